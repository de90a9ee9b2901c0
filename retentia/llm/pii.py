"""Personal data: detected entities are replaced by keyed surrogates of the same type and format.

Detected are e-mail addresses, phone numbers, IPv4 addresses, payment cards (check digit and
issuer prefix), IBANs (check digits), social security numbers, secrets after a naming word, and
person names (a known given name or a title before capitalized words). A card or an IBAN may have
more groups behind it (expiry, security code, BIC): it ends where its checks hold, at its issuer's
or country's length if they hold there.

A surrogate depends on the key, the type and the normalized entity alone, so one entity reads the
same everywhere (coreference). Digits and letters go through a keyed permutation of the strings
of that format, so two entities of one format never meet; what punctuation, case and script show
stays. Names keep gender and script: given names are dealt within lists, surnames keep length and
script through the same permutation. Where a format leaves a surrogate that is also the original
of another entity, or two entities of different formats meet, the collision check finds it among
all entities of the corpus and the later one is keyed anew until all are distinct.

Null texts stay null; texts without entities stay as they are, byte for byte. Empty tables give
no rows. Other columns pass through.
"""

import hashlib
import hmac
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F, types as T

from retentia.llm.common import as_strings, bounded_batches
from retentia.sources.staging import stage

# Given names by gender and script, titles by gender, issuer prefixes.
GIVEN = {
    ("f", "latin"): "Anna Maria Laura Julia Sophie Emma Clara Elena Alice Sarah Marie Lucia "
    "Carmen Nora Paula Ines Helene Martha Olivia Amelia Mary Jennifer Linda Susan".split(),
    ("m", "latin"): "Peter Paul Thomas Martin Daniel Lucas Jonas David Robert Hugo Pierre Carlos "
    "Pablo Antonio Felix Oscar Simon Albert Henry Louis John James Michael William".split(),
    ("f", "cyrillic"): "Анна Мария Елена Ольга Ирина Наталья Светлана Татьяна".split(),
    ("m", "cyrillic"): "Иван Пётр Сергей Алексей Дмитрий Николай Андрей Павел".split(),
    ("f", "greek"): "Μαρία Ελένη Αικατερίνη Σοφία Άννα Ειρήνη".split(),
    ("m", "greek"): "Γεώργιος Δημήτριος Νικόλαος Ιωάννης Πέτρος Παύλος".split(),
}
TITLES = {
    "f": "Mrs Ms Miss Frau Madame Mme Mlle Señora Sra".split(),
    "m": "Mr Herr Monsieur Señor Sr".split(),
    "": "Dr Prof".split(),
}
CARD_PREFIX = re.compile(r"4|5[1-5]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)|6011|64[4-9]|65|3[47]|35")
#: Digits of a card by its issuer prefix, characters of an IBAN by its country.
CARD_LENGTHS = [
    (re.compile("4"), {13, 16, 19}), (re.compile("5[1-5]|2"), {16}), (re.compile("3[47]"), {15}),
    (re.compile("6|35"), {16, 17, 18, 19}),
]
IBAN_LENGTHS = {
    country: n for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK",
        21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
        24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
        27: "BI DJ FR GR IT MC SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
        30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items() for country in countries.split()
}

ALPHABETS = {
    "digit": "0123456789",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "hex": "0123456789abcdef",
    "cyr": "абвгдежзийклмнопрстуфхцчшщъыьэюя",
    "CYR": "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ",
    "grk": "αβγδεζηθικλμνξοπρστυφχψω",
    "GRK": "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
}
_OF = {}
for _name in ("digit", "lower", "upper", "cyr", "CYR", "grk", "GRK"):
    _OF |= dict.fromkeys(ALPHABETS[_name], _name)

_NAME = r"[^\W\d_]+(?:[-'][^\W\d_]+)?"
_TITLE = "|".join(t for ts in TITLES.values() for t in ts)
_FIRST = "|".join(sorted({n for ns in GIVEN.values() for n in ns}, key=len, reverse=True))
PATTERNS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}",
    "secret": r"(?i:\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\b"
    r"[\"']?\s*[:=]\s*[\"']?)(?P<secret_value>[A-Za-z0-9+/_-]{16,}={0,2})",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "card": r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\w)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?![\w-])"
    r"|(?<![\w)])\(\d{3}\) ?\d{3}-\d{4}(?![\w-])|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w.-])",
    "name": rf"\b(?:(?:{_TITLE})\.? (?P<titled>[^\W\d_a-z]{_NAME}(?: [^\W\d_a-z]{_NAME}){{0,2}})"
    rf"|(?P<known>(?:{_FIRST}) [^\W\d_a-z]{_NAME}))\b",
}
#: A text can only hold an entity if it has one of these; most texts stop here. Matched by Arrow,
#: in time linear in the text.
HINT = r"@|\d\D?\d\D?\d|(?i:token|secret|passw|key)|" + f"(?:{_TITLE}|{_FIRST})[. ]"
ENTITY = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS.items()))
FOUND = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("value", T.StringType())]))


@dataclass(frozen=True)
class Surrogates:
    key: str = "corpus-surrogates-1"
    rounds: int = 10
    most_attempts: int = 20
    #: Entities that were keyed anew and are broadcast at most.
    most_shared: int = 100_000


def _luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d)
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10


def _card_ok(value):
    digits = re.sub(r"[ -]", "", value)
    return 13 <= len(digits) <= 19 and bool(CARD_PREFIX.match(digits)) and _luhn(digits) == 0


def _iban_ok(value):
    v = value.replace(" ", "")
    return len(v) >= 15 and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def _span(match):
    """(kind, start, end) of a match, or None if a check fails."""
    kind = match.lastgroup
    for group, of in (("secret_value", "secret"), ("titled", "name"), ("known", "name")):
        if match.group(group) is not None:
            return of, *match.span(group)
    if kind in ("card", "iban"):
        end = _checked_end(kind, match.group())
        return end and (kind, match.start(), match.start() + end)
    return kind, *match.span()


def _checked_end(kind, value):
    """Where a card or an IBAN at the start of a match ends: at its end or at a group's border.

    Ends at a length of the issuer or country go first, then longer ones; None if no check holds.
    """
    ends = [m.start() for m in re.finditer(r"[ -]|\Z", value)]
    size = {end: len(re.sub(r"[ -]", "", value[:end])) for end in ends}
    if kind == "card":
        usual = next((n for prefix, n in CARD_LENGTHS if prefix.match(value)), ())
    else:
        usual = {IBAN_LENGTHS.get(value[:2])}
    ok = _card_ok if kind == "card" else _iban_ok
    for end in sorted(ends, key=lambda e: (size[e] not in usual, -e)):
        if ok(value[:end]):
            return end
    return None


def entities(text):
    """(kind, start, end) of every entity of a text, in order."""
    out, at = [], 0
    while m := ENTITY.search(text, at):
        got = _span(m)
        if got:
            out.append(got)
            at = max(got[2], m.start() + 1)
        else:
            # what failed as one kind may hold another
            at = m.start() + 1
            while at < len(text) and text[at].isalnum() and text[at - 1].isalnum():
                at += 1
    return out


def normal(kind, value):
    """The form in which mentions of one entity agree."""
    if kind == "email":
        return value.lower()
    if kind in ("card", "phone", "iban"):
        return re.sub(r"[ ().-]", "", value)
    return value


def _prf(conf, *parts):
    text = "\x1f".join(map(str, parts)).encode()
    return int.from_bytes(hmac.new(conf.key.encode(), text, hashlib.sha256).digest(), "big")


def permute(conf, label, bases, digits):
    """A keyed permutation of the digit strings over the given bases: two halves by turns."""
    half = len(digits) // 2
    if not half:
        return [(d + 1 + _prf(conf, label, "one", b) % (b - 1)) % b if b > 1 else d
                for d, b in zip(digits, bases)]
    a, b = list(digits[:half]), list(digits[half:])
    base_a, base_b = bases[:half], bases[half:]
    for r in range(conf.rounds):
        into, bases_in, other = (b, base_b, a) if r % 2 == 0 else (a, base_a, b)
        for k, base in enumerate(bases_in):
            if k % 32 == 0:
                h = _prf(conf, label, r, other, k)
            into[k] = (into[k] + h) % base
            h //= base
    return a + b


def _format(conf, label, text, hexadecimal=False):
    """Permute the letters and digits of a text; everything else shows through."""
    letters = text.lower() if hexadecimal else text
    of = dict.fromkeys(ALPHABETS["hex"], "hex") if hexadecimal else _OF
    at = [k for k, c in enumerate(letters) if c in of]
    alphabets = [ALPHABETS[of[letters[k]]] for k in at]
    shape = "".join(of.get(c, c)[0] if c in of else c for c in letters)
    got = permute(conf, f"{label}|{shape}", [len(x) for x in alphabets],
                  [x.index(letters[k]) for k, x in zip(at, alphabets)])
    out = list(text)
    for k, alphabet, d in zip(at, alphabets, got):
        out[k] = alphabet[d].upper() if hexadecimal and text.isupper() else alphabet[d]
    return "".join(out)


def _card(conf, label, digits):
    """Keep the issuer's first digit and the check digit's rule, permute the rest."""
    for walk in range(100):
        body = digits[0] + _format(conf, label, digits[1:-1])
        check = next(c for c in "0123456789" if _luhn(body + c) == 0)
        digits = body + check
        if CARD_PREFIX.match(digits):
            break
    return digits


def _iban(conf, label, value):
    body = _format(conf, label, value[4:])
    rest = int("".join(str(int(c, 36)) for c in body + value[:2] + "00")) % 97
    return f"{value[:2]}{98 - rest:02d}{body}"


def _ip(conf, label, value):
    return ".".join(map(str, permute(conf, label, [256] * 4, [int(x) for x in value.split(".")])))


def _name(conf, label, value):
    """Given name from the list of its gender and script, surnames permuted."""
    words = value.split(" ")
    out = []
    for k, word in enumerate(words):
        where = next((g for g, names in GIVEN.items() if word in names), None)
        if k == 0 and where and len(words) > 1:
            names = GIVEN[where]
            shift = 1 + _prf(conf, label, where) % (len(names) - 1)
            out.append(names[(names.index(word) + shift) % len(names)])
        else:
            out.append(_format(conf, label + "|surname", word))
    return " ".join(out)


def surrogate(conf, kind, value, attempt=0):
    """The surrogate of a normalized entity."""
    label = f"{kind}|{attempt}"
    if kind == "email":
        local, _, domain = value.partition("@")
        # the domain moves to a reserved one; what it was is part of the label of the local part
        host, _, top = domain.rpartition(".")
        host = _format(conf, label + "|host", host) + ".invalid"
        return _format(conf, f"{label}|{top}", local) + "@" + host
    if kind == "card":
        return _card(conf, label, value)
    if kind == "iban":
        return _iban(conf, label, value)
    if kind == "ip":
        return _ip(conf, label, value)
    if kind == "phone" and value.startswith("+"):
        # the country stays; one leading digit of it is enough to tell formats apart
        return value[:2] + _format(conf, label + value[:2], value[2:])
    if kind == "name":
        return _name(conf, label, value)
    if kind == "secret" and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value):
        return _format(conf, label, value, hexadecimal=True)
    return _format(conf, label, value)


def restore(kind, mention, normalized):
    """Write a surrogate in the format of the mention it replaces."""
    if kind in ("card", "phone", "iban"):
        chars = iter(normalized)
        return "".join(c if c in " ().-" else next(chars, "") for c in mention)
    if kind == "email" and mention.isupper():
        return normalized.upper()
    return normalized


def replace(text, conf=Surrogates(), attempts=None):
    """A text with its entities replaced; attempts: (kind, value) -> attempt where not 0."""
    out, at = [], 0
    for kind, start, end in entities(text):
        mention = text[start:end]
        value = normal(kind, mention)
        attempt = (attempts or {}).get((kind, value), 0)
        out += [text[at:start], restore(kind, mention, surrogate(conf, kind, value, attempt))]
        at = end
    return "".join([*out, text[at:]]) if out else text


def hinted(texts):
    """Which texts of an array may hold an entity."""
    return pc.match_substring_regex(as_strings(texts), HINT)


def _found(texts):
    """The normalized entities of each text of an array."""
    out = [None] * len(texts)
    for k in np.flatnonzero(hinted(texts).to_numpy(zero_copy_only=False)):
        t = texts[int(k)].as_py()
        out[k] = [{"kind": e, "value": normal(e, t[a:b])} for e, a, b in entities(t)]
    return pa.array(
        out, pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string())])))


def _cleaned(texts, conf, attempts):
    """The texts of an array replaced; attempts: position -> {(kind, value): attempt}."""
    mask = hinted(texts)
    new = [
        replace(texts[int(k)].as_py(), conf, attempts(int(k)))
        for k in np.flatnonzero(mask.to_numpy(zero_copy_only=False))
    ]
    return pc.replace_with_mask(texts, mask, pa.array(new, texts.type))


def corpus_entities(docs):
    """The distinct (kind, value) of all documents, staged."""
    bounded_batches(docs.sparkSession)

    @F.arrow_udf(FOUND)
    def find(texts: pa.Array) -> pa.Array:
        return _found(texts)

    found = docs.select(F.explode(find(F.col("`text`"))).alias("e")).select("e.kind", "e.value")
    return stage(found.distinct(), "pii-entities")


def collisions(known, conf=Surrogates()):
    """Entities whose first surrogate is not free: kind, value, attempt; empty as a rule.

    A surrogate is free if no entity has that value and no other entity got it before. Each round
    gives new surrogates to those that lost; only they are carried on.
    """

    def made(batches):
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in ("kind", "value", "attempt")))
            got = [surrogate(conf, k, v, a) for k, v, a in rows]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(got, pa.string())],
                names=["kind", "value", "attempt", "surrogate"])

    kinds = "kind string, value string, attempt int, surrogate string"
    placed = stage(known.withColumn("attempt", F.lit(0)).mapInArrow(made, kinds), "pii-made")
    originals = known.select(F.col("value").alias("surrogate")).distinct()
    lost = None
    for attempt in range(1, conf.most_attempts + 1):
        first = placed.groupBy("surrogate").agg(
            F.min(F.struct(F.col("attempt"), "kind", "value")).alias("owner"))
        held = placed.join(first, "surrogate").where(
            F.struct("attempt", "kind", "value") != F.col("owner")).drop("owner")
        taken = placed.join(originals, "surrogate", "left_semi").select(*held.columns)
        losers = stage(held.unionByName(taken).select("kind", "value").distinct(), "pii-losers")
        if losers.isEmpty():
            return lost
        again = losers.withColumn("attempt", F.lit(attempt)).mapInArrow(made, kinds)
        kept = placed.join(losers, ["kind", "value"], "left_anti")
        placed = stage(kept.unionByName(again), "pii-made")
        lost = placed.where("attempt > 0").select("kind", "value", "attempt")
    raise ValueError(f"surrogates still collide after {conf.most_attempts} attempts")


def with_surrogates(docs, conf=Surrogates()):
    """The documents, all columns, with entities in `text` replaced.

    Entities that were keyed anew are broadcast up to `conf.most_shared`; beyond that they are
    joined to the texts that hold them. Either way gives the same texts.
    """
    spark = docs.sparkSession
    lost = collisions(corpus_entities(docs), conf)
    text = F.col("`text`")
    if lost is not None and len(lost.take(conf.most_shared + 1)) > conf.most_shared:
        return _joined(docs, lost, conf)
    rows = [] if lost is None else lost.collect()
    shared = spark.sparkContext.broadcast({(r.kind, r.value): r.attempt for r in rows})

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        return _cleaned(texts, conf, lambda _: shared.value)

    return _with_text(docs, clean(text))


def _with_text(docs, text):
    cols = [text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return docs.select(*cols)


def _joined(docs, lost, conf):
    """Surrogates where many were keyed anew: attempts come to each text by its digest."""

    @F.arrow_udf(FOUND)
    def find(texts: pa.Array) -> pa.Array:
        return _found(texts)

    @F.arrow_udf("string")
    def clean(texts: pa.Array, attempts: pa.Array) -> pa.Array:
        of = lambda k: {
            (x["kind"], x["value"]): x["attempt"] for x in attempts[k].as_py() or []}
        return _cleaned(texts, conf, of)

    digest = F.sha2(F.col("`text`").cast("binary"), 256)
    held = docs.select(digest.alias("_digest"), F.explode(find(F.col("`text`"))).alias("e"))
    held = held.select("_digest", "e.kind", "e.value").distinct().join(lost, ["kind", "value"])
    held = stage(held.groupBy("_digest").agg(
        F.collect_list(F.struct("kind", "value", "attempt")).alias("_attempts")), "pii-attempts")
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    rows = docs.select(own, digest.alias("_digest")).join(held, "_digest", "left")
    new = clean(F.col("_doc.text"), F.col("_attempts"))
    return rows.select(*[
        new.alias(c) if c == "text" else F.col(f"_doc.`{c}`") for c in docs.columns])
