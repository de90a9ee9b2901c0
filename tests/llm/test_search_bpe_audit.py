"""Ball-tree search, byte-level BPE and the filter audit: brute force, edge cases, recovery."""

import math
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from retentia.llm import ball_search, bpe, filter_audit

DOCS = "doc_id long, text string, source string, ids string, rank int, key string, n int"
LONG = " ".join(f"w{i % 997}x{i}" for i in range(60_000))


def docs_of(spark, rows, parts=3):
    rows = [(i, t, s, "x", 1, "k", 2) for i, t, s in rows]
    return spark.createDataFrame(rows, DOCS).repartition(parts)


# --- search ---

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute_search(docs, items, top=10):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, n in counted:
            m = 25 + (75 * n * n_docs) // n_terms
            score = sum(
                k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                for t, k in Counter(terms(text)).items() if t in c)
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, k, s[3], -s[0]) for k, s in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=str)


def searched(docs, items, **more):
    return sorted(map(tuple, ball_search.searched(docs, items, **more).collect()), key=str)


@pytest.mark.parametrize("leaf", [2, 128])
def test_search_equals_brute_force(spark, monkeypatch, leaf):
    rng = random.Random(leaf)
    words = [f"w{i}" for i in range(120)] + ["É", "é", "Ab", "aB"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(60))), "s") for i in range(600)]
    docs += [(700 + i, docs[5][1], "s") for i in range(80)]  # copies: ties by id
    items = [(i, " ".join(rng.choices(words, k=12)) + " W1, w1!") for i in range(30)]
    items.append((99, docs[5][1]))
    monkeypatch.setattr(ball_search, "LEAF", leaf)
    monkeypatch.setattr(ball_search, "TREE_DOCS", 100)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert searched(docs_of(spark, docs), bench) == brute_search([d[:2] for d in docs], items)


def test_search_edges(spark):
    rows = [(1, "one Two, three", "s"), (1, "one Two, three", "s"), (None, "two", "s"),
            (2, None, "s"), (3, "", "s"), (4, " ..\n", "s"), (5, LONG + " two", "s")]
    items = [(1, "TWO two"), (1, "TWO two"), (2, None), (3, ""), (None, "w1x1 nowhere"), (4, "zzz")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert searched(docs_of(spark, rows), bench) == brute_search([r[:2] for r in rows], items)
    assert searched(docs_of(spark, rows), bench.limit(0)) == []
    assert searched(docs_of(spark, rows).limit(0), bench) == []


def test_bounds_hold_and_prune():
    """No document scores above the bound of a ball around it; far balls are not opened."""
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 6, 3000)
    group = np.repeat(np.arange(3000) % 20, sizes)  # twenty groups of terms that do not meet
    indptr = np.concatenate(([0], np.cumsum(sizes)))
    terms_ = group * 40 + np.arange(sizes.sum()) - np.repeat(indptr[:-1], sizes)
    values = rng.integers(1, 1_000_000, sizes.sum())
    row = ball_search.build_tree(np.arange(3000), indptr, terms_, values)
    tree = ball_search.Tree({k: np.asarray(v) for k, v in row.items()})
    weights = {t: int(w) for t, w in zip(range(120, 123), (9000, 8000, 7000))}
    exact = np.add.reduceat(
        np.array([weights.get(t, 0) for t in terms_.tolist()]) * values, indptr[:-1])
    w = np.zeros(len(tree.vocabulary))
    for t, x in weights.items():
        w[np.searchsorted(tree.vocabulary, t)] = x
    bound = tree.centres.astype(float) @ w + np.linalg.norm(w) * tree.radius
    for node in range(len(tree.low)):
        inside = tree.ids[tree.low[node] : tree.high[node]]
        assert exact[inside].max() <= bound[node] * (1 + 1e-9) + 1
    kept = ball_search.Kept(1, 10)
    tree.search(np.array(list(weights)), np.array(list(weights.values())), kept)
    assert kept.scores.tolist() == sorted(exact.tolist(), reverse=True)[:10]
    leaves = sum(1 for x in tree.left if x == 0)
    assert tree.opened < leaves


# --- BPE ---


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.read(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding(
        "own", pat_str=P.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def test_perfect_hash_is_minimal(vocabulary):
    table, keys = vocabulary.whole, list(vocabulary.ranks)
    assert len(table.keys) == len(keys) and set(table.keys) == set(keys)
    assert table.find(keys).tolist() == [vocabulary.ranks[k] for k in keys]
    assert table.find([b"\x00no such token", b""]).tolist() == [-1, -1]
    assert bpe.PerfectHash([], []).find([b"a"]).tolist() == [-1]
    with pytest.raises(ValueError):
        bpe.PerfectHash([b"a", b"a"], [1, 2])


def test_bpe_equals_the_library(spark, vocabulary, library, monkeypatch):
    rng = random.Random(3)
    alphabet = [*range(0x09, 0x250), *range(0x300, 0x380), *range(0x4E00, 0x4E80), 0x1F600, 0x2028]
    texts = ["".join(map(chr, rng.choices(alphabet, k=rng.randrange(400)))) for _ in range(200)]
    texts += ["", " \n\n\t x  y", "a" * 5000, "<|endoftext|>", "Don't they've", LONG, LONG]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(None, None, None)]
    docs = docs_of(spark, rows)
    got = {r.doc_id: r.ids for r in bpe.encoded(docs, vocabulary).collect()}
    want = {i: library.encode_ordinary(t or "") for i, t, _ in rows}
    assert got == want
    back = bpe.decoded(bpe.encoded(docs, vocabulary), vocabulary).collect()
    assert {r.doc_id: bytes(r.bytes) for r in back} == {i: (t or "").encode() for i, t, _ in rows}
    monkeypatch.setattr(bpe, "LONG_TEXT", 50)
    monkeypatch.setattr(bpe, "KNOWN_PIECES", 20)
    encoder = bpe.Encoder(vocabulary)
    assert encoder.encode(bpe.pa.array(texts)).to_pylist() == [want[i] for i in range(len(texts))]


def test_bpe_digests(spark, vocabulary, library):
    import hashlib

    text = "Grüße, 42 words…"
    docs = docs_of(spark, [(1, text, "s"), (2, None, "s"), (1, text, "s")])
    rows = bpe.digests(bpe.encoded(docs, vocabulary), vocabulary).collect()
    ids = np.array(library.encode_ordinary(text), "<u4")
    none = hashlib.sha256(b"").hexdigest()
    one = (1, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(),
           hashlib.sha256(text.encode()).hexdigest())
    assert sorted(map(tuple, rows)) == [one, one, (2, 0, none, none)]
    empty = docs.limit(0)
    assert bpe.digests(bpe.encoded(empty, vocabulary), vocabulary).count() == 0


# --- audit ---


def brute_audit(rows, labels):
    least, good, bad = {}, Counter(), Counter()
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, q, x in labels:
        if i is not None:
            good[i] |= q == 1
            bad[i] |= x == 1
    out = {}
    for i, text, source in rows:
        text = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and i > least[text],
        }
        failed = [f for f in "ABCDE" if fails[f]]
        for order in permutations("ABCDE"):
            gone = False
            for step, f in enumerate(order, 1):
                at = out.setdefault((source or "", "".join(order), step), [0] * 7)
                here = fails[f] and not gone
                at[0] += not gone and not fails[f]
                at[1] += here
                at[2] += fails[f] and gone
                at[3] += failed == [f]
                at[4] += here and good[i]
                at[5] += here and bad[i]
                at[6] += 120 // len(failed) if fails[f] else 0
                gone |= fails[f]
    return {(*k, *map(int, v)) for k, v in out.items()}


def audited(spark, path, labels, **more):
    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails",
               "good_lost", "toxic_lost", "shapley"]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, part string")
    return {tuple(r) for r in filter_audit.audit(spark, path, table, **more).select(*columns).collect()}


def audit_rows():
    rng = random.Random(5)
    texts = ["", None, "A b c " * 100, " ".join(f"w{i}" for i in range(250)), "# x", "B" * 30, LONG]
    rows = [(i, rng.choice(texts), rng.choice(["a", "b", None])) for i in range(300, 0, -1)]
    rows += [(None, "# x", "a"), (None, "# x", None), (7, "# x", "a"), (7, "# x", "b")]
    labels = [(i, i % 2, i % 3 == 0, "p") for i in range(0, 320, 2)] + [(4, 1, 1, "p"), (None, 1, 1, "p")]
    return rows, [(i, int(q), int(x), p) for i, q, x, p in labels]


def test_audit_retracts(spark, tmp_path):
    """Ids fall from file to file, so every micro-batch retracts what earlier ones counted."""
    rows, labels = audit_rows()
    path = str(tmp_path / "documents.parquet")
    for k in range(4):
        some = rows[k * 76 : k * 76 + 76]
        docs_of(spark, some, 1).write.mode("append").parquet(path)
    assert len(rows) == spark.read.parquet(path).count()
    want = brute_audit(rows, [r[:3] for r in labels])
    assert audited(spark, path, labels) == want
    assert audited(spark, path, labels, rounds=1) == want


def test_audit_goes_on_after_new_files_and_lost_batches(spark, tmp_path):
    rows, labels = audit_rows()
    path, root = str(tmp_path / "documents.parquet"), str(tmp_path / "root")
    docs_of(spark, rows[:150], 1).write.parquet(path)
    first = audited(spark, path, labels, root=root)
    assert first == brute_audit(rows[:150], [r[:3] for r in labels])
    docs_of(spark, rows[150:], 1).write.mode("append").parquet(path)
    whole = brute_audit(rows, [r[:3] for r in labels])
    assert audited(spark, path, labels, root=root) == whole
    # the last batch ran, but its commit is lost: it runs again and replaces what it wrote
    commits = sorted((tmp_path / "root/checkpoint/commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()
    (commits[-1].parent / f".{commits[-1].name}.crc").unlink()
    assert audited(spark, path, labels, root=root) == whole


def test_audit_of_nothing(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    docs_of(spark, [], 1).write.parquet(path)
    assert audited(spark, path, [(1, 1, 1, "p")]) == set()
