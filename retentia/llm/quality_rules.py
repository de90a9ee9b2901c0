"""Quality rules whose cutoffs come with a limit on false rejections in every stratum.

Each rule is a measure of a text where more is worse; a document is rejected if any measure lies
above the stratum's cutoff. Cutoffs come from labelled documents in two halves, dealt by a hash
of the id. The first half proposes a ladder of cutoffs per stratum, from the largest value among
good documents to ever stricter quantiles. The second half certifies it: going up the ladder, a
step is taken if the exact binomial bound says that at most `limit` of the good documents are
rejected by any rule. Steps are tested in a fixed order, so a stratum spends its error once; the
strata share `error` equally (Bonferroni). With probability 1 - error, the limit holds in all
strata at once. A stratum without enough good documents gets no cutoffs and keeps what passes the
base rules.

Counts of labelled documents cover all of them; there is no sample. Null texts count as empty,
a null stratum is a stratum of its own, null ids have no label, an empty table gives no rows.
Labels that are repeated for one id count once, as the worse one.
"""

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F, types as T

from retentia.llm.common import (
    SHINGLE, WORD, as_strings, bounded_batches, mix, split_words, struct_of, windows,
    word_codes,
)
from retentia.sources.staging import stage

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper",
    "n_marks",
)
KIND = struct_of(**{c: T.LongType() for c in COUNTS})


@dataclass(frozen=True)
class Risk:
    limit: float = 0.05
    error: float = 0.05
    #: Share of good documents each step of the ladder gives up, over all rules.
    ladder: tuple = (0.0, 0.001, 0.002, 0.005, 0.01, 0.02, 0.03, 0.04)
    #: Measures are counted on a grid of this step.
    grid: float = 0.002
    seed: int = 11


#: Measures, in the columns of COUNTS; more is worse.
RULES = {
    "symbols": "n_symbols / greatest(n_words, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "same_lines": "n_dup_lines / greatest(n_lines, 1)",
    "upper": "n_upper / greatest(word_chars, 1)",
    "marks": "n_marks / greatest(n_words, 1)",
}


def repeated_words(codes, bounds):
    """For each text, its words inside windows of five words that occur twice or more in it."""
    n_texts = len(bounds) - 1
    if len(codes) < SHINGLE:
        return np.zeros(n_texts, np.int64)
    text = np.repeat(np.arange(n_texts), np.diff(bounds))
    starts = np.arange(len(codes) - SHINGLE + 1)
    starts = starts[starts + SHINGLE <= bounds[1:][text[starts]]]
    with np.errstate(over="ignore"):
        seed = mix(text[starts].astype(np.uint64) + np.uint64(1))
        keys = windows(mix(codes.astype(np.uint64) + np.uint64(1)))[starts] ^ seed
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(n_texts, np.int64)
    slot = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    found = np.flatnonzero(twice[slot] == keys)
    # equal keys stand for equal windows: compare each with the first one of its key
    found = found[np.argsort(slot[found], kind="stable")]
    first = found[np.searchsorted(slot[found], slot[found])]
    span = np.arange(SHINGLE)
    same = (codes[starts[found][:, None] + span] == codes[starts[first][:, None] + span]).all(1)
    edges = np.zeros(len(codes) + 1, np.int64)
    np.add.at(edges, starts[found[same]], 1)
    np.add.at(edges, starts[found[same]] + SHINGLE, -1)
    covered = np.concatenate(([0], np.cumsum(np.cumsum(edges)[:-1] > 0)))
    return covered[bounds[1:]] - covered[bounds[:-1]]


def _per_text(values, bounds):
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def same_lines(texts):
    """For each text: lines with a word that equal an earlier line, and all lines with a word."""
    lists = pc.split_pattern(texts, "\n")
    lines = lists.flatten()
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    offsets = offsets - offsets[0]
    full = pc.match_substring_regex(lines, WORD).to_numpy(zero_copy_only=False)
    codes = lines.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), np.diff(offsets))
    n_lines = np.bincount(text[full], minlength=len(texts))
    keys = np.unique(text[full] * (codes.max(initial=0) + 1) + codes[full])
    distinct = np.bincount(keys // (codes.max(initial=0) + 1), minlength=len(texts))
    return n_lines - distinct, n_lines


def count_texts(array):
    """The COUNTS of each text of an array."""
    texts = as_strings(array)
    words, bounds = split_words(texts)
    codes, _ = word_codes(words)
    same, lines = same_lines(texts)
    numbers = lambda x: x.to_numpy(zero_copy_only=False).astype(np.int64)
    return [
        np.diff(bounds),
        _per_text(numbers(pc.utf8_length(words)), bounds),
        numbers(pc.count_substring_regex(texts, r"[#*$%&|<>]")),
        same,
        repeated_words(codes, bounds),
        lines,
        numbers(pc.count_substring_regex(texts, r"\p{Lu}")),
        numbers(pc.count_substring(texts, "!")),
    ]


@F.arrow_udf(KIND)
def counts(texts: pa.Array) -> pa.Array:
    made = [pa.array(x, pa.int64()) for x in count_texts(texts)]
    return pa.StructArray.from_arrays(made, names=list(COUNTS))


def measured(docs, stratum="lang"):
    """doc_id, stratum and counts of every document; staged, so that texts are read once."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(
        F.col("`doc_id`").alias("doc_id"),
        F.col(f"`{stratum}`").cast("string").alias("stratum"),
        counts(F.col("`text`")).alias("counts"),
    ).select("doc_id", "stratum", "counts.*")
    failed = "n_words < 10 or 100 * n_repeat_words > 20 * n_words"
    return stage(rows.withColumn("base_failed", F.expr(failed)), "quality-counts")


def upper_bound_holds(k, n, limit, error):
    """Whether k rejections among n good documents prove a rate of at most limit.

    The exact binomial tail P(X <= k | n, limit) is at most error, which is to say that the
    upper bound of Clopper and Pearson at that error is at most limit.
    """
    if k >= n * limit:
        return False
    base, tail = n * math.log1p(-limit), 0.0
    for i in range(int(k) + 1):
        log_c = math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1)
        tail += math.exp(base + log_c + i * (math.log(limit) - math.log1p(-limit)))
    return tail <= error


def _propose(risk):
    """Cutoffs of each step from the counted grid of one stratum's good documents."""

    def run(key, pdf):
        out = []
        for step, given_up in enumerate(risk.ladder):
            row = {"step": step}
            for rule in RULES:
                cells = pdf[pdf.rule == rule].sort_values("cell")
                total = cells.n.cumsum()
                need = (1 - given_up / len(RULES)) * cells.n.sum()
                at = min(int(np.searchsorted(total, need - 1e-9)), len(cells) - 1)
                row[rule] = float(cells.cell.iloc[at]) * risk.grid
            out.append(row)
        made = pd.DataFrame(out)
        made.insert(0, "stratum", pd.Series([key[0]] * len(made), dtype=object))
        return made

    return run


def _certify(risk, n_strata):
    """Of the steps up to which all are certified, the one that tells good from poor best.

    All of them hold at once, so any may be taken: the one with the largest share of poor
    documents caught less good ones rejected, the earlier one on a tie.
    """

    def run(key, pdf):
        best, gain = None, -1.0
        for r in pdf.sort_values("step").itertuples():
            if not upper_bound_holds(r.rejected, r.n, risk.limit, risk.error / n_strata):
                break
            now = r.caught / max(r.poor, 1) - r.rejected / max(r.n, 1)
            if now > gain + 1e-12:
                best, gain = r, now
        cols = ["step", *RULES]
        if best is None:
            return pd.DataFrame({"stratum": pd.Series([], dtype=object), **{c: [] for c in cols}})
        name = pd.Series([key[0]], dtype=object)
        return pd.DataFrame({"stratum": name, **{c: [getattr(best, c)] for c in cols}})

    return run


def over(cutoffs=""):
    """Whether any measure lies above its cutoff."""
    tests = [f"coalesce(({m}) > {cutoffs}`cut_{r}` + 1e-9, false)" for r, m in RULES.items()]
    return F.expr(" or ".join(tests))


def select_cutoffs(rows, labels, risk=Risk()):
    """One row per certified stratum: stratum, step, cut_<rule>."""
    spark = rows.sparkSession
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"))
    half = F.pmod(F.xxhash64("doc_id", F.lit(risk.seed)), F.lit(2))
    labelled = rows.where(~F.col("base_failed")).join(known, "doc_id").withColumn("half", half)
    labelled = stage(labelled, "quality-labelled")
    cells = labelled.where("q = 1 and half = 0").select(
        "stratum",
        F.explode(F.array(*[
            F.struct(F.lit(r).alias("rule"),
                     F.ceil(F.expr(m) / risk.grid - 1e-9).alias("cell"))
            for r, m in RULES.items()
        ])).alias("c"),
    ).groupBy("stratum", "c.rule", "c.cell").agg(F.count("*").alias("n"))
    kinds = ", ".join(f"{r} double" for r in RULES)
    # a stratum's grid is bounded by the steps of the grid, whatever the number of documents
    ladder = cells.groupBy("stratum").applyInPandas(
        _propose(risk), f"stratum string, step int, {kinds}")
    ladder = stage(ladder, "quality-ladder")
    n_strata = max(1, ladder.select("stratum").distinct().count())
    cut = ladder.select(F.col("stratum").alias("_s"), "step",
                        *[F.col(r).alias(f"cut_{r}") for r in RULES])
    held = labelled.where("q = 0 or half = 1")
    tried = held.join(cut, F.col("stratum").eqNullSafe(F.col("_s")))
    tried = tried.withColumn("over", over()).groupBy("stratum", "step").agg(
        F.count_if(F.expr("q = 1")).alias("n"), F.count_if(F.expr("q = 1 and over")).alias("rejected"),
        F.count_if(F.expr("q = 0")).alias("poor"), F.count_if(F.expr("q = 0 and over")).alias("caught"),
        *[F.first(f"cut_{r}").alias(r) for r in RULES])
    chosen = tried.groupBy("stratum").applyInPandas(
        _certify(risk, n_strata), f"stratum string, step int, {kinds}")
    chosen = chosen.select("stratum", "step", *[F.col(r).alias(f"cut_{r}") for r in RULES])
    return stage(chosen, "quality-cutoffs")


def judged(docs, labels, stratum="lang", risk=Risk()):
    """doc_id, counts, base_failed, the stratum's cutoffs and kept for every document."""
    rows = measured(docs, stratum)
    cut = select_cutoffs(rows, labels, risk).withColumnRenamed("stratum", "_s")
    out = rows.join(cut, F.col("stratum").eqNullSafe(F.col("_s")), "left").drop("_s")
    return out.withColumn("kept", ~F.col("base_failed") & ~over())
