"""Toxicity scores from subword-bag embeddings and a linear softmax, trained in numpy.

A word is the bag of its character n-grams (between word marks) and of itself, each hashed to a
row of an embedding table; a text is the mean over its words; a linear softmax on top gives the
probability of label 1. Table and softmax are trained jointly. Misspellings share most n-grams
with the words they come from.

Training reads a bounded sample of labelled rows (`Model.per_label` of each label, in the order
of a hash of the id); their texts are reduced to bags in tasks, so the driver gets numbers only.
Scores cover every row and the whole text: since the softmax is linear in the mean, each word has
a fixed share of the logit, found once for each distinct word of a batch.

Null and empty texts get the score of a text without words. Without labels of both kinds every
score is the share of label 1 among them (0 without labels). Null ids are never labelled.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from retentia.llm.common import as_strings, bounded_batches, mix, split_words, word_codes


@dataclass(frozen=True)
class Model:
    shortest: int = 3
    longest: int = 5
    #: At most 2 ** 16, since bags are packed in 16 bits.
    buckets: int = 1 << 16
    width: int = 8
    #: Labelled rows taken of each label; the bound of the sample.
    per_label: int = 4000
    epochs: int = 6
    batch: int = 32
    step: float = 0.03
    decay: float = 0.003
    #: Means over many words are small; this puts them in the range the steps are made for.
    scale: float = 16.0
    seed: int = 7


def subwords(distinct, model=Model()):
    """Bucket of every n-gram of the words of an array, and the index of its word."""
    lower = pc.utf8_lower(as_strings(distinct))
    text = pc.binary_join_element_wise("<", lower, ">", "")
    sizes = pc.utf8_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
    chars = np.frombuffer("".join(text.to_pylist()).encode("utf-32-le"), dtype=np.uint32)
    ends = np.cumsum(sizes)
    word_of = np.repeat(np.arange(len(sizes)), sizes)
    room = ends[word_of] - np.arange(len(chars))
    codes = chars.astype(np.uint64) + np.uint64(1)
    rolled, buckets, owners = np.zeros(len(chars), np.uint64), [], []
    with np.errstate(over="ignore"):
        for n in range(1, model.longest + 1):
            shifted = np.zeros(len(chars), np.uint64)
            shifted[: len(chars) - n + 1] = codes[n - 1 :]
            rolled = rolled * np.uint64(0x100000001B3) + shifted
            if n >= model.shortest:
                at = np.flatnonzero(room >= n)
                buckets.append(mix(rolled[at] ^ np.uint64(n << 56)))
                owners.append(word_of[at])
        # the word itself, as one more n-gram
        place = np.arange(len(chars), dtype=np.uint64) - np.repeat(
            (ends - sizes).astype(np.uint64), sizes)
        whole = mix(codes * np.uint64(0x9E3779B97F4A7C15) + mix(place))
    if len(sizes):
        buckets.append(mix(np.add.reduceat(whole, ends - sizes)))
        owners.append(np.arange(len(sizes)))
    buckets = np.concatenate(buckets) if buckets else np.zeros(0, np.uint64)
    owners = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    return (buckets % np.uint64(model.buckets)).astype(np.int64), owners


def bags(array, model=Model()):
    """For each text: buckets and their weights in the mean over words of the mean over n-grams."""
    words, bounds = split_words(array)
    codes, distinct = word_codes(words)
    hashed, owners = subwords(distinct, model)
    order = np.argsort(owners, kind="stable")
    hashed, counts = hashed[order], np.bincount(owners, minlength=len(distinct))
    starts = np.cumsum(counts) - counts
    for a, b in zip(bounds[:-1], bounds[1:]):
        if a == b:
            yield np.zeros(0, np.int32), np.zeros(0, np.float32)
            continue
        used, times = np.unique(codes[a:b], return_counts=True)
        n = counts[used]
        at = np.repeat(starts[used] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        weights = np.bincount(
            hashed[at], weights=np.repeat(times / n, n), minlength=model.buckets) / (b - a)
        keep = np.flatnonzero(weights)
        yield keep.astype(np.int32), weights[keep].astype(np.float32)


#: Bags travel as 16-bit numbers, weights times this.
PACK = 4096


def train(samples, labels, model=Model(), pack=1):
    """Embeddings and softmax by Adam on mini-batches; (score of each bucket, bias).

    samples: (buckets, weights times pack) of each text. Returns the logit of label 1 against 0.
    """
    rng = np.random.default_rng(model.seed)
    labels = np.asarray(labels, dtype=np.int64)
    share = labels.mean() if len(labels) else 0.0
    if share in (0.0, 1.0):
        return np.zeros(model.buckets, np.float32), 40.0 if share else -40.0
    # from zero, so that n-grams which the sample does not have say nothing
    table = np.zeros((model.buckets, model.width), np.float32)
    softmax = rng.normal(0, 0.1, (model.width, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    params, moments = [table, softmax, bias], []
    for p in params:
        moments.append((np.zeros_like(p), np.zeros_like(p)))
    scale, t = model.scale, 0
    steps = model.epochs * -(-len(samples) // model.batch)
    for _ in range(model.epochs):
        order = rng.permutation(len(samples))
        for k in range(0, len(order), model.batch):
            part = order[k : k + model.batch]
            sizes = np.array([len(samples[i][0]) for i in part])
            used = np.concatenate([samples[i][0] for i in part]).astype(np.int64)
            w = np.concatenate([samples[i][1] for i in part]).astype(np.float32) * np.float32(scale / pack)
            doc = np.repeat(np.arange(len(part)), sizes)
            mean = np.zeros((len(part), model.width), np.float32)
            for d in range(model.width):
                mean[:, d] = np.bincount(doc, weights=table[used, d] * w,
                                         minlength=len(part))
            logits = mean @ softmax + bias
            logits -= logits.max(1, keepdims=True)
            p = np.exp(logits)
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), labels[part]] -= 1
            g = p / len(part)
            back = (g @ softmax.T).astype(np.float32)
            grads = [np.empty_like(table), mean.T @ g, g.sum(0)]
            for d in range(model.width):
                grads[0][:, d] = np.bincount(used, weights=back[doc, d] * w,
                                             minlength=model.buckets)
            t += 1
            left = 1 - (t - 1) / steps
            rate = model.step * left * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
            for q, (m, v), x in zip(params, moments, grads):
                m *= 0.9
                m += 0.1 * x
                v *= 0.999
                v += 0.001 * x * x
                q -= np.float32(rate) * (m / (np.sqrt(v) + 1e-8) + model.decay * q)
    line = softmax[:, 1] - softmax[:, 0]
    return (table @ line * scale).astype(np.float32), float(bias[1] - bias[0])


def scorer(weights, bias, model=Model()):
    """An Arrow function: texts -> probabilities of label 1."""

    def score(array):
        words, bounds = split_words(array)
        codes, distinct = word_codes(words)
        hashed, owners = subwords(distinct, model)
        counts = np.maximum(np.bincount(owners, minlength=len(distinct)), 1)
        of_word = np.bincount(owners, weights=weights[hashed], minlength=len(distinct)) / counts
        total = np.concatenate(([0.0], np.cumsum(of_word[codes])))
        n = np.maximum(bounds[1:] - bounds[:-1], 1)
        logit = (total[bounds[1:]] - total[bounds[:-1]]) / n + bias
        return pa.array(1 / (1 + np.exp(-np.clip(logit, -40, 40))), pa.float64())

    return score


def _packed(model):
    def run(batches):
        for batch in batches:
            made = list(bags(batch.column("text"), model))
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"),
                 pa.array([a.astype(np.uint16).tobytes() for a, _ in made], pa.binary()),
                 pa.array([(b * PACK).astype(np.float16).tobytes() for _, b in made], pa.binary())],
                names=["label", "buckets", "weights"])

    return run


def fit(docs, labels, model=Model()):
    """Train on a bounded sample of the labelled rows (doc_id, label) among the documents."""
    spark = docs.sparkSession
    bounded_batches(spark)
    known = labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(
        F.max("label").alias("label"))
    chosen = None
    for label in (0, 1):
        some = known.where(F.col("label") == label).orderBy(
            F.xxhash64("doc_id", F.lit(model.seed)), "doc_id").limit(model.per_label)
        chosen = some if chosen is None else chosen.unionByName(some)
    # at most 2 * per_label ids, so the broadcast is bounded
    sample = docs.select(F.col("`doc_id`").alias("doc_id"), F.col("`text`").alias("text")).join(
        F.broadcast(chosen), "doc_id")
    # one text per id, the least, so that repeated ids send no more than one bag
    rows = sample.groupBy("doc_id").agg(
        F.min("text").alias("text"), F.first("label").cast("int").alias("label"))
    packed = rows.select("label", "text").mapInArrow(
        _packed(model), "label int, buckets binary, weights binary")
    # one row after the other: at most 2 * per_label bags of at most `buckets` numbers
    got = sorted((r.label, bytes(r.buckets), bytes(r.weights)) for r in packed.toLocalIterator())
    weights, bias = train(
        [(np.frombuffer(b, np.uint16), np.frombuffer(w, np.float16)) for _, b, w in got],
        [x for x, _, _ in got], model, PACK)
    # the sample holds as many of each label as it may, so put the true shares back
    n = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    taken = [sum(x == label for x, _, _ in got) for label in (0, 1)]
    if all(taken):
        bias += float(np.log(n[1] / n[0]) - np.log(taken[1] / taken[0]))
    return weights, bias


def score_column(spark, text, fitted, model=Model()):
    """Column of scores of a text column."""
    bounded_batches(spark)
    weights, bias = fitted
    shared = spark.sparkContext.broadcast(weights)  # one float per bucket, whatever the data

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return scorer(shared.value, bias, model)(texts)

    return score(text)


def scored(docs, labels, model=Model()):
    """doc_id, score, predicted of every document; labels: (doc_id, label)."""
    fitted = fit(docs, labels, model)
    out = docs.select(
        F.col("`doc_id`").alias("doc_id"),
        score_column(docs.sparkSession, F.col("`text`"), fitted, model).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def training_part(labels, label="toxic"):
    """Labels of the rows whose id does not hash to the held-out fold."""
    return labels.where(~held_out(F.col("`doc_id`"))).select(
        F.col("`doc_id`").alias("doc_id"), F.col(f"`{label}`").alias("label"))


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def without_toxic(docs, labels, model=Model(), threshold=0.5):
    """The documents, all columns, whose score stays below the threshold."""
    fitted = fit(docs, training_part(labels), model)
    score = score_column(docs.sparkSession, F.col("`text`"), fitted, model)
    return docs.where(score < threshold)
