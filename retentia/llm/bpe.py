"""Byte-level BPE by two tiers: whole pre-tokens by a minimal perfect hash, the others by a heap.

A text is cut into pre-tokens by a pattern. A pre-token that is a token of the vocabulary gets its
rank from a minimal perfect hash over all tokens; any other starts as linked single bytes, and a
heap of neighbouring pairs joins the pair of the lowest rank, the leftmost first, until no pair is
a token. Both tiers run in Arrow tasks, over the distinct pre-tokens of a batch.

A vocabulary is a file of lines `base64(token) rank`, read by its path on the driver; its size is
fixed by that file and does not grow with the data, so the built tables are broadcast.

Null and empty texts have no ids. Very long texts are cut into pre-tokens piece by piece. Repeated
rows are encoded like any other; nothing depends on order, so there are no ties. Only the text
column and the kept columns are read, so further columns may have any name. An empty table gives
an empty one.
"""

import base64
import hashlib
import heapq
import uuid
from itertools import islice
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import types as T

from retentia.llm.common import _STEP, as_strings, bounded_batches, mix

KEYS_PER_BUCKET = 3
KNOWN_PIECES = 1 << 18  # encoded pre-tokens that a worker remembers
LONG_TEXT = 1 << 20  # code points above which a text's pre-tokens are not listed at once


def _hashes(keys):
    return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))


class PerfectHash:
    """Minimal perfect hash: n distinct byte strings to the slots 0..n-1.

    Keys fall into buckets. The fullest bucket chooses first: it takes the least displacement that
    sends its keys to free slots, and buckets of one key take the slots that are left. A lookup
    hashes once, displaces and compares the key in that slot.
    """

    def __init__(self, keys, values):
        n = len(keys)
        hashed = _hashes(keys)
        if len(np.unique(hashed)) < n:
            raise ValueError("keys repeat")
        self.n, self.buckets = n, max(1, n // KEYS_PER_BUCKET)
        bucket = (hashed % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        counts = np.bincount(bucket, minlength=self.buckets)
        starts = np.concatenate(([0], np.cumsum(counts)))
        free, self.shift = np.ones(n, bool), np.zeros(self.buckets, np.int64)
        slot_of, single = np.empty(n, np.int64), []
        for b in np.argsort(-counts, kind="stable"):
            members = order[starts[b] : starts[b + 1]]
            if len(members) < 2:
                single += [(b, m) for m in members]
                continue
            self.shift[b], slots = self._displace(hashed[members], free)
            free[slots] = False
            slot_of[members] = slots
        for (b, member), slot in zip(single, np.flatnonzero(free)):
            self.shift[b] = -1 - slot
            slot_of[member] = slot
        by_slot = np.argsort(slot_of)
        self.keys = [keys[i] for i in by_slot]
        self.values = np.asarray(values, np.int64)[by_slot]

    def _displace(self, hashed, free, tries=64):
        first = 0
        while True:
            shifts = np.arange(first, first + tries)
            slots = np.sort(self._slots(hashed[None, :], shifts[:, None]), axis=1)
            fits = free[slots].all(axis=1) & (np.diff(slots, axis=1) > 0).all(axis=1)
            if fits.any():
                shift = int(shifts[fits.argmax()])
                return shift, self._slots(hashed, np.int64(shift))
            first += tries

    def _slots(self, hashed, shift):
        with np.errstate(over="ignore"):
            moved = mix(hashed + (np.asarray(shift).astype(np.uint64) + np.uint64(1)) * _STEP)
        return (moved % np.uint64(self.n)).astype(np.int64)

    def find(self, keys):
        """The value of each key, -1 for a key that is not held."""
        if not self.n or not keys:
            return np.full(len(keys), -1, np.int64)
        hashed = _hashes(keys)
        shift = self.shift[(hashed % np.uint64(self.buckets)).astype(np.int64)]
        slots = np.where(shift < 0, -1 - shift, self._slots(hashed, np.maximum(shift, 0)))
        held = np.fromiter(
            (self.keys[s] == k for s, k in zip(slots.tolist(), keys)), bool, len(keys))
        return np.where(held, self.values[slots], -1)


class Vocabulary:
    """Tokens by rank, the perfect hash over them, and the pattern of pre-tokens."""

    def __init__(self, ranks, pattern):
        self.ranks, self.pattern = ranks, pattern
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.whole = PerfectHash(list(ranks), list(ranks.values()))

    @classmethod
    def read(cls, path, pattern):
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        return cls({base64.b64decode(token): int(rank) for token, rank in pairs}, pattern)

    def merged(self, piece):
        """Ranks of a byte string that is no token itself.

        `after` and `before` link the starts of the parts; `pairs` holds, at each start, the rank of
        that part joined with the next. A heap entry is a rank and a start in one number, and is
        stale if the pair at that start has another rank by now.
        """
        get, n = self.ranks.get, len(piece)
        after, before = list(range(1, n + 2)), list(range(-1, n))
        pairs = [get(piece[i : i + 2]) for i in range(n - 1)] + [None]
        heap = [rank << 32 | i for i, rank in enumerate(pairs) if rank is not None]
        heapq.heapify(heap)
        while heap:
            entry = heapq.heappop(heap)
            left = entry & 0xFFFFFFFF
            if pairs[left] != entry >> 32:
                continue
            right = after[left]
            end = after[left] = after[right]
            pairs[right] = pairs[left] = None
            if end < n:
                before[end] = left
                rank = pairs[left] = get(piece[left : after[end]])
                if rank is not None:
                    heapq.heappush(heap, rank << 32 | left)
            start = before[left]
            if start >= 0:
                rank = pairs[start] = get(piece[start:end])
                if rank is not None:
                    heapq.heappush(heap, rank << 32 | start)
        out, start = [], 0
        while start < n:
            out.append(self.ranks[piece[start : after[start]]])
            start = after[start]
        return out

    def decoded(self, ids):
        return b"".join(map(self.tokens.__getitem__, ids))


class Encoder:
    """Encodes batches of texts, with a bounded memory of encoded pre-tokens."""

    def __init__(self, vocabulary):
        self.vocabulary = vocabulary
        self.find_all = regex.compile(vocabulary.pattern)
        self.known = {}

    def _learn(self, pieces):
        new = [p for p in pieces if p not in self.known]
        raw = [p.encode() for p in new]
        for piece, data, rank in zip(new, raw, self.vocabulary.whole.find(raw).tolist()):
            ids = [rank] if rank >= 0 else self.vocabulary.merged(data)
            self.known[piece] = pack(f"<{len(ids)}I", *ids)

    def _packed(self, text):
        if len(text) <= LONG_TEXT:
            pieces = self.find_all.findall(text)
            self._learn(set(pieces))
            return b"".join([self.known[p] for p in pieces])
        found, parts = (m.group() for m in self.find_all.finditer(text)), []
        while pieces := list(islice(found, 1 << 16)):
            self._trim()
            self._learn(set(pieces))
            parts.append(b"".join([self.known[p] for p in pieces]))
        return b"".join(parts)

    def _trim(self):
        if len(self.known) > KNOWN_PIECES:
            self.known.clear()

    def encode(self, array):
        """A list array of ids, one list for each text."""
        packed = []
        for text in as_strings(array).to_pylist():
            self._trim()
            packed.append(self._packed(text))
        ends = np.cumsum([0, *(len(p) // 4 for p in packed)])
        ids = np.frombuffer(b"".join(packed), "<u4").astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))


_ENCODERS = {}  # of this Python worker: what one task has learned serves the next


def _encoder(name, shared):
    if name not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[name] = Encoder(shared.value)
    return _ENCODERS[name]


def encoded(docs, vocabulary, keep=("doc_id",), text="text"):
    """The kept columns and `ids`, the ranks of the whole text as an array of int."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = docs.select(*[f"`{k}`" for k in keep], docs[text].alias("_text"))
    ids_field = T.StructField("ids", T.ArrayType(T.IntegerType(), False))
    schema = T.StructType([*rows.schema.fields[:-1], ids_field])

    name = uuid.uuid4().hex

    def run(batches):
        encoder = _encoder(name, shared)
        for batch in batches:
            ids = encoder.encode(batch.column(len(keep)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], ids], [*keep, "ids"])

    return rows.mapInArrow(run, schema)


def _lists(array):
    """Bounds of each list and all values of an array of lists; null has no values."""
    lists = array.combine_chunks() if isinstance(array, pa.ChunkedArray) else array
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    bounds = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
    return bounds, lists.flatten().to_numpy(zero_copy_only=False)


def decoded(rows, vocabulary, keep=("doc_id",), ids="ids"):
    """The kept columns and `bytes`, what the ids stand for; null and empty ids give no bytes.

    An id that the vocabulary does not have is an error.
    """
    of = lambda v, part: {"bytes": v.decoded(part.tolist())}
    return _over_ids(rows, vocabulary, keep, ids, {"bytes": T.BinaryType()}, of)


def digests(rows, vocabulary, keep=("doc_id",), ids="ids"):
    """The kept columns, the number of ids, digests of the ids and of the bytes decoded from them."""
    digest = T.StringType()
    kinds = {"n_tokens": T.LongType(), "ids_sha256": digest, "decoded_sha256": digest}
    return _over_ids(rows, vocabulary, keep, ids, kinds, lambda v, part: {
        "n_tokens": len(part),
        "ids_sha256": hashlib.sha256(part.astype("<u4").tobytes()).hexdigest(),
        "decoded_sha256": hashlib.sha256(v.decoded(part.tolist())).hexdigest(),
    })


def _over_ids(rows, vocabulary, keep, ids, kinds, of):
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)
    rows = rows.select(*[f"`{k}`" for k in keep], rows[ids].alias("_ids"))
    more = [T.StructField(name, kind) for name, kind in kinds.items()]
    schema = T.StructType([*rows.schema.fields[:-1], *more])
    arrow = {T.LongType(): pa.int64(), T.StringType(): pa.string(), T.BinaryType(): pa.binary()}

    def run(batches):
        table = shared.value
        for batch in batches:
            bounds, values = _lists(batch.column(len(keep)))
            out = [of(table, values[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
            more = [pa.array([o[n] for o in out], arrow[k]) for n, k in kinds.items()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *more], [*keep, *kinds])

    return rows.mapInArrow(run, schema)
