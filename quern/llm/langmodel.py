"""Scoring texts by a weighted backoff automaton over words.

States are the n-grams of the training texts: the root, a state for each word and one for each pair of words.  A
state's arcs are the tokens seen after it.  An arc of a state with count n, seen c times, and its failure arc have the weights that Dirichlet smoothing
gives: the arc's probability is (c + m * p) / (n + m), where p is the probability of the same token in the state that
the failure arc leads to, and a token without an arc has m / (n + m) * p.  A pair fails to its second word, a word to
the root, whose arcs are all training words and one for any other.  The strengths m of both levels come from the
counts: they are such that a state of average count expects as many new tokens as there are n-grams seen once.

A traversal goes left to right and carries the state: after a token it is the longest state that the last two tokens
make up, so it is known at every position beforehand, and the positions of many texts are traversed as arrays.

The model is never gathered in one place.  Texts are read once and become shards of bounded size, which are kept as
arrays of word numbers.  A shard sends the distinct n-grams of its own texts, with their training counts, to buckets by
hash; a bucket sums them over all shards and returns to each shard the totals of what it sent, in the order in which
they came.  So a shard gets the part of the automaton that its own texts can reach, no hash travels back, and a
frequent n-gram comes to its bucket once from each shard, however hot it is.  The number of buckets follows the tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import kernels
from quern.llm.common import arrow_batches, crc_mod, cut, text_slices, worker_free

_U = np.uint64
#: Hashes of pairs and triples are even.
_EVEN = ~_U(1)
#: What the end of a text counts under among the word hashes.
END = int(kernels.mix(np.array([0x5151], dtype=_U))[0])
#: Text bytes of a shard (a longer text is a shard of its own), and keys that a bucket gets, about.
SHARD_BYTES, BUCKET_KEYS = 16 << 20, 2_000_000
ORDERS = (1, 2, 3)
#: Leading bits of a longer n-gram's hash that tell it from the others in its bucket; words keep all 64.
KEY_BITS = 40
#: Shards of a task have numbers from partition << SHARD_BITS on.
SHARD_BITS = 32

_BLOCKS = "shard long, tokens long, doc_ids array<long>, learn binary, sizes binary, ids binary, words int, vocabulary binary"
_SENT = "bucket long, shard long, " + ", ".join(f"n{o} int, k{o} binary, c{o} binary" for o in ORDERS)
_BACK = "bucket long, shard long, " + ", ".join(f"t{o} binary" for o in ORDERS) + ", stats array<long>"
_SCORED = "doc_id long, learn boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


@dataclass(frozen=True)
class Model:
    """What every shard needs besides its own arcs."""

    tokens: int
    words: int
    discount: float
    strengths: tuple[float, float]  # of the states of one word and of two

    @property
    def unknown(self) -> float:
        """Probability of all words not seen."""
        return self.discount * self.words / self.tokens if self.tokens else 1.0


def model_of(stats: np.ndarray) -> Model:
    """The model's numbers from a row per order: n-grams counted, distinct ones, those seen once and twice."""
    (tokens, words, once, twice), pairs, triples = (tuple(map(int, row)) for row in stats)
    discount = once / (once + 2 * twice) if once and twice else 0.5

    def strength(states: int, counted: int, single: int) -> float:
        new = min(max(single / counted, 1e-3), 1 - 1e-3) if counted else 0.5
        return counted / max(1, states) * new / (1 - new) or 1.0

    return Model(tokens, words, discount, (strength(words, pairs[0], pairs[2]), strength(pairs[1], triples[0], triples[2])))


def _bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets by the leading bits of a key, so that sorted keys have sorted buckets."""
    return (((keys >> _U(40)) * _U(buckets)) >> _U(24)).astype(np.int64)


def _packed(raw: bytes) -> bytes:
    return pa.compress(raw, codec="zstd", asbytes=True) if raw else b""


def _unpacked(raw: bytes, size: int) -> bytes:
    return pa.decompress(raw, decompressed_size=size, codec="zstd", asbytes=True) if raw else b""


def _planes(numbers: np.ndarray, width: int) -> bytes:
    """Numbers of `width` bytes by byte, each with its length before it: low bytes are noise, high ones are nearly all 0."""
    parts = [_packed(plane.tobytes()) if plane.any() else b"" for plane in numbers.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T]
    return b"".join(len(part).to_bytes(4, "little") + part for part in parts)


def _from_planes(raw: bytes, n: int, width: int) -> np.ndarray:
    planes, at = np.zeros((n, width), dtype=np.uint8), 0
    for k in range(width):
        size = int.from_bytes(raw[at : at + 4], "little")
        if size:
            planes[:, k] = np.frombuffer(_unpacked(raw[at + 4 : at + 4 + size], n), dtype=np.uint8)
        at += 4 + size
    return planes.reshape(-1).view(f"<u{width}")


def _write_keys(keys: np.ndarray) -> bytes:
    """Keys as their differences, which are small where keys are sorted; where they fall, differences wrap around."""
    return _planes(np.diff(keys, prepend=_U(0)), 8)


def _read_keys(raw: bytes, n: int) -> np.ndarray:
    """What _write_keys() made of n keys."""
    return np.cumsum(_from_planes(raw, n, 8), dtype=_U)


def _write_counts(counts: np.ndarray) -> bytes:
    """A byte that tells the width, then counts in the fewest bytes that hold the largest, compressed: most are 1."""
    if not len(counts):
        return b""
    width = next(w for w in (1, 2, 4, 8) if int(counts.max()) >> 8 * w == 0)
    return bytes([width]) + _packed(counts.astype(f"<u{width}").tobytes())


def _read_counts(raw: bytes, n: int) -> np.ndarray:
    """What _write_counts() made of n counts."""
    return np.frombuffer(_unpacked(raw[1:], raw[0] * n), dtype=f"<u{raw[0]}").astype("<i8") if n else np.zeros(0, dtype="<i8")


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Shards of (text, doc_id, learn) rows of about `most` bytes: which words stand where, as numbers by falling frequency."""
    worker_free()
    shard = TaskContext.get().partitionId() << SHARD_BITS
    held: list[tuple[np.ndarray, np.ndarray]] = []
    ids: list[pa.Array] = []
    learn: list[np.ndarray] = []
    size = 0

    def block() -> pa.RecordBatch:
        words = np.concatenate([h for h, _ in held])
        sizes = np.concatenate([n for _, n in held])
        # words of one frequency stay sorted, so their differences are small
        found, where, counts = np.unique(words, return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(found), dtype="<u4")
        rank[order] = np.arange(len(found), dtype="<u4")
        doc_ids = pa.chunked_array(ids).combine_chunks()
        return pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int64()), pa.array([len(words) + len(sizes)], pa.int64()),
             pa.ListArray.from_arrays(pa.array([0, len(doc_ids)], pa.int32()), doc_ids),
             pa.array([np.concatenate(learn).astype(np.uint8).tobytes()], pa.binary()), pa.array([sizes.astype("<i8").tobytes()], pa.binary()),
             pa.array([_planes(rank[where], 4)], pa.binary()), pa.array([len(found)], pa.int32()), pa.array([_write_keys(found[order])], pa.binary())],
            names=["shard", "tokens", "doc_ids", "learn", "sizes", "ids", "words", "vocabulary"],
        )

    for batch in batches:
        flags = np.asarray(batch.column(2).fill_null(False).to_numpy(zero_copy_only=False), dtype=bool)
        for first, raw in text_slices(batch.column(0)):
            hashes, bounds = kernels.words_by_text(raw)
            held.append((hashes, np.diff(bounds)))
            ids.append(batch.column(1).slice(first, len(raw)))
            learn.append(flags[first : first + len(raw)])
            size += sum(map(len, raw))
            if size >= most:
                yield block()
                held, ids, learn, size, shard = [], [], [], 0, shard + 1
    if held:
        yield block()


class _Grams:
    """The n-grams of a block: sorted distinct keys of each order, and positions that begin a text or follow one token."""

    def __init__(self, block: dict) -> None:
        words = _read_keys(block["vocabulary"], block["words"])
        self.sizes = np.frombuffer(block["sizes"], dtype="<i8")
        ends = np.cumsum(self.sizes + 1) - 1
        self.starts = ends - self.sizes
        n = int(self.sizes.sum())
        is_end = np.zeros(n + len(ends), dtype=bool)
        is_end[ends] = True
        tokens = np.empty(len(is_end), dtype=np.int64)
        tokens[is_end] = len(words)
        tokens[~is_end] = _from_planes(block["ids"], n, 4)
        hashes = np.concatenate([words, np.array([END], dtype=_U)])
        order = np.argsort(hashes, kind="stable")
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        self.words, self.tokens = hashes[order], place[tokens]  # a token's place among the sorted words
        self.learn = np.repeat(np.frombuffer(block["learn"], dtype=np.uint8).astype(bool), self.sizes + 1)
        first, second = np.zeros(len(tokens), dtype=bool), np.zeros(len(tokens), dtype=bool)
        first[self.starts] = True
        second[(self.starts + 1)[self.sizes > 0]] = True
        self.second = np.flatnonzero(~first)  # positions with a token before them
        self.third = np.flatnonzero(~first & ~second)  # with two
        with np.errstate(over="ignore"):
            mixed = kernels.mix(self.words)
            self.pairs = np.zeros(len(tokens), dtype=_U)
            self.pairs[self.second] = kernels.mix(mixed[self.tokens[self.second - 1]] + self.words[self.tokens[self.second]]) & _EVEN
            self.triples = kernels.mix(kernels.mix(self.pairs[self.third - 1]) + self.words[self.tokens[self.third]]) & _EVEN

    def placed(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys, and the place among them of each position that has one."""
        if order == 1:
            return self.words, self.tokens
        return np.unique(self.pairs[self.second] if order == 2 else self.triples, return_inverse=True)

    def counted(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys, and how often each stands in training texts."""
        if order == 1:
            return self.words, np.bincount(self.tokens[self.learn], minlength=len(self.words))
        keys, at = (self.pairs[self.second], self.second) if order == 2 else (self.triples, self.third)
        # the lowest bit carries whether a position is learnt from, so one sort does for keys and counts
        keys = np.sort(keys | self.learn[at])
        learnt = keys & _U(1)
        keys ^= learnt
        first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
        return keys[first], np.add.reduceat(learnt.astype(np.int64), first) if len(first) else first


def _sender(buckets: int):
    """Blocks to rows of a bucket and a shard: keys in sorted order, and their training counts."""
    drop = _U(max(0, 64 - KEY_BITS - buckets.bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_free()
        for batch in batches:
            for row in batch.to_pylist():
                grams = _Grams(row)
                columns, full = [], np.zeros(buckets, dtype=bool)
                for order in ORDERS:
                    keys, counts = grams.counted(order)
                    bounds = np.searchsorted(_bucket_of(keys, buckets), np.arange(buckets + 1))
                    full |= np.diff(bounds) > 0
                    columns.append((keys if order == 1 else keys >> drop, counts, bounds))
                del grams
                some = np.flatnonzero(full).tolist()
                for k in range(0, len(some), 256):
                    part = some[k : k + 256]
                    arrays = [pa.array(part, pa.int64()), pa.array([row["shard"]] * len(part), pa.int64())]
                    for keys, counts, bounds in columns:
                        arrays.append(pa.array([int(bounds[b + 1] - bounds[b]) for b in part], pa.int32()))
                        arrays.append(pa.array([_write_keys(keys[bounds[b] : bounds[b + 1]]) for b in part], pa.binary()))
                        arrays.append(pa.array([_write_counts(counts[bounds[b] : bounds[b + 1]]) for b in part], pa.binary()))
                    yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in _SENT.split(", ")])

    return run


def _total(_key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """A bucket's rows with the totals of their keys in place of the keys, and a last one with the bucket's statistics."""
    worker_free()
    shards = table.column("shard").to_pylist()
    back, stats = [], []
    for order in ORDERS:
        keys = [_read_keys(k, n) for k, n in zip(table.column(f"k{order}").to_pylist(), table.column(f"n{order}").to_pylist())]
        counts = np.concatenate([_read_counts(c, len(k)) for c, k in zip(table.column(f"c{order}").to_pylist(), keys)])
        bounds = np.cumsum([0, *map(len, keys)])
        found, where = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.bincount(where, weights=counts, minlength=len(found)).astype("<i8")
        own = totals[where]
        back.append([_write_counts(own[i:j]) for i, j in zip(bounds[:-1], bounds[1:])] + [b""])
        stats += [int(totals.sum()), int((totals > 0).sum()), int((totals == 1).sum()), int((totals == 2).sum())]
    bucket = table.column("bucket")[0].as_py()
    arrays = [pa.array([bucket] * (len(shards) + 1), pa.int64()), pa.array([*shards, -1], pa.int64())]
    arrays += [pa.array(b, pa.binary()) for b in back] + [pa.array([None] * len(shards) + [stats], pa.list_(pa.int64()))]
    return pa.Table.from_arrays(arrays, names=[c.split()[0] for c in _BACK.split(", ")])


def _traverse(m: Model, buckets: int, block: dict, arcs: pa.Table) -> tuple[np.ndarray, ...]:
    """Per text of a block: tokens, known tokens, base score, and the automaton's log10 probability."""
    grams = _Grams(block)
    arcs = arcs.sort_by("bucket")
    at = arcs.column("bucket").to_numpy()

    def totals(order: int, keys: np.ndarray) -> np.ndarray:
        own = np.bincount(_bucket_of(keys, buckets), minlength=buckets)[at]
        return np.concatenate([_read_counts(raw, int(n)) for raw, n in zip(arcs.column(f"t{order}").to_pylist(), own)]).astype(np.float64)

    c = totals(1, grams.words)[grams.tokens]
    base = np.log10((c + 1) / (m.tokens + 1 * (m.words + 1)))
    # the root's arcs, then those of the states of one word and of two where the text has such a state
    p = np.where(c > 0, (c - m.discount) / max(1, m.tokens), m.unknown)
    keys, place = grams.placed(2)
    pair = np.zeros(len(c))
    if len(keys):
        pair[grams.second] = totals(2, keys)[place]
        s = m.strengths[0]
        p[grams.second] = (pair[grams.second] + s * p[grams.second]) / (c[grams.second - 1] + s)
    keys, place = grams.placed(3)
    if len(keys):
        s = m.strengths[1]
        p[grams.third] = (totals(3, keys)[place] + s * p[grams.third]) / (pair[grams.third - 1] + s)
    logs = np.log10(np.minimum(p, 1.0))
    starts = grams.starts
    return grams.sizes + 1, np.add.reduceat(c > 0, starts, dtype=np.int64), np.add.reduceat(base, starts), np.add.reduceat(logs, starts)


def score(docs: DataFrame, learn: Column, buckets: int | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs (doc_id, text).

    learn: which rows to learn from; null counts as no.  A null text is empty: one token, the end.  Rows of one id are
    scored each by itself, and repeated rows alike.  An empty table gives no rows; with no row to learn from every
    token is unknown.  Other columns of docs are ignored, whatever their names.  buckets: by default as many as the
    tokens need.  Neither that nor the size of a shard changes the scores.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(learn, F.lit(False)).alias("learn"))
    blocks = cut(rows.mapInArrow(lambda batches: _blocks(batches, shard_bytes), _BLOCKS))
    if buckets is None:
        tokens = blocks.agg(F.sum("tokens").alias("n")).first()["n"] or 0
        buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * tokens // BUCKET_KEYS)
    sent = blocks.drop("doc_ids", "tokens").mapInArrow(_sender(buckets), _SENT)
    totals = cut(sent.groupBy("bucket").applyInArrow(_total, _BACK))
    # twelve sums come to the driver
    found = totals.where("shard < 0").agg(*[F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(4 * len(ORDERS))]).first()
    model = model_of(np.array([x or 0 for x in found], dtype=np.int64).reshape(len(ORDERS), 4))

    def traverse(_key: tuple[pa.Scalar, ...], texts: pa.Table, arcs: pa.Table) -> pa.Table:
        worker_free()
        block = texts.to_pylist()[0]
        n, known, base, own = _traverse(model, buckets, block, arcs)
        flags = np.frombuffer(block["learn"], dtype=np.uint8).astype(bool)
        return pa.table(
            [pa.array(block["doc_ids"], pa.int64()), pa.array(flags), pa.array(n, pa.int64()), pa.array(known, pa.int64()),
             pa.array(np.full(len(n), model.tokens), pa.int64()), pa.array(base, pa.float64()), pa.array(own, pa.float64())],
            names=[c.split()[0] for c in _SCORED.split(", ")],
        )

    scored = blocks.groupBy("shard").cogroup(totals.where("shard >= 0").drop("stats").groupBy("shard")).applyInArrow(traverse, _SCORED)
    return scored.select("doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def trainable(doc_id: Column, left_out: int = 2, of: int = 7) -> Column:
    return crc_mod(doc_id, of) != left_out
