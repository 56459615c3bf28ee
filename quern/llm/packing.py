"""Packing tokens into windows by Karmarkar-Karp multiway differencing.

A document's full windows stand alone; what remains of it, less than a window, waits in a pool.  A pool of bounded size
is differenced: the two partial partitions of largest spread are merged, the heaviest part of one with the lightest of
the other, until one near-equal partition is left; if a window of it exceeds the capacity, the count of windows rises
and the pool is differenced again.  The room that near-equal windows leave is filled with pieces cut from a few
documents that the pool set aside.  Each task packs its own rows, so nothing is shuffled and an executor's loss costs
only its tasks.  The last windows of a task are cut to powers of two, which need no padding.
"""

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import arrow_batches, text_slices, worker_held

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: Sequences of one task have ids from partition << SEQUENCE_BITS on.
SEQUENCE_BITS = 40

# fixed by the tokenizer's file: how it splits a normalised text
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: Characters beyond the reach of the short way: lower-casing, composition or white space may differ there.
_ODD = regex.compile(r"[\x1c-\x1fİɐ-\U0010ffff]")


class WordTokenizer:
    """Ids of texts by a tokenizer's file, word by word with a bounded cache.

    White space always separates tokens of this tokenizer and each piece is encoded by itself, so the ids of a text are
    those of its words.  Pieces that the cache lacks are encoded together, as one text with blanks between them.  The
    cache holds words and pieces alike, in two generations of half its bytes: what is met again moves to the young one,
    and the old one goes when the young one is full, so frequent words stay.  Texts with characters for which Python's
    and the library's rules might differ, or with a special token's string, take the library's own way as a whole.
    """

    def __init__(self, definition: str, cached_bytes: int = 192 << 20) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = True
        self.most = cached_bytes
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size = 0

    def _hold(self, found: dict[str, bytes]) -> None:
        """Add entries to the cache; one takes its string (four bytes a character at worst), its ids and about 200 bytes."""
        self.young.update(found)
        self.size += 200 * len(found) + sum(len(k) if k.isascii() else 4 * len(k) for k in found) + sum(map(len, found.values()))

    def _missing(self, strings: set[str]) -> set[str]:
        """Those of the strings that neither generation has; the young one has the others afterwards."""
        rest = {s for s in strings if s not in self.young}
        again = {s: self.old[s] for s in rest if s in self.old}
        self._hold(again)
        return {s for s in rest if s not in again}

    def _encoded(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _learn(self, pieces: list[str], together: int = 2000) -> None:
        for k in range(0, len(pieces), together):
            part = pieces[k : k + together]
            found = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids, owner = np.array(found.ids, dtype="<u4"), np.array(found.word_ids, dtype=np.int64)
            bounds = np.searchsorted(owner, np.arange(len(part) + 1))
            if len(owner) and (owner[-1] != len(part) - 1 or (np.diff(owner) < 0).any() or not np.diff(bounds).all()):
                self._hold({p: self._encoded(p).tobytes() for p in part})
                continue
            raw = ids.tobytes()
            self._hold({p: raw[4 * i : 4 * j] for p, i, j in zip(part, bounds[:-1].tolist(), bounds[1:].tolist())})

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = []
        split: list[list[str]] = []
        for text in texts:
            odd = "<|" in text or (not text.isascii() and _ODD.search(text)) or any(c in text for c in "\x1c\x1d\x1e\x1f")
            out.append(self._encoded(text) if odd else None)
            split.append([] if odd else text.lower().split())
        if 2 * self.size > self.most:
            self.old, self.young, self.size = self.young, {}, 0
        found = [list(map(self.young.get, w)) for w in split]
        new = self._missing({w for f, all_ in zip(found, split) if None in f for w, ids in zip(all_, f) if ids is None})
        parts = {w: _PIECES.findall(w) for w in new}
        self._learn(list(self._missing({p for some in parts.values() for p in some})))
        word = self.young.__getitem__
        self._hold({w: b"".join(map(word, p)) for w, p in parts.items() if p != [w]})
        joined = (b"".join(map(word, w) if None in f else f) for f, w in zip(found, split))
        return [np.frombuffer(j, dtype="<u4") if o is None else o for o, j in zip(out, joined)]


def differenced(lengths: list[int], windows: int) -> list[list[int]]:
    """Indices of lengths in that many near-equal parts, by multiway differencing."""
    if windows == 1:
        return [list(range(len(lengths)))]
    heap = []
    for i, n in enumerate(lengths):
        sums = np.zeros(windows, dtype=np.int64)
        sums[0] = n
        heap.append((-n, i, sums, [[i], *([] for _ in range(windows - 1))]))
    heapq.heapify(heap)
    turn = len(lengths)
    while len(heap) > 1:
        _, _, a, in_a = heapq.heappop(heap)
        _, _, b, in_b = heapq.heappop(heap)
        merged = a + b[::-1]
        order = np.argsort(-merged, kind="stable")
        sums = merged[order]
        sums -= sums[-1]
        members = [in_a[j] + in_b[windows - 1 - j] for j in order.tolist()]
        turn += 1
        heapq.heappush(heap, (-int(sums[0]), turn, sums, members))
    return heap[0][3] if heap else [[] for _ in range(windows)]


def windows_of(lengths: list[int], capacity: int) -> list[list[int]]:
    """Parts of at most the capacity, as few as differencing finds: their count rises while one exceeds it."""
    if not lengths:
        return []
    windows = -(-sum(lengths) // capacity)
    while True:
        parts = differenced(lengths, windows)
        if max(sum(lengths[i] for i in p) for p in parts) <= capacity:
            return [p for p in parts if p]
        windows += max(1, windows // 24)


class Piece:
    __slots__ = ("doc", "start", "ids", "total")

    def __init__(self, doc, start: int, ids: np.ndarray, total: int) -> None:
        self.doc, self.start, self.ids, self.total = doc, start, ids, total

    def __len__(self) -> int:
        return len(self.ids)

    def cut(self, n: int) -> tuple["Piece", "Piece"]:
        return Piece(self.doc, self.start, self.ids[:n], self.total), Piece(self.doc, self.start + n, self.ids[n:], self.total)


class Packer:
    """Packs the pieces of one task; rows() gives and forgets what is finished."""

    def __init__(self, capacity: int, pool: int, set_aside: float, sequence: int) -> None:
        self.capacity, self.most, self.set_aside, self.sequence = capacity, pool, set_aside, sequence
        self.pool: list[Piece] = []
        self.open: list[list[Piece]] = []
        self.out: list[tuple] = []

    def add(self, doc, ids: np.ndarray) -> None:
        rest = Piece(doc, 0, ids, len(ids))
        while len(rest) >= self.capacity:
            window, rest = rest.cut(self.capacity)
            self.close([window])
        if len(rest):
            self.pool.append(rest)
            if len(self.pool) >= self.most:
                self.flush()

    def close(self, window: list[Piece]) -> None:
        offset = 0
        for p in window:
            self.out.append((p.doc, p.start, len(p), zlib.crc32(p.ids.tobytes()), p.total, self.sequence, offset))
            offset += len(p)
        self.sequence += 1

    def fill(self, spare: list[Piece]) -> list[Piece]:
        """Cut spare pieces into the open windows, the fullest first; what is left of them."""
        self.open.sort(key=lambda w: -sum(map(len, w)))
        still = []
        for window in self.open:
            room = self.capacity - sum(map(len, window))
            while room and spare:
                piece = spare.pop()
                if len(piece) > room:
                    piece, rest = piece.cut(room)
                    spare.append(rest)
                window.append(piece)
                room -= len(piece)
            if room:
                still.append(window)
            else:
                self.close(window)
        self.open = still
        return spare

    def flush(self) -> None:
        self.pool.sort(key=len)
        wanted = self.set_aside * sum(map(len, self.pool)) + sum(self.capacity - sum(map(len, w)) for w in self.open)
        spare = []
        while len(self.pool) > 1 and sum(map(len, spare)) < wanted:
            spare.append(self.pool.pop())
        for part in windows_of([len(p) for p in self.pool], self.capacity):
            self.open.append([self.pool[i] for i in part])
        self.pool = self.fill(spare)

    def finish(self) -> None:
        """End of the task: fill what is open, then cut the rest to whole windows and powers of two."""
        pieces = self.fill(self.pool)
        for window in self.open:
            pieces = [*pieces, *window]
        self.pool, self.open, total = [], [], sum(map(len, pieces))
        pieces.reverse()
        while total:
            room = self.capacity if total >= self.capacity else 1 << (total.bit_length() - 1)
            total -= room
            window = []
            while room:
                piece = pieces.pop()
                if len(piece) > room:
                    piece, rest = piece.cut(room)
                    pieces.append(rest)
                window.append(piece)
                room -= len(piece)
            self.close(window)

    def rows(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def pack(
    docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, pool: int = 128, set_aside: float = 0.06
) -> DataFrame:
    """The pieces of docs (doc_id, text; other columns are ignored), see SCHEMA; every id lies in exactly one piece.

    A null or empty text is the end id alone.  Rows of one id are packed as documents of their own.  An empty table
    gives no rows.  Columns of docs with the result's names are not read.  tokenizer_path is read by the driver; workers
    get the file's content.  pool and set_aside (the
    share of a pool's tokens that fills gaps) bound a task's memory and trade cuts against padding.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = worker_held(f"tokenizer {tokenizer_path}", lambda: WordTokenizer(shared.value))
        packer = Packer(capacity, pool, set_aside, TaskContext.get().partitionId() << SEQUENCE_BITS)
        end = np.array([end_id], dtype="<u4")
        types = [pa.int64()] * 7
        names = [c.split()[0] for c in SCHEMA.split(", ")]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            docs_of, at = batch.column(0).to_pylist(), 0
            for _, raw in text_slices(batch.column(1)):
                for ids in tokenizer.ids([r.decode() for r in raw]):
                    packer.add(docs_of[at], np.concatenate([ids, end]))
                    at += 1
            if rows := packer.rows():
                yield batch_of(rows)
        packer.finish()
        if rows := packer.rows():
            yield batch_of(rows)

    arrow_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
