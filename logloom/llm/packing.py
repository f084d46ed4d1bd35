"""Harmonic packing of documents' tokens into sequences of a fixed capacity.

A document's full capacities are sequences of their own. What remains, of r tokens, belongs to class
``capacity // r``; a bin of class k takes k documents, which always fit, and is then closed. Every worker fills its own
bins from its own rows, so nothing is shuffled. The gap that a closed bin keeps is filled with tokens cut from the next
document, and what one worker has left at its end is laid out in sequences whose lengths are powers of two, which need
no padding. A worker holds less than ``classes`` open bins of ids, whatever the size of its input.
"""

from __future__ import annotations

import os
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe_codec import WordCodec, codec
from .runtime import loaded, tidy
from .textnum import char_chunks, prefix_hash, span_hash, texts

#: Texts are worked on in chunks of about so many characters, so that a chunk's arrays stay in a core's cache.
CHUNK_CHARS = 1 << 17


class HarmonicPacker:
    """Pieces are (key, start, ids as little-endian bytes, tokens of the whole document)."""

    def __init__(self, capacity: int, classes: int = 64):
        self.capacity, self.classes = capacity, classes
        self.open: dict[int, list] = {}
        self.gaps: deque = deque()
        self.sequence, self.rows = 0, []

    def close(self, pieces: list) -> None:
        at = 0
        for key, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((key, start, n, zlib.crc32(ids), total, self.sequence, at))
            at += n
        self.sequence += 1

    @staticmethod
    def cut(piece: tuple, n: int) -> tuple[tuple, tuple]:
        key, start, ids, total = piece
        return (key, start, ids[: 4 * n], total), (key, start + n, ids[4 * n :], total)

    def add(self, key: tuple, ids: bytes) -> None:
        """Takes one document; it has at least one id."""
        rest = key, 0, ids, len(ids) // 4
        while self.gaps and rest[2]:
            room, pieces = self.gaps.popleft()
            first, rest = self.cut(rest, room)
            pieces.append(first)
            if (left := room - len(first[2]) // 4) > 0:
                self.gaps.appendleft((left, pieces))
            else:
                self.close(pieces)
        while len(rest[2]) >= 4 * self.capacity:
            first, rest = self.cut(rest, self.capacity)
            self.close([first])
        if rest[2]:
            kind = min(self.capacity // (len(rest[2]) // 4), self.classes)
            mine = self.open.setdefault(kind, [])
            mine.append(rest)
            if len(mine) == kind:
                del self.open[kind]
                self.shut(mine)

    def shut(self, pieces: list) -> None:
        room = self.capacity - sum(len(p[2]) // 4 for p in pieces)
        if room:
            self.gaps.append((room, pieces))
        else:
            self.close(pieces)

    def finish(self) -> None:
        """Lays out what is left: whole sequences, then one for each power of two in the rest."""
        left = deque(p for _, pieces in self.gaps for p in pieces)
        left.extend(p for kind in sorted(self.open) for p in self.open[kind])
        self.gaps.clear()
        self.open.clear()
        total = sum(len(p[2]) // 4 for p in left)
        while total:
            size = min(self.capacity, 1 << (total.bit_length() - 1))
            total -= size
            pieces = []
            while size:
                piece = left.popleft()
                if len(piece[2]) > 4 * size:
                    piece, rest = self.cut(piece, size)
                    left.appendleft(rest)
                size -= len(piece[2]) // 4
                pieces.append(piece)
            self.close(pieces)

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


class WordIds:
    """Ids of words as the tokenizer library gives them, remembered in arrays.

    A word of up to ``LONG`` code points is known by its 64-bit hash, in a table with open addressing; longer ones are
    asked for wherever they occur. Beyond ``size`` words, or ``IDS`` times as many ids, the half that was used last stays.
    """

    LONG, IDS = 64, 6

    def __init__(self, path: str, size: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.normalizers import Sequence

        self.library = Tokenizer.from_file(path)
        self.library.normalizer = Sequence([])  # words come in normal form
        suffix, vocab = self.library.model.end_of_word_suffix, self.library.get_vocab()
        self.closing = np.zeros(max(vocab.values()) + 1, bool)
        self.closing[[i for piece, i in vocab.items() if piece.endswith(suffix)]] = True
        self.size, self.now = size, 0
        none = np.zeros(0, np.uint32)
        self.ids, self.used = np.zeros(1 << 16, "<u4"), 0
        self.build(none.astype(np.uint64), none, none, none)

    def build(self, keys: np.ndarray, start: np.ndarray, count: np.ndarray, last: np.ndarray, room: int = 0) -> None:
        """A new table of these words, at most half full with ``room`` more."""
        slots = 1 << max(16, (2 * (len(keys) + room) - 1).bit_length())
        self.n, self.mask = 0, slots - 1
        self.keys, self.start, self.count, self.last = np.zeros(slots, np.uint64), np.zeros(slots, np.uint32), np.zeros(slots, np.uint16), np.zeros(slots, np.uint32)
        self.insert(keys, start, count, last)

    def find(self, h: np.ndarray, slot: np.ndarray | None = None) -> np.ndarray:
        """Each hash's slot, or the empty one where its search, which may begin at ``slot``, ends."""
        if slot is None:
            slot = (h & np.uint64(self.mask)).astype(np.int64)
        key = self.keys[slot]
        todo = np.flatnonzero((key != h) & (key != 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            key = self.keys[slot[todo]]
            todo = todo[(key != h[todo]) & (key != 0)]
        return slot

    def insert(self, h: np.ndarray, start: np.ndarray, count: np.ndarray, last: np.ndarray | int) -> None:
        """Takes distinct hashes that the table does not have."""
        if 2 * (self.n + len(h)) > len(self.keys):
            old = np.flatnonzero(self.keys)
            self.build(self.keys[old], self.start[old], self.count[old], self.last[old], len(h))
        slot, todo = self.find(h), np.arange(len(h))
        while len(todo):
            self.keys[slot[todo]] = h[todo]  # one of those that meet stays
            todo = todo[self.keys[slot[todo]] != h[todo]]
            slot[todo] = self.find(h[todo], slot[todo])
        self.start[slot], self.count[slot], self.last[slot] = start, count, last
        self.n += len(h)

    def trim(self) -> None:
        """Keeps the words that were used last, in half of the room."""
        old = np.flatnonzero(self.keys)
        keep = old[np.argsort(self.last[old], kind="stable")[::-1][: self.size // 2]]
        keep = keep[np.cumsum(self.count[keep], dtype=np.int64) <= self.IDS * self.size // 2]
        start, count = self.start[keep].astype(np.int64), self.count[keep].astype(np.int64)
        ids, begins = self.gather(start, count), np.cumsum(count) - count
        self.ids, self.used = ids, len(ids)
        self.build(self.keys[keep], begins, count, self.last[keep])

    def gather(self, start: np.ndarray, count: np.ndarray) -> np.ndarray:
        ends = np.cumsum(count)
        return self.ids[np.repeat(start - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)]

    def append(self, ids: np.ndarray, at: int) -> int:
        """Writes ids behind the first ``at``; the end of what is written."""
        end = at + len(ids)
        if end > len(self.ids):
            self.ids = np.concatenate([self.ids[:at], np.zeros(max(at // 2, len(ids)), "<u4")])
        self.ids[at:end] = ids
        return end

    def ask(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words' ids one after another and how many each has: joined by white space, they end where a piece closes a word."""
        every, counts = [], []
        for at in range(0, len(words), 4096):
            some = words[at : at + 4096]
            found = self.library.encode_batch_fast([" ".join(some[k : k + 64]) for k in range(0, len(some), 64)], add_special_tokens=False)
            ids = np.array([i for x in found for i in x.ids], "<u4")
            count = np.diff(np.flatnonzero(self.closing[ids]) + 1, prepend=0)
            if len(count) != len(some):  # the library splits a word: each is asked for alone
                found = [x.ids for x in self.library.encode_batch_fast(some, add_special_tokens=False)]
                ids, count = np.array([i for x in found for i in x], "<u4"), np.array([len(x) for x in found])
            every.append(ids)
            counts.append(count)
        return np.concatenate([*every, np.zeros(0, "<u4")]), np.concatenate([*counts, np.zeros(0, np.int64)])

    def many(self, words: list[str]) -> list[bytes]:
        """Each word's ids as little-endian bytes."""
        ids, count = self.ask(words)
        raw, ends = ids.tobytes(), (4 * np.cumsum(count)).tolist()
        return [raw[x:y] for x, y in zip([0, *ends], ends, strict=False)]

    def of(self, joined: str, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a text's words one after another, and how many each has."""
        text = lambda which: [joined[s:e] for s, e in zip(starts[which].tolist(), ends[which].tolist(), strict=True)]
        if self.n > self.size or self.used > self.IDS * self.size or len(self.ids) > 2 * self.IDS * self.size:
            self.trim()
        self.now += 1
        h = np.maximum(span_hash(prefix_hash(points), starts, ends), np.uint64(1))
        short = ends - starts <= self.LONG
        slot = self.find(h)
        new = np.flatnonzero((self.keys[slot] != h) & short)
        if len(new):
            keys, first = np.unique(h[new], return_index=True)
            ids, count = self.ask(text(new[first]))
            begins = self.used + np.cumsum(count) - count
            self.used = self.append(ids, self.used)
            self.insert(keys, begins, count, self.now)
            slot = self.find(h)
        start, count = self.start[slot].astype(np.int64), self.count[slot].astype(np.int64)
        self.last[slot[short]] = self.now
        if len(long := np.flatnonzero(~short)):
            ids, count[long] = self.ask(text(long))
            start[long] = self.used + np.cumsum(count[long]) - count[long]
            self.append(ids, self.used)  # for this call alone
        return self.gather(start, count), count


@loaded(2)
def ids_memo(path: str) -> WordIds:
    return WordIds(path)


def encoded(words: WordCodec, memo: WordIds, rows: list[str]) -> Iterator[bytes]:
    """Each text's ids as little-endian bytes."""
    for a, b in char_chunks(rows, CHUNK_CHARS):
        parts, plan = words.parts(rows[a:b], lambda i: i.to_bytes(4, "little"))
        joined, points, starts, ends, at = words.words(parts)
        ids, count = memo.of(joined, points, starts, ends)
        raw, edges = ids.tobytes(), (4 * np.append(0, np.cumsum(count)))[at].tolist()
        for mine in plan:
            yield b"".join([x if k % 2 else raw[edges[x] : edges[x + 1]] for k, x in enumerate(mine)])


def pack(docs: DataFrame, path: str, capacity: int, end_id: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its text's ids and ``end_id`` (a null text has that alone), so empty documents are packed too.
    Rows with equal keys are packed each for itself. An empty table gives no rows. Sequences are numbered within a
    partition; the partition's number is above, so a task that runs again gives the same rows.
    """
    from pyspark.sql.types import LongType, StructType

    rows = docs.select(key, text)
    schema = StructType([rows.schema[key]])
    for name in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"):
        schema = schema.add(name, LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 33
        words, memo, packer = codec(path), ids_memo(path), HarmonicPacker(capacity)
        end = end_id.to_bytes(4, "little")
        kind = None

        def out() -> Iterator[pa.RecordBatch]:
            if packer.rows:
                columns = list(zip(*packer.take(), strict=True))
                columns[5] = [base | s for s in columns[5]]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:])], schema.names)

        for batch in batches:
            kind = batch.column(0).type
            for k, ids in zip(batch.column(0).to_pylist(), encoded(words, memo, texts(batch.column(1))), strict=True):
                packer.add(k, ids + end)
            yield from out()
        packer.finish()
        yield from out()

    return rows.mapInArrow(tidy(run), schema)
