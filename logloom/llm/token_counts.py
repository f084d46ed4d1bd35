"""Token counts by heap-and-linked-list byte-pair merging.

A text is normalised as the piece model says (a leading space, spaces as U+2581). No piece holds U+2581 after another
character, so a merge never crosses the place before a run of spaces, and the units between such places are counted
alone. In a unit the symbols form a linked list; a heap gives the adjacent pair of the best rank, leftmost first. The
count is the initial symbols less the merges; a character outside the vocabulary has as many symbols as bytes.
No identifiers are made.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .runtime import loaded, tidy
from .textnum import Memo, char_chunks, code_points, distinct, prefix_hash, runs, span_hash, texts

SPACE = "▁"


class PieceCounter:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        usable = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        scores = sorted({model.get_score(i) for i in usable}, reverse=True)
        rank = {score: k for k, score in enumerate(scores)}
        self.rank = {model.id_to_piece(i): rank[model.get_score(i)] for i in usable}
        if any(SPACE in piece.lstrip(SPACE) for piece in self.rank):
            raise ValueError("the model has pieces that cross a space; its units cannot be counted alone")
        self.memo = Memo(lambda units: [self.unit(u) for u in units])

    def unit(self, text: str) -> int:
        """Tokens of a run of spaces and what follows up to the next."""
        piece = list(text.replace(" ", SPACE))
        rank, n = self.rank, len(piece)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = []
        for i in range(n - 1):
            if (r := rank.get(piece[i] + piece[i + 1])) is not None:
                heap.append((r, i))
        heapq.heapify(heap)
        merges = 0
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if not piece[i] or j < 0 or rank.get(piece[i] + piece[j]) != r:
                continue  # one of the pair has been merged meanwhile
            piece[i] += piece[j]
            piece[j] = ""
            after[i] = k = after[j]
            merges += 1
            if k >= 0:
                before[k] = i
                if (r := rank.get(piece[i] + piece[k])) is not None:
                    heapq.heappush(heap, (r, i))
            if (k := before[i]) >= 0 and (r := rank.get(piece[k] + piece[i])) is not None:
                heapq.heappush(heap, (r, k))
        symbols = n + sum(len(c.encode()) - 1 for c in piece if c and c not in rank)
        return symbols - merges

    def count(self, rows: list[str]) -> np.ndarray:
        """Tokens of each text."""
        out = np.zeros(len(rows), np.int64)
        for a, b in char_chunks(rows):
            joined, points, offsets = code_points([" " + x.replace(SPACE, " ") if x else "" for x in rows[a:b]])
            starts, _ = runs(points == 32, offsets)
            if not len(starts):
                continue
            ends = np.append(starts[1:], len(points))
            index, inverse = distinct(span_hash(prefix_hash(points), starts, ends))
            units = [joined[s:e] for s, e in zip(starts[index].tolist(), ends[index].tolist(), strict=True)]
            sums = np.append(0, np.cumsum(np.array(self.memo.many(units), np.int64)[inverse]))
            at = np.searchsorted(starts, offsets)
            out[a:b] = sums[at[1:]] - sums[at[:-1]]
        return out


@loaded(2)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def count_tokens(docs: DataFrame, model_path: str, limit: int, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: the kept columns, n_bytes, n_tokens and over_limit (more than ``limit`` tokens).

    A null text counts as the empty text, which has no tokens. Repeated rows stay; other columns are not read.
    """
    from pyspark.sql.types import BooleanType, LongType, StructType

    rows = docs.select(*keep, text)
    schema = StructType([rows.schema[c] for c in keep]).add("n_bytes", LongType()).add("n_tokens", LongType()).add("over_limit", BooleanType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = texts(batch.column(len(keep)))
            tokens = counter(model_path).count(got)
            sizes = np.array([len(x.encode()) for x in got], np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(sizes), pa.array(tokens), pa.array(tokens > limit)], [*keep, "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(tidy(run), schema)
