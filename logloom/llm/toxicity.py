"""Toxicity by class-conditional Kneser-Ney models of words.

A word is a chain of expressions: its beginnings of 3, 4, 5, 6 and 8 bytes, then itself. In each class an expression
follows the one before it in the chain with an interpolated Kneser-Ney probability: its discounted count there
(documents that hold it), and the discounted mass times a distribution that both classes share, which rests on
continuation counts: the number of contexts, here classes, that an expression has been seen in, as if the class were the
oldest symbol of the context. A word's log-likelihood is the sum along its chain.

Of the two classes' log-likelihoods only the difference matters. Taken as it is, chance decides: most words are rare,
and a text has hundreds of them. So a chain's difference moves away from that of the next shorter beginning only as far
as its counts bear out (``CAUTION`` standard errors; none gives the plain models), and what no class has seen says
nothing. A text's difference is normalised by the root of its length in words, since chance grows with the root, and a
word that a text repeats counts as the root of its repeats. A logistic curve, monotone, fitted on halves of the sample
that the counts did not see, turns that into a score.

The classifier is fitted on at most about ``PER_CLASS`` labelled rows of each class, chosen by a hash of their key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import discard, saved, tidy
from .textnum import char_chunks, distinct, mix, prefix_hash, runs, span_hash, texts, utf8_bytes

PER_CLASS = 6000
LEVELS = (3, 4, 5, 6, 8)
DISCOUNT = 0.75
CAUTION = 2.5
CHUNK = 1 << 19


def _lower() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


_LOWER = _lower()
_WORD = np.array([48 <= b < 58 or 97 <= b < 123 or b >= 128 for b in range(256)])


def words(rows: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Prefix hashes of the small-letter bytes, starts and ends of words, and where each row's words begin."""
    _, data, offsets = utf8_bytes(rows)
    data = _LOWER[data]
    if len(data) > 1:
        lead = data[:-1]
        capital = np.flatnonzero((lead == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        data[capital] += 0x20
    letter = _WORD[data]
    mark = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x80)) if len(data) > 2 else np.zeros(0, np.int64)
    for k in range(3):  # general punctuation
        letter[mark + k] = False
    starts, ends = runs(letter, offsets)
    return prefix_hash(data), starts, ends, np.searchsorted(starts, offsets)


def chain(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each level, the words that have it and its key there; the last is the whole word."""
    out = []
    for k in LEVELS:
        has = np.flatnonzero(ends - starts > k)
        out.append((has, mix(span_hash(prefix, starts[has], starts[has] + k), k)))
    return [*out, (np.arange(len(starts)), mix(span_hash(prefix, starts, ends), 99))]


def with_sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with two min-hashes of their text's shingles of five words (of all its words where it has fewer)."""
    for batch in batches:
        rows = texts(batch.column(0))
        least = np.zeros((2, len(rows)), np.uint64)
        for a, b in char_chunks(rows, CHUNK):
            prefix, starts, ends, at = words(rows[a:b])
            word = span_hash(prefix, starts, ends)
            for i in range(a, b):
                own = word[at[i - a] : at[i - a + 1]]
                made = np.zeros(max(1, len(own) - 4), np.uint64)
                for j in range(min(5, len(own))):
                    made = made * np.uint64(0x9E3779B97F4A7C15) + own[j : j + len(made)]
                least[:, i] = mix(made, 1).min(), mix(made, 2).min()
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x.view(np.int64)) for x in least)], [*batch.schema.names, "a", "b"])


COUNTS = ("t0", "o0", "t1", "o1")


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, toxic, fold) to partial counts of expressions: key, parent, level, and for each fold the toxic and
    the ordinary documents that hold it."""
    names = ["key", "parent", "level", *COUNTS]
    for batch in batches:
        rows = texts(batch.column(0))
        toxic, fold = (np.asarray(batch.column(i)).astype(np.int64) for i in (1, 2))
        for a, b in char_chunks(rows, CHUNK):
            prefix, starts, ends, at = words(rows[a:b])
            if not len(starts):
                continue
            doc = np.repeat(np.arange(a, b), np.diff(at))
            parent = np.zeros(len(starts), np.uint64)
            for level, (has, key) in enumerate(chain(prefix, starts, ends)):
                if not len(has):
                    continue
                index, inverse = distinct(key)
                pairs = np.unique(inverse.astype(np.int64) * b + doc[has])
                what, who = pairs // b, pairs % b
                columns = [key[index].view(np.int64), parent[has][index].view(np.int64), np.full(len(index), level)]
                for f in (0, 1):
                    for y in (1, 0):
                        columns.append(np.bincount(what[(fold[who] == f) & (toxic[who] == y)], minlength=len(index)))
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64, copy=False)) for c in columns], names)
                parent[has] = key


@dataclass
class Evidence:
    """What a word says, by its longest known beginning: sorted keys and log-likelihood ratios."""

    keys: np.ndarray
    values: np.ndarray

    def of(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.zeros(len(starts))
        if len(self.keys):
            for has, key in chain(prefix, starts, ends):
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[at] == key
                out[has[hit]] = self.values[at[hit]]
        return out

    def sums(self, rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each text the summed log-likelihood ratio, and its number of words. A word that a text repeats counts
        as the root of its repeats, since repeats in one text are not independent."""
        total, number = np.zeros(len(rows)), np.zeros(len(rows), np.int64)
        for a, b in char_chunks(rows, CHUNK):
            prefix, starts, ends, at = words(rows[a:b])
            number[a:b] = np.diff(at)
            if len(starts):
                index, inverse = distinct(span_hash(prefix, starts, ends))
                value = self.of(prefix, starts[index], ends[index])
                told = np.flatnonzero(value[inverse])
                pairs, times = np.unique(np.repeat(np.arange(b - a), np.diff(at))[told] * len(index) + inverse[told], return_counts=True)
                total[a:b] = np.bincount(pairs // len(index), value[pairs % len(index)] * np.sqrt(times), b - a)
        return total, number


def ratios(parent: np.ndarray, level: np.ndarray, tox: np.ndarray, plain: np.ndarray, caution: float) -> np.ndarray:
    """For each expression the difference of the log-likelihoods of its chain up to it. ``parent`` is the index of the
    expression before it in the chain, or the number of expressions where there is none."""
    n = len(parent)
    seen = (tox > 0).astype(float) + (plain > 0)
    contexts = np.bincount(parent, seen, n + 1)[parent]
    shared = (np.maximum(seen - DISCOUNT, 0) + DISCOUNT) / contexts  # the kinds that share the discounted mass cancel out
    follows = []
    for count in (tox, plain):
        total, kinds = np.bincount(parent, count, n + 1), np.bincount(parent, count > 0, n + 1)
        left = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)[parent]
        follows.append(np.maximum(count - DISCOUNT, 0) / np.maximum(total[parent], 1) + left * shared)
    step = np.log(follows[0] / follows[1])
    doubt = caution * np.sqrt(1 / (tox + 0.5) + 1 / (plain + 0.5))
    whole, value = np.zeros(n + 1), np.zeros(n + 1)
    for k in range(len(LEVELS) + 1):  # a parent's level is always lower
        mine = np.flatnonzero(level == k)
        whole[mine] = whole[parent[mine]] + step[mine]
        before = value[parent[mine]]
        move = whole[mine] - before
        value[mine] = before + np.sign(move) * np.maximum(np.abs(move) - doubt[mine], 0)
    return value[:n]


def evidence(t: dict[str, np.ndarray], which: str, caution: float = CAUTION) -> Evidence:
    """Log-likelihood ratios from all counts; ``which`` names the folds that count. An expression that says the same as
    the one before it need not be kept."""
    tox, plain = (sum(t[f"{c}{f}"].astype(float) for f in which) for c in "to")
    order = np.argsort(t["key"].view(np.uint64))
    order = order[(tox + plain)[order] > 0]
    if not len(order):
        return Evidence(np.zeros(0, np.uint64), np.zeros(0, np.float32))
    keys, parent, level = t["key"].view(np.uint64)[order], t["parent"].view(np.uint64)[order], t["level"][order]
    up = np.minimum(np.searchsorted(keys, parent), len(keys) - 1)
    up = np.where((parent != 0) & (keys[up] == parent), up, len(keys))
    value = ratios(up, level, tox[order], plain[order], caution)
    new = value != np.append(value, 0)[up]
    return Evidence(keys[new], value[new].astype(np.float32))


def features(total: np.ndarray, number: np.ndarray) -> np.ndarray:
    return np.stack([total / np.sqrt(np.maximum(number, 1)), np.ones(len(total))], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted, slightly ridged logistic regression by Newton steps; more of the first feature is never less."""
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    z, beta, ridge = x / scale, np.zeros(x.shape[1]), 1e-2 * np.eye(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (weight * (y - p)) - ridge @ beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    beta[0] = max(beta[0], 0.0)
    return beta / scale


@dataclass
class Model:
    table: Evidence
    beta: np.ndarray

    def score(self, rows: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features(*self.table.sums(rows)) @ self.beta, -30, 30)))


def held_out(key: Column) -> Column:
    """Rows that no fit may see: crc32 of the key as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic") -> Model:
    """Counts over the bounded sample of labelled rows; a document with several labels is toxic if any says so.

    Without labelled rows of both classes every score is the share of toxic labels (0 without any).
    """
    spark = docs.sparkSession
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key))).groupBy(key).agg(F.max(label).cast("int").alias("y"))
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not (sizes.get(0) and sizes.get(1)):
        share = 1.0 if sizes.get(1) else 0.0
        return Model(Evidence(np.zeros(0, np.uint64), np.zeros(0, np.float32)), np.array([0, 30.0 if share else -30.0]))
    draw = F.pmod(F.xxhash64(F.col(key), F.lit(7)), F.lit(1 << 30)) < F.when(F.col("y") == 1, int(PER_CLASS / sizes[1] * (1 << 30)) + 1).otherwise(int(PER_CLASS / sizes[0] * (1 << 30)) + 1)
    chosen = spark.createDataFrame(known.where(draw).select(key, "y").toArrow(), schema=known.select(key, "y").schema)  # bounded by PER_CLASS
    drawn = docs.select(key, text).join(F.broadcast(chosen), key).select(text, "y", F.pmod(F.xxhash64(F.col(key), F.lit(8)), F.lit(2)).cast("int").alias("fold"), F.xxhash64(F.col(key), F.lit(9)).alias("order"))
    drawn = drawn.mapInArrow(tidy(with_sketch), f"{text} string, y int, fold int, order long, a long, b long")
    for sketch in ("a", "b"):  # copies are not independent: of texts with a sketch in common one counts
        drawn = drawn.groupBy(sketch).agg(F.min_by(F.struct(text, "y", "fold", "order", "a", "b"), F.struct("order", text)).alias("one")).select("one.*")
    sample = saved(drawn.select(text, "y", "fold"), "toxicity-sample")
    counts = sample.mapInArrow(tidy(count_batches), "key long, parent long, level long, t0 long, o0 long, t1 long, o1 long")
    counts = saved(counts.groupBy("key", "parent", "level").agg(*(F.sum(c).alias(c) for c in COUNTS)), "toxicity-counts")
    small = counts.select("key", "parent", F.col("level").cast("byte"), *(F.col(c).cast("int") for c in COUNTS))
    wide = small.toArrow()  # bounded by the sample
    t = {name: np.asarray(wide.column(name)) for name in wide.column_names}
    del wide
    halves = [evidence(t, "1"), evidence(t, "0")]  # a half is scored by the other's counts

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, fold = texts(batch.column(0)), np.asarray(batch.column(2))
            both = [h.sums(rows) for h in halves]
            yield pa.RecordBatch.from_arrays([pa.array(np.where(fold == 0, both[0][0], both[1][0])), pa.array(both[0][1]), pa.array(np.asarray(batch.column(1)).astype(np.int64))], ["total", "number", "y"])

    got = sample.mapInArrow(tidy(check), "total double, number long, y long").toArrow()
    total, number, y = (np.asarray(got.column(i)) for i in range(3))
    taken = np.array([max((y == c).sum(), 1) for c in (0, 1)])
    beta = logistic(features(total, number), y, np.array([sizes[0], sizes[1]])[y] / taken[y] / (sizes[0] + sizes[1]) * len(y)) if len(set(y.tolist())) == 2 else np.array([0, 0.0])
    for done in (sample, counts):
        discard(done)
    return Model(evidence(t, "01"), beta)


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """The kept columns and the score of each row, 0 to 1, from its text alone; a null text is the empty text."""
    from pyspark.sql.types import DoubleType, StructType

    rows = docs.select(*keep, text) if text not in keep else docs.select(*keep)
    at = rows.columns.index(text)
    schema = StructType([rows.schema[c] for c in keep]).add(name, DoubleType())
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(shared.value.score(texts(batch.column(at))))], schema.names)

    return rows.mapInArrow(tidy(run), schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: key, held_out, score, predicted.

    Null, empty and wordless texts are scored like any other, by the curve's value at no evidence. Very long texts are
    scored whole, in pieces of bounded size. Equal texts have equal scores (ties too), repeated rows each their own row; a key with
    several labels is toxic if one says so, and null labels and keys teach nothing. Rows with a null key are scored and
    not held out. Other columns are not read, whatever their names. Without labels of both classes the score is that of
    the only class, 0 without any. An empty table gives no rows.
    """
    out = score(docs, fit(docs, labels, text, key), text, (key,))
    return out.select(key, held_out(F.col(key)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
