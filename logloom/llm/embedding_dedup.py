"""Embedding near-duplicates with an inverted file and product quantisation.

Unit vectors are put on the coarse list of their nearest centre; residuals are coded in subspaces. A pair with cosine
``c`` or more lies within ``r = sqrt(2 - 2c)``. A vector probes every list whose bisecting plane towards its own list
is no farther than ``r``, beyond which no neighbour can be. On a list, asymmetric distances come from the codes, and as
each code's own error is stored, the triangle inequality says which rows may still be near. Those are compared exactly,
in double precision. Equal vectors of a label are one row with a number of copies.

The vectors of a label are dealt into blocks, and each two blocks are one task's unit of work, so a pair of vectors meets
once and a row is sent as often as its label has blocks, however many lists it probes. Vectors are sent as they came, and
units are worked on in passes, each of which sends about as many bytes as the table has and deletes them at its end. So
the disk in use does not grow with the number of blocks. Links are counted in a unit, and only as many as span their
components leave it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import Forest, components
from .runtime import loaded, saved, tidy

#: The index is fitted on at most about so many rows, chosen by a hash.
SAMPLE = 16_384
CODES = 64
#: Rows of a block at least, and their bytes at most; a table has about so many blocks or more.
BLOCK, BLOCK_BYTES, BLOCKS = 1024, 16 << 20, 12
#: Bytes that a pass sends, or as many as all vectors have, if these are more.
PASS_BYTES = 64 << 20
#: So many widths, the most frequent, have an index of their own; vectors of another width are on one list.
WIDTHS = 64


@dataclass
class Index:
    centres: np.ndarray
    books: list[np.ndarray]

    def width(self) -> int:
        return -(-self.centres.shape[1] // len(self.books)) if self.books else 0

    def assign(self, x: np.ndarray) -> np.ndarray:
        return nearest(x, self.centres)

    def encode(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of each subspace, and the length of what they leave out."""
        codes, left, w = np.empty((len(residual), len(self.books)), np.uint8), residual.copy(), self.width()
        for m, book in enumerate(self.books):
            part = slice(m * w, m * w + book.shape[1])
            codes[:, m] = nearest(residual[:, part], book)
            left[:, part] -= book[codes[:, m]]
        return codes, np.linalg.norm(left, axis=1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The residuals that codes stand for."""
        return np.concatenate([book[codes[:, m]] for m, book in enumerate(self.books)], axis=1)


def nearest(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.argmin((to**2).sum(axis=1)[None] - 2 * x @ to.T, axis=1)


def k_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centres by Lloyd's rounds from a fixed start."""
    k = min(k, len(x))
    centres = x[np.random.default_rng(7).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        sizes = np.bincount(at, minlength=k)
        full = sizes > 0
        centres[full] = sums[full] / sizes[full][:, None]
    return centres


def fit(x: np.ndarray, lists: int, parts: int = 8) -> Index:
    centres = k_means(x, lists)
    residual = x - centres[nearest(x, centres)]
    w = -(-x.shape[1] // min(parts, x.shape[1]))
    return Index(centres, [k_means(residual[:, i : i + w], CODES) for i in range(0, x.shape[1], w)])


@loaded(256)
def one_list(width: int) -> Index:
    return fit(np.ones((1, width)) / np.sqrt(width), 1)


def unit(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values in double precision, list offsets, and which vectors are usable (not null, finite, not zero)."""
    column = column.cast(pa.list_(pa.float64())) if column.type != pa.list_(pa.float64()) else column
    sizes = np.array([-1 if s is None else s for s in column.value_lengths().to_pylist()], np.int64)
    flat = column.flatten()
    values = np.asarray(flat.fill_null(float("nan")), dtype=np.float64)
    offsets = np.append(0, np.cumsum(np.maximum(sizes, 0)))
    sums = np.append(0, np.cumsum(np.where(np.isfinite(values), 0, 1)))
    some = np.append(0, np.cumsum(values != 0))
    good = (sizes > 0) & (sums[offsets[1:]] == sums[offsets[:-1]]) & (some[offsets[1:]] > some[offsets[:-1]])
    return values, offsets, good


def distinct_vectors(table: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(id, label, v): each row with the bytes of its numbers, null for a vector that links with nothing."""
    real = np.dtype(np.float32 if table.schema[vector].dataType.simpleString() == "array<float>" else np.float64)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, offsets, good = unit(batch.column(1))
            data = (values + 0.0).astype(real).tobytes()
            ends = (offsets * real.itemsize).tolist()
            out = [data[ends[i] : ends[i + 1]] if ok else None for i, ok in enumerate(good.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.binary())], ["id", "label", "v"])

    kind = table.schema[label].dataType.simpleString()
    return table.select(key, vector, label).mapInArrow(tidy(pack), f"id long, label {kind}, v binary")


def units(raw: np.ndarray) -> np.ndarray:
    """Rows as unit vectors in double precision."""
    x = raw.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that squares stay finite
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x


class Block:
    """Rows of one label sorted by list, with their codes."""

    def __init__(self, raw: np.ndarray, rep: np.ndarray, copies: np.ndarray, index: Index, radius: float):
        at = np.concatenate([index.assign(units(raw[i : i + 4096])) for i in range(0, len(raw), 4096)])
        order = np.argsort(at, kind="stable")
        self.raw, self.rep, self.copies, self.at = raw[order], rep[order], copies[order].astype(np.float64), at[order]
        self.coded = np.empty(raw.shape, np.float32)
        self.least = np.empty(len(raw), np.float32)  # the product with a coded row of whatever may be near the row
        for i in range(0, len(raw), 4096):
            s = slice(i, i + 4096)
            centre = index.centres[self.at[s]]
            codes, error = index.encode(units(self.raw[s]) - centre)
            coded = centre + index.decode(codes)
            self.coded[s] = coded
            self.least[s] = (1 + (coded**2).sum(axis=1) - (radius + error + 1e-6) ** 2) / 2 - 1e-4  # rounding never hides a row


def links_between(a: Block, b: Block, index: Index, radius: float, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links between rows of two blocks (places in each), or of one, each link once."""
    norms = (index.centres**2).sum(axis=1)
    apart = np.sqrt(np.maximum(norms[:, None] + norms[None] - 2 * index.centres @ index.centres.T, 0)) + 1e-6  # rounding never hides a list
    for i in range(0, len(a.raw), 512):
        x = units(a.raw[i : i + 512])
        own = a.at[i : i + 512]
        square = norms[None] - 2 * x @ index.centres.T
        probe = square - square[np.arange(len(x)), own][:, None] <= 2 * apart[own] * radius + 1e-9
        probe[np.arange(len(x)), own] = True
        listed = np.flatnonzero(probe.any(axis=0)[b.at])  # rows on the lists that these rows probe
        if a is b:
            listed = listed[listed > i]
        small = x.astype(np.float32)
        for j in range(0, len(listed), 2048):
            to = listed[j : j + 2048]
            near = small @ b.coded[to].T >= b.least[to][None]
            if a is b:
                near &= to[None] > np.arange(i, i + len(x))[:, None]
            p, q = np.nonzero(near)
            if not len(p):
                continue
            if 16 * len(p) > near.size:  # crowded: all at once, and what is next to the threshold for itself
                y = units(b.raw[to])
                cosine = (x @ y.T)[p, q]
                edge = np.flatnonzero(np.abs(cosine - threshold) < 1e-9)
            else:
                cosine, edge, y = np.empty(len(p)), np.arange(len(p)), None
            for k in range(0, len(edge), 1 << 14):
                e = edge[k : k + (1 << 14)]
                cosine[e] = (x[p[e]] * (units(b.raw[to[q[e]]]) if y is None else y[q[e]])).sum(axis=1)
            hit = cosine >= threshold
            if hit.any():
                yield i + p[hit], to[q[hit]]


def joined_up(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least place that each place is joined to, after further links."""
    u, v = root[u], root[v]
    new = np.flatnonzero(u != v)
    if not len(new):
        return root
    pairs = np.unique(np.stack([u[new], v[new]], axis=1), axis=0)
    ids, inverse = np.unique(pairs, return_inverse=True)
    inverse = inverse.reshape(-1, 2)
    forest = Forest(len(ids))
    for x, y in inverse.tolist():
        forest.union(x, y)
    to = np.arange(len(root))
    to[ids] = ids[[forest.find(k) for k in range(len(ids))]]
    return to[root]


def near_duplicates(table: DataFrame, threshold: float = 0.93, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row per row: key, n_links (other rows linked directly), component_id (least key reachable), kept.

    Rows are linked when their labels are equal and not null, their vectors have the same width, and their cosine in
    double precision is at least ``threshold``. Vectors that are null, empty, zero, or hold null or non-finite numbers
    link with nothing, but are returned. Rows with a null key link
    with nothing either; keys are expected to be distinct. An empty table gives no rows.
    """
    spark = table.sparkSession
    real = np.dtype(np.float32 if table.schema[vector].dataType.simpleString() == "array<float>" else np.float64)
    rows = distinct_vectors(table, key, vector, label)
    usable = rows.where("v is not null and label is not null and id is not null")
    once = saved(usable.groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "distinct-vectors")
    once = once.withColumn("w", (F.length("v") / real.itemsize).cast("int"))
    n = once.count()
    radius = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-9
    widths = [r[0] for r in once.groupBy("w").count().orderBy(F.desc("count"), "w").limit(WIDTHS).collect()]
    indexes: dict[int, Index] = {}
    draw = F.pmod(F.xxhash64("v"), F.lit(max(1, n // SAMPLE))) == 0
    for w in widths:
        got = once.where((F.col("w") == w) & draw).select("v").limit(2 * SAMPLE).toArrow()  # the index's bounded sample
        x = np.frombuffer(b"".join(got.column(0).to_pylist()), real).reshape(-1, w)
        indexes[w] = fit(units(x) if len(x) else np.ones((1, w)) / np.sqrt(w), int(np.clip(np.sqrt(n) / 8, 1, 1024)))
    shared = spark.sparkContext.broadcast(indexes)
    most = F.least(F.lit(max(BLOCK, n // BLOCKS)), F.greatest(F.lit(BLOCK), F.floor(F.lit(BLOCK_BYTES) / (4 * F.col("w")))))
    groups = once.groupBy("label", "w").agg(F.count("*").alias("n")).where("n > 1")
    groups = saved(groups.withColumn("blocks", F.ceil(F.col("n") / most).cast("int")).withColumn("group", F.monotonically_increasing_id()), "vector-groups")
    size = F.col("n") * (F.col("w") * real.itemsize + 48)
    all_bytes, sent_bytes = groups.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.sum(size * F.col("blocks")), F.lit(0))).first()
    passes = max(1, -(-sent_bytes // max(PASS_BYTES, all_bytes)))
    dealt = once.join(groups.select("label", "w", "group", "blocks"), ["label", "w"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    work = dealt.select("group", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "w", "v", "rep", "copies")
    turn = F.pmod(F.xxhash64("group", "lo", "hi"), F.lit(passes))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by unit: exact links of each unit's rows, counted and spanned."""
        at, w, parts = None, 0, []

        def flush() -> Iterator[pa.RecordBatch]:
            if not parts:
                return
            block, rep, copies = (np.concatenate([p[k] for p in parts]) for k in (0, 1, 2))
            raw = np.concatenate([p[3] for p in parts])
            parts.clear()
            index = shared.value.get(w) or one_list(w)
            halves = [np.flatnonzero(block == k) for k in sorted({at[1], at[2]})]
            if not all(len(h) for h in halves):
                return
            sides = [Block(raw[h], rep[h], copies[h], index, radius) for h in halves]
            del raw
            begin = len(sides[0].rep) if len(sides) == 2 else 0
            rep = np.concatenate([s.rep for s in sides])
            copies = np.concatenate([s.copies for s in sides])
            links, root = np.zeros(len(rep)), np.arange(len(rep))
            for a, b in links_between(sides[0], sides[-1], index, radius, threshold):
                b = b + begin
                links += np.bincount(a, weights=copies[b], minlength=len(rep)) + np.bincount(b, weights=copies[a], minlength=len(rep))
                root = joined_up(root, a, b)
            some, tied = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(rep)))
            if len(some):
                made = (np.concatenate([rep[some], rep[tied]]), np.concatenate([links[some].astype(np.int64), np.zeros(len(tied), np.int64)]), np.concatenate([rep[some], rep[root[tied]]]))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in made], ["a", "links", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            group, lo, hi, block, width, rep, copies = (np.asarray(batch.column(k)) for k in (0, 1, 2, 3, 4, 6, 7))
            starts = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]))).tolist()
            for i, j in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                here = int(group[i]), int(lo[i]), int(hi[i])
                if here != at:
                    yield from flush()
                    at, w = here, int(width[i])
                raw = np.frombuffer(b"".join(batch.column(5).slice(i, j - i).to_pylist()), real).reshape(-1, w)
                parts.append((block[i:j], rep[i:j], copies[i:j], raw))
        yield from flush()

    found = None
    for k in range(passes):
        units_of = work.where(turn == k) if passes > 1 else work
        links = saved(units_of.repartition("group", "lo", "hi").sortWithinPartitions("group", "lo", "hi").mapInArrow(tidy(search), "a long, links long, b long"), "vector-links")
        found = links if found is None else found.unionByName(links)
    counts = found.where("links > 0").groupBy("a").agg(F.sum("links").alias("others"))
    joined = components(found.where("links = 0"), "a", "b")
    classes = once.join(counts, once["rep"] == counts["a"], "left").join(joined, once["rep"] == joined["id"], "left")
    classes = classes.select("label", F.sha2("v", 256).alias("digest"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    classes = saved(classes, "vector-classes")
    every = rows.select("id", "label", F.coalesce(F.when(F.col("id").isNotNull(), F.sha2("v", 256)), F.col("id").cast("string")).alias("digest"))
    linked = every.join(classes, ["label", "digest"], "left")
    return linked.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"), (F.col("id") == F.coalesce("component_id", "id")).alias("kept"))
