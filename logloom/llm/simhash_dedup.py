"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most three bits differ in at most two outside one of three blocks of bits. So for
each block, left out in turn, every distinct fingerprint emits what remains and all variants of it with one bit turned:
the balls of half the remaining radius. Fingerprints of a pair meet in a common variant. The variants are shuffled,
collisions are verified on all 64 bits, and only links enough to span a collision's groups are kept, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import Forest, components
from .runtime import saved, tidy
from .textnum import mix, texts

RADIUS = 3
#: Bits of each block: first bit, bits.
BLOCKS = ((0, 22), (22, 21), (43, 21))
SMALL = 2048
#: Min-hashes of a text for near copies: bands of so many, with so many bands. A pair with similarity 0.8 has a band in
#: common with probability 0.99997.
BANDS, DEPTH = 20, 4
#: Rows of a band's key that a row is compared with, and the likeliest of them that are verified, at first.
REACH, VERIFIED = 128, 8
#: Rows in a chunk where the rest of a key's pairs is compared.
CHUNK = 2048


def shingle_digests(text: str, width: int, seed: int) -> np.ndarray:
    """Digests of the text's shingles as rows of eight bytes; none without words."""
    from xxhash import xxh64_digest

    words = text.encode().lower().split()  # on bytes: A-Z only, and ASCII white space
    if not words:
        return np.zeros((0, 8), np.uint8)
    joined = b" ".join(words)
    k = min(width, len(words))
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: len(words) - k].tolist()]
    stops = (ends[k - 1 :] - 1).tolist()
    return np.frombuffer(b"".join([xxh64_digest(joined[s:e], seed) for s, e in zip(starts, stops, strict=True)]), np.uint8).reshape(-1, 8)


def shingle_bits(text: str, width: int, seed: int) -> bytes:
    """The fingerprint's eight bytes, most significant first."""
    return digest_bits(shingle_digests(text, width, seed))


def digest_bits(digests: np.ndarray) -> bytes:
    n, counts = len(digests), np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        counts += np.unpackbits(digests[i : i + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > n).tobytes()


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 3, seed: int = 42) -> DataFrame:
    """(key, fp long) for every row; a null text is the empty text, whose fingerprint is zero."""
    rows = docs.select(key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = b"".join([shingle_bits(x, width, seed) for x in texts(batch.column(1))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.frombuffer(made, ">i8").astype(np.int64))], [key, "fp"])

    return rows.mapInArrow(tidy(run), f"{key} {rows.schema[key].dataType.simpleString()}, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def variants(fp: Column) -> Column:
    """Array of the keys under which a fingerprint meets others."""
    out = []
    for k, (first, bits) in enumerate(BLOCKS):
        hole = ((1 << bits) - 1) << first
        salt = (0x9E3779B97F4A7C15 * (k + 1)) & ((1 << 64) - 1)
        rest = fp.bitwiseAND(F.lit(_signed(~hole & ((1 << 64) - 1)))).bitwiseXOR(F.lit(_signed(salt)))
        out.append(rest)
        out += [rest.bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64) if not hole >> i & 1]
    return F.array(*out)


def bits_between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64))


def spanning(values: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links (indices of distinct values within the radius of each other) that span their components exactly."""
    forest, out = Forest(len(values)), []
    if len(values) <= SMALL:
        near = bits_between(values[:, None], values[None, :]) <= radius
        pairs = np.argwhere(np.triu(near, 1)).tolist()
    else:  # look up every value's ball of the radius in the sorted values
        from itertools import combinations

        order = np.argsort(values)
        sorted_values = values[order]
        flips = np.array([_signed(sum(1 << i for i in c)) for r in range(1, radius + 1) for c in combinations(range(64), r)], np.int64)
        pairs = []
        for flip in flips.tolist():
            want = values ^ np.int64(flip)
            at = np.minimum(np.searchsorted(sorted_values, want), len(values) - 1)
            hit = np.flatnonzero(sorted_values[at] == want)
            hit = hit[hit < order[at[hit]]]
            pairs += zip(hit.tolist(), order[at[hit]].tolist(), strict=True)
            pairs = [(x, y) for x, y in pairs if forest.union(x, y)] if len(pairs) > 1_000_000 else pairs
            if len(pairs) >= len(values):
                out += [(x, y) for x, y in pairs if forest.union(x, y)]
                pairs = []
    return out + [(x, y) for x, y in pairs if forest.union(x, y)]


def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verified links from rows sorted by key; each key's group is read to its end whatever the batches."""
    keys, fps = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def links(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(keys) < 2:
            return
        cuts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        sizes = np.diff(np.append(cuts, len(keys)))
        two = cuts[sizes == 2]
        close = two[bits_between(fps[two], fps[two + 1]) <= RADIUS]
        a, b = [fps[close]], [fps[close + 1]]
        for at, size in zip(cuts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            group = np.unique(fps[at : at + size])
            if found := spanning(group):
                x, y = np.array(found).T
                a.append(group[x])
                b.append(group[y])
        pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        if len(pairs):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, i])) for i in (0, 1)], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.concatenate([keys, np.asarray(batch.column(0))])
        fps = np.concatenate([fps, np.asarray(batch.column(1))])
        last = int(np.searchsorted(keys, keys[-1]))  # where the group that may go on begins
        if last:
            yield from links(keys[:last], fps[:last])
            keys, fps = keys[last:], fps[last:]
    yield from links(keys, fps)


def link_fingerprints(distinct: DataFrame) -> DataFrame:
    """(a, b) pairs of fingerprints within the radius, from a table of distinct ``fp``; enough for all components."""
    rows = distinct.select(F.explode(variants(F.col("fp"))).alias("key"), "fp")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(tidy(met), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 3, seed: int = 42) -> DataFrame:
    """One row per row of ``docs``: key, fingerprint (16 hex digits), component_id (least key reachable, itself included).

    Texts without words have fingerprint zero and are linked like any other. Null keys are kept; they join a component
    and never name one that has another key. An empty table gives no rows; columns besides the two are not read.
    """
    prints = saved(fingerprints(docs, text, key, width, seed).select(F.col(key).alias("id"), "fp"), "fingerprints")
    first = saved(prints.groupBy("fp").agg(F.min("id").alias("rep")), "distinct-fingerprints")
    links = link_fingerprints(first)
    ends = links
    for side in ("a", "b"):
        ends = ends.join(first.select(F.col("fp").alias(side), F.col("rep").alias(f"{side}_rep")), side)
    joined = components(ends.where("a_rep is not null and b_rep is not null"), "a_rep", "b_rep")
    classes = first.join(joined, first["rep"] == joined["id"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(classes, "fp").select(F.col("id").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def min_hashes(digests: np.ndarray) -> np.ndarray:
    """The min-hashes of one text's shingles; a text without shingles has the same as any other such."""
    values = digests.view(">u8").astype(np.uint64).ravel()
    factors = mix(np.arange(BANDS * DEPTH, dtype=np.uint64), 7)[:, None] | np.uint64(1)
    least = np.full(BANDS * DEPTH, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(values), 1024):
        least = np.minimum(least, (values[None, i : i + 1024] * factors).min(axis=1))
    return mix(least, 8)  # a least value's own bits are uneven


def agreement() -> int:
    """Bytes that sketches of near copies have in common at least: 0.8 less four standard errors."""
    return int(BANDS * DEPTH * (0.8 - 4 * np.sqrt(0.16 / (BANDS * DEPTH))))


def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that may be near copies, from rows (key, id, sketch) sorted by key and sketch: of the ``REACH`` rows before
    one that have its key, the ``VERIFIED`` whose sketches agree most, if by 0.8 less four standard errors."""
    least = agreement()
    keys, ids, sketches = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, BANDS * DEPTH), np.uint8)
    for batch in (batch.slice(i, 1024) for batch in batches for i in range(0, batch.num_rows, 1024)):  # a row has up to REACH pairs
        old = len(keys)
        keys = np.concatenate([keys, np.asarray(batch.column(0))])
        ids = np.concatenate([ids, np.asarray(batch.column(1))])
        sketches = np.concatenate([sketches, np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, BANDS * DEPTH)])
        rows, others, agree = [], [], []
        for d in range(1, min(REACH, len(keys) - 1) + 1):
            at = np.arange(max(old, d), len(keys))
            at = at[keys[at] == keys[at - d]]
            if not len(at):
                break  # rows of a key are neighbours, so none are farther apart
            same = (sketches[at] == sketches[at - d]).sum(axis=1)
            good = same >= least
            rows.append(at[good])
            others.append(at[good] - d)
            agree.append(same[good])
        if rows:
            row, other, same = (np.concatenate(v) for v in (rows, others, agree))
            order = np.lexsort((-same, row))
            row, other = row[order], other[order]
            begins = np.flatnonzero(np.append(True, row[1:] != row[:-1]))[: len(row)]
            rank = np.arange(len(row)) - np.repeat(begins, np.diff(np.append(begins, len(row))))
            a, b = ids[row[rank < VERIFIED]], ids[other[rank < VERIFIED]]
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])
        keys, ids, sketches = keys[-REACH:], ids[-REACH:], sketches[-REACH:]


def left_over(once: DataFrame, joined: DataFrame, said: DataFrame, width: int, similarity: float, seed: int) -> DataFrame:
    """Links (a, b) of texts with a band in common that are in different groups of ``joined`` and are near copies, as many
    as tie the groups together. Of each band's key the rows of one group, the least, are not held against each other, all
    others against all, where their texts (``said``) are: a pair that is no near copy makes no row."""

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (key, chunk, asks, id, group, text) sorted by key and chunk, those that do not ask first: the chunk's
        rows, and what is held against them."""
        at, held, flat, forest = None, [], None, {}

        def find(g: int) -> int:
            while forest.setdefault(g, g) != g:
                forest[g] = g = forest[forest[g]]
            return g

        for batch in batches:
            out = []
            for key, chunk, asks, node, group, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, chunk) != at:
                    at, held, flat, forest = (key, chunk), [], None, {}
                own = np.unique(shingle_digests(x or "", width, seed).view(">u8").astype(np.uint64))
                if not asks:
                    held.append((node, group, own))
                    continue
                if not held:
                    continue
                if flat is None:
                    flat, inverse = np.unique(np.concatenate([r[2] for r in held]), return_inverse=True)
                    nodes, groups, sizes = np.array([r[0] for r in held]), np.array([r[1] for r in held]), np.array([len(r[2]) for r in held])
                    row = np.repeat(np.arange(len(held)), sizes)
                known = np.zeros(len(flat) + 1, bool)
                place = np.searchsorted(flat, own)
                known[place[np.append(flat, 0)[place] == own]] = True
                both = np.bincount(row[known[inverse]], minlength=len(held))
                near = np.flatnonzero((both / np.maximum(sizes + len(own) - both, 1) >= similarity) & (groups != group))
                for i in near[np.unique(groups[near], return_index=True)[1]].tolist():
                    a, b = find(group), find(int(groups[i]))
                    if a != b:
                        forest[a] = b
                        out.append((max(node, int(nodes[i])), min(node, int(nodes[i]))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])

    rows = once.join(joined, once["node"] == joined["id"], "left").select("node", "bands", F.coalesce("component", "node").alias("group"))
    bands = rows.select(F.explode("bands").alias("key"), "node", "group")
    mixed = bands.groupBy("key").agg(F.count("*").alias("n"), F.min("group").alias("main"), F.max("group").alias("most"))
    mixed = mixed.where((F.col("n") > VERIFIED + 1) & (F.col("main") < F.col("most"))).select("key", "main", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    dealt = saved(bands.join(mixed, "key"), "mixed-bands")
    texts_of = said.join(dealt.select("node").distinct(), "node").dropDuplicates(["node"])
    members = dealt.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")).withColumn("asks", F.lit(False))
    asks = dealt.where(F.col("group") != F.col("main")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("asks", F.lit(True))
    columns = ["key", "chunk", "asks", "node", "group"]
    work = members.select(*columns).unionByName(asks.select(*columns)).join(texts_of, "node").select(*columns, "t")
    return work.repartition("key", "chunk").sortWithinPartitions("key", "chunk", "asks").mapInArrow(tidy(rest), "a long, b long").distinct()


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sets of digests, given as sorted distinct values."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def said(text: Column) -> Column:
    """Digest of a text's words as ``shingle_digests`` takes them; texts with equal words are one text."""
    small = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.md5(F.trim(F.regexp_replace(small, r"[\x20\x09-\x0D]+", " ")))


def text_groups(docs: DataFrame, text: str, key: str, width: int, similarity: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """Rows (id, words) of all documents, and for each distinct text (words, rep, component_id): the least key that has
    it, and the least that pairs of texts with at least this Jaccard similarity of shingles lead to."""
    rows = docs.select(key, text, said(F.col(text)).alias("__words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, sketches, bands = [], [], []
            for x in texts(batch.column(1)):
                digests = shingle_digests(x, width, seed)
                least = min_hashes(digests)
                prints.append(digest_bits(digests))
                sketches.append((least & np.uint64(255)).astype(np.uint8).tobytes())
                made = np.zeros(BANDS, np.uint64)
                for column in least.reshape(BANDS, DEPTH).T:
                    made = mix(made ^ column, 5)
                bands.append(mix(made ^ np.arange(BANDS, dtype=np.uint64), 6).view(np.int64))
            keys = pa.ListArray.from_arrays(pa.array(np.arange(len(bands) + 1, dtype=np.int32) * BANDS), pa.array(np.concatenate(bands)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.frombuffer(b"".join(prints), ">i8").astype(np.int64)), pa.array(sketches, pa.binary()), keys, batch.column(2)], ["id", "fp", "sketch", "bands", "words"])

    prints = saved(rows.mapInArrow(tidy(run), f"id {rows.schema[key].dataType.simpleString()}, fp long, sketch binary, bands array<long>, words string"), "near-copy-sketches")
    equal = prints.groupBy("words").agg(F.min("id").alias("rep"), *(F.any_value(c).alias(c) for c in ("fp", "sketch", "bands")))
    equal = saved(equal.withColumn("node", F.monotonically_increasing_id()), "distinct-texts")
    once = equal.where("rep is not null").select("node", "fp", "sketch", "bands")
    first = saved(once.groupBy("fp").agg(F.min("node").alias("node")), "distinct-fingerprints")
    close = link_fingerprints(first)
    for side in ("a", "b"):
        close = close.join(first.select(F.col("fp").alias(side), F.col("node").alias(f"{side}_node")), side)
    close = close.select(F.greatest("a_node", "b_node").alias("a"), F.least("a_node", "b_node").alias("b"))
    kept = once.join(first.withColumnRenamed("node", "first"), "fp").select(F.col("node").alias("a"), F.col("first").alias("b"))
    bands = once.select(F.explode("bands").alias("key"), F.col("node").alias("id"), "sketch")
    meeting = bands.repartition("key").sortWithinPartitions("key", "sketch", "id").mapInArrow(tidy(alike), "a long, b long")
    pairs = saved(close.unionByName(kept).unionByName(meeting).where("a <> b").distinct(), "near-copy-candidates")
    source = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).alias("t"), said(F.col(text)).alias("words"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for batch in batches:
            out = []
            for a, b, side, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), texts(batch.column(3)), strict=True):
                if side == 0 and held and held[:2] == (a, b):
                    continue  # a repeated row
                shingles = np.unique(shingle_digests(x, width, seed).view(">u8").astype(np.uint64))
                if side == 0:
                    held = a, b, shingles
                elif held and held[:2] == (a, b) and jaccard(held[2], shingles) >= similarity:
                    out.append((a, b))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])

    def similar(pairs: DataFrame) -> DataFrame:
        sides = pairs.select(F.col("a").alias("node"), "a", "b", F.lit(0).alias("side")).unionByName(pairs.select(F.col("b").alias("node"), "a", "b", F.lit(1).alias("side")))
        asked = sides.join(equal.select("node", F.col("rep").cast("long").alias("id"), "words"), "node")
        return source.join(asked, ["id", "words"]).select("a", "b", "side", "t").repartition("a", "b").sortWithinPartitions("a", "b", "side").mapInArrow(tidy(verify), "a long, b long")

    joined = components(similar(pairs), "a", "b")
    said_by = source.join(equal.select("node", F.col("rep").cast("long").alias("id"), "words"), ["id", "words"]).select("node", "t")
    more = saved(left_over(once, joined, said_by, width, similarity, seed), "near-copy-links")
    if more.head(1):
        joined = components(more.unionByName(joined.select(F.col("id").alias("a"), F.col("component").alias("b"))), "a", "b")
    members = equal.select("node", "words", "rep").join(joined, equal["node"] == joined["id"], "left").select("words", "rep", F.coalesce("component", "node").alias("group"))
    least = members.groupBy("group").agg(F.min("rep").alias("component_id"))
    return prints.select("id", "words"), members.join(least, "group").select("words", "rep", "group", "component_id")


def near_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5, similarity: float = 0.8, seed: int = 42) -> DataFrame:
    """(key, component_id) for every row: the least key that pairs of texts with at least this Jaccard similarity of
    shingles lead to, itself included.

    At similarity 0.8 fingerprints differ in about ten of 64 bits, which no ball of practical size holds. So candidates
    are fingerprints within the radius and texts with a band of min-hashes in common; both are verified on all shingles.
    Equal words are one text; texts without words (null texts too) are equal; shorter ones than ``width`` words are one
    shingle. Texts that only rows with null keys have link with equal texts only. Rows are grouped by their own text,
    so rows with equal keys may be in two groups. Keys are whole numbers; very long texts are taken whole; other columns
    are not read. An empty table gives no rows.
    """
    rows, groups = text_groups(docs, text, key, width, similarity, seed)
    return rows.join(groups.select("words", "component_id"), "words").select(F.col("id").alias(key), "component_id")


def without_near_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5, similarity: float = 0.8, seed: int = 42) -> DataFrame:
    """The rows of ``docs`` with one row of each group of ``near_copies``, all columns carried along.

    The row that stays has the group's least key; of repeated rows, with one key and equal words, any one stays. A group
    with null keys alone keeps one row.
    """
    _, groups = text_groups(docs, text, key, width, similarity, seed)
    mark = lambda k, words: F.concat(words, F.lit(" "), F.coalesce(k.cast("string"), F.lit("null")))
    best = groups.groupBy("group").agg(F.min(F.struct(F.col("rep").isNull(), F.col("rep"), F.col("words"))).alias("one"))
    chosen = best.select(mark(F.col("one.rep"), F.col("one.words")).alias("__mark"))
    marked = docs.withColumn("__mark", mark(F.col(key), said(F.col(text))))
    return marked.join(chosen, "__mark").dropDuplicates(["__mark"]).select(*docs.columns)
