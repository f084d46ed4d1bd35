"""Document fingerprints by locally consistent parsing.

A text's characters are names of level zero. At each level runs of one name become one name, deterministic coin
tossing (where does a name first differ from its left neighbour, and how) brings every name down to a label below six
that differs from its neighbours', and phrases begin where labels have a local maximum. A phrase's name is a hash of the
names in it. Labels depend on a few names to the left only, so equal substrings get equal phrases in their interior at
any offset. The fingerprint is the name of the whole text followed by the smallest names of phrases of level two and
above; likeness is the share of names in common, exact where a text has fewer than ``SIZE`` of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import tidy
from .textnum import code_points, mix, prefix_hash, span_hash

SIZE = 64
FIRST = 2
#: Ranges of keys at most; with ``STEP`` sampled keys for each, the driver gets a bounded number of keys.
RANGES, STEP = 65_536, 16
CHUNK = 1 << 19
_U64 = np.uint64


def _differ(now: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Twice the lowest bit at which two names differ, and that bit's value in the first."""
    x = now ^ before
    low = np.bitwise_count((x & (~x + x.dtype.type(1))) - x.dtype.type(1))
    return (2 * low + ((now >> low.astype(now.dtype)) & now.dtype.type(1)).astype(np.uint8)).astype(np.uint8)


def labels(names: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Labels below six; neighbours within a text differ. ``firsts`` are the places where texts begin."""
    before = np.empty_like(names)
    before[1:] = names[:-1]
    before[firsts] = ~names[firsts]
    out = _differ(names, before)
    for _ in range(3):
        left = np.empty_like(out)
        left[1:] = out[:-1]
        left[firsts] = ~out[firsts]
        out = _differ(out, left)
    return out


def one_level(names: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The names of the next level, and where each text begins there. Texts of one name stay as they are."""
    n = len(names)
    some = offsets[:-1][offsets[1:] > offsets[:-1]]  # begins of texts that are not empty
    new = np.ones(n, bool)
    new[1:] = names[1:] != names[:-1]
    new[some] = True
    heads = np.flatnonzero(new)
    lengths = np.diff(np.append(heads, n))
    single = names[heads].astype(_U64)
    again = lengths > 1
    single[again] = mix(single[again] ^ mix(lengths[again].astype(_U64), 5), 6)
    at = np.searchsorted(heads, offsets)
    firsts = np.searchsorted(heads, some)
    label = labels(single, firsts)
    m = len(single)
    start = np.zeros(m, bool)
    if m > 2:
        start[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
    last = np.append(firsts[1:], m) - 1
    start[last] = False  # a phrase of the last name alone would depend on the end
    start[firsts] = True
    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], m)
    made = span_hash(prefix_hash(single), starts, ends)
    return made, np.searchsorted(starts, at)


def sketches(rows: list[str]) -> list[tuple[int, np.ndarray]]:
    """For each text the name of the whole, and its smallest phrase names in order."""
    _, points, offsets = code_points(rows)
    whole = np.full(len(rows), 0x243F6A8885A308D3, _U64)
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    names, alive = points, np.arange(len(rows))
    sizes = np.diff(offsets)
    alive = alive[sizes > 0]
    offsets = np.append(0, np.cumsum(sizes[sizes > 0]))
    level = 0
    while len(alive):
        names, offsets = one_level(names, offsets)
        level += 1
        sizes = np.diff(offsets)
        tagged = mix(names, 100 + level)
        done = sizes == 1
        if level >= FIRST:
            kept.append((np.repeat(alive, sizes), tagged))
        elif done.any():
            kept.append((alive[done], tagged[offsets[:-1][done]]))
        whole[alive[done]] = tagged[offsets[:-1][done]]
        stay = np.repeat(~done, sizes)
        names, alive = names[stay], alive[~done]
        offsets = np.append(0, np.cumsum(sizes[~done]))
    doc = np.concatenate([x for x, _ in kept]) if kept else np.zeros(0, np.int64)
    name = np.concatenate([x for _, x in kept]) >> _U64(32) if kept else np.zeros(0, _U64)
    key = np.unique((doc.astype(_U64) << _U64(32)) | name)
    at = np.searchsorted(key, np.arange(len(rows) + 1).astype(_U64) << _U64(32))
    small = (key & _U64(0xFFFFFFFF)).astype(np.uint32)
    return [(int(whole[i]), small[at[i] : min(at[i + 1], at[i] + SIZE)]) for i in range(len(rows))]


def likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    """Share of names in common, 0 to 1; two empty texts are alike."""
    if a[0] == b[0]:
        return 1.0
    x, y = a[1], b[1]
    both = np.union1d(x, y)
    if max(len(x), len(y)) >= SIZE:
        both = both[:SIZE]
    if not len(both):
        return 0.0
    common = np.intersect1d(x, y, assume_unique=True)
    return float(np.count_nonzero(common <= both[-1])) / len(both)


def shown(sketch: tuple[int, np.ndarray]) -> str:
    return f"{sketch[0]:016x}" + sketch[1].astype(">u4").tobytes().hex()


def edited(text: str, after: str) -> str:
    """The text with its last quarter replaced by as much of the start of the next one."""
    cut = len(text) // 4
    return text[: len(text) - cut] + after[:cut]


def compare(docs: DataFrame, text: str = "text", key: str = "doc_id", per_bucket: int = 2048) -> DataFrame:
    """One row per row of ``docs``: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is that of the next key in ascending order, after the last the first; null keys come first, and
    rows with equal keys follow one another in a fixed order. A null text is the empty text. An only document is its
    own next one. Keys are dealt into ranges, whose bounds are keys of the table; each range also gets the rows of the
    next bound. Texts cross that shuffle compressed, once.
    """
    from pyspark.sql.types import BinaryType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructType

    ids = docs.select(key)
    n = ids.count()
    schema = StructType([docs.schema[key]]).add("n_chars", LongType())
    for name in ("edited_sha256", "fingerprint", "edited_fingerprint"):
        schema = schema.add(name, StringType())
    schema = schema.add("near_edited", DoubleType()).add("near_next", DoubleType())
    least = -(1 << 63)
    buckets = min(max(1, -(-n // per_bucket)), RANGES)
    draw = F.pmod(F.xxhash64(key), F.lit(max(1, n // (buckets * STEP)))) == 0
    sample = sorted({least if r[0] is None else r[0] for r in ids.where(draw).collect()})
    lowest = ids.agg(F.min(key), F.count_if(F.col(key).isNull())).first()
    start = least if lowest[1] else lowest[0]
    every = max(1, len(sample) // buckets)
    bounds = np.array(sorted({start if start is not None else least, *sample[every::every]}), np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            order = np.array([least if k is None else k for k in batch.column(0).to_pylist()], np.int64)
            payload = pa.array([squeeze.compress(x.encode() if x else b"") for x in batch.column(1).to_pylist()], pa.binary())
            home = (np.searchsorted(bounds, order, "right") - 1).astype(np.int32)
            guest = np.flatnonzero(bounds[home] == order)
            take = pa.array(np.concatenate([np.arange(len(order)), guest]))
            bucket = np.concatenate([home, (home[guest] - 1) % len(bounds)]).astype(np.int32)
            late = np.concatenate([np.zeros(len(order), bool), np.ones(len(guest), bool)])
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(late), batch.column(0).take(take), payload.take(take)], ["bucket", "late", key, "payload"])

    dealt = docs.select(key, text).mapInArrow(tidy(deal), StructType().add("bucket", IntegerType()).add("late", BooleanType()).add(docs.schema[key]).add("payload", BinaryType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        open_up = zstandard.ZstdDecompressor()

        def made(rows: list[tuple], before: tuple | None) -> tuple[list[tuple], tuple]:
            """Results for pairs of neighbours in rows; ``before`` is the first row's sketch if known."""
            own = [before] if before else sketches([rows[0][3]])
            own += sketches([r[3] for r in rows[1:]])
            pairs = [i for i in range(len(rows) - 1) if rows[i][0] == rows[i + 1][0] and not rows[i][1]]
            changed = [edited(rows[i][3], rows[i + 1][3]) for i in pairs]
            out = []
            for i, text, other in zip(pairs, changed, sketches(changed), strict=True):
                out.append((rows[i][2], len(rows[i][3]), hashlib.sha256(text.encode()).hexdigest(), shown(own[i]), shown(other), likeness(own[i], other), likeness(own[i], own[i + 1])))
            return out, own[-1]

        rows: list[tuple] = []
        size, before, kind = 0, None, None
        for batch in batches:
            kind = batch.column(2).type
            for bucket, late, k, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.append((bucket, late, k, open_up.decompress(payload).decode()))
                size += len(rows[-1][3])
                if size >= CHUNK and len(rows) > 1:
                    got, before = made(rows, before)
                    rows, size = rows[-1:], 0
                    if got:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), [kind, pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2], strict=True)], schema.names)
        if len(rows) > 1:
            got, _ = made(rows, before)
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), [kind, pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2], strict=True)], schema.names)

    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return dealt.repartition(max(parts, min(len(bounds), 4 * parts)), "bucket").sortWithinPartitions("bucket", "late", key, "payload").mapInArrow(tidy(run), schema)
