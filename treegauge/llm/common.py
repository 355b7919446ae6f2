"""What the corpus operators share: scratch tables, byte-level text kernels, components.

The kernels work on the UTF-8 buffers of Arrow string columns, so no Python string is made
for a text, and in pieces of bounded size, so that a worker's memory doesn't follow its batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treegauge.scratch import forget, met
from treegauge.scratch import written as materialize
from treegauge.workers import ship

#: Bytes of text a kernel handles at once; a longer text is handled alone.
PIECE = 1 << 20
#: Rows in an Arrow batch of texts or of packed arrays.
BATCH_ROWS = 1000

U64 = np.uint64
_C1, _C2 = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)
ODD = U64(0xD6E8FEB86659FD93)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """For operators with Python workers: Arrow batches of so many rows at most, and this package on every worker's path.

    The setting is read when a result is computed, so it stays lowered for the session; a lower one is left alone.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))
    ship(spark)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of input for which a task that holds a partition is made, and above which a plan's own estimate counts as unknown.
SHARE, UNKNOWN = 64 << 20, 1 << 50


def width_of(docs: DataFrame, share: int = SHARE) -> int:
    """Partitions for tasks that hold one in memory: they follow the size that docs' plan is estimated to read, and are never fewer than the session's.

    So what such a task holds doesn't grow with the input, whatever the session's number is.
    """
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(shuffle_width(docs.sparkSession), size // share if size < UNKNOWN else 0)


def kept_names(columns: list[str], added: tuple[str, ...]) -> list[str]:
    """Names for the columns of an input beside added ones: where they clash, those of the input get a _ behind."""
    taken, out = {x.lower() for x in added}, []
    for c in columns:
        while c.lower() in taken:
            c += "_"
        taken.add(c.lower())
        out.append(c)
    return out


def row_of(docs: DataFrame) -> Column:
    """A whole row as one struct column, so that no column of it meets an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_")


def unpacked(docs: DataFrame, added: tuple[str, ...]) -> list[Column]:
    """The columns of row_of(docs) beside added ones; see kept_names."""
    return [F.col("row_")[c].alias(name) for c, name in zip(docs.columns, kept_names(docs.columns, added), strict=True)]


# ---- byte kernels -------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(32))) * _C1
    x = (x ^ (x >> U64(29))) * _C2
    return x ^ (x >> U64(32))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string or binary column; null counts as empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def pieces(offsets: np.ndarray, cap: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most cap bytes, or of one row."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + cap, "right")) - 1)
        yield at, to
        at = to


_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """ODD**j and its inverse modulo 2**64 for j < n at least."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, PIECE + 64)  # those of a longer text aren't kept
        inverse = U64(pow(int(ODD), -1, 1 << 64))
        both = []
        for base in (ODD, inverse):
            p = np.full(size, base, U64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        if size > PIECE + 64:
            return both[0], both[1]
        _POWERS[:] = both
    return _POWERS[0], _POWERS[1]


BYTE_CODES = mix(np.arange(1, 257, dtype=U64) * _C2)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    """Running sums of codes[j] * ODD**j with a leading 0; see span_hash."""
    out = np.zeros(len(codes) + 1, U64)
    np.cumsum(codes * powers(len(codes))[0][: len(codes)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the codes in [start, end) that doesn't depend on where they stand."""
    inverse = powers(len(sums))[1]
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U64))


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the space-separated words, A-Z lower-cased, and the row of each."""
    if not len(raw):
        return np.zeros(0, U64), np.zeros(0, np.int64)
    inside = ~SPACE[raw]
    cut = np.zeros(len(raw) + 1, bool)
    cut[offsets] = True
    before = np.concatenate(([False], inside[:-1])) & ~cut[:-1]
    after = np.concatenate((inside[1:], [False])) & ~cut[1:]
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    h = span_hash(prefix_sums(BYTE_CODES[LOWER[raw]]), starts, ends)
    return h, np.searchsorted(offsets, starts, "right") - 1


def shingles(raw: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words in the order of the rows, and each row's count of runs.

    A row of fewer words, but not none, has its whole sequence as its one run.
    """
    h, row = words(raw, offsets)
    rows = len(offsets) - 1
    count = np.bincount(row, minlength=rows)
    first = np.concatenate(([0], np.cumsum(count)))[:-1]
    acc = h.copy()
    short: dict[int, np.ndarray] = {}
    for t in range(1, n):
        at = first[count == t]
        short[t] = mix(acc[at] + U64(t))
        acc = acc[: max(0, len(h) - t)]
        acc = mix(acc * ODD + h[t : t + len(acc)]) if len(acc) else acc
    whole = row[: len(acc)] == row[n - 1 : n - 1 + len(acc)] if len(acc) else np.zeros(0, bool)
    value, owner = [acc[whole]], [row[: len(acc)][whole]]
    for t, x in short.items():
        value.append(x)
        owner.append(np.flatnonzero(count == t))
    value, owner = np.concatenate(value), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return value[order], np.bincount(owner, minlength=rows)


def pack(**x: np.ndarray) -> bytes:
    """One binary of several arrays, so that a shuffle moves few large rows."""
    head = np.array([len(v.tobytes()) for v in x.values()], np.int64)
    return head.tobytes() + b"".join(v.tobytes() for v in x.values())


def unpack(b: bytes, *kinds: type) -> list[np.ndarray]:
    size = np.frombuffer(b, np.int64, len(kinds))
    at, out = 8 * len(kinds), []
    for k, n in zip(kinds, size, strict=True):
        out.append(np.frombuffer(b, k, int(n) // np.dtype(k).itemsize, at))
        at += int(n)
    return out


def by_row(ids: np.ndarray, docs: np.ndarray, values: np.ndarray, names: tuple[str, str, str]) -> Iterator[pa.RecordBatch]:
    """A row for each distinct (id, doc) with the bytes of its values, in their order."""
    order = np.lexsort((docs, ids))
    ids, docs, values = ids[order], docs[order], np.ascontiguousarray(values[order])
    heads = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (docs[1:] != docs[:-1])))) if len(ids) else np.zeros(0, np.int64)
    ends = np.append(heads[1:], len(ids))
    width = values.itemsize * (values.shape[1] if values.ndim > 1 else 1)
    for lo in range(0, len(heads), BATCH_ROWS):
        a, b = heads[lo : lo + BATCH_ROWS], ends[lo : lo + BATCH_ROWS]
        off = np.append(a, b[-1:]).astype(np.int64) - a[0]
        data = pa.py_buffer(values[a[0] : b[-1]].tobytes())
        blobs = pa.Array.from_buffers(pa.large_binary(), len(a), [None, pa.py_buffer((off * width).tobytes()), data]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(docs[a]), blobs], names=list(names))


# ---- components ---------------------------------------------------------------------------


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of links (a, b): component is the smallest node reachable.

    Labels spread along links and then jump to their own label's label, so the rounds follow the
    logarithm of the longest path. Each round's labels are written to the shared folder; the loop
    reads back one count a round, never links or labels, and the labels of the round before are deleted.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
    both = materialize(both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).select("a", "b"))
    label = held = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")))
    for turn in range(rounds):
        near = both.join(met(label).select(F.col("node").alias("b"), "component"), "b").select(F.col("a").alias("node"), "component", F.lit(None).cast("long").alias("was"))
        every = near.union(label.select("node", "component", F.col("component").alias("was")))
        nxt = every.groupBy("node").agg(F.min("component").alias("component"), F.max("was").alias("was"))
        if turn > 1:  # short paths have settled; long ones are halved
            hop = nxt.select(F.col("node").alias("component"), F.col("component").alias("far"))
            nxt = nxt.join(met(hop), "component", "left").select("node", F.least("component", F.coalesce("far", "component")).alias("component"), "was")
        nxt = materialize(nxt.select("node", "component", "was"))
        forget(held)
        held = nxt
        label, changed = nxt.select("node", "component"), nxt.where("was <> component").limit(1).count()
        if not changed:
            forget(both)
            return label
    raise RuntimeError("components did not settle")
