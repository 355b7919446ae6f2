"""Near-duplicate embeddings by NN-descent.

Vectors are compared within a label only. Equal vectors form one class, whose smallest vec_id
stands for it. Then

1. Start: for each of `orders` random rotations, vectors are sorted by label and the signs of their
   projections, and consecutive blocks of `block` are compared: every vector has its best `k`.
2. Descent, `rounds` times: lists are made mutual, every vector is sent to its neighbours, and what
   meets at a neighbour is compared: neighbours of neighbours. Long meetings are cut into blocks.
   Lists keep the best `k` and the first `k` by id at the threshold or above it.
3. audit() measures the recall of links against brute force for a twentieth of the vectors, by a hash of
   their ids, in blocks, and logs it. While it is below `recall`, k doubles and the descent goes on, three
   times. Where the hash takes no vector at all, nothing is measured, and the audit doesn't pass.
4. Saturated vectors, with `k` links or more, may have more links than a list holds. They are
   compared with all rows of their label, dealt as tiles of `tile` rows by `tile` columns: counts
   of both ends and pairs of components that a link joins leave a tile. If the audit never
   passes, all vectors are compared so.

Cosines are taken in double precision. Nulls: a null label, and a vector that is null, zero, or has
null or non-finite components or another length than its block's, links with nothing. A null vec_id
is never linked; its component_id is null and it is kept. Repeated rows come out once each; rows of
one vec_id are one node. Extra columns are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

EDGE = "a long, b long, c double"


def _unit(rows: list) -> np.ndarray:
    x = np.array([np.frombuffer(r, np.float64) for r in rows])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _best(ids: np.ndarray, x: np.ndarray, k: int, least: float) -> tuple[np.ndarray, ...]:
    """(a, b, cosine): each row's best k others, and its first k by id at least or above; ids are sorted."""
    s = x @ x.T
    np.fill_diagonal(s, -2)
    n = len(ids)
    keep = s >= least
    keep &= np.cumsum(keep, axis=1) <= k
    if n > 1:
        top = np.argpartition(-s, min(k, n - 1) - 1, axis=1)[:, : min(k, n - 1)]
        np.put_along_axis(keep, top, True, 1)
    np.fill_diagonal(keep, False)
    a, b = np.nonzero(keep)
    other = ids[a] != ids[b]
    return ids[a][other], ids[b][other], s[a, b][other]


def _edges(a: list, b: list, c: list) -> pa.RecordBatch:
    cat = lambda x, kind: pa.array(np.concatenate(x) if x else np.zeros(0), kind)
    return pa.RecordBatch.from_arrays([cat(a, pa.int64()), cat(b, pa.int64()), cat(c, pa.float64())], names=["a", "b", "c"])


def _compare(dealt: DataFrame, keys: int, block: int, k: int, least: float) -> DataFrame:
    """Edges among neighbours in dealt (keys..., id, v), sorted by its keys in each partition: rows of equal keys are cut into blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[list] = [[], [], []]

        def flush() -> None:
            ids = np.array([r[-2] for r in held], np.int64)
            ids, once = np.unique(ids, return_index=True)
            if len(ids) > 1:
                for to, x in zip(out, _best(ids, _unit([held[i][-1] for i in once]), k, least), strict=True):
                    to.append(x)
            held.clear()

        for batch in batches:
            for row in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if held and (held[-1][:keys] != row[:keys] or len(held) >= block or len(held[-1][-1]) != len(row[-1])):
                    flush()
                held.append(row)
            if sum(map(len, out[0])) > 50_000:
                yield _edges(*out)
                out = [[], [], []]
        if held:
            flush()
        yield _edges(*out)

    return dealt.mapInArrow(run, EDGE)


def _trim(edges: DataFrame, k: int, least: float) -> DataFrame:
    """Mutual lists (id, near array<struct<c,b>>, links): the best k of each, and the first k by id at least or above.

    links is how many at least or above were seen; below k, the list has them all. The first by id
    tie a dense group to the same few vectors, so that its lists stay connected.
    """
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "c"))
    once = both.groupBy("a", "b").agg(F.max("c").alias("c"))
    near = once.groupBy(F.col("a").alias("id")).agg(F.reverse(F.array_sort(F.collect_list(F.struct("c", "b")))).alias("all"))
    near = near.withColumn("good", F.filter("all", lambda x: x["c"] >= least))
    first = F.transform(F.slice(F.array_sort(F.transform("good", lambda x: F.struct(x["b"].alias("b"), x["c"].alias("c")))), 1, k), lambda x: F.struct(x["c"].alias("c"), x["b"].alias("b")))
    return near.select("id", F.array_union(F.slice("all", 1, k), first).alias("near"), F.size("good").alias("links"))


def neighbours(v: DataFrame, least: float, k: int, rounds: int, orders: int, block: int, seed: int, start: DataFrame | None = None) -> DataFrame:
    """Lists (id, near, links) for v (id, label, v binary of doubles)."""
    width = C.shuffle_width(v.sparkSession)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(2).to_pylist()
            keys = np.zeros((len(rows), orders), np.uint64)
            for size in {len(r) for r in rows}:
                at = [i for i, r in enumerate(rows) if len(r) == size]
                x = _unit([rows[i] for i in at])
                for o in range(orders):
                    planes = np.random.default_rng([seed, o, size]).standard_normal((size // 8, 62))
                    keys[at, o] = ((x @ planes) > 0).astype(np.uint64) @ (np.uint64(1) << np.arange(62, dtype=np.uint64)[::-1])
            for o in range(orders):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), o, np.int32)), batch.column(1), pa.array(keys[:, o].astype(np.int64)), batch.column(0), batch.column(2)], names=["o", "label", "key", "id", "v"])

    edges = start
    if edges is None:
        placed = v.mapInArrow(place, "o int, label string, key long, id long, v binary")
        dealt = placed.repartitionByRange(width, "o", "label", "key", "id").sortWithinPartitions("o", "label", "key", "id").select("o", "label", "id", "v")
        edges = C.materialize(_compare(dealt, 2, block, k, least))
    lists = C.materialize(_trim(edges, k, least))
    for turn in range(rounds):
        # every vector goes to its best k neighbours, and to itself
        sent = lists.select("id", F.explode(F.concat(F.array("id"), F.slice("near.b", 1, k))).alias("at"))
        # k and turn salt the order, so that other members share a block in each round
        dealt = sent.join(v.select("id", "v"), "id").repartition(width, "at").sortWithinPartitions("at", F.xxhash64("id", F.lit(seed), F.lit(k), F.lit(turn))).select("at", "id", "v")
        fresh = _compare(dealt, 1, block, k, least)
        old = lists.select(F.col("id").alias("a"), F.explode("near").alias("x")).select("a", "x.b", "x.c")
        lists = C.materialize(_trim(fresh.union(old), k, least))
    return lists


def audit(v: DataFrame, lists: DataFrame, least: float, k: int, tile: int = 512) -> tuple[int, int, int]:
    """(vectors audited, links found, links there are) of a twentieth of the vectors, by a hash of their ids, against all rows of their label in tiles.

    A saturated vector, of k links or more, counts as found: it is compared with its whole label later.
    """
    every = v.select("id", "label", "v", F.lit(1).cast("long").alias("weight"), F.lit(0).cast("long").alias("node"), F.lit(True).alias("full"))
    audited = every.where(F.pmod(F.xxhash64("id", F.lit(20)), F.lit(20)) == 0)
    there = _tiles(audited, every, least, tile).groupBy("id").agg(F.sum("links").alias("links"))
    seen = there.withColumnRenamed("links", "there").join(lists.select("id", "links"), "id", "left")
    row = seen.agg(F.coalesce(F.sum(F.when(F.col("links") >= k, F.col("there")).otherwise(F.least("links", "there"))), F.lit(0)), F.coalesce(F.sum("there"), F.lit(0))).first()
    return audited.count(), row[0], row[1]


def _tiles(rows: DataFrame, columns: DataFrame, least: float, tile: int) -> DataFrame:
    """Rows against columns (both id, label, v, weight, node, full) of their label, itself left out.

    (id, links): weights of the columns at least so near to a row, and of the rows so near to a
    column that is not full, to be summed by id. (a, b), with a null id: nodes of a row and a
    column so near, if they differ. Rows and columns of a label are dealt by hash into parts of
    about tile, and every pair of parts is a task's group.
    """
    n = columns.groupBy("label").agg(F.count(F.lit(1)).alias("n")).select("label", F.ceil(F.col("n") / tile).cast("int").alias("q"))
    m = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).select("label", F.ceil(F.col("n") / tile).cast("int").alias("p"))
    grid = n.join(m, "label")
    part = lambda of: F.pmod(F.xxhash64("id"), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    held = ["id", "v", "weight", "node", "full"]
    l = rows.join(grid, "label").select("label", part("p").alias("i"), "q", *held).select("label", "i", every("q").alias("j"), F.lit(0).alias("side"), *held)
    r = columns.join(grid, "label").select("label", "p", part("q").alias("j"), *held).select("label", every("p").alias("i"), "j", F.lit(1).alias("side"), *held)
    dealt = l.union(r).repartition(C.shuffle_width(rows.sparkSession), "label", "i", "j").sortWithinPartitions("label", "i", "j", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def count() -> Iterator[pa.RecordBatch]:
            for size in {len(r[5]) for r in held}:
                a, b = ([r for r in held if r[3] == side and len(r[5]) == size] for side in (0, 1))
                if a and b:
                    (ids, w, own), (cols, u, other) = (np.array([(r[4], r[6], r[7]) for r in x], np.int64).T for x in (a, b))
                    near = (_unit([r[5] for r in a]) @ _unit([r[5] for r in b]).T >= least) & (ids[:, None] != cols[None, :])
                    links = np.concatenate((near @ u, w @ near))
                    told = np.concatenate((np.ones(len(ids), bool), ~np.array([r[8] for r in b]) & near.any(axis=0)))
                    i, j = np.nonzero(near & (own[:, None] != other[None, :]))
                    pairs = np.unique(np.stack((own[i], other[j]), axis=1), axis=0)
                    none = lambda k: pa.nulls(k, pa.int64())
                    at = np.concatenate((ids, cols))[told]
                    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(links[told]), none(len(at)), none(len(at))], names=["id", "links", "a", "b"])
                    yield pa.RecordBatch.from_arrays([none(len(pairs)), none(len(pairs)), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["id", "links", "a", "b"])

        for batch in batches:
            for row in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if held and held[-1][:3] != row[:3]:
                    yield from count()
                    held.clear()
                held.append(row)
        if held:
            yield from count()

    return dealt.mapInArrow(run, "id long, links long, a long, b long")


def near_vectors(vectors: DataFrame, least: float = 0.93, k: int = 16, rounds: int = 2, orders: int = 4, block: int = 128, tile: int = 512, recall: float = 0.98, seed: int = 5) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    C.prepare(spark)
    x = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"), F.col("label").cast("string").alias("label"))
    fine = F.coalesce(F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("e", lambda c: c != 0), F.lit(False))
    sound = fine & F.col("vec_id").isNotNull() & F.col("label").isNotNull()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [np.array(e, np.float64) for e in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([(e / np.abs(e).max()).tobytes() for e in packed], pa.binary())], names=["vec_id", "label", "v"])

    packed = C.materialize(x.where(sound).select("vec_id", "label", "e").mapInArrow(pack, "vec_id long, label string, v binary"))
    classes = packed.groupBy("label", "v").agg(F.min("vec_id").alias("id"), F.count_distinct("vec_id").alias("weight"))
    v = C.materialize(classes.select("id", "label", "v", "weight"))
    lists = neighbours(v, least, k, rounds, orders, block, seed)
    for turn in range(4):
        audited, found, there = audit(v, lists, least, k, tile)
        passed = audited > 0 and found >= recall * there
        logging.getLogger(__name__).info("k %d: %d of %d links of %d audited vectors found", k, found, there, audited)
        if passed or turn == 3 or not audited:
            break
        k *= 2
        start = lists.select(F.col("id").alias("a"), F.explode("near").alias("x")).select("a", "x.b", "x.c")
        lists = neighbours(v, least, k, 1, orders, block, seed, C.materialize(start))

    edges = lists.select(F.col("id").alias("a"), F.explode("near").alias("x")).where(F.col("x.c") >= least).select("a", "x.b")
    edges = C.materialize(edges)
    # a saturated list may go on: compare with all of its label; all vectors where the audit didn't pass
    full = lists.select("id", (F.col("links") >= k).alias("full"))
    placed = v.join(C.components(edges).withColumnRenamed("node", "id"), "id", "left").join(full, "id", "left")
    placed = C.materialize(placed.select("id", "label", "v", "weight", F.coalesce("component", "id").alias("node"), (F.coalesce("full", F.lit(False)) | F.lit(not passed)).alias("full")))
    tiles = C.materialize(_tiles(placed.where("full"), placed, least, tile))
    more = tiles.where("id is not null").groupBy("id").agg(F.sum("links").alias("more"))
    joined = C.components(tiles.where("a is not null").select("a", "b").distinct())
    direct = edges.join(placed.where("not full").select(F.col("id").alias("b"), "weight"), "b").groupBy(F.col("a").alias("id")).agg(F.sum("weight").alias("direct"))
    node = placed.join(direct, "id", "left").join(more, "id", "left").join(joined, "node", "left")
    links = F.coalesce("more", F.lit(0)) + F.when(F.col("full"), 0).otherwise(F.coalesce("direct", F.lit(0)))
    node = node.select("label", "v", (links + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    linked = packed.join(node, ["label", "v"]).select("vec_id", "n_links", "component_id").groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = x.select("vec_id").join(linked, "vec_id", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
