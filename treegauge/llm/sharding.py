"""Range partitioning of documents into shards of near equal bytes by sampled splitters.

A row's key has 40 bits of a hash of its text and 24 of its doc_id, so equal texts are neighbours: a
group. Splitters are keys sampled with probability in proportion to size; the exact sizes of the
ranges between them give the ranges in which the shards' quantiles fall. Those are sampled again,
and so on, until a quantile is met within `slack` of a shard, or lies inside one group. A group is
overfull if it alone is larger than a shard: then it is subdivided by doc_id. Any other group stays in
one shard. Groups of more than `heavy` of a shard, of which there are at most shards / heavy, are dealt first,
the largest to the emptiest shard; the quantiles of all others are what each shard then lacks. So the
sizes of shards are near equal, off by half of a group that isn't heavy, unless heavy groups alone can't be dealt so.

Each round brings at most about 2 * `samples` keys and sizes to the driver; samples follow the input's
size, from 1,024 to 65,536, so that a range stays one task's work.
Slots are counted within ranges, also inside large groups, whose counts are then added up: no task
numbers a whole shard.

Nulls: a null text has size 1; a null doc_id hashes like any value. Equal rows are neighbours and
come out once each. Ties of key, doc_id, text and size are numbered in any order. Extra columns stay; one with the name of a result (size, text_crc32, shard, slot)
gets a _ behind. A very long text is one row of one task. Shards may be empty if there are few rows
or groups. An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from heapq import heappop, heappush

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, unpacked

LOW = (1 << 24) - 1


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def crc_of(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def key_of(doc_id: Column, text: Column) -> Column:
    h = F.xxhash64(F.coalesce(text, F.lit("")))
    return h.bitwiseAND(F.lit(~LOW)).bitwiseOR(F.xxhash64(doc_id).bitwiseAND(F.lit(LOW)))


def place(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most key, by binary search in a constant array."""
    if not bounds:
        return F.lit(0)
    held = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    top = 1 << (len(bounds).bit_length() - 1)
    steps = [top >> i for i in range(top.bit_length())]
    found = F.aggregate(F.array(*map(F.lit, steps)), F.struct(key.alias("k"), F.lit(0).alias("p")), lambda acc, s: F.struct(acc["k"].alias("k"), F.when(F.coalesce(F.get(held, acc["p"] + s - 1) <= acc["k"], F.lit(False)), acc["p"] + s).otherwise(acc["p"]).alias("p")))
    return found["p"]


def _sampled(light: DataFrame, total: int, samples: int, turn: int) -> list[int]:
    drawn = F.pmod(F.xxhash64(F.lit(turn), "key", "size"), F.lit(1 << 40)) < F.least(F.lit(1.0), F.lit(float(samples)) / F.lit(float(max(1, total))) * F.col("size")) * F.lit(float(1 << 40))
    return [r[0] for r in light.where(drawn).select("key").distinct().collect()]


def drawn_for(docs: DataFrame) -> int:
    """A sample for each 256 MB that the plan is estimated to read, within bounds."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return min(65_536, max(1024, size >> 28))


def dealt(groups: list[tuple[int, int]], shards: int) -> tuple[dict[int, int], list[int]]:
    """Shards of groups (group, size), the largest to the emptiest, and the sizes that they have then."""
    load, of = [(0, s) for s in range(shards)], {}
    for g, size in sorted(groups, key=lambda x: (-x[1], x[0])):
        n, s = heappop(load)
        of[g] = s
        heappush(load, (n + size, s))
    return of, [n for n, _ in sorted(load, key=lambda x: x[1])]


def aims_of(held: list[int], rest: int) -> list[float]:
    """Where shards end in the rest, so that with what they hold they come as near to one size as can be."""
    level, over = 0.0, sorted(held)
    for i in range(len(over)):
        level = (sum(over[: i + 1]) + rest) / (i + 1)
        if i + 1 == len(over) or level <= over[i + 1]:
            break
    out, run = [], 0.0
    for h in held[:-1]:
        run += max(0.0, level - h)
        out.append(run)
    return out


def splitters(light: DataFrame, aims: list[float], total: int, shard_size: float, samples: int = 1024, slack: float = 0.001) -> tuple[list[int], list[int]]:
    """For light (key, size) of a total size: the lowest keys from the aims on, and all bounds that were drawn."""
    if not total:
        return [], []
    group = F.col("key").bitwiseAND(F.lit(~LOW))
    inside, inside_size, bounds, split = light, total, set(), set()
    for turn in range(60):
        # bounds are the first keys of groups, but inside a group that is to be split
        bounds |= {k if k & ~LOW in split else k & ~LOW for k in _sampled(inside, inside_size, samples, turn)}
        order = sorted(bounds)
        sizes = {r[0]: r[1] for r in light.groupBy(place(F.col("key"), order).alias("p")).agg(F.sum("size")).collect()}
        edges, run = [], 0  # edges[i]: the size below order[i]
        for i in range(len(order)):
            run += sizes.get(i, 0)
            edges.append(run)
        cut, wide = [], set()
        for aim in aims:
            i = bisect_left(edges, aim)
            near = min((j for j in (i - 1, i) if 0 <= j < len(order)), key=lambda j: abs(edges[j] - aim), default=None)
            cut.append(None if near is None else order[near])
            if near is None or abs(edges[near] - aim) > slack * shard_size:
                wide.add(i)
        # a range of one key, or of one group that isn't overfull, can't be cut
        lows, highs = (lambda i: order[i - 1] if i else -(1 << 63)), (lambda i: order[i] if i < len(order) else 1 << 63)
        wide = {i for i in wide if highs(i) - lows(i) > (1 if lows(i) & ~LOW in split else LOW + 1)}
        if not wide:
            return [order[0] if c is None else c for c in cut] if order else [], order
        inside = light.withColumn("p", place(F.col("key"), order)).where(F.col("p").isin(*wide))
        inside_size = sum(sizes.get(i, 0) for i in wide) or 1
        if turn >= 2:
            # the largest group of each range that is left gets bounds of its own, and is split if overfull
            top = inside.groupBy("p", group.alias("g")).agg(F.sum("size").alias("s"), F.min("key").alias("a"), F.max("key").alias("b"))
            for r in top.groupBy("p").agg(F.max(F.struct("s", "g", "a", "b")).alias("x")).select("x.*").collect():
                bounds |= {r["g"], min(r["g"] + LOW + 1, (1 << 63) - 1)}
                if r["a"] == r["b"]:  # one key
                    bounds |= {r["a"], min(r["b"] + 1, (1 << 63) - 1)}
                if r["s"] > shard_size:
                    split.add(r["g"])
    raise RuntimeError("splitters did not settle")


def sharded(docs: DataFrame, shards: int = 8, keep: tuple[str, ...] | None = None, samples: int | None = None, heavy: float = 0.01) -> DataFrame:
    """keep (default: all columns) of each row with size, text_crc32, shard from 0, and slot, gapless from 0 in its shard."""
    kept = docs if keep is None else docs.select(*keep)
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept.columns]).alias("row_"), F.col("doc_id"), size_of(F.col("text")).alias("size"), crc_of(F.col("text")).alias("text_crc32"), key_of(F.col("doc_id"), F.col("text")).alias("key"))
    samples = samples or drawn_for(docs)
    light = materialize(keyed.select("key", "size"))
    total = light.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    mean, group = total / shards, F.col("key").bitwiseAND(F.lit(~LOW))
    large = light.groupBy(group.alias("group")).agg(F.sum("size").alias("s")).where((F.col("s") > heavy * mean) & (F.col("s") <= mean))
    of, held = dealt([(r[0], r[1]) for r in large.collect()], shards)
    # at most shards / heavy rows
    fixed = F.broadcast(docs.sparkSession.createDataFrame(list(of.items()), "group long, fixed int"))
    others = light.join(fixed, group == F.col("group"), "left_anti") if of else light
    cuts, bounds = splitters(others, aims_of(held, total - sum(held)), total - sum(held), mean, samples)
    # slots are counted in finer ranges, which large groups share too
    finer = _sampled(light, total, samples, -1)
    bounds = sorted({*bounds, *cuts, *finer})

    def spot(df: DataFrame) -> DataFrame:
        df = df.withColumn("range", place(F.col("key"), bounds)).withColumn("shard", place(F.col("key"), cuts))
        return df.join(fixed, group == F.col("group"), "left").withColumn("shard", F.coalesce("fixed", "shard")).drop("group", "fixed") if of else df

    counts = spot(light).groupBy("shard", "range").agg(F.count(F.lit(1)).alias("n"))
    base = counts.select("shard", "range", (F.sum("n").over(Window.partitionBy("shard").orderBy("range")) - F.col("n")).alias("base"))
    # a row for each range at most: as many as there are bounds
    out = spot(keyed).withColumn("n", F.row_number().over(Window.partitionBy("shard", "range").orderBy("key", "doc_id", "text_crc32", "size")))
    out = out.join(F.broadcast(base), ["shard", "range"])
    return out.select(*unpacked(kept, ("size", "text_crc32", "shard", "slot")), "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("base") + F.col("n") - 1).cast("long").alias("slot"))
