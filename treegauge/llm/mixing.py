"""Mixing sources to target weights by temperature, in DataFrame functions only.

A source's share p of all tokens is raised to an exponent and normalised: w ~ p ** a. Bisection,
`WAYS` steps at a time in one aggregate over the table of sources, finds the largest exponent in
[0, 1] whose weights reach `entropy` (a part of the greatest entropy possible) and the least one
whose repetition stays within `max_repeats`; the greater of both is taken, so the repetition limit holds where they conflict. The budget is `budget` tokens, or else
the smallest that shows every source once at least, so that no document is lost.

A source of weight w gets w * budget tokens as blocks: so many whole permutations of its documents
as fit, then the head of one more permutation, up to the tokens left. The cut in that permutation
is found from sums over 4096 ranges of its keys and one window over the range that it falls in,
so that no task sorts a whole source.

Nulls: a null source is a source of its own; a null text has no tokens; documents without tokens
stay in whole blocks and in the partial block if their key is below its cut. Equal rows have equal
keys and are taken together. Extra columns stay; one with the name of a result (source_weight,
copies, block, place_key) gets a _ behind. A very long text is one row of one task. An empty table
gives an empty result.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, row_of, unpacked

#: Exponents that one aggregate tries, and how near the bisection comes.
WAYS, NEAR = 32, 2.0**-60
#: A row a source is broadcast up to so many sources, else joined.
BROADCAST_SOURCES = 100_000


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_of(source: Column) -> Column:
    return F.coalesce(source.cast("string"), F.lit("\x00"))


def permuted(seed: int, block: int | Column) -> Column:
    """Where a row stands in a block: the order of a pseudo-random key."""
    return F.xxhash64(F.lit(seed), block if isinstance(block, Column) else F.lit(block).cast("long"), F.col("doc_id"), F.col("text"))


def exponent(sources: DataFrame, entropy: float, max_repeats: float, budget: float | None) -> dict:
    """{a, z, budget, total, n} for a table of sources (source, tokens): exponent, norm, tokens to give out.

    What reaches the driver is two sums for each exponent that is tried, however many sources there are.
    """
    some = sources.where("tokens > 0")
    one = some.agg(F.sum("tokens").alias("total"), F.count(F.lit(1)).alias("n"), F.min("tokens").alias("least"), F.max("tokens").alias("most")).first()
    if not one["n"]:
        return {"a": 1.0, "z": 1.0, "total": 0, "n": 0, "budget": 0.0}
    total, n, least, most = (float(one[c]) for c in ("total", "n", "least", "most"))
    p = F.col("tokens") / F.lit(total)

    def norms(tried: list[float]) -> list[tuple[float, float]]:
        """(sum of p ** a, sum of p ** a * log p) for each exponent."""
        # the exponents are rows, so that every turn has the same plan
        each = some.select(p.alias("p"), F.explode(F.array(*map(F.lit, sorted(set(tried))))).alias("a")).groupBy("a").agg(F.sum(F.pow("p", "a")).alias("z"), F.sum(F.pow("p", "a") * F.log("p")).alias("s"))
        got = {r["a"]: (r["z"], r["s"]) for r in each.collect()}
        return [got[a] for a in tried]

    def spread(a: float, z: float, s: float) -> bool:
        return log(z) - a * s / z >= entropy * log(n) - 1e-12

    def repeats(a: float, z: float) -> bool:
        # of a source with share x: x ** a / z * budget / (x * total); the most is at the least share
        if budget is None:
            return (most / least) ** (1 - a) <= max_repeats * (1 + 1e-12)
        return (least / total) ** (a - 1) / z * budget <= max_repeats * total * (1 + 1e-12)

    # spread holds below an exponent, repeats above one; both ends are looked for at once
    lows, highs = [0.0, 0.0], [1.0, 1.0]
    ends = norms([0.0, 1.0])
    open_ = [not spread(1.0, *ends[1]), not repeats(0.0, ends[0][0])]
    found = [1.0, 0.0]
    while any(o and highs[i] - lows[i] > NEAR for i, o in enumerate(open_)):
        tried = [lows[i] + (highs[i] - lows[i]) * k / (WAYS + 1) for i in (0, 1) for k in range(1, WAYS + 1)]
        sums = norms(tried)
        for i in (0, 1):
            good = [spread(a, z, s) if i == 0 else not repeats(a, z) for a, (z, s) in zip(tried[i * WAYS : (i + 1) * WAYS], sums[i * WAYS : (i + 1) * WAYS], strict=True)]
            k = good.index(False) if False in good else WAYS
            step = (highs[i] - lows[i]) / (WAYS + 1)
            was = lows[i], highs[i]
            lows[i], highs[i] = lows[i] + step * k, lows[i] + step * (k + 1)
            if (lows[i], highs[i]) == was:  # no number lies between
                open_[i], found[i] = False, (lows if i == 0 else highs)[i]
    for i, o in enumerate(open_):
        if o:
            found[i] = (lows if i == 0 else highs)[i]
    a = max(found)
    z = norms([a])[0][0]
    given = float(budget) if budget is not None else total * (most / total) ** (1 - a) * z
    return {"a": a, "z": z, "total": int(total), "n": int(n), "budget": given}


def plan(docs: DataFrame, entropy: float = 0.9, max_repeats: float = 4.0, budget: float | None = None, seed: int = 11) -> tuple[DataFrame, int]:
    """The number of sources, and of each (src, tokens, weight, blocks, cut): a source's whole blocks, and the last key in its partial one (null: none)."""
    light = docs.select(source_of(F.col("source")).alias("src"), tokens_of(F.col("text")).alias("tokens"), permuted(seed, 0).alias("key"))
    spot = F.shiftrightunsigned(F.col("key").bitwiseXOR(F.lit(-(1 << 63))), 52).cast("int")
    sums = light.groupBy("src", spot.alias("spot")).agg(F.sum("tokens").alias("tokens"))
    sums = materialize(sums)
    sources = materialize(sums.groupBy("src").agg(F.sum("tokens").alias("tokens")))
    e = exponent(sources, entropy, max_repeats, budget)
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(max(1, e["total"]))), F.lit(e["a"])) / F.lit(e["z"])).otherwise(0.0)
    # a source without tokens has one block; rounding keeps whole blocks whole
    ratio = F.when(F.col("tokens") > 0, F.round(weight * F.lit(e["budget"]) / F.col("tokens"), 9)).otherwise(1.0)
    quota = sources.withColumn("weight", weight).withColumn("ratio", ratio).withColumn("blocks", F.floor("ratio")).withColumn("left", F.floor((F.col("ratio") - F.col("blocks")) * F.col("tokens")))
    w = Window.partitionBy("src").orderBy("spot")
    before = sums.select("src", "spot", "tokens", (F.sum("tokens").over(w) - F.col("tokens")).alias("before"))
    q = quota.select("src", "left")
    at = before.join(q, "src").where("left > 0 and before < left").groupBy("src").agg(F.max("spot").alias("spot"), F.max_by("before", "spot").alias("before"), F.max("left").alias("left"))
    small = F.broadcast if e["n"] <= BROADCAST_SOURCES else (lambda x: x)
    inside = light.withColumn("spot", spot).join(small(at), ["src", "spot"])
    run = F.sum("tokens").over(Window.partitionBy("src").orderBy("key").rangeBetween(Window.unboundedPreceding, 0)) + F.col("before")
    last = inside.withColumn("run", run).where("run <= left").groupBy("src").agg(F.max("key").alias("inner"))
    # where nothing of the range fits, the cut is just before it
    floor = F.shiftleft(F.col("spot").cast("long"), 52).bitwiseXOR(F.lit(-(1 << 63)))
    cut = at.join(last, "src", "left").select("src", F.when(F.col("inner").isNotNull(), F.col("inner")).when(F.col("spot") > 0, floor - 1).alias("cut"))
    return materialize(quota.join(cut, "src", "left").select("src", "tokens", "weight", "blocks", "cut")), e["n"]


def _placed(docs: DataFrame, entropy: float, max_repeats: float, budget: float | None, seed: int) -> DataFrame:
    """(row_, doc_id, text, weight, blocks, part): whole rows with how often each is shown."""
    p, n = plan(docs, entropy, max_repeats, budget, seed)
    p = p.select("src", "weight", "blocks", "cut")
    out = docs.select("doc_id", "text", source_of(F.col("source")).alias("src"), row_of(docs)).join(F.broadcast(p) if n <= BROADCAST_SOURCES else p, "src", "left")
    return out.select("row_", "doc_id", "text", "weight", "blocks", F.coalesce(permuted(seed, 0) <= F.col("cut"), F.lit(False)).cast("long").alias("part"))


def mix(docs: DataFrame, entropy: float = 0.9, max_repeats: float = 4.0, budget: float | None = None, seed: int = 11) -> DataFrame:
    """docs with all its columns and source_weight, copies: how often each row is shown."""
    out = _placed(docs, entropy, max_repeats, budget, seed)
    return out.select(*unpacked(docs, ("source_weight", "copies")), F.col("weight").alias("source_weight"), (F.col("blocks") + F.col("part")).alias("copies"))


def blocks(docs: DataFrame, entropy: float = 0.9, max_repeats: float = 4.0, budget: float | None = None, seed: int = 11) -> DataFrame:
    """The rows to show: docs with all its columns, each row once a copy, with block and place_key.

    In the order of place_key a block of a source is a permutation of its documents; block 0 is
    the head of one. Rows that aren't shown are left out.
    """
    out = _placed(docs, entropy, max_repeats, budget, seed).where("blocks + part > 0")
    out = out.withColumn("block", F.explode(F.sequence(1 - F.col("part"), F.col("blocks"))))
    return out.select(*unpacked(docs, ("block", "place_key")), "block", permuted(seed, F.col("block")).alias("place_key"))
