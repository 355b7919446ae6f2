"""MinHash near-duplicate groups with tensored banding.

Two small collections of half keys are drawn for a document, `side` of each kind, every half key
joining `rows` minhashes. Table (i, j) is keyed by half i of the first and half j of the second
collection: side * side tables cost only 2 * side * rows minhashes, about the square root of what
independent tables would. With the defaults (8 x 8 tables of 4 minhashes from 32) a pair of
similarity 0.8 meets in some table but for 6 in 10,000, and a pair of 0.9 but for 3 in 10 million.

1. One pass over the texts: size of the shingle set, a 128-bit fingerprint of it, the half keys.
   Documents of equal fingerprints form one class, whose smallest doc_id stands for it.
2. Class representatives are put in the tables; keys held by one document only are dropped.
3. Star rounds: in each bucket whose members are not yet in one component, members of other
   components are compared with a leader (first the smallest id, then a random one a round). No
   bucket emits its pairs, and a bucket that has become one component is done.
4. Documents left in buckets of several components are put in sharper tables (`sharp_side`,
   `sharp_rows`), whose buckets are joined across components. So a link is found whether or not its bucket's leaders are alike.

Before a pair's full sets are compared, its odd sketches are: 1024 bits, each the parity of how
many shingles hash to it. The bits in which two differ are at most the shingles that only one has,
so a pair with more differing bits than the threshold allows is no link, and none is lost.

Nulls: a null text has no words. A null doc_id is never linked, its component_id is null and it is
kept. Without words a document links with nothing. Equal rows come out once each, with the same
component; rows of one doc_id with different texts are judged by their own texts, each with its own component. A very long text is one worker's work, at some hundred bytes of memory a byte.
Extra columns are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

U64 = np.uint64
#: Bits of an odd sketch.
SKETCH = 1024


def signatures(docs: DataFrame, words: int, side: int, rows: int, seed: int) -> DataFrame:
    """(doc_id, n_shingles, f1, f2, a[side], b[side], sketch[16]) of each row of docs (doc_id, text)."""
    salts = C.mix(np.arange(1, 2 * side * rows + 1, dtype=U64) * C.ODD + U64(seed)) | U64(1)

    def sign(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
        n = len(off) - 1
        value, count = C.shingles(raw, off, words)
        size, f1, f2 = np.zeros(n, np.int64), np.zeros(n, U64), np.zeros(n, U64)
        halves, bits = np.zeros((n, 2 * side), U64), np.zeros((n, SKETCH), np.uint8)
        full = np.flatnonzero(count)
        if len(full):
            starts = np.concatenate(([0], np.cumsum(count)))
            for i in full:
                own = np.unique(value[starts[i] : starts[i + 1]])
                size[i], f1[i], f2[i] = len(own), C.mix(own).sum(), (own * (own >> U64(31))).sum()
                bits[i] = np.bincount((own >> U64(17)).astype(np.int64) % SKETCH, minlength=SKETCH) & 1
            at = starts[:-1][full]
            for k in range(2 * side):
                acc = np.full(len(full), k + 1, U64)
                for r in range(rows):
                    acc = C.mix(acc * C.ODD + np.minimum.reduceat((value ^ (value >> U64(33))) * salts[k * rows + r] + salts[r * 2 * side + k], at))
                halves[full, k] = acc
        return size, f1, f2, halves, np.packbits(bits, axis=1)

    def longs(x: np.ndarray, n: int) -> pa.Array:
        return pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(x).view(np.int64).ravel()), n).cast(pa.list_(pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = C.buffers(batch.column(1))
            for lo, hi in C.pieces(off):
                size, f1, f2, halves, bits = sign(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                both = [longs(x, side) for x in (halves[:, :side], halves[:, side:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(size), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), *both, longs(bits.view(np.int64), SKETCH // 64)], names=["doc_id", "n_shingles", "f1", "f2", "a", "b", "sketch"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, f1 long, f2 long, a array<long>, b array<long>, sketch array<long>")


def verify(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full shingle sets have the similarity.

    Each text of a pair's b is sent to its a; a with many partners is dealt to several tasks,
    with its text sent to each.
    """
    many = 256
    stars = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).withColumn("parts", F.ceil(F.col("n") / many).cast("int"))
    t = texts.select(F.col("doc_id").alias("id"), "text")
    heads = stars.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).withColumn("b", F.lit(None).cast("long"))
    rays = pairs.join(C.met(stars.select("a", "parts")), "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b")
    sent = heads.unionByName(rays).withColumn("id", F.coalesce("b", "a")).join(C.met(t), "id").select("a", "part", "b", "text")
    width = C.shuffle_width(pairs.sparkSession)
    dealt = sent.repartition(width, "a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, sets = None, []
        for batch in batches:
            a, b = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)), batch.column(2).to_pylist()
            raw, off = C.buffers(batch.column(3))
            out: list[tuple[int, int]] = []
            for lo, hi in C.pieces(off):
                value, count = C.shingles(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], words)
                at = np.concatenate(([0], np.cumsum(count)))
                for i in range(lo, hi):
                    own = np.unique(value[at[i - lo] : at[i - lo + 1]])
                    if b[i] is None:
                        # rows of one doc_id with different texts are one node of several sets
                        sets = [*sets, own] if lead == a[i] else [own]
                        lead = a[i]
                    elif lead == a[i]:
                        for one in sets:
                            if len(one) and len(own):
                                spot = np.searchsorted(one, own)
                                spot[spot == len(one)] = 0
                                both = int((one[spot] == own).sum())
                                if 100 * both >= percent * (len(one) + len(own) - both):
                                    out.append((a[i][0], b[i]))
                                    break
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def shared_keys(halves: DataFrame) -> DataFrame:
    """(key, node): the table keys of halves (node, a, b) that several nodes hold."""
    every = F.flatten(F.transform("a", lambda x, i: F.transform("b", lambda y, j: F.xxhash64(i, j, x, y))))
    keyed = halves.select("node", F.explode(every).alias("key"))
    # a node holds a key once
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    return keyed.join(C.met(shared), "key")


def alike(x: Column, y: Column, percent: int) -> Column:
    """Sets of more different sizes are never linked."""
    return F.least(x, y) * 100 >= F.greatest(x, y) * percent


def close(l: str, r: str, percent: int) -> Column:
    """Whether the sizes and odd sketches of two sides allow a link; of linked sets they always do."""
    n, m = F.col(f"{l}.n_shingles"), F.col(f"{r}.n_shingles")
    apart = sum((F.bit_count(F.col(f"{l}.sketch")[i].bitwiseXOR(F.col(f"{r}.sketch")[i])) for i in range(SKETCH // 64)), F.lit(0))
    return alike(n, m, percent) & (apart * (100 + percent) <= (n + m) * (100 - percent))


def sharp_pairs(texts: DataFrame, label: DataFrame, words: int, percent: int, side: int, rows: int, seed: int) -> DataFrame:
    """(a, b) of different components among texts (doc_id, text) that meet in a sharp table and are close."""
    sig = C.materialize(signatures(texts, words, side, rows, seed).withColumnRenamed("doc_id", "node"))
    held = C.materialize(shared_keys(sig).join(C.met(label), "node").join(C.met(sig.select("node", "n_shingles", "sketch")), "node"))
    l, r = held.alias("l"), held.alias("r")
    met = l.join(C.met(r), F.expr("l.key = r.key and l.component < r.component") & close("l", "r", percent))
    return met.select(F.col("l.node").alias("a"), F.col("r.node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, side: int = 8, rows: int = 2, stars: int = 1, sharp_side: int = 16, sharp_rows: int = 4, seed: int = 7) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs (doc_id, text).

    words: words in a shingle. percent: least 100 * intersection / union of linked sets.
    side, rows: half keys of each kind and minhashes in each. stars: star rounds.
    sharp_side, sharp_rows: the same of the tables for what the star rounds leave open.
    """
    spark = docs.sparkSession
    C.prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sig = C.materialize(signatures(docs, words, side, rows, seed))
    linked = sig.where("n_shingles > 0 and doc_id is not null")
    reps = linked.groupBy("n_shingles", "f1", "f2").agg(F.min_by(F.struct("a", "b", "sketch"), "doc_id").alias("s"), F.min("doc_id").alias("rep"))
    nodes = reps.select(F.col("rep").alias("node"), "n_shingles", "s.*")
    member = C.materialize(shared_keys(nodes))
    held = member.select("node").distinct()
    info = C.materialize(nodes.select("node", "n_shingles", "sketch").join(held, "node"))
    texts = C.materialize(docs.join(held.withColumnRenamed("node", "doc_id"), "doc_id").distinct())

    label, links, tested = member.select("node", F.col("node").alias("component")).distinct(), None, None
    for turn in range(stars + 1):
        here = member.join(C.met(label), "node")
        by_key = here.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), *([F.min_by(F.struct("node", "component"), F.xxhash64("node", F.lit(turn)) if turn else F.col("node")).alias("lead")] if turn < stars else []))
        open_keys = by_key.where("c0 < c1")
        if turn < stars:
            rays = here.join(C.met(open_keys), "key").where(F.col("component") != F.col("lead.component"))
            pairs = rays.select(F.col("lead.node").alias("a"), F.col("node").alias("b")).distinct().alias("p")
            pairs = pairs.join(C.met(info).alias("l"), F.expr("p.a = l.node")).join(C.met(info).alias("r"), F.expr("p.b = r.node")).where(close("l", "r", percent)).select("p.a", "p.b")
        else:
            rest = here.join(C.met(open_keys.select("key")), "key").select(F.col("node").alias("doc_id")).distinct()
            pairs = sharp_pairs(texts.join(rest, "doc_id"), label, words, percent, sharp_side, sharp_rows, seed + 1)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = C.materialize(pairs)
        flipped = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        tested = flipped if tested is None else tested.union(flipped)
        found = C.materialize(verify(pairs, texts, words, percent))
        links = found if links is None else links.union(found)
        if not found.isEmpty():
            c = C.components(links)
            label = member.select("node").distinct().join(c, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
            label = C.materialize(label)
        elif turn >= stars:
            break
    klass = reps.select("n_shingles", "f1", "f2", "rep").join(label.select(F.col("node").alias("rep"), "component"), "rep", "left").select("n_shingles", "f1", "f2", F.coalesce("component", "rep").alias("component_id"))
    out = sig.select("doc_id", "n_shingles", "f1", "f2").join(klass, ["n_shingles", "f1", "f2"], "left")
    own = F.when(F.col("doc_id").isNull() | (F.col("n_shingles") == 0), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
