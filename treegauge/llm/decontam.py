"""Benchmark decontamination by a broadcast hash set of normalised word windows, in DataFrame functions only.

A-Z are lower-cased; words are runs of digits, a-z and characters beyond ASCII. A window is `size`
consecutive words of a benchmark item, or all of an item that has fewer, but some. Every document
is read once: its windows of each length that the benchmark has are hashed and looked up in the
benchmark's windows; a hit is verified by its words. A word inside a verified window is hit.

The windows are broadcast while they take at most `broadcast_bytes`, which is measured first. Beyond
it the documents' words are written once, only (row, place, hash) is shuffled to the windows, and
what meets comes back to its document to be verified.

Nulls: a null text has no words. A null item_id hits, but isn't counted or listed. Repeated rows and
null doc_ids come out once a row. Documents without words come out with zeros. Extra columns of
either table are ignored, or kept by decontaminate(), whatever their names. A very long text is one
task's work, at some hundred bytes of memory a word. With no benchmark nothing is contaminated.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, row_of, unpacked

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A word in any case with what stands before the first and after each.
WORD_AND_GAP = r"(?:^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)?[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"


def words_of(text: Column) -> Column:
    # lower() is the same for ASCII and much faster than translate()
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.coalesce(F.regexp_extract_all(low, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def window_text(words: Column, start: Column, size: Column) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def benchmark_windows(benchmark: DataFrame, size: int) -> DataFrame:
    """(h, gram, len, items): each distinct window once, with the items that hold it."""
    w = benchmark.select(F.col("item_id").alias("item"), words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    w = w.withColumn("len", F.least(F.size("w"), F.lit(size)))
    at = w.select("item", "len", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)).alias("i"))
    gram = at.select("item", "len", window_text(F.col("w"), F.col("i"), F.col("len")).alias("gram"), F.xxhash64(F.slice("w", F.col("i"), F.col("len"))).alias("h"))
    return gram.groupBy("h", "gram", "len").agg(F.collect_set("item").alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 13, broadcast_bytes: int = 64 << 20, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, keep..., n_words, n_hit, items array, spans array<struct<start,end>>) for every row of docs (doc_id, text).

    spans: the maximal runs of hit words, as word places from 0, end exclusive.
    """
    windows = benchmark_windows(benchmark, size)
    fact = windows.agg(F.sum(F.octet_length("gram") + 32 + 8 * F.size("items")).alias("bytes"), F.sort_array(F.collect_set("len")).alias("lens")).first()
    lens = fact["lens"] or [size]
    small = (fact["bytes"] or 0) <= broadcast_bytes
    d = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(F.col("doc_id"), *keep).alias("own"), words_of(F.col("text")).alias("w")).withColumn("n", F.size("w"))
    count = {k: F.greatest(F.col("n") - (k - 1), F.lit(0)) for k in lens}

    def hashes_of(k: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), count[k]), lambda i: F.xxhash64(F.slice("w", i, F.lit(k))))
        return F.when(count[k] > 0, every).otherwise(F.array().cast("array<bigint>"))

    if not small:
        # the ids of rows must hold for the two joins that follow
        d = materialize(d)
    # a lambda in the generator itself would keep it, and the join after it, out of code generation
    words, d = d, d.withColumn("hashes", F.concat(*map(hashes_of, lens)))
    held = ["row", "own", "n", "w"] if small else ["row", "n"]
    each = d.select(*held, (F.posexplode_outer if small else F.posexplode)("hashes").alias("g", "h"))
    # of which length the g-th hash is, and where it starts
    edges, total = [], F.lit(0)
    for k in lens:
        edges.append((k, total))
        total = total + count[k]
    length, start = F.lit(lens[0]), F.col("g")
    for k, edge in edges[1:]:
        length, start = F.when(F.col("g") >= edge, k).otherwise(length), F.when(F.col("g") >= edge, F.col("g") - edge).otherwise(start)
    each = each.withColumn("len_", length).withColumn("start", start)
    hit = F.col("gram").isNotNull() & (window_text(F.col("w"), F.col("start") + 1, F.col("len_")) == F.col("gram"))
    windows = windows.withColumnRenamed("h", "bh")
    same = (F.col("h") == F.col("bh")) & (F.col("len_") == F.col("len"))
    if small:
        met = each.join(F.broadcast(windows), same, "left")
    else:
        found = each.join(windows, same).select("row", "g", "start", "len_", "gram", "items")
        met = words.join(found, "row", "left").withColumn("g", F.coalesce("g", F.lit(0)))
    met = met.withColumn("hit", hit)
    met = (met.where(F.col("hit") | F.coalesce(F.col("g") == 0, F.lit(True))) if small else met).select("row", "own", "n", F.when(F.col("hit"), F.struct(F.col("start").alias("s"), (F.col("start") + F.col("len_")).alias("e"))).alias("span"), F.when(F.col("hit"), F.col("items")).alias("items"))
    doc = met.groupBy("row").agg(F.first("own").alias("own"), F.first("n").alias("n"), F.array_sort(F.collect_set("span")).alias("hits"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    # intervals in order of their starts are merged into the last run, or begin a new one
    none = F.array().cast("array<struct<start:int,end:int>>")
    join = lambda runs, x: F.when(
        (F.size(runs) > 0) & (F.try_element_at(runs, F.lit(-1))["end"] >= x["s"]),
        F.concat(F.slice(runs, F.lit(1), F.greatest(F.size(runs) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(runs, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(runs, F.lit(-1))["end"], x["e"]).alias("end")))),
    ).otherwise(F.concat(runs, F.array(F.struct(x["s"].alias("start"), x["e"].alias("end")))))
    doc = doc.withColumn("spans", F.aggregate("hits", none, join))
    total = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + (x["end"] - x["start"]))
    return doc.select("own.*", F.col("n").cast("long").alias("n_words"), total.alias("n_hit"), "items", "spans")


def is_contaminated(n_hit: Column, n_words: Column, share: int = 20) -> Column:
    """A word hit, and one word in `share` at least."""
    return (n_hit > 0) & (n_hit * share >= n_words)


def decontaminate(docs: DataFrame, benchmark: DataFrame, how: str = "documents", size: int = 13, share: int = 20) -> DataFrame:
    """docs with all its columns, without contaminated documents, or ("spans") without their hit words."""
    row = docs.select("doc_id", "text", row_of(docs))
    flagged = contamination(row, benchmark, size, keep=("row_",) if how == "documents" else ("row_", "text"))
    bad = is_contaminated(F.col("n_hit"), F.col("n_words"), share)
    if how == "documents":
        return flagged.where(~bad).select(*unpacked(docs, ()))
    if how != "spans":
        raise ValueError(how)
    parts = F.regexp_extract_all("text", F.lit(WORD_AND_GAP), F.lit(0))
    rest = F.array_join(F.filter(parts, lambda x, i: ~F.exists("spans", lambda s: (i >= s["start"]) & (i < s["end"]))), "")
    kept = F.when(bad, rest).otherwise(F.col("text"))
    return flagged.select(*[kept.alias(c) if c.lower() == "text" else x for c, x in zip(docs.columns, unpacked(docs, ()), strict=True)])
