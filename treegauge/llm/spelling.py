"""Spelling variants: words that are one change apart, grouped under the most frequent form.

Every word sends itself and its distinct single deletions; words that meet in a key differ by one change
or by little more, and their exact distance says which. At most as many words meet in a key as one
character can be put into it, so no key is hot, however frequent its words are. A word's form is its near word of the largest count
(ties: the smallest in code-point order) if that count is at least `ratio` times its own; its root is what
the forms lead to. Counts grow along forms, so they have no cycles; roots are joined with their own roots
until none moves, which takes the logarithm of the longest chain of rounds.

Words of a text: maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased. Nulls: a null or empty text has none, and null words are left out.
Repeated rows and ties of doc_id count again. Extra columns are ignored, whatever their names. A very
long text is one task's work until its words are apart. Empty tables give empty results.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

RUN = "[A-Za-zÀ-ÿ]+"


def lowered(c: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def runs(docs: DataFrame, least_chars: int = 1) -> DataFrame:
    """(doc_id, word): every run of at least so many code points of every text of docs (doc_id, text), A-Z lower-cased."""
    every = F.filter(F.regexp_extract_all(F.col("text").cast("string"), F.lit(RUN), F.lit(0)), lambda w: F.char_length(w) >= least_chars)
    return docs.select(F.col("doc_id"), F.explode(every).alias("word")).select("doc_id", lowered(F.col("word")).alias("word"))


def without(c: Column, i: Column) -> Column:
    """The string without its code point i, from 0."""
    return F.concat(F.substring(c, F.lit(1), i), F.substring(c, i + 2, F.char_length(c)))


def slips(words: DataFrame, every: int) -> DataFrame:
    """(word): words (doc_id, word) where every so many-th pair of document and word, by crc32, has lost one code point."""
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("word")).cast("binary"))
    marked = words.select("word", h.alias("h"))
    return marked.select(F.when(F.col("h") % every == 0, without(F.col("word"), (F.col("h") % F.char_length("word")).cast("int"))).otherwise(F.col("word")).alias("word"))


def frequent(words: DataFrame, least_chars: int = 5, least: int = 3) -> DataFrame:
    """(word, n) of the words of so many code points and occurrences at least."""
    long_ = words.where(F.char_length("word") >= least_chars)
    return long_.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n): all ordered pairs of words (word, n) that one inserted, deleted or replaced code point tells apart."""
    places = F.sequence(F.lit(0), F.char_length("word") - 1)
    sent = F.array_distinct(F.concat(F.array("word"), F.transform(places, lambda i: without(F.col("word"), i))))
    keys = words.where("word <> ''").select("word", "n", F.explode(sent).alias("key"))
    other = keys.select(F.col("word").alias("near"), F.col("n").alias("near_n"), "key")
    met = keys.join(C.met(other), "key").where("word < near").where("key = word or key = near or levenshtein(word, near, 1) = 1")
    both = F.explode(F.array(F.struct("word", "near", F.col("near_n").alias("near_n")), F.struct(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n"))))
    return met.select(both.alias("x")).select("x.*").repartition("word").distinct()


def forms(words: DataFrame, ratio: int = 2) -> DataFrame:
    """(word, n, n_near, form, form_n) for every row of words (word, n), each word once."""
    top = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("x"))
    led = words.where("word is not null").join(C.met(top), "word", "left")
    leads = -F.col("x.m") >= ratio * F.col("n")
    return led.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(leads, F.col("x.near")).alias("form"), F.when(leads, -F.col("x.m")).alias("form_n"))


def rooted(formed: DataFrame) -> DataFrame:
    """formed (word, form, ...) with root: the last form from word on, word itself where it has none."""
    formed = C.materialize(formed)
    at = formed.where("form is not null").select("word", F.col("form").alias("root"))
    held = None
    while True:
        at = C.materialize(at)
        hop = at.select(F.col("word").alias("root"), F.col("root").alias("far"))
        nxt = C.materialize(at.join(C.met(hop), "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")))
        if held is not None:
            C.forget(held)
        held, at = nxt, nxt.select("word", "root")
        if not nxt.where("moved").limit(1).count():
            return formed.join(C.met(at), "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, least_chars: int = 5, least: int = 3, ratio: int = 2, slip: int | None = None) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of the frequent words of docs (doc_id, text); with slip, words lose code points as slips() says."""
    words = runs(docs, least_chars)
    words = slips(words, slip) if slip else words.select("word")
    return rooted(forms(C.materialize(frequent(words, least_chars, least)), ratio))
