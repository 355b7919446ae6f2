"""Line dedup by a reversible index: exact reference counts of line keys, and cuckoo filters before them.

A key is a line without `[ \\t-\\r]` at both ends, A-Z lower-cased, of at least `least_chars` code points; it is
known by 128 bits of hash. The index consists of tables that only grow, one folder a step:

* refs (hi, lo, doc_id, gone): which document holds which key; a later row with `gone` takes it back;
* counts (hi, lo, n, last, step): by how many documents a key is held, and the largest of them; the row of
  the latest step holds;
* filters (shard, level, cells, spill): per shard of the keys a cuckoo filter of the keys held (level 1), and one of
  the keys held by at least `least` documents (level 2).

`insert` asks the level-1 filters which keys of new documents may be held; only those meet refs and counts.
`delete` takes documents back: their keys are counted anew from refs, and keys that fall out of a level
are removed from its filter, as cuckoo filters allow. So deleting what was inserted gives the state of before. `kept` asks the
level-2 filters first; lines that they rule out, nearly all, need no look-up, and the others are
verified against counts. A filter never decides alone, so its false positives change nothing.

Keys, not lines, are sent to shards, once each, so that no line is hot there; shards double as keys grow
(`PER_SHARD` each), and what a full filter can't take is held beside it, exactly.

A document is known by its doc_id; rows of one doc_id are one document, whose lines are all its rows'. Rows
without doc_id are one document together, whose id counts as the smallest. A null or empty text is one empty line.
Repeated rows come out once each, alike. Inserting a document again, with the same or more text, adds only what is new; deleting an unknown one
changes nothing. A very long text is one worker's work. Extra columns are ignored, whatever their names.
Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

U64 = np.uint64
#: Keys of a shard on average, at most; slots of a bucket; rounds of moves before a key is held beside its filter.
PER_SHARD, SLOTS, MOVES = 100_000, 4, 200
CODES = (C.BYTE_CODES, C.mix(C.BYTE_CODES + U64(77)))
NO_ID = -(1 << 63)
KEY = ["hi", "lo"]


class Cuckoo:
    """Fingerprints of 16 bits in two possible buckets each, four slots a bucket, of keys that are added once and removed once."""

    def __init__(self, cells: np.ndarray, spill: np.ndarray) -> None:
        self.cells, self.spill = cells, spill

    @classmethod
    def sized(cls, keys: int) -> Cuckoo:
        buckets = 1 << max(4, int(np.ceil(np.log2(max(1, keys) / SLOTS / 0.8))))
        return cls(np.zeros((buckets, SLOTS), np.uint16), np.zeros(0, U64))

    @classmethod
    def read(cls, cells: bytes, spill: bytes) -> Cuckoo:
        return cls(np.frombuffer(cells, np.uint16).reshape(-1, SLOTS).copy(), np.frombuffer(spill, U64).copy())

    def places(self, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprint and first bucket of hashes."""
        print_ = (lo >> U64(48)).astype(np.uint16)
        print_[print_ == 0] = 1
        return print_, (lo & U64(len(self.cells) - 1)).astype(np.int64)

    def other(self, print_: np.ndarray, at: np.ndarray) -> np.ndarray:
        return at ^ (C.mix(print_.astype(U64)) & U64(len(self.cells) - 1)).astype(np.int64)

    def held_beside(self, print_: np.ndarray, at: np.ndarray) -> np.ndarray:
        """What stands in spill: the fingerprint and the smaller of its two buckets."""
        return np.minimum(at, self.other(print_, at)).astype(U64) << U64(16) | print_.astype(U64)

    def may_hold(self, lo: np.ndarray) -> np.ndarray:
        print_, at = self.places(lo)
        found = (self.cells[at] == print_[:, None]).any(1) | (self.cells[self.other(print_, at)] == print_[:, None]).any(1)
        return found | np.isin(self.held_beside(print_, at), self.spill) if len(self.spill) else found

    def add(self, lo: np.ndarray, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        print_, at = self.places(lo)
        for turn in range(MOVES):
            if not len(at):
                return
            full = (self.cells[at] != 0).all(1)
            swap = full & ((self.cells[self.other(print_, at)] == 0).any(1) | (turn % 2 == 1))
            at = np.where(swap, self.other(print_, at), at)
            one = np.zeros(len(at), bool)  # one fingerprint a bucket and turn
            one[np.unique(at, return_index=True)[1]] = True
            free = self.cells[at] == 0
            put = one & free.any(1)
            self.cells[at[put], free[put].argmax(1)] = print_[put]
            kick = np.flatnonzero(one & ~free.any(1))
            slot = rng.integers(0, SLOTS, len(kick))
            out = self.cells[at[kick], slot]
            self.cells[at[kick], slot] = print_[kick]
            print_[kick] = out
            at[kick] = self.other(out, at[kick])
            print_, at = print_[~put], at[~put]
        self.spill = np.concatenate((self.spill, self.held_beside(print_, at)))

    def remove(self, lo: np.ndarray) -> None:
        """Takes out keys that were added."""
        print_, at = self.places(lo)
        for _ in range(2):
            left = np.ones(len(at), bool)
            todo = np.arange(len(at))
            while len(todo):  # keys of one bucket one after the other
                turn = todo[np.unique(at[todo], return_index=True)[1]]
                same = self.cells[at[turn]] == print_[turn, None]
                hit = same.any(1)
                self.cells[at[turn[hit]], same[hit].argmax(1)] = 0
                left[turn[hit]] = False
                todo = np.setdiff1d(todo, turn)
            print_, at = print_[left], self.other(print_[left], at[left])
        if len(at):
            gone = list(self.held_beside(print_, at))
            rest = []
            for x in self.spill:
                if x in gone:
                    gone.remove(x)
                else:
                    rest.append(x)
            self.spill = np.array(rest, U64)


def lines(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, first byte, end byte, code points of the key, two hashes of the key) of all lines."""
    rows = len(off) - 1
    breaks = np.flatnonzero(raw == 10)
    of = np.searchsorted(off, breaks, "right") - 1
    begin = np.concatenate((off[:-1], breaks + 1))
    row = np.concatenate((np.arange(rows), of))
    order = np.argsort(row, kind="stable")  # a row's own start comes before its breaks
    begin, row = begin[order], row[order]
    end = np.append(begin[1:] - 1, 0) if len(begin) else begin
    last = np.flatnonzero(np.append(row[1:] != row[:-1], True)) if len(row) else row
    end[last] = off[row[last] + 1]
    solid = np.flatnonzero(~C.SPACE[raw])
    a, b = np.searchsorted(solid, begin), np.searchsorted(solid, end)
    some = b > a
    first, stop = begin.copy(), begin.copy()
    first[some], stop[some] = solid[a[some]], solid[b[some] - 1] + 1
    points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    low = C.LOWER[raw]
    h = [C.span_hash(C.prefix_sums(codes[low]), first, stop) if len(raw) else np.zeros(len(first), U64) for codes in CODES]
    return row, begin, end, points[stop] - points[first], h[0], h[1]


def shard(shards: int) -> Column:
    return F.pmod("hi", F.lit(shards)).cast("int").alias("shard")


@dataclass(frozen=True)
class LineIndex:
    """One state of an index; insert and delete give the next one and leave this one as it is."""

    spark: SparkSession
    least: int = 3
    least_chars: int = 20
    shards: int = 0
    step: int = 0
    refs: tuple[DataFrame, ...] = ()
    counts: tuple[DataFrame, ...] = ()
    filters: DataFrame | None = None

    # ---- tables ----

    def held_keys(self, docs: DataFrame) -> DataFrame:
        """(hi, lo, doc_id): keys that documents hold, once for each row of docs at most."""
        C.prepare(self.spark)
        chars = self.least_chars

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_numpy()
                raw, off = C.buffers(batch.column(1))
                for x, y in C.pieces(off):
                    row, _, _, points, h1, h2 = lines(raw[off[x] : off[y]], off[x : y + 1] - off[x])
                    some = points >= chars
                    t = np.stack((row[some].astype(np.int64), h1[some].view(np.int64), h2[some].view(np.int64)), 1)
                    t = np.unique(t, axis=0) if len(t) else t
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(t[:, 1])), pa.array(np.ascontiguousarray(t[:, 2])), pa.array(ids[x:y][t[:, 0]])], names=["hi", "lo", "doc_id"])

        return known(docs).mapInArrow(run, "hi long, lo long, doc_id long")

    def live_refs(self) -> DataFrame:
        every = [r.select(*KEY, "doc_id", F.lit(i).alias("step"), "gone") for i, r in enumerate(self.refs)]
        if len(every) == 1:
            return every[0].where("not gone").select(*KEY, "doc_id")
        out = every[0]
        for x in every[1:]:
            out = out.union(x)
        return out.groupBy(*KEY, "doc_id").agg(F.max_by("gone", "step").alias("gone")).where("not gone").select(*KEY, "doc_id")

    def live_counts(self, of: DataFrame | None = None) -> DataFrame:
        """(hi, lo, n, last), of given keys (hi, lo)."""
        every = [c.join(of, KEY, "left_semi") if of is not None else c for c in self.counts]
        if len(every) == 1:
            return every[0].select(*KEY, "n", "last").where("n > 0")
        out = every[0]
        for x in every[1:]:
            out = out.union(x)
        return out.groupBy(*KEY).agg(F.max_by(F.struct("n", "last"), "step").alias("x")).select(*KEY, "x.n", "x.last").where("n > 0")

    # ---- filters ----

    def may_hold(self, keys: DataFrame, level: int) -> DataFrame:
        """The rows of keys (hi, lo), each key once, that a filter of the level may hold."""

        def ask(left: pa.Table, right: pa.Table) -> pa.Table:
            if not right.num_rows or not left.num_rows:
                return left.select(KEY).slice(0, 0)
            f = Cuckoo.read(right.column("cells")[0].as_py(), right.column("spill")[0].as_py())
            return left.select(KEY).filter(pa.array(f.may_hold(left.column("lo").to_numpy().view(U64))))

        filters = self.filters.where(F.col("level") == level)
        return keys.select(*KEY, shard(self.shards)).groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(ask, "hi long, lo long")

    def filtered(self, changes: DataFrame) -> LineIndex:
        """The index with filters after changes (hi, lo, was, n): the reference counts of before and now."""
        least, shards = self.least, self.shards

        def change(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            of = dict(zip(right.column("level").to_pylist(), zip(right.column("cells").to_pylist(), right.column("spill").to_pylist(), strict=True), strict=True))
            lo, was, n = left.column("lo").to_numpy().view(U64), left.column("was").to_numpy(), left.column("n").to_numpy()
            order = np.argsort(lo)  # the same filter whatever the order of rows
            lo, was, n = lo[order], was[order], n[order]
            out = []
            for level, bound in ((1, 1), (2, least)):
                f = Cuckoo.read(*of[level]) if level in of else Cuckoo.sized(max(int((n >= bound).sum()), PER_SHARD if level == 1 else PER_SHARD // 4))
                f.remove(lo[(was >= bound) & (n < bound)])
                f.add(lo[(was < bound) & (n >= bound)])
                out.append((key[0].as_py(), level, f.cells.tobytes(), f.spill.tobytes()))
            return pa.table(dict(zip(("shard", "level", "cells", "spill"), zip(*out, strict=True), strict=True)), schema=pa.schema([("shard", pa.int32()), ("level", pa.int32()), ("cells", pa.binary()), ("spill", pa.binary())]))

        old = self.filters if self.filters is not None else self.spark.createDataFrame([], "shard int, level int, cells binary, spill binary")
        new = changes.select(*KEY, "was", "n", shard(shards)).groupBy("shard").cogroup(old.groupBy("shard")).applyInArrow(change, "shard int, level int, cells binary, spill binary")
        return replace(self, filters=C.materialize(new))

    def sized(self, counts: DataFrame) -> LineIndex:
        """The index with enough shards for counts (hi, lo, n), its filters made anew if they are more than before."""
        keys = counts.where("n > 0").count()
        shards = max(1, self.shards)
        while shards * PER_SHARD < keys:
            shards *= 2
        out = replace(self, shards=shards)
        if self.filters is not None and shards == self.shards:
            return out
        return replace(out, filters=None).filtered(counts.select(*KEY, F.lit(0).cast("long").alias("was"), "n"))

    # ---- documents ----

    def insert(self, docs: DataFrame) -> LineIndex:
        """The index with docs (doc_id, text)."""
        new = self.held_keys(docs).distinct()
        if self.filters is not None:
            new = C.materialize(new)
            maybe = C.materialize(self.may_hold(new.select(*KEY).distinct(), 1))
            seen = new.join(maybe, KEY, "left_semi")
            again = self.live_refs().join(maybe, KEY, "left_semi")
            fresh = new.join(maybe, KEY, "left_anti").union(seen.join(again, [*KEY, "doc_id"], "left_anti"))
        else:
            fresh = new
        refs = C.materialize(fresh.select(*KEY, "doc_id", F.lit(False).alias("gone")))
        added = refs.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last"))
        if self.filters is None:
            counts = C.materialize(added.select(*KEY, "n", "last", F.lit(0).cast("long").alias("was"), F.lit(self.step).alias("step")))
            return replace(self, step=self.step + 1, refs=(refs,), counts=(counts,)).sized(counts)
        old = self.live_counts(maybe).select(*KEY, F.col("n").alias("was"), F.col("last").alias("old"))
        both = added.join(old, KEY, "left").select(*KEY, (F.col("n") + F.coalesce("was", F.lit(0))).alias("n"), F.greatest("last", "old").alias("last"), F.coalesce("was", F.lit(0)).cast("long").alias("was"))
        return self.after(refs, both)

    def delete(self, ids: DataFrame) -> LineIndex:
        """The index without the documents of ids (doc_id)."""
        if not self.refs:
            return self
        live = self.live_refs()
        gone = C.materialize(live.join(known(ids, ()).distinct(), "doc_id", "left_semi").select(*KEY, "doc_id", F.lit(True).alias("gone")))
        keys = C.materialize(gone.select(*KEY).distinct())
        stays = live.join(keys, KEY, "left_semi").join(gone, [*KEY, "doc_id"], "left_anti").groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last"))
        was = self.live_counts(keys).select(*KEY, F.col("n").alias("was"))
        return self.after(gone, was.join(stays, KEY, "left").select(*KEY, F.coalesce("n", F.lit(0)).cast("long").alias("n"), "last", "was"))

    def after(self, refs: DataFrame, changed: DataFrame) -> LineIndex:
        counts = C.materialize(changed.select(*KEY, "n", "last", "was", F.lit(self.step).alias("step")))
        out = replace(self, step=self.step + 1, refs=(*self.refs, refs), counts=(*self.counts, counts))
        grown = out.sized(out.live_counts())
        return grown if grown.shards != out.shards else out.filtered(counts)

    def compact(self) -> LineIndex:
        """The same state in one step's tables."""
        if len(self.refs) < 2:
            return self
        refs = C.materialize(self.live_refs().withColumn("gone", F.lit(False)))
        counts = C.materialize(self.live_counts().select(*KEY, "n", "last", F.lit(0).cast("long").alias("was"), F.lit(0).alias("step")))
        return replace(self, step=1, refs=(refs,), counts=(counts,))

    def repeated(self, keys: DataFrame) -> DataFrame:
        """(hi, lo, last) of those of keys (hi, lo) that at least `least` documents hold."""
        maybe = self.may_hold(keys.select(*KEY).distinct(), 2)
        return self.live_counts(C.materialize(maybe)).where(F.col("n") >= self.least).select(*KEY, "last")

    def kept(self, docs: DataFrame) -> DataFrame:
        """(doc_id, n_lines, n_dropped, kept_text) for every row of docs (doc_id, text), inserted or not.

        Lines of keys that at least `least` documents of the index hold go, but for those in the largest doc_id that holds it.
        """
        rows = known(docs)
        if self.filters is None:
            dropped = self.spark.createDataFrame([], "doc_id long, keys array<struct<hi:long,lo:long>>")
        else:
            own = C.materialize(self.held_keys(docs))
            goes = own.join(self.repeated(own), KEY).where("doc_id <> last")
            dropped = goes.groupBy("doc_id").agg(F.collect_set(F.struct(*KEY)).alias("keys"))

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                raw, off = C.buffers(batch.column(1))
                keys = batch.column(2).to_pylist()
                count, gone, text = [], [], []
                for x, y in C.pieces(off):
                    base = off[x]
                    row, begin, end, points, h1, h2 = lines(raw[base : off[y]], off[x : y + 1] - base)
                    at = np.searchsorted(row, np.arange(y - x + 1))
                    for i in range(x, y):
                        s = slice(at[i - x], at[i - x + 1])
                        count.append(s.stop - s.start)
                        whole = raw[off[i] : off[i + 1]].tobytes()
                        if keys[i]:
                            drop = {(k["hi"], k["lo"]) for k in keys[i]}
                            go = [k in drop and p >= self_chars for k, p in zip(zip(h1[s].view(np.int64).tolist(), h2[s].view(np.int64).tolist(), strict=True), points[s].tolist(), strict=True)]
                            whole = b"\n".join(raw[a:b].tobytes() for a, b, g in zip(begin[s] + base, end[s] + base, go, strict=True) if not g)
                            gone.append(sum(go))
                        else:
                            gone.append(0)
                        text.append(whole.decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), pa.array(gone, pa.int64()), pa.array(text, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_text"])

        self_chars = self.least_chars
        out = rows.withColumnRenamed("doc_id", "id_").join(dropped, F.col("id_") == F.col("doc_id"), "left").select("own", "text", "keys")
        return out.mapInArrow(cut, "doc_id long, n_lines long, n_dropped long, kept_text string")

    # ---- storing ----

    def save(self, path: str) -> None:
        """Writes the state to a new folder; `_SUCCESS` of its last table says that it is whole."""
        one = self.compact()
        for name, t in (("refs", one.refs and one.refs[0]), ("counts", one.counts and one.counts[0]), ("filters", one.filters)):
            if t is not None and t != ():
                t.write.parquet(f"{path}/{name}")
        self.spark.createDataFrame([(self.least, self.least_chars, one.shards, one.filters is None)], "least int, least_chars int, shards int, blank boolean").coalesce(1).write.parquet(f"{path}/state")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LineIndex:
        s = spark.read.parquet(f"{path}/state").first()
        if s.blank:
            return cls(spark, s.least, s.least_chars)
        refs, counts, filters = (spark.read.parquet(f"{path}/{name}") for name in ("refs", "counts", "filters"))
        return cls(spark, s.least, s.least_chars, s.shards, 1, (refs,), (counts,), filters)


def known(docs: DataFrame, more: tuple[str, ...] = ("text",)) -> DataFrame:
    """doc_id as the index knows it, and texts; own is the doc_id as it stands."""
    out = [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id")]
    if more:
        out += [F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("own")]
    return docs.select(*out)
