"""Removal of sentences that repeat across the corpus in runs.

A sentence ends at a newline, or at `.`, `!` or `?` before white space. Every run of `run`
consecutive sentences of a document is hashed (128 bits, of the sentences with A-Z lower-cased and
without white space). With `words`, fewer consecutive sentences count as a run too if they hold more
than `words` words; with `short`, so do all the sentences of a document of fewer than `run`. The
first holder of a run by (doc_id, place) keeps it; every sentence that a non-first run covers is
removed.

Each batch sends one holder of a run, its first, to the task of the run's hash; its other holders
are known at once not to be first. So a run that a third of the corpus holds reaches its task once
a batch.

What stays of a repeated passage: a first or last sentence that runs on into the text around it, and,
with `words`, runs of fewer than `run` sentences of `words` words or fewer. A stretch without a stop
is one sentence, however long.

A task holds its partition of runs; partitions follow the size of docs, so that this doesn't grow with it.
A row is known by its doc_id and a hash of both its columns. Nulls: a null text has no sentences. A
null doc_id counts as larger than all others. Without `words` and `short`, documents of fewer than
`run` sentences lose nothing. Repeated rows come out once each, alike. A very long text is one
worker's work, at some hundred bytes of memory a byte. Extra columns are ignored, whatever their
names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

U64 = np.uint64
NO_ID = (1 << 63) - 1
STOP = np.zeros(256, bool)
STOP[[33, 46, 63]] = True
CODES = (C.BYTE_CODES, C.mix(C.BYTE_CODES + U64(77)))


def sentences(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, first byte, end byte in the piece) of the sentences, two hashes and the words of each."""
    space = C.SPACE[raw]
    ends = raw == 10
    ends[:-1] |= STOP[raw[:-1]] & space[1:]
    new = np.zeros(len(raw) + 1, bool)
    new[1:] = ends
    new[off] = True
    part = np.cumsum(new[:-1])
    kept = np.flatnonzero(~space)
    if not len(kept):
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(U64), z.astype(U64), z
    of = part[kept]
    a = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
    b = np.concatenate((a[1:], [len(kept)]))
    low = C.LOWER[raw[kept]]
    h1, h2 = (C.span_hash(C.prefix_sums(codes[low]), a, b) for codes in CODES)
    begins = np.ones(len(kept), np.int64)
    begins[1:] = (kept[1:] != kept[:-1] + 1) | (of[1:] != of[:-1])
    return np.searchsorted(off, kept[a], "right") - 1, kept[a], kept[b - 1] + 1, h1, h2, np.add.reduceat(begins, a)


def spans(raw: np.ndarray, off: np.ndarray, run: int, words: int | None, short: bool) -> tuple[np.ndarray, ...]:
    """(row, place, two hashes) of all runs: place is run times that of the first sentence in its row, plus the sentences after it."""
    row, _, _, h1, h2, held = sentences(raw, off)
    z = np.zeros(0, np.int64)
    out = [(z, z, z.astype(U64), z.astype(U64))]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    size = np.bincount(row, minlength=1)[row]
    x, y, n_words = h1, h2, held
    for t in range(min(run, len(row))):
        n = len(row) - t
        if t:
            x, y, n_words = C.mix(x[:n] * C.ODD + h1[t:]), C.mix(y[:n] * C.ODD + h2[t:]), n_words[:n] + held[t:]
        one = row[:n] == row[t:]
        if t + 1 < run:
            one &= ((n_words > words) if words is not None else False) | ((size[:n] == t + 1) & short)
        out.append((row[:n][one], place[:n][one] * run + t, x[one], y[one]))
    return tuple(np.concatenate(k) for k in zip(*out, strict=True))


def repeated_sentences(docs: DataFrame, run: int = 3, words: int | None = None, short: bool = False) -> DataFrame:
    """(doc_id, n_sentences, removed array<int>, kept_text) for every row of docs (doc_id, text).

    removed: places, from 0, of the sentences removed; kept_text: the text without them and the
    white space after them.
    """
    spark = docs.sparkSession
    C.prepare(spark)
    width = C.width_of(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("rid", F.xxhash64("doc_id", "text"))

    def firsts(d: np.ndarray, r: np.ndarray, s: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the first holders, and of the others that aren't the same row again."""
        order = np.lexsort((s, r, d, h2, h1))
        head = np.ones(len(order), bool)
        a, b = order[1:], order[:-1]
        head[1:] = (h1[a] != h1[b]) | (h2[a] != h2[b])
        lead = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
        other = ~head & ((r[order] != r[lead]) | (d[order] != d[lead]) | (s[order] != s[lead]))
        return order[head], order[other]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, rid = batch.column(0).fill_null(NO_ID).to_numpy(), batch.column(1).to_numpy()
            raw, off = C.buffers(batch.column(2))
            got = [[x[0] + lo, *x[1:]] for lo, hi in C.pieces(off) for x in [spans(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], run, words, short)]]
            row, s, h1, h2 = (np.concatenate([x[k] for x in got]) for k in range(4)) if got else (np.zeros(0, np.int64),) * 4
            if not len(row):
                continue
            d, r = doc[row], rid[row]
            lead, other = firsts(d, r, s, h1, h2)
            to = (h1[lead] % U64(width)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            lead, to = lead[order], to[order]
            names, kinds, blobs = [], [], []
            for part in np.split(np.arange(len(to)), np.flatnonzero(np.diff(to)) + 1):
                i = lead[part]
                names.append(int(to[part[0]]))
                kinds.append(0)
                blobs.append(C.pack(d=d[i], r=r[i], s=s[i].astype(np.int32), h1=h1[i], h2=h2[i]))
            if len(other):
                names.append(int(rid[0] % width))
                kinds.append(1)
                blobs.append(C.pack(r=r[other], d=d[other], s=s[other].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(kinds, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "kind", "blob"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, known = [], []
        for batch in batches:
            for kind, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if kind:
                    known.append(C.unpack(b, np.int64, np.int64, np.int32))
                else:
                    got.append(C.unpack(b, np.int64, np.int64, np.int32, U64, U64))
        if got:
            d, r, s, h1, h2 = (np.concatenate([x[k] for x in got]) for k in range(5))
            other = firsts(d, r, s, h1, h2)[1]
            known.append([r[other], d[other], s[other]])
        if not known:
            return
        r, d, s = (np.concatenate([x[k] for x in known]) for k in range(3))
        to = r % width
        order = np.argsort(to, kind="stable")
        r, d, s, to = r[order], d[order], s[order], to[order]
        # one row for each task that gathers marks, however many rows they belong to
        for part in np.split(np.arange(len(to)), np.flatnonzero(np.diff(to)) + 1) if len(to) else ():
            yield pa.RecordBatch.from_arrays([pa.array([int(to[part[0]])], pa.int32()), pa.array([C.pack(r=r[part], d=d[part], s=s[part].astype(np.int32))], pa.binary())], names=["part", "blob"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [C.unpack(b, np.int64, np.int64, np.int32) for batch in batches for b in batch.column(1).to_pylist()]
        if got:
            yield from C.by_row(*(np.concatenate([x[k] for x in got]) for k in range(3)), ("rid", "did", "marks"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = C.buffers(batch.column(1))
            marks = batch.column(2).to_pylist()
            count, removed, kept = [], [], []
            for lo, hi in C.pieces(off):
                base = off[lo]
                row, start, _, _, _, _ = sentences(raw[base : off[hi]], off[lo : hi + 1] - base)
                at = np.searchsorted(row, np.arange(hi - lo + 1))
                for i in range(lo, hi):
                    own = start[at[i - lo] : at[i - lo + 1]] + base
                    text = raw[off[i] : off[i + 1]].tobytes()
                    count.append(len(own))
                    gone = np.zeros(len(own), bool)
                    if marks[i]:
                        s = np.unique(np.frombuffer(marks[i], np.int32))
                        for t in range(run):
                            gone[s[s % run >= t] // run + t] = True
                    removed.append(np.flatnonzero(gone).tolist())
                    if gone.any():
                        edge = np.append(own, off[i + 1]) - off[i]
                        text = text[: edge[0]] + b"".join(text[edge[k] : edge[k + 1]] for k in np.flatnonzero(~gone))
                    kept.append(text.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), pa.array(removed, pa.list_(pa.int32())), pa.array(kept, pa.string())], names=["doc_id", "n_sentences", "removed", "kept_text"])

    found = rows.select("doc_id", "rid", "text").mapInArrow(send, "part int, kind int, blob binary").repartitionById(width, "part").mapInArrow(settle, "part int, blob binary")
    marks = found.repartitionById(width, "part").mapInArrow(gather, "rid long, did long, marks binary")
    return rows.withColumn("did", F.coalesce("doc_id", F.lit(NO_ID))).join(marks, ["rid", "did"], "left").select("doc_id", "text", "marks").mapInArrow(cut, "doc_id long, n_sentences long, removed array<int>, kept_text string")
