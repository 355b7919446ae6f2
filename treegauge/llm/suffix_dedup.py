"""Removal of byte strings that repeat across documents, with suffix arrays built by two-stage sorting.

A string of `window` bytes that starts in two documents has the same minimizer in both: the least
hash of the 24-byte strings in it. So the texts are cut into runs of consecutive windows with one
minimizer, and only runs of one minimizer need be sorted together.

1. Equal texts stand as one, the row with the smallest doc_id; the others are covered whole.
   Every batch sends the hashes of its minimizers, each with one text that holds it; those of two
   texts or more are told back. Other texts of the batch with one know at once that it is shared.
2. Every such text sends its runs with such a minimizer. In each batch only the first holder (by
   doc_id) of a run sends it: what other documents of the batch hold is already known to repeat.
   So a passage of a million copies reaches its task once a batch.
3. Each task sorts the suffixes of its runs in parts of bounded size. Suffixes smaller than their
   successors are sorted directly; the others are induced by scanning the buckets of first bytes
   in order; adjacent common prefixes of `window` bytes or more then make the classes of equal
   strings. A string whose class has a smaller doc_id is covered.
4. The covered intervals go back to their documents.

A task holds its partition; partitions follow the size of docs, so that this doesn't grow with it. A row
is known by its doc_id and a hash of both its columns. A very long text is one worker's work,
at some hundred bytes of memory a byte; runs of one minimizer are sorted together, however many.

Nulls: a null text is empty. A null doc_id counts as larger than all others, so it can lose bytes
to them and they lose none to it; equal doc_ids lose none to each other. Repeated rows come out
once each, alike. Texts shorter than the window are left whole. Extra columns are ignored, whatever
their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

U64 = np.uint64
GRAM = 24
#: Bytes whose suffixes are sorted at once.
PART = 2 << 20
NO_ID = (1 << 63) - 1
#: The mark of a text that is covered whole: from 0 to -1.
WHOLE = np.array([0, -1], np.int32).tobytes()


def words8(t: np.ndarray, big: bool) -> np.ndarray:
    """The 8 bytes from each place of t on as an integer; t ends in zeros for this."""
    n = len(t)
    x = np.zeros(n + 8, U64)
    x[:n] = t
    for step in (1, 2, 4):
        y = x[: len(x) - step]
        x = (y << U64(8 * step)) | x[step:] if big else y | (x[step:] << U64(8 * step))
    return x[:n]


def runs(raw: np.ndarray, off: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(row, start in row, bytes, minimizer) of the maximal runs of windows with one minimizer."""
    n, lengths = len(raw), np.diff(off)
    long_rows = np.flatnonzero(lengths >= window)
    if not len(long_rows):
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(U64)
    x = words8(raw, False)
    h = C.mix(C.mix(x[: n - GRAM + 1] * C.ODD + x[8 : n - GRAM + 9]) + x[16 : n - GRAM + 17])
    wide, span = window - GRAM + 1, 1
    while span * 2 <= wide:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    if wide > span:
        h = np.minimum(h[: len(h) - (wide - span)], h[wide - span :])
    step = np.zeros(len(h) + 1, np.int8)
    step[off[long_rows]] += 1
    step[off[long_rows] + lengths[long_rows] - window + 1] -= 1
    valid = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
    turn = np.concatenate(([True], h[1:] != h[:-1]))
    first = np.flatnonzero(valid & (turn | ~np.concatenate(([False], valid[:-1]))))
    last = np.flatnonzero(valid & (np.concatenate((turn[1:], [True])) | ~np.concatenate((valid[1:], [False]))))
    row = np.searchsorted(off, first, "right") - 1
    return row, first - off[row], last - first + window, h[first]


def half(h: np.ndarray) -> np.ndarray:
    """The upper half of minimizers, the lower of which deals them out: two that are alike in it only cost a run sent in vain."""
    return (h >> U64(32)).astype(np.uint32)


def suffix_order(t: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of t in order; those alike for depth bytes stand together in any order."""
    n = len(t)
    if n < 2:
        return np.arange(n)
    place = np.arange(n - 1)
    differs = np.where(t[:-1] != t[1:], place, n)
    nxt = np.minimum.accumulate(differs[::-1])[::-1]
    rises = np.zeros(n, bool)  # smaller than its successor
    inner = nxt < n
    rises[:-1][inner] = t[nxt[inner]] < t[nxt[inner] + 1]

    pad = np.concatenate((t, np.zeros(depth + 16, np.uint8)))
    x = words8(pad, True)
    direct = np.flatnonzero(rises)
    key = x[direct]
    order = np.argsort(key)
    direct, key = direct[order], key[order]
    group = np.zeros(len(direct), np.int64)
    if len(direct):
        group[1:] = np.cumsum(key[1:] != key[:-1])
    at = 8
    while at < depth and len(direct):
        alone = np.ones(len(direct), bool)
        same = group[1:] == group[:-1]
        alone[1:] &= ~same
        alone[:-1] &= ~same
        tied = np.flatnonzero(~alone)
        if not len(tied):
            break
        dense = np.concatenate(([0], np.cumsum(np.diff(group[tied]) != 0)))
        key = (dense.astype(U64) << U64(40)) | (x[direct[tied] + at] >> U64(24))
        order = np.argsort(key)
        key = key[order]
        direct[tied] = direct[tied][order]
        new = np.ones(len(direct), bool)
        new[1:] = group[1:] != group[:-1]
        inside = tied[1:][key[1:] != key[:-1]]
        new[inside] = True
        group = np.cumsum(new) - 1
        at += 5

    firsts = t[direct]
    low = np.searchsorted(firsts, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[t[n - 1]].append(np.array([n - 1]))
    done = []
    for c in np.flatnonzero(np.bincount(t, minlength=256)):
        parts, cur = list(waiting[c]), np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        waiting[c] = []
        while len(cur):
            cur = cur[cur > 0] - 1
            cur = cur[(t[cur] == c) & ~rises[cur]]
            parts.append(cur)
        bucket = np.concatenate([*parts, direct[low[c] : low[c + 1]]])
        done.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[~rises[before] & (t[before] > c)]
        byte = t[before]
        order = np.argsort(byte, kind="stable")
        before, byte = before[order], byte[order]
        for part in np.split(before, np.flatnonzero(np.diff(byte)) + 1) if len(before) else ():
            waiting[t[part[0]]].append(part)
    return np.concatenate(done)


def long_prefixes(t: np.ndarray, order: np.ndarray, window: int) -> np.ndarray:
    """Whether each suffix of order shares window bytes with the one before it."""
    x = words8(np.concatenate((t, np.zeros(16, np.uint8))), True)
    steps = [*range(0, window - 7, 8), window - 8] if window >= 8 else []
    same = np.flatnonzero(np.ones(max(0, len(order) - 1), bool))
    for s in dict.fromkeys(steps):
        same = same[x[order[same] + s] == x[order[same + 1] + s]]
    if window < 8:
        same = same[(x[order[same]] ^ x[order[same + 1]]) >> U64(64 - 8 * window) == 0]
    out = np.zeros(len(order), bool)
    out[same + 1] = True
    return out


def covered(contents: list[bytes], docs: np.ndarray, window: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each content with covered windows: its index, the starts and the ends of the covered intervals."""
    t = np.frombuffer(b"".join(contents), np.uint8)
    ends = np.cumsum([len(x) for x in contents])
    starts = np.concatenate(([0], ends[:-1]))
    order = suffix_order(t, window)
    owner = np.searchsorted(ends, order, "right")
    whole = order + window <= ends[owner]
    order, owner = order[whole], owner[whole]
    if not len(order):
        return
    heads = np.flatnonzero(~long_prefixes(t, order, window))
    least = np.minimum.reduceat(docs[owner], heads)
    least = np.repeat(least, np.diff(np.concatenate((heads, [len(order)]))))
    hit = np.sort(order[least < docs[owner]])
    if not len(hit):
        return
    own = np.searchsorted(ends, hit, "right")
    new = np.flatnonzero(np.concatenate(([True], (hit[1:] > hit[:-1] + 1) | (own[1:] != own[:-1]))))
    last = np.concatenate((new[1:] - 1, [len(hit) - 1]))
    a, b, of = hit[new] - starts[own[new]], hit[last] - starts[own[new]] + window, own[new]
    for part in np.split(np.arange(len(of)), np.flatnonzero(np.diff(of)) + 1):
        yield int(of[part[0]]), a[part], b[part]


def repeated_spans(docs: DataFrame, window: int = 50) -> DataFrame:
    """(doc_id, n_bytes, spans array<struct<start,end>>, kept binary) for every row of docs (doc_id, text).

    spans are the maximal removed byte runs in order, kept the bytes that remain. window >= 32.
    """
    spark = docs.sparkSession
    C.prepare(spark)
    width = C.width_of(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("rid", F.xxhash64("doc_id", "text")).withColumn("tid", F.xxhash64("text"))

    def send_minimizers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tid, once = np.unique(batch.column(0).to_numpy(), return_index=True)
            raw, off = C.buffers(batch.column(1).take(pa.array(once)))
            hs, rs = [], []
            for lo, hi in C.pieces(off):
                row, _, _, h = runs(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], window)
                hs.append(h)
                rs.append(row + lo)
            h, r = np.concatenate(hs or [np.zeros(0, U64)]), np.concatenate(rs or [np.zeros(0, np.int64)])
            order = np.lexsort((r, h))
            h, r = h[order], r[order]
            if not len(h):
                continue
            head = np.concatenate(([True], h[1:] != h[:-1]))
            # others of the batch that hold the hash of the row before: known to be shared
            more = ~head & np.concatenate(([False], r[1:] != r[:-1]))
            many = np.add.reduceat(more, np.flatnonzero(head)) > 0
            lead_h, lead_t = h[head], tid[r[head]]
            to = (lead_h % U64(width)).astype(np.int64)
            order = np.lexsort((lead_t, to))
            lead_h, lead_t, many, to = lead_h[order], lead_t[order], many[order], to[order]
            names, kinds, blobs = [], [], []
            for part in np.split(np.arange(len(to)), np.flatnonzero(np.diff(to)) + 1):
                who, count = np.unique(lead_t[part], return_counts=True)
                names.append(int(to[part[0]]))
                kinds.append(0)
                blobs.append(C.pack(tid=who, n=count.astype(np.int32), many=np.packbits(many[part]), h=half(lead_h[part])))
            if more.any():
                order = np.argsort(tid[r[more]], kind="stable")
                who, count = np.unique(tid[r[more]], return_counts=True)
                names.append(int(tid[0] % width))
                kinds.append(1)
                blobs.append(C.pack(tid=who, n=count.astype(np.int32), h=half(h[more])[order]))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(kinds, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "kind", "blob"])

    def find_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = []
        for batch in batches:
            for kind, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if kind:
                    who, n, h = C.unpack(b, np.int64, np.int32, np.uint32)
                    tid = np.repeat(who, n)
                    yield from C.by_row(tid, tid, h, ("tid", "same", "shared"))
                else:
                    who, n, many, h = C.unpack(b, np.int64, np.int32, np.uint8, np.uint32)
                    got.append((np.repeat(who, n), np.unpackbits(many)[: len(h)], h))
        if not got:
            return
        tid, flag, h = (np.concatenate([x[k] for x in got]) for k in range(3))
        del got
        order = np.argsort(h, kind="stable")
        tid, flag, h = tid[order], flag[order], h[order]
        heads = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        sizes = np.diff(np.concatenate((heads, [len(h)])))
        shared = (np.minimum.reduceat(tid, heads) != np.maximum.reduceat(tid, heads)) | (np.maximum.reduceat(flag, heads) > 0)
        many = np.repeat(shared, sizes)
        yield from C.by_row(tid[many], tid[many], h[many], ("tid", "same", "shared"))

    def send_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs_, rid = batch.column(0).fill_null(NO_ID).to_numpy(), batch.column(1).to_numpy()
            raw, off = C.buffers(batch.column(2))
            shared = batch.column(3).to_pylist()
            first: dict[bytes, list] = {}
            for lo, hi in C.pieces(off):
                base = off[lo]
                row, start, size, h = runs(raw[base : off[hi]], off[lo : hi + 1] - base, window)
                for i, part in zip(range(lo, hi), np.split(np.arange(len(row)), np.searchsorted(row, np.arange(1, hi - lo))), strict=True):
                    own = np.frombuffer(b"".join(shared[i]), np.uint32)
                    part = part[np.isin(half(h[part]), own)]
                    text = raw[off[i] : off[i + 1]].tobytes()
                    for s, n, m in zip(start[part].tolist(), size[part].tolist(), h[part].tolist(), strict=True):
                        first.setdefault(text[s : s + n], [m]).append((docs_[i], rid[i], s))
            held: dict[int, list] = {}
            marks: list[tuple[int, int, int, int]] = []
            for content, (m, *at) in first.items():
                least = min(x[0] for x in at)
                keep = held.setdefault(m % width, [])
                for d, r, s in at:
                    if d == least:
                        keep.append((content, m, d, r, s))
                    else:
                        marks.append((r, d, s, s + len(content)))
            names, blobs = [], []
            for to, keep in held.items():
                names.append(to)
                blobs.append(C.pack(n=np.array([len(x[0]) for x in keep], np.int32), m=np.array([x[1] for x in keep], U64), d=np.array([x[2] for x in keep], np.int64), r=np.array([x[3] for x in keep], np.int64), s=np.array([x[4] for x in keep], np.int32), t=np.frombuffer(b"".join(x[0] for x in keep), np.uint8)))
            kinds = [0] * len(names)
            if marks:
                x = np.array(marks, np.int64)
                names.append(int(x[0, 0] % width))
                kinds.append(1)
                blobs.append(C.pack(r=x[:, 0], d=x[:, 1], a=x[:, 2].astype(np.int32), b=x[:, 3].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(kinds, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "kind", "blob"])

    def sort_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = []
        for batch in batches:
            for kind, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if kind:
                    r, d, x, y = C.unpack(b, np.int64, np.int64, np.int32, np.int32)
                    yield from C.by_row(r, d, np.stack((x, y), 1), ("rid", "did", "marks"))
                else:
                    got.append(C.unpack(b, np.int32, U64, np.int64, np.int64, np.int32, np.uint8))
        if not got:
            return
        n, m, d, r, s = (np.concatenate([x[k] for x in got]) for k in range(5))
        texts = b"".join(x[5].tobytes() for x in got)
        del got
        at = np.concatenate(([0], np.cumsum(n.astype(np.int64))))
        order = np.lexsort((d, m))
        total = np.cumsum(n[order].astype(np.int64))
        lo = 0
        while lo < len(order):
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + PART, "right")))
            while hi < len(order) and m[order[hi]] == m[order[hi - 1]]:  # a minimizer's runs stay together
                hi += 1
            held: dict[bytes, list[int]] = {}
            for i in order[lo:hi].tolist():
                held.setdefault(texts[at[i] : at[i + 1]], []).append(i)
            contents, marks = list(held), []
            least = np.array([d[who[0]] for who in held.values()], np.int64)
            owners = [[i for i in who if d[i] == d[who[0]]] for who in held.values()]
            for c, who in held.items():
                marks += [(r[i], d[i], s[i], s[i] + len(c)) for i in who if d[i] != d[who[0]]]
            for k, a, b in covered(contents, least, window):
                marks += [(r[i], d[i], s[i] + x, s[i] + y) for i in owners[k] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            if marks:
                x = np.array(marks, np.int64)
                yield from C.by_row(x[:, 0], x[:, 1], x[:, 2:].astype(np.int32), ("rid", "did", "marks"))
            lo = hi

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = C.buffers(batch.column(1))
            marks = batch.column(2).to_pylist()
            kept, spans = [], []
            for i, own in enumerate(marks):
                text = raw[off[i] : off[i + 1]]
                if not own:
                    kept.append(text.tobytes())
                    spans.append([])
                    continue
                x = np.frombuffer(b"".join(own), np.int32).reshape(-1, 2)
                step = np.zeros(len(text) + 1, np.int64)
                np.add.at(step, x[:, 0], 1)
                np.add.at(step, np.where(x[:, 1] < 0, len(text), x[:, 1]), -1)
                gone = np.cumsum(step[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate(([0], gone, [0]))))
                kept.append(text[~gone].tobytes())
                spans.append([{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(off)), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    sent = rows.select("tid", "text").mapInArrow(send_minimizers, "part int, kind int, blob binary")
    shared = sent.repartitionById(width, "part").mapInArrow(find_shared, "tid long, same long, shared binary").drop("same")
    id_ = F.coalesce("doc_id", F.lit(NO_ID))
    light = rows.select("rid", id_.alias("did"), "tid", F.xxhash64(F.lit(1), "text").alias("tid2"), F.octet_length("text").alias("n"))
    first = light.groupBy("tid", "tid2").agg(F.min(F.struct("did", "rid")).alias("f")).select("tid", "tid2", F.col("f.did").alias("first_doc"), F.col("f.rid").alias("first"))
    # one row of each text sends its runs
    asked = shared.join(first.select("tid", F.col("first").alias("rid"), F.col("first_doc").alias("did")), "tid").groupBy("rid", "did").agg(F.collect_list("shared").alias("shared"))
    some = rows.select("doc_id", "rid", "text", id_.alias("did")).join(asked, ["rid", "did"]).select("doc_id", "rid", "text", "shared")
    parts = some.mapInArrow(send_runs, "part int, kind int, blob binary").repartitionById(width, "part").mapInArrow(sort_runs, "rid long, did long, marks binary")
    copies = light.join(first, ["tid", "tid2"]).where("rid <> first or did <> first_doc").where(F.col("n") >= window)
    whole = copies.where(F.col("did") > F.col("first_doc")).select("rid", "did").distinct().withColumn("marks", F.lit(WHOLE))
    marks = parts.union(whole).groupBy("rid", "did").agg(F.collect_list("marks").alias("marks"))
    return rows.select("doc_id", "rid", "text", id_.alias("did")).join(marks, ["rid", "did"], "left").select("doc_id", "text", "marks").mapInArrow(cut, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
