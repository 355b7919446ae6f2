"""Alignment of two tokenizers over the bytes of each text, scored by what the whole corpus links.

A text is encoded by a byte-level BPE (A, of a space and the text) and by a sentencepiece BPE (B, which
adds the space itself). Byte offsets where a token of both ends cut the text into groups; in a group
every token occurrence of A is linked with every one of B. A pair of ids counts in how many documents
it is linked.

Both tokenizers cut before every space that follows and precedes something else than white space, so a
text is encoded chunk by chunk, and a worker keeps the alignments of the chunks it has met, up to
`chunks`. The postings (pair, document, multiplicity) of up to `flush` characters of texts are packed into
one row for each of `sides` classes of A ids. Then come two shuffles:

* the postings' pair sizes, summed by pair: counts, and their maximum by A id;
* a cogroup by side: postings and counts of a class of A ids meet in one partition, sorted by the JVM,
  which can spill; counts come first and are held, postings are streamed. Postings are salted by where
  they were made and counts are repeated for every salt, so that a frequent id is many tasks' work.

The documents' contributions are then summed by document. Counts held by a task are bounded by the pairs
of the two vocabularies, never by the documents.

Each row is a document: repeated rows, and rows of one doc_id, count for themselves. A null doc_id stays
null. Texts that are null, empty, or not given back byte for byte by both tokenizers have no tokens: zeros,
an empty groups_sha256, and no part in the counts. Of equal counts of one A id all are best. A very long text is one
worker's work, at some tens of bytes of memory a token; a very long chunk is encoded but not kept. Extra
columns are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: The longest chunk that is remembered, in characters; rows packed together at most; characters of chunks encoded in a row.
KEPT, ROWS, RUN = 200, 60_000, 20_000
ENCODED = "flush long, place int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, side int, pairs binary, posts binary"
CUT = re.compile(r"(?<=\S)(?= +\S)")


def printed_bytes() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others from U+0100 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Pair:
    """Two tokenizers, the bytes of their tokens, and what their ids read like in groups."""

    def __init__(self, byte_file: str, piece_file: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(byte_file), sentencepiece.SentencePieceProcessor(model_file=piece_file)
        self.a.encode_special_tokens = True
        of = printed_bytes()
        a = {i: bytes(of[c] for c in t) if all(c in of for c in t) else t.encode() for t, i in self.a.get_vocab().items()}
        self.a_bytes = [a.get(i, b"") for i in range(max(a) + 1)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i in range(self.b.get_piece_size()) for p in [self.b.id_to_piece(i)]]
        self.a_size, self.b_size = (np.array([len(t) for t in x]) for x in (self.a_bytes, self.b_bytes))
        # an id of A before another and as the last of its group, then the same of B
        self.said = [b"%d%c" % (i, c) for n, c in ((len(a), b","), (len(a), b"|"), (len(self.b_bytes), b","), (len(self.b_bytes), b";")) for i in range(n)]

    def encoded(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of A and B for texts that begin with a space; None where the tokens aren't the text's bytes."""
        out = []
        for text, a, b in zip(texts, self.a.encode_batch_fast(texts, add_special_tokens=False), self.b.encode([t[1:] for t in texts], num_threads=1), strict=True):
            a, whole = a.ids, text.encode("utf-8", "surrogatepass")
            same = b"".join([self.a_bytes[i] for i in a]) == whole == b"".join([self.b_bytes[i] for i in b])
            out.append((np.array(a, np.int64), np.array(b, np.int64)) if same else None)
        return out


class Chunks:
    """Alignments of chunks by number: the text of their groups, their sizes, their pairs and multiplicities."""

    def __init__(self, pair: Pair, limit: int) -> None:
        self.pair, self.limit = pair, limit
        self.begin()

    def begin(self) -> None:
        self.number: dict[str, int] = {}
        self.said: list[bytes] = []
        self.sizes, self.pairs, self.times, self.edge = array("q"), array("q"), array("q"), array("q", [0])
        self.known: dict[int, int] = {}
        self.codes = array("q")

    def add(self, keys: list[str]) -> None:
        """Aligns chunks; a key that begins with a space is a chunk with its space, another one lacks it.

        Chunks are encoded in runs, since both tokenizers cut between them, but for those that end in white
        space or hold the word mark. A run that a tokenizer doesn't give back is encoded chunk by chunk.
        """
        runs, held, size = [], [], 0
        for key in keys:
            text = key if key[:1] == " " else " " + key
            if text[-1].isspace() or "▁" in text:
                runs.append([(key, text)])
                continue
            held.append((key, text))
            size += len(text)
            if size > RUN:
                runs.append(held)
                held, size = [], 0
        if held:
            runs.append(held)
        again = []
        for todo in (runs, again):
            got = self.pair.encoded(["".join([t for _, t in run]) for run in todo])
            fine = []
            for run, ids in zip(todo, got, strict=True):
                if ids is None and len(run) > 1:
                    again += [[x] for x in run]
                elif ids is None:
                    self.keep([run[0][0]], [b""], np.array([[-1, 0, 0, 0]]), *[np.zeros(0, np.int64)] * 3)
                else:
                    fine.append((run, ids))
            if fine:
                self.align([x for run, _ in fine for x in run], *(np.concatenate([ids[k] for _, ids in fine]) for k in (0, 1)))

    def align(self, chunks: list[tuple[str, str]], a: np.ndarray, b: np.ndarray) -> None:
        """Cuts the ids of chunks in a row into groups."""
        end = np.cumsum([len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass")) for _, t in chunks])
        to_a, to_b = np.cumsum(self.pair.a_size[a]), np.cumsum(self.pair.b_size[b])
        common = to_a[to_b[np.searchsorted(to_b, to_a)] == to_a]
        of_a, of_b, of = np.searchsorted(common, to_a), np.searchsorted(common, to_b), np.searchsorted(end, common)
        n, groups = len(chunks), len(common)
        n_a, n_b = np.bincount(of_a, minlength=groups), np.bincount(of_b, minlength=groups)
        sizes = np.stack([np.bincount(of, x, n).astype(np.int64) for x in (n_a, n_b, np.ones(groups), n_a * n_b)], 1)
        # links: every token of A with every one of B of its group
        many = n_b[of_a]
        first = (np.cumsum(n_b) - n_b)[of_a]
        at = np.arange(many.sum()) + np.repeat(first - (np.cumsum(many) - many), many)
        code, which = np.unique(np.repeat(a, many) << 32 | b[at], return_inverse=True)
        link, times = np.unique(np.repeat(of[of_a], many) * len(code) + which, return_counts=True)
        # what the groups read like: tokens of A, then of B, group by group
        last_a, last_b = np.append(of_a[1:] != of_a[:-1], True), np.append(of_b[1:] != of_b[:-1], True)
        big = len(self.pair.a_bytes)
        word = np.concatenate((a + big * last_a, b + 2 * big + len(self.pair.b_bytes) * last_b))
        order = np.argsort(np.concatenate((2 * of_a, 2 * of_b + 1)), kind="stable")
        words = [self.pair.said[i] for i in word[order].tolist()]
        stop = np.cumsum(sizes[:, 0] + sizes[:, 1]).tolist()
        said = [b"".join(words[i:j]) for i, j in zip([0, *stop], stop, strict=False)]
        self.keep([k for k, _ in chunks], said, sizes, code, link, times)

    def keep(self, keys: list[str], said: list[bytes], sizes: np.ndarray, code: np.ndarray, link: np.ndarray, times: np.ndarray) -> None:
        """Takes up aligned chunks; link: a chunk's place times the number of codes, plus that of a code."""
        self.number.update(zip(keys, range(len(self.said), len(self.said) + len(keys)), strict=True))
        self.said += said
        self.sizes.frombytes(np.ascontiguousarray(sizes, np.int64).tobytes())
        for c in code.tolist():
            if c not in self.known:
                self.known[c] = len(self.codes)
                self.codes.append(c)
        place = np.array([self.known[c] for c in code.tolist()], np.int64)
        n = max(1, len(code))
        self.edge.frombytes((len(self.pairs) + np.searchsorted(link // n, np.arange(1, len(keys) + 1))).astype(np.int64).tobytes())
        self.pairs.frombytes(place[link % n].astype(np.int64).tobytes() if len(link) else b"")
        self.times.frombytes(times.astype(np.int64).tobytes())

    def numbers(self, texts: list[str]) -> list[list[int]]:
        """The chunks of each text, in order."""
        if len(self.said) > self.limit:
            self.begin()
        split, new = [], {}
        for text in texts:
            keys = text.split(" ")
            fresh = [k for k in keys if k not in self.number]
            if any(not k or k[0].isspace() or k[-1].isspace() for k in fresh):
                keys = fresh = CUT.split(" " + text)
                fresh = [k for k in keys if k not in self.number]
            new.update(dict.fromkeys(fresh))
            split.append(keys)
        if new:
            self.add(list(new))
        out = [[self.number[k] for k in keys] for keys in split]
        for k in [k for k in new if len(k) > KEPT]:
            del self.number[k]
        return out


def table(x: array) -> np.ndarray:
    return np.array(x, np.int64)


def packed(chunks: Chunks, sides: int, flush: int, ids: list[int | None], texts: list[str]) -> Iterator[pa.RecordBatch]:
    """The documents' rows and the postings of one flush."""
    own = chunks.numbers([t for t in texts if t])
    lists = iter(own)
    of = [next(lists) if t else [] for t in texts]
    size = table(chunks.sizes).reshape(-1, 4)
    flat = np.fromiter((c for x in of for c in x), np.int64, sum(map(len, of)))
    doc = np.repeat(np.arange(len(of)), [len(x) for x in of])
    bad = np.zeros(len(of), bool)
    bad[doc[size[flat, 0] < 0]] = True
    good = ~bad[doc]
    flat, doc = flat[good], doc[good]
    sums = [np.bincount(doc, size[flat, k], len(of)).astype(np.int64) for k in range(4)]
    sha = [hashlib.sha256(b"".join([chunks.said[c] for c in x])[:-1]).hexdigest() if x and not bad[i] else "" for i, x in enumerate(of)]
    n = len(of)
    blank = {"side": pa.nulls(n, pa.int32()), "pairs": pa.nulls(n, pa.binary()), "posts": pa.nulls(n, pa.binary())}
    yield pa.RecordBatch.from_pydict({"flush": pa.array([flush] * n, pa.int64()), "place": pa.array(range(n), pa.int32()), "doc_id": pa.array(ids, pa.int64()), **{k: pa.array(v) for k, v in zip(("n_a", "n_b", "n_groups", "n_links"), sums, strict=True)}, "groups_sha256": pa.array(sha, pa.string()), **blank})
    if not len(flat):
        return

    # (document, chunk, times), then (pair, document, times)
    key, times = np.unique(doc << 32 | flat, return_counts=True)
    doc, chunk = key >> 32, key & 0xFFFFFFFF
    edge = table(chunks.edge)
    lo, many = edge[chunk], edge[chunk + 1] - edge[chunk]
    at = np.arange(many.sum()) + np.repeat(lo - np.concatenate(([0], np.cumsum(many)[:-1])), many)
    key = table(chunks.pairs)[at] * n + np.repeat(doc, many)
    times = table(chunks.times)[at] * np.repeat(times, many)
    order = np.argsort(key, kind="stable")
    key, times = key[order], times[order]
    head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    key, times = key[head], np.add.reduceat(times, head)
    code = table(chunks.codes)[key // n]
    side = (code >> 32) % sides
    order = np.lexsort((key % n, code, side))
    code, side, doc, times = code[order], side[order], (key % n)[order].astype(np.uint16), times[order]
    rows = []
    for s in np.unique(side):
        a, b = np.searchsorted(side, (s, s + 1))
        head = np.flatnonzero(np.concatenate(([True], code[a + 1 : b] != code[a : b - 1])))
        great = np.flatnonzero(times[a:b] > 254)
        pairs = C.pack(code=code[a:b][head], docs=np.diff(np.append(head, b - a)).astype(np.int32))
        rows.append((int(s), pairs, C.pack(doc=doc[a:b], times=np.minimum(times[a:b], 255).astype(np.uint8), at=great, great=times[a:b][great])))
    n = len(rows)
    stats = {k: pa.nulls(n, pa.int64()) for k in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
    yield pa.RecordBatch.from_pydict({"flush": pa.array([flush] * n, pa.int64()), "place": pa.nulls(n, pa.int32()), **stats, "groups_sha256": pa.nulls(n, pa.string()), "side": pa.array([r[0] for r in rows], pa.int32()), "pairs": pa.array([r[1] for r in rows], pa.binary()), "posts": pa.array([r[2] for r in rows], pa.binary())})


_CHUNKS: dict[tuple[str, str, int], Chunks] = {}


def aligned(docs: DataFrame, byte_file: str, piece_file: str, chunks: int = 300_000, flush: int = 4 << 20, sides: int = 16) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    C.prepare(spark, 200)  # rows of postings hold up to some hundred kB
    salts, key = max(1, C.shuffle_width(spark) // sides), (byte_file, piece_file, chunks)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _CHUNKS:
            _CHUNKS.clear()
            _CHUNKS[key] = Chunks(Pair(byte_file, piece_file), chunks)
        number, held, ids, texts = TaskContext.get().partitionId() << 32, 0, [], []
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(i)
                texts.append(t or "")
                held += len(texts[-1])
                if held >= flush or len(texts) >= ROWS:
                    yield from packed(_CHUNKS[key], sides, number, ids, texts)
                    number, held, ids, texts = number + 1, 0, [], []
        if texts:
            yield from packed(_CHUNKS[key], sides, number, ids, texts)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [C.unpack(b, np.int64, np.int32) for b in batch.column(0).to_pylist()]
            if got:
                code, at = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
                n = np.bincount(at, np.concatenate([g[1] for g in got])).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"code": pa.array(code), "docs": pa.array(n)})

    def contribute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per partition: counts of its side first, then its postings by flush."""
        held, side, code, count, best = [], None, None, None, None
        for batch in batches:
            sides, flushes, pairs, posts, bests = (batch.column(k).to_pylist() for k in ("side", "flush", "pairs", "posts", "best"))
            codes, docs_of = batch.column("codes"), batch.column("docs")
            for i, s in enumerate(sides):
                if s != side:
                    side, held, code = s, [], None
                if bests[i] is not None:
                    x = codes[i].values.to_numpy()
                    held.append((x, docs_of[i].values.to_numpy(), np.full(len(x), bests[i])))
                    continue
                if code is None:
                    code, count, best = (np.concatenate([h[k] for h in held]) for k in range(3))
                    order = np.argsort(code)
                    code, count, best, held = code[order], count[order], best[order], []
                own, holders = C.unpack(pairs[i], np.int64, np.int32)
                doc, times, at, great = C.unpack(posts[i], np.uint16, np.uint8, np.int64, np.int64)
                times, doc = times.astype(np.int64), doc.astype(np.int64)
                times[at] = great
                k = np.searchsorted(code, own)
                n = int(doc.max()) + 1
                total, top = np.zeros(n, np.int64), np.zeros(n, np.int64)
                np.add.at(total, doc, times * np.repeat(count[k], holders))
                np.add.at(top, doc, times * np.repeat(count[k] == best[k], holders))
                some = np.flatnonzero(total)
                yield pa.RecordBatch.from_pydict({"flush": pa.array(np.full(len(some), flushes[i])), "place": pa.array(some.astype(np.int32)), "count_sum": pa.array(total[some]), "n_best": pa.array(top[some])})

    made = C.materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(encode, ENCODED))
    posts = made.where("side is not null")
    counts = posts.select("pairs").mapInArrow(sizes, "code long, docs long").groupBy("code").agg(F.sum("docs").alias("docs")).withColumn("a", F.shiftright("code", 32))
    # an A id has at most as many pairs as B has ids, and so has a row of known
    known = counts.groupBy("a").agg(F.collect_list(F.struct("code", "docs")).alias("x"), F.max("docs").alias("best"))
    known = known.select(F.pmod("a", F.lit(sides)).cast("int").alias("side"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.col("x.code").alias("codes"), F.col("x.docs").alias("docs"), "best")
    dealt = posts.select("side", F.pmod(F.xxhash64("flush"), F.lit(salts)).cast("int").alias("salt"), "flush", "pairs", "posts")
    both = dealt.unionByName(known, allowMissingColumns=True).withColumn("part", F.col("salt") * sides + F.col("side"))
    streams = both.repartitionById(salts * sides, "part").sortWithinPartitions(F.col("part"), F.col("best").isNull(), F.col("flush")).drop("part", "salt")
    shares = streams.mapInArrow(contribute, "flush long, place int, count_sum long, n_best long")
    none = F.lit(None)
    every = made.where("place is not null").select("flush", "place", F.lit(1).alias("is_doc"), "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", F.lit(0).cast("long").alias("count_sum"), F.lit(0).cast("long").alias("n_best"))
    every = every.union(shares.select("flush", "place", none.cast("int"), *[none.cast("long")] * 5, none.cast("string"), "count_sum", "n_best"))
    firsts = [F.max(c).alias(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")]
    return every.groupBy("flush", "place").agg(*firsts, F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
