"""Language identification by error-correcting output codes.

Every learned language has a codeword of bits. For each bit a logistic classifier is fitted on
hashed byte n-grams (2, 3 and 4 bytes of the letters, A-Z and other letters in lower case, a space
between words). A text's margins are decoded against all codewords with the logistic loss, each
bit weighted by its classifier's accuracy on the training rows; the nearest codeword wins. score is
the softmax share of the winner's loss; a text is ambiguous if the runner-up is within `margin`.

Up to 7 languages have the exhaustive code (2 ** (k - 1) - 1 bits), more have seeded random codes
of 10 * log2(k) bits. The classifiers are fitted on at most `sample` rows, taken by the least hashes
of doc_id in equal parts of the languages, and on whole texts: this is the operator's documented
bound. Of more than `sample` languages, the most frequent ones are learned. Prediction reads only
the text.

Nulls: a null text, or one without a letter (Unicode's L categories; number characters such as a half or a
Roman numeral are none), is `und` with score 0. Of equal losses the first language wins, and the text is ambiguous. Rows with a null text or lang
aren't learned from. With one language learned, it is the answer to every text with a letter; with
none, `und`. Repeated rows, null doc_ids and extra columns pass through; a column with the name of a
result (lang_pred, score, ambiguous) gets a _ behind. A very long text is one worker's work, at some
ten bytes of memory a byte. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

DIM = 1 << 13
GAP = re.compile(r"[\W\d_]+")


def features(texts: list[str]) -> np.ndarray:
    """Square roots of hashed n-gram counts, of length 1."""
    out = np.zeros((len(texts), DIM), np.float32)
    for i, text in enumerate(texts):
        b = np.frombuffer((" " + GAP.sub(" ", text.lower()) + " ").encode("utf-8", "replace"), np.uint8).astype(np.uint32)
        two = b[:-1] << 8 | b[1:]
        three = two[:-1] << 8 | b[2:]
        four = three[:-1] << 8 | b[3:]
        at = np.concatenate([(g * np.uint32(k)) >> np.uint32(32 - 13) for g, k in ((two, 0x9E3779B1), (three, 0x85EBCA77), (four, 0xC2B2AE3D))])
        row = np.sqrt(np.bincount(at, minlength=DIM))
        out[i] = row / max(1e-9, float(np.linalg.norm(row)))
    return out


def codewords(k: int, seed: int = 3) -> np.ndarray:
    """A row of +1 and -1 for each of k languages; no column is constant."""
    if k < 2:
        return np.ones((k, 0))
    if k <= 7:
        columns = [(1, *bits) for bits in itertools.product((1, -1), repeat=k - 1) if -1 in bits]
        return np.array(columns).T
    rng = np.random.default_rng(seed)
    tries = [rng.choice((-1, 1), (k, math.ceil(10 * math.log2(k)))) for _ in range(200)]
    tries = [t[:, np.abs(t.sum(0)) < k] for t in tries]
    apart = lambda t: min((int((t[i] != t[j]).sum()) for i in range(k) for j in range(i)), default=0)
    return max(tries, key=apart)


class Model:
    """What fit() learned: languages, their codewords, a weight column and a trust for each bit."""

    def __init__(self, langs: list[str], codes: np.ndarray, weights: np.ndarray, trust: np.ndarray) -> None:
        self.langs, self.codes, self.weights, self.trust = langs, codes, weights, trust

    def losses(self, x: np.ndarray) -> np.ndarray:
        """The weighted loss of every codeword for rows of features."""
        m = np.concatenate([x, np.ones((len(x), 1), np.float32)], 1) @ self.weights
        return np.stack([(np.logaddexp(0, -m * code) * self.trust).sum(1) for code in self.codes], 1)


def fit(texts: list[str], langs: list[str], steps: int = 150, rate: float = 40.0, decay: float = 1e-6) -> Model:
    names = sorted(set(langs))
    codes = codewords(len(names))
    weights, trust = np.zeros((DIM + 1, codes.shape[1]), np.float32), np.ones(codes.shape[1])
    if len(names) > 1:
        x = np.concatenate([features(texts), np.ones((len(texts), 1), np.float32)], 1)
        y = codes[[names.index(v) for v in langs]].astype(np.float32)
        speed = np.zeros_like(weights)
        for _ in range(steps):
            slope = x.T @ (-y / (1 + np.exp(np.clip(y * (x @ weights), -30, 30)))) / len(x) + decay * weights
            speed = 0.9 * speed - rate * 0.1 * slope
            weights = weights + speed
        right = ((x @ weights) * y > 0).mean(0)
        trust = np.maximum(right - 0.5, 0.01)
        trust = trust / trust.sum() * len(trust)
    return Model(names, codes, weights, trust)


def learn(docs: DataFrame, training: Column, sample: int = 2000) -> Model:
    """Fits on at most sample of the rows of docs (doc_id, text, lang) for which training holds."""
    d = docs.select("doc_id", "text", "lang", training.alias("training")).where("training and lang is not null and text is not null").drop("training")
    counts = {r[0]: r[1] for r in d.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max(1, sample)).collect()}
    if not counts:
        return fit([], [])
    each, order = max(1, sample // len(counts)), F.xxhash64(F.lit(17), "doc_id")
    # a row is a candidate if its hash is below its language's part of all hashes: so few that their texts can be looked at
    part, want, got = {k: min(1.0, (2 * each + 30) / n) for k, n in counts.items()}, list(counts), {}
    while want:
        low = F.lit(False)
        for lang in want:
            below = -(1 << 63) + int(part[lang] * 2**64)
            low = low | ((F.col("lang") == lang) & ((order < F.lit(below)) if part[lang] < 1 else F.lit(True)))
        first = Window.partitionBy("lang").orderBy("h", "text")
        seen = d.where(low).where(F.col("text").rlike(r"\p{L}")).select("lang", "text", order.alias("h")).withColumn("k", F.row_number().over(first)).where(F.col("k") <= each)
        for r in seen.orderBy("lang", "k").collect():
            got.setdefault(r["lang"], {})[r["k"]] = r["text"]
        want = [k for k in want if len(got.get(k, ())) < each and part[k] < 1]
        part.update({k: min(1.0, 4 * part[k]) for k in want})
    rows = [(text, lang) for lang in sorted(got) for _, text in sorted(got[lang].items())]
    return fit([x for x, _ in rows], [x for _, x in rows])


def identify(docs: DataFrame, model: Model, margin: float = 0.15) -> DataFrame:
    """docs with all its columns and lang_pred, score, ambiguous."""
    spark = docs.sparkSession
    C.prepare(spark)
    held = spark.sparkContext.broadcast((model.langs, model.codes, model.weights, model.trust))
    at, added = docs.columns.index("text"), ("lang_pred", "score", "ambiguous")
    docs = docs.toDF(*C.kept_names(docs.columns, added))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*held.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = part.column(at).to_pylist()
                known = [i for i, t in enumerate(texts) if t and m.langs and any(map(str.isalpha, t))]
                lang, score, ambiguous = ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
                if known:
                    loss = m.losses(features([texts[i] for i in known]))
                    share = np.exp(loss.min(1, keepdims=True) - loss)
                    share /= share.sum(1, keepdims=True)
                    order = np.sort(share, 1)
                    for i, best, top, second in zip(known, loss.argmin(1), order[:, -1], order[:, -2] if len(m.langs) > 1 else np.zeros(len(known)), strict=True):
                        lang[i], score[i], ambiguous[i] = m.langs[best], float(top), bool(top - second < margin)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang), pa.array(score), pa.array(ambiguous)], names=[*names, *added])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{kinds}, lang_pred string, score double, ambiguous boolean")
