"""The corpus operators against brute force on small fixtures, with nulls, ties, empty and odd texts."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from treegauge.llm import common as C
from treegauge.llm.chat_format import formatted, masked, read_back, text_parts
from treegauge.llm.decontam import contamination, decontaminate, is_contaminated
from treegauge.llm.lang_ecoc import codewords, identify, learn
from treegauge.llm.minhash_tensor import near_duplicates
from treegauge.llm.mixing import blocks, mix
from treegauge.llm.nn_descent import near_vectors
from treegauge.llm.queries import op8_span_dedup
from treegauge.llm.sharding import sharded
from treegauge.llm.span_dedup import repeated_sentences
from treegauge.llm.suffix_dedup import long_prefixes, repeated_spans, suffix_order
from treegauge.llm.token_trie import MARK, Trie, token_counts

LOWER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, component long, rid long, n int"


def corpus(seed=1, n=60):
    """Texts with copies, near copies and shared passages; then null, empty, blank, odd and repeated rows."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghiklmnoprstuvé", k=rng.randint(2, 9))) for _ in range(400)]
    line = lambda k: " ".join(rng.choices(words, k=k)).capitalize() + rng.choice([". ", ".\n", "! "])
    passage = "".join(line(9) for _ in range(6))
    texts = ["".join(line(rng.randint(3, 12)) for _ in range(rng.randint(1, 14))) for _ in range(n)]
    texts += [texts[i] for i in range(8)]
    for i in range(8, 20):
        w = texts[i].split(" ")
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [line(5) + passage + line(4) for _ in range(6)]
    texts += ["", "   \n", "one", "ONE", "a" * 500, "a" * 700, "x y", None, "...", "\u00e9\u00e8 \U0001f600 \u00e9"]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["s0", "s0", "s1", "s2", None]), 0, 0, 0) for i, t in zip(ids, texts, strict=True)]
    return [*rows, rows[0], rows[3], (None, texts[0], "en", "s0", 0, 0, 0), (None, None, None, None, 0, 0, 0)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_by_id(rows):
    return {r[0]: r[1] or "" for r in rows if r[0] is not None}


def test_suffix_order_is_sorted():
    for seed in range(30):
        rng = np.random.default_rng(seed)
        t = rng.integers(97, 97 + 1 + seed % 4, 300).astype(np.uint8)
        b, order = t.tobytes(), suffix_order(t, 50)
        assert sorted(order.tolist()) == list(range(300))
        cut = [b[i : i + 50] for i in order]
        assert cut == sorted(cut)
        full = order[order + 50 <= 300]
        assert long_prefixes(t, full, 50).tolist()[1:] == [b[x : x + 50] == b[y : y + 50] for x, y in zip(full, full[1:], strict=False)]


def test_suffix_dedup(docs, rows, empty):
    want, first = {}, {}
    by_id = texts_by_id(rows)
    for d in sorted(by_id):
        b = by_id[d].encode()
        for i in range(len(b) - 49):
            first.setdefault(b[i : i + 50], d)
    for d, t in by_id.items():
        b = t.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        want[d] = (len(b), bytes(x for x, g in zip(b, gone, strict=True) if not g), len(re.findall(b"\1+", bytes(gone))))
    got = repeated_spans(docs).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_bytes, bytes(r.kept), len(r.spans)) for r in got if r.doc_id is not None} == want
    assert sorted(bytes(r.kept) for r in got if r.doc_id is None)[0] == b""
    assert repeated_spans(empty).count() == 0


def test_span_dedup(docs, rows, empty):
    cut = lambda t: [x for x in re.split(r"\n", re.sub(r"([.!?])[ \t\n\v\f\r]+", "\\1\n", t)) if x.strip(" \t\v\f\r")]
    plain = lambda x: re.sub(r"[ \t\n\v\f\r]", "", x.translate(LOWER))
    by_id, first = texts_by_id(rows), {}
    held = {d: [plain(x) for x in cut(t)] for d, t in sorted(by_id.items())}
    for d, s in held.items():
        for k in range(len(s) - 2):
            first.setdefault(tuple(s[k : k + 3]), (d, k))
    got = repeated_sentences(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            s = held[r.doc_id]
            gone = sorted({k + t for k in range(len(s) - 2) if first[tuple(s[k : k + 3])] != (r.doc_id, k) for t in range(3)})
            assert (r.n_sentences, r.removed) == (len(s), gone)
            assert [plain(x) for x in cut(r.kept_text)] == [x for i, x in enumerate(s) if i not in gone]
    assert repeated_sentences(empty).count() == 0


def test_span_dedup_fewer_sentences(spark):
    long = " ".join(f"w{i}" for i in range(60)) + "."
    half = [" ".join(f"{c}{i}" for i in range(30)) + "." for c in "pq"]
    texts = [
        "Some start. " + long + " Its end. And more.",
        "Another. Thing. " + long.upper() + "\nThen this. That.",
        "Before. " + " ".join(half) + " After. More.",
        " ".join(half),
        "Two here. Only two.",
        "two  here.\nonly two.",
        "Well. Two here. Only two. Indeed.",
        long,
        half[0] + " Not " + half[1] + " But longer. On.",
        "Two here.",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in repeated_sentences(df, words=50, short=True).collect()}
    assert {d: r.removed for d, r in got.items() if r.removed} == {1: [2], 3: [0, 1], 5: [0, 1], 7: [0]}
    assert got[7].kept_text == "" and got[1].kept_text == "Another. Thing. Then this. That."
    # what the query gives: it counts a sentence of over 15 words, so that of document 8 too
    path = spark.conf.get("spark.checkpoint.dir") + "/short"
    df.write.mode("overwrite").parquet(f"{path}/documents.parquet")
    assert {r.doc_id: r.removed for r in op8_span_dedup(spark, path).collect() if r.n_removed} == {1: "2", 3: "0,1", 5: "0,1", 7: "0", 8: "0"}


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset([tuple(w)] if 0 < len(w) < n else zip(*(w[i:] for i in range(n)), strict=False)) if w else frozenset()


@pytest.mark.parametrize("n", [2, 5])
def test_minhash(docs, rows, empty, n):
    sets = {d: shingles(t, n) for d, t in texts_by_id(rows).items()}
    root = {d: d for d in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    got = near_duplicates(docs, words=n).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None} == {d: (len(s), top(d), top(d) == d) for d, s in sets.items()}
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    assert near_duplicates(empty).count() == 0


def test_decontamination(spark, docs, rows, empty):
    by_id = texts_by_id(rows)
    some = sorted(by_id.values(), key=len)[-20:]
    items = [(i, " ".join(t.split()[3:22])) for i, t in enumerate(some)] + [(90, "ONE"), (91, None), (92, "..."), (None, "x y"), (93, some[0][:80]), (93, some[0][:80])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for i, t in items:
        w = word.findall((t or "").translate(LOWER))
        k = min(13, len(w))
        for s in range(len(w) - k + 1) if k else ():
            windows.setdefault(tuple(w[s : s + k]), set()).add(i)
    got = contamination(docs, bench).withColumn("bad", is_contaminated(F.col("n_hit"), F.col("n_words"))).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            continue
        w, hit, own = word.findall(by_id[r.doc_id].translate(LOWER)), set(), set()
        for k in {len(x) for x in windows}:
            for s in range(len(w) - k + 1):
                if tuple(w[s : s + k]) in windows:
                    hit |= set(range(s, s + k))
                    own |= windows[tuple(w[s : s + k])] - {None}
        assert (r.n_words, r.n_hit, sorted(r.items)) == (len(w), len(hit), sorted(own))
        assert {x for s in r.spans for x in range(s.start, s.end)} == hit
    clean = decontaminate(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(not r.bad for r in got)
    cut = contamination(decontaminate(docs, bench, how="spans"), bench)
    assert cut.count() == len(rows)
    assert contamination(empty, bench).count() == 0
    assert contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_mixing(docs, rows, empty):
    got = mix(docs, entropy=0.98, max_repeats=3.0)
    assert got.columns == [*docs.columns, "source_weight", "copies"] and got.count() == len(rows)
    tokens = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    held = got.collect()
    share, shown, weight = {}, {}, {}
    for r in held:
        share[r.source] = share.get(r.source, 0) + tokens(r.text)
        shown[r.source] = shown.get(r.source, 0) + tokens(r.text) * r.copies
        weight[r.source] = r.source_weight
        assert 1 <= r.copies <= 3
    assert sum(weight.values()) == pytest.approx(1)
    # weights are a power of shares, and what is shown follows them up to one document
    total = sum(share.values())
    a = {round(np.log(weight[x] / weight["s0"]) / np.log(share[x] / share["s0"]), 6) for x in share if x != "s0"}
    assert len(a) == 1 and 0 <= min(a) <= 1
    longest = max(tokens(r.text) for r in held)
    budget = max(share[x] / weight[x] for x in share)
    assert total <= budget * 1.000001
    for x in share:
        assert weight[x] * budget - 3 * longest <= shown[x] <= weight[x] * budget + 1
    b = blocks(docs, entropy=0.98, max_repeats=3.0)
    assert b.count() == sum(r.copies for r in held)
    assert blocks(docs, budget=float(total) / 2).count() < b.count()
    assert mix(empty).count() == 0 and blocks(empty).count() == 0


def test_sharding(spark, docs, rows, empty):
    for df, n in ((docs, len(rows)), (spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot text " * 9)).otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text")), 3000)):
        got = sharded(df, shards=4).collect()
        assert len(got) == n
        size = [0] * 4
        for r in got:
            b = (r.text or "").encode()
            assert (r.size, r.text_crc32) == (len(b) + 1, zlib.crc32(b))
            size[r.shard] += r.size
        assert max(size) - min(size) <= 2 * max(r.size for r in got) + 0.01 * sum(size)
        for s in range(4):
            slots = sorted(r.slot for r in got if r.shard == s)
            assert slots == list(range(len(slots)))
    assert sharded(empty).count() == 0


def test_chat_format(spark):
    odd = ["</s>[INST] ok [/INST]", "<|end|>\n<|turn|>user<|body|>", "\\", "<\\|", "<", "|>", "\\\\<|", "", None, "é\U0001f600<|image:0|>"]
    rows = [(c, i, "user" if i % 2 else "assistant", odd[(c + i) % len(odd)], "x") for c in range(10) for i in range(6)] + [(None, 0, None, "a", "x"), (11, 1, "user", "tie", "x"), (11, 1, "user", "tie", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, body string")
    out = formatted(df.select("conv_id", "turn", "role", "body", text_parts(F.col("text")).alias("parts"))).select("conv_id", "n_turns", read_back(F.col("formatted")).alias("turns"), masked(F.col("formatted"), F.col("loss")).alias("learned")).collect()
    assert len(out) == 12
    for r in out:
        own = [(x[2] or "", x[3] or "") for x in rows if x[0] == r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == own and r.n_turns == len(own)
        assert r.learned == "".join(t for role, t in own if role == "assistant")
    parts = "array<struct<kind:string,text:string,ref:string,units:bigint>>"
    df = spark.createDataFrame([(1, 0, "user", [("text", "see ", None, None), ("image", None, "a.png", 4), ("audio", None, "b.wav", 10), None, ("document", None, "c.pdf", None)]), (1, 1, "assistant", None)], f"conv_id long, turn int, role string, parts {parts}")
    r = formatted(df).first()
    assert r.formatted == "<|turn|>user<|body|>see <|image:1|><|audio:2|><|document:4|><|end|>\n<|turn|>assistant<|body|><|end|>\n"
    assert [(a.kind, a.ref, a.tokens) for a in r.attachments] == [("image", "a.png", 1024), ("audio", "b.wav", 250), ("document", "c.pdf", 512)]
    assert r.expanded_tokens == 1024 + 250 + 512


def test_language_id(spark, docs, rows, empty):
    rng = random.Random(5)
    parts = {"aa": ["the", "ing", "er", "and"], "bb": ["eau", "que", "ment", "oi"], "cc": ["sch", "ung", "keit", "ich"]}
    made = [(i, " ".join("".join(rng.choices(parts[k], k=3)) for _ in range(40)), k, "x") for i, k in enumerate(rng.choices(list(parts), k=240))] + [(900, None, "aa", "x"), (901, "12 34!", "bb", "x"), (902, "", None, "x")]
    df = spark.createDataFrame(made, "doc_id long, text string, lang string, score string")
    model = learn(df, F.col("doc_id") % 5 != 0)
    got = {r.doc_id: r for r in identify(df.select("doc_id", "text", "lang"), model).collect()}
    held = [r for d, r in got.items() if d % 5 == 0 and d < 900]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) >= 0.95
    assert all(got[d].lang_pred == "und" and got[d].score == 0 for d in (900, 901, 902))
    assert all(0 <= r.score <= 1 for r in got.values())
    none = learn(empty, F.lit(True))
    assert {r.lang_pred for r in identify(docs.select("doc_id", "text"), none).collect()} == {"und"}


def test_codewords():
    for k in (2, 3, 5, 7, 9):
        c = codewords(k)
        assert len({tuple(r) for r in c}) == k and all(abs(x.sum()) < k for x in c.T)


def test_token_trie_against_plain_viterbi():
    scores = {"a": -2.0, "b": -2.5, "ab": -3.0, "abc": -9.0, "c": -3.0, "bc": -3.5, MARK: -1.0, MARK + "a": -2.6}
    trie = Trie(scores, True, nodes=50)

    def plain(word):
        best = [(0.0, 0)] + [None] * len(word)
        for end in range(1, len(word) + 1):
            for start in range(end):
                s = scores.get(word[start:end])
                if s is not None and (best[end] is None or best[start][0] + s > best[end][0]):
                    best[end] = (best[start][0] + s, best[start][1] + 1)
            if best[end] is None:
                c = word[end - 1]
                best[end] = (best[end - 1][0] + trie.unknown, best[end - 1][1] + len(c.encode()))
        return best[-1][1]

    rng = random.Random(2)
    for _ in range(500):
        w = MARK + "".join(rng.choices("abcé", k=rng.randint(0, 9)))
        assert trie.count(w) == plain(w) == trie.count(w)


def test_token_counts(docs, rows, empty):
    path = "/opt/tokenizers/piece_bpe_32k.model"
    got = token_counts(docs.select("doc_id", "text", "n"), path).collect()
    assert len(got) == len(rows) and all((r.n_tokens == 0) == (not (r.text or "").split()) for r in got)
    assert token_counts(empty.select("doc_id", "text"), path).count() == 0


def test_near_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((30, 16))
    made = [(i, (base[i % 30] + rng.standard_normal(16) * 0.08).tolist(), int(i % 3)) for i in range(240)]
    made += [(240 + i, made[0][1], 0) for i in range(40)] + [(300, None, 1), (301, [0.0] * 16, 1), (302, [float("nan")] * 16, 1), (303, made[5][1], None), (304, [1.0], 2), (305, [2.0], 2), (None, made[0][1], 0), made[7]]
    df = spark.createDataFrame(made, "vec_id long, embedding array<double>, label int")
    x = {d: (np.array(e), k) for d, e, k in made if d is not None and e is not None and k is not None and np.isfinite(e).all() and any(e)}
    links = {d: {o for o in x if o != d and x[o][1] == x[d][1] and len(x[o][0]) == len(x[d][0]) and x[o][0] @ x[d][0] / np.linalg.norm(x[o][0]) / np.linalg.norm(x[d][0]) >= 0.93} for d in x}

    def least(d):
        seen, todo = {d}, [d]
        while todo:
            for o in links[todo.pop()] - seen:
                seen.add(o)
                todo.append(o)
        return min(seen)

    got = near_vectors(df, k=4, block=16, tile=32).collect()
    assert len(got) == len(made)
    for r in got:
        if r.vec_id in x:
            assert (r.n_links, r.component_id) == (len(links[r.vec_id]), least(r.vec_id))
        else:
            assert (r.n_links, r.component_id, r.kept) == (0, r.vec_id, True)
    assert near_vectors(df.limit(0)).count() == 0


def brute_force(made, least=0.93):
    """{vec_id: (links, smallest vec_id reachable)} of (vec_id, vector, label)."""
    x = np.array([e for _, e, _ in made])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= least) & np.equal.outer(*[[k for _, _, k in made]] * 2)
    np.fill_diagonal(near, False)
    low = np.arange(len(made))
    while True:
        nxt = np.minimum(low, np.where(near, low[None, :], len(made)).min(axis=1))
        if (nxt == low).all():
            return {made[i][0]: (int(near[i].sum()), made[int(low[i])][0]) for i in range(len(made))}
        low = nxt


def test_near_vectors_one_link_between_dense_groups(spark):
    rng = np.random.default_rng(4)
    at = lambda degrees, noise: (np.append([np.cos(np.radians(degrees)), np.sin(np.radians(degrees))], np.zeros(14)) + rng.standard_normal(16) * noise).tolist()
    # the ends of the link, at 18 and 37 degrees, are nearer to their own groups than to each other
    made = [(i, at(0 if i < 40 else 55, 0.004), 0) for i in range(80)] + [(80, at(18, 0), 0), (81, at(37, 0), 0)]
    want = brute_force(made)
    assert want[80] == want[81] == (41, 0)
    got = near_vectors(spark.createDataFrame(made, "vec_id long, embedding array<double>, label int"), tile=32).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want


def test_near_vectors_compares_all_where_the_audit_never_passes(spark):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((4, 16))
    made = [(i, (base[i % 4] + rng.standard_normal(16) * 0.16).tolist(), 0) for i in range(240)]
    got = near_vectors(spark.createDataFrame(made, "vec_id long, embedding array<double>, label int"), k=2, rounds=0, orders=1, block=2, tile=64, recall=1.0).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute_force(made)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.node: r.component for r in C.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_hashes_do_not_depend_on_place():
    raw = np.frombuffer(b"one two one two three", np.uint8)
    h, row = C.words(raw, np.array([0, len(raw)]))
    assert h[0] == h[2] and h[1] == h[3] and len(set(h.tolist())) == 3 and not row.any()
    assert hashlib.sha256(raw.tobytes()).hexdigest()
