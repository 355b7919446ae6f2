"""Tokenizer alignment, reversible line dedup and spelling variants against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from treegauge.llm import queries as Q
from treegauge.llm.line_index import Cuckoo, LineIndex
from treegauge.llm.spelling import frequent, near_words, rooted, variants
from treegauge.llm.token_align import aligned, printed_bytes

A_FILE, B_FILE = f"{Q.TOKENIZERS}/byte_bpe_50k.json", f"{Q.TOKENIZERS}/piece_bpe_32k.model"
SCHEMA = "doc_id long, text string, n_a string, word int, n int, keys int, flush int, own string, root int"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3, 4, "y", 5) for i, t in rows], SCHEMA).repartition(parts)


def texts(seed=3, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeilnorstü", k=rng.randint(1, 11))) for _ in range(120)]
    shared = [" ".join(rng.choices(words, k=7)) + " with one tail." for _ in range(6)]
    out = []
    for _ in range(n):
        lines = [" ".join(rng.choices(words, k=rng.randint(0, 9))).capitalize() for _ in range(rng.randint(1, 6))]
        for s in rng.sample(shared, rng.randint(0, 3)):
            lines.insert(rng.randint(0, len(lines)), rng.choice(["", "  ", "\t"]) + rng.choice([s, s.upper() if "ü" not in s else s]) + rng.choice(["", " \r"]))
        out.append("\n".join(lines))
    odd = ["", " ", "\n", "  lead and  double ", "x \n y\n\n z ", "tab\tand\x0bmore\x1c here", "a▁b is lost", "nul \x00 byte", "<|endoftext|> and </s><s> [INST]", "日本語の文章 が ここ", "　wide spaces   x", "emoji 😀😀 it's we'll’s", "ab" * 400, "word " * 500, "ÀÉÎõü× ÷ ÿß"]
    return out + odd


@pytest.fixture(scope="module")
def rows():
    t = texts()
    ids = list(range(len(t)))
    random.Random(5).shuffle(ids)
    out = list(zip(ids, t, strict=True))
    return [*out, (None, t[0]), (None, None), (7000, None), out[1], out[2], (out[3][0], t[9])]


# ---- 11 ----


def brute_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A_FILE), sentencepiece.SentencePieceProcessor(model_file=B_FILE)
    a.encode_special_tokens = True
    back = printed_bytes()
    docs, held = [], Counter()
    for doc, text in rows:
        groups, links = [], Counter()
        if text:
            x = [(i, bytes(back[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
            y = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
            whole = (" " + text).encode()
            if b"".join(t for _, t in x) == whole == b"".join(t for _, t in y):
                ends = []
                for side in (x, y):
                    at, own = 0, {}
                    for k, (_, t) in enumerate(side):
                        at += len(t)
                        own[at] = k + 1
                    ends.append(own)
                fa = fb = 0
                for e in sorted(ends[0].keys() & ends[1].keys()):
                    groups.append(([i for i, _ in x[fa : ends[0][e]]], [i for i, _ in y[fb : ends[1][e]]]))
                    fa, fb = ends[0][e], ends[1][e]
                for p, q in groups:
                    links.update((i, j) for i in p for j in q)
        held.update(links.keys())
        docs.append((doc, groups, links))
    best = defaultdict(int)
    for (i, _), n in held.items():
        best[i] = max(best[i], n)
    out = []
    for doc, groups, links in docs:
        said = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append((doc, sum(len(p) for p, _ in groups), sum(len(q) for _, q in groups), len(groups), sum(links.values()), sum(n for k, n in links.items() if held[k] == best[k[0]]), sum(n * held[k] for k, n in links.items()), hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    return out


def key(x):
    return tuple((v is not None, str(v)) for v in x)


@pytest.mark.parametrize("small", [{}, {"flush": 900, "chunks": 40, "sides": 3}])  # several flushes, chunks forgotten between them
def test_alignment(spark, rows, small):
    d = frame(spark, rows, 1 if small else 3)
    got = [tuple(r) for r in aligned(d, A_FILE, B_FILE, **small).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()]
    assert sorted(got, key=key) == sorted(brute_alignment(rows), key=key)


def test_alignment_counts_many_times(spark):
    rows = [(1, "aaa bbb " * 400), (2, "aaa ccc"), (3, "aaa bbb")]
    got = [tuple(r) for r in aligned(frame(spark, rows), A_FILE, B_FILE).collect()]
    want = [(d, a, b, g, n, best, s, sha) for d, a, b, g, n, best, s, sha in brute_alignment(rows)]
    assert sorted(got, key=key) == sorted(want, key=key)


# ---- 12 ----


def line_key(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s.strip(" \t\n\x0b\x0c\r"))


def brute_lines(rows, held=None, least=3, chars=20):
    """Rows without repeated lines; held: the documents that count."""
    where = defaultdict(set)
    for doc, text in rows if held is None else held:
        for s in (text or "").split("\n"):
            if len(line_key(s)) >= chars:
                where[line_key(s)].add(-(1 << 63) if doc is None else doc)
    out = []
    for doc, text in rows:
        lines, did = (text or "").split("\n"), -(1 << 63) if doc is None else doc
        stays = [s for s in lines if len(where[line_key(s)]) < least or did == max(where[line_key(s)])]
        out.append((doc, len(lines), len(lines) - len(stays), "\n".join(stays)))
    return sorted(out, key=key)


def kept(index, d):
    return sorted((tuple(r) for r in index.kept(d).collect()), key=key)


def state(index):
    """Keys with their counts, and for each level the keys that its filters may hold."""
    counts = sorted(tuple(r) for r in index.live_counts().collect())
    return sorted(tuple(r) for r in index.live_refs().collect()), counts


def level(index, n):
    return {(r.hi, r.lo) for r in index.may_hold(index.live_refs().select("hi", "lo").distinct(), n).collect()}


def test_cuckoo_filter_adds_and_removes():
    rng = np.random.default_rng(4)
    keys = rng.integers(0, 1 << 63, 4000).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    f = Cuckoo.sized(2000)  # too small for all: the rest stands beside it
    f.add(keys)
    assert f.may_hold(keys).all() and len(f.spill)
    assert f.may_hold(rng.integers(0, 1 << 63, 20000).astype(np.uint64)).mean() < 0.01
    f.remove(keys[:3000])
    assert f.may_hold(keys[3000:]).all() and f.may_hold(keys[:3000]).mean() < 0.01
    f.remove(keys[3000:])
    assert not f.cells.any() and not len(f.spill)
    same = np.repeat(keys[:1], 20)  # more equal fingerprints than two buckets take
    f.add(same)
    assert len(f.spill) == 12
    f.remove(same)
    assert not f.cells.any() and not len(f.spill)


def test_lines(spark, rows):
    d = frame(spark, rows)
    assert kept(LineIndex(spark).insert(d), d) == brute_lines(rows)
    assert sum(r[2] for r in brute_lines(rows)) > 20


def test_lines_incremental_and_reversible(spark, rows, monkeypatch):
    monkeypatch.setattr("treegauge.llm.line_index.PER_SHARD", 60)  # shards double on the way
    d = frame(spark, rows)
    first, rest = [r for r in rows if (r[0] or 0) % 3 == 0], [r for r in rows if (r[0] or 0) % 3]
    one = LineIndex(spark).insert(frame(spark, first))
    two = one.insert(frame(spark, rest))
    whole = LineIndex(spark).insert(d)
    assert two.shards > one.shards and state(two) == state(whole)
    assert kept(two, d) == brute_lines(rows)
    assert kept(one, d) == brute_lines(rows, first)  # documents that it doesn't hold are judged, but don't count
    again = two.insert(frame(spark, first))
    assert state(again) == state(two)
    back = again.delete(frame(spark, [(i, None) for i in {r[0] for r in rest}] + [(999_999, None)]))
    assert state(back) == state(one)
    assert kept(back, d) == brute_lines(rows, first)
    keys = {(k[0], k[1]): k[2] for k in state(back)[1]}
    for n, least in ((1, 1), (2, 3)):
        must = {k for k, c in keys.items() if c >= least}
        assert must <= level(back, n) and len(level(back, n) - must) <= 2
    none = back.delete(d)
    assert state(none) == ([], []) and not any(any(f.cells) for f in none.filters.collect())
    assert kept(none.insert(d), d) == brute_lines(rows)


def test_lines_compacted_and_stored(spark, rows, tmp_path):
    d = frame(spark, rows)
    index = LineIndex(spark).insert(frame(spark, rows[:30])).insert(frame(spark, rows[20:])).delete(frame(spark, rows[:5]))
    index.save(f"{tmp_path}/index")
    back = LineIndex.load(spark, f"{tmp_path}/index")
    gone = {r[0] for r in rows[:5]}
    assert state(back) == state(index) and kept(back, d) == brute_lines(rows, [r for r in rows if r[0] not in gone])
    blank = frame(spark, [])
    empty = LineIndex(spark)
    assert kept(empty, blank) == [] and kept(empty.insert(blank), d) == brute_lines(rows, [])
    assert kept(empty.insert(blank).insert(d), d) == brute_lines(rows)
    empty.delete(d).save(f"{tmp_path}/blank")
    assert kept(LineIndex.load(spark, f"{tmp_path}/blank"), d) == brute_lines(rows, [])


# ---- 13 ----


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(rows, every=97):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def brute_variants(n):
    out, form = [], {}
    for w, c in n.items():
        own = [v for v in n if near(w, v)]
        top = min(own, key=lambda v: (-n[v], v), default=None)
        form[w] = top if top and n[top] >= 2 * c else None
        out.append([w, form[w], w, c, len(own), n[top] if form[w] else None])
    for r in out:
        while form[r[2]]:
            r[2] = form[r[2]]
    return sorted(map(tuple, out))


def spoken(seed=2):
    rng = random.Random(seed)
    base = ["".join(rng.choices("abcé", k=rng.randint(5, 8))) for _ in range(40)]
    rows = []
    for i in range(150):
        own = []
        for _ in range(rng.randint(0, 60)):
            w = base[min(int(rng.expovariate(0.12)), 39)]
            if rng.random() < 0.3:
                k = rng.randrange(len(w))
                w = w[:k] + rng.choice(["", "a", "b", "ab"]) + w[k + rng.randint(0, 1) :]
            own.append(w.capitalize() if rng.random() < 0.3 else w)
        rows.append((i, rng.choice([" ", ", ", "3"]).join(own)))
    return [*rows, (None, rows[3][1]), (None, None), (500, ""), rows[4], rows[4], (501, "ÀÉÎõü Àéîõü " * 4), (502, "aaaaa aaaaaa " * 9)]


@pytest.mark.parametrize("every", [97, 5])
def test_variants(spark, every):
    rows = spoken()
    got = variants(frame(spark, rows), slip=every).select("word", "form", "root", "n", "n_near", "form_n").collect()
    want = brute_variants(brute_words(rows, every))
    assert sorted(map(tuple, got)) == want
    assert any(r[2] not in (r[0], r[1]) for r in want)


def test_near_words_are_at_distance_one(spark):
    words = ["abcde", "abcdee", "abdce", "bbcde", "abcd", "abcdf", "abcdef", "acbde", "xabcde", "aabcde", "ééééé", "éééé", "\U0001f600abcd", "abcd\U0001f600", "ab", "ba", "a", "b", ""]
    got = near_words(spark.createDataFrame([(w, i) for i, w in enumerate(words)] + [(None, 1)], "word string, n long")).collect()
    assert sorted((r.word, r.near) for r in got) == sorted((a, b) for a in words for b in words if a and b and near(a, b))


def test_roots_of_long_chains(spark):
    n = 37
    rows = [(f"w{i}", f"w{i + 1}" if i < n else None) for i in range(n + 1)] + [("lone", None)]
    got = rooted(spark.createDataFrame(rows, "word string, form string")).collect()
    assert {r.word: r.root for r in got} == {f"w{i}": f"w{n}" for i in range(n + 1)} | {"lone": "lone"}


def test_no_words(spark):
    for rows in ([], [(1, None), (2, "a b c")]):
        assert variants(frame(spark, rows), slip=97).count() == 0
        assert aligned(frame(spark, rows[:0]), A_FILE, B_FILE).count() == 0
    assert frequent(spark.createDataFrame([], "word string")).count() == 0
