"""Joins, substring and embedding deduplication against brute force, hard cases included."""

import hashlib
import math
import random
import re
from fractions import Fraction

import numpy as np
import pytest

from millrace.llm import embed_dedup, ngram_join, substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def components(ids, linked):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        root[find(a)] = find(b)
    out = []
    for i in range(len(ids)):
        known = [ids[j] for j in range(len(ids)) if find(j) == find(i) and ids[j] is not None]
        out.append(min(known) if known else None)
    return out


def shingles(text, k):
    w = WORD.findall(lower(text or ""))
    if not w:
        return set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}


def similar_rows(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return sorted((str(i), len(s), str(c)) for (i, _), s, c in zip(rows, sets, components([i for i, _ in rows], links)))


def corpus(seed, n=120):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    passage = " ".join(r.choice(vocab) for _ in range(60))
    texts = [None, "", "  \n", "one", "One", "two words", "two\twords", "é É", "x " * 300]
    for _ in range(n):
        kind = r.random()
        if kind < 0.45 and len(texts) > 20:
            w = (r.choice(texts[9:]) or "a").split()
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = r.choice(vocab)
            if r.random() < 0.3:
                w = [x.upper() for x in w]
            texts.append("\n".join(w))
        else:
            w = [r.choice(vocab) for _ in range(r.randint(1, 160))]
            if r.random() < 0.4:
                w[r.randrange(len(w)) : 0] = passage.split()
            texts.append(" ".join(w))
    rows = [(i, t) for i, t in enumerate(texts)]
    r.shuffle(rows)
    return rows + [rows[40], (rows[41][0], rows[42][1]), (None, rows[43][1]), (None, (rows[44][1] or "q") + " tail"), (None, (rows[45][1] or "q") + " tail")]


@pytest.mark.parametrize("seed,k,percent,block", [(1, 4, 85, 10**6), (2, 5, 80, 600), (3, 4, 85, 300)])
def test_ngram_join(spark, seed, k, percent, block):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n long, key string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_join.similar(df, k=k, percent=percent, block_tokens=block).collect())
    assert got == similar_rows(rows, k, percent)


@pytest.mark.parametrize("seed,k,percent,block", [(1, 4, 85, 10**6), (3, 4, 70, 300)])
def test_ngram_join_counts_links(spark, seed, k, percent, block):
    rows = corpus(seed)
    sets = [shingles(t, k) for _, t in rows]
    n = [sum(1 for j, b in enumerate(sets) if i != j and a and b and 100 * len(a & b) >= percent * len(a | b)) for i, a in enumerate(sets)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.similar(df, k=k, percent=percent, block_tokens=block).collect()
    assert max(n) > 2 and sorted((str(r.doc_id), r.n_shingles, r.n_links) for r in got) == sorted((str(i), len(s), x) for (i, _), s, x in zip(rows, sets, n))


def test_ngram_join_empty(spark):
    assert ngram_join.similar(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_of_each(spark):
    rows = [(3, "a b c d e f"), (1, "A B c d e f"), (7, None), (8, ""), (2, "other words all the way"), (2, "other words all the way"), (None, "x y")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, __extra string")
    got = ngram_join.one_of_each(df).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "2", "7", "8", "None"]
    assert got[0].__fields__ == df.columns


def test_linked_sets_share_a_signature():
    """Whatever the sizes: also where linked sets agree in empty ranges only."""
    r = np.random.default_rng(5)
    for percent in (85, 80, 60):
        bands, linked = ngram_join.Bands(percent), 0
        for _ in range(1500):
            n = int(r.integers(1, 12)) if r.random() < 0.5 else int(r.integers(12, 400))
            a = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
            b = np.unique(np.concatenate([a[r.random(len(a)) > r.random() * 0.15], r.integers(0, 2**64, int(r.integers(0, 2 + n // 12)), dtype=np.uint64)]))
            k = len(np.intersect1d(a, b))
            if len(b) and len(a) != k and 100 * k >= percent * (len(a) + len(b) - k):
                linked += 1
                o, s, m = ngram_join.signatures([a, b], bands)
                both = np.intersect1d(s[o == 0], s[o == 1])
                for i in (0, 1):  # for the band in which they are compared, each has as many as its mark says
                    met = m[(o == i) & np.isin(s, both)]
                    assert any(np.count_nonzero(met == x) >= x % 128 for x in np.unique(met))
        assert linked > 200


def test_ngram_join_blocks_stay_apart(spark, monkeypatch):
    """Families of near copies that only share usual lines are blocks of their own, and their links are whole."""
    r, rows = random.Random(8), []
    lines = [[f"line{i}_{j}" for j in range(9)] for i in range(12)]
    for family in range(120):
        words = [f"f{family}_{i}" for i in range(150)]
        for line in r.sample(lines, 6):
            words[(at := r.randrange(len(words))) : at] = line
        for _ in range(3):
            copy = words[:]
            copy[r.randrange(len(copy))] = f"own{len(rows)}"
            rows.append((len(rows), " ".join(copy)))
    seen, cut = {}, ngram_join.common.cut
    monkeypatch.setattr(ngram_join.common, "cut", lambda df, label="cut", codec="snappy": seen.setdefault(label, cut(df, label, codec)) if label == "sizes" else cut(df, label, codec))
    got = ngram_join.similar(spark.createDataFrame(rows, "doc_id long, text string"), k=5, percent=80).collect()
    assert sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in got) == similar_rows(rows, 5, 80)
    sizes = [x.total for x in seen["sizes"].collect()]
    assert len(sizes) > 60 and max(sizes) < 0.2 * sum(sizes)


def test_dropped_signatures_leave_one_in_common():
    """Each set leaves out its first ones in the common order, whatever else it meets; linked sets then still meet."""
    r, linked = np.random.default_rng(9), 0
    bands = ngram_join.Bands(80)
    for _ in range(600):
        n = int(r.integers(4, 3000)) if r.random() < 0.2 else int(r.integers(4, 200))
        a = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[r.random(n) > r.random() * 0.2], r.integers(0, 2**64, int(r.integers(0, 2 + n // 8)), dtype=np.uint64)]))
        k = len(np.intersect1d(a, b))
        if not len(b) or len(a) == k == len(b) or 100 * k < 80 * (len(a) + len(b) - k):
            continue
        linked += 1
        o, s, m = ngram_join.signatures([a, b], bands)
        common = np.intersect1d(s[o == 0], s[o == 1])
        also = r.random() < 0.5  # strangers meet the rest
        left = []
        for i in (0, 1):
            left.append(set())
            for x in np.unique(m[o == i]):
                met = np.sort(s[(o == i) & (m == x) & (also | np.isin(s, common))])  # few shingles first
                left[i] |= set(met[ngram_join.AT_LEAST[x % 128] - 1 :].tolist())
        assert left[0] & left[1]
    assert linked > 150


def test_likely_rows(spark):
    df = spark.range(200_000).selectExpr("id as key", "if(id % 5 = 0, null, id * 7) as doc_id", "cast(id as string) as text", "1 as at", "2 as bits")
    wanted = df.filter("key % 100 < 2").select("key", "doc_id")
    got = ngram_join.likely(df, wanted, "key", "doc_id")
    keys = {x.key for x in got.collect()}
    assert got.columns == df.columns and {x.key for x in wanted.collect()} <= keys and len(keys) < 4_200
    assert ngram_join.likely(df, wanted.limit(0), "key", "doc_id").count() == 0


def test_count_block_is_brute_force():
    r = random.Random(6)
    for _ in range(200):
        sets = []
        for _ in range(r.randint(1, 14)):
            base = r.choice(sets).tolist() if sets and r.random() < 0.7 else r.sample(range(60), r.randint(3, 25))
            sets.append(np.array(sorted(set(base) ^ set(r.sample(range(60), r.randint(0, 2)))) or [1]))
        sizes, weights = [len(s) + r.randint(0, 1) for s in sets], [r.randint(1, 5) for _ in sets]
        first = [r.random() < 0.5 for _ in sets] if r.random() < 0.5 else None
        links = [(a, b) for a in range(len(sets)) for b in range(len(sets)) if a != b and (first is None or first[a] != first[b]) and 100 * (k := len(np.intersect1d(sets[a], sets[b]))) >= 70 * (sizes[a] + sizes[b] - k)]
        ids = list(range(len(sets)))
        forest, counts = ngram_join.count_block(sets, sizes, weights, 70, first)
        assert components(ids, forest) == components(ids, links)
        assert counts.tolist() == [sum(weights[b] for a, b in links if a == i) for i in ids]


def removed(rows, window):
    words = [WORD.findall(t or "") for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, words):
        for k in range(len(w) - window + 1):
            x = tuple(w[k : k + window])
            if i is not None:
                first[x] = min(first.get(x, i), i)
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append((str(i), len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(*x, 5) for x in rows], "doc_id long, text string, key long")
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substring.deduplicate(df, window=20, gram=6).collect())
    assert got == removed(rows, 20)


def test_substring_factors(spark):
    """Factors say where their words stand first, go on as long as the reference does, and windows across their ends are found."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, f"{a} {b}"), (2, f"{b} {c}"), (3, f"x {a} {b} {c} y"), (4, "z " * 40 + b), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in substring.deduplicate(df, window=20, gram=6).collect()}
    assert [tuple(f) for f in got[3].factors] == [(1, 61, 1, 0), (42, 91, 2, 11)] and got[3].kept == "x y"
    assert [tuple(f) for f in got[4].factors] == [(40, 70, 1, 30)] and got[5].factors is None and got[1].n_removed == 0
    words = {i: (t or "").split() for i, t in rows}
    assert all(words[r.doc_id][f.start : f.end] == words[f["doc_id"]][f.place : f.place + f.end - f.start] for r in got.values() for f in r.factors or [])


def test_substrings_empty(spark):
    assert substring.deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_embeddings(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(40, 12))
    rows = []
    for i in range(260):
        v = base[r.integers(40)] + r.normal(size=12) * r.choice([0, 0.1, 0.25])
        rows.append((i, v.astype("f4").tolist(), None if i % 37 == 0 else int(r.integers(3))))
    rows += [(900, None, 1), (901, [], 1), (902, [0.0] * 12, 1), (903, [float("nan")] + [1.0] * 11, 1), (904, [None] + [1.0] * 11, 1), (905, [1.0, 0.0], 1), (906, [2.0, 0.0], 1), (907, [-0.0, 3.0], 1), (908, [0.0, 3.0], 1), (5, rows[7][1], rows[7][2]), rows[8], (None, rows[9][1], rows[9][2])]

    def fine(v, label):
        return label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    links = []
    for a in range(len(rows)):
        for b in range(len(rows)):
            (_, x, lx), (_, y, ly) = rows[a], rows[b]
            if a != b and fine(x, lx) and fine(y, ly) and lx == ly and len(x) == len(y) and np.dot(x, y) / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.93:
                links.append((a, b))
    comp = components([i for i, _, _ in rows], links)
    want = sorted((str(i), sum(a == k for a, _ in links), str(c), i == c) for k, ((i, _, _), c) in enumerate(zip(rows, comp)))
    df = spark.createDataFrame([(*x, "k") for x in rows], "vec_id long, embedding array<float>, label int, key string")
    got = sorted((str(x.vec_id), x.n_links, str(x.component_id), x.kept) for x in embed_dedup.near_duplicates(df, 0.93, tile=16).collect())
    assert got == want
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embedding_threshold_is_exact(spark):
    """Pairs a few roundings around the threshold link exactly if their cosine, in exact arithmetic, is not below it."""
    r = np.random.default_rng(8)
    rows, want = [], {}
    for k in range(150):
        x = r.normal(size=8)
        x /= np.linalg.norm(x)
        o = r.normal(size=8)
        o -= (o @ x) * x
        o /= np.linalg.norm(o)
        y = 0.93 * x + math.sqrt(1 - 0.93**2) * o
        y[int(r.integers(8))] += r.integers(-3, 4) * 2e-16
        rows += [(2 * k, x.tolist(), k), (2 * k + 1, y.tolist(), k)]
        dot = sum(Fraction(a) * Fraction(b) for a, b in zip(x.tolist(), y.tolist()))
        norms = [sum(Fraction(a) ** 2 for a in v.tolist()) for v in (x, y)]
        want[2 * k] = want[2 * k + 1] = int(dot * dot >= Fraction(0.93) ** 2 * norms[0] * norms[1])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert {x.vec_id: x.n_links for x in embed_dedup.near_duplicates(df, 0.93).collect()} == want
    assert 20 < sum(want.values()) / 2 < 130


@pytest.mark.parametrize("strip", [1, 3])
def test_embedding_strips(spark, strip):
    """Many tiles and strips of one label give what one tile gives."""
    r = np.random.default_rng(4)
    base = r.normal(size=(30, 6))
    rows = [(i, (base[r.integers(30)] + r.normal(size=6) * 0.2).tolist(), 1) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    one = sorted(map(tuple, embed_dedup.near_duplicates(df, 0.93).collect()))
    assert sorted(map(tuple, embed_dedup.near_duplicates(df, 0.93, tile=8, strip=strip).collect())) == one
