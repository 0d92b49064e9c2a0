import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from fieldtree.llm import source_divergence as D

SCHEMA = "doc_id long, text string, lang string, source string"


def expected(rows, least, best=10):
    """The task by its words: every group with every kept term."""
    docs = [(t or "", g or "", s or "") for _, t, g, s in rows]
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [(re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", t.translate(low)), g, s) for t, g, s in docs]
    out = set()
    for lang in {g for _, g, _ in docs}:
        spread = Counter(w for ws, g, _ in words if g == lang for w in set(ws))
        kept = sorted(w for w, n in spread.items() if n >= least)
        counts = {s: Counter(w for ws, g, t in words if g == lang and t == s for w in ws) for s in {s for _, g, s in docs if g == lang}}
        whole = sum(counts.values(), Counter())

        def probabilities(count):
            n = sum(count[w] for w in kept) + 2 * len(kept)
            return {w: 1 + 10**9 * (count[w] + 2) // n for w in kept}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = {s: probabilities(c) for s, c in counts.items()}, probabilities(whole)
        for s in counts:
            pairs = sorted((-sum(f(p[s][w], p[o][w]) for w in kept), o.encode(), o) for o in counts if o != s)
            out |= {(lang, s, "pair", o, -v, k + 1) for k, (v, _, o) in enumerate(pairs)}
            told = sorted((-f(p[s][w], q[w]), w.encode(), w) for w in kept if counts[s][w] and p[s][w] > q[w])
            out |= {(lang, s, "term", w, -v, k + 1) for k, (v, _, w) in enumerate(told[:best])}
    return out


def corpus(seed, n=260):
    draw = random.Random(seed)
    vocabulary = ["the", "The", "of", "Éa", "éa", "é漢", "x1y", "a_b", "naïve"] + [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(70)]
    rows = []
    for i in range(n):
        source = draw.choice(["s0"] * 6 + ["s1", "s2", "é", "", None, "only"])
        lang = draw.choice(["en", "en", "fr", None, ""])
        pick = vocabulary[: 20 + 10 * (len(source or "") % 4)] if i % 3 else vocabulary
        rows.append((i, draw.choice([" ", "\n", ", ", "9"]).join(draw.choice(pick) for _ in range(draw.randint(0, 60))), lang, source))
    return rows + [(1, None, "en", "s1"), (None, "the the of", "xx", "alone"), (None, None, "yy", "none"), (5, "", "yy", None)] + rows[:3]


def got(df):
    return {tuple(r) for r in df.collect()}


@pytest.mark.parametrize("seed,held,pairs", [(1, D.HELD, D.PAIRS), (2, 20, 5), (3, 1, 1)])
def test_against_definition(spark, monkeypatch, seed, held, pairs):
    """Also where tasks flush all the time and a term's pairs come in many blocks."""
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", term string").repartition(5)
    listed = D.postings(df, 10)
    assert {tuple(r) for r in D.counted(df, held).filter("term IS NOT NULL").collect()} == {tuple(r) for r in D.counted(df).filter("term IS NOT NULL").collect()}
    known = D.groups(listed)
    made = D.divergence(df)
    assert made.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert got(made) == expected(rows, 10)
    assert known.count() == len({(r[2] or "", r[3] or "") for r in rows})


def test_blocks_of_pairs(monkeypatch):
    draw = np.random.default_rng(1)
    names = [f"s{k}" for k in range(40)]
    terms = [draw.permutation(40)[: draw.integers(2, 40)] for _ in range(30)]
    p = [draw.integers(2, 10**9, len(t)) for t in terms]
    unseen = draw.integers(1, 50, 40)
    results = []
    for size in (1 << 20, 7):
        monkeypatch.setattr(D, "PAIRS", size)
        sums = D._Sums()
        for t, x in zip(terms, p):
            sums.add([names[k] for k in t], x, unseen[t])
        results.append({(min(a, b), max(a, b)): v for a, b, v in sums.rows()})
    f = lambda a, b: (a - b) ** 2 // (a + b)
    goal = Counter()
    for t, x in zip(terms, p):
        for i in range(len(t)):
            for j in range(i):
                a, b, u, v = int(x[i]), int(x[j]), int(unseen[t[i]]), int(unseen[t[j]])
                goal[tuple(sorted((names[t[i]], names[t[j]])))] += f(a, b) - f(a, v) - f(u, b) + f(u, v)
    assert results[0] == results[1] == dict(goal)


def test_probabilities_beyond_64_bits(spark):
    rows = [(0, 4), (10**12, 10**13), (7, 10**15 + 3), (10**15, 10**15 + 2), (0, 0)]
    made = spark.createDataFrame(rows, "c long, n long").select("c", "n", D.probability(D.F.col("c"), D.F.col("n")).alias("p")).collect()
    assert all(r.p == (1 + 10**9 * (r.c + 2) // r.n if r.n else None) for r in made)


def test_stretches(monkeypatch):
    text = ("Aé b9C " * 50 + "z" * 40).encode()
    whole = [t for part in D.terms(text) for t in part]
    monkeypatch.setattr(D, "STRETCH", 3)
    assert [t for part in D.terms(text) for t in part] == whole == re.findall(rb"[a-z\x80-\xff]+", text.lower())


def test_few_terms_are_read(spark):
    """Most terms are in buckets below the tenth bound, and none of these is evaluated."""
    draw = random.Random(2)
    words = [f"{a}{b}{c}" for a in "abcdef" for b in "abcdefgh" for c in "abcdefgh"]
    rows = [(i, " ".join(w for w in words for _ in range(int(draw.paretovariate(1)) if draw.random() < 0.4 else 0)), "en", f"s{i % 3}") for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    listed = D.postings(df)
    known = D.groups(listed)
    told = D.buckets(listed, known)
    best = {tuple(r) for r in D.best_terms(listed, known, told).select("source", "item", "value", "rank").collect()}
    assert best == {(s, i, v, k) for _, s, part, i, v, k in expected(rows, 10) if part == "term"}
    kth = {r.source: r.value for r in D.best_terms(listed, known, told).filter("rank = 10").collect()}
    bounds = told.filter("bound IS NOT NULL").collect()
    read = sum(r.held for r in bounds if r.bound >= sorted((b.bound for b in bounds if b.source == r.source), reverse=True)[9])
    assert read < 0.7 * sum(r.held for r in bounds) and all(sum(b.bound >= kth[s] for b in bounds if b.source == s) for s in kth)


def test_empty_table(spark):
    assert D.divergence(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sql(spark, tmp_path):
    rows = corpus(7)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/d")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    assert set(con.execute(D.divergence_sql()).fetchall()) == expected(rows, 10)
