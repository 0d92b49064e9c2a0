import os
import random

import pytest
from pyspark.sql import functions as F

from fieldtree.llm import source_mixing as M

SF = "/root/testdata/sf0.1"


def capped(n, power, lift):
    """Targets of a marginal by bisection: in proportion to n to the power, at most ``lift * n``, and n's sum in all."""
    n, low, high = n.astype(float), 0.0, 1e12
    for _ in range(300):
        middle = (low + high) / 2
        low, high = (middle, high) if (n**power * (n > 0) * middle).clip(upper=lift * n).sum() < n.sum() else (low, middle)
    return (n**power * (n > 0) * high).clip(upper=lift * n)


def test_marginals_are_met(spark):
    sizes = iter([900, 50, 30, 20, 7, 1, 400, 90, 60, 3, 11, 0])
    cells = spark.createDataFrame([(s, g, t, next(sizes)) for s in ("a", "b", None) for g in ("en", "de") for t in ("t", "u")], "source string, lang string, topic string, tokens long")
    powers = {"source": 0.5, "lang": 0.7, "topic": 0.7}
    made = M.rake(cells, powers, rounds=12).toPandas()
    total = made.tokens.sum()
    for dim, power in powers.items():
        have = (made.tokens * made.weight).groupby(made[dim].fillna("-")).sum()
        tokens = made.tokens.groupby(made[dim].fillna("-")).sum().astype(float)
        goal = tokens**power * (tokens > 0)
        assert (have - goal / goal.sum() * total).abs().max() < 0.002 * total
    for keep in (0.4, 0.2):
        kept = M.probabilities(spark.createDataFrame(made), keep, powers).toPandas()
        share = (kept.tokens * kept.probability).sum() / total
        assert abs(share - keep) < 1e-3
        goal = {dim: capped(made.tokens.groupby(made[dim].fillna("-")).sum(), power, M.lift_of(keep)) for dim, power in powers.items()}
        assert ((kept.probability > 0) & (kept.probability <= 1)).all()
        for dim in powers:
            have = (kept.tokens * kept.probability).groupby(kept[dim].fillna("-")).sum()
            assert (have / have.sum() - goal[dim] / goal[dim].sum()).abs().max() < 0.01 * share


def test_sample(spark):
    rows = [(i, "w " * (i % 9 + 1), "en" if i % 4 else "de", f"s{min(i % 7, 2)}") for i in range(3000)]
    df = spark.createDataFrame([(*r, "clash", 2.0) for r in rows], "doc_id long, text string, lang string, source string, topic string, weight double")
    report = M.mixing_report(df).cache()
    share = report.agg(F.sum(F.when(F.col("kept"), F.col("tokens"))) / F.sum("tokens")).first()[0]
    expected = report.agg(F.sum(F.col("probability") * F.col("tokens")) / F.sum("tokens")).first()[0]
    assert abs(share - expected) < 0.05 and 0.2 < expected <= M.KEEP
    kept = M.mixed(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in report.filter("kept").collect()}
    assert {r.doc_id for r in M.mixed(df.repartition(3)).collect()} == {r.doc_id for r in kept.collect()}


def test_odd_rows(spark, documents):
    report = M.mixing_report(documents).collect()
    assert len(report) == documents.count() and all(0 < r.probability <= 1 for r in report)
    assert M.mixing_report(documents.limit(0)).count() == 0
    silent = documents.filter("text IS NULL OR text = ''")
    assert M.mixing_report(silent).count() == 2


@pytest.mark.parametrize("text,topic", [("a | b", "table"), ("NOW!!", "shout"), ("x***", "marks"), ("a License", "licence"), ("plain", "prose"), (None, "prose")])
def test_topics(spark, text, topic):
    assert spark.createDataFrame([(text,)], "text string").select(M.topic_of()).first()[0] == topic


def off(made, powers):
    """Largest relative deviation of a marginal from its target."""
    total, most = made.tokens.sum(), 0.0
    for dim, power in powers.items():
        have = (made.tokens * made.weight).groupby(made[dim]).sum()
        goal = made.tokens.groupby(made[dim]).sum().astype(float) ** power
        most = max(most, (have / (goal / goal.sum() * total) - 1).abs().max())
    return most


def test_correlated_cells_converge(spark):
    """Each source mostly in one language, and one hot source: the production settings meet the marginals."""
    rows = [(f"s{k}", f"l{g}", "t", (40 if k == 0 else 1) * (1000 if k % 4 == g else 1 + k)) for k in range(20) for g in range(4)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    made = M.rake(cells, M.POWERS).toPandas()
    assert list(made.columns) == [*cells.columns, "weight"]
    assert off(made, M.POWERS) <= 2 * 1e-3


def test_contradicting_marginals_are_reported(spark):
    cells = spark.createDataFrame([("a", "en", "t", 900), ("b", "de", "t", 100)], "source string, lang string, topic string, tokens long")
    with pytest.warns(UserWarning, match="does not meet"):
        assert M.rake(cells, M.POWERS).count() == 2


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are absent")
def test_sampled_tokens_of_the_tables_have_the_target_marginals(spark):
    """Expected tokens within 1 % of their targets on all documents."""
    made = M.mixing_report(spark.read.parquet(f"{SF}/documents.parquet")).toPandas()
    for dim, power in M.POWERS.items():
        goal = capped(made.tokens.groupby(made[dim].fillna("-")).sum(), power, M.lift_of(M.KEEP))
        have = (made.tokens * made.probability).groupby(made[dim].fillna("-")).sum()
        assert (have / (goal * M.KEEP) - 1).abs().max() < 0.01


def shares(report):
    """Expected share of tokens of a report."""
    return float((report.tokens * report.probability).sum() / report.tokens.sum())


@pytest.mark.parametrize("stray", [(-5, "hello", "en", "nowhere"), (-5, "hello", None, None), (-5, "hello " * 40 + "!!", "xx", "s1")])
def test_a_scarce_value_changes_nearly_nothing(spark, stray):
    """One row with a source, or a language, of its own: the share kept and the others' probabilities stay."""
    rows = [(i, "w " * (i % 9 + 20) + "!!" * (i % 40 == 0), "en" if i % 4 else "de", f"s{0 if i % 3 == 0 else i % 7}") for i in range(4000)]
    schema = "doc_id long, text string, lang string, source string"
    before = M.mixing_report(spark.createDataFrame(rows, schema)).toPandas()
    after = M.mixing_report(spark.createDataFrame([*rows, stray], schema)).toPandas()
    assert abs(shares(before) - M.KEEP) < 1e-3 and abs(shares(after) - M.KEEP) < 0.01 * M.KEEP
    both = before.merge(after, on="doc_id")
    assert (both.probability_x - both.probability_y).abs().max() < 0.01
    copied = M.mixed(spark.createDataFrame([*rows, stray], schema), repeats=True).groupBy("doc_id").count()
    assert copied.agg(F.max("count")).first()[0] <= M.COPIES


def test_targets_of_both_ways_and_by_bisection(spark):
    import numpy as np
    import pandas as pd

    draw = np.random.default_rng(4)
    for lift in (None, 1.0, 1.5, 6.0):
        n = np.concatenate([[0, 1, 1, 2], (10 ** draw.uniform(0, 7, 40)).astype(int)]).astype(float)
        here = M._targets(n, 0.5, lift)
        df = spark.createDataFrame([(k, int(v)) for k, v in enumerate(n) if v], "t long, n long")
        there = {r.t: r.target for r in M._targets_there(df, 0.5, lift, n.sum()).collect()}
        want = capped(pd.Series(n), 0.5, lift or 1e30).to_numpy()
        assert abs(here.sum() / n.sum() - 1) < 1e-9 and np.allclose(here, want, rtol=1e-6)
        assert all(abs(here[k] - v) <= 1e-9 * v for k, v in there.items())


def test_sql_beyond_the_least_rounds(spark):
    """Correlated cells take more rounds than the least; the SQL goes on as well."""
    import duckdb

    draw = random.Random(5)
    rows = []
    for i in range(6000):
        source = 0 if draw.random() < 0.4 else draw.randint(1, 9)
        lang = source % 3 if draw.random() < 0.97 else draw.randint(0, 2)
        rows.append((i, "w " * (3 + source) + "!!" * (draw.random() < 0.05), f"l{lang}", f"s{source}"))
    documents = spark.createDataFrame([*rows, (-1, "hello", "rare", "rarer")], "doc_id long, text string, lang string, source string")
    con = duckdb.connect()
    con.register("documents", documents.toPandas())
    for rounds, bounded in ((1, 1), (M.ROUNDS, M.BOUNDED_ROUNDS)):
        short = M.mixing_sql(rounds=rounds, bounded=bounded)
        taken = con.execute(short[: short.rindex("\nSELECT d.doc_id")] + " SELECT (SELECT max(len(seen)) FROM weights_rounds)").fetchone()[0]
        assert taken > rounds
    names = ["doc_id", "source", "lang", "topic", "tokens", "weight", "probability", "kept"]
    key = lambda rows: sorted(str([round(x, 5) if isinstance(x, float) else x for x in r]) for r in rows)
    assert key(con.execute(f"SELECT {', '.join(names)} FROM ({M.mixing_sql()})").fetchall()) == key(tuple(r) for r in M.mixing_report(documents).select(*names).collect())


def test_sql_agrees_with_nulls(spark):
    import duckdb

    draw = random.Random(8)
    rows = [(i if i % 90 else None, draw.choice([None, "", "a b c d !!", "x | y", "p q r s t u", "*** z"]), draw.choice([None, "en", "en", "de"]), draw.choice([None, "s", "s", "t"])) for i in range(2000)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    con = duckdb.connect()
    con.register("documents", documents.toPandas().astype({"doc_id": "Int64"}))
    names = ["source", "lang", "topic", "tokens", "weight", "probability", "kept"]
    key = lambda rows: sorted(str([round(x, 5) if isinstance(x, float) else x for x in r]) for r in rows)
    assert key(con.execute(f"SELECT {', '.join(names)} FROM ({M.mixing_sql()})").fetchall()) == key(tuple(r) for r in M.mixing_report(documents).select(*names).collect())


def test_both_ways_of_fitting_agree(spark, monkeypatch):
    cells = spark.createDataFrame([("a", "en", "t", 900), ("b", "de", "t", 100), ("a", "de", "t", 50), (None, "en", "t", 7), ("b", "en", "t", 0)], "source string, lang string, topic string, tokens long")
    monkeypatch.setattr(M, "DRIVER_CELLS", 0)
    monkeypatch.setattr(M, "TOLERANCE", 1.0)
    there = {r[:3]: r.weight for r in M.rake(cells, M.POWERS, rounds=3).collect()}
    monkeypatch.setattr(M, "DRIVER_CELLS", 9)
    again = {r[:3]: r.weight for r in M.rake(cells, M.POWERS, rounds=3).collect()}
    assert there.keys() == again.keys() and all(abs(there[k] - again[k]) < 1e-9 for k in there)
    bounded = {r[:3]: r.probability for r in M.probabilities(cells, 0.6, rounds=3).collect()}
    monkeypatch.setattr(M, "DRIVER_CELLS", 0)
    assert all(abs(bounded[r[:3]] - r.probability) < 1e-9 for r in M.probabilities(cells, 0.6, rounds=3).collect())


def test_stage_has_the_target_marginals(spark):
    """One hot source, each source mostly in one language: the stage's tokens have the raked marginals."""
    import corpus_pipeline as C

    draw = random.Random(3)
    rows = []
    for i in range(24000):
        source = 0 if draw.random() < 0.33 else draw.randint(1, 11)
        lang = source % 3 if draw.random() < 0.8 else draw.randint(0, 2)
        rows.append((i, "w " * 9 + "!!" * (draw.random() < 0.05), f"l{lang}", f"s{source}", 18))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    report = M.calibrated(df)[0].drop("doc_id", "n_chars", "text").toPandas()
    made = C.mixing(spark, df, "")
    assert made.columns == df.columns
    kept = made.withColumns({"topic": M.topic_of(), "tokens": M.tokens_of()}).toPandas()
    total = report.tokens.sum()
    assert abs(kept.tokens.sum() / total - M.KEEP) < 0.02
    for dim, power in M.POWERS.items():
        goal = report.tokens.groupby(report[dim]).sum().astype(float) ** power
        share = kept.tokens.groupby(kept[dim]).sum() / kept.tokens.sum()
        assert (share / (goal / goal.sum()) - 1).abs().max() < 0.08
    assert kept.doc_id.duplicated().any()
