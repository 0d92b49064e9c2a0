"""Mixing sources to target weights (operator 2): raking, then calibrated sampling.

Documents fall into cells by source, language and topic. Iterative proportional fitting gives each
cell a weight such that weight times tokens has the target marginals of all three. Probabilities are
fitted the same way, with the bound of 1 inside the fitting: cells that reach it stay there, and the
others make up for them, so that the expected tokens of the sample have the target marginals and sum to
the stated share of all tokens. Whether a document is kept is decided by a hash of its id, so it
doesn't depend on partitions and a second run keeps the same ones.

A scarce value can't give more than it has: no target is above ``lift_of`` times the value's tokens, that is
``SLACK`` of what its documents give when each is taken as often as is allowed. What such values lack is
spread over the others in proportion to their own targets, so one stray row changes its own value and
nearly nothing else.

Token counts, cells and marginals cover all documents. Cells are aggregates: the fitting works on a
table of one row per cell: on the driver up to ``DRIVER_CELLS`` cells, and beyond that in DataFrame
operations, stored after each round. The documents
are only joined with that table; it is broadcast if its size on disk is below the engine's threshold.
Rounds go on, at least ``ROUNDS``, until no step of a round changes a weight by more than ``TOLERANCE``
of it. Marginals may contradict each other where cells are empty; then the fitting stops when it no
longer gets closer, and a warning says by how much the marginals are missed.

Default targets: each value's share of tokens to a power below 1, so that large sources, languages
and topics give way to small ones, as far as those reach. Nulls in source, language or topic count as a value of their own;
null texts have no tokens; null ids hash as the empty string. Documents without tokens get their
cell's probability like others; a cell with no tokens at all has weight 1. Repeated rows share their
fate. ``mixed`` can repeat rows, each at most ``copies`` times. Texts of any length
are only counted, in the engine. Empty tables give empty results; other columns are kept by ``mixed`` and ignored otherwise.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, unused

#: Least numbers of rounds, of weights and of probabilities.
ROUNDS, BOUNDED_ROUNDS = 8, 30
#: Largest relative change of a weight in the last round.
TOLERANCE = 1e-3
#: Fitting ends at so many rounds, or if so many rounds lower the largest change by less than a fiftieth.
MOST_ROUNDS, STALL_ROUNDS = 400, 8
#: Tables of at most so many cells (some 10 MB) are fitted by the driver, where a round costs no jobs.
DRIVER_CELLS = 1 << 17
#: Share of all tokens to keep, and the power of each marginal.
KEEP, POWERS = 0.6, {"source": 0.5, "lang": 0.7, "topic": 0.7}
#: Of all that a value of a marginal can give, as much is asked of it at most; the rest is room for the other marginals.
SLACK = 0.9
#: A row comes at most so often where rows are repeated.
COPIES = 4
SALT = "mix|"


def tokens_of(text: str = "text") -> Column:
    """Words between ASCII white space."""
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def topic_of(text: str = "text") -> Column:
    """What a text mostly looks like: a table, shouting, marked-up words, a licence, or prose."""
    t = F.coalesce(F.col(text), F.lit(""))
    return F.when(t.contains(" | "), "table").when(t.contains("!!"), "shout").when(t.contains("***"), "marks").when(t.contains("icense"), "licence").otherwise("prose")


def uniform(key: Column) -> Column:
    """A number from 0 up to 1 by a hash of the id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(SALT), F.coalesce(key.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _settled(seen: list[float], rounds: int) -> bool:
    """Whether fitting ends, after rounds with these largest changes; with a warning if marginals are missed."""
    if len(seen) >= rounds and seen[-1] <= TOLERANCE:
        return True
    if len(seen) >= max(rounds, MOST_ROUNDS) or len(seen) >= rounds + STALL_ROUNDS and seen[-1] > 0.98 * seen[-1 - STALL_ROUNDS]:
        warnings.warn(f"raking does not meet all marginals: round {len(seen)} still changes weights by up to {seen[-1]:.2g} of them", stacklevel=3)
        return True
    return False


def lift_of(keep: float, copies: float = 1) -> float:
    """How many times its own tokens a value's target can be (in tokens of a sample scaled to all tokens)."""
    return max(1.0, SLACK * copies / keep)


def _targets(n: np.ndarray, power: float, lift: float | None) -> np.ndarray:
    """Tokens that each value should have: in proportion to n to the power, at most ``lift * n``, and n's sum in all."""
    want = np.where(n > 0, n, 0.0) ** power * (n > 0)
    capped = np.zeros(len(n), bool)
    while True:
        left = n.sum() - (lift * n[capped].sum() if capped.any() else 0.0)
        scale = max(left, 0.0) / (want[~capped].sum() or 1.0)
        more = ~capped & (want * scale > lift * n) if lift else capped & False
        if not more.any():
            return np.where(capped, (lift or 0.0) * n, want * scale)
        capped |= more


def _targets_there(sums: DataFrame, power: float, lift: float | None, total: float) -> DataFrame:
    """``_targets`` of a table of values t and their tokens n, with a column target."""
    want, n = F.pow(F.col("n").cast("double"), F.lit(power)), F.col("n").cast("double")
    capped, before = F.lit(False), -1
    while True:
        row = sums.agg(F.sum(F.when(capped, n).otherwise(0.0)), F.sum(F.when(capped, 0.0).otherwise(want)), F.count_if(capped)).first()
        scale = max(total - (lift or 0.0) * (row[0] or 0.0), 0.0) / (row[1] or 1.0)
        # The scale only rises, so a value that is capped once stays capped.
        if row[2] == before or not lift:
            return sums.withColumn("target", F.when(capped, n * (lift or 0.0)).otherwise(want * scale))
        capped, before = want * F.lit(scale) > n * F.lit(lift), row[2]


def _fitted_here(cells: DataFrame, powers: dict[str, float], rounds: int, keep: float | None, copies: float, lift: float | None) -> DataFrame:
    """``_fitted`` on the driver."""
    table = cells.toArrow()
    tokens = np.array(table.column("tokens").fill_null(0), np.float64)
    fits = []
    for dim, power in powers.items():
        at = np.asarray(table.column(dim).combine_chunks().dictionary_encode(null_encoding="encode").indices)
        n = np.bincount(at, tokens)
        fits.append((at, _targets(n, power, lift), n > 0, n))
    share = 1.0 if keep is None else keep
    value = np.full(table.num_rows, share)
    seen: list[float] = []
    while table.num_rows and not (seen and _settled(seen, rounds)):
        most = 0.0
        for at, target, some, n in fits:
            full = (value >= copies) & (keep is not None)
            whole, part = np.bincount(at, tokens * full * copies, len(n)), np.bincount(at, np.where(full, 0.0, tokens * value), len(n))
            goal = target * share
            with np.errstate(divide="ignore", invalid="ignore"):
                ratio = np.where(some, np.where((part > 0) & (goal > whole), (goal - whole) / part, goal / (whole + part)), 1.0)
            most = max(most, float(np.abs(ratio - 1).max()))
            value = value * ratio[at]
        seen.append(most)
    if keep is not None:
        value = np.minimum(value, copies)
    return cells.sparkSession.createDataFrame(table.append_column("fitted", pa.array(value)))


def _fitted(cells: DataFrame, powers: dict[str, float], rounds: int, keep: float | None, copies: float = 1, lift: float | None = None) -> DataFrame:
    """``cells`` (the columns of ``powers`` and tokens) with a column fitted: weights, or how often a row is taken, at most ``copies``."""
    if cells.count() <= DRIVER_CELLS:
        return _fitted_here(cells, powers, rounds, keep, copies, lift)
    total, share = float(cells.agg(F.sum("tokens")).first()[0] or 0), 1.0 if keep is None else keep
    targets = {}
    for dim, power in powers.items():
        sums = stored(cells.groupBy(F.col(dim).alias("t")).agg(F.sum("tokens").alias("n")).filter("n > 0"), f"marginal-{dim}")
        targets[dim] = _targets_there(sums, power, lift, total)
    now, off, seen = cells.withColumn("fitted", F.lit(share)), unused(cells, "off")[0], []
    full = (F.col("fitted") >= copies) & F.lit(keep is not None)
    while True:
        now = now.withColumn(off, F.lit(0.0))
        for dim in powers:
            have = now.groupBy(F.col(dim).alias("h")).agg(F.sum(F.when(full, F.col("tokens") * copies).otherwise(0)).alias("whole"), F.sum(F.when(full, 0.0).otherwise(F.col("tokens") * F.col("fitted"))).alias("part"))
            goal = F.col("target") * share
            ratio = F.when((F.col("part") > 0) & (goal > F.col("whole")), (goal - F.col("whole")) / F.col("part")).otherwise(goal / (F.col("whole") + F.col("part")))
            ratio = have.join(targets[dim], F.col("h").eqNullSafe(F.col("t"))).select("h", ratio.alias("ratio"))
            now = now.join(ratio, F.col(dim).eqNullSafe(F.col("h")), "left").withColumn("fitted", F.col("fitted") * F.coalesce("ratio", F.lit(1.0))).withColumn(off, F.greatest(off, F.abs(F.coalesce("ratio", F.lit(1.0)) - 1))).select(*cells.columns, "fitted", off)
        # Stored, so that the planner sees that cells are few, where they are, and sends them whole.
        now = stored(now, "raked")
        seen.append(now.agg(F.max(off)).first()[0] or 0.0)
        now = now.drop(off)
        if _settled(seen, rounds):
            return now if keep is None else now.withColumn("fitted", F.least("fitted", F.lit(float(copies))))


def rake(cells: DataFrame, powers: dict[str, float], rounds: int = ROUNDS, lift: float | None = None) -> DataFrame:
    """``cells`` (the columns of ``powers`` and tokens) with a weight that meets all marginals.

    A marginal's target is the tokens' share to the given power, scaled to sum to all tokens, and at most
    ``lift`` times the value's own tokens if that is given. ``rounds`` is the least number of rounds.
    """
    return _fitted(cells, powers, rounds, None, lift=lift).withColumnRenamed("fitted", "weight")


def probabilities(cells: DataFrame, keep: float, powers: dict[str, float] | None = None, rounds: int = BOUNDED_ROUNDS, copies: int = 1) -> DataFrame:
    """``cells`` with a probability, or with ``copies`` above 1 a mean number of times, of at most ``copies``: expected
    tokens have the target marginals and are the share ``keep`` of all tokens."""
    return _fitted(cells, powers or POWERS, rounds, keep, copies, lift_of(keep, copies)).withColumnRenamed("fitted", "probability")


def calibrated(docs: DataFrame, topic: Column | None = None, text: str = "text", keep: float = KEEP, powers: dict[str, float] | None = None, rounds: int = ROUNDS, copies: int = 1) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its topic, tokens, weight and probability (see ``probabilities``), and the names of these four columns."""
    source_, lang_, topic_, tokens_, weight_, probability_, a_, b_, c_ = unused(docs, "source", "lang", "topic", "tokens", "weight", "probability", "cell_source", "cell_lang", "cell_topic")
    rows = docs.withColumns({source_: F.col("source"), lang_: F.col("lang"), topic_: topic if topic is not None else topic_of(text), tokens_: tokens_of(text)})
    cells = stored(rows.groupBy(F.col(source_).alias("source"), F.col(lang_).alias("lang"), F.col(topic_).alias("topic")).agg(F.sum(tokens_).alias("tokens")), "cells")
    made = probabilities(rake(cells, powers or POWERS, rounds, lift_of(keep, copies)), keep, powers, copies=copies)
    made = stored(made.select(F.col("source").alias(a_), F.col("lang").alias(b_), F.col("topic").alias(c_), F.col("weight").alias(weight_), F.col("probability").alias(probability_)), "probabilities")
    on = [F.col(x).eqNullSafe(F.col(y)) for x, y in ((source_, a_), (lang_, b_), (topic_, c_))]
    out = rows.join(made, on[0] & on[1] & on[2]).select(*docs.columns, topic_, tokens_, weight_, probability_)
    return out, {"topic": topic_, "tokens": tokens_, "weight": weight_, "probability": probability_}


def mixing_report(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """Per row of ``docs``: doc_id, source, lang, topic, tokens, weight, probability and whether it is kept."""
    rows, names = calibrated(docs.select(F.col(key).alias("doc_id"), "source", "lang", "text"), **options)
    probability = F.col(names["probability"])
    return rows.select("doc_id", "source", "lang", F.col(names["topic"]).alias("topic"), F.col(names["tokens"]).alias("tokens"), F.round(names["weight"], 6).alias("weight"), F.round(probability, 6).alias("probability"), (uniform(F.col("doc_id")) < probability).alias("kept"))


def mixed(docs: DataFrame, key: str = "doc_id", keep: float = KEEP, repeats: bool = False, copies: int = COPIES, **options) -> DataFrame:
    """The sampled rows of ``docs``, with their columns.

    With ``repeats``, a row can come several times, at most ``copies``, which gives scarce values more room than
    probabilities of at most 1 do. A row without tokens comes at most once.
    """
    rows, names = calibrated(docs, keep=keep, copies=copies if repeats else 1, **options)
    often = F.col(names["probability"])
    if not repeats:
        return rows.filter(uniform(F.col(key)) < often).select(*docs.columns)
    often = F.when(F.col(names["tokens"]) > 0, often).otherwise(F.least(F.lit(1.0), often))
    times, copy = unused(rows, "times", "copy")
    made = rows.withColumn(times, (F.floor(often) + (uniform(F.col(key)) < often - F.floor(often)).cast("int")).cast("int"))
    return made.filter(F.col(times) > 0).withColumn(copy, F.explode(F.array_repeat(F.lit(0), F.col(times)))).select(*docs.columns)


def mixing_sql(keep: float = KEEP, powers: dict[str, float] | None = None, rounds: int = ROUNDS, bounded: int = BOUNDED_ROUNDS) -> str:
    """DuckDB SQL for ``mixing_report`` of the table documents: both fittings are recursive, a step a round."""
    powers = powers or POWERS
    lift = lift_of(keep)
    steps = ["""docs AS (SELECT doc_id, source, lang, CASE WHEN contains(t, ' | ') THEN 'table' WHEN contains(t, '!!') THEN 'shout' WHEN contains(t, '***') THEN 'marks' WHEN contains(t, 'icense') THEN 'licence' ELSE 'prose' END AS topic,
    len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+'))::BIGINT AS tokens FROM (SELECT *, coalesce(text, '') AS t FROM documents))""", "cells AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM docs GROUP BY ALL)"]
    for d, power in powers.items():
        # Scarcest first: those before the first that isn't capped are capped, and the rest share what is left.
        steps.append(f"""t_{d} AS MATERIALIZED (SELECT {d}, CASE WHEN place < coalesce(min(place) FILTER (scale * want <= {lift} * n) OVER (), place + 1) THEN {lift} * n ELSE want * arg_min(scale, place) FILTER (scale * want <= {lift} * n) OVER () END AS target
FROM (SELECT *, (sum(n) OVER () - {lift} * (sum(n) OVER o - n)) / (sum(want) OVER () - (sum(want) OVER o - want)) AS scale, row_number() OVER o AS place FROM (SELECT {d}, sum(tokens) AS n, pow(sum(tokens), {power}) AS want FROM cells GROUP BY {d}) WHERE n > 0 WINDOW o AS (ORDER BY want / n DESC, {d} ROWS UNBOUNDED PRECEDING)))""")

    def loop(name: str, start: float, least: int, full: str) -> str:
        """The table ``name``: cells with v, fitted to targets times ``start``."""
        last, past = "seen[len(seen)]", f"seen[len(seen) - {STALL_ROUNDS}]"
        over = f"(len(seen) >= {least} AND {last} <= {TOLERANCE} OR len(seen) >= {max(least, MOST_ROUNDS)} OR len(seen) >= {least + STALL_ROUNDS} AND {last} > 0.98 * {past})"
        at = f"(SELECT *, 0.0::DOUBLE AS off FROM {name}_rounds WHERE NOT {over})"
        for d in powers:
            own = f"OVER (PARTITION BY w.{d})"
            at = f"""(SELECT source, lang, topic, tokens, v * r AS v, seen, greatest(off, abs(r - 1)) AS off FROM (SELECT *, coalesce(CASE WHEN part > 0 AND goal > whole THEN (goal - whole) / part ELSE goal / (whole + part) END, 1) AS r FROM
(SELECT w.*, t.target * {start} AS goal, sum(CASE WHEN {full} THEN w.tokens ELSE 0 END) {own} AS whole, sum(CASE WHEN {full} THEN 0 ELSE w.tokens * v END) {own} AS part FROM {at} w LEFT JOIN t_{d} t ON t.{d} IS NOT DISTINCT FROM w.{d})))"""
        return f"""{name}_rounds AS (SELECT source, lang, topic, tokens, {start}::DOUBLE AS v, []::DOUBLE[] AS seen FROM cells
UNION ALL SELECT source, lang, topic, tokens, v, list_append(seen, max(off) OVER ()) AS seen FROM {at}),
{name} AS MATERIALIZED (SELECT source, lang, topic, v FROM {name}_rounds WHERE len(seen) = (SELECT max(len(seen)) FROM {name}_rounds))"""

    # Probabilities: cells at 1 or above count whole, and the others make up for them.
    steps += [loop("weights", 1.0, rounds, "false"), loop("shares", keep, bounded, "v >= 1")]
    return f"""WITH RECURSIVE {', '.join(steps)}
SELECT d.doc_id, d.source, d.lang, d.topic, d.tokens, round(w.v, 6) AS weight, round(least(1, p.v), 6) AS probability,
('0x' || substr(md5('{SALT}' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT / {1 << 52}.0::DOUBLE < least(1, p.v) AS kept
FROM docs d JOIN weights w ON w.source IS NOT DISTINCT FROM d.source AND w.lang IS NOT DISTINCT FROM d.lang AND w.topic IS NOT DISTINCT FROM d.topic
JOIN shares p ON p.source IS NOT DISTINCT FROM d.source AND p.lang IS NOT DISTINCT FROM d.lang AND p.topic IS NOT DISTINCT FROM d.topic"""
