"""How the sources of a language differ in their words: divergence of all pairs, and each source's most telling terms.

Terms are runs of ASCII letters and of characters beyond ASCII, with A-Z in lower case. A language keeps the terms
in at least ``LEAST`` of its documents, V of them. With N occurrences of kept terms, a group (a source within a
language, or the language) gives a term that occurs c times the probability p = 1 + floor(10^9 (c + 2) / (N + 2 V)), and
the difference of p and q is f = floor((p - q)^2 / (p + q)). All of it is whole numbers.

*Terms.* For one group, p follows from c, and f falls as the language's q rises towards p. So a bucket of the terms
that occur c times has a bound from the least q among them, and that bound is the value of one of its terms. Buckets are
taken best first; the ten best bounds are ten values, so once ten buckets are seen every bucket whose bound is strictly
below the tenth is left out unread, and only terms of the others are evaluated. Buckets of equal bounds are kept for ties.

*Pairs.* A sum over all V terms is never made term by term for terms that one or both sources lack. If all counts
were zero, a pair's sum would be V times one value; each bucket of one source moves it by as many terms as it holds, against the
other's probability of an unseen term; only terms that both hold, read from the postings (the sources of a term side by side),
need their own correction. Corrections are summed within tasks, so what is shuffled is a row a pair and task.

What counts is gathered in the tasks before any shuffle and flushed when a task holds ``HELD`` terms. The result has
all pairs of a language's sources, as asked for, which is what grows with their square.

Null texts, languages and sources are empty ones. Repeated rows and repeated or null ids are documents like others. Ties are
ranked by the UTF-8 of the item. A language without kept terms has pairs of value 0 and no terms; an empty table
gives an empty one. Other columns play no part.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, stored, to_arrow, trimmed

#: Documents of a language that a kept term is in, and ranks of terms.
LEAST, BEST = 10, 10
#: Terms that a task holds, bytes that it splits at once, and pairs that it has at once.
HELD, STRETCH, PAIRS = 1 << 19, 4 << 20, 1 << 20

#: Bytes to letters: A-Z in lower case, other ASCII to spaces.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, in lists of bounded bytes (but for a single longer term)."""
    plain, at = text.translate(_LETTERS), 0
    while at < len(plain):
        end = plain.find(b" ", at + STRETCH) if len(plain) - at > STRETCH else -1
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def counted(docs: DataFrame, held: int = HELD) -> DataFrame:
    """lang, source, term, n and docs: occurrences, and documents with it; a row with a null term and zeros for each group."""
    schema = "lang string, source string, term string, n long, docs long"
    arrow = to_arrow(docs, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs_) in totals.items():
                some = list(n)
                for lo in range(0, len(some), 1 << 16):
                    part = some[lo : lo + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array(part, pa.binary()).view(pa.string()), pa.array([n[t] for t in part], pa.int64()), pa.array([docs_[t] for t in part], pa.int64())], schema=arrow)
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([source]), pa.nulls(1, pa.string()), pa.array([0]), pa.array([0])], schema=arrow)
            totals.clear()

        for batch in batches:
            for some in slices(batch):
                for lang, source, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), some.column(2).to_pylist()):
                    n, docs_ = totals.setdefault((lang, source), (Counter(), Counter()))
                    parts = terms(text)
                    first = next(parts, [])
                    n.update(first)
                    distinct = set(first)
                    for more in parts:
                        n.update(more)
                        distinct.update(more)
                    docs_.update(distinct)
                if sum(len(n) for n, _ in totals.values()) > held:
                    yield from rows()
        yield from rows()

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    read = docs.select(text("lang").alias("lang"), text("source").alias("source"), F.encode(text("text"), "UTF-8").alias("text"))
    made = read.mapInArrow(lambda batches: trimmed(run(batches)), schema)
    return made.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def postings(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, term, source, n, total (of the language) and lead (one row a term) of kept terms, and rows of a null term for each group; stored."""
    term = Window.partitionBy("lang", "term")
    seen = counted(docs).withColumns({"total": F.sum("n").over(term), "spread": F.sum("docs").over(term), "lead": F.col("source") == F.min("source").over(term)})
    return stored(seen.filter((F.col("spread") >= least) | F.col("term").isNull()).select("lang", "term", "source", "n", "total", (F.col("lead") & F.col("term").isNotNull()).alias("lead")), "postings")


def probability(count: Column, whole: Column) -> Column:
    """1 + floor(10^9 (count + 2) / whole), by three digits at a time, so that nothing overflows below 9 * 10^15; null for 0."""
    over = F.nullif(whole, F.lit(0).cast("long"))
    rest, out = count.cast("long") + F.lit(2).cast("long"), F.lit(1).cast("long")
    for scale in (1_000_000, 1_000, 1):
        rest = rest * 1000
        out = out + F.call_function("div", rest, over) * scale
        rest = rest % over
    return out


def difference(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), F.nullif(p + q, F.lit(0).cast("long")))


def groups(listed: DataFrame) -> DataFrame:
    """lang, source, terms (V), whole (N + 2 V of the group), lang_whole (of the language) and unseen (p of a count of 0); stored."""
    langs = listed.groupBy("lang").agg(F.count_if("lead").alias("terms"), F.sum("n").alias("lang_n"))
    made = listed.groupBy("lang", "source").agg(F.sum("n").alias("n")).join(langs, "lang")
    made = made.select("lang", "source", "terms", (F.col("n") + 2 * F.col("terms")).alias("whole"), (F.col("lang_n") + 2 * F.col("terms")).alias("lang_whole"))
    return stored(made.withColumn("unseen", probability(F.lit(0), F.col("whole"))), "groups")


def buckets(listed: DataFrame, known: DataFrame) -> DataFrame:
    """lang, source, n, terms of that count, p, and bound: the largest f of a term in it, null if none has p > q; stored."""
    made = listed.filter("term IS NOT NULL").groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("held"), F.min("total").alias("rarest"))
    made = made.join(known, ["lang", "source"]).withColumns({"p": probability(F.col("n"), F.col("whole")), "q": probability(F.col("rarest"), F.col("lang_whole"))})
    return stored(made.select("lang", "source", "n", "held", "p", F.when(F.col("p") > F.col("q"), difference(F.col("p"), F.col("q"))).alias("bound")), "buckets")


def best_terms(listed: DataFrame, known: DataFrame, told: DataFrame, best: int = BEST) -> DataFrame:
    """lang, source, item, value and rank of each group's ``best`` terms."""
    first = Window.partitionBy("lang", "source").orderBy(F.col("bound").desc(), "n")
    ranked = told.filter("bound IS NOT NULL").withColumn("place", F.row_number().over(first))
    kth = ranked.filter(F.col("place") == best).select("lang", "source", F.col("bound").alias("kth"))
    open_ = ranked.join(kth, ["lang", "source"], "left").filter(F.col("kth").isNull() | (F.col("bound") >= F.col("kth")))
    read = listed.filter("term IS NOT NULL").join(open_.select("lang", "source", "n", "p"), ["lang", "source", "n"]).join(known.select("lang", "source", "lang_whole"), ["lang", "source"])
    valued = read.withColumn("q", probability(F.col("total"), F.col("lang_whole"))).filter("p > q").select("lang", "source", F.col("term").alias("item"), difference(F.col("p"), F.col("q")).alias("value"))
    return valued.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))).filter(F.col("rank") <= best)


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


class _Sums:
    """Sums of pairs of sources of one language."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.codes, self.values, self.size, self.sums = [], [], 0, {}

    def add(self, sources: list[str], p: np.ndarray, unseen: np.ndarray) -> None:
        """Of a term with these sources, p and probabilities of an unseen term, in blocks of bounded size."""
        at = np.array([self.number.setdefault(s, len(self.number)) for s in sources], np.int64)
        order = np.argsort(at)
        at, p, unseen = at[order], p[order], unseen[order]
        step = max(1, PAIRS // len(at))
        for lo in range(0, len(at) - 1, step):
            i, j = np.triu_indices(min(step, len(at) - lo), 1, len(at) - lo)
            i, j = i + lo, j + lo
            a, b, x, y = p[i], p[j], unseen[i], unseen[j]
            self.codes.append(at[i] << 32 | at[j])
            self.values.append(_f(a, b) - _f(a, y) - _f(x, b) + _f(x, y))
            self.size += len(i)
            if self.size >= PAIRS:
                self.fold()

    def fold(self) -> None:
        if self.codes:
            codes, at = np.unique(np.concatenate(self.codes), return_inverse=True)
            sums = np.zeros(len(codes), np.int64)
            np.add.at(sums, at, np.concatenate(self.values))
            for code, s in zip(codes.tolist(), sums.tolist()):
                self.sums[code] = self.sums.get(code, 0) + s
            self.codes, self.values, self.size = [], [], 0

    def rows(self) -> list[tuple[str, str, int]]:
        self.fold()
        names = list(self.number)
        return [(names[code >> 32], names[code & 0xFFFFFFFF], s) for code, s in self.sums.items()]


def shared_terms(listed: DataFrame, known: DataFrame) -> DataFrame:
    """lang, a, b and value: the corrections of terms that both sources hold, summed by task; each pair in one order or the other."""
    schema = "lang string, a string, b string, value long"
    arrow = to_arrow(listed, schema)
    rows = listed.filter("term IS NOT NULL").join(known.select("lang", "source", "whole", "unseen"), ["lang", "source"])
    rows = rows.select("lang", "term", "source", probability(F.col("n"), F.col("whole")).alias("p"), "unseen").repartition("lang", "term").sortWithinPartitions("lang", "term")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, now, left = None, _Sums(), None

        def done() -> Iterator[pa.RecordBatch]:
            made = now.rows()
            for lo in range(0, len(made), 1 << 16):
                part = list(zip(*made[lo : lo + (1 << 16)]))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part[0])), *(pa.array(c, f.type) for c, f in zip(part, list(arrow)[1:]))], schema=arrow)

        def take(table: pa.Table) -> Iterator[pa.RecordBatch]:
            """Whole terms of a sorted table."""
            nonlocal lang, now
            langs, words, sources = (table.column(c).to_pylist() for c in ("lang", "term", "source"))
            p, unseen = (table.column(c).to_numpy() for c in ("p", "unseen"))
            lo = 0
            for hi in range(1, len(words) + 1):
                if hi < len(words) and words[hi] == words[lo] and langs[hi] == langs[lo]:
                    continue
                if langs[lo] != lang:
                    yield from done()
                    lang, now = langs[lo], _Sums()
                if hi - lo > 1:
                    now.add(sources[lo:hi], p[lo:hi], unseen[lo:hi])
                lo = hi

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if left is None else pa.concat_tables([left, table])
            words, langs = table.column("term").to_pylist(), table.column("lang").to_pylist()
            cut = len(words)
            while cut and words[cut - 1] == words[-1] and langs[cut - 1] == langs[-1]:
                cut -= 1
            yield from take(table.slice(0, cut))
            left = table.slice(cut)
        if left is not None:
            yield from take(left)
        yield from done()

    return rows.mapInArrow(lambda batches: trimmed(run(batches)), schema)


def pair_values(listed: DataFrame, known: DataFrame, told: DataFrame) -> DataFrame:
    """lang, source, item (another source of the language) and value: the sum of f over all kept terms."""
    others = known.select("lang", F.col("source").alias("item"), F.col("unseen").alias("other"))
    both = known.join(others, "lang").filter("source <> item")
    none = both.select("lang", "source", "item", F.coalesce(F.col("terms") * difference(F.col("unseen"), F.col("other")), F.lit(0)).alias("value"))
    seen = told.join(known.select("lang", "source", "unseen"), ["lang", "source"]).join(others, "lang").filter("source <> item")
    moved = F.col("held") * (difference(F.col("p"), F.col("other")) - difference(F.col("unseen"), F.col("other")))
    one = stored(seen.groupBy("lang", "source", "item").agg(F.sum(moved).alias("value")), "one-sided")
    shared = stored(shared_terms(listed, known), "shared-terms").select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value")
    swapped = lambda df: df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    parts = none.unionByName(one).unionByName(swapped(one)).unionByName(shared).unionByName(swapped(shared))
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, least: int = LEAST, best: int = BEST) -> DataFrame:
    """lang, source, part (pair or term), item, value and rank; values fall, ties by the item."""
    listed = postings(docs, least)
    known = groups(listed)
    told = buckets(listed, known)
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pair_values(listed, known, told).withColumn("rank", F.row_number().over(order))
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return columns(pairs, "pair").unionByName(columns(best_terms(listed, known, told, best), "term"))


def divergence_sql(least: int = LEAST, best: int = BEST) -> str:
    """The same in DuckDB's SQL: every group with every kept term."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    p = "(1 + (1000000000::HUGEINT * (%s + 2)) // %s)::BIGINT"
    f = "(({0} - {1}) * ({0} - {1})) // ({0} + {1})"
    return f"""
WITH docs AS (SELECT coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS doc FROM documents),
words AS (SELECT doc, lang, source, unnest(regexp_extract_all(translate(text, '{upper}', '{lower}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT doc) AS spread FROM words GROUP BY 1, 2, 3),
kept AS (SELECT lang, term, sum(n)::BIGINT AS total FROM counts GROUP BY 1, 2 HAVING sum(spread) >= {least}),
langs AS (SELECT lang, count(*) AS v, (sum(total) + 2 * count(*))::BIGINT AS whole FROM kept GROUP BY 1),
grp AS (SELECT DISTINCT lang, source FROM docs),
cells AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.total FROM grp g JOIN kept k ON k.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sizes AS (SELECT c.lang, c.source, (sum(n) + 2 * any_value(l.v))::BIGINT AS whole, any_value(l.whole) AS lang_whole FROM cells c JOIN langs l USING (lang) GROUP BY 1, 2),
p AS MATERIALIZED (SELECT lang, source, term, n, {p % ("n", "whole")} AS p, {p % ("total", "lang_whole")} AS q FROM cells JOIN sizes USING (lang, source)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum({f.format("a.p", "b.p")})::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
every AS (SELECT g.lang, g.source, h.source AS item, coalesce(value, 0) AS value FROM grp g JOIN grp h ON h.lang = g.lang AND h.source <> g.source LEFT JOIN pairs x ON x.lang = g.lang AND x.source = g.source AND x.item = h.source),
best AS (SELECT lang, source, term AS item, {f.format("p", "q")} AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM best)
SELECT lang, source, 'pair' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM every
UNION ALL SELECT lang, source, 'term', item, value::BIGINT, rank::INT FROM ranked WHERE rank <= {best}
"""
