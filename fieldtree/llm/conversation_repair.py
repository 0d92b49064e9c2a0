"""Repair of a conversation's structure at the least cost, by a scan of min-plus matrices.

A conversation is well formed if the initials of its roles are ``(s?(ua)+)?``. Its four states are the start, after
a system turn, after a user's and after an assistant's; it may end at the start or after an assistant. A turn is
a 4x4 matrix from state to state: Keep (0, to the state of its own initial), Rerole to user or assistant (2) and Delete
(3, the state stays; all there is for blank and duplicate turns). Truncated turns that stay add 1. The closure of Insert (2, an
empty turn of user or assistant) is a matrix too, and stands between turns.

Elements are (cost, audit), the edits' initials. Products take sums of costs and audits one after the other; the least
element wins, by cost and then by the audit's ASCII. Two audits of one cost over the same turns are never prefixes of
one another (what follows the shorter one could only be inserts, which cost), so the order holds under
concatenation, and the product is associative: turns are scanned in blocks, blocks are joined as a tree.

1. Turns are counted by conversation, place and a digest of role and text, so that copies become one row; the
   first place of each role and text tells duplicates. Only digests move, no text.
2. Turns are dealt by ranges of (conversation, place), so that a long conversation is spread over tasks. Each task
   gives blocks of turns: a matrix, counts, and both ends' initials and places, which join associatively, too.
3. Blocks of one conversation are joined, ``FAN`` at a time, until one is left.
4. The audit goes ahead of its conversation's turns, which a task reads in order and edits one by one.

A digest of a conversation's whole text is sequential, so in step 4 a conversation is one task's stream; the task
holds its audit and one turn at a time. Step 4's turns are the operator's output (``repaired_turns``), or digests of them.

Turns of equal place are in the order of the MD5 of role and text. Null roles and texts are one space, and so is a null
id or place where a rule asks for a text. Null ids are one conversation. A conversation without turns costs
nothing. Repeated rows are turns like others (the later ones duplicates). Roles with other initials can only be
reroled or deleted. An empty table gives an empty one; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, trimmed

#: Turns of one block, blocks that are joined at once, and turns whose matrix is looked up.
BLOCK, FAN, SHORT = 4096, 16, 6

# Fixed values of the task: states, costs of edits, and the white space that doesn't count.
START, SYSTEM, USER, ASSISTANT = range(4)
REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1
SPACE = " \t\n\x0b\x0c\r"

Element = tuple[int, str] | None
Matrix = tuple[tuple[Element, ...], ...]
_NEXT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}


def product(a: Matrix, b: Matrix) -> Matrix:
    """Least (cost, audit) over the state between; None is without a way."""
    columns = tuple(zip(*b))
    return tuple(tuple(min(((x[0] + y[0], x[1] + y[1]) for x, y in zip(row, column) if x is not None and y is not None), default=None) for column in columns) for row in a)


def _least(elements: dict[tuple[int, int], list[tuple[int, str]]]) -> Matrix:
    return tuple(tuple(min(elements.get((i, j), ()), default=None) for j in range(4)) for i in range(4))


UNIT: Matrix = _least({(i, i): [(0, "")] for i in range(4)})


def _closure() -> Matrix:
    """Any number of inserts: one more of them never pays once no element changes."""
    once = _least({(i, j): [(INSERT, "I")] for role in "ua" for i, j in _NEXT[role].items()})
    now = UNIT
    while True:
        more = product(now, once)
        wider = tuple(tuple(min((e for e in (x, y) if e is not None), default=None) for x, y in zip(*rows)) for rows in zip(now, more))
        if wider == now:
            return now
        now = wider


CLOSURE = _closure()


@lru_cache(maxsize=None)
def turn_matrix(kind: str) -> Matrix:
    """Of a kind of turn: ``D`` is a blank or duplicate one, else the initial (``x`` for others), in upper case if truncated. With the closure behind it."""
    out: dict[tuple[int, int], list[tuple[int, str]]] = {(i, i): [(DELETE, "D")] for i in range(4)}
    if kind != "D":
        cut = CUT if kind.isupper() else 0
        for i, j in _NEXT.get(kind.lower(), {}).items():
            out.setdefault((i, j), []).append((cut, "K"))
        for role in "ua":
            for i, j in _NEXT[role].items():
                out.setdefault((i, j), []).append((REROLE + cut, "R"))
    return product(_least(out), CLOSURE)


@lru_cache(maxsize=1 << 16)
def _short(kinds: str) -> Matrix:
    if len(kinds) < 2:
        return turn_matrix(kinds) if kinds else UNIT
    return product(_short(kinds[: len(kinds) // 2]), _short(kinds[len(kinds) // 2 :]))


def scan(kinds: str) -> Matrix:
    """The product of all turns' matrices, as a tree; equal stretches of a few turns are multiplied once a worker."""
    level = [_short(kinds[k : k + SHORT]) for k in range(0, len(kinds), SHORT)] or [UNIT]
    while len(level) > 1:
        level = [product(*pair) if len(pair) == 2 else pair[0] for pair in (level[k : k + 2] for k in range(0, len(level), 2))]
    return level[0]


def outcome(matrix: Matrix) -> tuple[int, str]:
    """Cost and audit of a whole conversation (inserts may come first)."""
    first = product((CLOSURE[START],), matrix)[0]
    return min(e for e in (first[START], first[ASSISTANT]) if e is not None)


# --- turns -----------------------------------------------------------------------------------------------------------


def _spaced(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies (0 where the turn is dropped), damaged by the checksum of id and place, modulo 20."""
    code = F.crc32(F.concat(_spaced("conv_id"), F.lit(":"), _spaced("turn"))) % 20
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), _spaced("role").alias("role"), _spaced("text").alias("text"), code.alias("code"))
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("code") == 0, 0).when(F.col("code") == 3, 2).otherwise(1).cast("long").alias("copies"))


def as_turns(rows: DataFrame) -> DataFrame:
    """Undamaged rows in the form of ``damaged``."""
    return rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), _spaced("role").alias("role"), _spaced("text").alias("text"), F.lit(1).cast("long").alias("copies"))


def _key() -> Column:
    return F.unhex(F.md5(F.concat(F.encode("role", "UTF-8"), F.lit(b"\0"), F.encode("text", "UTF-8"))))


def _place() -> Column:
    """Rank of a place: nulls first."""
    return F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))


def kinds(turns: DataFrame) -> DataFrame:
    """conv_id, turn, key, n (rows alike), kind and initial of the first of them, and whether it is a duplicate itself; dropped turns have n = 0."""
    last = F.substring(F.rtrim("text", F.lit(SPACE)), -1, 1)
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    told = turns.select("conv_id", "turn", _key().alias("key"), "copies", initial.alias("initial"), F.when(last == "", "D").when(last.isin(".", "!", "?"), known).otherwise(F.upper(known)).alias("kind"))
    told = told.withColumns({"kind": F.when(F.col("copies") == 0, "").otherwise(F.col("kind")), "key": F.when(F.col("copies") > 0, F.col("key")), "turn": F.when(F.col("copies") > 0, F.col("turn")), "initial": F.when(F.col("copies") > 0, F.col("initial"))})
    rows = stored(told.groupBy("conv_id", "turn", "key", "kind", "initial").agg(F.sum("copies").alias("n")), "turns")
    solid = rows.filter("kind NOT IN ('D', '')")
    # Only what stands at two places needs to know which is first.
    again = solid.groupBy("conv_id", "key").agg(F.count(F.lit(1)).alias("places"), F.min(_place()).alias("first")).filter("places > 1")
    again = again.select(F.col("conv_id").alias("c"), F.col("key").alias("k"), F.col("first.turn").alias("first"), F.lit(True).alias("again"))
    joined = rows.join(again, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("key") == F.col("k")), "left")
    return joined.select("conv_id", "turn", "key", "n", "kind", "initial", (F.coalesce("again", F.lit(False)) & ~F.col("turn").eqNullSafe(F.col("first"))).alias("later"))


# --- blocks ----------------------------------------------------------------------------------------------------------

_COUNTS = ("blank", "duplicate", "truncated", "illegal", "places")
_BLOCK = "conv_id long, part long, number long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", first_initial string, last_initial string, low long, high long, costs array<long>, audits array<string>"
_LEGAL = {"su", "ua", "au"}


def _flat(matrix: Matrix) -> tuple[list[int | None], list[str | None]]:
    cells = [e for row in matrix for e in row]
    return [None if e is None else e[0] for e in cells], [None if e is None else e[1] for e in cells]


def _square(costs: list[int | None], audits: list[str | None]) -> Matrix:
    cells = [None if c is None else (c, a) for c, a in zip(costs, audits)]
    return tuple(tuple(cells[4 * i : 4 * i + 4]) for i in range(4))


class _Open:
    """A block that is being read."""

    def __init__(self, conv: int | None):
        self.conv, self.kinds, self.size, self.first, self.last, self.low, self.high = conv, [], 0, None, None, None, None
        self.counts = dict.fromkeys(_COUNTS, 0)

    def add(self, turn: int | None, n: int, kind: str, initial: str, later: bool) -> None:
        if n == 0:
            return
        blank, copies = kind == "D", n - (not later)
        self.counts["blank"] += n * blank
        self.counts["duplicate"] += 0 if blank else copies
        self.counts["truncated"] += kind.isupper() and not blank and not later
        self.kinds.append("D" * n if blank or later else kind + "D" * copies)
        self.size += n
        self.counts["illegal"] += (self.last is not None and self.last + initial not in _LEGAL) + (n - 1)
        self.first, self.last = initial if self.first is None else self.first, initial
        if turn is not None:
            self.counts["places"] += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn

    def row(self, part: int, number: int) -> tuple:
        return (self.conv, part, number, *self.counts.values(), self.first, self.last, self.low, self.high, *_flat(scan("".join(self.kinds))))


def joined(rows: list[tuple]) -> tuple:
    """One block of several that follow each other (rows of ``_BLOCK``); numbered like the first."""
    out = rows[0]
    for row in rows[1:]:
        counts = [a + b for a, b in zip(out[3:8], row[3:8])]
        if out[9] is not None and row[8] is not None:
            counts[3] += out[9] + row[8] not in _LEGAL
        if out[11] is not None and out[11] == row[10]:
            counts[4] -= 1
        known = lambda a, b: b if a is None else a
        out = (*out[:3], *counts, known(out[8], row[8]), known(row[9], out[9]), known(out[10], row[10]), known(row[11], out[11]), *out[12:])
    level = [_square(*row[12:]) for row in rows]
    while len(level) > 1:
        level = [product(*pair) if len(pair) == 2 else pair[0] for pair in (level[k : k + 2] for k in range(0, len(level), 2))]
    return (*out[:12], *_flat(level[0]))


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


def blocks(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """Blocks of at most about ``block`` turns (``_BLOCK``), in the order of (part, number); stored. A copied turn isn't cut."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(_BLOCK))
    order = ["conv_id", "turn", "key"]
    tasks = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, now, done = TaskContext.get().partitionId(), 0, None, []
        for batch in batches:
            for conv, turn, n, kind, initial, later in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "n", "kind", "initial", "later"))):
                if now is None or now.conv != conv or now.size >= block:
                    if now is not None:
                        done.append(now.row(part, number))
                        number += 1
                    now = _Open(conv)
                now.add(turn, n, kind, initial, later)
                if len(done) >= 512:
                    yield _table(done, arrow)
                    done = []
        if now is not None:
            done.append(now.row(part, number))
        if done:
            yield _table(done, arrow)

    dealt = turns.select(*order, "n", "kind", "initial", "later").repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    return stored(dealt.mapInArrow(lambda batches: trimmed(run(batches)), _BLOCK), "blocks")


def one_block(made: DataFrame, fan: int = FAN) -> DataFrame:
    """The one block of each conversation: those of a conversation with several are numbered and joined, ``fan`` at a time."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(_BLOCK))
    # Blocks of a conversation lie side by side, so their places in the whole are theirs but for an offset; a row a partition on the driver.
    sizes = made.groupBy("part").agg((F.max("number") + 1).alias("n")).orderBy("part").collect()
    offsets, total = [], 0
    for r in sizes:
        offsets.append((r.part, total))
        total += r.n
    spark = made.sparkSession
    placed = made.join(F.broadcast(spark.createDataFrame(offsets, "of long, ahead long")), F.col("part") == F.col("of")).withColumn("number", F.col("number") + F.col("ahead")).drop("of", "ahead")
    starts = placed.groupBy(F.col("conv_id").alias("c")).agg(F.min("number").alias("least"), F.max("number").alias("most"))
    placed = placed.join(starts, F.col("conv_id").eqNullSafe(F.col("c"))).withColumns({"part": F.lit(0).cast("long"), "many": F.col("most") - F.col("least") + 1, "number": F.col("number") - F.col("least")})
    columns = [f.split()[0] for f in _BLOCK.split(", ")]
    single, many = placed.filter("many = 1").select(*columns), placed.filter("many > 1")
    deepest = many.agg(F.max("many")).first()[0]
    if not deepest:
        return single

    def join(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in columns)), key=lambda r: r[2])
        out = joined(rows)
        return pa.Table.from_batches([_table([(*out[:2], out[2] // fan, *out[3:])], arrow)])

    now = many.select(*columns)
    while deepest > 1:
        now = stored(now.groupBy("conv_id", F.floor(F.col("number") / fan)).applyInArrow(join, _BLOCK), "joined-blocks")
        deepest = -(-deepest // fan)
    return single.unionByName(now)


# --- output ----------------------------------------------------------------------------------------------------------

_SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def summaries(turns: DataFrame, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit of every conversation (``turns``: like ``damaged``)."""

    @F.udf("cost long, audit string", useArrow=True)
    def settle(costs, audits):
        return outcome(_square(list(costs), list(audits)))

    whole = one_block(blocks(kinds(turns), block), fan).withColumn("best", settle("costs", "audits"))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("places"), F.lit(0))
    return stored(whole.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", F.col("best.cost").alias("cost"), F.col("best.audit").alias("audit")), "summaries")


class _Editor:
    """Follows an audit along the turns of a conversation."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def _step(self, edit: str, role: str, text: str) -> Iterator[tuple[str, str]]:
        if edit == "D":
            return
        if edit != "K":
            role = "assistant" if self.state == USER else "user"
        self.state = _NEXT[role[:1]][self.state]
        yield role, "" if edit == "I" else text

    def inserts(self) -> Iterator[tuple[str, str]]:
        while self.audit.startswith("I", self.at):
            self.at += 1
            yield from self._step("I", "", "")

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserts()
        self.at += 1
        yield from self._step(self.audit[self.at - 1], role, text)


def _edited(turns: DataFrame, told: DataFrame, schema: str, begin: Callable, take: Callable, end: Callable) -> DataFrame:
    """Streams each conversation, its summary first, through an editor; ``begin(summary)`` makes a state, ``take(state, turn)`` and ``end(state)`` give rows."""
    names = [f.split()[0] for f in _SUMMARY.split(", ")]
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    nothing = {c: F.lit(None).cast(t) for c, t in (f.split() for f in _SUMMARY.split(", ")) if c != "conv_id"}
    ahead = told.select(*names, F.lit(True).alias("head"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("binary").alias("key"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("copies"))
    rows = turns.filter("copies > 0").withColumns(nothing).select(*names, F.lit(False).alias("head"), "turn", _key().alias("key"), "role", "text", "copies")
    order = [F.col("conv_id"), F.col("head").desc(), F.col("turn"), F.col("key")]
    dealt = ahead.unionByName(rows).repartition("conv_id").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, editor, state = [], 0, None, None
        for batch in batches:
            for part in slices(batch):
                heads = zip(*(part.column(c).to_pylist() for c in names))
                for summary, head, role, text, copies in zip(heads, *(part.column(c).to_pylist() for c in ("head", "role", "text", "copies"))):
                    if head:
                        if editor is not None:
                            out += end(state, editor.inserts())
                        editor, state = _Editor(summary[-1]), begin(summary)
                    for _ in range(copies):
                        out += take(state, editor.turn(role, text))
                        size += len(text)
                    if len(out) >= 4096 or size >= 4 << 20:
                        yield _table(out, arrow)
                        out, size = [], 0
        if editor is not None:
            out += end(state, editor.inserts())
        if out:
            yield _table(out, arrow)

    return dealt.mapInArrow(lambda batches: trimmed(run(batches)), schema)


def repaired_turns(turns: DataFrame, told: DataFrame) -> DataFrame:
    """conv_id, place (from 0), role and text of every turn after the edits of ``summaries``."""

    def take(state: list, made: Iterator) -> list[tuple]:
        rows = [(state[0], state[1] + k, *turn) for k, turn in enumerate(made)]
        state[1] += len(rows)
        return rows

    return _edited(turns, told, "conv_id long, place long, role string, text string", lambda summary: [summary[0], 0], take, take)


def repair_report(turns: DataFrame, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """``summaries`` with repaired_sha256: the digest of the repaired turns as ``role:text`` lines."""

    def take(state: list, made: Iterator) -> list[tuple]:
        for role, text in made:
            state[1].update((("\n" if state[2] else "") + role + ":" + text).encode())
            state[2] = True
        return []

    def end(state: list, made: Iterator) -> list[tuple]:
        take(state, made)
        return [(*state[0], state[1].hexdigest())]

    return _edited(turns, summaries(turns, block, fan), _SUMMARY + ", repaired_sha256 string", lambda summary: [summary, hashlib.sha256(), False], take, end)


# --- SQL --------------------------------------------------------------------------------------------------------------


def repair_sql() -> str:
    """The query in DuckDB's SQL: one turn after another, with the least way to each of the four states, and no matrices."""
    crc = "xor(list_reduce(list_transform(string_split(k, ''), lambda c: ascii(c)::BIGINT), lambda acc, b: list_reduce(range(8), lambda x, j: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(acc, b)), 4294967295::BIGINT), 4294967295)"
    to = lambda e, cost, edit: f"{{'c': ({e}).c + {cost}, 'a': ({e}).a || '{edit}'}}"
    of = lambda k: f"v[{k}]"
    none = "{'c': 1000000000::BIGINT, 'a': ''}"
    stay = f"CASE WHEN forced THEN {none} ELSE %s END"
    user = f"list_min([{of(1)}, {of(2)}, {of(4)}])"
    step = (
        f"[{to(of(1), 3, 'D')}, list_min([{to(of(2), 3, 'D')}, {stay % f"CASE WHEN initial = 's' THEN {to(of(1), 'cut', 'K')} ELSE {none} END"}]), "
        f"list_min([{to(of(3), 3, 'D')}, {stay % f"CASE WHEN initial = 'u' THEN {to(user, 'cut', 'K')} ELSE {to(user, '2 + cut', 'R')} END"}]), "
        f"list_min([{to(of(4), 3, 'D')}, {stay % f"CASE WHEN initial = 'a' THEN {to(of(3), 'cut', 'K')} ELSE {to(of(3), '2 + cut', 'R')} END"}])]"
    )
    closed = f"[w[1], w[2], list_min([w[3], {to('w[1]', 2, 'I')}, {to('w[2]', 2, 'I')}, {to('w[4]', 2, 'I')}]), list_min([w[4], {to('w[3]', 2, 'I')}, {to('w[1]', 4, 'II')}, {to('w[2]', 4, 'II')}])]"
    return f"""
WITH RECURSIVE src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
codes AS (SELECT *, {crc} % 20 AS code FROM src),
told AS (SELECT conv_id, turn, CASE code WHEN 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE code WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM codes WHERE code <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, left(role, 1) AS initial, regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) AS final FROM told),
faults AS (SELECT *, final = '' AS blank, final <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS ahead FROM placed),
turns AS MATERIALIZED (SELECT *, blank OR again AS forced, (NOT blank AND NOT again AND final NOT IN ('.', '!', '?'))::INT AS cut FROM faults),
way AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, [{{'c': 0::BIGINT, 'a': ''}}, {none}, {{'c': 2::BIGINT, 'a': 'I'}}, {{'c': 4::BIGINT, 'a': 'II'}}] AS v FROM src
UNION ALL SELECT conv_id, i, {closed} FROM (SELECT way.conv_id, t.i, {step} AS w FROM way JOIN turns t ON t.conv_id IS NOT DISTINCT FROM way.conv_id AND t.i = way.i + 1)),
best AS MATERIALIZED (SELECT conv_id, list_min([last[1], last[4]]).c AS cost, list_min([last[1], last[4]]).a AS audit FROM (SELECT conv_id, arg_max(v, i) AS last FROM way GROUP BY conv_id)),
edits AS (SELECT conv_id, k, edit, count(*) FILTER (WHERE edit <> 'I') OVER (PARTITION BY conv_id ORDER BY k) AS i FROM (SELECT conv_id, unnest(range(1, length(audit) + 1)) AS k, unnest(string_split(audit, '')) AS edit FROM best WHERE audit <> '')),
items AS (SELECT e.conv_id, k, edit, t.role, t.text, row_number() OVER (PARTITION BY e.conv_id ORDER BY k) AS m, first_value(edit = 'K' AND t.initial = 's') OVER (PARTITION BY e.conv_id ORDER BY k) AS led FROM edits e LEFT JOIN turns t ON t.conv_id IS NOT DISTINCT FROM e.conv_id AND t.i = e.i AND e.edit <> 'I' WHERE edit <> 'D'),
made AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (m - coalesce(led, false)::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS whole FROM items GROUP BY conv_id),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count_if(blank)::BIGINT AS blank, count_if(again)::BIGINT AS duplicate, sum(cut)::BIGINT AS truncated, count_if(ahead IS NOT NULL AND ahead || initial NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal FROM turns GROUP BY conv_id)
SELECT b.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, b.cost, b.audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM best b LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN made m ON m.conv_id IS NOT DISTINCT FROM b.conv_id
"""
