import hashlib
import heapq
import itertools
import random
import re
import zlib

import duckdb
import pytest

from fieldtree.llm import conversation_repair as R

WHITE = " \t\n\x0b\x0c\r"
ROLES = ["user", "assistant", "system", "tool", "", None]


def cheapest(kinds):
    """Least (cost, audit) by a search over (turns done, state), one edit at a time."""
    heap, seen = [((0, ""), 0, "")], set()
    after = {"": "su", "s": "u", "u": "a", "a": "u"}
    while heap:
        (cost, audit), k, state = heapq.heappop(heap)
        if k == len(kinds) and state in ("", "a"):
            return cost, audit
        if (k, state) in seen:
            continue
        seen.add((k, state))
        for role in "ua":
            if role in after[state]:
                heapq.heappush(heap, ((cost + 2, audit + "I"), k, role))
        if k < len(kinds):
            kind = kinds[k]
            heapq.heappush(heap, ((cost + 3, audit + "D"), k + 1, state))
            if kind != "D":
                cut = kind.isupper()
                for role in "ua":
                    if role in after[state]:
                        heapq.heappush(heap, ((cost + 2 + cut, audit + "R"), k + 1, role))
                if kind.lower() in after[state]:
                    heapq.heappush(heap, ((cost + cut, audit + "K"), k + 1, kind.lower()))


def test_scan_against_search():
    for n in range(5):
        for kinds in itertools.product("suaxSUAXD", repeat=n):
            if n < 4 or random.Random(str(kinds)).random() < 0.2:
                assert R.outcome(R.scan("".join(kinds))) == cheapest(kinds)
    draw = random.Random(3)
    for _ in range(200):
        kinds = "".join(draw.choice("uauasUAxD") for _ in range(draw.randint(5, 60)))
        assert R.outcome(R.scan(kinds)) == cheapest(kinds)


def test_product_is_associative():
    draw = random.Random(1)
    for _ in range(200):
        a, b, c = (R.scan("".join(draw.choice("suaxSUAXD") for _ in range(draw.randint(0, 5)))) for _ in range(3))
        assert R.product(R.product(a, b), c) == R.product(a, R.product(b, c))


def expected(rows):
    """The task by its words, on a dict of conversations."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
            turns += [(turn, "user" if code == 4 else role, text)] * {0: 0, 3: 2}.get(code, 1)
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, hashlib.md5(f"{t[1]}\0{t[2]}".encode()).digest()))
        seen, faults, kinds = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, ""
        for _, role, text in turns:
            fault = "blank" if not text.strip(WHITE) else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(WHITE)[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            kind = role[:1] if role[:1] in ("s", "u", "a") else "x"
            kinds += "D" if fault in ("blank", "duplicate") else kind.upper() if fault else kind
        cost, audit = cheapest(kinds)
        made, k = [], 0
        for edit in audit:
            role, text = ("", "") if edit == "I" else turns[k][1:]
            k += edit != "I"
            if edit != "D":
                made.append((role if edit == "K" else "assistant" if made and made[-1][0][:1] == "u" else "user", text))
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in made))
        places = {t for t, _, _ in turns if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
        out[conv] = (max(places) - min(places) + 1 - len(places) if places else 0, *faults.values(), illegal, cost, audit, digest)
    return out


def conversations(seed, n, longest):
    draw = random.Random(seed)
    texts = ["Yes.", "No", "", " \n", None, "What? ", "Ünd…", "a.\n\n", "z" * 3000 + "!"] + [f"Text {k}." for k in range(40)]
    rows = []
    for conv in [None, -3, *range(n)]:
        for turn in range(draw.randint(1, longest)):
            rows.append((conv, draw.choice([turn, turn, turn, turn + 1, None]), draw.choice(ROLES[:2] * 4 + ROLES), draw.choice(texts)))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"
FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@pytest.mark.parametrize("seed,longest,block,fan", [(1, 9, 4096, 16), (2, 60, 3, 2), (3, 25, 1, 3)])
def test_report(spark, seed, longest, block, fan):
    """Also with blocks of a turn or three, so that most conversations are joined from blocks in several tasks."""
    rows = conversations(seed, 40 if longest > 20 else 150, longest)
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", key string").repartition(5)
    got = {r.conv_id: tuple(r[c] for c in FIELDS) for r in R.repair_report(R.damaged(df), block, fan).collect()}
    assert got == expected(rows)


def test_one_long_conversation_and_copies(spark):
    draw = random.Random(8)
    rows = [(1, t, draw.choice(["user", "assistant"]), f"Line {draw.randrange(900)}{draw.choice('.!,')}") for t in range(3000)] + [(2, 5, "user", "Same.")] * 400 + [(3, 1, "user", "Hi.")]
    got = {r.conv_id: tuple(r[c] for c in FIELDS) for r in R.repair_report(R.damaged(spark.createDataFrame(rows, SCHEMA).repartition(8)), 100).collect()}
    assert got == expected(rows)


def test_repaired_turns(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Again."), (1, 2, "system", "No"), (2, 0, "assistant", None)]
    turns = R.as_turns(spark.createDataFrame(rows, SCHEMA))
    told = R.summaries(turns)
    assert {r.conv_id: r.audit for r in told.collect()} == {1: "KIKR", 2: "D"}
    made = sorted((r.conv_id, r.place, r.role, r.text) for r in R.repaired_turns(turns, told).collect())
    assert made == [(1, 0, "user", "Hi."), (1, 1, "assistant", ""), (1, 2, "user", "Again."), (1, 3, "assistant", "No")]


def test_empty_table(spark):
    assert R.repair_report(R.damaged(spark.createDataFrame([], SCHEMA))).count() == 0


def test_sql(spark, tmp_path):
    rows = conversations(5, 120, 12)
    # Places of their own, as SQL orders equal ones by role and text.
    rows = [(c, 100 * k + (t or 0) if t is not None else None if k == 0 else 7 * k, r, x) for k, (c, t, r, x) in enumerate(rows)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/c")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/c/*.parquet'")
    made = con.execute(R.repair_sql()).fetchall()
    assert {r[0]: tuple(r[1:]) for r in made} == expected(rows)
