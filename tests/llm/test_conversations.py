import hashlib
import heapq
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from netsight.llm import conversations, queries

SHAPE = re.compile(r"(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string, key string, audit int, same string, copy int"


def plain_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def plain_summary(rows):
    """By exhaustive search over edits, cheapest first and then by audit; rows (turn, role, text) of one conversation."""
    rows = plain_order([(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows])
    seen, faults = set(), []
    for _, role, text in rows:
        core = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
        seen.add((role, text))
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, i, roles, said = heapq.heappop(queue)
        if i == len(rows) and SHAPE.fullmatch(roles):
            break
        if (i, roles[-2:], len(roles) == 1) in done:
            continue
        done.add((i, roles[-2:], len(roles) == 1))
        nexts = []
        for who in ("user", "assistant"):
            nexts.append((cost + 3, audit + "I", i, roles + who[0], (*said, f"{who}:")))
        if i < len(rows):
            _, role, text = rows[i]
            nexts.append((cost + 4, audit + "D", i + 1, roles, said))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 * (faults[i] == "truncated")
                nexts.append((cost + more, audit + "K", i + 1, roles + (role[:1] or "?"), (*said, f"{role}:{text}")))
                for who in ("user", "assistant"):
                    nexts.append((cost + 3 + more, audit + "R", i + 1, roles + who[0], (*said, f"{who}:{text}")))
        for x in nexts:
            if re.fullmatch(r"(s?(ua)*u?)?", x[3]):
                heapq.heappush(queue, x)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()), said


def conversation(r, n):
    roles = ["user", "assistant", "system", "tool", "", None, "USER"]
    texts = ["Hello.", "Hello", "Hello.", "Why?", " \n", "", None, "Yes! ", "a\x1c", "Überß.\n", "b"]
    weights = (8, 8, 2, 1, 1, 1, 1)
    return [(r.choice([None, *range(n)]), r.choices(roles, weights)[0], r.choice(texts) if r.random() < 0.6 else f"{r.random()}.") for _ in range(n)]


@pytest.fixture(scope="module")
def many():
    r = random.Random(3)
    convs = {k: conversation(r, r.choice([1, 1, 2, 3, 5, 8])) for k in range(150)}
    convs[None] = [(0, "user", "Hi."), (0, "user", "Hi."), (None, "user", "Hi."), (1, "assistant", "Ho.")]
    convs[900] = [(None, None, None)] * 3
    convs[901] = [(i, "ua"[i % 2].replace("u", "user").replace("a", "assistant"), f"{i}." + "x. " * 20_000) for i in range(8)]
    return convs


def table_of(spark, convs):
    rows = [(k, *row, "k", 1, "s", 2) for k, turns in convs.items() for row in turns]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_summaries(spark, many, small_batches):
    """Ties, null and repeated rows, long texts, clashing columns, and conversations over several Arrow batches."""
    found = {r.conv_id: tuple(r)[1:] for r in conversations.summaries(table_of(spark, many)).collect()}
    assert found == {k: plain_summary(rows)[0] for k, rows in many.items()}
    assert conversations.summaries(table_of(spark, many).limit(0)).count() == 0


def test_repaired_turns(spark, many):
    rows = conversations.repaired(table_of(spark, many)).collect()
    for k, turns in many.items():
        mine = sorted((r for r in rows if r.conv_id == k), key=lambda r: r.place)
        summary, said = plain_summary(turns)
        assert [r.place for r in mine] == list(range(len(summary[6])))
        assert "".join(r.edit for r in mine) == summary[6]
        assert tuple(f"{r.role}:{r.text}" for r in mine if r.edit != "D") == said


@pytest.mark.parametrize("piece", [1, 500, 1 << 30])
def test_turns_wait_in_a_file(monkeypatch, piece):
    monkeypatch.setattr(conversations, "PIECE", piece)
    r = random.Random(piece)
    rows = [(i, r.choice(["user", "assistant", "system"]), f"{i} " + "x" * r.randint(0, 90) + r.choice(["", "."])) for i in range(300)]
    c = conversations._Conversation(1)
    for turn, role, text in reversed(rows):
        c.add(turn, role, text, False, False, text[-1] != ".")
    assert bool(c.waiting.ends) == (piece < 1 << 30)
    edits = list(c.repaired())
    roles = "".join(role[0] for edit, _, role, _ in edits if edit != "D")
    assert SHAPE.fullmatch(roles)
    assert [turn for edit, turn, _, _ in edits if edit != "I"] == [turn for turn, _, _ in rows]
    costs = {"D": 4, "I": 3, "K": 0, "R": 3}
    assert sum(costs[e] + 3 * (e in "KR" and text[-1:] != ".") for e, _, _, text in edits) == c.costs[conversations.START]


def test_one_byte_for_the_choices():
    for after in itertools.product((0, 1, 4, 9), repeat=4):
        for initial, go, cut in itertools.product("suax", (True, False), (True, False)):
            assert 0 <= conversations.step(after, initial, go, cut)[1] < 256


def test_damage(spark):
    rows = [(c, t, "assistant" if t and t % 2 else None, "A. B! C?" if t != 3 else None, "k", 1, "s", 2) for c in range(40) for t in [*range(6), None]]
    turns = spark.createDataFrame(rows, SCHEMA)
    import zlib

    expected = []
    for c, t, role, text, *_ in rows:
        fault = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", " " if text is None else text
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        expected += [(c, t, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    found = [tuple(r) for r in queries.damaged(turns).collect()]
    assert sorted(map(repr, found)) == sorted(map(repr, expected))


def test_query_names_every_conversation(spark, tmp_path):
    import zlib

    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "Hi."), (None, None, None, None), (-1, 5, "user", "Hi.")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = {r.conv_id: r for r in queries.conversation_repair(spark, str(tmp_path)).collect()}
    assert set(found) == {gone, None, -1}
    assert tuple(found[gone])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_hot_conversation_repeats_are_found_without_its_task(spark):
    """Repeats come from a join by content: the plan has no window and no list per conversation."""
    plan = conversations.summaries(spark.createDataFrame([(1, 0, "user", "x.")], "conv_id long, turn long, role string, text string"))
    text = plan._jdf.queryExecution().toString()
    assert "Window" not in text and "collect_" not in text
    assert plan.select(F.col("audit")).first().audit == "KI"
