"""Repair of conversations to system, then user and assistant in turn, by the cheapest edits.

Turns are dealt by conversation and sorted, the last first, and a dynamic program runs over them as they
stream by, batch after batch: four costs, one for each role that may stand before a turn. What it chose at
each turn fits one byte; the choices and the turns of a long conversation wait in a file in compressed
pieces until the first turn is reached, and are then read back from the first on. A task so holds one
piece, not a conversation. Which turns repeat earlier ones is found before, by a join.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsight.llm.common import BLANK_CHARS, rows_of, type_of
from netsight.session import ship_package

#: Costs of the edits.
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: Bytes of turns that wait in memory; more go to a file.
PIECE = 4 << 20
#: Emitted turns of an Arrow batch: so many, or so many bytes of text.
BATCH_ROWS, BATCH_BYTES = 2_000, 8 << 20

#: What came before: nothing, the system's turn, a user's, an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The role that an inserted or renamed turn takes, and what holds after it.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: By the initial of a kept turn's role: what may come before it, and what holds after it.
KEEP = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: In the order of ties.
EDITS = "DIKR"
LEGAL = ("su", "ua", "au")


@lru_cache(1 << 16)
def _step(after: tuple[int, ...], initial: str, must_go: bool, truncated: bool) -> tuple[tuple[int, ...], int]:
    costs, edits = [0] * 4, [0] * 4
    for before in range(4):
        options = [(DELETE + after[before], 0)]
        if not must_go:
            more = TRUNCATED * truncated
            if before in KEEP.get(initial, ()):
                options.append((more + after[KEEP[initial][before]], 2))
            options.append((REROLE + more + after[NEXT[before]], 3))
        costs[before], edits[before] = min(options)
    plain = tuple(costs)
    # Two insertions in a row lead from user and assistant back to themselves, so one is enough for them.
    for before in (USER, ASSISTANT, START, SYSTEM):
        inserted = INSERT + (plain if before >= USER else costs)[NEXT[before]]
        if (inserted, 1) < (costs[before], edits[before]):
            costs[before], edits[before] = inserted, 1
    return tuple(costs), sum(e << 2 * k for k, e in enumerate(edits))


def step(after: tuple[int, ...], initial: str, must_go: bool, truncated: bool) -> tuple[tuple[int, ...], int]:
    """Cheapest costs from a turn on, from those after it; and the edits chosen, two bits for each role before."""
    least = min(after)
    costs, edits = _step(tuple(c - least for c in after), initial, must_go, truncated)
    return tuple(c + least for c in costs), edits


#: Costs after the last turn: an open pair is closed by insertions.
END = (0, 2 * INSERT, INSERT, 0)


class _Waiting:
    """Items in order of arrival, given back in reverse; beyond a piece they wait in a file."""

    def __init__(self):
        self.items, self.size, self.file, self.ends = [], 0, None, []

    def add(self, item: tuple, size: int) -> None:
        self.items.append(item)
        self.size += size + 64
        if self.size > PIECE:
            self.file = self.file or tempfile.TemporaryFile()
            self.file.write(zlib.compress(pickle.dumps(self.items), 1))
            self.ends.append(self.file.tell())
            self.items, self.size = [], 0

    def reversed(self) -> Iterator[tuple]:
        yield from reversed(self.items)
        for k in range(len(self.ends) - 1, -1, -1):
            start = self.ends[k - 1] if k else 0
            self.file.seek(start)
            yield from reversed(pickle.loads(zlib.decompress(self.file.read(self.ends[k] - start))))
        if self.file:
            self.file.close()


class _Conversation:
    """The turns of a conversation, the last first."""

    def __init__(self, key):
        self.key, self.costs, self.waiting = key, END, _Waiting()
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.later, self.first, self.last = None, None, None

    def add(self, turn, role: str, text: str, blank: bool, again: bool, truncated: bool) -> None:
        """again: an earlier turn has the same role and text."""
        self.blank += blank
        self.duplicate += again and not blank
        truncated = truncated and not blank and not again
        self.truncated += truncated
        if self.later is not None:
            self.illegal += role[:1] + self.later not in LEGAL
        self.later = role[:1]
        if turn is not None:
            if self.first != turn:
                self.distinct += 1
            self.last = turn if self.last is None else self.last
            self.first = turn
        self.costs, edits = step(self.costs, role[:1], blank or again, truncated)
        self.waiting.add((edits, turn, role, text), len(text) + len(role))

    def repaired(self) -> Iterator[tuple]:
        """(edit, turn, role, text): role and text as repaired; null for a deleted turn."""
        before = START
        for edits, turn, role, text in self.waiting.reversed():
            while (edit := edits >> 2 * before & 3) == 1:
                before = NEXT[before]
                yield "I", None, ROLES[before], ""
            if edit == 0:
                yield "D", turn, None, None
            elif edit == 2:
                before = KEEP[role[:1]][before]
                yield "K", turn, role, text
            else:
                before = NEXT[before]
                yield "R", turn, ROLES[before], text
        while before in (SYSTEM, USER):
            before = NEXT[before]
            yield "I", None, ROLES[before], ""

    def counts(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.costs[START]


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[_Conversation]:
    """One after the other, each once all its turns have streamed by."""
    now, pending = None, None

    def take(row: tuple, again: bool) -> None:
        _, turn, role, text, _, _, blank, truncated = row
        now.add(turn, role, text, blank, again, truncated)

    for row in rows_of(batches, "key", "turn", "role", "text", "same", "early", "blank", "truncated"):
        if pending is not None:
            # Equal turns of one number stand together: the one that comes first has no earlier one.
            alike = row[0] == pending[0] and row[1] == pending[1] and row[4] == pending[4]
            take(pending, alike or not pending[5])
        if now is None or row[0] != now.key:
            if now is not None:
                yield now
            now = _Conversation(row[0])
        pending = row
    if now is not None:
        take(pending, not pending[5])
        yield now


def flaws(text: Column) -> tuple[Column, Column]:
    """Whether a text is blank; whether it does not end with a mark that closes a sentence."""
    rest = F.btrim(text, F.lit(BLANK_CHARS))
    return rest == "", ~F.right(rest, F.lit(1)).isin(".", "!", "?")


def _turns(conversations: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """Turns by conversation, the last first; `early`: no smaller number has a turn of the same role and text."""
    plain = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = conversations.select(
        F.col(key).alias("key"), F.col(turn).cast("bigint").alias("turn"), plain(role).alias("role"), plain(text).alias("text")
    )
    rows = rows.withColumn("same", F.unhex(F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256)))
    first = rows.groupBy(F.col("key").alias("k"), F.col("same").alias("s")).agg(
        F.min("turn").alias("least"), F.max(F.col("turn").isNull()).alias("unnumbered")
    )
    match = rows["key"].eqNullSafe(first["k"]) & (rows["same"] == first["s"])
    early = F.when(F.col("unnumbered"), F.col("turn").isNull()).otherwise(F.col("turn") == F.col("least"))
    blank, truncated = flaws(F.col("text"))
    return (
        rows.join(first, match)
        .select("key", "turn", "role", "text", "same", early.alias("early"), blank.alias("blank"), truncated.alias("truncated"))
        .repartition("key")
        .sortWithinPartitions("key", F.col("turn").desc_nulls_last(), F.col("role").desc(), F.col("text").desc())
    )


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _emitted(rows: DataFrame, of: Callable[[_Conversation], Iterator[tuple]], columns: str) -> DataFrame:
    """(key, columns) from the tuples that `of` gives for each conversation, some thousand to a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind: list[pa.DataType] = []

        def noted() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kind[:] = [batch.schema.field("key").type]
                yield batch

        out, size = [], 0
        types = [pa.string() if c.endswith("string") else pa.int64() for c in columns.split(", ")]
        names = ["key", *(c.split()[0] for c in columns.split(", "))]

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), [*kind, *types], strict=True)], names)

        for conversation in _conversations(noted()):
            for row in of(conversation):
                out.append((conversation.key, *row))
                size += sum(len(x) for x in row if isinstance(x, str))
                if len(out) >= BATCH_ROWS or size >= BATCH_BYTES:
                    yield batch_of()
                    out, size = [], 0
        if out:
            yield batch_of()

    return rows.mapInArrow(run, f"key {type_of(rows, 'key')}, {columns}")


def repaired(
    conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(key, place, edit, turn, role, text) of every edit of every conversation, in order of place from 0.

    edit: D, I, K or R; role and text as repaired, null for a deleted turn; turn is null for an inserted one.
    What counts as a turn, and which edits are chosen, is as in `summaries`.
    """
    ship_package(conversations.sparkSession)

    def edits(c: _Conversation) -> Iterator[tuple]:
        for place, row in enumerate(c.repaired()):
            yield (place, *row)

    rows = _turns(conversations, key, turn, role, text)
    return _emitted(rows, edits, "place bigint, edit string, turn bigint, role string, text string").withColumnRenamed("key", key)


def summaries(
    conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per conversation: key, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Turns are taken by number, null first, ties by role and text. Null roles and texts count as one space;
    rows whose key is null are a conversation. A turn's first fault counts: blank (nothing but blanks),
    duplicate (role and text seen earlier, so repeated rows too), truncated (no `.`, `!` or `?` at its end).
    gaps: numbers missing between the least and the greatest. illegal: neighbours whose roles' initials
    are none of su, ua, au. audit: the initials of the edits (Delete, Insert, Keep, Rerole) that lead to
    `(s?(ua)+)?` at the least cost, ties by the least text. repaired_sha256: of `role:text` of the repaired
    turns, joined by line ends. An empty table gives an empty one; other columns are not read.
    """
    ship_package(conversations.sparkSession)

    def summary(c: _Conversation) -> Iterator[tuple]:
        audit, digest, between = bytearray(), hashlib.sha256(), b""
        for edit, _, who, said in c.repaired():
            audit += edit.encode()
            if who is not None:
                digest.update(between + f"{who}:{said}".encode())
                between = b"\n"
        yield (*c.counts(), audit.decode(), digest.hexdigest())

    columns = ", ".join([*(f"{c} bigint" for c in COUNTS), "audit string", "repaired_sha256 string"])
    return _emitted(_turns(conversations, key, turn, role, text), summary, columns).withColumnRenamed("key", key)
