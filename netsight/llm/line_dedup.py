"""Deletes passages of whole lines that repeat an earlier passage, found by winnowing over line hashes.

Lines without a word are passed over. A passage is a run of consecutive lines with at least `min_words`
words. In every shortest passage, from each line on and up to each line, the gram (shortest run with half
as many words) with the smallest hash is a fingerprint; equal passages choose the same one. Only where a
fingerprint occurs again is it extended both ways to the passages that chose it, and of equal passages
all but the first are deleted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsight.llm.common import fresh, rows_of, type_of
from netsight.session import cut_lineage, ship_package

DIGEST = 16


def line_sketch(text: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Of the lines with a word: their digests, their numbers of words, their places among all lines."""
    digests, sizes, places = [], [], []
    for place, line in enumerate(text.split(b"\n")):
        if words := line.split():
            digests.append(xxhash.xxh3_128_digest(b" ".join(words)))
            sizes.append(len(words))
            places.append(place)
    return b"".join(digests), np.array(sizes, np.int32), np.array(places, np.int32)


def _shortest(total: np.ndarray, words: int) -> np.ndarray:
    """For each line, the end (exclusive) of the shortest run from it with so many words; n + 1 if there is none."""
    return np.searchsorted(total[1:], total[:-1] + words) + 1


def passages(digests: bytes, sizes: np.ndarray, min_words: int) -> Iterator[tuple[int, int, int]]:
    """(fingerprint, first line, end) of every shortest passage of a document."""
    n = len(sizes)
    total = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    if not n or total[-1] < min_words:
        return
    ends = _shortest(total, min_words).tolist()
    runs = {(i, e) for i, e in enumerate(ends) if e <= n}
    starts = np.searchsorted(total, total[1:] - min_words, side="right") - 1
    runs |= {(s, e + 1) for e, s in enumerate(starts.tolist()) if s >= 0}
    gram_ends = _shortest(total, (min_words + 1) // 2)
    grams = [
        xxhash.xxh3_64_intdigest(digests[DIGEST * i : DIGEST * e]) - (1 << 63) for i, e in enumerate(gram_ends.tolist()) if e <= n
    ]
    for first, end in runs:
        last = int(np.searchsorted(gram_ends, end, side="right"))
        yield min(grams[first:last]), first, end


def _sketches(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, mark, digests, sizes, places): a row per document; rows equal in key and text are one."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.select("key", F.xxhash64("text").alias("mark"), F.col("text").cast("binary").alias("text"))
    schema = f"key {type_of(rows, 'key')}, mark bigint, digests binary, sizes array<int>, places array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [line_sketch(t) for (t,) in rows_of([batch], "text")]
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(batch.schema.get_field_index("key")), batch.column(batch.schema.get_field_index("mark")),
                    pa.array([d for d, _, _ in made], pa.binary()), pa.array([s for _, s, _ in made], ints),
                    pa.array([p for _, _, p in made], ints),
                ],
                ["key", "mark", "digests", "sizes", "places"],
            )

    return rows.mapInArrow(run, schema)


def _fingerprints(sketches: DataFrame, min_words: int) -> DataFrame:
    """(print, key, mark): each fingerprint of a document, with how many of its passages chose it."""
    schema = f"print bigint, key {type_of(sketches, 'key')}, mark bigint, n int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, rows, counts = [], [], []
            for row, (digests, sizes) in enumerate(rows_of([batch], "digests", "sizes")):
                chosen: dict[int, int] = {}
                for mark, _, _ in passages(digests, np.array(sizes, np.int32), min_words):
                    chosen[mark] = chosen.get(mark, 0) + 1
                prints += chosen.keys()
                counts += chosen.values()
                rows += [row] * len(chosen)
            of = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(prints, pa.int64()), batch.column(0).take(of), batch.column(1).take(of), pa.array(counts, pa.int32())],
                ["print", "key", "mark", "n"],
            )

    return sketches.select("key", "mark", "digests", "sizes").mapInArrow(run, schema)


def _extended(met: DataFrame, min_words: int) -> DataFrame:
    """(a, b, key, mark, first, end): the passages around the met fingerprints; a, b is their content's hash."""
    schema = f"a bigint, b bigint, key {type_of(met, 'key')}, mark bigint, first int, end int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, rows, firsts, ends = [], [], [], []
            for row, (digests, sizes, prints) in enumerate(rows_of([batch], "digests", "sizes", "prints")):
                wanted = set(prints)
                for mark, first, end in passages(digests, np.array(sizes, np.int32), min_words):
                    if mark in wanted:
                        names.append(xxhash.xxh3_128_digest(digests[DIGEST * first : DIGEST * end]))
                        rows.append(row)
                        firsts.append(first)
                        ends.append(end)
            of, halves = pa.array(rows, pa.int64()), np.frombuffer(b"".join(names), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(halves[:, 0]), pa.array(halves[:, 1]), batch.column(0).take(of), batch.column(1).take(of),
                    pa.array(firsts, pa.int32()), pa.array(ends, pa.int32()),
                ],
                ["a", "b", "key", "mark", "first", "end"],
            )

    return met.select("key", "mark", "digests", "sizes", "prints").mapInArrow(run, schema)


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 50) -> DataFrame:
    """(key, mark, spans): the lines of a document to delete, as ranges of places (first, last).

    mark is xxhash64 of the text. Earlier means: smaller key (null last), then smaller mark, then nearer
    to the start of the text. Rows that agree in key and text are one document. Documents that lose
    nothing have no row.
    """
    ship_package(docs.sparkSession)
    sketches = cut_lineage(_sketches(docs, key, text).dropDuplicates(["key", "mark"]))
    prints = cut_lineage(_fingerprints(sketches, min_words))
    again = prints.groupBy("print").agg(F.sum("n").alias("times")).where("times > 1")
    met = prints.join(again, "print").groupBy("key", "mark").agg(F.collect_list("print").alias("prints"))
    same = sketches["key"].eqNullSafe(met["key"]) & (sketches["mark"] == met["mark"])
    met = sketches.join(met, same).select(sketches["*"], "prints")
    found = cut_lineage(_extended(met, min_words))
    place = F.struct(F.col("key").isNull().alias("unnamed"), "key", "mark", "first")
    earliest = found.groupBy("a", "b").agg(F.min(place).alias("origin"), F.count("*").alias("times")).where("times > 1")
    later = found.join(earliest, ["a", "b"]).where(place > F.col("origin"))
    spans = later.groupBy("key", "mark").agg(F.collect_list(F.struct("first", "end")).alias("runs"))
    same = sketches["key"].eqNullSafe(spans["key"]) & (sketches["mark"] == spans["mark"])
    lines = sketches.join(spans, same).select(sketches["key"].alias(key), sketches["mark"], "places", "runs")
    ranges = F.transform(
        F.array_sort("runs"),
        lambda r: F.struct(
            F.element_at("places", r["first"] + 1).alias("first"), F.element_at("places", r["end"]).alias("last")
        ),
    )
    return lines.select(key, "mark", _united(ranges).alias("spans"))


def _united(ranges):
    """Sorted ranges, with those that touch made one."""
    kind = "array<struct<first:int,last:int>>"

    def add(done, r):
        last = F.try_element_at(done, F.lit(-1))
        joined = F.concat(
            F.slice(done, 1, F.size(done) - 1),
            F.array(F.struct(last["first"].alias("first"), F.greatest(last["last"], r["last"]).alias("last"))),
        )
        return F.when((F.size(done) > 0) & (last["last"] + 1 >= r["first"]), joined).otherwise(
            F.concat(done, F.array(r))
        )

    return F.aggregate(ranges, F.array().cast(kind), add)


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 50) -> DataFrame:
    """docs with the later repeats deleted from the text, and a last column of spans, null where nothing was.

    A null text stays null; a text may become empty. Other columns stay as they are.
    """
    of, mark, spans_ = fresh(docs, "_key", "_text", "_spans")
    spans = repeated_lines(docs, key, text, min_words)
    spans = spans.select(F.col(key).alias(of), F.col("mark").alias(mark), F.col("spans").alias(spans_))
    own = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    joined = docs.join(spans, F.col(key).eqNullSafe(F.col(of)) & (own == F.col(mark)), "left")
    kept = F.filter(
        F.split(text, "\n"),
        lambda line, place: ~F.exists(spans_, lambda s: (place >= s["first"]) & (place <= s["last"])),
    )
    new = F.when(F.col(spans_).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    return joined.select(*[new.alias(text) if c == text else F.col(c) for c in docs.columns], F.col(spans_).alias(spans_))
