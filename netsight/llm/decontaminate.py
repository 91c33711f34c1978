"""Benchmark decontamination over a distributed positional inverted index.

The index is cut into segments of documents; a row holds one segment: its terms, how often each occurs,
and every position of each. A test phrase is looked up from its rarest terms on: the position lists, each
shifted by the term's place in the phrase, are intersected until nothing is left or the phrase is found.
Proximity goes the same way with lists that may miss each other by a few words, and some terms missing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsight.llm.common import as_bytes, rows_of, type_of
from netsight.session import scratch_path, ship_package

#: Letters, digits and everything beyond ASCII, after lower-casing A-Z; bytes of UTF-8.
TERM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Words of a segment: positions then fit two bytes. A longer document is a segment of its own.
SEGMENT = 1 << 16
#: Words of test phrases that are looked up at a time.
BLOCK = 1 << 20
#: Starts of windows that are tried at a time in a segment.
TRIED = 1 << 18


@dataclass(frozen=True)
class Near:
    """A window is near a place of a document if there all its words but `missing` are found, each at most
    `slack` words from where it would be in an exact copy (one word of the document may be found for several)."""

    slack: int = 2
    missing: int = 2


def terms_of(text: bytes) -> list[bytes]:
    return TERM.findall(text.lower())


def _segment(number: int, keys: list, lengths: list[int], words: list[bytes], key_type: pa.DataType) -> pa.RecordBatch:
    """Terms in order of first occurrence; positions as steps within each term's ascending list."""
    ids: dict[bytes, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int32, len(words))
    counts = np.bincount(at, minlength=len(ids)).astype(np.int32)
    places = np.argsort(at, kind="stable").astype(np.int32)
    steps = np.diff(places, prepend=0)
    first = np.cumsum(counts) - counts
    steps[first] = places[first]
    wide = len(words) > SEGMENT
    return pa.RecordBatch.from_arrays(
        [
            pa.array([number], pa.int64()), pa.array([keys], pa.list_(key_type)), pa.array([lengths], pa.list_(pa.int32())),
            pa.array([b" ".join(ids)], pa.binary()), pa.array([counts.tobytes()], pa.binary()),
            pa.array([steps.astype(np.int32 if wide else np.uint16).tobytes()], pa.binary()), pa.array([wide], pa.bool_()),
        ],
        ["segment", "keys", "lengths", "terms", "counts", "steps", "wide"],
    )


def build_index(docs: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """Write the positional index of all rows as Parquet; a row per segment."""
    ship_package(docs.sparkSession)
    rows = as_bytes(docs, key, text)
    schema = (
        f"segment bigint, keys array<{type_of(rows, 'key')}>, lengths array<int>, "
        "terms binary, counts binary, steps binary, wide boolean"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        keys, lengths, words, kind = [], [], [], pa.null()
        for batch in batches:
            kind = batch.schema.field("key").type
            for key_, text_ in rows_of([batch], "key", "text"):
                found = terms_of(text_)
                if keys and len(words) + len(found) > SEGMENT:
                    yield _segment(number, keys, lengths, words, kind)
                    number, keys, lengths, words = number + 1, [], [], []
                keys.append(key_)
                lengths.append(len(found))
                words += found
        if keys:
            yield _segment(number, keys, lengths, words, kind)

    made = rows.mapInArrow(run, schema)
    made.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(made.schema).parquet(path)


class Segment:
    """Looks up terms in one row of the index."""

    def __init__(self, terms: bytes, counts: bytes, steps: bytes, lengths: list[int], wide: bool):
        self.names = terms.split(b" ") if counts else []
        self.ids = {t: i for i, t in enumerate(self.names)}
        self.counts = np.frombuffer(counts, np.int32)
        self.last = np.cumsum(self.counts, dtype=np.int64)
        self.steps = np.frombuffer(steps, np.int32 if wide else np.uint16)
        self.ends = np.cumsum(lengths, dtype=np.int64)
        self.starts = self.ends - np.asarray(lengths, np.int64)

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, positions, side="right")

    @cached_property
    def placed(self) -> np.ndarray:
        """The positions of all terms, term by term."""
        total = np.cumsum(self.steps, dtype=np.int64)
        first = self.last - self.counts
        return total - np.repeat(total[first] - self.steps[first], self.counts)

    def words(self, margin: int) -> np.ndarray:
        """The term at every position, between margins of no term."""
        out = np.full(len(self.steps) + 2 * margin, -2, np.int32)
        out[self.placed + margin] = np.repeat(np.arange(len(self.counts), dtype=np.int32), self.counts)
        return out

    def near(self, grid: np.ndarray, near: Near) -> tuple[np.ndarray, np.ndarray]:
        """(window, positions of its words or -1) wherever a window is near. grid: a row of terms (-1: not here) per window."""
        width, reach = grid.shape[1], 2 * near.slack
        none = np.zeros(0, np.int64), np.zeros((0, width), np.int64)
        some = np.flatnonzero((grid >= 0).sum(axis=1) >= width - near.missing)
        if not len(some):
            return none
        own = grid[some]
        order = np.argsort(np.where(own >= 0, self.counts[own], 0), axis=1, kind="stable")
        # One of the rarest terms must be found: their positions give the starts to try.
        row, place = np.repeat(np.arange(len(some)), near.missing + 1), order[:, : near.missing + 1].ravel()
        term = own[row, place]
        row, place, term = row[term >= 0], place[term >= 0], term[term >= 0]
        upto = np.cumsum(self.counts[term], dtype=np.int64)
        margin = 2 * width + 2 * reach
        words, found = self.words(margin), []
        for first in range(0, int(upto[-1]), TRIED):
            number = np.arange(first, min(first + TRIED, int(upto[-1])))
            pair = np.searchsorted(upto, number, side="right")
            position = self.placed[self.last[term[pair]] - (upto[pair] - number)]
            doc = self.doc_of(position)
            window, start = row[pair], position - place[pair]
            missed = np.zeros(len(window), np.int64)
            # The start may be off by the slack itself, hence twice the slack. From the rarest term on.
            for k in range(width):
                at = order[window, k]
                wanted, here = own[window, at], start + at
                hit = np.zeros(len(window), bool)
                for off in range(-reach, reach + 1):
                    hit |= words[here + (off + margin)] == wanted
                missed += ~hit
                left = missed <= near.missing
                window, start, doc, missed = window[left], start[left], doc[left], missed[left]
            if len(window):
                shift = np.arange(-near.slack, near.slack + 1)
                tried = [np.repeat(window, len(shift)), np.repeat(doc, len(shift)), (start[:, None] + shift).ravel()]
                found.append(np.stack(tried))
        if not found:
            return none
        window, doc, start = np.unique(np.concatenate(found, axis=1), axis=1)
        nearest = np.full((len(window), width), -1, np.int64)
        for at in range(width):
            for off in sorted(range(-near.slack, near.slack + 1), key=lambda e: (abs(e), e)):
                here = start + at + off
                hit = (words[here + margin] == own[window, at]) & (here >= self.starts[doc]) & (here < self.ends[doc])
                nearest[:, at] = np.where((nearest[:, at] < 0) & hit, here, nearest[:, at])
        good = (nearest >= 0).sum(axis=1) >= width - near.missing
        return some[window[good]], nearest[good]

    def positions(self, term: int) -> np.ndarray:
        end = self.last[term]
        return np.cumsum(self.steps[end - self.counts[term] : end], dtype=np.int64)

    def phrase(self, terms: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Where the phrase starts, inside one document. order: places in the phrase, rarest term first."""
        found = None
        for place in order:
            starts = self.positions(terms[place]) - place
            if found is None:
                found = starts
            else:
                at = np.searchsorted(starts, found)
                found = found[(at < len(starts)) & (starts[np.minimum(at, len(starts) - 1)] == found)]
            if not len(found):
                return found
        found = found[found >= 0]
        doc = self.doc_of(found)
        return found[found + len(terms) <= self.ends[doc]]


def _phrases(items: list[tuple[str, list[bytes]]], window: int) -> dict[tuple[bytes, ...], list[str]]:
    """The distinct windows of some items, and the items that have them."""
    found: dict[tuple[bytes, ...], list[str]] = {}
    for item, words in items:
        for at in range(max(1, len(words) - window + 1)) if words else ():
            held = found.setdefault(tuple(words[at : at + window]), [])
            if not held or held[-1] != item:
                held.append(item)
    return found


def _blocks(items: Iterator[tuple[str, bytes]], window: int) -> Iterator[dict[tuple[bytes, ...], list[str]]]:
    held, size = [], 0
    for item, text in items:
        words = terms_of(text)
        held.append((item, words))
        size += len(words)
        if size >= BLOCK:
            yield _phrases(held, window)
            held, size = [], 0
    if held:
        yield _phrases(held, window)


def term_counts(index: DataFrame, vocabulary: list[bytes]) -> dict[bytes, int]:
    """How often each of some terms occurs in the whole index."""
    numbers = {t: i for i, t in enumerate(vocabulary)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(numbers), np.int64)
        for terms, counts in rows_of(batches, "terms", "counts"):
            for term, n in zip(terms.split(b" "), np.frombuffer(counts, np.int32).tolist(), strict=False):
                if term in numbers:
                    total[numbers[term]] += n
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["term", "n"])

    found = index.select("terms", "counts").mapInArrow(run, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    return {vocabulary[r["term"]]: r["n"] for r in found.collect()}


#: The documents that hold phrases: the words that do and the items of the phrases, exact and near.
HITS = (
    "segment bigint, place int, spans array<struct<first:int,last:int>>, items array<string>, "
    "near_spans array<struct<first:int,last:int>>, near_items array<string>"
)


def _look_up(index: DataFrame, phrases: dict[tuple[bytes, ...], list[str]], window: int, near: Near | None) -> DataFrame:
    """The documents in which phrases of one block occur (HITS). Only whole windows are looked for nearby."""
    vocabulary = sorted({t for p in phrases for t in p})
    counts = term_counts(index, vocabulary)
    number = {t: i for i, t in enumerate(vocabulary)}
    longest = max(map(len, phrases))
    grid = np.full((len(phrases), longest), len(vocabulary), np.int32)
    for k, p in enumerate(phrases):
        grid[k, : len(p)] = [number[t] for t in p]
    sizes = np.array([len(p) for p in phrases])
    rarity = np.array([counts.get(t, 0) for t in vocabulary] + [np.iinfo(np.int64).max], np.int64)
    order = np.argsort(rarity[grid], axis=1, kind="stable").astype(np.int32)
    of = list(phrases.values())
    whole = np.flatnonzero(sizes == window)
    singly = np.flatnonzero(sizes != window) if near else np.arange(len(sizes))
    span = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))

    def as_spans(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
        return [{"first": a, "last": b} for a, b in _merged(spans)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for segment, lengths, terms, counts, steps, wide in rows_of(batches, "segment", "lengths", "terms", "counts", "steps", "wide"):
            held = Segment(terms, counts, steps, lengths, wide)
            here = np.array([held.ids.get(t, -1) for t in vocabulary] + [0], np.int64)
            spans: dict[int, list[tuple[int, int]]] = {}
            items: dict[int, set[str]] = {}
            exact: list[tuple[int, int]] = []
            if near and len(whole):
                # A window that is found word by word at its place is an exact one.
                windows, found = held.near(here[grid[whole]], near)
                in_place = (found == found[:, :1] + np.arange(window)).all(axis=1) & (found[:, 0] >= 0)
                exact = list(zip(whole[windows[in_place]].tolist(), found[in_place, 0].tolist(), strict=True))
            for k in singly[(here[grid[singly]] >= 0).all(axis=1)].tolist():
                exact += [(k, start) for start in held.phrase(here[grid[k, : sizes[k]]], order[k, : sizes[k]]).tolist()]
            for (k, start), doc in zip(exact, held.doc_of(np.array([s for _, s in exact], np.int64)).tolist(), strict=True):
                spans.setdefault(doc, []).append((start, start + int(sizes[k])))
                items.setdefault(doc, set()).update(of[k])
            near_spans, near_items = {d: list(s) for d, s in spans.items()}, {d: set(i) for d, i in items.items()}
            if near and len(whole):
                of_doc = held.doc_of(found.max(axis=1, initial=-1))
                for doc, k in np.unique(np.stack([of_doc, whole[windows]]), axis=1).T.tolist():
                    near_items.setdefault(doc, set()).update(of[k])
                words = np.unique(found[found >= 0])
                for doc, word in zip(held.doc_of(words).tolist(), words.tolist(), strict=True):
                    near_spans.setdefault(doc, []).append((word, word + 1))
            docs = sorted(near_spans)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([segment] * len(docs), pa.int64()), pa.array(docs, pa.int32()),
                    pa.array([as_spans(spans.get(d, [])) for d in docs], span),
                    pa.array([sorted(items.get(d, ())) for d in docs], pa.list_(pa.string())),
                    pa.array([as_spans(near_spans[d]) for d in docs], span),
                    pa.array([sorted(near_items[d]) for d in docs], pa.list_(pa.string())),
                ],
                ["segment", "place", "spans", "items", "near_spans", "near_items"],
            )

    return index.select("segment", "lengths", "terms", "counts", "steps", "wide").mapInArrow(run, HITS)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def _covered(spans: str) -> Column:
    """How many places some sorted spans cover together."""
    counted = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(F.lit(0), s["last"] - F.greatest(s["first"], acc["to"]))).alias("n"),
            F.greatest(acc["to"], s["last"]).alias("to"),
        ),
    )
    return counted["n"]


def contamination(
    docs: DataFrame,
    tests: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    index: DataFrame | None = None,
    near: Near | None = None,
) -> DataFrame:
    """(key, n_words, n_hit, items) of every row of docs; with `near` also (n_near, near_items).

    n_hit counts the words inside any occurrence of a window of `window` consecutive item words (a
    shorter item is one window); items are the ids, sorted as strings, of the items with such windows.
    Null and empty texts have no words and no hits; repeated rows each give a row; items without a word
    and null items never hit (an item with a null id counts as ''). n_near counts the words that are found
    where a window is near (see Near; of equally near words the earlier one is taken), and near_items has the
    items with such windows; words and items of exact windows are among them. The test items come in blocks of
    about a million words, so that neither the driver nor a task holds them all; the index is read once
    for each block.
    """
    spark = docs.sparkSession
    if index is None:
        index = build_index(docs, key, text, scratch_path(spark, "index"))
    spans_at = scratch_path(spark, "hits")
    spark.createDataFrame([], HITS).write.parquet(spans_at)
    asked = tests.select(
        F.coalesce(F.col(item).cast("string"), F.lit("")), F.coalesce(F.col(item_text), F.lit("")).cast("binary")
    )
    for phrases in _blocks(((r[0], bytes(r[1])) for r in asked.toLocalIterator()), window):
        if phrases:
            _look_up(index, phrases, window, near).write.mode("append").parquet(spans_at)
    hits = spark.read.schema(HITS).parquet(spans_at)
    counts = [("spans", "items", "n_hit")] + ([("near_spans", "near_items", "n_near")] if near else [])
    together = [c for spans, items, _ in counts for c in (
        F.array_sort(F.flatten(F.collect_list(spans))).alias(spans),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(items)))).alias(items),
    )]
    found = hits.groupBy("segment", "place").agg(*together)
    found = found.withColumns({n: _covered(spans) for spans, _, n in counts})
    all_docs = index.select("segment", F.posexplode(F.arrays_zip("keys", "lengths")).alias("place", "d"))
    all_docs = all_docs.select("segment", "place", F.col("d.keys").alias(key), F.col("d.lengths").alias("n_words"))
    return all_docs.join(found, ["segment", "place"], "left").select(
        key,
        F.col("n_words").cast("bigint").alias("n_words"),
        *[c for _, items, n in counts for c in (
            F.coalesce(n, F.lit(0)).cast("bigint").alias(n),
            F.coalesce(items, F.array().cast("array<string>")).alias(items),
        )],
    )
