"""Near-duplicates by SimHash; candidates by the pigeonring principle.

The 64 bits of a fingerprint lie on a ring of five segments. If two fingerprints differ in at most two
bits, some segment starts a chain whose first l segments differ in at most 2 * l / 5 bits, for every l:
the first two segments are equal, the first three and the first four differ in one bit at most. Equal
first two segments are the key under which fingerprints meet; the longer chains prune before all 64
bits are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsight.llm import graph
from netsight.llm.common import as_bytes, rows_of, type_of
from netsight.session import cut_lineage, ship_package

WIDTHS = (13, 13, 13, 13, 12)
STARTS = (0, 13, 26, 39, 52)
RING = len(WIDTHS)
SPAN = 16
#: A key with more fingerprints than this is dealt out again by longer chains.
SPLIT = 256
CHUNK = 1 << 16


def _mask(start: int, segments: int) -> int:
    """The bits of so many segments on the ring from one on."""
    taken = [(start + k) % RING for k in range(segments)]
    return sum(((1 << WIDTHS[s]) - 1) << STARTS[s] for s in taken)


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The SimHash of a text, signed: a bit is set if it is set in over half of the shingles' hashes."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False)))
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), np.uint64, len(shingles))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, key: str, text: str, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(key, fingerprint) of every row; a text without words, or null, has fingerprint 0."""
    ship_package(docs.sparkSession)
    rows = as_bytes(docs, key, text)
    schema = f"key {type_of(rows, 'key')}, fingerprint bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            found = pa.array((fingerprint(t.as_py(), shingle, seed) for t in texts), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("key")), found], ["key", "fingerprint"])

    return rows.mapInArrow(run, schema)


def _segment(bits: Column, s: int) -> Column:
    return F.shiftrightunsigned(bits, STARTS[s]).bitwiseAND(F.lit((1 << WIDTHS[s]) - 1))


def _short_chains(prints: DataFrame) -> DataFrame:
    """(start, part, bits): one row per start, part = the two segments from there."""
    bits = F.col("bits")
    chains = [
        F.struct(
            F.lit(s).alias("start"),
            F.shiftleft(_segment(bits, s), SPAN).bitwiseOR(_segment(bits, (s + 1) % RING)).alias("part"),
        )
        for s in range(RING)
    ]
    return prints.select(F.explode(F.array(*chains)).alias("c"), "bits").select("c.start", "c.part", "bits")


def _long_chains(crowded: DataFrame) -> DataFrame:
    """Rows of crowded keys, dealt out by four segments of which one bit of the last two is masked.

    Only the bits of the fifth segment and the masked one are free, so that no key can hold more than
    2^14 fingerprints, however many there are. `start` also carries which bit is masked.
    """
    by_start = []
    for s in range(RING):
        chain, loose = _mask(s, 4), _mask((s + 2) % RING, 2)
        for bit in (b for b in range(64) if loose >> b & 1):
            part = F.col("bits").bitwiseAND(F.lit(_signed(chain & ~(1 << bit))))
            by_start.append((s, F.struct(F.lit(s + 8 * (bit + 1)).alias("start"), part.alias("part"))))
    options = [F.when(F.col("start") == s, F.array(*[c for k, c in by_start if k == s])) for s in range(RING)]
    return crowded.select(F.explode(F.coalesce(*options)).alias("c"), "bits").select("c.start", "c.part", "bits")


class _Forest:
    """Union-find over positions, fed with arrays of links."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            above = self.up[self.up]
            if np.array_equal(above, self.up):
                return self.up
            self.up = above

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        roots = self.roots()
        open_ = roots[a] != roots[b]
        for x, y in zip(roots[a[open_]].tolist(), roots[b[open_]].tolist(), strict=True):
            while self.up[x] != x:
                x = self.up[x]
            while self.up[y] != y:
                y = self.up[y]
            self.up[max(x, y)] = min(x, y)


def linked(start: np.ndarray, part: np.ndarray, bits: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows that are sorted by (start, part), reduced to one per row: (row, its root)."""
    chain = start & 7
    masks = {l: np.array([_mask(s, l) for s in range(RING)], np.uint64) for l in (3, 4)}
    runs = np.concatenate([[0], np.cumsum((start[1:] != start[:-1]) | (part[1:] != part[:-1]))])
    forest, at = _Forest(len(bits)), np.arange(len(bits))
    for step in range(1, len(bits)):
        at = at[at + step < len(bits)]
        at = at[runs[at] == runs[at + step]]
        if not len(at):
            break
        differ, of = bits[at] ^ bits[at + step], chain[at]
        good = np.bitwise_count(differ & masks[3][of]) <= 1
        good &= np.bitwise_count(differ & masks[4][of]) <= 1
        near = at[good]
        near = near[np.bitwise_count(differ[good]) <= distance]
        if len(near):
            forest.join(near, near + step)
    roots = forest.roots()
    rows = np.flatnonzero(roots != np.arange(len(bits)))
    return rows, roots[rows]


def _links(chains: DataFrame, distance: int) -> DataFrame:
    """(a, b) from rows that meet under a key, one link per fingerprint and key at most."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            rows = frame if held is None else pd.concat([held, frame], ignore_index=True)
            if not len(rows):
                continue
            last = (rows["start"] == rows["start"].iat[-1]) & (rows["part"] == rows["part"].iat[-1])
            held = rows[last]
            yield _found(rows[~last], distance)
        if held is not None:
            yield _found(held, distance)

    dealt = chains.repartition("start", "part").sortWithinPartitions("start", "part")
    return dealt.mapInPandas(run, "a bigint, b bigint")


def _found(rows: pd.DataFrame, distance: int) -> pd.DataFrame:
    if len(rows) < 2:
        return pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
    bits = rows["bits"].to_numpy(np.int64)
    row, root = linked(rows["start"].to_numpy(np.int64), rows["part"].to_numpy(np.int64), bits.view(np.uint64), distance)
    return pd.DataFrame({"a": bits[row], "b": bits[root]})


def links(prints: DataFrame, distance: int = 2) -> DataFrame:
    """(a, b): links that connect the same fingerprints as all pairs within the distance (at most 2).

    Dense groups would have as many links as pairs; a task gives one link per fingerprint and key.
    """
    if distance > 2:
        raise ValueError("the ring of five segments finds distances of at most 2")
    chains = _short_chains(prints.select(F.col("fingerprint").alias("bits")).distinct())
    met = chains.groupBy("start", "part").agg(F.count("*").alias("n")).where("n > 1")
    met = cut_lineage(chains.join(met, ["start", "part"]))
    few = _links(met.where(F.col("n") <= SPLIT), distance)
    many = _links(_long_chains(met.where(F.col("n") > SPLIT)), distance)
    return few.unionByName(many)


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, distance: int = 2, seed: int = 42
) -> DataFrame:
    """(key, fingerprint, component_id): the groups of texts whose fingerprints are linked.

    fingerprint: 16 hex digits. component_id: the smallest key reachable over links of at most
    `distance` differing bits. Every row gives a row: repeated rows and ties too; texts that are null or
    have no word share fingerprint 0; a null key counts for no minimum, so that a group of null keys
    alone has a null component. An empty table gives an empty one; other columns of docs are not read.
    """
    prints = cut_lineage(fingerprints(docs, key, text, shingle, seed))
    classes = cut_lineage(prints.groupBy("fingerprint").agg(F.min("key").alias("least")))
    roots = graph.components(links(classes, distance))
    nodes = classes.join(roots, classes["fingerprint"] == roots["node"], "left").select(
        "fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")
    )
    nodes = cut_lineage(nodes)
    groups = cut_lineage(nodes.groupBy("root").agg(F.min("least").alias("component_id")))
    named = nodes.join(groups, "root").select("fingerprint", "component_id")
    return prints.join(named, "fingerprint").select(
        F.col("key").alias(key), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )
