"""Near-duplicate vectors by lattice hashing on E8.

A unit vector is projected to eight dimensions and rounded to the nearest point of the lattice E8, its
cell; it also visits the neighbouring cells that lie next to its projection. Vectors meet in a cell if one
of them lives there, in any of several tables of other projections. What meets is verified by the cosine
in double precision. A pair may meet in many cells and counts in the first of them only: by table, then by
cell. Cells with many vectors are cut into blocks, and tasks compare a block with a block.

At the defaults a pair at the threshold of 0.98 is missed with a chance well below one in a thousand, and
closer pairs less often; chance meetings are one in 25,000 of the other vectors of a label and table.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsight.llm import graph
from netsight.llm.common import runs_of, type_of
from netsight.session import cut_lineage, ship_package

#: Vectors of a cell that are compared in one piece; a cell with more is cut into blocks of about as many.
BLOCK = 256
#: Coordinates and projections are rounded to multiples of these, so that sums in double precision are exact
#: whatever the order of addition: a vector has the same cells wherever they are computed.
FINE, COARSE = 1 << 20, 1 << 10


def _d8(points: np.ndarray) -> np.ndarray:
    """Nearest points with integer coordinates of an even sum."""
    near = np.rint(points)
    off = points - near
    odd = np.flatnonzero(near.sum(axis=1) % 2)
    worst = np.abs(off[odd]).argmax(axis=1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
    return near


def nearest(points: np.ndarray) -> np.ndarray:
    """Nearest points of E8: of its two halves, D8 and D8 shifted by a half, the nearer one's."""
    whole, half = _d8(points), _d8(points - 0.5) + 0.5
    far = ((points - whole) ** 2).sum(axis=1) > ((points - half) ** 2).sum(axis=1)
    return np.where(far[:, None], half, whole)


@lru_cache(1)
def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8, from a cell to its neighbours."""
    whole = [
        [a * (k == i) + b * (k == j) for k in range(8)]
        for i, j in itertools.combinations(range(8), 2)
        for a, b in itertools.product((1, -1), repeat=2)
    ]
    half = [s for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array([*whole, *half])


@lru_cache(64)
def _projection(seed: int, size: int, table: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Projection of vectors of that size; odd numbers that hash coordinates, and one for the table."""
    draw = np.random.default_rng([seed, size, table])
    matrix = np.rint(draw.normal(size=(size, 8)) * COARSE)
    odd = draw.integers(0, 1 << 64, 9, np.uint64, endpoint=False) | np.uint64(1)
    return matrix, odd[:8], odd[8]


def _hashed(points: np.ndarray, odd: np.ndarray, table: int) -> np.ndarray:
    mixed = (np.rint(points * 2).astype(np.int64).view(np.uint64) * odd).sum(axis=-1, dtype=np.uint64) + table
    mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed ^ (mixed >> np.uint64(31))).view(np.int64)


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1)[:, None]
    return scaled / np.sqrt((scaled * scaled).sum(axis=1))[:, None]


def cells(units: np.ndarray, tables: int, probes: int, scale: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each vector's own cells (rows x tables) and of those it visits (rows x tables x probes)."""
    fine = np.rint(units * FINE)
    homes, visits = [], []
    for table in range(tables):
        matrix, odd, of = _projection(seed, units.shape[1], table)
        points = (fine @ matrix) * (scale / (FINE * COARSE))
        home = nearest(points)
        towards = (points - home) @ _roots().T
        chosen = np.argpartition(-towards, probes, axis=1)[:, :probes]
        homes.append(_hashed(home, odd, of))
        visits.append(_hashed(home[:, None, :] + _roots()[chosen], odd, of))
    return np.stack(homes, axis=1), np.stack(visits, axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one size as rows in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _entries(classes: DataFrame, tables: int, probes: int, scale: float, seed: int) -> DataFrame:
    """(label, size, tab, cell, home, c1, c2): where each class lives and which cells it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                homes, visits = cells(unit(_matrix(part.column("vector"))), tables, probes, scale, seed)
                at = np.repeat(np.arange(part.num_rows), 1 + probes)
                for table in range(tables):
                    cell = np.concatenate([homes[:, table, None], visits[:, table]], axis=1).ravel()
                    home = np.tile(np.arange(1 + probes) == 0, part.num_rows)
                    rows = part.select(["label", "size", "c1", "c2"]).take(pa.array(at))
                    yield pa.RecordBatch.from_arrays(
                        [*rows.columns[:2], pa.array(np.full(len(at), table, np.int32)), pa.array(cell), pa.array(home), *rows.columns[2:]],
                        ["label", "size", "tab", "cell", "home", "c1", "c2"],
                    )

    schema = f"label {type_of(classes, 'label')}, size int, tab int, cell bigint, home boolean, c1 bigint, c2 bigint"
    return classes.select("label", "size", "c1", "c2", "vector").mapInArrow(run, schema)


def _trees(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n places the smallest one that links (a, b) lead to."""
    up = np.arange(n)
    while True:
        least, before = np.minimum(up[a], up[b]), up.copy()
        np.minimum.at(up, a, least)
        np.minimum.at(up, b, least)
        up = up[up]
        if np.array_equal(up, before):
            return up


def linked(
    units: np.ndarray, home: np.ndarray, block: np.ndarray, pair: tuple[int, int], table: int, cell: int,
    cosine: float, tables: int, probes: int, scale: float, seed: int,
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of two blocks of a cell (or of one block) that are linked and have not met in an earlier cell."""
    left, right = np.flatnonzero(block == pair[0]), np.flatnonzero(block == pair[1])
    near = units[left] @ units[right].T >= cosine
    near &= home[left][:, None] | home[right][None, :]
    a, b = np.nonzero(near)
    a, b = left[a], right[b]
    if pair[0] == pair[1]:
        a, b = a[a < b], b[a < b]
    if not len(a):
        return a, b
    used, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = places[: len(a)], places[len(a) :]
    homes, visits = cells(units[used], tables, probes, scale, seed)
    own, other = homes[x, table], homes[y, table]
    # The pair also meets where the visitor lives, if the one that lives here visits that cell.
    elsewhere = np.where(own == cell, other, own)
    guest = np.where(own == cell, x, y)
    here = (elsewhere == cell) | (cell < elsewhere) | ~(visits[guest, table] == elsewhere[:, None]).any(axis=1)
    for earlier in range(table):
        here &= homes[x, earlier] != homes[y, earlier]
        left_over = np.flatnonzero(here)
        p, q = x[left_over], y[left_over]
        met = (visits[p, earlier] == homes[q, earlier, None]).any(axis=1)
        met |= (visits[q, earlier] == homes[p, earlier, None]).any(axis=1)
        here[left_over] = ~met
    return a[here], b[here]


def _links(meeting: DataFrame, cosine: float, tables: int, probes: int, scale: float, seed: int) -> DataFrame:
    """(c1, c2, links, r1, r2): for a class and a pair of blocks, how many vectors it is linked with there,
    and one class that all those linked with it there lead to."""
    keys = ["label", "size", "tab", "cell", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs_of(batches, keys):
            if rows.num_rows < 2:
                continue
            first = {k: rows.column(k)[0].as_py() for k in ("tab", "cell", "low", "high")}
            plain = {k: rows.column(k).to_numpy(zero_copy_only=False) for k in ("home", "block", "weight", "c1", "c2")}
            a, b = linked(
                unit(_matrix(rows.column("vector"))), plain["home"], plain["block"], (first["low"], first["high"]),
                first["tab"], first["cell"], cosine, tables, probes, scale, seed,
            )
            if not len(a):
                continue
            count = np.zeros(rows.num_rows, np.int64)
            np.add.at(count, a, plain["weight"][b])
            np.add.at(count, b, plain["weight"][a])
            at = np.flatnonzero(count)
            root = _trees(rows.num_rows, a, b)[at]
            found = [plain["c1"][at], plain["c2"][at], count[at], plain["c1"][root], plain["c2"][root]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["c1", "c2", "links", "r1", "r2"])

    dealt = meeting.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, "c1 bigint, c2 bigint, links bigint, r1 bigint, r2 bigint")


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: neither null, empty nor zero, and all its components finite."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~odd & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_vectors(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    cosine: float = 0.98, tables: int = 4, probes: int = 4, scale: float = 1.0, seed: int = 8,
) -> DataFrame:
    """(key, n_links, component_id, kept) of every row: rows of equal label and size link from `cosine` on.

    n_links counts rows, so repeated rows and equal vectors link too; component_id is the smallest key
    reachable. Rows whose label or vector is null, or whose vector is empty, zero or holds a null or
    non-finite component, link with nothing and are their own component. A null key counts for no minimum
    and is kept where its whole component has none. An empty table gives an empty one; other columns are
    not read. Equal vectors are one class from the start, told by 128 bits of hash.

    `scale`: cells shrink as it grows, which suits more vectors, and wants more tables or probes for
    the same recall. What is compared grows with the square of a cell's distinct vectors, in blocks.
    """
    ship_package(vectors.sparkSession)
    vec = F.col(vector)
    good = usable(vec) & F.col(label).isNotNull()
    ids = [F.when(good, F.xxhash64(F.lit(s), F.col(label), F.size(vec), vec)) for s in (7, 11)]
    rows = vectors.select(
        F.col(key).alias("key"), F.when(good, F.col(label)).alias("label"), F.when(good, vec).alias("vector"),
        ids[0].alias("c1"), ids[1].alias("c2"),
    )
    classes = rows.where("c1 is not null").groupBy("c1", "c2").agg(
        F.first("label").alias("label"), F.size(F.first("vector")).alias("size"), F.first("vector").alias("vector"),
        F.min("key").alias("least"), F.count("*").alias("weight"),
    )
    classes = cut_lineage(classes)
    place = ["label", "size", "tab", "cell"]
    entries = _entries(classes, tables, probes, scale, seed)
    met = entries.groupBy(*place).agg(F.count("*").alias("n"), F.sum(F.col("home").cast("int")).alias("lives"))
    met = met.where("n > 1 and lives > 0").select(*place, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    meeting = entries.join(met, place).join(classes.select("c1", "c2", "weight", "vector"), ["c1", "c2"])
    meeting = meeting.withColumn("block", F.pmod(F.xxhash64("cell", "c1", "c2"), "blocks").cast("int"))
    meeting = meeting.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    meeting = meeting.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    links = cut_lineage(_links(meeting.drop("other", "blocks"), cosine, tables, probes, scale, seed))

    node = lambda a, b: F.struct(F.col(a).alias("c1"), F.col(b).alias("c2"))
    roots = graph.components(links.select(node("c1", "c2").alias("a"), node("r1", "r2").alias("b")))
    counts = links.groupBy("c1", "c2").agg(F.sum("links").alias("links"))
    named = classes.select("c1", "c2", "least", "weight").join(
        roots.select("node.c1", "node.c2", "root"), ["c1", "c2"], "left"
    ).withColumn("root", F.coalesce("root", node("c1", "c2")))
    named = cut_lineage(named.join(counts, ["c1", "c2"], "left"))
    groups = cut_lineage(named.groupBy("root").agg(F.min("least").alias("component")))  # so that a large component is split
    found = cut_lineage(named.join(groups, "root").select(
        "c1", "c2", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component"
    ))
    component = F.when(F.col("c1").isNull(), F.col("key")).otherwise(F.col("component"))
    return rows.select("key", "c1", "c2").join(found, ["c1", "c2"], "left").select(
        F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"), F.col("key").eqNullSafe(component).alias("kept"),
    )
