"""Exact neighbours of vectors: radius joins and k nearest. A tree of pivots makes blocks of points that lie together, and blocks meet as a product in which no vector is shuffled."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.session import checkpointed

#: Points of a block at most, and children of a node. A node gets a child for each half block, so that blocks come of one level up to some 500,000 points.
BLOCK, FAN = 2048, 512
#: Points that are drawn beyond the children's pivots, about, so that there are enough.
SPARE = 64
#: Points that pass by a node's pivots in one task.
PASSING = 1 << 14
#: Nodes of a level, or leaves, that are broadcast; beyond, they are joined by a shuffle.
LISTED = 250_000
#: Points that a task holds of those which ask, at most, about; and tasks for which they hold fewer, down to a block.
HELD, TASKS = 1 << 13, 64
#: Own points compared with a block at once, and pairs of points whose distances are summed at once.
SLICE, PLACED = 512, 1 << 14
_ROOT = "0"


def _vectors(table: pa.Table, column: str) -> np.ndarray:
    values = table.column(column).combine_chunks()
    return np.asarray(values.flatten().to_numpy(zero_copy_only=False), float).reshape(len(values), -1) if len(values) else np.zeros((0, 1))


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All distances, but for rounding."""
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1) - 2 * x @ y.T, 0))


def _squares(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All squared distances, and for each row of x how far rounding may have moved them."""
    own, other = (x**2).sum(1), (y**2).sum(1)
    out = x @ y.T
    out *= -2
    out += other
    out += own[:, None]
    return out, 1e-15 * (x.shape[1] + 8) * (own + other.max(initial=0))


def exactly(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of rows, squares summed from left to right."""
    parts = [np.sqrt(np.add.accumulate((x[at : at + PLACED] - y[at : at + PLACED]) ** 2, axis=1)[:, -1]) for at in range(0, len(x), PLACED)]
    return np.concatenate(parts) if parts else np.zeros(0)


def _within(x: np.ndarray, y: np.ndarray, eps: float) -> np.ndarray:
    """Which rows lie within eps of each other; exact distances decide where rounding might."""
    far, moved = _squares(x, y)
    out = far <= eps * eps + moved[:, None]
    i, j = np.nonzero(out & (far >= (eps * eps - moved - 1e-12 * eps * eps)[:, None]))
    out[i, j] = np.concatenate([exactly(x[i[at : at + PLACED]], y[j[at : at + PLACED]]) <= eps for at in range(0, len(i), PLACED)] or [np.zeros(0, bool)])
    return out


def _place(points: pa.Table, drawn: pa.Table) -> pa.Table:
    """Points of a node by the nearest of its children's pivots; the first point of each child carries the pivot."""
    pivots = np.unique(_vectors(drawn.sort_by([("turn", "ascending")]).slice(0, drawn.column("fan")[0].as_py()), "pivot"), axis=0) if drawn.num_rows else np.zeros((0, 1))
    n = points.num_rows
    child, far = np.full(n, -1), np.zeros(n)
    if len(pivots) > 1:
        x = _vectors(points, "v")
        for at in range(0, n, SLICE):
            gaps = apart(x[at : at + SLICE], pivots)
            child[at : at + SLICE], far[at : at + SLICE] = gaps.argmin(1), gaps.min(1)
    first = np.zeros(n, bool)
    first[np.unique(child, return_index=True)[1]] = True
    nodes = [node if c < 0 else f"{node}.{c}" for node, c in zip(points.column("node").to_pylist(), child.tolist(), strict=True)]
    pivot = [pivots[c].tolist() if f and c >= 0 else None for c, f in zip(child.tolist(), first.tolist(), strict=True)]
    return pa.table([*(points.column(c) for c in ("id", "v", "asks")), pa.array(nodes, pa.string()), pa.array(far), pa.array(pivot, pa.list_(pa.float64())), pa.array(child < 0)], ["id", "v", "asks", "node", "far", "pivot", "stuck"])


def pivot_tree(rows: DataFrame, id_col: str, column: str, asked: Column | None = None, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(blocks (node, part, ids, flat, asks), nodes (node, parent, leaf, pivot, radius, n)) of a tree over the rows' vectors.

    A node of more than block points is split among up to FAN pivots, twice as many as it fills blocks, drawn of its own points by their
    hashes, and so on until leaves are small, whatever the number of points; a node's radius is its farthest point's distance to its pivot.
    A level shuffles the vectors of the nodes that it splits once. Points that no pivots tell apart stay in one leaf, dealt into parts by
    hash. No task gets a node whole, and nothing of it reaches the driver.
    Vectors that are null, or hold null or what isn't finite, are left out.
    """
    finite = F.forall(F.col(column), lambda x: F.coalesce(F.abs(x.cast("double")) < math.inf, F.lit(False)))
    points = rows.where(F.coalesce(finite, F.lit(False))).select(F.col(id_col).alias("id"), F.col(column).cast("array<double>").alias("v"), (F.lit(True) if asked is None else F.coalesce(asked, F.lit(False))).alias("asks"))
    kind = points.schema["id"].dataType.simpleString()
    now = points.select("*", F.lit(_ROOT).alias("node"), F.lit(0.0).alias("far"), F.lit(None).cast("array<double>").alias("pivot"), F.lit(False).alias("stuck"))
    leaves, nodes, ends, level = [], [], [], 0
    while True:
        known = checkpointed(now.groupBy("node").agg(F.count("*").alias("n"), F.max("far").alias("radius"), F.first("pivot", ignorenulls=True).alias("pivot"), F.max("stuck").alias("stuck")))
        leaf = (F.col("n") <= block) | F.col("stuck")
        # a stuck node is listed with the level at which it was made
        made = known.where("NOT stuck") if level else known
        nodes.append(made.select("node", F.when(F.lit(level > 0), F.regexp_replace("node", r"\.[^.]*$", "")).alias("parent"), "pivot", "radius", "n"))
        ends.append(known.where(leaf).select("node", F.lit(True).alias("leaf")))
        listed, split = known.agg(F.count("*"), F.count_if(~leaf)).first()
        sizes = known.select("node", "n", "stuck")
        sized = now.drop("far", "pivot", "stuck").join(F.broadcast(sizes) if listed <= LISTED else sizes, "node")
        leaves.append(sized.where(leaf).select("node", "id", "v", "asks", F.pmod(F.xxhash64("id", F.lit(11)), F.ceil(F.col("n") / block)).alias("part")))
        if not split:
            break
        over = sized.where(~leaf)
        salts, fan = F.ceil(F.col("n") / PASSING), F.least(F.lit(FAN), F.ceil(2 * F.col("n") / block)).cast("int")
        drawn = over.where(F.pmod(F.xxhash64("id", F.lit(level)), "n") < fan + SPARE)
        drawn = drawn.select(F.col("node").alias("of"), F.col("v").alias("pivot"), fan.alias("fan"), F.xxhash64(F.lit(level), "id").alias("turn"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("for"))
        dealt = over.select("id", "v", "asks", "node", F.pmod(F.xxhash64("id", F.lit(12)), salts).alias("salt"))
        now = dealt.groupBy("node", "salt").cogroup(drawn.groupBy("of", "for")).applyInArrow(_place, f"id {kind}, v array<double>, asks boolean, node string, far double, pivot array<double>, stuck boolean")
        now = checkpointed(now)
        level += 1
    all_leaves, all_nodes, all_ends = (functools.reduce(DataFrame.unionAll, x) for x in (leaves, nodes, ends))
    blocks = all_leaves.groupBy("node", "part").agg(F.array_sort(F.collect_list(F.struct("id", "v", "asks"))).alias("p"))
    blocks = blocks.select("node", "part", F.col("p.id").alias("ids"), F.flatten("p.v").alias("flat"), F.col("p.asks").alias("asks"))
    all_nodes = all_nodes.join(all_ends, "node", "left").withColumn("leaf", F.coalesce("leaf", F.lit(False)))
    return blocks, all_nodes if level == 0 else checkpointed(all_nodes)


def _matrix(flat: bytes, n: int) -> np.ndarray:
    return np.frombuffer(flat).reshape(n, -1)


def _dealt(blocks: DataFrame, n: int) -> DataFrame:
    """Blocks written to the shared folder in parts of a few."""
    return checkpointed(blocks.repartition(max(1, math.ceil(n / min(HELD, max(BLOCK, n // TASKS))))))


def blocked(rows: DataFrame, id_col: str, column: str, asked: Column | None = None, block: int = BLOCK, k: int = 0) -> tuple[DataFrame, int]:
    """(blocks (key, ids, flat, asks, reach, far, centre, radius), number of points), written to the shared folder.

    centre and radius are of a ball around a block's points. With k, reach has for each point that asks a distance within which its k nearest
    others lie, and far the greatest of a block: a point's k-th neighbour is no farther than the k-th in its own block, nor than twice the
    radius of a node of more than k points that it lies in.
    """
    # a row holds a block, or two that meet, so a batch must not hold as many rows as it else would
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    blocks, nodes = pivot_tree(rows, id_col, column, asked, block)
    kind = rows.schema[id_col].dataType.simpleString()
    n, leaves = nodes.where("leaf").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    if k:
        # a leaf's ancestors are the beginnings of its name
        above = F.expr("transform(sequence(1, size(split(leaf_node, '[.]'))), i -> array_join(slice(split(leaf_node, '[.]'), 1, i), '.'))")
        lines = nodes.where("leaf").select(F.col("node").alias("leaf_node")).select("leaf_node", F.explode(above).alias("node")).join(nodes.where((F.col("n") > k) & F.col("parent").isNotNull()).select("node", "radius"), "node")
        bounds = lines.groupBy(F.col("leaf_node").alias("node")).agg((2 * F.min("radius")).alias("bound"))
        # a join by shuffle would move the vectors once more
        blocks = blocks.join(F.broadcast(bounds) if leaves <= LISTED else bounds, "node", "left")
    else:
        blocks = blocks.withColumn("bound", F.lit(None).cast("double"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                names, asks = np.asarray(r.ids), np.asarray(r.asks, bool)
                x = np.asarray(r.flat, float).reshape(len(names), -1)
                centre, reach = x.mean(0), np.zeros(len(names))
                if k:
                    reach[:] = math.inf if r.bound is None or math.isnan(r.bound) else r.bound * (1 + 1e-9)
                    for at in range(0, len(x), SLICE):
                        far, moved = _squares(x[at : at + SLICE], x)
                        far[names[at : at + SLICE, None] == names] = math.inf
                        if k <= len(x):
                            far = np.sqrt(np.maximum(np.partition(far, k - 1, axis=1)[:, k - 1], 0) + moved) * (1 + 1e-9)
                            reach[at : at + SLICE] = np.minimum(reach[at : at + SLICE], far)
                    reach[~asks] = math.nan
                radius = float(np.sqrt(((x - centre) ** 2).sum(1).max())) * (1 + 1e-9)
                yield pd.DataFrame({"key": [f"{r.node}/{r.part}"], "ids": [names], "flat": [x.tobytes()], "asks": [asks], "reach": [reach.tobytes()], "far": [float(reach[asks].max()) if asks.any() else None], "centre": [centre], "radius": [radius]})

    packed = blocks.select("node", "part", "ids", "flat", "asks", "bound").mapInPandas(pack, f"key string, ids array<{kind}>, flat binary, asks array<boolean>, reach binary, far double, centre array<double>, radius double")
    return _dealt(packed, n), n


def _met(blocks: DataFrame, reach: Column | float, own: str = "true", other: str = "true") -> DataFrame:
    """Blocks (own_key, own_ids, ...) beside each (key, ids, ...) that may hold points within their reach: balls decide.

    Each task holds some blocks that ask while all others pass by, read from the shared folder: nothing is shuffled, and what is found for a
    block comes from one task, so that a point gets one answer however many points there are.
    """
    asking = blocks.where(own).select(*[F.col(c).alias(f"own_{c}") for c in blocks.columns])
    passing = blocks.coalesce(1).where(other)
    gap = F.sqrt(F.aggregate(F.zip_with("own_centre", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    bound = (F.col("own_radius") + F.col("radius") + reach) * (1 + 1e-9)
    size = F.aggregate("own_centre", F.lit(0.0), lambda s, x: s + x * x) + F.aggregate("centre", F.lit(0.0), lambda s, x: s + x * x)
    return passing.join(asking.hint("shuffle_replicate_nl"), gap <= bound + 1e-9 * F.sqrt(size))


def _narrowed(x: np.ndarray, centre: np.ndarray, radius: float, reach: np.ndarray | float) -> np.ndarray:
    """The rows of x that may have points of a ball within reach."""
    centre = np.asarray(centre, float)
    gap = np.sqrt(((x - centre) ** 2).sum(1))
    return np.flatnonzero(gap <= (radius + reach) * (1 + 1e-9) + 1e-9 * math.sqrt(float(centre @ centre)))


_PAIR = ("own_key", "own_ids", "own_flat", "key", "ids", "flat", "centre", "radius")


def meeting_blocks(rows: DataFrame, id_col: str, column: str, eps: float, block: int = BLOCK) -> DataFrame:
    """(own, ids): points beside the blocks that may hold others within eps of them, which is what gets compared."""
    kind = rows.schema[id_col].dataType.simpleString()

    def narrow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                i = _narrowed(_matrix(r.own_flat, len(r.own_ids)), r.centre, r.radius, eps)
                if len(i):
                    yield pd.DataFrame({"own": [np.asarray(r.own_ids)[i]], "ids": [r.ids]})

    return _met(blocked(rows, id_col, column, block=block)[0], F.lit(float(eps))).select(*_PAIR).mapInPandas(narrow, f"own array<{kind}>, ids array<{kind}>")


def _slices(r, eps: float, keep: np.ndarray | None = None, other: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of the own block, which points of the other lie within eps of them), some rows at once; of those to keep, beside some of the others."""
    x, y = _matrix(r.own_flat, len(r.own_ids)), _matrix(r.flat, len(r.ids))
    rows = _narrowed(x, r.centre, r.radius, eps)
    rows = rows if keep is None else rows[keep[rows]]
    y = y if other is None else y[other]
    for at in range(0, len(rows), SLICE):
        yield (i := rows[at : at + SLICE]), _within(x[i], y, eps)


def neighbours(rows: DataFrame, id_col: str, column: str, eps: float, block: int = BLOCK) -> DataFrame:
    """(a, b, dist) of pairs a < b within eps.

    Points are compared with the blocks whose ball is within eps. What is compared is quadratic where balls overlap, and the pairs are as
    many as there are; `degrees` and `links` need no pairs. Rows with a null vector have no neighbours, and an empty table gives no rows.
    """
    kind = rows.schema[id_col].dataType.simpleString()

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                own, ids = np.asarray(r.own_ids), np.asarray(r.ids)
                x, y = _matrix(r.own_flat, len(own)), _matrix(r.flat, len(ids))
                for rows, within in _slices(r, eps):
                    i, j = np.nonzero(within & (own[rows, None] < ids))
                    for at in range(0, len(i), PLACED):
                        p, q = rows[i[at : at + PLACED]], j[at : at + PLACED]
                        yield pd.DataFrame({"a": own[p], "b": ids[q], "dist": exactly(x[p], y[q])})

    return _met(blocked(rows, id_col, column, block=block)[0], F.lit(float(eps))).select(*_PAIR).mapInPandas(compare, f"a {kind}, b {kind}, dist double")


def degrees(blocks: DataFrame, n: int, eps: float) -> DataFrame:
    """(key, at, id, degree) of each point at its place in a block: the number of points within eps, itself included. Tasks answer with counts, not pairs."""
    kind = blocks.schema["ids"].dataType.elementType.simpleString()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for r in batch.itertuples(index=False):
                _, counts = held.setdefault(r.own_key, (np.asarray(r.own_ids), np.zeros(len(r.own_ids), np.int64)))
                for rows, within in _slices(r, eps):
                    counts[rows] += within.sum(1)
        for key, (ids, counts) in held.items():
            yield pd.DataFrame({"key": key, "at": np.arange(len(ids)), "id": ids, "n": counts})

    found = _met(blocks, F.lit(float(eps))).select(*_PAIR).mapInPandas(count, f"key string, at int, id {kind}, n long")
    return found.groupBy("key", "at", "id").agg(F.sum("n").alias("degree"))


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of every node but roots that the edges connect."""
    ids, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(ids))
    while True:
        new = label.copy()
        least = np.minimum(label[i], label[j])
        for end in (i, j, label[i], label[j]):  # roots hear it, too
            np.minimum.at(new, end, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(ids)))
    return ids[moved], ids[label[moved]]


#: Edges that a task gathers before it reduces them to stars.
GATHERED = 1 << 19


def links(blocks: DataFrame, n: int, eps: float, cores: DataFrame) -> DataFrame:
    """(a, b, border): edges that connect the cores within eps of each other, and each pair of another point a and a core b within eps (border).

    cores: (key, at, is_core) of all points of the blocks. Of edges between cores a task answers with stars of its own components, which are fewer
    than its points, however many the pairs.
    """
    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    flags = cores.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "is_core"))).alias("c")).select("key", F.col("c.is_core").alias("core"))
    flagged = _dealt(blocks.join(flags, "key"), n)

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gathered, size = [], 0
        for batch in batches:
            for r in batch.itertuples(index=False):
                own, own_core, core = np.asarray(r.own_ids), np.asarray(r.own_core, bool), np.asarray(r.core, bool)
                ids = np.asarray(r.ids)[core]
                # pairs of cores are seen from one side
                for rows, within in _slices(r, eps, None if r.own_key <= r.key else ~own_core, core):
                    i, j = np.nonzero(within)
                    inner = own_core[rows[i]]
                    a, b = own[rows[i]], ids[j]
                    if not inner.all():
                        yield pd.DataFrame({"a": a[~inner], "b": b[~inner], "border": True})
                    if inner.any():
                        gathered.append(_stars(a[inner], b[inner]))
                        size += len(gathered[-1][0])
                if size > GATHERED:
                    gathered = [_stars(*(np.concatenate(x) for x in zip(*gathered, strict=True)))]
                    size = 0
        if gathered:
            a, b = _stars(*(np.concatenate(x) for x in zip(*gathered, strict=True)))
            yield pd.DataFrame({"a": a, "b": b, "border": False})

    met = _met(flagged, F.lit(float(eps)), other="exists(core, c -> c)")
    return met.select(*_PAIR, "own_core", "core").mapInPandas(link, f"a {kind}, b {kind}, border boolean")


def nearest(rows: DataFrame, id_col: str, column: str, k: int, queries: Column | None = None, block: int = BLOCK) -> DataFrame:
    """(id, neighbour, dist, rank): the k nearest others of each query row, exact, ties by id.

    A task keeps the k best of the blocks that pass by for each point it holds, whose search reaches no farther than the k-th of them.
    Rows with a null vector have and are no neighbours.
    """
    kind = rows.schema[id_col].dataType.simpleString()

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = {}
        for batch in batches:
            for r in batch.itertuples(index=False):
                own, names = np.asarray(r.own_ids), np.asarray(r.ids)
                x, y = _matrix(r.own_flat, len(own)), _matrix(r.flat, len(names))
                best = held.setdefault(r.own_key, [own, np.frombuffer(r.own_reach).copy(), np.zeros(0, np.int64), np.zeros(0), names[:0]])
                reach = best[1]
                asking = _narrowed(x, r.centre, r.radius, reach)
                for at in range(0, len(asking), SLICE):
                    i, j, d = _reached(x, y, asking[at : at + SLICE], reach)
                    other = own[i] != names[j]
                    if other.any():
                        _keep(best, i[other], d[other], names[j[other]], k)
        for own, _, i, d, names in held.values():
            yield pd.DataFrame({"id": own[i], "neighbour": names, "dist": d})

    met = _met(blocked(rows, id_col, column, queries, block, k)[0], F.col("own_far"), own="far IS NOT NULL")
    found = met.select(*_PAIR, "own_reach").mapInPandas(compare, f"id {kind}, neighbour {kind}, dist double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("dist", "neighbour")))
    return ranked.where(F.col("rank") <= k)


def _reached(x: np.ndarray, y: np.ndarray, rows: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, distance) of pairs within the reach of rows."""
    far, moved = _squares(x[rows], y)
    bound = reach[rows] ** 2
    i, j = np.nonzero(far <= (bound * (1 + 1e-9) + moved)[:, None])
    i = rows[i]
    d = np.concatenate([exactly(x[i[at : at + PLACED]], y[j[at : at + PLACED]]) for at in range(0, len(i), PLACED)] or [np.zeros(0)])
    ok = d <= reach[i]
    return i[ok], j[ok], d[ok]


def _keep(best: list, i: np.ndarray, d: np.ndarray, names: np.ndarray, k: int) -> None:
    """Merges found (row, distance, name) into the k best of each row, ties by name, and shortens the reach of rows that have k."""
    _, reach, *known = best
    i, d, names = (np.concatenate(pair) for pair in zip(known, (i, d, names), strict=True))
    order = np.lexsort((names, d, i))
    i, d, names = i[order], d[order], names[order]
    turn = np.arange(len(i)) - np.searchsorted(i, i)
    last = turn == k - 1
    reach[i[last]] = np.minimum(reach[i[last]], d[last])
    best[2:] = [i[turn < k], d[turn < k], names[turn < k]]
