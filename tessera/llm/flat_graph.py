"""Near-duplicate embeddings by a robust-pruned flat graph, built on overlapping cluster shards."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.components import connected_components
from tessera.llm.storage import discard, materialize

#: Least cosine of a link.
THRESHOLD = 0.98
#: Vectors of a shard, about; a larger one is split.
SHARD = 2048
#: Vectors drawn of a shard to split it (the bounded sample that the index is fitted on), and most centres taken of them.
SAMPLE, CENTRES = 128, 32
#: A vector also goes to a second centre whose cosine is below the best by at most this: shards overlap.
OVERLAP = 0.08
#: A shard that a split leaves with more than this share of its parent is dense.
SHRINK = 0.75
#: Pruned near neighbours of a node, far ones beside them, nearest candidates for pruning, and how much shorter a detour must be.
DEGREE, FAR, CANDIDATES, ALPHA = 20, 4, 64, 1.2
#: Nodes that a greedy search keeps.
BEAM = 16
#: Queries handled at once, and pairs verified at once.
BLOCK, PAIRS = 256, 1 << 16
#: Vectors split in one task.
SPLIT_ROWS = 1 << 14
#: Stands for an id that is missing; sorts last.
NO_ID = (1 << 63) - 1
_FIELDS = "p1 long, p2 long, id long, m long, vec array<double>, cell string, block long, blocks long"


def _unit(table: pa.Table, column: str = "vec") -> np.ndarray:
    """The column's vectors as rows of length 1; they are scaled first, so that no square overflows."""
    values = table.column(column).combine_chunks()
    rows = np.asarray(values.flatten().to_numpy(zero_copy_only=False), float).reshape(len(values), -1) if len(values) else np.zeros((0, 1))
    rows = rows / np.abs(rows).max(axis=1, keepdims=True, initial=1e-300)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def _points(rows: DataFrame) -> DataFrame:
    """(p1, p2, id, m, vec, cell) of each different vector of a label: m rows hold it, id is their smallest. Two 64-bit hashes name it."""
    return rows.groupBy("p1", "p2").agg(F.min(F.coalesce("vec_id", F.lit(NO_ID))).alias("id"), F.count("*").alias("m"), F.any_value("vec").alias("vec"), F.any_value("cell").alias("cell"))


def _spread(centres: np.ndarray, threshold: float, most: int) -> np.ndarray:
    """The first centres that lie more than twice the links' angle from each one before, so that no group of copies is cut up."""
    apart, kept = np.cos(2 * np.arccos(threshold)), []
    for i in range(len(centres)):
        if not kept or (centres[kept] @ centres[i]).max() < apart:
            kept.append(i)
            if len(kept) == most:
                break
    return centres[kept]


def _split(threshold: float, shard: int):
    """Cogroup mapper of (points of a shard, its sample): each point in the shards of its centres, or marked dense where one centre is left."""

    def split(points: pa.Table, sample: pa.Table) -> pa.Table:
        n = points.num_rows
        size = points.column("n")[0].as_py() if n else 0
        centres = _spread(_unit(sample, "drawn"), threshold, min(CENTRES, max(8, -(-4 * size // shard)))) if sample.num_rows else np.zeros((0, 1))
        take, child = np.arange(n), np.full(n, -1)
        if len(centres) > 1:
            near = _unit(points) @ centres.T
            order = np.argsort(-near, axis=1, kind="stable")[:, :2]
            best = np.take_along_axis(near, order, 1)
            second = np.flatnonzero(best[:, 0] - best[:, 1] <= OVERLAP)
            take, child = np.append(take, second), np.append(order[:, 0], order[second, 1])
        out = points.take(pa.array(take))
        cells = [c if k < 0 else f"{c}.{k}" for c, k in zip(out.column("cell").to_pylist(), child.tolist(), strict=True)]
        return pa.table([*(out.column(c) for c in ("p1", "p2", "id", "m", "vec")), pa.array(cells, pa.string()), out.column("n"), pa.array(child < 0)], ["p1", "p2", "id", "m", "vec", "cell", "parent", "dense"])

    return split


def _shards(points: DataFrame, threshold: float, shard: int) -> tuple[DataFrame, list[DataFrame]]:
    """(points in their shards, tables that it reads).

    Shards above shard vectors are split again and again, each around centres drawn of its own vectors. A shard whose vectors lie
    so close that one centre is left, or that a split hardly shrinks, is dense: it is cut into blocks by hash, each of which
    meets all others of the shard in the search.
    """
    ended, tables = [], []
    now = points.select("p1", "p2", "id", "m", "vec", "cell", F.lit(None).cast("long").alias("parent"), F.lit(False).alias("dense"))
    level = 0
    while True:
        now = materialize(now, f"shards-{level}")
        tables.append(now)
        sized = now.join(now.groupBy("cell").agg(F.count("*").alias("n")), "cell")
        dense = F.col("dense") | F.coalesce(F.col("n") > SHRINK * F.col("parent"), F.lit(False))
        blocks = F.when(F.col("n") <= shard, F.lit(1)).otherwise(F.ceil(F.col("n") / shard)).cast("long")
        done = sized.where((F.col("n") <= shard) | dense).withColumn("blocks", blocks)
        ended.append(done.select("p1", "p2", "id", "m", "vec", "cell", F.pmod(F.xxhash64("p1", "p2"), "blocks").alias("block"), "blocks"))
        over = sized.where((F.col("n") > shard) & ~dense).drop("parent", "dense")
        if over.isEmpty():
            return reduce(DataFrame.unionAll, ended), tables
        salts = F.ceil(F.col("n") / SPLIT_ROWS)
        drawn = over.where(F.pmod(F.xxhash64("p1", "p2", F.lit(level)), "n") < SAMPLE)
        drawn = drawn.select(F.col("cell").alias("of"), F.col("vec").alias("drawn"), F.xxhash64("p2", "p1", F.lit(level)).alias("turn"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("part"))
        dealt = over.withColumn("salt", F.pmod(F.xxhash64("p2"), salts)).groupBy("cell", "salt")
        children = dealt.cogroup(drawn.groupBy("of", "part"))
        now = children.applyInArrow(_ordered(_split(threshold, shard)), "p1 long, p2 long, id long, m long, vec array<double>, cell string, parent long, dense boolean")
        level += 1


def _ordered(split):
    """The sample of a shard in the same order for each of its tasks."""

    def run(points: pa.Table, sample: pa.Table) -> pa.Table:
        return split(points, sample.sort_by([("turn", "ascending")]) if sample.num_rows else sample)

    return run


def robust_graph(unit: np.ndarray) -> list[np.ndarray]:
    """Neighbours of each row, by robust pruning of its nearest rows.

    A candidate goes if a neighbour taken before is ALPHA times nearer to it than the row is. A few far rows and the reverse of
    every edge are added, and rows that the medoid doesn't reach are linked to the nearest that it does.
    """
    n = len(unit)
    if n < 2:
        return [np.zeros(0, np.int64)] * n
    u = unit.astype(np.float32)
    most, edges = min(CANDIDATES, n - 1), []
    for lo in range(0, n, BLOCK):
        rows = np.arange(lo, min(lo + BLOCK, n))
        near = u[rows] @ u.T
        near[np.arange(len(rows)), rows] = -np.inf
        found = np.argpartition(-near, most - 1, axis=1)[:, :most]
        gap = 2 - 2 * np.take_along_axis(near, found, 1)
        between = 2 - 2 * (u[found] @ u[found].transpose(0, 2, 1))
        alive, at = np.ones(found.shape, bool), np.arange(len(rows))
        for _ in range(min(DEGREE, most)):
            pick = np.where(alive, gap, np.inf).argmin(1)
            live = alive[at, pick]
            edges.append(np.stack([rows[live], found[at, pick][live]]))
            alive &= ALPHA**2 * between[at, pick] > gap
            alive[at, pick] = False
    far = np.random.default_rng(n).integers(0, n, (n, FAR))
    edges.append(np.stack([np.repeat(np.arange(n), FAR), far.ravel()]))
    both = np.concatenate(edges, 1)
    beside = np.zeros((n, n), bool)
    beside[both[0], both[1]] = beside[both[1], both[0]] = True
    np.fill_diagonal(beside, False)
    reached, front = np.zeros(n, bool), np.zeros(n, bool)
    front[_medoid(u)] = True
    while front.any():
        reached |= front
        front = beside[front].any(0) & ~reached
    lost = np.flatnonzero(~reached)
    if len(lost):
        known = np.flatnonzero(reached)
        nearest = known[(u[lost] @ u[known].T).argmax(1)]
        beside[lost, nearest] = beside[nearest, lost] = True
    return [np.flatnonzero(row) for row in beside]


def _medoid(u: np.ndarray) -> int:
    """The row nearest to the rows' mean."""
    return int((u @ u.sum(0)).argmax())


def range_search(u: np.ndarray, links: np.ndarray, queries: np.ndarray, entries: np.ndarray, least: float) -> np.ndarray:
    """Matrix (query, row) of the rows found with an inner product of least or more.

    u: unit rows; links: neighbours of each row, -1 after the last; entries: where each query begins, -1 for none. A greedy
    search keeps the BEAM best; then the search widens from every row in range to all neighbours, until none is new.
    """
    n, hits = len(u), []
    for lo in range(0, len(queries), BLOCK):
        q = u[queries[lo : lo + BLOCK]]
        k = len(q)
        at = np.arange(k)
        seen, spent, hit = np.zeros((k, n), bool), np.zeros((k, n), bool), np.zeros((k, n), bool)
        beam, score = np.full((k, BEAM), -1), np.full((k, BEAM), -np.inf, np.float32)

        def meet(rows: np.ndarray, nodes: np.ndarray) -> None:
            """Puts nodes (a few for each of rows) that are new into the beams."""
            new = nodes >= 0
            new &= ~seen[rows[:, None], nodes]
            s = np.matmul(u[nodes], q[rows][:, :, None])[:, :, 0]
            s[~new] = -np.inf
            r, c = np.nonzero(new)
            seen[rows[r], nodes[r, c]] = True
            inside = s >= least
            r, c = np.nonzero(inside)
            hit[rows[r], nodes[r, c]] = True
            ids, scores = np.concatenate([beam[rows], nodes], 1), np.concatenate([score[rows], s], 1)
            top = np.argpartition(-scores, BEAM - 1, axis=1)[:, :BEAM]
            beam[rows], score[rows] = np.take_along_axis(ids, top, 1), np.take_along_axis(scores, top, 1)

        for start in entries[lo : lo + BLOCK].T:
            meet(at, start[:, None])
        while True:
            open_score = np.where((beam >= 0) & ~spent[at[:, None], beam], score, -np.inf)
            pick = open_score.argmax(1)
            rows = np.flatnonzero(open_score[at, pick] > -np.inf)
            if not len(rows):
                break
            nodes = beam[rows, pick[rows]]
            spent[rows, nodes] = True
            meet(rows, links[nodes])
        while (front := hit & ~spent).any():
            spent |= front
            r, c = np.nonzero(front)
            for i in range(0, len(r), PAIRS):
                near = links[c[i : i + PAIRS]]
                owner = np.broadcast_to(r[i : i + PAIRS, None], near.shape)[near >= 0]
                fresh = np.zeros((k, n), bool)
                fresh[owner, near[near >= 0]] = True
                fresh &= ~seen
                seen |= fresh
                a, b = np.nonzero(fresh)
                for j in range(0, len(a), PAIRS):
                    inside = np.einsum("ij,ij->i", q[a[j : j + PAIRS]], u[b[j : j + PAIRS]]) >= least
                    hit[a[j : j + PAIRS][inside], b[j : j + PAIRS][inside]] = True
        hits.append(hit)
    return np.concatenate(hits) if hits else np.zeros((0, n), bool)


def _build(table: pa.Table) -> pa.Table:
    """A shard's points with the names of their neighbours in its graph."""
    names = np.stack([table.column("p1").to_numpy(), table.column("p2").to_numpy()], 1)
    links = [names[near].tobytes() for near in robust_graph(_unit(table))]
    return table.append_column("links", pa.array(links, pa.binary()))


def _components(linked: np.ndarray) -> np.ndarray:
    """Smallest row reachable from each row of a symmetric matrix."""
    n = len(linked)
    least = np.arange(n)
    while True:
        new = np.minimum(least, np.where(linked, least[None, :], n).min(1, initial=n))
        new = new[new]
        if (new == least).all():
            return least
        least = new


def _search(threshold: float):
    """Mapper of a shard, or of two blocks of a dense one, to its points' numbers of links and the edges of a spanning forest."""

    def search(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("p1", "ascending"), ("p2", "ascending")])
        p1, p2, ids, m = (table.column(c).to_numpy() for c in ("p1", "p2", "id", "m"))
        cell, lo, hi = (table.column(c)[0].as_py() for c in ("cell", "lo", "hi"))
        block = table.column("block").to_numpy()
        unit = _unit(table)
        u, n = unit.astype(np.float32), len(unit)
        place = {name: i for i, name in enumerate(np.stack([p1, p2], 1).view("V16").ravel().tolist())}
        near = []
        for i, lists in enumerate(table.column("links").to_pylist()):
            joined = b"".join(lists)
            here = {place.get(joined[k : k + 16], -1) for k in range(0, len(joined), 16)} - {-1, i}
            near.append(sorted(j for j in here if block[j] == block[i]))
        links = np.full((n, max(1, max(map(len, near)))), -1)
        for i, x in enumerate(near):
            links[i, : len(x)] = x
        found = np.zeros((n, n), bool)
        for queries, nodes in ({(lo, hi), (hi, lo)}):
            graph, asked = np.flatnonzero(block == nodes), np.flatnonzero(block == queries)
            if len(graph) and len(asked):
                entries = np.full((len(asked), 2), graph[_medoid(u[graph])])
                entries[:, 1] = asked if lo == hi else -1
                found[asked] |= range_search(u, links, asked, entries, threshold - 1e-4)
        np.fill_diagonal(found, False)
        a, b = np.nonzero(np.triu(found | found.T))
        linked = np.zeros((n, n), bool)
        for i in range(0, len(a), PAIRS):
            x, y = a[i : i + PAIRS], b[i : i + PAIRS]
            sure = np.einsum("ij,ij->i", unit[x], unit[y]) >= threshold
            linked[x[sure], y[sure]] = linked[y[sure], x[sure]] = True
        least = _components(linked)
        # two points that share several shards count their link in the first
        homes = table.column("cells").to_pylist()
        shared: dict[str, list[int]] = {}
        for i, cells in enumerate(homes):
            for c in cells:
                if c < cell:
                    shared.setdefault(c, []).append(i)
        for rows in shared.values():
            linked[np.ix_(rows, rows)] = False
        count = linked @ m
        some, far = np.flatnonzero(count), np.flatnonzero(least != np.arange(n))
        left, right = np.append(some, far), np.append(np.full(len(some), -1), least[far])
        value = lambda column: pa.array(np.where(right < 0, 0, column[right]), pa.int64(), mask=right < 0)
        return pa.table([pa.array(p1[left]), pa.array(p2[left]), pa.array(ids[left]), pa.array(np.append(count[some], np.zeros(len(far), np.int64)).astype(np.int64)), value(p1), value(p2), value(ids)], ["p1", "p2", "id", "links", "q1", "q2", "qid"])

    return search


def link_vectors(vectors: DataFrame, threshold: float = THRESHOLD, shard: int = SHARD) -> DataFrame:
    """Per row of vectors (vec_id, embedding, label, and any others): vec_id, n_links, component_id, kept.

    Rows of one label and length link when the cosine of their embeddings, in double precision, is threshold or more. Equal
    vectors are one point with a number of rows. Points go to overlapping shards around centres; each shard builds a robust-pruned
    graph, a point's neighbours of all its shards are joined into one list, and every point is searched for in its shards, greedily
    from the medoid and from itself, widening over all that is in range. Pairs found are verified in double precision. Pairs are
    never rows of a table: shards give numbers of links and spanning forests. No link is below the threshold; a link whose points
    share no shard is lost (audit_recall measures them).

    Labels that are null and embeddings that are null, empty, zero, or hold null or non-finite components link with nothing.
    Repeated ids are rows of their own, with one component if either's is the smaller; a row without an id never names a
    component: component_id is null where nothing reachable has one, and kept then. An empty table gives no rows.
    """
    finite = "embedding IS NOT NULL AND label IS NOT NULL AND forall(embedding, x -> coalesce(abs(x) < double('infinity'), false)) AND exists(embedding, x -> x <> 0)"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.withColumn("usable", F.coalesce(F.expr(finite), F.lit(False)))
    vec = F.transform("embedding", lambda x: x + F.lit(0.0))  # one zero for both signs
    usable = rows.where("usable").select("vec_id", vec.alias("vec"), F.concat_ws("/", F.size("embedding").cast("string"), "label").alias("cell"))
    usable = usable.withColumns({"p1": F.xxhash64(F.lit(1), "cell", "vec"), "p2": F.xxhash64(F.lit(2), "cell", "vec")})

    points = materialize(_points(usable), "points")
    shards, tables = _shards(points, threshold, shard)
    graphs = shards.groupBy("cell", "block").applyInArrow(_build, _FIELDS + ", links binary")
    home = F.struct("cell", "block", "blocks")
    union = graphs.groupBy("p1", "p2").agg(F.any_value("id").alias("id"), F.any_value("m").alias("m"), F.any_value("vec").alias("vec"), F.collect_set(home).alias("homes"), F.collect_list("links").alias("links"))
    union = materialize(union, "graph")
    asked = union.select("p1", "p2", "id", "m", "vec", "links", F.expr("transform(homes, h -> h.cell)").alias("cells"), F.explode("homes").alias("home")).select("*", "home.*").drop("home")
    asked = asked.select("*", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("other"))
    asked = asked.select("*", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")).drop("other")
    found = materialize(asked.groupBy("cell", "lo", "hi").applyInArrow(_search(threshold), "p1 long, p2 long, id long, links long, q1 long, q2 long, qid long"), "links")
    discard(*tables, union)

    node = lambda i, a, b: F.struct(F.col(i).alias("id"), F.col(a).alias("p1"), F.col(b).alias("p2"))
    components = connected_components(found.where("q1 IS NOT NULL").select(node("id", "p1", "p2").alias("a"), node("qid", "q1", "q2").alias("b")))
    counts = found.where("q1 IS NULL").groupBy("p1", "p2").agg(F.sum("links").alias("links"))
    named = points.select("p1", "p2", "id", "m").join(counts, ["p1", "p2"], "left").join(components.select("node.p1", "node.p2", F.col("component.id").alias("first")), ["p1", "p2"], "left")
    named = named.select("p1", "p2", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.nullif(F.coalesce("first", "id"), F.lit(NO_ID)).alias("component_id"))
    linked = usable.select("vec_id", "p1", "p2").join(named, ["p1", "p2"]).select("vec_id", "n_links", "component_id")
    lone = rows.where("NOT usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionAll(lone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def audit_recall(vectors: DataFrame, linked: DataFrame, threshold: float = THRESHOLD, step: int = 20, block: int = 4096) -> DataFrame:
    """(label, queries, links, found, recall) by brute force: every vector whose id is divisible by step against all of its label, in blocks.

    linked: rows of link_vectors; links counts true links of the queries, found those counted there. Ids must be unique. Recall
    is null for labels without links.
    """
    rows = vectors.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND forall(embedding, x -> coalesce(abs(x) < double('infinity'), false)) AND exists(embedding, x -> x <> 0)")
    rows = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("vec"), F.concat_ws("/", F.size("embedding").cast("string"), F.col("label").cast("string")).alias("cell"), F.col("label").cast("string").alias("label"))
    sizes = rows.groupBy("cell").agg(F.ceil(F.count("*") / block).alias("parts"), F.ceil(F.sum((F.col("vec_id") % step == 0).cast("long")) / block).alias("turns"))
    sized = rows.join(sizes, "cell").where("turns > 0")
    queries = sized.where(F.col("vec_id") % step == 0).select("vec_id", "label", "vec", "cell", F.pmod(F.xxhash64("vec_id"), "turns").alias("turn"), F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"))
    against = sized.select(F.col("vec_id").alias("other_id"), F.col("vec").alias("other"), F.col("cell").alias("of"), F.pmod(F.xxhash64("vec_id"), "parts").alias("at"), F.explode(F.expr("sequence(0L, turns - 1)")).alias("for"))

    def count(asked: pa.Table, all_of: pa.Table) -> pa.Table:
        ids, n = asked.column("vec_id").to_numpy(), np.zeros(asked.num_rows, np.int64)
        if asked.num_rows and all_of.num_rows:
            n = ((_unit(asked) @ _unit(all_of, "other").T >= threshold) & (ids[:, None] != all_of.column("other_id").to_numpy()[None, :])).sum(1)
        return pa.table([asked.column("vec_id"), asked.column("label"), pa.array(n)], ["vec_id", "label", "n"])

    true = queries.groupBy("cell", "turn", "part").cogroup(against.groupBy("of", "for", "at")).applyInArrow(count, "vec_id long, label string, n long")
    true = true.groupBy("vec_id", "label").agg(F.sum("n").alias("n"))
    both = true.join(linked.select("vec_id", "n_links"), "vec_id")
    return both.groupBy("label").agg(F.count("*").alias("queries"), F.sum("n").alias("links"), F.sum(F.least("n", "n_links")).alias("found")).withColumn("recall", F.try_divide("found", "links"))


def op12_flat_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    return link_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


#: All pairs of a label; components by the smallest row reached.
OP12_SQL = r"""
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS row, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), usable AS (
  SELECT row, vec_id, label, e, sqrt(list_inner_product(e, e)) AS size FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.row AS x, b.row AS y FROM usable a JOIN usable b ON a.label = b.label AND a.row <> b.row AND len(a.e) = len(b.e) WHERE list_inner_product(a.e, b.e) / (a.size * b.size) >= 0.98
), reach AS (
  SELECT row AS x, row AS y FROM v UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y
), least AS (
  SELECT x, min(vec_id) AS component_id FROM reach JOIN v ON v.row = reach.y GROUP BY x
), n AS (
  SELECT x, count(*) AS n FROM links GROUP BY x
)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN least ON least.x = v.row LEFT JOIN n ON n.x = v.row
"""
