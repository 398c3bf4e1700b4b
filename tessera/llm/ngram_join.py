"""N-gram Jaccard join over count-vector R-trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import connected_components
from tessera.llm.storage import bound_batches, discard, join_frequent, materialize
from tessera.llm.tokens import SPACED, Slice, mix, shingles, slices, word_hashes, words

#: Words of a shingle, and the least similarity in hundredths.
SHINGLE, PERCENT = 5, 80
#: Groups that tokens (shingles) are hashed into: coordinates of a point.
GROUPS = 64
#: Shingles whose hash is below this share of all hashes come first in the global order, with their document frequencies.
COUNTED = 0.3
#: Members of its blocks that a document meets first. More leave fewer pairs to the trees; the result is the same.
HUBS = 4
#: Bytes of a tree's sets, about, and points of a leaf and nodes of an inner node.
TREE_BYTES, FANOUT = 1 << 20, 8
#: Pairs of nodes that are compared at once.
PAIRS = 1 << 14
#: Rows' names are broadcast up to this many (about 25 MB); beyond, they are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Names of rows without an id are numbers from here, of their texts, as are those of sets of an id that has several; ids are below.
NO_ID = 1 << 62
_LIMIT = np.uint64(int(COUNTED * 2**64))


def _sets(part: Slice, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct shingle hashes sorted within rows, row of each, number per row)."""
    found = words(part, SPACED)
    value, row = shingles(word_hashes(part, found, SPACED), found.per_row, size)
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    value, row = value[new], row[new]
    return value, row, np.bincount(row, minlength=part.last - part.first).astype(np.int64)


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each row's values modulo 2**64."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    ends = np.cumsum(counts)
    return (total[ends] - total[ends - counts]).view(np.int64)


def _digests(size: int):
    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(doc, row, n, d1, d2): n, d1 and d2 are equal for rows of equal sets."""
        for batch in batches:
            for part in slices(batch.column("text")):
                value, _, n = _sets(part, size)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).slice(part.first, part.last - part.first) for c in ("doc", "row")], pa.array(n), pa.array(_sums(value, n)), pa.array(_sums(mix(value ^ np.uint64(0x5851F42D4C957F2D)), n))], names=["doc", "row", "n", "d1", "d2"]
                )

    return digests


def _counted(size: int):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(h, row) of the shingles that are counted."""
        for batch in batches:
            docs = batch.column("row").to_numpy()
            for part in slices(batch.column("text")):
                value, row, _ = _sets(part, size)
                keep = value < _LIMIT
                yield pa.RecordBatch.from_arrays([pa.array(value[keep].view(np.int64)), pa.array(docs[part.first + row[keep]])], names=["h", "row"])

    return counted


def _full(size: int):
    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(doc, n, vec, hashes): whole sets and their counts by group; unsigned hashes as signed numbers."""
        for batch in batches:
            for part in slices(batch.column("text")):
                value, row, n = _sets(part, size)
                group = (value >> np.uint64(3)) % np.uint64(GROUPS)
                vec = np.bincount(row * GROUPS + group.astype(np.int64), minlength=len(n) * GROUPS).astype(np.int32)
                ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc").slice(part.first, part.last - part.first), pa.array(n), pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * GROUPS), pa.array(vec)), pa.ListArray.from_arrays(pa.array(ends), pa.array(value.view(np.int64)))],
                    names=["doc", "n", "vec", "hashes"],
                )

    return full


def _bound(a: Column, b: Column) -> Column:
    """Most elements that two sets can share: summed coordinate minima of their points."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)


def _reaches(shared: Column, n1: Column, n2: Column, percent: int) -> Column:
    return shared * 100 >= (n1 + n2 - shared) * percent


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) among candidate pairs (a, b), by their whole sets."""
    left = sets.select(F.col("doc").alias("a"), F.col("hashes").alias("ha"))
    right = sets.select(F.col("doc").alias("b"), F.col("hashes").alias("hb"))
    met = pairs.join(right, "b").join(left, "a").withColumn("shared", F.size(F.array_intersect("ha", "hb")))
    return met.where(_reaches(F.col("shared"), F.size("ha"), F.size("hb"), percent)).select("a", "b")


class Tree:
    """An R-tree of the points in one row, bulk-loaded: sorted by their code, FANOUT points to a leaf and FANOUT nodes to an inner node.

    A node knows the greatest coordinates below it (its corner), least and greatest size, and the component if there is one only.
    """

    def __init__(self, points: pa.StructArray) -> None:
        doc, n, component, code = (points.field(c).to_numpy() for c in ("doc", "n", "component", "code"))
        at = np.concatenate([[0], np.cumsum(n)])
        flat = points.field("hashes").flatten().to_numpy().view(np.uint64)
        vec = points.field("vec").flatten().to_numpy().reshape(len(doc), GROUPS)
        order = np.lexsort((n, code.view(np.uint64)))
        self.doc, self.n, self.component = doc[order], n[order], component[order]
        self.sets = [flat[at[i] : at[i + 1]] for i in order]
        #: Levels from the points up, each (corners, least sizes, greatest sizes, components).
        self.levels = [(vec[order], self.n, self.n, self.component)]
        while len(self.levels[-1][1]) > FANOUT:
            corner, least, most, own = self.levels[-1]
            cut = np.arange(0, len(least), FANOUT)
            low, high = np.minimum.reduceat(own, cut), np.maximum.reduceat(own, cut)
            self.levels.append((np.maximum.reduceat(corner, cut), np.minimum.reduceat(least, cut), np.maximum.reduceat(most, cut), np.where(low == high, low, -1)))


def _children(nodes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(which node, child) of all children of nodes, of n on the level below."""
    counts = np.minimum(nodes * FANOUT + FANOUT, n) - nodes * FANOUT
    which = np.repeat(np.arange(len(nodes)), counts)
    return which, nodes[which] * FANOUT + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _may_meet(a: tuple, b: tuple, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether any points below nodes i and j, of two components, could share as much as a link needs: bounded by the summed minima of their corners."""
    ok = (b[2][j] * 100 >= a[1][i] * percent) & (a[2][i] * 100 >= b[1][j] * percent) & ((a[3][i] != b[3][j]) | (a[3][i] < 0))
    some = np.flatnonzero(ok)
    most = np.minimum(a[0][i[some]], b[0][j[some]]).sum(1)
    ok[some] = most * 100 >= (a[1][i[some]] + b[1][j[some]] - most) * percent
    return ok


def meet(a: Tree, b: Tree, same: bool, percent: int) -> Iterator[tuple[int, int]]:
    """Links between points of two trees, which are descended together; of links that join the same components one is enough."""
    names, where = np.unique(np.concatenate([a.component, b.component]), return_inverse=True)
    mine, theirs = where[: len(a.doc)], where[len(a.doc) :]
    joined = np.arange(len(names))
    top = max(len(a.levels), len(b.levels)) - 1
    level_of = lambda t, k: t.levels[min(k, len(t.levels) - 1)]
    i, j = (x.ravel() for x in np.meshgrid(*[np.arange(len(level_of(t, top)[1])) for t in (a, b)], indexing="ij"))
    todo = [(top, i, j)]
    while todo:
        level, i, j = todo.pop()
        if len(i) > PAIRS:
            todo += [(level, i[PAIRS:], j[PAIRS:])]
            i, j = i[:PAIRS], j[:PAIRS]
        if same:
            i, j = i[i <= j], j[i <= j]
        ok = _may_meet(level_of(a, level), level_of(b, level), i, j, percent)
        i, j = i[ok], j[ok]
        if level:
            # a tree that isn't as high stays at its top until the other has come down to it
            if level < len(a.levels):
                which, i = _children(i, len(a.levels[level - 1][1]))
                j = j[which]
            if level < len(b.levels):
                which, j = _children(j, len(b.levels[level - 1][1]))
                i = i[which]
            todo.append((level - 1, i, j))
            continue
        if same:
            i, j = i[i < j], j[i < j]
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        for k in np.unique(i):
            some = j[np.searchsorted(i, k) : np.searchsorted(i, k, "right")]
            some = some[joined[theirs[some]] != joined[mine[k]]]
            if not len(some):
                continue
            own, sets = a.sets[k], [b.sets[x] for x in some]
            sizes = np.array([len(x) for x in sets])
            every = np.concatenate(sets)
            place = np.minimum(np.searchsorted(own, every), len(own) - 1)
            shared = np.add.reduceat((own[place] == every).astype(np.int64), np.cumsum(sizes) - sizes)
            for x in some[shared * 100 >= (len(own) + sizes - shared) * percent]:
                p, q = joined[mine[k]], joined[theirs[x]]
                if p != q:
                    joined[joined == max(p, q)] = min(p, q)
                    yield int(a.doc[k]), int(b.doc[x])


def _compare(percent: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int]] = []
            for i in range(batch.num_rows):
                same = batch.column("same")[i].as_py()
                tree = Tree(batch.column("points_a")[i].values)
                found += meet(tree, tree if same else Tree(batch.column("points_b")[i].values), same, percent)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])

    return compare


def _id(doc: Column) -> Column:
    return F.when(doc < NO_ID, doc)


def _one_order(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def ngram_components(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Components of the documents whose shingle sets have a Jaccard similarity of percent / 100 or more.

    Words are runs of anything but `[\\x20\\x09-\\x0D]`, A-Z lower-cased. A text of fewer than `size` words is one shingle, a
    text without words or null has none and is linked with nothing, not even its like.

    Exact, in these steps; all are joins and aggregations, and nothing about documents reaches the driver but counts.
    1. Equal sets are one class, which its smallest id stands for.
    2. Shingles with a hash below COUNTED are counted over all documents. A set with a partner has at most 1 - t of its
       shingles to itself, so a document with more unique ones among those is done: it has no link.
    3. The others' whole sets become points: shingles are hashed into GROUPS groups, and a coordinate counts a group. Their
       rarest shingles route them: counted shingles by frequency, then the rest by hash, are one order of all shingles,
       and two sets that are linked share one of their first n - ceil(t n) + 1. Points with such a shingle in common are
       one block, over which R-trees stand.
    4. Each document meets some HUBS members of its blocks, least by as many hashes and so the same ones for most of a group of
       copies, then one of each other block that isn't in its component yet; components are found.
       What a block has in two components after that goes through R-trees. Each point stands in one tree: its largest block's
       points are cut into cells by size and by whether they are above the mean in one coordinate after another, a cell of about TREE_BYTES is a
       tree. Trees that a block has in common meet if the summed minima of their corners allow the overlap needed; they are
       descended together, nodes and then points under the same bound. All pairs of different components in a block are met.
    5. Surviving pairs are verified by whole sets.

    Returns one row per input row: id, n_shingles, component_id (smallest id reachable by links, itself included). Ids are
    integers below 2 ** 62. Rows of one id are one node with the links of each text: each of its sets is a point of its own, named
    by 62 bits of a hash, with an edge to the id. Rows are told apart by 64 bits of a hash of id and text; of 10 ** 9 rows two
    share one with a probability of 0.03. A row without an id is a node of its own
    (with those of equal texts), counts as larger than any id, and is returned as null; so is the component of such rows alone. An
    empty table gives no rows. Other columns are ignored. A document's set fits one row (2 GB). Lowers the session's limits on Arrow batches (bound_batches).
    """
    spark = documents.sparkSession
    bound_batches(spark)
    doc = F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text_col).bitwiseAND(F.lit(NO_ID - 1)).bitwiseOR(F.lit(NO_ID)))
    rows = documents.select(doc.alias("doc"), F.col(text_col).alias("text")).select("doc", F.xxhash64("doc", "text").alias("row"), "text")
    digests = materialize(rows.mapInArrow(_digests(size), "doc long, row long, n long, d1 long, d2 long"), "digests")
    classes = digests.where("n > 0").groupBy("n", "d1", "d2").agg(F.min(F.struct("doc", "row")).alias("least")).select("n", "d1", "d2", F.col("least.doc").alias("of"), "least.row")
    # a set is a point by itself; sets of one id are joined to it by edges
    several = materialize(digests.groupBy("doc").agg(F.min(F.struct("n", "d1", "d2")).alias("x"), F.max(F.struct("n", "d1", "d2")).alias("y")).where("x <> y").select(F.col("doc").alias("of"), F.lit(True).alias("several")), "several")
    own_number = F.xxhash64("n", "d1", "d2").bitwiseAND(F.lit(NO_ID - 1)).bitwiseOR(F.lit(NO_ID))
    classes = materialize(classes.join(several, "of", "left").select("n", "d1", "d2", F.when(F.col("several"), own_number).otherwise(F.col("of")).alias("doc"), "row"), "classes")
    uses = rows.mapInArrow(_counted(size), "h long, row long").groupBy("h").agg(F.count("*").alias("df"), F.min("row").alias("row"))
    # one pass over the counts: shingles in one row are summed by row, others are listed
    uses = materialize(uses.select("h", F.when(F.col("df") > 1, F.col("df")).alias("df"), F.when(F.col("df") == 1, F.col("row")).alias("row")).groupBy(F.when(F.col("row").isNull(), F.col("h")).alias("h"), "row").agg(F.count("*").alias("alone"), F.max("df").alias("df")), "uses")
    alone = uses.where("h IS NULL").select("row", "alone")
    spare = lambda n: n - F.ceil(n * percent / 100)
    left = materialize(classes.join(alone, "row", "left").where(F.coalesce("alone", F.lit(0)) <= spare(F.col("n"))).select("row", "doc"), "candidates")
    few = left.count() <= BROADCAST_IDS
    points = materialize(rows.drop("doc").join(F.broadcast(left) if few else left, "row").select("doc", "text").mapInArrow(_full(size), "doc long, n long, vec array<int>, hashes array<long>").where("n > 0"), "points")
    limit = int(_LIMIT)
    frequency = uses.where("h IS NOT NULL").select("h", "df")
    first = points.select("doc", "n", F.expr(f"filter(hashes, h -> h >= 0 AND h < {limit})").alias("low"), F.expr(f"filter(hashes, h -> NOT (h >= 0 AND h < {limit}))").alias("high"))
    need = (spare(F.col("n")) + 1).cast("int")
    # every counted shingle takes part in the order; of the rest only as many as the prefix lacks
    counted = join_frequent(first.select("doc", need.alias("need"), F.size("low").alias("has"), F.explode("low").alias("h")), frequency, "h", "df")
    by_doc = counted.groupBy("doc").agg(F.max("need").alias("need"), F.max("has").alias("has"), F.sort_array(F.collect_set(F.struct("df", "h"))).alias("shared"))
    # counted shingles of one document come first in the order; those listed follow
    prefix = by_doc.select("doc", F.explode(F.expr("transform(slice(shared, 1, greatest(need - (has - size(shared)), 0)), s -> s.h)")).alias("h"))
    rest = first.select("doc", F.explode(F.slice("high", F.lit(1), F.greatest(need - F.size("low"), F.lit(0)))).alias("h"))
    keys = materialize(prefix.unionAll(rest).distinct(), "prefixes")
    shared_keys = keys.groupBy("h").agg(F.count("*").alias("k"), *[F.bit_xor(F.xxhash64("doc", F.lit(i))).alias(f"s{i}") for i in (1, 2)], *[F.min(F.struct(F.xxhash64("doc", F.lit(10 + i)).alias("x"), "doc")).alias(f"hub{i}") for i in range(HUBS)]).where("k > 1")
    # shingles with the same members make the same pairs: one block for all of them
    shared_keys = shared_keys.groupBy("k", "s1", "s2").agg(F.min("h").alias("h"), *[F.min(f"hub{i}").alias(f"hub{i}") for i in range(HUBS)])
    shared_keys = materialize(shared_keys, "shared-keys")
    # a shingle of a third of all points is one key
    where = materialize(join_frequent(keys, shared_keys, "h", "k").select("h", "doc", "k", *[f"hub{i}" for i in range(HUBS)]), "blocks")
    lean = points.select("doc", "n", "vec")
    hubs = lean.select(F.col("doc").alias("hub"), F.col("n").alias("hub_n"), F.col("vec").alias("hub_vec"))

    def linked(stars: DataFrame) -> DataFrame:
        """Edges among the pairs (hub, doc) given."""
        met = stars.where("doc <> hub").join(lean, "doc").join(hubs, "hub")
        met = met.where(_reaches(F.least("n", "hub_n"), F.col("n"), F.col("hub_n"), percent)).where(_reaches(_bound(F.col("vec"), F.col("hub_vec")), F.col("n"), F.col("hub_n"), percent))
        return materialize(_verified(met.select(*_one_order(F.col("hub"), F.col("doc"))).distinct(), points, percent), "links")

    members_of = where.select("h", "doc", "k", F.col("hub0.doc").alias("hub"))

    def placed(parts: DataFrame) -> DataFrame:
        """Blocks' members with their components so far."""
        return members_of.join(parts.select(F.col("node").alias("doc"), "component"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))

    # a few hubs for each document, then those of its other blocks that are elsewhere
    own = where.groupBy("doc").agg(*[F.min(f"hub{i}").alias(f"hub{i}") for i in range(HUBS)])
    edges = linked(own.select("doc", F.explode(F.array_distinct(F.array(*[F.col(f"hub{i}.doc") for i in range(HUBS)]))).alias("hub")))
    repeated = not several.isEmpty()
    if repeated:
        same_id = digests.where("n > 0").join(several.select(F.col("of").alias("doc")), "doc").join(classes.withColumnRenamed("doc", "node"), ["n", "d1", "d2"])
        edges = edges.unionAll(materialize(same_id.select(*_one_order(F.col("doc"), F.col("node"))).distinct(), "same-id"))
    parts = materialize(connected_components(edges), "components")
    of_hub = parts.select(F.col("node").alias("hub"), F.col("component").alias("hub_component"))
    apart = placed(parts).join(of_hub, "hub", "left").where(F.coalesce("hub_component", "hub") != F.col("component"))
    edges = materialize(edges.unionAll(linked(apart.select("hub", "doc").distinct())), "links")
    parts = materialize(connected_components(edges), "components")
    # blocks with members in several components
    known = placed(parts)
    mixed = known.groupBy("h").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 <> c2").select("h")
    members = materialize(known.join(mixed, "h").select("h", "doc", "component", "k"), "members")
    # each point stands in one tree: a cell of the largest of its blocks
    homes = members.groupBy("doc", "component").agg(F.max(F.struct("k", "h")).alias("top")).join(lean, "doc")
    band = F.floor(F.log("n") * 25)
    # by bits, whether a coordinate is above the mean
    code = F.aggregate("vec", F.lit(0).cast("long"), lambda c, x: F.shiftleft(c, 1).bitwiseOR((x * GROUPS > F.col("n")).cast("long")))
    depth = F.least(F.greatest(F.ceil(F.log2(F.col("top.k") * F.col("n") * 8 / TREE_BYTES)), F.lit(0)), F.lit(32)).cast("int")
    homes = homes.select("doc", "component", "n", code.alias("code"), F.xxhash64("top.h", band, F.when(depth > 0, F.call_function("shiftrightunsigned", code, 64 - depth)).otherwise(0)).alias("cell"))
    cells = homes.groupBy("cell").agg(F.sum("n").alias("cell_n"))
    # equal codes stay in one cell, however many: such a cell is dealt into several trees
    homes = homes.join(cells, "cell").withColumn("tree", F.xxhash64("cell", F.pmod(F.xxhash64("doc"), F.ceil(F.col("cell_n") * 8 / TREE_BYTES).cast("long"))))
    homes = materialize(homes.select("doc", "component", "code", "tree"), "homes")
    in_block = members.select("h", "doc").join(homes, "doc").groupBy("h", "tree").agg(F.min("component").alias("c1"), F.max("component").alias("c2"))
    left_tree, right_tree = (in_block.select("h", F.col("tree").alias(f"tree_{x}"), F.col("c1").alias(f"c1_{x}"), F.col("c2").alias(f"c2_{x}")) for x in "ab")
    meetings = left_tree.join(right_tree, "h").where("tree_a <= tree_b AND NOT (c1_a = c2_a AND c1_b = c2_b AND c1_a = c1_b)").select("tree_a", "tree_b").distinct()
    packed = homes.join(points, "doc").groupBy("tree").agg(F.collect_list(F.struct("doc", "n", "component", "code", "vec", "hashes")).alias("points"), F.min("n").alias("least_n"), F.max("n").alias("most_n"))
    corner = F.expr(f"aggregate(points, array_repeat(0, {GROUPS}), (c, p) -> zip_with(c, p.vec, (x, y) -> greatest(x, y)))")
    trees = materialize(packed.withColumn("corner", corner), "trees")
    side = lambda x, *more: trees.select(F.col("tree").alias(f"tree_{x}"), *[F.col(c).alias(f"{c}_{x}") for c in more])
    near = meetings.join(side("a", "least_n", "most_n", "corner"), "tree_a").join(side("b", "least_n", "most_n", "corner"), "tree_b")
    # the most that points of both can share, against the least that their smallest sizes need
    near = near.where((F.col("most_n_b") * 100 >= F.col("least_n_a") * percent) & (F.col("most_n_a") * 100 >= F.col("least_n_b") * percent)).where(_reaches(_bound(F.col("corner_a"), F.col("corner_b")), F.col("least_n_a"), F.col("least_n_b"), percent))
    pairs = near.select("tree_a", "tree_b").join(side("a", "points"), "tree_a").join(side("b", "points"), "tree_b").select((F.col("tree_a") == F.col("tree_b")).alias("same"), "points_a", "points_b")
    more = materialize(pairs.mapInArrow(_compare(percent), "a long, b long"), "links")
    if not more.isEmpty():
        parts = materialize(connected_components(edges.unionAll(more)), "components")
    discard(uses, left, points, keys, shared_keys, where, members, homes, trees)
    of_class = classes.join(parts, classes.doc == parts.node, "left").select("n", "d1", "d2", F.coalesce("component", "doc").alias("component"))
    out = digests.join(of_class, ["n", "d1", "d2"], "left")
    if repeated:
        # an id's rows without words have its component, too
        of_id = several.join(parts, several.of == parts.node).select(F.col("of").alias("doc"), F.col("component").alias("id_component"))
        out = out.join(of_id, "doc", "left").withColumn("component", F.coalesce("id_component", "component"))
    return out.select(_id(F.col("doc")).alias(id_col), F.col("n").alias("n_shingles"), _id(F.coalesce("component", "doc")).alias("component_id"))


def op1_ngram_join(spark, sf_dir: str) -> DataFrame:
    return ngram_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op1_ctes(docs: str) -> str:
    return f"""
said AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), []) AS w FROM {docs}),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM said),
grams AS (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS g FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS common FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared WHERE 100 * common >= 80 * (na + nb - common)),
two AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM two UNION SELECT reach.a, two.b FROM reach JOIN two ON reach.b = two.a),
least_of AS (SELECT a AS doc_id, min(b) AS other FROM reach GROUP BY a)"""


OP1_SQL = f"WITH RECURSIVE {op1_ctes('documents')} SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(other, doc_id)) AS component_id FROM sets LEFT JOIN least_of USING (doc_id)"
