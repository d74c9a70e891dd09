"""Exact top-k search by inner product, with dual cover trees.

Vectors are integers, floor(scale * x) of each component. Candidates lie in cells of about ``cell_rows`` vectors: the
Voronoi cells of sampled pivots, one for each ``cell_rows`` rows; a cell that is still too large is cut by pivots of its
own, and only what geometry cannot cut (copies of one vector) is dealt by a hash. Queries lie in groups made likewise.

Every cell and every group is a ball, a centre with a covering radius. For a ball of queries (centre q, radius r) and a
ball of candidates (centre c, radius s),

    x . y  <=  q . c + |q| s + |c| r + r s

for all queries x and candidates y in them. Over the balls of either side stands a tree: neighbouring balls lie in a larger
one, about ``FAN`` in each, up to one root, and the least kth score of a node's queries goes up with them. The search has two
rounds, and only balls meet before a vector is sent. Each goes down both trees at once from the pair of roots, a level a join:

1. each group takes, level by level, the cell of the highest bound below where it is; the cell that it ends in gives each
   query a kth best score (before that, its kth best among the pivots);
2. a pair of nodes whose bound is below the least kth score of its queries is dropped with all that lies below it; groups then
   go to the cells that are left.

Inside a pair, cover trees of either side go on in the same way: a pair of nodes is dropped if its bound is below the
worst kth score of the query node. A worker keeps the trees of the last cell and group it met. A node with no structure to prune by (its cover would need
over ``FAN`` children, as in many dimensions) is a leaf, and a pair of leaves is one matrix product, in exact integers.

Vectors that are null, empty, or hold null or non-finite components take no part, and neither do null ids; other vectors of
different widths are an error. An empty table gives no rows. A row is never its own candidate; other rows with its id or vector are. Ties go to
the smaller id. Other columns of the table, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Stash

LEAF, FAN, LOWEST = 64, 16, -(2**62)
BALL = T.StructType().add("centre", T.ArrayType(T.DoubleType())).add("norm", "double").add("radius", "double")
FOUND = "q_row long, query_id long, vec_id long, row long, score long"


class Node:
    __slots__ = ("rows", "centre", "norm", "radius", "children")

    def __init__(self, rows, centre, radius):
        self.rows, self.centre, self.radius, self.children = rows, centre, radius, []
        self.norm = float(np.sqrt(centre @ centre))


def _cover(x: np.ndarray, rows: np.ndarray, reach: float) -> list[tuple[int, np.ndarray]]:
    """Centres among the rows, and the rows within `reach` of each and of none before it; none if over FAN are needed."""
    out, left = [], rows
    while len(left):
        if len(out) == FAN:
            return []
        d = np.sqrt(np.square(x[left] - x[left[0]]).sum(axis=1))
        near = d <= reach
        near[0] = True
        out.append((int(left[0]), left[near]))
        left = left[~near]
    return out


def cover_tree(x: np.ndarray, base: float = 2.0) -> Node:
    """All points below one node. Children cover their parent's points with radius / base, each around one of its points."""
    root: list[Node] = []
    work = [(np.arange(len(x)), 0, root)]
    while work:
        rows, centre, siblings = work.pop()
        radius = float(np.sqrt(np.square(x[rows] - x[centre]).sum(axis=1).max(initial=0))) * (1 + 1e-12)
        node = Node(rows, x[centre], radius)
        siblings.append(node)
        if len(rows) > LEAF and radius > 0:
            work += [(own, c, node.children) for c, own in _cover(x, rows, radius / base)]
    return root[0]


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products; floats where they are exact, else 64-bit integers."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    return np.rint(q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64) if most < 2**52 else q @ x.T


class Side:
    """The vectors of one cell or group, with their tree."""

    def __init__(self, packed: pa.StructScalar | pa.ListScalar):
        s = packed.values
        self.v = _matrix(s.field("v"))
        self.ids, self.rows = np.asarray(s.field("id")), np.asarray(s.field("row"))
        self.floor = np.asarray(s.field("floor")) if "floor" in [f.name for f in s.type] else None
        self.tree = cover_tree(self.v.astype(np.float64))


def search(q: Side, x: Side, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best k candidates of each query that reach its floor: positions of queries and of candidates, scores."""
    worst = q.floor.copy()
    best = (np.zeros(0, np.int64),) * 3

    def merge(a: Node, b: Node) -> None:
        nonlocal best
        score = products(q.v[a.rows], x.v[b.rows])
        score[q.rows[a.rows][:, None] == x.rows[b.rows][None, :]] = LOWEST
        least = worst[a.rows]
        if len(b.rows) > k:
            least = np.maximum(least, np.partition(score, len(b.rows) - k, axis=1)[:, -k])
        i, j = np.nonzero((score >= least[:, None]) & (score > LOWEST))
        if not len(i):
            return
        qi, xi, s = (np.concatenate(z) for z in zip(best, (a.rows[i], b.rows[j], score[i, j]), strict=True))
        order = np.lexsort((x.rows[xi], x.ids[xi], -s, qi))
        qi, xi, s = qi[order], xi[order], s[order]
        begins = np.flatnonzero(np.r_[True, qi[1:] != qi[:-1]])
        place = np.arange(len(qi)) - np.repeat(begins, np.diff(np.r_[begins, len(qi)]))
        last = place == k - 1
        worst[qi[last]] = np.maximum(worst[qi[last]], s[last])
        keep = place < k
        best = qi[keep], xi[keep], s[keep]

    def visit(a: Node, b: Node) -> None:
        dot = float(a.centre @ b.centre)
        most = dot + a.norm * b.radius + b.norm * a.radius + a.radius * b.radius
        if most + 1e-9 * abs(most) + 1e-6 < worst[a.rows].min():
            return
        if not a.children and not b.children:
            merge(a, b)
        elif b.children and (not a.children or b.radius >= a.radius):
            for child in sorted(b.children, key=lambda c: -float(a.centre @ c.centre) - a.norm * c.radius):
                visit(a, child)
        else:
            for child in a.children:
                visit(child, b)

    visit(q.tree, x.tree)
    return best


def integers(column: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as x in double; null if the vector or a component is null or not finite."""
    x = F.transform(column, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(column.isNotNull() & (F.size(column) > 0) & ~bad, F.transform(x, lambda v: F.floor(v * scale).cast("long")))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.int64)


def _nearest(m: np.ndarray, p: np.ndarray) -> np.ndarray:
    return (np.square(p).sum(axis=1) - 2 * (m.astype(np.float64) @ p.T)).argmin(axis=1)


def sampled(vectors: DataFrame, k: int, n: int) -> list:
    """k of the n rows, by a hash; all, if there are fewer."""
    unit = F.pmod(F.xxhash64("row", F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    return vectors.select("row", "v").filter(unit < 8.0 * k / max(n, 1)).orderBy(unit, "row").limit(k).collect()


def dealt(vectors: DataFrame, size: int, name: str, stash: Stash, most_pivots: int = 256, fan: int = 16) -> DataFrame:
    """vectors (row, v, ...) with a cell number in the column `name`; no cell holds much over `size` rows.

    First the nearest of at most most_pivots sampled pivots; then, in cells of over 2 * size rows, the nearest of up to
    `fan` rows of the cell (most_pivots * fan vectors are broadcast); then, in parts that are still larger, a hash of the
    row.
    """
    spark, n = vectors.sparkSession, vectors.count()
    want = min(most_pivots, -(-n // size))
    if want <= 1 and n <= 2 * size:
        return vectors.withColumn(name, F.lit(0).cast("long"))
    pivots = np.array([r.v for r in sampled(vectors, max(want, 1), n)], dtype=np.float64)  # most_pivots rows
    held = spark.sparkContext.broadcast(pivots)

    @F.arrow_udf(T.IntegerType())
    def nearest(v: pa.Array) -> pa.Array:
        return pa.array(_nearest(_matrix(v), held.value).astype(np.int32) if len(v) else [], pa.int32())

    near = stash.put(vectors.withColumn("p1", nearest("v")))
    large = near.groupBy("p1").agg(F.count("*").alias("n")).filter(F.col("n") > 2 * size)  # most_pivots rows
    unit = F.pmod(F.xxhash64("row", F.lit(4)), F.lit(1 << 30)) / float(1 << 30)
    some = near.join(F.broadcast(large), "p1").filter(unit < F.lit(2.0 * fan) / F.col("n"))  # some 2 * fan rows a cell
    inner = some.groupBy("p1").agg(F.slice(F.array_sort(F.collect_list(F.struct(unit.alias("u"), "row", "v"))), 1, fan)["v"].alias("pivots")).collect()  # most_pivots * fan vectors at most
    own = spark.sparkContext.broadcast({r.p1: np.array(r.pivots, dtype=np.float64) for r in inner})

    @F.arrow_udf(T.IntegerType())
    def nearest_inside(v: pa.Array, p1: pa.Array) -> pa.Array:
        m, cell = _matrix(v), np.asarray(p1)
        out = np.zeros(len(cell), np.int32)
        for c in np.unique(cell).tolist():
            if c in own.value:
                out[cell == c] = _nearest(m[cell == c], own.value[c])
        return pa.array(out)

    parted = stash.put(near.withColumn("p2", nearest_inside("v", "p1")))
    sizes = parted.groupBy("p1", "p2").agg(F.count("*").alias("n"))
    parts = sizes.select("p1", "p2", F.greatest(F.ceil(F.col("n") / (2 * size)), F.lit(1)).alias("parts"))  # most_pivots * fan rows
    salt = F.pmod(F.xxhash64("row", F.lit(5)), F.col("parts"))
    cell = (F.col("p1").cast("long") * fan + F.col("p2")) * F.lit(1 << 32) + salt
    out = parted.join(F.broadcast(parts), ["p1", "p2"]).withColumn(name, cell.cast("long")).drop("p1", "p2", "parts")
    return out


@F.arrow_udf(BALL)
def ball(packed: pa.Array) -> pa.Array:
    """Mean and covering radius of each packed row's vectors."""
    out = []
    for one in packed:
        v = _matrix(one.values.field("v")).astype(np.float64)
        c = v.mean(axis=0)
        out.append({"centre": c.tolist(), "norm": float(np.sqrt(c @ c)), "radius": float(np.sqrt(np.square(v - c).sum(axis=1).max())) * (1 + 1e-9)})
    return pa.array(out, pa.struct([("centre", pa.list_(pa.float64())), ("norm", pa.float64()), ("radius", pa.float64())]))


@F.arrow_udf(BALL)
def covering(packed: pa.Array) -> pa.Array:
    """The ball around each packed row's balls."""
    out = []
    for one in packed:
        v, r = _matrix(one.values.field("centre")), np.asarray(one.values.field("radius"))
        c = v.mean(axis=0)
        out.append({"centre": c.tolist(), "norm": float(np.sqrt(c @ c)), "radius": float((np.sqrt(np.square(v - c).sum(axis=1)) + r).max()) * (1 + 1e-9)})
    return pa.array(out, pa.struct([("centre", pa.list_(pa.float64())), ("norm", pa.float64()), ("radius", pa.float64())]))


def ball_tree(balls: DataFrame, stash: Stash) -> list[DataFrame]:
    """balls (node, b) -> a table (node, parent, b) for each level, from these up to the one that has a single node."""
    out = []
    while balls.count() > 1:
        rows = dealt(balls.select(F.col("node").alias("row"), F.col("b.centre").alias("v"), "b"), FAN, "parent", stash)
        out.append(stash.put(rows.select(F.col("row").alias("node"), "parent", "b")))
        packed = out[-1].groupBy("parent").agg(F.collect_list(F.struct("b.centre", "b.radius")).alias("bs"))  # some 2 * FAN balls at most
        balls = stash.put(packed.select(F.col("parent").alias("node"), covering("bs").alias("b")))
    return [*out, balls.withColumn("parent", F.lit(None).cast("long"))]


def descended(q: list[DataFrame], x: list[DataFrame], stash: Stash, least: DataFrame | None = None) -> DataFrame:
    """Pairs (grp, cell) of the trees' lowest nodes: without `least`, for each group one cell, of the highest bound at every
    level; with it (node, least), all whose bound reaches the least score that the group's queries ask for."""
    dot = F.aggregate(F.zip_with("qb.centre", "xb.centre", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    most = dot + F.col("qb.norm") * F.col("xb.radius") + F.col("xb.norm") * F.col("qb.radius") + F.col("qb.radius") * F.col("xb.radius")
    asked = [least]
    for level in q[:-1] if least is not None else []:
        asked.append(stash.put(level.join(asked[-1], "node").groupBy(F.col("parent").alias("node")).agg(F.min("least").alias("least"))))
    roots = [t[-1].select("node").first() for t in (q, x)]  # a node each
    pairs = stash.spark.createDataFrame([tuple(r.node for r in roots)] if all(roots) else [], "qn long, xn long")
    i, j = len(q) - 1, len(x) - 1
    while i or j:

        def below(levels: list[DataFrame], at: int, name: str) -> DataFrame:
            t = levels[max(at - 1, 0)]
            return t.select(F.col("parent" if at else "node").alias(f"{name}n"), F.col("node").alias(f"{name}c"), F.col("b").alias(f"{name}b"))

        met = pairs.join(below(q, i, "q"), "qn").join(below(x, j, "x"), "xn").select("qc", "xc", (most + F.abs(most) * 1e-9 + 1e-6).alias("most"))
        i, j = max(i - 1, 0), max(j - 1, 0)
        if least is None:
            met = met.groupBy("qc").agg(F.max_by("xc", F.struct("most", "xc")).alias("xc"))
        else:
            met = met.join(asked[i].withColumnRenamed("node", "qc"), "qc").filter(F.col("most") >= F.col("least"))
        pairs = stash.put(met.select(F.col("qc").alias("qn"), F.col("xc").alias("xn")))
    return pairs.select(F.col("qn").alias("grp"), F.col("xn").alias("cell"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, cell_rows: int = 2048, group_rows: int = 512, n_floor: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best candidates, fewer if there are fewer."""
    spark = vectors.sparkSession
    stash = Stash(spark)
    all_rows = vectors.select(F.col(id_col).cast("long").alias("id"), integers(F.col(vector_col), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).filter(F.col("id").isNotNull() & F.col("v").isNotNull())
    all_rows = stash.put(all_rows.withColumn("row", F.monotonically_increasing_id()))
    widths = all_rows.groupBy(F.size("v").alias("w")).agg(F.count("*").alias("n")).orderBy("w").limit(2).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not widths:
        return empty
    if len(widths) > 1:
        raise ValueError(f"vectors of {widths[0].w} and of {widths[1].w} components have no inner product")
    usable = all_rows
    sample = sampled(usable, n_floor, widths[0].n)  # n_floor rows
    held = spark.sparkContext.broadcast((np.array([r.v for r in sample], dtype=np.int64), np.array([r.row for r in sample])))

    @F.arrow_udf("bigint")
    def floors(v: pa.Array, row: pa.Array) -> pa.Array:
        """The kth best score in the sample (each query's own row aside): no answer lies below it."""
        p, rows = held.value
        if len(p) <= k or not len(v):
            return pa.array([LOWEST] * len(v), pa.int64())
        s = np.where(np.asarray(row)[:, None] == rows[None, :], LOWEST, products(_matrix(v), p))
        return pa.array(np.partition(s, len(p) - k, axis=1)[:, -k])

    asked = usable.filter("asks").select("id", "row", "v", floors("v", "row").alias("floor"))
    asked = stash.put(dealt(asked, group_rows, "grp", stash))
    cells = dealt(usable.select("id", "row", "v"), cell_rows, "cell", stash)
    cells = stash.put(cells.groupBy("cell").agg(F.collect_list(F.struct("id", "row", "v")).alias("xs")).withColumn("x", ball("xs")))  # a cell is 2 * cell_rows vectors at most, or near it

    def groups(rows: DataFrame) -> DataFrame:
        return stash.put(rows.groupBy("grp").agg(F.collect_list(F.struct("id", "row", "floor", "v")).alias("qs"), F.min("floor").alias("least")).withColumn("q", ball("qs")))

    first_groups = groups(asked)
    # Balls only: one row for group_rows queries or cell_rows candidates.
    trees = [ball_tree(t.select(F.col(n).cast("long").alias("node"), F.col(b).alias("b")), stash) for t, n, b in ((first_groups, "grp", "q"), (cells, "cell", "x"))]
    nearest = descended(*trees, stash)

    def met(pairs: DataFrame, packed: DataFrame) -> DataFrame:
        def find(batches):
            grp = cell = q = x = None
            for b in batches:
                for g, c, qs, xs in zip(*(b.column(n) for n in ("grp", "cell", "qs", "xs")), strict=True):
                    if (g := g.as_py()) != grp:
                        grp, q = g, Side(qs)
                    if (c := c.as_py()) != cell:
                        cell, x = c, Side(xs)
                    i, p, s = search(q, x, k)
                    yield pa.RecordBatch.from_arrays([pa.array(z) for z in (q.rows[i], q.ids[i], x.ids[p], x.rows[p], s)], ["q_row", "query_id", "vec_id", "row", "score"])

        sent = pairs.join(packed.select("grp", "qs"), "grp").join(cells.select("cell", "xs"), "cell")
        return sent.select("grp", "cell", "qs", "xs").mapInArrow(find, FOUND)

    begun = stash.put(met(nearest, first_groups))
    kth = begun.groupBy("q_row").agg(F.count("*").alias("n"), F.min("score").alias("kth")).filter(F.col("n") >= k).select(F.col("q_row").alias("row"), "kth")
    second_groups = groups(asked.join(kth, "row", "left").withColumn("floor", F.greatest("floor", F.coalesce("kth", F.lit(LOWEST)))).drop("kth"))
    reach = descended(*trees, stash, second_groups.select(F.col("grp").alias("node"), "least"))
    open_pairs = reach.join(nearest, ["grp", "cell"], "left_anti")
    found = begun.unionByName(met(open_pairs, second_groups))
    order = Window.partitionBy("q_row").orderBy(F.col("score").desc(), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
