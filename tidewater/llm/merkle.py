"""Merkle manifest of a dataset: a tree for each source, and a tree of the sources' roots.

Leaves are sorted by (source, id) and dealt in ranges to blocks of some ``per_block`` leaves; a block's sources are numbered
from where the blocks before it end. Each block builds a mountain range: a stack that takes leaf after leaf and, whenever
its top closes a run of ``FAN`` nodes of one level (at the end of a source: a shorter run, without padding), replaces the run
by its parent, level after level, as a counter carries. What the stack makes are node records; what is left on it are the
block's peaks, at most 2 * (FAN - 1) a level for the sources that reach over its edges. Peaks of ``MERGED`` neighbouring
blocks meet in one task, whose stack goes on where theirs ended, and so on until one task is left; no task holds a source.

Proofs go the other way: each round gives the peaks below it the siblings from there to the root, and each block completes
them for its leaves. So neither a source nor a level of the tree is ever gathered.

A null field counts as ``-``; rows without an id come first and are never tampered with, those without a source are the
first source. Rows that share an id are leaves of their own, ordered by their digests. An empty text is a field of 0 bytes;
long texts are hashed where they are read and go no further. An empty table has no nodes and no rows. Other columns,
whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stash

FAN, MERGED = 3, 64
Node = tuple[int, int, str]  # level, place in the level, digest as hex text


def digest(texts: Iterable[str]) -> str:
    return sha256("".join(texts).encode()).hexdigest()


def widths(total: int) -> list[int]:
    """How many nodes each level of a tree of `total` leaves has."""
    out = [total]
    while out[-1] > 1:
        out.append(-(-out[-1] // FAN))
    return out


def carry(nodes: Iterable[Node], total: int) -> tuple[list[Node], list[Node]]:
    """What the stack makes of neighbouring nodes of one tree, and the peaks that are left on it."""
    wide, made, stack = widths(total), [], []
    for node in nodes:
        stack.append(node)
        while stack[-1][0] < len(wide) - 1:
            level, at, _ = stack[-1]
            first = at - at % FAN
            n = min(FAN, wide[level] - first)
            if at - first != n - 1 or len(stack) < n or stack[-n][:2] != (level, first):
                break
            parent = (level + 1, at // FAN, digest(d for _, _, d in stack[-n:]))
            stack[-n:] = [parent]
            made.append(parent)
    return made, stack


def climber(known: dict[tuple[int, int], str], above: dict[tuple[int, int], tuple[tuple[str, ...], str]], total: int) -> Callable:
    """A function (level, place) -> (path, root): `left|right` siblings of each level up to the root. `above` holds the
    paths of nodes whose parents lie elsewhere, `known` the digests of the nodes below them."""
    wide, seen = widths(total), dict(above)

    def path(level: int, at: int, keep: bool = True) -> tuple[tuple[str, ...], str]:
        if (level, at) in seen:
            return seen[level, at]
        first = at - at % FAN
        run = range(first, min(first + FAN, wide[level]))
        up, root = path(level + 1, at // FAN)
        out = (("".join(known[level, i] for i in run if i < at) + "|" + "".join(known[level, i] for i in run if i > at), *up), root)
        if keep:
            seen[level, at] = out
        return out

    return path


def fold(leaf: str, path: Iterable[str]) -> str:
    for step in path:
        left, _, right = step.partition("|")
        leaf = digest((left, leaf, right))
    return leaf


@dataclass(frozen=True)
class Forest:
    """Node records by round: round 0 holds the leaves and what the blocks made, round r what tasks of MERGED units made."""

    rounds: list[DataFrame]
    schema: str
    stash: Stash

    def nodes(self) -> DataFrame:
        """All nodes: tree (its name), level, place, digest."""
        each = [r.filter("made").select(F.col("g").alias("tree"), "level", "place", F.lower(F.hex("h")).alias("digest")) for r in self.rounds]
        out = each[0]
        for e in each[1:]:
            out = out.unionByName(e)
        return out

    def roots(self) -> DataFrame:
        """One row a tree: round and unit where its root was made, g, level, h."""
        each = [r.filter("root").select(F.lit(i).alias("round"), "unit", "g", "level", "h") for i, r in enumerate(self.rounds)]
        out = each[0]
        for e in each[1:]:
            out = out.unionByName(e)
        return out


def _slices(t: pa.Table):
    """(tree, first row, rows behind the last) of each run of rows with one g."""
    names, at = t.column("g").to_pylist(), 0
    while at < len(names):
        stop = at + 1
        while stop < len(names) and names[stop] == names[at]:
            stop += 1
        yield names[at], at, stop
        at = stop


def _records(unit: int, g: str | None, total: int, made: list[Node], peaks: list[Node], schema: pa.Schema, new: bool = True) -> pa.Table:
    top = len(widths(total)) - 1
    left = {(lv, at) for lv, at, _ in peaks}
    n = len(made)
    cols = {
        "unit": [unit] * n, "g": [g] * n, "total": [total] * n, "level": [lv for lv, _, _ in made], "place": [at for _, at, _ in made], "h": [bytes.fromhex(d) for _, _, d in made],
        "root": [lv == top for lv, _, _ in made], "peak": [lv < top and (lv, at) in left for lv, at, _ in made], "made": [new] * n, "p": [None] * n,
    }
    return pa.Table.from_pydict(cols, schema=schema)


def _sown(schema: pa.Schema):
    """Leaves of a block and where its sources begin -> the block's node records."""

    def sow(leaves: pa.Table, begins: pa.Table) -> pa.Table:
        if not leaves.num_rows:
            return schema.empty_table()
        leaves = leaves.take(pc.sort_indices(leaves.column("row")))
        unit, out = leaves.column("unit")[0].as_py(), []
        where = {g: (b, t) for g, b, t in zip(*(begins.column(c).to_pylist() for c in ("g", "begin", "total")), strict=True)}
        for g, a, b in _slices(leaves):
            begin, total = where[g]
            some = leaves.slice(a, b - a)
            nodes = [(0, begin + i, h.hex()) for i, h in enumerate(some.column("h").to_pylist())]
            made, peaks = carry(nodes, total)
            left = {at for lv, at, _ in peaks if not lv}
            n = b - a
            cols = {
                "unit": pa.array([unit] * n, pa.int64()), "g": pa.array([g] * n, pa.string()), "total": pa.array([total] * n, pa.int64()), "level": pa.array([0] * n, pa.int32()),
                "place": pa.array(range(begin, begin + n), pa.int64()), "h": some.column("h"), "root": pa.array([total == 1] * n), "peak": pa.array([total > 1 and begin + i in left for i in range(n)]), "made": pa.array([True] * n), "p": some.column("p"),
            }
            out += [pa.Table.from_pydict(cols).cast(schema), _records(unit, g, total, made, peaks, schema)]
        return pa.concat_tables(out)

    return sow


def _by_place(t: pa.Table) -> pa.Table:
    """Peaks in the order of their trees and leaves."""
    first = pa.array([at * FAN**lv for lv, at in zip(t.column("level").to_pylist(), t.column("place").to_pylist(), strict=True)], pa.int64())
    return t.append_column("_first", first).sort_by([("g", "ascending"), ("_first", "ascending")])


def _merged(schema: pa.Schema):
    def merge(peaks: pa.Table) -> pa.Table:
        peaks, out = _by_place(peaks), []
        unit = peaks.column("unit")[0].as_py()
        for g, a, b in _slices(peaks):
            some = peaks.slice(a, b - a)
            total = some.column("total")[0].as_py()
            nodes = [(lv, at, h.hex()) for lv, at, h in zip(*(some.column(c).to_pylist() for c in ("level", "place", "h")), strict=True)]
            made, left = carry(nodes, total)
            out.append(_records(unit, g, total, made, left, schema))
            still = {(lv, at) for lv, at, _ in left}.difference((lv, at) for lv, at, _ in made)
            kept = [n for n in nodes if n[:2] in still]  # peaks that go on to the next round as they are
            if kept:
                out.append(_records(unit, g, total, kept, kept, schema, new=False))
        return pa.concat_tables(out)

    return merge


def grow(leaves: DataFrame, order: list[Column], stash: Stash, per_block: int) -> Forest:
    """leaves (a written table: g, the name of the tree, may be null; h, binary; p, whatever goes with a leaf) -> nodes."""
    blocks = max(1, -(-leaves.count() // per_block))
    by = [F.col("g").asc_nulls_first(), *order]
    row = F.monotonically_increasing_id()  # partition and place in it
    placed = stash.put(leaves.repartitionByRange(blocks, *by).sortWithinPartitions(*by).select("g", "h", "p", row.alias("row"), F.shiftright(row, 33).alias("unit")))
    here = placed.groupBy("unit", "g").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    w = Window.partitionBy("g").orderBy("unit")  # a row for each block of a source
    begins = here.select("unit", "g", (F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("begin"), F.sum("n").over(Window.partitionBy("g")).alias("total"))
    schema = f"unit bigint, g string, total bigint, level int, place bigint, h binary, root boolean, peak boolean, made boolean, p {leaves.schema['p'].dataType.simpleString()}"
    empty = leaves.sparkSession.createDataFrame([], schema)
    arrow = empty.toArrow().schema
    nodes = stash.put(placed.groupBy("unit").cogroup(begins.groupBy("unit")).applyInArrow(_sown(arrow), schema))
    stash.drop(placed)
    rounds, units = [nodes], (nodes.agg(F.max("unit")).first()[0] or 0) + 1
    while units > 1:
        units = -(-units // MERGED)
        peaks = rounds[-1].filter("peak").withColumn("unit", F.floor(F.col("unit") / MERGED).cast("long"))
        rounds.append(stash.put(peaks.groupBy("unit").applyInArrow(_merged(arrow), schema)))
    return Forest(rounds, schema, stash)


UP = "unit bigint, g string, level int, place bigint, path array<string>, root string"


def _above(t: pa.Table) -> dict:
    out: dict = {}
    for g, lv, at, path, root in zip(*(t.column(c).to_pylist() for c in ("g", "level", "place", "path", "root")), strict=True):
        out.setdefault(g, {})[lv, at] = (tuple(path), root)
    return out


def _lowered(schema: pa.Schema):
    """Nodes of a merging task and the peaks that came to it, with the paths above -> paths of the peaks that came."""

    def lower(nodes: pa.Table, above: pa.Table) -> pa.Table:
        if not nodes.num_rows:
            return schema.empty_table()
        ups, cols = _above(above), {k: [] for k in schema.names}
        nodes = nodes.sort_by("g")
        for g, a, b in _slices(nodes):
            rows = list(zip(*(nodes.slice(a, b - a).column(c).to_pylist() for c in ("level", "place", "h", "below", "total")), strict=True))
            path = climber({(lv, at): h.hex() for lv, at, h, _, _ in rows}, ups.get(g, {}), rows[0][4])
            for lv, at, _, below, _ in rows:
                if below is not None:
                    steps, root = path(lv, at)
                    for c, v in zip(schema.names, (below, g, lv, at, list(steps), root), strict=True):
                        cols[c].append(v)
        return pa.Table.from_pydict(cols, schema=schema)

    return lower


def frames(forest: Forest, upper: DataFrame) -> DataFrame:
    """upper (g, path, root): what lies above each tree's root -> paths (UP) of what the blocks' leaves can't climb."""
    spark, stash = upper.sparkSession, forest.stash
    roots = forest.roots()
    named = upper.select(F.col("g").alias("_g"), "path", "root")
    tops = stash.put(roots.join(named, roots.g.eqNullSafe(named._g)).select("round", "unit", "g", "level", F.lit(0).cast("long").alias("place"), "path", "root"))
    arrow = spark.createDataFrame([], UP).toArrow().schema
    lower = spark.createDataFrame([], UP)
    for i in range(len(forest.rounds) - 1, -1, -1):
        lower = lower.unionByName(tops.filter(F.col("round") == i).drop("round"))
        if i:
            came = forest.rounds[i - 1].filter("peak").select(F.floor(F.col("unit") / MERGED).cast("long").alias("unit"), "g", "level", "place", "h", F.col("unit").alias("below"), "total")
            made = forest.rounds[i].select("unit", "g", "level", "place", "h", F.lit(None).cast("long").alias("below"), "total")
            lower = stash.put(came.unionByName(made).groupBy("unit").cogroup(lower.groupBy("unit")).applyInArrow(_lowered(arrow), UP))
    return lower


def _closed(finish: Callable, schema: pa.Schema):
    """Nodes of a block, with the paths above -> what finish makes of (p of a leaf, its digest, path, root)."""

    def close(nodes: pa.Table, above: pa.Table) -> pa.Table:
        if not nodes.num_rows:
            return schema.empty_table()
        ups, rows = _above(above), []
        nodes = nodes.sort_by("g")
        for g, a, b in _slices(nodes):
            some = nodes.slice(a, b - a)
            level, place, h = (some.column(c).to_pylist() for c in ("level", "place", "h"))
            path = climber({(lv, at): x.hex() for lv, at, x in zip(level, place, h, strict=True)}, ups.get(g, {}), some.column("total")[0].as_py())
            for lv, at, x, p in zip(level, place, h, some.column("p").to_pylist(), strict=True):
                if not lv:
                    rows.append(finish(p, x.hex(), *path(0, at, keep=False)))
        cols = list(zip(*rows, strict=True))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return close


def proofs(forest: Forest, upper: DataFrame, finish: Callable, out: str) -> DataFrame:
    """One row a leaf, made by finish(p, leaf, path, root) in the block of the leaf."""
    arrow = upper.sparkSession.createDataFrame([], out).toArrow().schema
    return forest.rounds[0].groupBy("unit").cogroup(frames(forest, upper).groupBy("unit")).applyInArrow(_closed(finish, arrow), out)


def of_roots(forest: Forest, per_block: int) -> tuple[DataFrame, Forest]:
    """The tree of the trees' roots: (g, path, root) for each of them, and its nodes."""
    stash = forest.stash
    leaves = stash.put(forest.roots().select(F.lit(None).cast("string").alias("g"), "h", F.struct(F.col("g").alias("name")).alias("p")))
    top = grow(leaves, [F.col("p.name").asc_nulls_first()], stash, per_block)
    end = top.roots().select("g", F.array().cast("array<string>").alias("path"), F.lower(F.hex("h")).alias("root"))
    return stash.put(proofs(top, end, lambda p, _, path, root: (p["name"], list(path), root), "g string, path array<string>, root string")), top


def field(c: Column) -> Column:
    s = c.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(docs_fields: dict[str, Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*(field(docs_fields[f]) for f in FIELDS)), 256))


def leaves(docs: DataFrame, stash: Stash) -> DataFrame:
    """Each row's leaf, and the leaf of its tampered copy: every second row, by crc32 of its id, without its line feeds."""
    cols = {f: F.col(f) for f in FIELDS}
    text = F.col("text").cast("string")
    changed = leaf({**cols, "text": F.replace(text, F.lit("\n"), F.lit(""))})
    hit = (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.contains(text, F.lit("\n"))
    p = F.struct("doc_id", F.when(hit, changed).alias("changed"))
    return stash.put(docs.select(F.col("source").cast("string").alias("g"), leaf(cols).alias("h"), p.alias("p"), F.monotonically_increasing_id().alias("tie")))


def manifest(docs: DataFrame, per_block: int = 100_000) -> tuple[Forest, Forest, DataFrame]:
    """The sources' trees, the tree of their roots, and (g, path, root) of each source."""
    stash = Stash(docs.sparkSession)
    forest = grow(leaves(docs, stash), [F.col("p.doc_id").asc_nulls_first(), F.col("h"), F.col("tie")], stash, per_block)
    upper, top = of_roots(forest, per_block)
    return forest, top, upper


def node_records(docs: DataFrame, per_block: int = 100_000) -> DataFrame:
    """The manifest: source, level, place, digest of every node of the sources' trees."""
    return manifest(docs, per_block)[0].nodes().withColumnRenamed("tree", "source")


def _audited(p: dict, own: str, path: tuple[str, ...], root: str):
    subject = p["changed"].hex() if p["changed"] is not None else own
    folded = fold(subject, path)
    return p["doc_id"], own, root, digest(s.replace("|", "") for s in path), folded, folded == root


def audit(docs: DataFrame, per_block: int = 100_000) -> DataFrame:
    """One row per row of docs: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified. Every leaf, tampered with
    or not, is folded with its original siblings; it is verified if that gives the root."""
    forest, _, upper = manifest(docs, per_block)
    kind = docs.schema["doc_id"].dataType.simpleString()
    roots = forest.roots().select(F.col("g").alias("_r"), F.lower(F.hex("h")).alias("subroot"))
    # the subroot rides on the path that lies above it, so that rows are not joined to their sources
    above = upper.join(roots, upper.g.eqNullSafe(roots._r)).select("g", F.concat(F.array(F.concat(F.lit("="), "subroot")), "path").alias("path"), "root")

    def finish(p, own, path, root):
        at = next(i for i, s in enumerate(path) if s[0] == "=")
        doc_id, own, root, proof, folded, good = _audited(p, own, path[:at] + path[at + 1 :], root)
        return doc_id, own, path[at][1:], root, proof, folded, good

    return proofs(forest, above, finish, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
