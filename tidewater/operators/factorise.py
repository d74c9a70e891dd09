"""Positive semidefiniteness of matrices of any size: a Cholesky factorisation over square tiles.

A matrix is a table of tiles (key, bi, bj, tile), lower half only, each some hundred rows and columns of doubles. A step takes
one column of tiles: its diagonal tile is factored wherever a tile below it is solved against the factor, and each solved tile
goes to the tiles that it changes, which subtract the product of the two that reach them. So a task holds three tiles, a step
is two shuffles of the rest of the matrix, and the driver counts the steps only.
"""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .risk import symmetry

SIDE = 512  # rows and columns of a tile: 2 MB


def _shared(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir; where that is unset, a local session gets one of its own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="tidewater-")
        spark.sparkContext.setCheckpointDir(at)
    return f"{at.rstrip('/')}/tidewater-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _pack(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a, dtype="<f8").tobytes()


def _unpack(b: bytes, rows: int, cols: int) -> np.ndarray:
    return np.frombuffer(b, dtype="<f8").reshape(rows, cols)


def _sided(n: int, block: int, side: int) -> int:
    """Rows of a block: the last one may be shorter."""
    return min(side, n - block * side)


def tiles(cov: DataFrame, key: str, side: int = SIDE) -> DataFrame:
    """The lower half of symmetric matrices (key, i, j, v) as (key, n, bi, bj, tile, scale): n assets, numbered in their order;
    scale is the largest magnitude on the diagonal, at least 1."""
    members = cov.groupBy(F.col(key).alias("_k"), F.col("i").alias("_a")).agg(F.max(F.when(F.col("i") == F.col("j"), F.abs("v"))).alias("_d"))
    w = Window.partitionBy("_k")  # a row for each asset of a matrix, not for each cell
    at = members.select("_k", "_a", (F.row_number().over(w.orderBy("_a")) - 1).alias("_at"), F.count("*").over(w).cast("int").alias("n"), F.greatest(F.lit(1.0), F.max("_d").over(w)).alias("scale"))
    row = at.select("_k", F.col("_a").alias("i"), F.col("_at").alias("_r"), "n", "scale")
    col = at.select("_k", F.col("_a").alias("j"), F.col("_at").alias("_c"))
    cells = cov.withColumn("_k", F.col(key)).select("_k", "i", "j", "v").join(row, ["_k", "i"]).join(col, ["_k", "j"]).filter("_r >= _c")
    placed = cells.select(F.col("_k").alias(key), "n", "scale", F.expr(f"cast(_r div {side} as int)").alias("bi"), F.expr(f"cast(_c div {side} as int)").alias("bj"), F.expr(f"cast(_r % {side} as int)").alias("r"), F.expr(f"cast(_c % {side} as int)").alias("c"), "v")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        n, bi, bj = int(first["n"]), int(first["bi"]), int(first["bj"])
        a = np.zeros((_sided(n, bi, side), _sided(n, bj, side)))
        r, c = pdf["r"].to_numpy(), pdf["c"].to_numpy()
        a[r, c] = pdf["v"].to_numpy()
        if bi == bj:
            a = np.tril(a) + np.tril(a, -1).T
        return pd.DataFrame({key: [first[key]], "n": [n], "bi": [bi], "bj": [bj], "tile": [_pack(a)], "scale": [float(first["scale"])]})

    return placed.groupBy(key, "bi", "bj").applyInPandas(build, f"`{key}` {cov.schema[key].dataType.simpleString()}, n int, bi int, bj int, tile binary, scale double")


def positive(cells: DataFrame, key: str, tolerance: float = 1e-12, side: int = SIDE) -> DataFrame:
    """Per matrix of tiles(): psd, whether matrix + tolerance * scale * identity has a Cholesky factor.

    A step ends with its rest written to the shared folder, and the rest before it is removed: what a step needs is one
    matrix on disk, and a lost executor costs one step. The answer is exact but for the rounding of doubles, which is some n
    times 1e-16 of the largest value."""
    spark, root = cells.sparkSession, _shared(cells.sparkSession)
    schema = f"`{key}` {cells.schema[key].dataType.simpleString()}, n int, bi int, bj int, tile binary, scale double, ok boolean, role string"
    names = [key, "n", "bi", "bj", "tile", "scale", "ok", "role"]

    def solver(k: int):
        def solve(pdf: pd.DataFrame) -> pd.DataFrame:
            """Diagonal tile k and, but for its own row, one tile below it."""
            d = pdf[pdf["role"] == "diagonal"].iloc[0]
            n, bi = int(d["n"]), int(d["bi"])
            m = _sided(n, k, side)
            try:
                factor = np.linalg.cholesky(_unpack(d["tile"], m, m) + tolerance * d["scale"] * np.eye(m))
            except np.linalg.LinAlgError:
                factor = None
            if bi == k:
                return pd.DataFrame([[d[key], n, k, k, None, d["scale"], factor is not None, "done"]], columns=names)
            if factor is None:
                return pd.DataFrame([], columns=names)
            below = _unpack(pdf[pdf["role"] == "rest"].iloc[0]["tile"], _sided(n, bi, side), m)
            return pd.DataFrame([[d[key], n, bi, k, _pack(np.linalg.solve(factor, below.T).T), d["scale"], None, "panel"]], columns=names)

        return solve

    def update(pdf: pd.DataFrame) -> pd.DataFrame:
        """A tile of the rest less the product of the panel tiles of its row and its column; none if the step failed."""
        roles = {r["role"]: r for _, r in pdf.iterrows()}
        if "done" in roles:
            return pd.DataFrame([list(roles["done"][names])], columns=names)
        if "rest" not in roles or "row" not in roles or "column" not in roles:
            return pd.DataFrame([], columns=names)
        t = roles["rest"]
        rows, cols = _sided(int(t["n"]), int(t["bi"]), side), _sided(int(t["n"]), int(t["bj"]), side)
        left, right = np.frombuffer(roles["row"]["tile"], dtype="<f8").reshape(rows, -1), np.frombuffer(roles["column"]["tile"], dtype="<f8").reshape(cols, -1)
        return pd.DataFrame([[t[key], t["n"], t["bi"], t["bj"], _pack(_unpack(t["tile"], rows, cols) - left @ right.T), t["scale"], None, "rest"]], columns=names)

    def written(df: DataFrame, step: int) -> DataFrame:
        df.write.parquet(f"{root}/{step}")
        return spark.read.schema(df.schema).parquet(f"{root}/{step}")

    state = written(cells.select(key, "n", "bi", "bj", "tile", "scale", F.lit(None).cast("boolean").alias("ok"), F.lit("rest").alias("role")), 0)
    blocks = state.agg(F.max("bi")).first()[0]
    last = F.expr(f"cast((n - 1) div {side} as int)")
    for k in range(0 if blocks is None else blocks + 1):
        rest = state.filter("role = 'rest'")
        diagonal = rest.filter((F.col("bi") == k) & (F.col("bj") == k)).withColumn("role", F.lit("diagonal")).withColumn("bi", F.explode(F.sequence(F.lit(k), last)))
        column = rest.filter((F.col("bj") == k) & (F.col("bi") > k))
        panel = diagonal.unionByName(column).groupBy(key, "bi").applyInPandas(solver(k), schema)
        own = F.array(F.struct(F.col("bi"), F.col("bj"), F.col("role")))
        to_rows = F.transform(F.sequence(F.lit(k + 1), F.greatest(F.col("bi"), F.lit(k + 1))), lambda j: F.struct(F.col("bi"), j.alias("bj"), F.lit("row").alias("role")))
        to_columns = F.transform(F.sequence(F.col("bi"), F.greatest(last, F.col("bi"))), lambda i: F.struct(i.alias("bi"), F.col("bi").alias("bj"), F.lit("column").alias("role")))
        sent = panel.withColumn("_to", F.explode(F.when(F.col("role") == "done", own).otherwise(F.concat(to_rows, to_columns))))
        sent = sent.select(key, "n", "_to.bi", "_to.bj", "tile", "scale", "ok", "_to.role")
        now = rest.filter(F.col("bj") > k).unionByName(sent).groupBy(key, "bi", "bj").applyInPandas(update, schema)
        state = written(now.unionByName(state.filter("role = 'done'")), k + 1)
        _delete(spark, f"{root}/{k}")
    return state.filter("role = 'done'").groupBy(key).agg(F.min("ok").alias("psd"))


def psd_by_tiles(cov: DataFrame, key: str, tolerance: float = 1e-12, side: int = SIDE) -> DataFrame:
    """risk.psd_check() without its limit on assets and without the eigenvalue: per matrix (key, i, j, v) n_assets, symmetric,
    psd. It is positive semidefinite if its smallest eigenvalue is at least -tolerance * max(1, largest of the diagonal).

    Matrices that lack cells, repeat them, or aren't symmetric within the tolerance (values null or not finite included) are
    neither, and aren't factored. Keys may not be null; an empty table gives no rows."""
    known = symmetry(cov, key, tolerance)
    good = known.filter("symmetric").select(F.col(key).alias("_good"))
    whole = cov.join(good, F.col(key) == F.col("_good")).drop("_good")
    ok = positive(tiles(whole, key, side), key, tolerance, side).select(F.col(key).alias("_key"), "psd")
    return known.join(ok, F.col(key) == F.col("_key"), "left").select(key, "n_assets", "symmetric", F.coalesce("psd", F.lit(False)).alias("psd"))
