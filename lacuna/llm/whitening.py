"""Whitening of embeddings with MLlib's BlockMatrix.

Entries become whole numbers, x = floor(64 * c) + 1000000. Count, sums and bounds of each dimension are exact aggregations. A row, centred as
(n * x - sum) / n from whole numbers, gets an index and goes into a distributed ``BlockMatrix``; the product of its transpose with itself is the scatter, whose
inner dimension is cut into as many parts as there are row blocks to add up in parallel. The scatter (dimension x dimension) is decomposed
on the driver by ``eigh``; the block matrix times the whitening matrix, eigenvectors over the roots of their eigenvalues, projects the
rows. The whitened rows are centred and multiplied in the same way to measure how far their covariance is from the identity.

Sums and matrices of the dimension's size reach the driver, for dimensions of up to ``WIDEST``; of blocks only their coordinates do (MLlib plans
a product there), one for up to 2**20 entries.

Defined cases: a row whose vector is null, or holds a null, a NaN, an infinite number or one beyond +-2**52, is left out; so is one that is shorter than
the longest vector (its last entries are missing); repeated rows count as often as they occur, and a null id is one like others; directions
without variance (an eigenvalue below 1e-12 of the largest) are no components, so a table of equal vectors, of one row or of none gives no rows; a
deviation beyond 64 bits is null; other columns are neither read nor returned.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settled

SCALE, SHIFT = 64, 1_000_000
MOST_COMPONENTS = 32
#: Rows of a block at least, its columns, and its entries at most; parts of a product over rows.
LEAST_ROWS, BLOCK_COLUMNS, BLOCK_ENTRIES, MOST_PARTS = 256, 1024, 1 << 20, 65_536
WIDEST = 8192
FARTHEST = 1 << 52
FLAT = 1e-12


def whole(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, x (whole numbers), index (0, 1, ...) as a table."""
    rows = vectors.select(F.col(id).alias("id"), F.col(vector).alias("v")).where("size(v) > 0")
    long = rows.agg(F.max(F.size("v"))).first()[0] or 0
    if long > WIDEST:
        raise ValueError(f"vectors of {long} entries; at most {WIDEST} can be decomposed")
    good = F.forall("v", lambda c: F.coalesce(F.abs(c.cast("double")) <= FARTHEST, F.lit(False)))  # NaN is above all numbers
    x = F.transform("v", lambda c: F.floor(c.cast("double") * SCALE) + SHIFT)
    return indexed(rows.where((F.size("v") == long) & good).select("id", x.alias("x")))


def indexed(rows: DataFrame) -> DataFrame:
    """``rows`` as a table with ``index``, 0, 1, ... without gaps. Only a count for each task meets in one place."""
    rows = settled(rows.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    return settled(rows.withColumn("_part", part).join(starts, "_part").withColumn("index", F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_part", "_start"))


def blocks(rows: DataFrame, vector: Column, n: int, width: int) -> BlockMatrix:
    """The n rows (index, an array of doubles) as a distributed matrix of blocks of up to ``BLOCK_ENTRIES`` entries."""
    tasks = 4 * rows.sparkSession.sparkContext.defaultParallelism
    high = max(1, min(max(LEAST_ROWS, -(-n // tasks)), BLOCK_ENTRIES // min(width, BLOCK_COLUMNS)))
    named = rows.select("index", array_to_vector(vector).alias("vector"))
    return IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(named, "vector"), n, width).toBlockMatrix(high, BLOCK_COLUMNS)


def product(a: BlockMatrix, b: BlockMatrix, parts: int = 1) -> BlockMatrix:
    """a times b with the inner dimension cut into ``parts`` that are multiplied apart and added up."""
    made = a._java_matrix_wrapper.call("multiply", b._java_matrix_wrapper._java_model, parts)
    return BlockMatrix(made, a.rowsPerBlock, b.colsPerBlock)


def scatter(centred: BlockMatrix) -> np.ndarray:
    """Transpose times itself, as a local matrix."""
    found = product(centred.transpose(), centred, min(centred.numRowBlocks, MOST_PARTS)).toLocalMatrix().toArray()
    return (found + found.T) / 2


def local_blocks(spark, matrix: np.ndarray) -> BlockMatrix:
    """A small matrix as a BlockMatrix of row blocks."""
    cut = [(k, matrix[k * BLOCK_COLUMNS : (k + 1) * BLOCK_COLUMNS]) for k in range(-(-len(matrix) // BLOCK_COLUMNS))]
    made = spark.sparkContext.parallelize([((k, 0), Matrices.dense(*m.shape, m.ravel(order="F"))) for k, m in cut], 1)
    return BlockMatrix(made, BLOCK_COLUMNS, matrix.shape[1])


def statistics(rows: DataFrame) -> tuple[int, list[int], int, int]:
    """Count, sums of the dimensions, the largest |x|, and the largest distance between n * x and the sum."""
    each = rows.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.count("*").alias("n"), F.sum(F.col("v").cast("decimal(20,0)")).alias("s"), F.min("v").alias("low"), F.max("v").alias("high"))
    found = sorted(each.collect())  # a row for each dimension
    if not found:
        return 0, [], 0, 0
    n, sums = found[0]["n"], [int(r["s"]) for r in found]
    far = max(max(n * r["high"] - s, s - n * r["low"]) for r, s in zip(found, sums, strict=True))
    return n, sums, max(max(abs(r["low"]), abs(r["high"])) for r in found), far


def offsets(n: int, sums: list[int], reach: int) -> Column:
    """n * x - sum of each dimension in whole numbers, as decimals where 64 bits may not do."""
    if n * reach < 1 << 62:
        return F.zip_with("x", F.lit(sums), lambda x, s: x * n - s)
    sums_ = F.array(*[F.lit(str(s)).cast("decimal(38,0)") for s in sums])
    return F.zip_with("x", sums_, lambda x, s: (x.cast("decimal(19,0)") * F.lit(str(n)).cast("decimal(18,0)") - s).cast("decimal(38,0)"))


def deviation(n: int, sums: list[int], reach: int, far: int) -> Column:
    """Sum of (n * x - sum)**2."""
    most = len(sums) * far * far
    if most < 1 << 63 and n * reach < 1 << 62:
        return F.aggregate(offsets(n, sums, reach), F.lit(0).cast("long"), lambda a, d: a + d * d)
    if most >= 10**38:
        raise ValueError("deviations of more than 38 digits")
    square = lambda d: d.cast("decimal(19,0)") * d.cast("decimal(19,0)")
    total = F.aggregate(offsets(n, sums, reach), F.lit(0).cast("decimal(38,0)"), lambda a, d: (a + square(d)).cast("decimal(38,0)"))
    return total.try_cast("long")


def whitened(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", most: int = MOST_COMPONENTS) -> tuple[DataFrame, dict]:
    """A row for each vector: id, deviation, w (its whitened components); and n, sums, values (eigenvalues), vectors, explained, identity_error."""
    rows = whole(vectors, id, vector)
    n, sums, reach, far = statistics(rows)
    if far == 0:
        none = rows.where("false").select("id", F.lit(0).cast("long").alias("deviation"), F.array().cast("array<double>").alias("w"))
        return none, {"n": n, "sums": sums, "values": [], "vectors": None, "explained": [], "identity_error": 0.0}
    centred = blocks(rows, F.transform(offsets(n, sums, reach), lambda d: d.cast("double") / n), n, len(sums))
    covariance = scatter(centred) / n
    values, directions = np.linalg.eigh(covariance)
    kept = [k for k in np.argsort(values)[::-1] if values[k] > FLAT * values.max()][:most]
    values, directions = values[kept], directions[:, kept]
    projected = product(centred, local_blocks(rows.sparkSession, directions / np.sqrt(values)))
    java = projected.toIndexedRowMatrix()._java_matrix_wrapper._java_model
    found = MLUtils.convertVectorColumnsToML(callMLlibFunc("getIndexedRows", java), "vector")
    found = settled(found.select("index", vector_to_array("vector").alias("w")))
    means = found.agg(F.array(*[F.avg(F.get("w", F.lit(k))) for k in range(len(kept))])).first()[0]
    again = scatter(blocks(found, F.zip_with("w", F.lit(means), lambda a, m: a - m), n, len(kept))) / n
    fit = {"n": n, "sums": sums, "values": values.tolist(), "vectors": directions, "explained": (values / np.trace(covariance)).tolist(), "identity_error": float(np.abs(again - np.eye(len(kept))).max())}
    return rows.select("id", "index", deviation(n, sums, reach, far).alias("deviation")).join(found, "index").drop("index"), fit


def whiten(vectors: DataFrame) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component."""
    rows, fit = whitened(vectors)
    shares = F.lit(fit["explained"]) if fit["explained"] else F.array().cast("array<double>")
    each = rows.select(F.col("id").alias("vec_id"), "deviation", F.posexplode(F.arrays_zip(F.col("w").alias("w"), shares.alias("e"))).alias("k", "c"))
    return each.select("vec_id", (F.col("k") + 1).alias("component"), F.lit(fit["n"]).cast("long").alias("n"), "deviation", F.col("c.w").alias("whitened"), F.col("c.e").alias("explained"), F.lit(fit["identity_error"]).alias("identity_error"))
