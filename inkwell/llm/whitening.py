"""Embedding whitening with MLlib's block matrices.

Vectors become whole numbers (floor of `scale` times each entry), so sums are exact and equal vectors are equal. The
distinct vectors are the fit list. Its rows, centred, are indexed into a BlockMatrix of BLOCK_ROWS rows a block; the
transposed matrix times the matrix is the scatter, of dimension d x d, whose eigenvectors are found on the driver (d is
the length of one vector, however many rows there are). A second BlockMatrix of all rows is multiplied by the d x k
whitening matrix, which projects them.

All of it stays in the JVM. The product that gives the scatter has one block for its result, so the middle dimension is
dealt over as many partitions as a shuffle has; else one task would multiply all blocks. MLlib lays the projected blocks
out on a grid, about the square root of the number of partitions for a matrix this tall; each block of a partition is
multiplied by itself.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import staged

BLOCK_ROWS, BLOCK_COLUMNS = 1024, 1024
#: An eigenvalue below this share of the trace is rounding: its component has no spread to divide by.
LEAST_SHARE = 1e-12


def whole_numbers(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale))))


def finite(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))


def indexed(rows: DataFrame, label: str) -> DataFrame:
    """rows with `row`, numbered from 0 without gaps. Rows are written with their places in their task first; the tasks'
    sizes, one row a task, are summed up behind them."""
    placed = staged(rows.withColumn("part_", F.spark_partition_id()).withColumn("place_", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), label)
    sizes = placed.groupBy("part_").agg(F.count(F.lit(1)).alias("size_"))
    before = F.coalesce(F.sum("size_").over(Window.partitionBy(F.lit(0)).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("part_", before.alias("before_"))
    return placed.join(F.broadcast(offsets), "part_").withColumn("row", F.col("before_") + F.col("place_")).drop("part_", "place_", "before_")


def block_matrix(rows: DataFrame, vector: Column, n_rows: int, n_columns: int, block_rows: int) -> BlockMatrix:
    """The rows (row, and a vector of doubles) of a matrix, in blocks."""
    frame = MLUtils.convertVectorColumnsFromML(rows.select("row", array_to_vector(vector).alias("vector")), "vector")
    return IndexedRowMatrix(frame, n_rows, n_columns).toBlockMatrix(block_rows, BLOCK_COLUMNS)


def scatter(matrix: BlockMatrix, parts: int) -> np.ndarray:
    """transpose(matrix) * matrix, with the middle dimension dealt over `parts` tasks."""
    turned = matrix.transpose()
    product = turned._java_matrix_wrapper.call("multiply", matrix._java_matrix_wrapper._java_model, parts)
    return BlockMatrix(product, BLOCK_COLUMNS, BLOCK_COLUMNS).toLocalMatrix().toArray()


def projected(matrix: BlockMatrix, onto: BlockMatrix) -> DataFrame:
    """row, projection (array of doubles) of matrix * onto."""
    product = matrix.multiply(onto).toIndexedRowMatrix()  # a name, or its Java object is let go before the call
    rows = callMLlibFunc("getIndexedRows", product._java_matrix_wrapper._java_model)
    return MLUtils.convertVectorColumnsToML(rows, "vector").select(F.col("index").alias("row"), vector_to_array("vector").alias("projection"))


def whiten(embeddings: DataFrame, k: int = 4, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows and components up to k: vec_id, component, n, deviation, whitened, explained, identity_error.

    n is the number of distinct vectors; deviation the exact sum of squares of n * x - (sum of the distinct x); whitened
    the centred row's projection on the component over the root of its eigenvalue; explained the eigenvalue over the
    trace; identity_error the largest absolute entry of whitened's covariance over the distinct vectors, less the
    identity.

    Defined results: rows are left out whose vector is null or holds null or non-finite entries, and those whose length
    is not the most frequent one of the others (of two, the longer). Repeated rows and null ids stay, each with its
    result; vectors of fewer than k entries have as many components; where a component has no spread (fewer distinct
    vectors than dimensions, constant entries), whitened is null and identity_error leaves it out (0 where none has
    any). deviation is null where it doesn't fit a long. An empty table gives an empty result; other columns are ignored.
    """
    spark = embeddings.sparkSession
    valid = embeddings.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector")).where(finite(F.col("vector")))
    length = valid.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = length["d"] if length else 0
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not d:
        return spark.createDataFrame([], schema)
    rows = indexed(valid.where(F.size("vector") == d).select("vec_id", whole_numbers(F.col("vector"), scale).alias("x")), "vectors")
    fit = indexed(rows.select("x").distinct(), "fit-list")
    n, n_rows = fit.count(), length["count"]
    of_dimension = fit.select(F.posexplode("x").alias("dimension", "c")).groupBy("dimension").agg(F.sum(F.col("c").cast("decimal(20,0)")).alias("s"), F.min("c").alias("low"), F.max("c").alias("high"))
    found = {r["dimension"]: (int(r["s"]), max(-r["low"], r["high"])) for r in of_dimension.toLocalIterator()}  # d rows
    sums, most = [found[i][0] for i in range(d)], max(n * m + abs(s) for s, m in found.values())
    mean = F.array(*[F.lit(s / n) for s in sums])
    centred = F.zip_with("x", mean, lambda a, b: a.cast("double") - b)
    parts = max(1, min(-(-n // BLOCK_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    fit_matrix = block_matrix(fit, centred, n, d, BLOCK_ROWS)
    values, vectors = np.linalg.eigh(scatter(fit_matrix, parts) / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    trace, spread = float(values.sum()), [i for i in range(min(k, d)) if values[i] > LEAST_SHARE * values.sum()]
    # exact either way; long arithmetic where no sum of squares can leave it
    kind = "long" if d * most * most < 1 << 63 else "decimal(38,0)"
    squares = F.aggregate(F.zip_with("x", F.array(*[F.lit(str(s)).cast(kind) for s in sums]), lambda a, b: (a.cast(kind) * F.lit(n) - b).cast(kind)), F.lit(0).cast(kind), lambda acc, v: F.try_add(acc, F.try_multiply(v, v)).cast(kind))
    rows = rows.withColumn("squares_", squares).selectExpr("row", "vec_id", "x", "try_cast(squares_ as long) as deviation")
    error = 0.0
    if spread:
        whitening = vectors[:, spread] / np.sqrt(values[spread])
        onto = block_matrix(spark.createDataFrame([(i, [float(v) for v in whitening[i]]) for i in range(d)], "row long, weights array<double>"), F.col("weights"), d, len(spread), BLOCK_COLUMNS)
        of_fit = projected(fit_matrix, onto)
        p = [F.element_at("projection", i + 1) for i in range(len(spread))]
        pairs = [(i, j) for i in range(len(spread)) for j in range(i, len(spread))]
        moments = of_fit.agg(*[F.avg(p[i]).alias(f"m{i}") for i in range(len(spread))], *[F.avg(p[i] * p[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
        error = max(abs(moments[f"c{i}_{j}"] - moments[f"m{i}"] * moments[f"m{j}"] - (i == j)) for i, j in pairs)
        rows = rows.join(projected(block_matrix(rows, centred, n_rows, d, BLOCK_ROWS), onto), "row")
    else:
        rows = rows.withColumn("projection", F.array().cast("array<double>"))
    place = {c: i + 1 for i, c in enumerate(spread)}
    columns = [F.struct(F.lit(c + 1).alias("component"), (F.element_at("projection", place[c]) if c in place else F.lit(None).cast("double")).alias("whitened"), F.lit(max(float(values[c]), 0.0) / trace if trace > 0 else 0.0).alias("explained")) for c in range(min(k, d))]
    out = rows.select("vec_id", "deviation", F.explode(F.array(*columns)).alias("c"))
    return out.select(F.col("vec_id").cast("long").alias("vec_id"), "c.component", F.lit(n).cast("long").alias("n"), "deviation", "c.whitened", "c.explained", F.lit(float(error)).alias("identity_error"))
