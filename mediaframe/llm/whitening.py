"""Whitening of embeddings with distributed block matrices.

Entries become integers x = floor(64 c) + 1000000, so counts and sums are exact. The rows, centred on the column means, are numbered
and form an indexed row matrix, which is cut into blocks. The scatter matrix is the product of the block matrix's transpose and itself, its middle
dimension split over many tasks; its eigenvectors are found on the driver (columns squared entries, whatever the number of rows), and a second product of
block matrices projects all rows on the whitening matrix. A third one, of the projected rows with themselves, measures how far their covariance is from
the identity.

A mean S / n is kept as whole part and remainder, so a centred entry is one exact difference of integers less a fraction below one: nothing cancels.

Defined cases: rows whose vector is null, empty, or holds a null or non-finite entry are dropped, and so are entries' rows too large for an
exact x (2^52 and beyond); if vectors differ in length, the most frequent length (the smaller of equals) is the table's and rows of another length are dropped. Components whose
eigenvalue is zero within rounding are not returned, so a table of equal rows, of one row or of none gives no rows. Repeated rows each count and are each returned. A
deviation that no 64-bit integer holds is null. The sign of a component makes its largest coefficient positive. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mediaframe.llm.common import column, stored

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
EXACT = 2.0**52
BLOCK_ENTRIES = 1 << 19
BLOCK_COLUMNS = 1024
SPLITS = 1000
#: monotonically_increasing_id: task number above, row of the task in the lower bits
TASK_BITS = 33


def numbered(rows: DataFrame) -> DataFrame:
    """rows with ``row``: 0, 1, 2 ... over all tasks, from one count a task."""
    kept = stored(rows.withColumn("__id", F.monotonically_increasing_id()), "vectors")
    task = F.shiftright("__id", TASK_BITS)
    counts = kept.groupBy(task.alias("__task")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1))  # a row per task of the scan
    first = counts.select("__task", F.coalesce(before, F.lit(0)).alias("__first"))
    in_task = F.col("__id").bitwiseAND(F.lit((1 << TASK_BITS) - 1))
    return kept.withColumn("__task", task).join(first, "__task").select(*rows.columns, (F.col("__first") + in_task).alias("row"))


def integer_rows(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, x (array of long) of the rows that take part."""
    v = column(vector)
    usable = F.coalesce(F.size(v) > 0, F.lit(False)) & F.forall(v, lambda c: F.coalesce(F.abs(c.cast("double") * SCALE) < EXACT, F.lit(False)))
    x = F.transform(v, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT)
    return vectors.where(usable).select(column(vec_id).alias("vec_id"), x.alias("x"))


def sums(rows: DataFrame) -> list[int]:
    """Exact sum of each entry of x."""
    entries = rows.select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.sum(F.col("x").cast("decimal(20,0)")).alias("s"))
    return [int(r["s"]) for r in sorted(entries.collect(), key=lambda r: r["i"])]  # a row per column


def centred(x: Column, n: int, s: list[int]) -> Column:
    """x - S / n as doubles."""
    whole, part = F.array(*[F.lit(t // n) for t in s]), F.array(*[F.lit(t % n / n) for t in s])
    return F.transform(F.arrays_zip(x.alias("x"), whole.alias("w"), part.alias("p")), lambda e: (e["x"] - e["w"]).cast("double") - e["p"])


def deviation(x: Column, n: int, s: list[int]) -> Column:
    """Sum over the entries of (n x - S)^2 as long; null where that is too large."""
    pairs = F.arrays_zip(x.alias("x"), F.array(*[F.lit(t // n) for t in s]).alias("w"), F.array(*[F.lit(t % n) for t in s]).alias("r"))

    def add(total, e):
        off = F.try_subtract(F.try_multiply((e["x"] - e["w"]).cast("decimal(38,0)"), F.lit(n).cast("decimal(38,0)")), e["r"].cast("decimal(38,0)"))
        return F.try_add(total, F.try_multiply(off, off)).cast("decimal(38,0)")

    return F.aggregate(pairs, F.lit(0).cast("decimal(38,0)"), add).try_cast("long")


def times(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    """left x right with the middle dimension split over ``splits`` tasks; Python's own multiply leaves it whole, in one task for a small product."""
    java = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(java, left.rowsPerBlock, right.colsPerBlock)


def covariance(m: BlockMatrix, n: int) -> np.ndarray:
    c = times(m.transpose(), m, min(m.numRowBlocks, SPLITS)).toLocalMatrix().toArray() / n
    return (c + c.T) / 2


def components(v: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a covariance matrix, up to ``most`` above rounding."""
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    k = min(most, int((e > len(e) * np.finfo(float).eps * max(e[0], 0.0)).sum()))
    u = u[:, :k]
    return e[:k], u * np.where(u[np.abs(u).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)


def local_blocks(spark, w: np.ndarray) -> BlockMatrix:
    """A small matrix as row blocks of BLOCK_COLUMNS rows, to multiply from the right."""
    d, k = w.shape
    cut = [((i // BLOCK_COLUMNS, 0), w[i : i + BLOCK_COLUMNS]) for i in range(0, d, BLOCK_COLUMNS)]
    dense = [(at, Matrices.dense(b.shape[0], k, b.ravel(order="F"))) for at, b in cut]
    return BlockMatrix(spark.sparkContext.parallelize(dense, len(dense)), BLOCK_COLUMNS, k, d, k)


def whiten(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """A row per vector: vec_id, n, deviation, whitened, explained (arrays, a number per component), identity_error."""
    spark = vectors.sparkSession
    id_type = vectors.schema[vec_id].dataType.simpleString()
    empty = spark.createDataFrame([], f"vec_id {id_type}, n long, deviation long, whitened array<double>, explained array<double>, identity_error double")
    rows = integer_rows(vectors, vec_id, vector)
    length = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if length is None:
        return empty
    d, n = length
    rows = numbered(rows.where(F.size("x") == d))
    s = sums(rows)

    vectored = rows.select(F.col("row").alias("index"), array_to_vector(centred(F.col("x"), n, s)).alias("vector"))
    matrix = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(vectored, "vector"), n, d)
    matrix = matrix.toBlockMatrix(max(BLOCK_ENTRIES // min(d, BLOCK_COLUMNS), 1), BLOCK_COLUMNS)
    v = covariance(matrix, n)
    e, u = components(v, most)
    if not len(e):
        return empty

    projected = times(matrix, local_blocks(spark, u / np.sqrt(e)), 1)
    error = float(np.abs(covariance(projected, n) - np.eye(len(e))).max())
    lines = projected.toIndexedRowMatrix().rows.map(lambda r: (int(r.index), r.vector.toArray().tolist()))
    lines = spark.createDataFrame(lines, "row long, whitened array<double>")
    explained = F.array(*[F.lit(float(x)) for x in e / np.trace(v)])
    exact = rows.select("vec_id", "row", deviation(F.col("x"), n, s).alias("deviation"))
    return exact.join(lines, "row").select(
        "vec_id", F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error")
    )


def report(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """Per vector and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error."""
    w = whiten(vectors, vec_id, vector, most)
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c")
    opened = w.select("vec_id", "n", "deviation", "identity_error", each)
    return opened.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error"
    )
