"""Sinks: images, raw planes, text reports, word lines, tables.

Pictures are assembled in two steps, pixels to rows and rows to pictures, so a task holds at most one
picture row of pixels or one picture of row strings.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediaframe.functions.bits import int_div, u32_hex
from mediaframe.operators.trace import CAPACITY


def _byte(c: Column) -> Column:
    return F.lpad(F.hex(c.cast("bigint")), 2, "0")


def _joined(df: DataFrame, by: Sequence[str], order: Sequence[str], piece: Column, out: str) -> DataFrame:
    """Concatenate hex pieces in order per group."""
    g = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, piece.alias("__h")))).alias("__a"))
    return g.select(*by, F.array_join(F.col("__a.__h"), "").alias(out))


def ppm_images(rgb: DataFrame, picture: Sequence[str] = ("frame",)) -> DataFrame:
    """One binary P6 image per picture from (picture, y, x, r, g, b)."""
    rows = _joined(rgb, [*picture, "y"], ["x"], F.concat(_byte(F.col("r")), _byte(F.col("g")), _byte(F.col("b"))), "h")
    g = rows.groupBy(*picture).agg(
        F.array_sort(F.collect_list(F.struct("y", "h"))).alias("a"), F.count("*").alias("height"), (F.max(F.length("h")) / 6).cast("bigint").alias("width")
    )
    head = F.hex(F.encode(F.format_string("P6\n%d %d\n255\n", "width", "height"), "UTF-8"))
    return g.select(*picture, F.unhex(F.concat(head, F.array_join(F.col("a.h"), ""))).alias("image"))


def picture_files(pictures: DataFrame, content: str, suffix: str, picture: Sequence[str] = ("frame",)) -> DataFrame:
    """path, content for ``files.write_files``: one file per picture, named by its key."""
    name = F.concat_ws("/", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in picture])
    return pictures.select(F.concat(name, F.lit(suffix)).alias("path"), F.col(content).alias("content"))


def raw_planes(px: DataFrame, picture: Sequence[str] = ("frame",)) -> DataFrame:
    """Planes one after the other, rows without padding, from (picture, plane, y, x, v)."""
    rows = _joined(px, [*picture, "plane", "y"], ["x"], _byte(F.col("v")), "h")
    whole = _joined(rows, list(picture), ["plane", "y"], F.col("h"), "h")
    return whole.select(*picture, F.unhex("h").alias("data"))


def word_lines(words: DataFrame, keys: Sequence[str] = ("stream_id",), per_line: int = CAPACITY) -> DataFrame:
    """Comma lists of 0x-prefixed words; a stream longer than a buffer continues on the next line."""
    tok = F.concat(F.lit("0x"), u32_hex(F.col("w")))
    seg = words.select(*keys, int_div(F.col("dw"), per_line).alias("line_no"), "dw", tok.alias("t"))
    g = seg.groupBy(*keys, "line_no").agg(F.array_sort(F.collect_list(F.struct("dw", "t"))).alias("a"))
    return g.select(*keys, "line_no", F.array_join(F.col("a.t"), ",").alias("line"))


def frame_report_text(report: DataFrame) -> DataFrame:
    """The per-frame report as text lines."""
    line = F.format_string(
        "  frame %2d: luma %d/%d (max %d) chroma %d/%d (max %d)  %.3f%% mismatch%s",
        "frame", "luma_bad", "luma_total", "luma_max", "chroma_bad", "chroma_total", "chroma_max", "pct",
        F.when(F.col("significant"), "  <-- SIGNIFICANT").otherwise(""),
    )
    return report.select("frame", line.alias("line"))


def write_text_report(lines: DataFrame, path: str, order: Sequence[str]) -> None:
    """Text files in order: range-partitioned, each part sorted."""
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.text(path)


def write_table(df: DataFrame, path: str, schema: T.StructType, partition_by: Sequence[str] = ()) -> None:
    """Parquet with a declared schema: columns are cast, reordered and completed with NULL."""
    have = set(df.columns)
    cols = [(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]
    df.select(*cols).write.partitionBy(*partition_by).parquet(path)


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Parquet read with the declared schema; columns added later read as NULL from older files."""
    return spark.read.schema(schema).parquet(path)


def write_bucketed_pixels(px: DataFrame, name: str, buckets: int) -> None:
    """A pixel version as a table bucketed on its key, so later version diffs join without a shuffle."""
    px.write.bucketBy(buckets, "frame", "plane", "y", "x").sortBy("frame", "plane", "y", "x").saveAsTable(name)
