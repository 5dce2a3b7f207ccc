"""Container tables: sizes, chunks, runs, samples, summaries.

Range and as-of lookups are done on the union of both sides in key order, cut into blocks, so a file
with a third of all samples is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaframe.functions.bits import be_uint
from mediaframe.functions.lineage import cut_lineage
from mediaframe.functions.ordered import by_width, first_k, last_at, numbered, running_sum
from mediaframe.functions.skew import spread_join

FILE = ["file_id"]


def box_rollup(boxes: DataFrame) -> DataFrame:
    """Count and bytes per type, parent type and file, with subtotals."""
    base = boxes.groupBy("path", "parent_type", "type").agg(F.count("*").alias("c"), F.sum("size").alias("s"))
    base = base.withColumn("parent_type", F.coalesce("parent_type", F.lit("")))
    return base.rollup("path", "parent_type", "type").agg(
        F.sum("c").alias("n"), F.sum("s").alias("bytes"), F.grouping_id().alias("level")
    )


def sps_summary(sps: Column) -> list[Column]:
    """Profile and level from the parameter set; NULL if it is too short."""
    ok = F.octet_length(sps) >= 4
    return [F.when(ok, be_uint(sps, 1, 1)).alias("profile_idc"), F.when(ok, be_uint(sps, 3, 1)).alias("level_idc")]


def sample_sizes(tracks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per sample from either form of the size table."""
    const = tracks.where(F.col("const_size") != 0).select(*keys, F.col("sample_count").cast("bigint").alias("sample_count"), F.col("const_size").alias("size"))
    const = numbered(const, "sample_count", "sample_idx").select(*keys, "sample_idx", "size")
    listed = tracks.where(F.col("const_size") == 0).select(*keys, F.posexplode("sizes").alias("sample_idx", "size"))
    return const.unionByName(listed.withColumn("sample_idx", F.col("sample_idx").cast("bigint")))


def chunk_table(narrow: DataFrame, wide: DataFrame, keys: Sequence[str] = FILE) -> DataFrame:
    """Chunk offsets from 32-bit and 64-bit tables; per file the later table (larger box_off) replaces the other."""
    both = narrow.unionByName(wide)
    keep = both.groupBy(*keys).agg(F.max("box_off").alias("box_off"))
    return spread_join(both, keep, [*keys, "box_off"], "chunk_no", "left_semi").select(*keys, "chunk_no", "chunk_off")


def run_rows(tracks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Run-length table as rows, numbered in table order."""
    zipped = F.arrays_zip("first_chunk", "samples_per_chunk")
    r = tracks.select(*keys, F.posexplode(zipped).alias("run_no", "r"))
    return r.select(*keys, "run_no", F.col("r.first_chunk").alias("first_chunk"), F.col("r.samples_per_chunk").alias("spc"))


def samples_per_chunk(chunks: DataFrame, runs: DataFrame, keys: Sequence[str] = FILE) -> DataFrame:
    """Add spc to every chunk: the run it lies in, or the last run of the table (by run_no, else by first_chunk) when it precedes them all."""
    keys = list(keys)
    none = lambda n: F.lit(None).cast("bigint").alias(n)
    at = lambda c, side: (F.col(c) * 2 + side).cast("bigint").alias("at")  # noqa: E731  (a run sorts before the chunk it starts at)
    r = runs.select(*keys, at("first_chunk", 0), none("chunk_no"), none("chunk_off"), "spc")
    # the last run also stands before chunk 1, which gives early chunks their value without a join on the file
    last = runs.groupBy(*keys).agg(F.max_by("spc", "run_no" if "run_no" in runs.columns else "first_chunk").alias("spc"))
    r = r.unionByName(last.select(*keys, F.lit(-1).cast("bigint").alias("at"), none("chunk_no"), none("chunk_off"), "spc"))
    c = chunks.select(*keys, at("chunk_no", 1), "chunk_no", "chunk_off", none("spc"))
    found = last_at(r.unionByName(c), keys, ["at"], by_width("at"), {"hit": F.col("spc")})
    return found.where(F.col("chunk_no").isNotNull() & F.col("hit").isNotNull()).select(*keys, "chunk_no", "chunk_off", F.col("hit").alias("spc"))


def expand_samples(sizes: DataFrame, chunks_spc: DataFrame, keys: Sequence[str] = FILE) -> DataFrame:
    """Chunk number and file offset of every sample that falls into a chunk."""
    keys = list(keys)
    placed = cut_lineage(running_sum(chunks_spc, keys, ["chunk_no"], by_width("chunk_no"), F.col("spc").cast("bigint"), "first_sample", inclusive=False))
    null = lambda n: F.lit(None).cast("bigint").alias(n)
    # chunks without samples share their place with the next chunk and never own any, so they are left out
    c = placed.where(F.col("spc") > 0).select(
        *keys, (F.col("first_sample") * 2).alias("at"), "chunk_no", "chunk_off", (F.col("first_sample") + F.col("spc")).alias("stop"), null("sample_idx"), null("size")
    )
    s = sizes.select(
        *keys, (F.col("sample_idx") * 2 + 1).alias("at"), null("chunk_no"), null("chunk_off"), null("stop"),
        F.col("sample_idx").cast("bigint").alias("sample_idx"), F.col("size").cast("bigint").alias("size"),
    )
    found = {"in_no": F.col("chunk_no"), "in_off": F.col("chunk_off"), "in_stop": F.col("stop")}
    hit = last_at(c.unionByName(s), keys, ["at"], by_width("at"), found)
    hit = hit.where(F.col("sample_idx") < F.col("in_stop"))
    # each scan reads its input twice (block totals, rows), so the one in between is written once
    flat = cut_lineage(hit.select(*keys, "sample_idx", F.col("in_no").alias("chunk_no"), F.col("in_off").alias("chunk_off"), "size"))
    out = running_sum(flat, [*keys, "chunk_no"], ["sample_idx"], by_width("sample_idx"), F.col("size"), "before", inclusive=False)
    return out.select(*keys, "sample_idx", "chunk_no", (F.col("chunk_off") + F.col("before")).alias("off"), "size")


TRACK = ["path", "track_id"]


def track_samples(tracks: DataFrame) -> DataFrame:
    """path, track_id, sample_idx, chunk_no, off, size of the samples of track rows that fall into a chunk."""
    chunks = tracks.select(*TRACK, F.posexplode("chunk_offsets").alias("i", "chunk_off"))
    chunks = chunks.select(*TRACK, (F.col("i") + 1).cast("bigint").alias("chunk_no"), "chunk_off")
    return expand_samples(sample_sizes(tracks, TRACK), samples_per_chunk(chunks, run_rows(tracks, TRACK), TRACK), TRACK)


def reject_reason(track: DataFrame) -> DataFrame:
    """Add reason (NULL for a usable file): no video, no samples, no chunks, no runs - in that order."""
    reason = F.coalesce(
        F.when(~F.coalesce(F.col("has_video"), F.lit(False)), "no_video"),
        F.when(F.coalesce(F.col("n_samples"), F.lit(0)) == 0, "no_samples"),
        F.when(F.coalesce(F.col("n_chunks"), F.lit(0)) == 0, "no_chunks"),
        F.when(F.coalesce(F.col("n_runs"), F.lit(0)) == 0, "no_runs"),
    )
    return track.withColumn("reason", reason)


def track_counts(tracks: DataFrame) -> DataFrame:
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    return tracks.select(
        "path", "track_id", F.col("sps").isNotNull().alias("has_video"), F.col("sample_count").alias("n_samples"),
        F.greatest(size("chunk_offsets"), F.lit(0)).alias("n_chunks"), F.greatest(size("first_chunk"), F.lit(0)).alias("n_runs"),
    )


def in_bounds(samples: DataFrame, files: DataFrame, keys: Sequence[str] = FILE) -> DataFrame:
    """Samples that end inside their file; ``files`` has the keys and length."""
    return spread_join(samples, files.select(*keys, "length"), keys, "sample_idx").where(F.col("off") + F.col("size") <= F.col("length")).drop("length")


def unit_histogram(units: DataFrame) -> DataFrame:
    return units.where(~F.col("bad_tail")).groupBy("nal_type").agg(F.count("*").alias("n"), F.sum("len").alias("bytes"))


def unit_pivot(units: DataFrame, types: Sequence[int]) -> DataFrame:
    """Units per file, one column per wanted type."""
    n = [F.count_if(~F.col("bad_tail") & (F.col("nal_type") == t)).alias(f"t{t}") for t in types]
    return units.groupBy("path").agg(*n)


def head_tail(samples: DataFrame, keys: Sequence[str] = FILE, head: int = 5, tail: int = 2) -> DataFrame:
    """First and last samples per file: two top-k windows, each trimmed on the map side, so a huge file costs nothing extra."""
    order = ["sample_idx"]
    first = first_k(samples, keys, order, head, "__r")
    last = first_k(samples.withColumn("__d", -F.col("sample_idx")), keys, ["__d"], tail, "__r").drop("__d")
    return first.unionByName(last).drop("__r").dropDuplicates([*keys, *order])


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], k: int = 3) -> DataFrame:
    return first_k(df, keys, order, k)


def file_summary(samples: DataFrame, chunks: DataFrame, runs: DataFrame, keys: Sequence[str] = FILE) -> DataFrame:
    """Counts and bytes per file."""
    keys = list(keys)
    s = samples.groupBy(*keys).agg(F.count("*").alias("n_samples"), F.sum("size").alias("bytes"), F.max("size").alias("max_size"))
    c = chunks.groupBy(*keys).agg(F.count("*").alias("n_chunks"))
    r = runs.groupBy(*keys).agg(F.count("*").alias("n_runs"))
    return s.join(c, keys, "full_outer").join(r, keys, "full_outer")


def file_report(tracks: DataFrame) -> DataFrame:
    """One line per track: picture size, prefix bytes, profile, level and table lengths, straight from the track row."""
    n = lambda c: F.coalesce(F.size(c), F.lit(0)).alias("n_" + c)
    total = F.coalesce(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, v: a + v), F.col("const_size") * F.col("sample_count"))
    return tracks.select(
        "path", "track_id", "width", "height", "nal_length_size", *sps_summary(F.col("sps")), "sample_count",
        n("chunk_offsets"), n("first_chunk"), total.alias("bytes"),
    )


def decoder_config(sps: Column, pps: Column, nal_length_size: Column) -> Column:
    """Decoder configuration record: six header bytes, then one of each parameter set with its length."""
    byte = lambda v: F.unhex(F.lpad(F.hex(v), 2, "0"))
    len16 = lambda b: F.unhex(F.lpad(F.hex(F.octet_length(b)), 4, "0"))
    return F.concat(
        F.unhex(F.lit("01")), F.substring(sps, 2, 3), byte(F.lit(0xFC).bitwiseOR(nal_length_size - 1)), F.unhex(F.lit("E1")),
        len16(sps), sps, F.unhex(F.lit("01")), len16(pps), pps,
    )
