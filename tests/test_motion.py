"""Routing, decline reasons and partitions on hand-made macroblocks."""

import pytest
from pyspark.sql import functions as F

from mediaframe import schemas as S
from mediaframe.operators import motion as M

BASE = dict(mb_type=S.T16X16, mb_x=5, mb_y=5, slice=S.SLICE_P, mb_width=20, mb_height=20, base_mv_x=0, base_mv_y=0, base_ref=0, has_ref=True,
            mv_l0=[0] * 80, ref_l0=[0] * 40, sub=[S.T16X16] * 4)
COLS = ("id string, mb_type int, mb_x int, mb_y int, slice int, mb_width int, mb_height int, base_mv_x int, base_mv_y int, base_ref int, has_ref boolean, "
        "mv_l0 array<int>, ref_l0 array<int>, sub array<int>")


def put(values, **at):
    out = list(values)
    for i, v in at.items():
        out[int(i[1:])] = v
    return out


CASES = {
    "plain": ({}, "p16x16", None),
    "skip keeps the 16x16 bit": (dict(mb_type=S.SKIP | S.T16X16), "skip", None),
    "skip has no 8x8 rule": (dict(mb_type=S.SKIP | S.T16X16 | S.DCT8X8), "skip", None),
    "8x8 transform first": (dict(mb_type=S.T16X16 | S.DCT8X8, slice=S.SLICE_B), "p16x16", "dct8x8"),
    "b slice first for parts": (dict(mb_type=S.T16X8 | S.DCT8X8, slice=S.SLICE_B), "p16x8", "b_slice"),
    "list one": (dict(mb_type=S.T16X16 | (1 << 14)), "p16x16", "list1"),
    "no reference": (dict(has_ref=False), "p16x16", "no_ref"),
    "left margin": (dict(mb_x=0), "p16x16", "luma_margin"),
    "right margin": (dict(mb_x=18), "p16x16", None),
    "right margin moved": (dict(mb_x=18, base_mv_x=4 * 14), "p16x16", "luma_margin"),
    "part reference": (dict(mb_type=S.T8X16, ref_l0=put([0] * 40, i14=1)), "p16x8", "ref_differs"),
    "first failing part counts": (dict(mb_type=S.T16X8, mb_x=0, mv_l0=put([0] * 80, i24=-40), ref_l0=put([0] * 40, i28=3)), "p16x8", "luma_margin"),
    "second part fails": (dict(mb_type=S.T16X8, ref_l0=put([0] * 40, i28=3)), "p16x8", "ref_differs"),
    "quarters": (dict(mb_type=S.T8X8, sub=[S.T16X16, S.T16X8, S.T8X16, S.T8X8]), "p8x8", None),
    "intra 4x4": (dict(mb_type=S.INTRA4X4), "not_intra16x16", "not_intra16x16"),
    "intra in I slice": (dict(mb_type=S.INTRA16X16, slice=S.SLICE_I, mb_x=0), "intra_slice_i", "intra_slice_i"),
    "intra at the edge": (dict(mb_type=S.INTRA16X16, mb_y=0), "intra_edge", "intra_edge"),
    "intra taken": (dict(mb_type=S.INTRA16X16), "intra", None),
}


@pytest.fixture(scope="module")
def blocks(spark):
    names = [c.split(" ")[0] for c in COLS.replace(", ", ",").split(",")][1:]
    return spark.createDataFrame([(k, *[{**BASE, **v[0]}[n] for n in names]) for k, v in CASES.items()], COLS)


def test_routes_and_reasons(blocks):
    got = {r.id: (r.route, r.reason, r.taken) for r in M.outcomes(blocks).collect()}
    assert got == {k: (route, why, why is None) for k, (_, route, why) in CASES.items()}


def test_partitions_cover_the_block(blocks):
    p = blocks.select("id", F.inline(M.partitions(F.col("mb_type"), F.col("sub"))))
    area = {r.id: r.a for r in p.groupBy("id").agg(F.sum(F.col("w") * F.col("h")).alias("a")).collect()}
    assert set(area.values()) == {256} and "intra taken" not in area
    q = [(r.n, r.x_off, r.y_off, r.w, r.h) for r in p.where("id = 'quarters'").orderBy("n").collect()]
    assert q == [(0, 0, 0, 8, 8), (4, 8, 0, 8, 4), (6, 8, 4, 8, 4), (8, 0, 8, 4, 8), (9, 4, 8, 4, 8),
                 (12, 8, 8, 4, 4), (13, 12, 8, 4, 4), (14, 8, 12, 4, 4), (15, 12, 12, 4, 4)]


def test_census_counts_quarters_one_by_one(blocks):
    c = {r.shape: r.n for r in M.shape_census(blocks).collect()}
    assert (c["8x8"], c["8x8:8x4"], c["8x8:4x8"], c["8x8:4x4"]) == (1, 1, 1, 1)
    assert (c["16x8"], c["8x16"]) == (3, 1)


def test_phases(spark):
    df = spark.range(16).select((F.col("id") % 4 - 8).cast("int").alias("x"), F.floor(F.col("id") / 4).cast("int").alias("y"))
    got = df.select("x", "y", M.phase_class9(F.col("x"), F.col("y")).alias("c"), M.phase_pattern4(F.col("x"), F.col("y")).alias("p"),
                    M.phase_family(F.col("x") + 8, F.col("y")).alias("f")).collect()
    cls = {(r.x + 8, r.y): r.c for r in got}
    assert cls[0, 0] == 0 and cls[2, 0] == 1 and cls[0, 2] == 2 and cls[3, 0] == 3 and cls[0, 1] == 4 and cls[1, 3] == 5
    assert cls[2, 2] == 6 and cls[2, 1] == 7 and cls[3, 2] == 8
    assert {(r.x + 8, r.y) for r in got if r.f == "diag"} == {(2, 2), (1, 2), (3, 2), (2, 1), (2, 3)}
    assert sum(r.p is None for r in got) == 4


def test_gating_and_counts(spark):
    df = spark.createDataFrame([([5] * 16, S.T16X16, 0, 3), ([5] * 16, S.T16X16, 1, 3), ([5] * 16, S.INTRA16X16, 0, 3), ([5] * 16, S.T16X16, 15, 0)],
                               "c array<int>, t int, cbp int, nnz int")
    luma = [r.g for r in df.select(M.gate_luma(F.col("c"), F.col("t"), F.col("cbp"), F.col("nnz")).alias("g")).collect()]
    assert [(g[0], g[1]) for g in luma] == [(32, 0), (37, 5), (5, 5), (32, 0)]
    ch = df.select(M.gate_chroma(F.col("c"), F.lit(0x30), F.col("nnz"), F.lit(9)).alias("g")).collect()
    assert [(r.g[0], r.g[1]) for r in ch] == [(41, 5), (41, 5), (41, 5), (41, 0)]
    n = spark.createDataFrame([([64, 3, 64, 2],)], "n array<int>")
    assert n.select(M.nnz_sum(F.col("n")).alias("s")).first().s == 5


def test_references_beyond_the_cap_are_kept(spark):
    rows = [(1, i, i % 40, "single" if i % 3 else "diag") for i in range(120)]
    r = M.reference_groups(spark.createDataFrame(rows, "batch int, ord int, ref int, family string"), ["batch"], "ord").collect()
    assert sum(x.n for x in r) == 120 and {x.ref for x in r if not x.within_cap} == set(range(32, 40))


def test_cell_arrays_are_built_once_a_row_under_a_filter(spark):
    """A pushed-down filter writes out the columns it reads: inside the partition rules that was once for every use and partition."""
    fixed = {n: F.lit(v) for n, v in dict(mb_type=S.T16X8, slice=S.SLICE_P, mb_x=3, mb_y=3, mb_width=16, mb_height=12, base_mv_x=0, base_mv_y=0, base_ref=0, has_ref=True).items()}
    mb = spark.range(3).withColumns({**fixed, "sub": F.array(*[F.lit(8)] * 4), "mv_l0": F.array_repeat(F.col("id").cast("int"), 80), "ref_l0": F.array_repeat(F.lit(0), 40)})
    taken = M.outcomes(mb).where("taken").select("id", "route")
    assert taken._jdf.queryExecution().optimizedPlan().toString().count("array_repeat(cast") == 1
    assert taken.count() == 3


def test_macroblock_records_compile(spark):
    """The JVM leaves methods above 8000 bytes to its interpreter."""
    from mediaframe.plans import fixtures as fx

    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rec = fx.macroblock_info(spark, "/root/testdata/sf0.001").select(F.col("mv_l0").cast("array<smallint>"), F.col("ref_l0").cast("array<tinyint>"))
        code = rec._jdf.queryExecution().debug().codegenToSeq()
        assert 0 < max(code.apply(i)._3().maxMethodCodeSize() for i in range(code.size())) <= 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_cells_of_any_line_item(spark):
    from mediaframe.plans import fixtures as fx

    for r in fx.macroblock_info(spark, "/root/testdata/sf0.001").select("mv_x", "mv_y", "ref", "n9", "mv_l0", "ref_l0").limit(200).collect():
        assert r["mv_l0"] == [v for i in range(40) for v in (r["mv_x"] + i % 5 - 2, r["mv_y"] + i % 3 - 1)]
        assert r["ref_l0"] == [r["ref"] + ((r["n9"] + i) % 29 == 0) for i in range(40)]
