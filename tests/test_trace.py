"""Packet structure, policy and stream comparison on hand-made streams."""

import pytest
from pyspark.sql import functions as F

from mediaframe.operators import trace as X

FILL = 0x80000000


def t0(base, n, one=False):
    return (base // 4) | (0x8000 if one else 0) | ((n - 1) << 16)


SLOT = 100
PROGRAM = [t0(0x4250, 1), SLOT, t0(0x4254, 6, True), 0x001F8105, 0, 0, 0x00DB0498, 0x00C18000, 0x20490000, t0(0x4630, 1), (SLOT << 16) | SLOT]
STREAMS = {
    1: PROGRAM,
    2: [0, FILL, FILL + 5, t0(0x429C, 1), 7],
    3: [t0(0x411C, 2), 1, 2, t0(0x3000, 1), 3, t0(0x4060, 1), 4],
    4: [t0(0x4e00, 3), 1],
    5: [0x40000000 | (0x4104 // 4 & 0x7FF) | ((0x2140 // 4 & 0x7FF) << 11), 1],
    6: [0xC0000000 | (0x99 << 8), 1, 0xC0050000 | (0x10 << 8), 1],
    7: [0x40000000 | 0x10 | (0x20 << 11), 5, 6],
}


@pytest.fixture(scope="module")
def words(spark):
    rows = [(s, i, w) for s, ws in STREAMS.items() for i, w in enumerate(ws)]
    return spark.createDataFrame(rows, "stream_id bigint, dw bigint, w bigint").repartition(3)


def rules(words, spark, **kw):
    out = {}
    for r in X.findings(words, X.packets(words), X.register_dim(spark), **kw).orderBy("dw", "ord").collect():
        out.setdefault(r.stream_id, []).append(r.rule)
    return out


def test_findings(words, spark):
    got = rules(words, spark)
    assert 1 not in got
    assert got[2] == ["zero_header", "type2_low_bits", "forbidden"]
    assert got[3] == ["hang_risk", "hang_risk", "outside_blocks", "unconfirmed"]
    assert got[4] == ["type0_overrun"] and got[5] == ["type1_truncated"]
    assert got[6] == ["opcode_not_allowed", "type3_overrun"]
    assert "hang_risk" not in rules(words, spark, allow_hang_risk=True)[3]


def test_gate_and_empty(words, spark):
    streams = spark.createDataFrame([(i,) for i in range(1, 10)], "stream_id bigint")
    g = X.gate(streams, X.findings(words, X.packets(words), X.register_dim(spark)), X.empty_streams(streams, words))
    assert {r.stream_id for r in g.where("pass").collect()} == {1}


def test_state_and_programs(words):
    h = X.packets(words)
    w = X.register_writes(words, h)
    s = {r.addr: r.value for r in X.last_state(w).where("stream_id = 1").collect()}
    assert s == {0x4250: SLOT, 0x4254: 0x20490000, 0x4630: (SLOT << 16) | SLOT}
    assert {r.addr for r in w.where("stream_id = 7").collect()} == {0x40, 0x80}
    p = X.programs(words)
    assert [(r.stream_id, r.dw, r.slot, r.n) for r in p.collect()] == [(1, 2, SLOT, 6)]
    ins = X.disassemble(X.program_words(words, p), ["stream_id", "prog_dw"]).first()
    assert ins.kind == "OUT" and ins.rgb_op == "MAD" and ins.last == 1
    assert X.distinct_registers(w).where("stream_id = 1").first().n_registers == 3


def test_known_names():
    names = dict(X.register_names())
    assert names[0x2150] == "VAP_PROG_STREAM_CNTL_0" and names[0x2154] == "VAP_PROG_STREAM_CNTL_1" and names[0x4400] == "TX_FILTER0_0"


def test_insertion(words, spark):
    one = words.where("stream_id in (1, 7)")
    pay = spark.createDataFrame([(s, k, 1000 + k) for s in (1, 7) for k in range(3)], "stream_id bigint, k bigint, w bigint")
    at = spark.createDataFrame([(1, 2, 99), (7, 3, 99)], "stream_id bigint, pos bigint, head_dw bigint")
    inj = X.insert_words(one, pay, at)
    assert all(r.ok for r in X.insertion_check(one, inj, pay, at).collect())
    broken = inj.withColumn("w", F.when((F.col("stream_id") == 1) & (F.col("dw") == 0), F.lit(5)).otherwise(F.col("w")))
    r = {x.stream_id: x for x in X.insertion_check(one, broken, pay, at).collect()}
    assert not r[1].before_ok and r[1].payload_ok and r[7].ok
    assert {x.stream_id: x.prefix for x in X.common_prefix(one, broken).where("stream_id = 1").collect()} == {1: 0}


def test_record_walk(spark):
    rec = [(1, [0x02000003, 9, 9, 0x05000002, 8, 0x01000000, 0x07000001]), (2, [0x03000009, 1])]
    df = spark.createDataFrame([(s, i, w) for s, ws in rec for i, w in enumerate(ws)], "stream_id bigint, dw bigint, w bigint")
    got = [(r.stream_id, r.dw, r.op, r.len) for r in X.record_walk(df).orderBy("stream_id", "dw").collect()]
    assert got == [(1, 0, 2, 3), (1, 3, 5, 2), (1, 5, 1, 0), (2, 0, 3, 9)]


def test_ordering_hazard(spark):
    draw = 0xC0000000 | (0x28 << 8)
    s = {1: [t0(0x411C, 1), 1, draw, 0], 2: [t0(0x411C, 1), 1, t0(0x4200, 2), 1, 2, draw, 0], 3: [t0(0x4120, 1), 1, t0(0x4200, 1), 1]}
    df = spark.createDataFrame([(k, i, w) for k, ws in s.items() for i, w in enumerate(ws)], "stream_id bigint, dw bigint, w bigint")
    h = X.packets(df)
    assert [(r.stream_id, r.writes_before_draw) for r in X.ordering_hazards(X.register_writes(df, h), h).collect()] == [(1, 0)]
