"""Units by Arrow batches against the walk of one payload."""

import random

import pyarrow as pa
import pytest

from mediaframe.operators import udf as U
from mediaframe.sources.movie import split_units


def payload(rnd, prefix):
    units = b"".join(n.to_bytes(prefix, "big") + rnd.randbytes(n) for n in (rnd.randint(1, 9) for _ in range(rnd.randint(0, 6))))
    return units + rnd.choice([b"", b"", b"\0" * prefix, b"\x7f" * (prefix + 2), b"\1"])


@pytest.mark.parametrize("prefix", [1, 2, 4])
def test_unit_lists(prefix):
    rnd = random.Random(prefix)
    data = [payload(rnd, prefix) for _ in range(300)] + [b"", None, b"\0" * 9]
    got = U.unit_lists(pa.array(data, pa.binary()), pa.array([prefix] * len(data), pa.int32())).to_pylist()
    assert [[tuple(u.values()) for u in g] for g in got] == [split_units(d or b"", 0, len(d or b""), prefix) for d in data]
    assert U.unit_lists(pa.array([], pa.binary()), pa.array([], pa.int32())).to_pylist() == []


def test_units_of_gives_the_rows_of_the_table_function(spark):
    rnd = random.Random(9)
    rows = [(i, payload(rnd, 4)) for i in range(200)] + [(200, None), (201, b"")]
    df = spark.createDataFrame(rows, "id int, payload binary").repartition(3)
    U.register_table_functions(spark)
    df.createOrReplaceTempView("units_of_test")
    want = spark.sql("SELECT id, u.* FROM units_of_test, LATERAL split_units(payload, 4) u")
    got = U.units_of(df, "payload", 4, ["id"])
    assert got.schema.names == want.schema.names and [f.dataType for f in got.schema] == [f.dataType for f in want.schema]
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "BatchEvalPythonUDTF" not in got._jdf.queryExecution().executedPlan().toString()
