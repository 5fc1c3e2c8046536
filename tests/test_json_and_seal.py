"""Canonical JSON against the standard library's writer, and seals that end in one root."""

import hashlib
import json
import math
import random
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlight.operators import audit

DOUBLES = [
    0.0, -0.0, 1.0, -1.0, 0.1, 1e-5, 1e-4, 0.00012345, 1e15, 1e16, 9007199254740993.0, 123456789012345680.0, 1e20, 1.5e300, 5e-324, 2.2250738585072014e-308,
    12345678.5, 1e22, 1e23, 1.7976931348623157e308, 3.14, 100.0, 1234567.0, 1e7, 9999999.0, 0.001, 1e-3, 2e-3, -1e-7, 4.35, 4.349999999999999, 2**53 + 2.0, 1e21,
]


def written(spark, rows, schema):
    df = spark.createDataFrame(rows, schema)
    return [r.j for r in df.select(audit.canonical_json(df, [c for c in df.columns if c != "at"]).alias("j"), "at").orderBy("at").collect()]


def expected(value):
    return json.dumps(value, sort_keys=True, separators=(",", ":"))


def test_doubles_as_the_standard_writer_has_them(spark):
    rnd = random.Random(5)
    values = [*DOUBLES]
    while len(values) < 3000:
        x = struct.unpack("d", struct.pack("Q", rnd.getrandbits(64)))[0] if len(values) % 2 else round(rnd.uniform(-1e6, 1e6), rnd.randint(0, 8))
        if math.isfinite(x):
            values.append(x)
    got = written(spark, list(enumerate(values)), "at long, x double")
    assert got == [expected({"x": v}) for v in values]


def test_doubles_that_json_lacks(spark):
    got = written(spark, list(enumerate([float("nan"), float("inf"), float("-inf"), None])), "at long, x double")
    assert got == ['{"x":NaN}', '{"x":Infinity}', '{"x":-Infinity}', '{"x":null}']


@pytest.fixture(scope="module")
def texts():
    return ["plain", "", '"quoted" \\ /', "\u0000\u0001\u001f\u007f\u0080", "\b\f\n\r\t", "é ü 漢", "😀 𝄞", " ", "a\u001Fb", "\\u001F", "\\\\u00AB", None]


def test_texts(spark, texts):
    assert written(spark, list(enumerate(texts)), "at long, s string") == [expected({"s": t}) for t in texts]


def test_nested_values(spark, texts):
    schema = T.StructType([
        T.StructField("at", T.LongType()), T.StructField("z", T.ArrayType(T.DoubleType())), T.StructField("m", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("b", T.BooleanType()), T.StructField("s", T.StructType([T.StructField("y", T.MapType(T.StringType(), T.StringType())), T.StructField("x", T.LongType()), T.StructField("a", T.ArrayType(T.StructType([T.StructField("d", T.DoubleType()), T.StructField("c", T.StringType())])))])),
    ])
    rows = [
        (0, [1e20, None, 0.5], {"b": 1e-5, "a": 2.0, "é\u001f": None}, True, ({"2": "x\u001f", "10": None}, 7, [(1e16, "k"), None])),
        (1, [], {}, False, None), (2, None, None, None, (None, None, [])),
    ]
    wanted = []
    for _, z, m, b, s in rows:
        inner = None if s is None else {"y": s[0], "x": s[1], "a": None if s[2] is None else [None if e is None else {"d": e[0], "c": e[1]} for e in s[2]]}
        wanted.append(expected({"z": z, "m": m, "b": b, "s": inner}))
    assert written(spark, rows, schema) == wanted


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.floats(allow_nan=False, allow_infinity=False), st.text(st.characters(exclude_categories=["Cs"]), max_size=12)), min_size=1, max_size=60))
def test_any_values(spark, rows):
    got = written(spark, [(i, x, t) for i, (x, t) in enumerate(rows)], "at long, x double, s string")
    assert got == [expected({"x": x, "s": t}) for x, t in rows]


# seals


def entries(spark, n, gone=()):
    return spark.range(n).where(~F.col("id").isin(*gone) if gone else F.lit(True)).select("id", F.concat(F.lit("body "), "id").alias("body"))


def chain(bodies):
    last = audit.GENESIS
    for body in bodies:
        last = hashlib.sha256((last + body).encode()).hexdigest()
    return last


def brute_root(n, block_rows, fan_in):
    level = [chain([f"body {i}" for i in range(at, min(n, at + block_rows))]) for at in range(0, n, block_rows)]
    while True:
        level = [chain(level[at : at + fan_in]) for at in range(0, len(level), fan_in)]
        if len(level) == 1:
            return level[0]


@pytest.mark.parametrize("n,block_rows,fan_in", [(1, 4, 4), (100, 8, 4), (333, 4, 2), (64, 64, 64)])
def test_one_root(spark, n, block_rows, fan_in):
    sealed = audit.seal_root(audit.build_chain(entries(spark, n), block_rows), fan_in)
    row = sealed.collect()
    assert len(row) == 1 and row[0].root == brute_root(n, block_rows, fan_in) and row[0].entries == n


def test_a_missing_segment_shows(spark):
    whole = audit.build_chain(entries(spark, 300), 8)
    kept = audit.seal_levels(whole, 4)
    cut = audit.seal_levels(audit.build_chain(entries(spark, 300, tuple(range(96, 104))), 8), 4)
    assert audit.seal_root(whole, 4).first().root != audit.seal_root(audit.build_chain(entries(spark, 300, tuple(range(96, 104))), 8), 4).first().root
    found = {(r.level, r.segment): r.problem for r in audit.seal_differences(kept, cut).collect()}
    assert found[(0, 12)] == "missing" and found[(1, 3)] == "changed" and all(level for level, segment in found if segment != 12)
    assert audit.seal_differences(kept, audit.seal_levels(whole, 4)).collect() == []


def test_seal_of_nothing(spark):
    assert audit.seal_root(audit.build_chain(entries(spark, 0), 8), 4).collect() == []
