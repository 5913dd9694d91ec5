import struct

import pytest
from pyspark.sql import functions as F

from verdigris import queries
from verdigris.functions import ALL
from verdigris.plans.env import Env
from verdigris.sources import Descriptor, Field, check_session, load_programs, prepare, save_programs
from verdigris.sources.protobuf import Malformed, decode, decode_messages
from verdigris.streaming import DeadlineExceeded, filter_stream, read_stream, run_once, windowed_counts, with_deadline

INNER = Descriptor("Inner", (Field("x", 1, "sint64"),))
OUTER = Descriptor("Outer", (
    Field("id", 1, "int64"), Field("name", 2, "string"), Field("tags", 3, "string", repeated=True), Field("nums", 4, "int32", repeated=True), Field("inner", 5, "message", message=INNER),
    Field("d", 6, "double"), Field("counts", 7, "map", key="string", value="uint64"), Field("ok", 8, "bool", presence=True), Field("at", 9, "message", message="google.protobuf.Timestamp"), Field("f", 10, "fixed32"), Field("w", 11, "message", message="google.protobuf.Int64Value"),
))


def varint(v):
    v &= (1 << 64) - 1
    out = b""
    while v > 127:
        out += bytes([v & 127 | 128])
        v >>= 7
    return out + bytes([v])


def sized(number, body):
    return varint(number << 3 | 2) + varint(len(body)) + body


MESSAGE = (
    varint(8) + varint(-5) + sized(2, "é".encode()) + sized(3, b"a") + sized(3, b"b") + sized(4, varint(1) + varint(-1)) + varint(4 << 3) + varint(7) + sized(5, varint(8) + varint(3))
    + varint(6 << 3 | 1) + struct.pack("<d", 1.5) + sized(7, sized(1, b"k") + varint(16) + varint((1 << 64) - 1)) + sized(9, varint(8) + varint(60)) + varint(10 << 3 | 5) + struct.pack("<I", 9) + sized(11, varint(8) + varint(4)) + sized(99, b"unknown") + varint(98 << 3) + varint(1)
)


def test_wire_decoding():
    m = decode(OUTER, MESSAGE)
    assert (m["id"], m["name"], m["tags"], m["nums"], m["inner"], m["d"], m["counts"], m["ok"], m["f"], m["w"]) == (-5, "é", ["a", "b"], [1, -1, 7], {"x": -2}, 1.5, {"k": (1 << 64) - 1}, None, 9, 4)
    assert decode(OUTER, b"")["name"] == "" and decode(OUTER, b"")["inner"] is None
    for bad in (b"\x08", b"\x12\x05ab", b"\x0b", b"\x00", sized(2, b"\xff")):
        with pytest.raises(Malformed):
            decode(OUTER, bad)


def test_decoded_messages_in_programs(spark):
    df = spark.createDataFrame([(bytearray(MESSAGE),), (bytearray(b"\x08"),), (None,)], "b binary").select(decode_messages(F.col("b"), OUTER).alias("m"))
    env = Env.from_schema(df.schema, ALL)
    run = lambda t: [r[0] for r in df.select(env.compile(t).column()).collect()]
    assert run("m.nums.sum() + m.inner.x") == [5, None, None]
    assert run("m.at == timestamp(60)") == [True, None, None]
    assert run("m == null") == [False, True, True]


def test_programs_in_files(spark, tmp_path):
    env = Env({"x": "int"}, ALL)
    save_programs({"a": "x > 1", "b": env.compile("x + 1")}, str(tmp_path / "p"))
    got = load_programs(env, str(tmp_path / "p"))
    assert {k: p.unparse() for k, p in got.items()} == {"a": "x > 1", "b": "x + 1"}


def test_session_is_checked(spark):
    prepare(spark)
    check_session(spark)
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    with pytest.raises(ValueError):
        check_session(spark)
    prepare(spark)


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    env = Env.from_schema(events.schema, ALL)
    p = env.compile("event_type == 'click' && value > 10.0")
    run_once(filter_stream(read_stream(spark, str(tmp_path / "in"), events.schema), p), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(p.filter(events).collect())
    counts = windowed_counts(read_stream(spark, str(tmp_path / "in"), events.schema), p, "ts", "1 hour", "10 minutes")
    run_once(counts, str(tmp_path / "out2"), str(tmp_path / "cp2"))
    assert 0 < spark.read.parquet(str(tmp_path / "out2")).agg(F.sum("n")).first()[0] <= p.filter(events).count()


def test_deadline(spark):
    assert with_deadline(spark, 60, lambda: spark.range(10).count()) == 10
    with pytest.raises(DeadlineExceeded):
        with_deadline(spark, 0.5, lambda: spark.range(1 << 42).selectExpr("sum(hash(id))").collect())


def test_plans_push_filters_and_prune_columns(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    out = queries.program(df, queries.FLAGSHIP).filter(df).select("l_extendedprice")
    plan = spark._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "formatted")
    pushed = plan[plan.index("PushedFilters") : plan.index("ReadSchema")]
    assert all(x in pushed for x in ("GreaterThanOrEqual(l_discount,0.05)", "LessThan(l_quantity,24.0)"))
    assert "In(l_returnflag" in plan and "l_comment" not in plan and "Python" not in plan and "l_partkey" not in plan[plan.index("ReadSchema") :]


def test_tracking_and_strict_mode(spark):
    df = spark.createDataFrame([(1,), (0,)], "i long")
    p = Env.from_schema(df.schema, ALL).compile("10 / i > 3 && i == 1")
    rows = p.tracked(df, trace="nodes").collect()
    assert [(r["value"], r["failed"]) for r in rows] == [(True, False), (False, False)]
    assert rows[0]["nodes"]["10 / i"] == "10" and rows[1]["nodes"]["10 / i"] is None
    with pytest.raises(Exception, match="program failed"):
        Env.from_schema(df.schema, ALL).compile("10 / i").strict(df, "v").collect()


def test_unchecked_programs_and_observed_counts(spark):
    from pyspark.sql import Observation

    env = Env({}, ALL)
    value = lambda t: spark.range(1).select(env.compile(t, checked=False).column()).first()[0]
    assert value("nope(1) == 1 || true") is True
    assert value("1 + 'a' == 1 && true") is None
    df = spark.createDataFrame([(1,), (0,), (4,)], "i long")
    seen = Observation()
    Env.from_schema(df.schema, ALL).compile("10 / i > 3").observed(df, seen).collect()
    assert seen.get == {"rows": 3, "failed": 1, "true": 1}


def test_messages_merge_and_hold_any_value():
    from verdigris.sources.protobuf import Descriptor, Field, Json, Malformed, decode

    part = lambda n, body: bytes([n << 3 | 2, len(body)]) + body
    inner = Descriptor("x.Inner", (Field("a", 1, "int64"), Field("b", 2, "int64"), Field("s", 3, "string", repeated=True)))
    d = Descriptor("x.Outer", (Field("m", 1, "message", message=inner), Field("v", 2, "message", message="google.protobuf.Value"), Field("s", 3, "message", message="google.protobuf.Struct"), Field("l", 4, "message", message="google.protobuf.ListValue"), Field("p", 5, "message", message="google.protobuf.Any")))
    got = decode(d, part(1, b"\x08\x01" + part(3, b"x")) + part(1, b"\x10\x02" + part(3, b"y")) + part(1, b"\x08\x05"))
    assert got["m"] == {"a": 5, "b": 2, "s": ["x", "y"]} and got["v"] is None
    text, number, null, yes = part(3, b"hi"), b"\x11" + b"\0\0\0\0\0\0\xf8?", b"\x08\x00", b"\x20\x01"
    for body, want in ((text, "hi"), (number, 1.5), (null, None), (yes, True), (b"\x20\x00", False), (b"", None), (part(3, b""), "")):
        assert decode(d, part(2, body))["v"] == Json(want)
    entry = lambda k, v: part(1, part(1, k) + part(2, v))
    assert decode(d, part(3, entry(b"k", text) + entry(b"n", part(6, part(1, number)))))["s"] == Json({"k": "hi", "n": [1.5]})
    assert decode(d, part(4, part(1, null) + part(1, part(5, entry(b"z", yes)))))["l"] == Json([None, {"z": True}])
    packed = part(1, b"type.googleapis.com/x.Inner") + part(2, b"\x08\x07")
    assert decode(d, part(5, packed), {"x.Inner": inner})["p"] == Json({"a": 7, "b": 0, "s": []})
    assert decode(d, part(5, packed))["p"] == Json({"type_url": "type.googleapis.com/x.Inner", "value": "CAc="})
    with pytest.raises(Malformed):
        decode(d, part(1, b"\x08"))
