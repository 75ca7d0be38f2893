"""Scalar helpers."""

import math
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sparktide.functions import labels as L
from sparktide.functions import numbers as N
from sparktide.functions import times as T


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def lmap(**kv):
    if not kv:
        return L.empty_labels()
    return F.create_map(*[F.lit(x) for p in kv.items() for x in p])


def test_series_id_is_order_free_and_reversible(spark):
    a = F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit('x"\\y\n'))
    b = F.create_map(F.lit("a"), F.lit('x"\\y\n'), F.lit("b"), F.lit("2"))
    row = one(spark, L.series_id(F.lit("cpu"), a), L.series_id(F.lit("cpu"), b),
              L.labels_of(L.series_id(F.lit("cpu"), a)), L.series_id(F.lit("up"), L.empty_labels()),
              L.labels_of(F.lit("up{}")))
    assert row[0] == row[1] == 'cpu{a="x\\"\\\\y\\n",b="2"}'
    assert row[2] == {"a": 'x"\\y\n', "b": "2"}
    assert row[3] == "up{}" and row[4] == {}


def test_label_match_missing_equals_empty(spark):
    m = lmap(host="a")
    row = one(spark, L.label_match(m, {"host": "a"}), L.label_match(m, {"host": "b"}),
              L.label_match(m, {"zone": ""}), L.label_match(m, {"zone": "x"}), L.label_match(m, {}))
    assert list(row) == [True, False, True, False, True]


def test_merging(spark):
    row = one(spark, L.merge_labels(lmap(job="node", cpu="t"), lmap(cpu="0")), L.with_label(lmap(a="1"), "a", F.lit("2")),
              L.split_name(lmap(__name__="up", a="1"))[0], L.split_name(lmap(__name__="up", a="1"))[1],
              L.metric_labels(F.lit("up"), lmap(a="1")))
    assert row[0] == {"job": "node", "cpu": "0"}
    assert row[1] == {"a": "2"} and row[2] == "up" and row[3] == {"a": "1"}
    assert row[4] == {"a": "1", "__name__": "up"}


def test_label_texts(spark):
    row = one(spark, L.label_for(lmap(device="sda", x="1"), F.lit("m"), "device"), L.label_for(lmap(b="2", a="1"), F.lit("m")),
              L.label_for(L.empty_labels(), F.lit("m")), L.label_for(L.empty_labels(), F.lit("")),
              L.label_suffix(lmap(b="2", a="1")), L.label_suffix(L.empty_labels()), L.labels_json(L.empty_labels()),
              L.labels_json(F.lit(None).cast("map<string,string>")), L.labels_json(lmap(b="<2>", a="1")),
              L.short_memory_name(F.lit("node_memory_MemFree_bytes")))
    assert list(row) == ["sda", "a=1,b=2", "m", "value", "{a=1,b=2}", "", "{}", "{}",
                         '{"a":"1","b":"\\u003c2\\u003e"}', "MemFree"]


@pytest.mark.parametrize("value,text", [
    (100.0, "100"), (12.31, "12.31"), (0.1, "0.1"), (1e6, "1e+06"), (999999.5, "999999.5"), (1234567.8, "1.2345678e+06"),
    (123456789.0, "1.23456789e+08"), (1e21, "1e+21"), (1e-4, "0.0001"), (1.5e-5, "1.5e-05"), (0.00123, "0.00123"),
    (-2.5, "-2.5"), (0.0, "0"), (-0.0, "-0"), (math.inf, "+Inf"), (-math.inf, "-Inf"), (math.nan, "NaN"),
    (1e100, "1e+100"), (5.684341886080802e-14, "5.684341886080802e-14"), (2.0 / 3, "0.6666666666666666"),
    (1e22, "1e+22"), (42.0, "42"), (123456.0, "123456"), (3602879701896397.0, "3.602879701896397e+15"),
])
def test_format_float(spark, value, text):
    assert one(spark, N.format_float(F.lit(value)))[0] == text


def shortest(v):
    """Plain-Python form of the same text."""
    _, digits, exp = Decimal(repr(abs(v))).normalize().as_tuple()
    d = "".join(map(str, digits))
    e = exp + len(d) - 1
    sign = "-" if v < 0 else ""
    if e < -4 or e >= 6:
        return f"{sign}{d[0]}{'.' if len(d) > 1 else ''}{d[1:]}e{'-' if e < 0 else '+'}{abs(e):02d}"
    return sign + format(Decimal(repr(abs(v))).normalize(), "f")


def test_format_float_is_shortest(spark):
    rows = spark.range(3000).select(((F.rand(7) - 0.5) * F.pow(F.lit(10.0), (F.rand(8) * 60 - 30).cast("int"))).alias("v"))
    rows = rows.select("v", N.format_float(F.col("v")).alias("t")).collect()
    assert all(float(r.t) == r.v for r in rows)
    longer = [r for r in rows if r.t != shortest(r.v)]
    # the JVM's own printing may pick another 17-digit text for the same number
    assert all(len(r.t) == len(shortest(r.v)) for r in longer) and len(longer) < 30


def test_bounds_and_sizes(spark):
    row = one(spark, N.format_bound(F.lit("0.5")), N.format_bound(F.lit("1000000")), N.format_bound(F.lit("+Inf")),
              N.human_bytes(F.lit(512.0)), N.human_bytes(F.lit(1536.0)), N.human_bytes(F.lit(3.0 * 1024 ** 4)),
              N.human_bytes(F.lit(512.0), decimals=1), N.human_bytes(F.lit(2048.0 * 1024 ** 3), decimals=1),
              N.parse_human_bytes(F.lit("1898G")), N.parse_human_bytes(F.lit("512")), N.parse_human_bytes(F.lit("5X")))
    assert list(row) == ["0.5", "1e+06", "+Inf", "512B", "1.50KiB", "3.00TiB", "512.0B", "2048.0GiB",
                         1898.0 * 1024 ** 3, 512.0, None]


def test_format_float_of_large_whole_numbers(spark):
    values = [1e6, -1e6, 1234567.0, 1e15 - 1, 1e15, 2.0 ** 53, 12e9, 1000001.5, -123456789012345.0]
    row = one(spark, *[N.format_float(F.lit(v)) for v in values])
    assert list(row) == ["1e+06", "-1e+06", "1.234567e+06", "9.99999999999999e+14", "1e+15", "9.007199254740992e+15", "1.2e+10", "1.0000015e+06",
                         "-1.23456789012345e+14"]


def test_sizes_up_to_a_named_unit(spark):
    row = one(spark, N.human_bytes(F.lit(3.0 * 1024 ** 4), largest="G"), N.human_bytes(F.lit(1536.0), largest="G"),
              N.human_bytes(F.lit(3.0 * 1024 ** 4), decimals=1, largest="T"), N.human_bytes(F.lit(1.5 * 1024 ** 6)))
    assert list(row) == ["3072.00GiB", "1.50KiB", "3.0TiB", "1.50EiB"]


@pytest.mark.parametrize("text,seconds", [
    ("15s", 15), ("2h", 7200), ("7d", 604800), ("1y", 31536000), ("1h30m", 5400), ("1.5h", 5400), ("250ms", 0.25), ("0", 0),
    ("-5s", -5),
])
def test_durations(spark, text, seconds):
    assert T.duration_seconds(text) == pytest.approx(seconds)
    assert one(spark, T.parse_duration(F.lit(text)))[0] == pytest.approx(seconds)


@pytest.mark.parametrize("text", ["", "abc", "5", "1d2h", "5 s"])
def test_bad_durations(spark, text):
    with pytest.raises(ValueError):
        T.duration_seconds(text)
    assert one(spark, T.parse_duration(F.lit(text)))[0] is None


def test_parse_time(spark):
    row = one(spark, F.unix_micros(T.parse_time(F.lit("1700000000.25"))), F.unix_micros(T.parse_time(F.lit("2023-11-14T22:13:20Z"))),
              F.unix_micros(T.parse_time(F.lit("2023-11-15T00:13:20.5+02:00"))), T.parse_time(F.lit("yesterday")))
    assert list(row) == [1700000000250000, 1700000000000000, 1700000000500000, None]


def test_compare_and_nan(spark):
    nan = F.lit(math.nan)
    got = one(spark, *[N.compare_op(F.lit(op), nan, F.lit(1.0)) for op in N.OPERATORS],
              *[N.compare_op(F.lit(op), F.lit(2.0), F.lit(1.0)) for op in N.OPERATORS],
              N.compare_op(F.lit("~"), F.lit(2.0), F.lit(1.0)))
    assert list(got) == [False] * 5 + [True] + [True, False, True, False, False, True] + [False]


def test_distance_and_score(spark):
    a, b, c = (F.array(*[F.lit(float(x)) for x in v]) for v in ((0, 0, 0), (3, 4, 0), (0, 0, 1)))
    row = one(spark, N.mean_distance(a, b, c), N.mean_distance(a, b, c, 3), N.anomaly_score(F.lit(5.0), F.lit(1.0), F.lit(1.0)),
              N.anomaly_score(F.lit(0.0), F.lit(1.0), F.lit(2.0)), N.anomaly_score(F.lit(1.5), F.lit(1.0), F.lit(2.0)),
              N.anomaly_score(F.lit(9.0), F.lit(1.0), F.lit(2.0)), N.clip_pct(F.lit(-3.0)), N.clip_pct(F.lit(130.0)))
    assert list(row) == [3.0, 3.0, 0.0, 100.0, 50.0, 100.0, 0.0, 100.0]


def test_bucket_floor_before_1970(spark):
    row = one(spark, T.floor_to(F.lit(-1).cast("long"), 60), T.floor_to(F.lit(119).cast("long"), 60))
    assert list(row) == [-60, 60]
