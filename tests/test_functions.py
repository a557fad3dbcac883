from datetime import datetime

from pyspark.sql import functions as F

from conftest import rows
from tlake import functions as fn
from tlake import schemas
from tlake.functions.attributes import VALUE_KINDS


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_nanos_truncate_and_keep_order(spark):
    ns = F.lit(1704067207179575999)
    assert one(spark, fn.from_unix_nanos(ns))[0] == datetime(2024, 1, 1, 0, 0, 7, 179575)
    assert one(spark, fn.from_unix_nanos(F.lit(-1).cast("bigint")))[0] == datetime(1969, 12, 31, 23, 59, 59, 999999)
    t = F.lit("2024-01-01 00:00:07.179575").cast("timestamp_ntz")
    assert one(spark, fn.unix_nanos(t), fn.unix_seconds(t)) == (1704067207179575000, 1704067207)


def test_buckets(spark):
    t = F.lit("2024-01-01 13:47:59.5").cast("timestamp_ntz")
    assert one(spark, *[fn.time_bucket(t, w) for w in ("1 second", "5 minutes", "1 hour", "1 day")]) == (
        datetime(2024, 1, 1, 13, 47, 59), datetime(2024, 1, 1, 13, 45), datetime(2024, 1, 1, 13), datetime(2024, 1, 1),
    )
    assert one(spark, fn.trunc_second(F.lit("1969-12-31 23:59:59.9").cast("timestamp_ntz")))[0] == datetime(1969, 12, 31, 23, 59, 59)


def test_bad_number_is_null(spark):
    assert one(spark, *[fn.as_bigint(F.lit(x)) for x in ("", "x", "12")]) == (None, None, 12)


def test_readable_size(spark):
    sizes = [0, 1023, 1024, 1536, 186 * 1024, 1 << 30, 3 << 40]
    got = one(spark, *[fn.readable_size(F.lit(n)) for n in sizes])
    assert got == ("0.00 B", "1023.00 B", "1.00 KiB", "1.50 KiB", "186.00 KiB", "1.00 GiB", "3.00 TiB")


def test_attributes(spark):
    line = """{"a":[{"key":"x","value":{"stringValue":"1"}},{"key":"e","value":{"stringValue":""}},
        {"key":"n","value":{"intValue":"7"}},{"key":"d","value":{"doubleValue":1.5}},
        {"key":"b","value":{"boolValue":true}},{"key":"none"},{"key":"x","value":{"stringValue":"2"}}]}""".replace("\n", "")
    df = spark.createDataFrame([(line,)], "v string").select(
        F.from_json("v", f"a {schemas.KEY_VALUES}").alias("r")
    )
    m, first, absent = df.select(
        fn.attrs_to_map("r.a"), fn.first_attr("r.a", "x"), fn.first_attr("r.a", "zzz")
    ).first()
    assert m == {"x": "2", "e": "", "n": "7", "d": "1.5", "b": "true", "none": ""}
    assert (first, absent) == ("1", "")
    null = F.lit(None).cast(schemas.KEY_VALUES)
    assert one(spark, fn.attrs_to_map(null), fn.first_attr(null, "x")) == ({}, "")


def test_upsert_and_key(spark):
    m = F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), F.lit("2"))
    r = F.create_map(F.lit("a"), F.lit("2"), F.lit("b"), F.lit("1"))
    assert one(spark, fn.upsert(m, {"b": "9", "c": "3"}))[0] == {"a": "2", "b": "9", "c": "3"}
    assert one(spark, fn.attr_key(m) == fn.attr_key(r), fn.map_text(m, "zz")) == (True, "")
    assert one(spark, fn.upsert(F.lit(None).cast("map<string,string>"), {"k": "v"}))[0] == {"k": "v"}


def test_json_paths_count_from_one(spark):
    doc = F.lit('{"a":[{"b":"x"},{"b":"y","n":[1,2]}]}')
    assert one(spark, fn.json_string(doc, "a", 2, "b"), fn.json_string(doc, "a", 3, "b"),
               fn.json_value(doc, "array<int>", "a", 2, "n")) == ("y", "", [1, 2])


def test_like_takes_underscores_literally(spark):
    df = spark.createDataFrame([("a_local",), ("alocal",), ("axlocal",)], "t string")
    assert rows(df.filter(fn.like_literal("t", suffix="_local"))) == [("a_local",)]


def test_array_first_never_raises(spark):
    arr = F.array(F.lit(1), F.lit(2), F.lit(3))
    assert one(spark, fn.array_first(arr, lambda x: x > 1), fn.array_first(arr, lambda x: x > 9)) == (2, None)


def test_missing_keys_spread(spark):
    df = spark.range(1000).select(
        fn.own_key(F.lit(""), F.lit(False), "id").alias("k"), fn.looked_up(F.col("id").cast("string")).alias("l")
    )
    assert df.select("k").distinct().count() == 1000
    assert df.join(df.select(F.col("l").alias("k")), "k").count() == 0


def test_kinds_of_a_value_are_read_at_once(spark, capsys):
    """One reading of the VARIANT whatever its kind; odd values give what a reading per kind gives."""
    odd = [
        "{}", "null", "5", '"x"', "[1, 2]", "true", '{"stringValue":null}', '{"stringValue":null,"intValue":"5"}', '{"stringValue":""}',
        '{"intValue":5}', '{"intValue":12345678901234567890123}', '{"doubleValue":1e-7}', '{"doubleValue":1e300}', '{"doubleValue":10.0}',
        '{"boolValue":false}', '{"arrayValue":{}}', '{"arrayValue":{"values":[{"intValue":"1"},null]}}', '{"other":1}',
        '{"arrayValue":null,"kvlistValue":{"values":[]}}', '{"bytesValue":"YQ==","stringValue":"z"}', '{"bytesValue":"YQ=="}', '{"StringValue":"a"}',
        '{"other":{"stringValue":"a"},"boolValue":true}', '{"stringValue":{"a":1}}', '{"stringValue":["é\\"",1.50]}',
    ]
    df = spark.createDataFrame([(x,) for x in [*odd, None]], "j string").select("j", F.try_parse_json("j").alias("v"))
    each = {kind: F.try_variant_get("v", f"$.{kind}", "string") for kind in VALUE_KINDS}
    kinds = F.coalesce(*[F.when(c.isNotNull(), kind) for kind, c in each.items()], F.lit(""))
    got = df.select("j", fn.value_kind(F.col("v")), kinds, fn.variant_text(F.col("v")), F.coalesce(*each.values())).collect()
    assert len(got) == len(odd) + 1 and [r for r in got if r[1] != r[2] or r[3] != r[4]] == []
    assert {r[1] for r in got} == {"", *VALUE_KINDS}
    for read in (fn.value_kind, fn.variant_text):
        capsys.readouterr()
        df.select(read(F.col("v")).alias("out")).explain()
        assert capsys.readouterr().out.count("try_variant_get") == 1
