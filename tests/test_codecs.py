import datetime as dt
import decimal
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowtide.functions import avro_codec, codecs, hashing, text
from rowtide.functions.buckets import BUCKETS, CachedShardId, bucket_text
from rowtide.functions.json_codec import json_payload

D = decimal.Decimal
STAMP = dt.datetime(2020, 3, 31, 21, 21, 15, 120000)
SCALARS = {
    "bool": (T.BooleanType(), True),
    "long": (T.LongType(), -(2**63)),
    "double": (T.DoubleType(), 3.14),
    "numeric": (T.DecimalType(38, 9), D("6.626")),
    "string": (T.StringType(), "grüße \"q\"\n"),
    "bytes": (T.BinaryType(), bytearray(b"TEST" * 30)),
    "date": (T.DateType(), dt.date(2020, 3, 31)),
    "ts": (T.TimestampNTZType(), STAMP),
}


@pytest.fixture(scope="module")
def wide(spark):
    """Every scalar and its array, once set and once null, with nulls inside the arrays."""
    fields, full, empty = [], [], []
    for name, (kind, value) in SCALARS.items():
        fields += [T.StructField(name, kind), T.StructField(f"{name}s", T.ArrayType(kind, True)), T.StructField(f"must_{name}", kind, False)]
        full += [value, [value, None, value, None], value]
        empty += [None, None, value]
    return spark.createDataFrame([full, empty], T.StructType(fields))


def test_json(wide):
    full, empty = (json.loads(r[0]) for r in wide.select(json_payload(wide)).collect())
    assert full["date"] == "2020-03-31" and full["ts"] == "2020-03-31T21:21:15.120000000Z" and full["numeric"] == "6.626"
    assert full["bytes"] == "VEVTVFRFU1RURVNU" * 10 and full["longs"] == [-(2**63), None, -(2**63), None]
    assert full["tss"] == ["2020-03-31T21:21:15.120000000Z", None] * 2 and full["string"] == "grüße \"q\"\n"
    assert list(full) == wide.columns == list(empty) and empty["bool"] is None and empty["dates"] is None and empty["must_double"] == 3.14


@pytest.mark.parametrize("micros, said", [(0, "1970-01-01T00:00:00Z"), (1, "1970-01-01T00:00:00.000001000Z"), (199818, "1970-01-01T00:00:00.199818000Z")])
def test_timestamp_text(spark, micros, said):
    one = spark.createDataFrame([(dt.datetime(1970, 1, 1, 0, 0, 0, micros),)], "t timestamp_ntz")
    assert one.select(text.timestamp_text(F.col("t"))).first()[0] == said


def test_decimal_text(spark):
    values = ["0", "3.14", "6.6260", "-100", "1000.000", "0.000000001"]
    found = spark.createDataFrame([(D(v),) for v in values], "d decimal(38,9)").select(text.decimal_text(F.col("d"))).collect()
    assert [r[0] for r in found] == ["0", "3.14", "6.626", "-100", "1000", "0.000000001"]


def test_unsupported(spark):
    for shape in ("s struct<a:int>", "s array<array<int>>", "s map<string,int>"):
        df = spark.createDataFrame([], shape)
        with pytest.raises(TypeError):
            json_payload(df)
        with pytest.raises(TypeError):
            avro_codec.avro_schema(df.schema, "t")


def test_avro_schema(wide):
    s = json.loads(avro_codec.avro_schema(wide.schema, "T"))
    by = {f["name"]: f for f in s["fields"]}
    assert (s["name"], s["namespace"]) == ("T", "avroNamespace")
    assert by["bool"] == {"name": "bool", "type": ["null", "boolean"], "default": None}
    assert by["must_ts"] == {"name": "must_ts", "type": "string"}
    assert by["bytess"] == {"name": "bytess", "type": ["null", {"type": "array", "items": ["null", "bytes"]}]}


def test_avro_round_trip(wide):
    schema = avro_codec.avro_schema(wide.schema, "T")
    back = wide.select(avro_codec.avro_payload(wide, schema).alias("v")).select(avro_codec.avro_decoded(F.col("v"), schema).alias("r")).select("r.*").collect()
    assert back[0]["ts"] == "2020-03-31T21:21:15.120000000Z" and back[0]["numeric"] == "6.626" and bytes(back[0]["bytes"]) == b"TEST" * 30
    assert back[0]["doubles"] == [3.14, None, 3.14, None] and back[0]["must_long"] == -(2**63)
    assert back[1]["bool"] is None and back[1]["strings"] is None and back[1]["must_string"] == SCALARS["string"][1]


def test_avro_matches_the_java_library(spark, wide):
    schema = avro_codec.avro_schema(wide.schema, "T")
    jvm = spark._jvm
    parsed = jvm.org.apache.avro.Schema.Parser().parse(schema)
    for r in wide.select(avro_codec.avro_payload(wide, schema).alias("v")).collect():
        decoder = jvm.org.apache.avro.io.DecoderFactory.get().binaryDecoder(bytes(r.v), None)
        record = jvm.org.apache.avro.generic.GenericDatumReader(parsed).read(None, decoder)
        assert decoder.isEnd() and record.get("must_ts").toString() == "2020-03-31T21:21:15.120000000Z" and record.get("must_long") == -(2**63)


def one_by_one(kind, *messages):
    """Each message decoded, all of them in one batch."""
    data = np.frombuffer(b"".join(messages), np.uint8)
    end = np.cumsum([len(m) for m in messages])
    values, at = avro_codec.decoded(kind, data, end - [len(m) for m in messages], end)
    assert (at == end).all()
    return values.to_pylist()


def test_avro_numbers():
    numbers = [0, 1, -1, 63, 64, -64, -65, 2**31, 2**63 - 1, -(2**63)]
    assert one_by_one("long", *[avro_codec.write_long(n) for n in numbers]) == numbers
    w = avro_codec.write_long
    blocks = w(-2) + w(2) + b"\x02\x04" + w(1) + b"\x06" + b"\x00"
    assert one_by_one({"type": "array", "items": "long"}, blocks, w(0), w(1) + w(9) + w(0)) == [[1, 2, 3], [], [9]]
    assert one_by_one({"type": "array", "items": ["null", "string"]}, w(2) + w(0) + w(1) + w(1) + b"x" + w(0), w(0)) == [[None, "x"], []]
    assert one_by_one("float", b"\x00\x00\xc0\x3f") == [1.5] and one_by_one(["string", "null"], w(0) + w(1) + b"y", w(1)) == ["y", None]
    for kind, bad in (("long", b"\x80"), ("long", b"\xff" * 10), ("double", b"\x00" * 7), ("boolean", b"\x02"), ("string", w(3) + b"ab"), ("bytes", w(-1)), (["null", "long"], w(2) + w(1)), ({"type": "array", "items": "long"}, w(2) + w(1))):
        with pytest.raises(avro_codec.BadMessage):
            one_by_one(kind, bad, b"\x02\x04\x06\x08")


def failing(df):
    with pytest.raises(Exception) as caught:
        df.collect()
    return str(caught.value)


@pytest.mark.parametrize("broken", [lambda v: v[:-2], lambda v: v + b"\x00", lambda v: b"", lambda v: b"\x05" + v[1:]])
def test_a_broken_message_raises_wherever_it_stands(spark, broken):
    """A cut message took its last bytes from the next one; any now fails, first, in the middle and last."""
    df = spark.createDataFrame([("abc", 1), ("def", 2), ("ghi", 3)], "s string, n long").coalesce(1)
    schema = avro_codec.avro_schema(df.schema, "T")
    sent = [bytes(r[0]) for r in df.select(avro_codec.avro_payload(df, schema)).collect()]
    for k in range(3):
        got = [(broken(v) if i == k else v,) for i, v in enumerate(sent)]
        assert "BadMessage" in failing(spark.createDataFrame(got, "v binary").coalesce(1).select(avro_codec.avro_decoded(F.col("v"), schema)))


def record(*fields):
    return json.dumps({"type": "record", "name": "T", "fields": [dict(zip(("name", "type", "default"), f)) for f in fields]})


def test_schemas_are_resolved(spark):
    """Columns added, taken away, in another order, renamed, promoted, and arrays; as the Java library reads them."""
    df = spark.createDataFrame([(1, "x", [1, None], 2), (None, None, None, 3)], "a long, b string, c array<long>, d long")
    writer = avro_codec.avro_schema(df.schema, "T", "")
    optional = lambda t: ["null", t]
    reader = record(("c", optional({"type": "array", "items": optional("double")})), ("new", optional("string"), None), ("a", optional("double")), ("kept", "long", 7))
    reader = reader[:-2] + ', {"name": "bytes", "aliases": ["b"], "type": ["null", "bytes"]}]}'
    sent = df.select(avro_codec.avro_payload(df, writer).alias("v"))
    rows = [r[0].asDict() for r in sent.select(avro_codec.avro_decoded(F.col("v"), writer, reader)).collect()]
    assert rows == [{"c": [1.0, None], "new": None, "a": 1.0, "kept": 7, "bytes": b"x"}, {"c": None, "new": None, "a": None, "kept": 7, "bytes": None}]
    jvm = spark._jvm
    parse = lambda s: jvm.org.apache.avro.Schema.Parser().parse(s)
    for r, own in zip(sent.collect(), rows):
        decoder = jvm.org.apache.avro.io.DecoderFactory.get().binaryDecoder(bytes(r.v), None)
        said = jvm.org.apache.avro.generic.GenericDatumReader(parse(writer), parse(reader.replace('"aliases": ["b"], "type": ["null", "bytes"]', '"type": ["null", "bytes"], "default": null'))).read(None, decoder)
        assert (said.get("a"), said.get("kept"), said.get("c") is None) == (own["a"], 7, own["c"] is None)
    one = lambda kind: record(("a", kind))
    decode = lambda w, r: spark.range(1).select(F.lit(b"\x02").alias("v")).select(avro_codec.avro_decoded(F.col("v"), w, r)["a"]).first()[0]
    assert decode(one("int"), one("double")) == 1.0 and decode(one("long"), one(optional("long"))) == 1
    for w, r in (("double", "long"), ("string", "long"), ("long", "boolean"), ({"type": "array", "items": "long"}, "long"), ("long", {"type": "array", "items": "long"})):
        with pytest.raises(TypeError):
            avro_codec.plan_fields(json.loads(one(w))["fields"], json.loads(one(r))["fields"])
    with pytest.raises(TypeError):
        avro_codec.plan_fields([], json.loads(one("long"))["fields"])
    nulls = spark.createDataFrame([(b"\x00",)], "v binary").select(avro_codec.avro_decoded(F.col("v"), one(optional("long")), one("long")))
    assert "null for a field" in failing(nulls)


def test_schema_fingerprints_match_the_java_library(spark, wide):
    parser = lambda s: spark._jvm.org.apache.avro.Schema.Parser().parse(s)
    for schema in (avro_codec.avro_schema(wide.schema, "T"), avro_codec.avro_schema(wide.schema, "T", ""), record(("ü", "long", 3)), '"null"'):
        theirs = spark._jvm.org.apache.avro.SchemaNormalization.parsingFingerprint64(parser(schema))
        assert avro_codec.fingerprint(schema) == f"{theirs % (1 << 64):016x}"


def test_long_arrays_of_many_rows(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 5 != 0, F.sequence(F.lit(0).cast("long"), F.col("id") % 70)).alias("xs"), F.transform(F.sequence(F.lit(1), (F.col("id") % 3).cast("int") + 1), lambda i: F.when(i != 2, F.concat(F.lit("s"), i))).alias("ss"))
    schema = avro_codec.avro_schema(df.schema, "T")
    back = df.select(avro_codec.avro_payload(df, schema).alias("v"), "xs", "ss").select(avro_codec.avro_decoded(F.col("v"), schema).alias("r"), "xs", "ss")
    assert back.where(~F.col("r.xs").eqNullSafe(F.col("xs")) | ~F.col("r.ss").eqNullSafe(F.col("ss"))).count() == 0


def test_avro_keeps_nan_apart_from_null(spark):
    df = spark.createDataFrame([(math.nan,), (None,), (math.inf,)], "d double")
    schema = avro_codec.avro_schema(df.schema, "T")
    back = [r[0] for r in df.select(avro_codec.avro_payload(df, schema).alias("v")).select(avro_codec.avro_decoded(F.col("v"), schema)["d"]).collect()]
    assert math.isnan(back[0]) and back[1:] == [None, math.inf]


def test_converters():
    assert all(hasattr(codecs.load(n), "encode") for n in ("json", "avro", "rowtide.functions.json_codec.JsonConverter"))
    for bad in ("no.such.Thing", "json.JSONDecoder", "rowtide.functions.codecs.missing", "x"):
        with pytest.raises(ValueError):
            codecs.load(bad)


def test_fingerprint_published_values():
    assert hashing.fingerprint64(b"1footrue") == -1541654101129638711
    assert hashing.fingerprint64(b"2applefalse") == 2794438866806483259
    assert hashing.fingerprint64(b"3true") == -4880158226897771312


def test_fingerprint_column(spark):
    rng = random.Random(1)
    values = [None, "", *("".join(chr(rng.randrange(97, 123)) for _ in range(n)) for n in (1, 3, 4, 8, 16, 17, 32, 33, 64, 65, 128, 500))]
    found = spark.createDataFrame([(v,) for v in values], "s string").select(hashing.farm_fingerprint(F.col("s"))).collect()
    assert [r[0] for r in found] == [None if v is None else hashing.fingerprint64(v.encode()) for v in values]


def test_bucket_names_agree(spark):
    moments = [dt.datetime(2019, 12, 28) + dt.timedelta(hours=7 * k) for k in range(1300)]
    df = spark.createDataFrame([(m,) for m in moments], "t timestamp_ntz")
    rows = df.select("t", *[bucket_text(F.col("t"), b).alias(b) for b in BUCKETS]).collect()
    for r in rows:
        for b, bucket in BUCKETS.items():
            assert r[b] == bucket.name_of(r.t), (r.t, b)


def test_cached_shard_id():
    c, t = CachedShardId("HOUR_OF_DAY", encoded=False), dt.datetime(2024, 1, 1, 5, 59, 59)
    assert c.should_refresh(t) and c.value(t) == "05" and not c.should_refresh(t) and c.should_refresh(t + dt.timedelta(seconds=1))
