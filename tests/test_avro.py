import json

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemill.sources.avro import Codec, Registry, avro_to_json, encoded, framed
from tidemill.sources.readers import wire_payload

KEY = {"type": "record", "name": "key", "fields": [{"name": "id", "type": "long"}]}
SCHEMA = {
    "type": "record", "name": "order",
    "fields": [
        {"name": "key", "type": KEY}, {"name": "again", "type": ["null", "key"]}, {"name": "flag", "type": "boolean"}, {"name": "amount", "type": "double"},
        {"name": "note", "type": ["null", "string"], "default": None}, {"name": "kind", "type": {"type": "enum", "name": "kind", "symbols": ["personal", "group"]}},
        {"name": "tags", "type": {"type": "array", "items": "string"}}, {"name": "counts", "type": {"type": "map", "values": "long"}}, {"name": "at", "type": {"type": "long", "logicalType": "timestamp-millis"}},
    ],
}
LONG = st.integers(-(2**63), 2**63 - 1)
RECORD = st.fixed_dictionaries({
    "key": st.fixed_dictionaries({"id": LONG}), "again": st.none() | st.fixed_dictionaries({"id": LONG}), "flag": st.booleans(), "amount": st.floats(allow_nan=False), "note": st.none() | st.text(),
    "kind": st.sampled_from(["personal", "group"]), "tags": st.lists(st.text(max_size=5), max_size=4), "counts": st.dictionaries(st.text(max_size=4), LONG, max_size=4), "at": LONG,
})


@given(RECORD)
def test_round_trip(record):
    codec = Codec(json.dumps(SCHEMA))
    data = codec.encode(record)
    assert codec.decode(data) == record
    for broken in (data[:-1], data + b"x"):
        with pytest.raises(ValueError):
            codec.decode(broken)


def test_bytes_of_the_specification():
    assert Codec("long").encode(-64) == b"\x7f" and Codec("long").encode(64) == b"\x80\x01" and Codec("string").encode("foo") == b"\x06foo"
    assert Codec(["null", "string"]).encode("a") == b"\x02\x02a" and Codec({"type": "array", "items": "long"}).encode([3, 27]) == b"\x04\x06\x36\x00"
    assert Codec({"type": "array", "items": "long"}).decode(b"\x03\x04\x06\x36\x00") == [3, 27]  # a block with its size in bytes
    for schema, bad in (("int", "x"), (["null", "long"], "x"), ({"type": "enum", "name": "e", "symbols": ["a"]}, 3)):
        with pytest.raises(ValueError):
            Codec(schema).encode(bad)
    assert framed(7, b"ab") == b"\x00\x00\x00\x00\x07ab"


def test_registry_asks_for_versions():
    asked = []

    def fetch(url):
        asked.append(url)
        return json.dumps({"schema": f"schema {url[-1]}"})

    assert Registry("http://r.example/", fetch).versions("orders-value") == [(2, "schema 2"), (1, "schema 1")]
    assert asked == ["http://r.example/subjects/orders-value/versions/2", "http://r.example/subjects/orders-value/versions/1"]


def test_columns(spark):
    schema = json.dumps({"type": "record", "name": "r", "fields": [{"name": "a", "type": "long"}, {"name": "b", "type": ["null", "string"]}]})
    rows = spark.createDataFrame([(1, "x"), (2, None)], "a bigint, b string")
    sent = encoded(rows, schema, 9).unionByName(spark.createDataFrame([(bytearray(b"\x00\x00\x00\x00\x09\x02"),), (None,)], "value binary"))
    got = [r[0] for r in sent.select(avro_to_json(wire_payload(F.col("value")), schema)).collect()]
    assert [json.loads(x) if x else None for x in got] == [{"a": 1, "b": "x"}, {"a": 2, "b": None}, None, None]
