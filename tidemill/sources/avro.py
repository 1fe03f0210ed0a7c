"""Avro records in messages: schemas, binary form, a registry client, and decoding by versions.

A message is a magic byte 0, the four-byte id of its schema, and the record in Avro's binary form.  The forms read and
written here are those of the public specification: null, boolean, int, long, float, double, bytes, string, records,
enumerations, arrays, maps, fixed and unions; logical types keep their underlying value.

Defined results: bytes that end early or are left over do not decode under that schema; null messages decode under none.
"""

from __future__ import annotations

import base64
import json
import struct
import urllib.request
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

MAGIC = 0


def _read_long(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return (value >> 1) ^ -(value & 1), at
        shift += 7
        if shift > 63:
            raise ValueError("number too long")


def _long(value: int) -> bytes:
    value = (value << 1) ^ (value >> 63)
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def _take(data: bytes, at: int, size: int) -> tuple[bytes, int]:
    if size < 0 or at + size > len(data):
        raise ValueError("record ends early")
    return data[at : at + size], at + size


class Codec:
    """Reader and writer of one schema."""

    def __init__(self, schema: str | dict | list) -> None:
        self.schema = json.loads(schema) if isinstance(schema, str) and schema.lstrip()[:1] in ("{", "[") else schema
        self.names: dict[str, dict] = {}
        self._collect(self.schema)

    def _collect(self, schema) -> None:
        if isinstance(schema, list):
            for one in schema:
                self._collect(one)
        elif isinstance(schema, dict):
            if "name" in schema:
                self.names[schema["name"]] = schema
            for inner in [f["type"] for f in schema.get("fields", [])] + [schema[k] for k in ("items", "values") if k in schema]:
                self._collect(inner)
            if isinstance(schema.get("type"), (dict, list)):
                self._collect(schema["type"])

    def decode(self, data: bytes):
        try:
            value, at = self._read(self.schema, data, 0)
        except (IndexError, struct.error, UnicodeDecodeError) as error:
            raise ValueError("not a record of this schema") from error
        if at != len(data):
            raise ValueError("bytes are left over")
        return value

    def _read(self, schema, data: bytes, at: int):
        if isinstance(schema, list):
            branch, at = _read_long(data, at)
            if not 0 <= branch < len(schema):
                raise ValueError("no such branch of a union")
            return self._read(schema[branch], data, at)
        kind = schema["type"] if isinstance(schema, dict) else schema
        if isinstance(kind, (dict, list)):
            return self._read(kind, data, at)
        if kind in self.names and not isinstance(schema, dict):
            return self._read(self.names[kind], data, at)
        if kind == "null":
            return None, at
        if kind == "boolean":
            byte, at = _take(data, at, 1)
            if byte[0] > 1:
                raise ValueError("not a truth value")
            return bool(byte[0]), at
        if kind in ("int", "long"):
            return _read_long(data, at)
        if kind in ("float", "double"):
            raw, at = _take(data, at, 4 if kind == "float" else 8)
            return struct.unpack("<f" if kind == "float" else "<d", raw)[0], at
        if kind in ("bytes", "string"):
            size, at = _read_long(data, at)
            raw, at = _take(data, at, size)
            return (raw.decode() if kind == "string" else base64.b64encode(raw).decode()), at
        if kind == "fixed":
            raw, at = _take(data, at, schema["size"])
            return base64.b64encode(raw).decode(), at
        if kind == "enum":
            number, at = _read_long(data, at)
            if not 0 <= number < len(schema["symbols"]):
                raise ValueError("no such symbol")
            return schema["symbols"][number], at
        if kind == "record":
            out = {}
            for field in schema["fields"]:
                out[field["name"]], at = self._read(field["type"], data, at)
            return out, at
        if kind in ("array", "map"):
            out = [] if kind == "array" else {}
            while True:
                count, at = _read_long(data, at)
                if count == 0:
                    return out, at
                if count < 0:
                    count, (_, at) = -count, _read_long(data, at)
                if count > len(data):
                    raise ValueError("record ends early")
                for _ in range(count):
                    if kind == "array":
                        value, at = self._read(schema["items"], data, at)
                        out.append(value)
                    else:
                        name, at = self._read("string", data, at)
                        out[name], at = self._read(schema["values"], data, at)
        raise ValueError(f"unknown type {kind!r}")

    def encode(self, value) -> bytes:
        return self._write(self.schema, value)

    def _fits(self, schema, value) -> bool:
        kind = schema["type"] if isinstance(schema, dict) else schema
        if kind in self.names and not isinstance(schema, dict):
            kind = self.names[kind]["type"]
        if kind == "null" or value is None:
            return kind == "null" and value is None
        if isinstance(value, bool):
            return kind == "boolean"
        kinds = {int: ("int", "long", "float", "double"), float: ("float", "double"), str: ("string", "enum"), bytes: ("bytes", "fixed"), dict: ("record", "map"), list: ("array",)}
        return kind in kinds.get(type(value), ())

    def _write(self, schema, value) -> bytes:
        if isinstance(schema, list):
            for branch, one in enumerate(schema):
                if self._fits(one, value):
                    return _long(branch) + self._write(one, value)
            raise ValueError(f"{value!r} fits no branch")
        kind = schema["type"] if isinstance(schema, dict) else schema
        if isinstance(kind, (dict, list)):
            return self._write(kind, value)
        if kind in self.names and not isinstance(schema, dict):
            return self._write(self.names[kind], value)
        if not self._fits(schema, value):
            raise ValueError(f"{value!r} is no {kind}")
        if kind == "null":
            return b""
        if kind == "boolean":
            return bytes([value])
        if kind in ("int", "long"):
            return _long(value)
        if kind in ("float", "double"):
            return struct.pack("<f" if kind == "float" else "<d", value)
        if kind in ("string", "bytes"):
            raw = value.encode() if kind == "string" else value
            return _long(len(raw)) + raw
        if kind == "fixed":
            return value
        if kind == "enum":
            return _long(schema["symbols"].index(value))
        if kind == "record":
            return b"".join(self._write(f["type"], value.get(f["name"], f.get("default"))) for f in schema["fields"])
        items = [self._write(schema["items"], v) for v in value] if kind == "array" else [self._write("string", k) + self._write(schema["values"], v) for k, v in value.items()]
        return (_long(len(items)) + b"".join(items) if items else b"") + _long(0)


def framed(schema_id: int, record: bytes) -> bytes:
    """A record with the header of its message."""
    return struct.pack(">bI", MAGIC, schema_id) + record


def http_fetch(url: str) -> str:
    with urllib.request.urlopen(url, timeout=30) as answer:  # noqa: S310
        return answer.read().decode()


class Registry:
    """Schemas of subjects by version, over a registry's REST interface; ``fetch`` gets a URL and gives the answer's text."""

    def __init__(self, url: str, fetch: Callable[[str], str] = http_fetch) -> None:
        self.url, self.fetch = url.rstrip("/"), fetch

    def schema(self, subject: str, version: int | str = "latest") -> str:
        return json.loads(self.fetch(f"{self.url}/subjects/{subject}/versions/{version}"))["schema"]

    def versions(self, subject: str, wanted: tuple[int, ...] = (2, 1)) -> list[tuple[int, str]]:
        """(version, schema), newest first, once per run on the driver."""
        return [(v, self.schema(subject, v)) for v in wanted]


@lru_cache(maxsize=256)
def _codec(schema: str) -> Codec:
    return Codec(schema)


def avro_to_json(payload: Column, schema: str) -> Column:
    """Records as JSON text, null where the bytes are none of this schema; in Arrow batches."""

    @F.pandas_udf(StringType())
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _codec(schema)
        for part in parts:
            out = []
            for data in part:
                try:
                    out.append(None if data is None else json.dumps(codec.decode(bytes(data)), ensure_ascii=False))
                except ValueError:
                    out.append(None)
            yield pd.Series(out, dtype=object)

    return run(payload)


def encoded(rows: DataFrame, schema: str, schema_id: int) -> DataFrame:
    """Rows (columns named as the schema's fields) as framed messages, column ``value``; for producers and tests."""
    names = rows.columns

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = _codec(schema)
        for part in parts:
            yield pd.DataFrame({"value": [framed(schema_id, codec.encode(json.loads(text))) for text in part["_json"]]})

    return rows.select(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("_json")).mapInPandas(run, "value binary")
