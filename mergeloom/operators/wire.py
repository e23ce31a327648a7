"""Values and state as self-describing bytes.

Twelve bytes of header (magic, version, kind, flags, length of the body), then
the value with a tag before each part; the body may be compressed.
"""

from __future__ import annotations

import json
import struct
import zlib
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

HEADER = struct.Struct(">4sHBBI")
MAGIC, VERSION, COMPRESSED = b"MLWV", 1, 1
KINDS = {"value": 0, "counter": 1, "register": 2, "set": 3, "map": 4, "clock": 5, "delta": 6, "sketch": 7}


class WireError(ValueError):
    pass


def _put(x: Any) -> bytes:
    if x is None:
        return b"n"
    if isinstance(x, bool):
        return b"T" if x else b"F"
    if isinstance(x, int):
        if -128 <= x < 128:
            return b"b" + struct.pack(">b", x)
        if not -(2**63) <= x < 2**63:
            raise WireError("a whole number has 64 bits at most")
        return b"i" + struct.pack(">q", x)
    if isinstance(x, float):
        return b"d" + struct.pack(">d", x)
    if isinstance(x, str):
        data = x.encode()
        return b"s" + struct.pack(">I", len(data)) + data
    if isinstance(x, (bytes, bytearray)):
        return b"y" + struct.pack(">I", len(x)) + bytes(x)
    if isinstance(x, (list, tuple)):
        return b"l" + struct.pack(">I", len(x)) + b"".join(map(_put, x))
    if isinstance(x, (set, frozenset)):
        return b"e" + struct.pack(">I", len(x)) + b"".join(sorted(map(_put, x)))
    if isinstance(x, dict):
        return b"m" + struct.pack(">I", len(x)) + b"".join(_put(k) + _put(v) for k, v in sorted(x.items(), key=lambda i: _put(i[0])))
    raise WireError(f"no form for {type(x).__name__}")


def _get(data: bytes, at: int) -> tuple[Any, int]:
    try:
        tag, at = data[at : at + 1], at + 1
        if tag in (b"n", b"T", b"F"):
            return {b"n": None, b"T": True, b"F": False}[tag], at
        if tag in (b"b", b"i", b"d"):
            form = {b"b": ">b", b"i": ">q", b"d": ">d"}[tag]
            return struct.unpack_from(form, data, at)[0], at + struct.calcsize(form)
        (n,), at = struct.unpack_from(">I", data, at), at + 4
        if tag in (b"s", b"y"):
            if at + n > len(data):
                raise WireError("the value is cut off")
            return (data[at : at + n].decode() if tag == b"s" else data[at : at + n]), at + n
        if tag in (b"l", b"e"):
            items = []
            for _ in range(n):
                x, at = _get(data, at)
                items.append(x)
            return (items if tag == b"l" else set(items)), at
        if tag == b"m":
            out = {}
            for _ in range(n):
                k, at = _get(data, at)
                out[k], at = _get(data, at)
            return out, at
    except struct.error as e:
        raise WireError("the value is cut off") from e
    raise WireError(f"unknown tag {tag!r}")


def serialize(value: Any, kind: str = "value", compress: bool = False) -> bytes:
    body = _put(value)
    if compress:
        body = zlib.compress(body)
    return HEADER.pack(MAGIC, VERSION, KINDS[kind], COMPRESSED * compress, len(body)) + body


def peek(data: bytes) -> dict:
    """Kind, version, compression and size, from the header alone."""
    if len(data) < HEADER.size:
        raise WireError("the header is cut off")
    magic, version, kind, flags, n = HEADER.unpack_from(data)
    if magic != MAGIC or version != VERSION or kind not in KINDS.values():
        raise WireError("not of this form")
    return {"kind": next(k for k, v in KINDS.items() if v == kind), "version": version, "compressed": bool(flags & COMPRESSED), "size": HEADER.size + n}


def deserialize(data: bytes) -> Any:
    head = peek(data)
    if len(data) != head["size"]:
        raise WireError("the body has another length")
    try:
        body = zlib.decompress(data[HEADER.size :]) if head["compressed"] else data[HEADER.size :]
    except zlib.error as e:
        raise WireError("the body is damaged") from e
    value, at = _get(body, 0)
    if at != len(body):
        raise WireError("bytes are left over")
    return value


def _to(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else serialize(json.loads(x), compress=True))


def _from(data: pd.Series) -> pd.Series:
    return data.map(lambda x: None if x is None else json.dumps(deserialize(bytes(x)), default=list))


def to_wire(value: Column) -> Column:
    """A struct, map or array as compressed bytes, by Arrow batches."""
    return F.pandas_udf(_to, "binary")(F.to_json(value))


def from_wire(data: Column, schema: str) -> Column:
    """Bytes back as a column of the type ``schema``."""
    return F.from_json(F.pandas_udf(_from, "string")(data), schema)
