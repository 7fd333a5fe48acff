"""Canonical JSON: one text for equal values, so that hashes of it are identities.

Members go by code points of their names, numbers are written as ECMAScript writes doubles, strings with its escapes;
numbers that aren't finite are refused. Standard library encoders differ in all three, hence this one.
"""

from __future__ import annotations

import hashlib
import json
import math

import pyarrow as pa
from pyspark.sql import DataFrame

_SHORT = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r", 34: '\\"', 92: "\\\\"}


def number_text(x: int | float) -> str:
    """A number as ECMAScript prints it: shortest digits, exponents only from 1e21 up and below 1e-6."""
    x = float(x)
    if not math.isfinite(x):
        raise ValueError("numbers must be finite")
    if x == 0:
        return "0"
    digits, _, exponent = repr(abs(x)).partition("e")
    whole, _, fraction = digits.partition(".")
    if fraction == "0":
        fraction = ""
    point = len(whole) + int(exponent or 0)
    all_ = (whole + fraction).lstrip("0")
    point -= len(whole + fraction) - len((whole + fraction).lstrip("0"))
    all_ = all_.rstrip("0") or "0"
    n = len(all_)
    sign = "-" if x < 0 else ""
    if n <= point <= 21:
        return sign + all_ + "0" * (point - n)
    if 0 < point <= 21:
        return sign + all_[:point] + "." + all_[point:]
    if -6 < point <= 0:
        return sign + "0." + "0" * -point + all_
    e = point - 1
    return f"{sign}{all_[0]}{'.' + all_[1:] if n > 1 else ''}e{'+' if e > 0 else '-'}{abs(e)}"


def string_text(s: str) -> str:
    out = ['"']
    for ch in s:
        o = ord(ch)
        out.append(_SHORT[o] if o in _SHORT else f"\\u{o:04x}" if o < 32 or 0xD800 <= o < 0xE000 else ch)
    return "".join(out) + '"'


def canonical_json(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        return number_text(v)
    if isinstance(v, str):
        return string_text(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(canonical_json, v)) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{string_text(k)}:{canonical_json(v[k])}" for k in sorted(v)) + "}"
    raise TypeError(f"no canonical JSON for {type(v).__name__}")


def canonical_hash(v) -> str:
    return hashlib.sha256(canonical_json(v).encode("utf8", "surrogatepass")).hexdigest()


def loads_doubles(text: str):
    """JSON with every number as a double, the only kind ECMAScript has."""
    return json.loads(text, parse_int=float)


def canonical_column(df: DataFrame, key: str, raw: str) -> DataFrame:
    """key, canonical and its SHA-256 for each text that is whole JSON; others give no row."""

    def go(batches):
        for b in batches:
            rows = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    c = canonical_json(loads_doubles(t))
                except (ValueError, TypeError, RecursionError):
                    continue
                rows.append((k, c, hashlib.sha256(c.encode("utf8", "surrogatepass")).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], b.column(0).type), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], names=[key, "canonical", "hash"])

    return df.select(key, raw).mapInArrow(go, f"{key} {dict(df.dtypes)[key]}, canonical string, hash string")
