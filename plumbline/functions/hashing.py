"""Fingerprints, hash buckets and signatures."""

from __future__ import annotations

import hashlib
import hmac as _hmac
import json
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def fingerprint(kind: Column, text: Column) -> Column:
    """kind:16 hex digits of SHA-256."""
    return F.concat(kind, F.lit(":"), F.substring(F.sha2(text, 256), 1, 16))


def hash_number(text: Column) -> Column:
    """The first 32 bits of SHA-256 as a number."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")


def hash_bucket(text: Column, n: int) -> Column:
    return hash_number(text) % n


def rotated(position: Column, worker: Column, n: Column) -> Column:
    """Position of a plan entry for a worker whose plan starts at its own offset."""
    return F.pmod(position - F.pmod(hash_number(worker), n), n)


def canonical(value: Any) -> Any:
    """Keys and sequences sorted by their compact JSON form, at every level."""
    if isinstance(value, dict):
        return {k: canonical(value[k]) for k in sorted(value)}
    if isinstance(value, (list, tuple, set, frozenset)):
        return sorted((canonical(v) for v in value), key=lambda v: json.dumps(v, sort_keys=True, ensure_ascii=False, separators=(",", ":")))
    return value


def canonical_json(value: Any) -> bytes:
    """Compact UTF-8 JSON of the canonical value; NaN is an error."""
    return json.dumps(canonical(value), sort_keys=True, ensure_ascii=False, separators=(",", ":"), allow_nan=False).encode()


def signature(key: bytes):
    """A Pandas UDF: HMAC-SHA-256 of a text column."""

    @F.pandas_udf("string")
    def sign(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else _hmac.new(key, x.encode(), hashlib.sha256).hexdigest())

    return sign
