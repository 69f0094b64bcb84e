"""Canonical JSON, its digests, strict JSON reading, and exact seconds."""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Callable
from datetime import datetime
from decimal import Decimal
from fractions import Fraction
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

UTC_TEXT = re.compile(r"(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})(\.\d+)?Z")


def exact_seconds(text: str) -> Fraction:
    whole, part = UTC_TEXT.fullmatch(text).groups()
    since = datetime.fromisoformat(whole) - datetime(1970, 1, 1)
    return since.days * 86400 + since.seconds + Fraction(part or "0")


def canonical_json(value: Any) -> str:
    """Sorted keys, no blanks, UTF-8, shortest doubles; raises ValueError for NaN and infinities."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def digest(value: Any) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def without_nulls(value: Any) -> Any:
    """Absent rather than null members."""
    if isinstance(value, dict):
        return {k: without_nulls(v) for k, v in value.items() if v is not None}
    return [without_nulls(v) for v in value] if isinstance(value, list) else value


def _float(text: str) -> float:
    number = float(text)
    if not math.isfinite(number) or (number == 0 and Decimal(text) != 0):
        raise ValueError(f"a double can't hold {text}")
    return number


def _members(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    names = [k for k, _ in pairs]
    if len(names) != len({*names}):
        raise ValueError("a repeated member")
    return dict(pairs)


def _constant(name: str) -> float:
    raise ValueError(f"{name} is no JSON number")


def strict_load(text: str) -> Any:
    """JSON without repeated members, NaN, infinities, overflow, underflow to 0 and lone surrogates; ValueError otherwise."""
    value = json.loads(text, parse_float=_float, parse_constant=_constant, object_pairs_hook=_members)
    canonical_json(value).encode()
    return value


def _rowwise(f: Callable[[Any], Any]) -> Callable[[pa.Array], pa.Array]:
    return lambda values: pa.array([None if v is None else f(v) for v in values.to_pylist()], pa.string())


def canonical_json_of(value: Column) -> Column:
    """Canonical JSON of a struct column, null members left out."""
    return F.arrow_udf(_rowwise(lambda v: canonical_json(without_nulls(v))), "string")(value)


def digest_of(value: Column) -> Column:
    return F.sha2(canonical_json_of(value), 256)


def value_digest(value: Any) -> str:
    """The same digest of a Python value."""
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def strict_json_code(text: Column) -> Column:
    """Null for JSON that ``strict_load`` reads, else its complaint."""

    def complaint(value: str) -> str | None:
        try:
            strict_load(value)
        except (ValueError, RecursionError) as problem:
            return str(problem) or "not JSON"
        return None

    return F.arrow_udf(_rowwise(complaint), "string")(text)
