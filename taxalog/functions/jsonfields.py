"""Removal of high-cardinality top-level fields from JSON log lines.

The JVM decides which rows can be affected at all; only those reach Python,
because a strict parser is needed: trailing text must count as "not JSON",
duplicate keys keep the last value, and the output is re-serialized with sorted
keys and double-precision numbers.
"""

from __future__ import annotations

import json
import math
import re
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from taxalog.functions.text import trim_space

# The fields removed by default.
DEFAULT_STRIP_FIELDS = (
    "trace_id", "span_id", "request_id", "x_request_id",
    "correlation_id", "dd.trace_id", "dd.span_id",
)

# Characters that are printed as escapes; a lone surrogate cannot be printed at all.
_UNSAFE = re.compile("[<>&\\u2028\\u2029\\ud800-\\udfff]")


def _number(text: str) -> float:
    value = float(text)
    if math.isinf(value):
        raise ValueError(text)
    return value


def _reject(name: str):
    raise ValueError(name)


def _number_text(value: float) -> str:
    """Plain decimals between 1e-6 and 1e21, exponents outside."""
    if value and not 1e-6 <= abs(value) < 1e21:
        return repr(value).replace("e-0", "e-")
    text = format(Decimal(repr(value)), "f")
    return text.rstrip("0").rstrip(".") if "." in text else text


def _string_text(value: str) -> str:
    return _UNSAFE.sub(lambda m: "\ufffd" if m[0] >= "\ud800" else f"\\u{ord(m[0]):04x}",
                       json.dumps(value, ensure_ascii=False))


def _dump(value) -> str:
    if isinstance(value, str):
        return _string_text(value)
    if isinstance(value, float):
        return _number_text(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{_string_text(k)}:{_dump(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_dump, value)) + "]"
    return json.dumps(value)


def strip_one(text: str, fields) -> str | None:
    """The shortened object, or None when the text stays as it is."""
    try:
        record = json.loads(text, parse_int=_number, parse_float=_number, parse_constant=_reject)
    except (ValueError, RecursionError):
        return None
    if not isinstance(record, dict) or not any(f in record for f in fields):
        return None
    for field in fields:
        record.pop(field, None)
    return _dump(record)


def strip_fields(raw: Column, fields=None) -> Column:
    fields = tuple(DEFAULT_STRIP_FIELDS if fields is None else fields)
    if not fields:
        return raw

    @F.pandas_udf("string")
    def shortened(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else strip_one(t, fields))

    quoted = "|".join(re.escape(json.dumps(f, ensure_ascii=False)) for f in fields)
    trimmed = trim_space(raw)
    # A key may also be written with \u escapes, hence the second alternative.
    candidate = raw.rlike(r"(?U)^\s*\{") & raw.rlike(quoted + r"|\\u")
    return F.coalesce(shortened(F.when(candidate, trimmed)), raw)
