"""Canonical forms of nested values and their digests; the protocol of seals and chains."""

from __future__ import annotations

import hashlib
import hmac
import json
import unicodedata
from fractions import Fraction
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VERSION = "2"


def _text(value: str) -> str:
    return unicodedata.normalize("NFC", value.replace("\r\n", "\n").replace("\r", "\n"))


def float8(value: float) -> str:
    """Eight decimals of the exact binary value; one zero, nan and infinities by name."""
    return f"{value + 0.0:.8f}" if abs(value) < float("inf") else {True: "nan", False: "inf" if value > 0 else "-inf"}[value != value]


def canonical(value: Any, version: str = VERSION) -> Any:
    """The canonical form: scalars as tagged text, keys sorted. Version 1 leaves strings as they are and writes unknown types as text."""
    kind = type(value)
    if isinstance(value, dict):
        return {key: canonical(value[key], version) for key in sorted(value)}
    if isinstance(value, list | tuple):
        return [canonical(item, version) for item in value]
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, int):
        return f"{value}:int"
    if isinstance(value, float):
        return float8(value)
    if isinstance(value, str):
        return value if version == "1" else "s:" + _text(value)
    if version == "1":
        return str(value)
    if isinstance(value, Fraction):
        return f"{value.numerator}/{value.denominator}:frac"
    raise TypeError(f"no canonical form for {kind.__name__}")


def digest(value: Any, version: str = VERSION) -> str:
    return hashlib.sha256(json.dumps(canonical(value, version), sort_keys=True).encode()).hexdigest()


def entry_digest(seq: int, previous: str, payload: dict, version: str = VERSION) -> str:
    """Digest of a chain entry: what it says, its number and the digest before it."""
    return digest({**payload, "seq": seq, "prev_hash": previous}, version)


def keyed(key: bytes, text: str) -> str:
    return hmac.new(key, text.encode(), "sha256").hexdigest()


def analysis_digest(value: Any) -> str:
    """Digest of an analysis: raw values, compact separators, characters unescaped."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def arguments_digest(arguments: Any) -> str:
    """Digest of a call's arguments: keys sorted, characters escaped, unknown types as text; none count as an empty object."""
    return hashlib.sha256(json.dumps(arguments or {}, sort_keys=True, default=str).encode()).hexdigest()


def strict_json(text: str | None) -> Any:
    """JSON without repeated keys and without NaN or infinities."""

    def pairs(items: list[tuple[str, Any]]) -> dict:
        out = dict(items)
        if len(out) < len(items):
            raise ValueError("repeated key")
        return out

    def constant(name: str) -> Any:
        raise ValueError(f"{name} is not JSON")

    return json.loads(text, object_pairs_hook=pairs, parse_constant=constant)


def digest_udf(version: str = VERSION):
    """Digest of a JSON text's value; null where it isn't strict JSON."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(text):
            try:
                return digest(strict_json(text), version)
            except (ValueError, TypeError, RecursionError):
                return None

        return texts.map(one)

    return run


def entry_udf(version: str = VERSION):
    """Digest of chain entries from number, previous digest and payload as JSON."""

    @F.pandas_udf("string")
    def run(seq: pd.Series, previous: pd.Series, payload: pd.Series) -> pd.Series:
        return pd.Series([entry_digest(int(s), p, strict_json(t), version) for s, p, t in zip(seq, previous, payload, strict=True)], dtype=object)

    return run


def hmac_udf(key: bytes):
    """HMAC of a text; the key stays out of the plan."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else keyed(key, t))

    return run


def nfc_udf():
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else _text(t))

    return run


def float8_udf():
    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: float8(float(v)))

    return run


def escape_udf():
    """Control, format, private and unassigned characters as escapes."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(text):
            return None if text is None else "".join(c.encode("unicode_escape").decode() if unicodedata.category(c)[0] == "C" else c for c in text)

        return texts.map(one)

    return run


def flat_canonical(**fields: Column) -> Column:
    """The canonical JSON of a flat record of ASCII strings (STRING) and whole numbers, built by SQL; null is the null tag."""
    parts = []
    for name in sorted(fields):
        value = fields[name]
        parts += [F.lit(("" if not parts else ", ") + json.dumps(name) + ': "'), F.coalesce(value, F.lit("null")), F.lit('"')]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def text_tag(value: Column) -> Column:
    """Tag of an ASCII string, with JSON's escapes."""
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "\r\n?", "\n"), r"\\", r"\\\\"), '"', r'\\"')
    return F.concat(F.lit("s:"), F.regexp_replace(F.regexp_replace(clean, "\n", r"\\n"), "\t", r"\\t"))


def int_tag(value: Column) -> Column:
    return F.concat(value.cast("string"), F.lit(":int"))
