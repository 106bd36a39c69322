"""Scalar functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def strip_stress(x: Column) -> Column:
    """Without one trailing digit 0-9 (digits of other scripts stay)."""
    return F.regexp_replace(x, "[0-9]$", "")


def hz_to_erb(f: Column) -> Column:
    return F.lit(9.265) * F.ln(1 + f / F.lit(24.7 * 9.265))


def erb_to_hz(e: Column) -> Column:
    return F.lit(24.7 * 9.265) * (F.exp(e / F.lit(9.265)) - 1)


def hz_to_erb_ferret(f: Column) -> Column:
    return F.lit((1 / 0.31) * (1 / (1 - 0.533))) * F.pow(f / 1000, F.lit(1 - 0.533))


def erb_to_hz_ferret(e: Column) -> Column:
    return F.pow(e * F.lit(0.31 * (1 - 0.533)), F.lit(1 / (1 - 0.533))) * 1000


def data_hash(x: Column) -> Column:
    """MD5 of a value's text."""
    return F.md5(x.cast("string").cast("binary"))


def to_text(x: Column, hash_len: int | None = None) -> Column:
    """A value's text, NULL for null, an empty text, the number 0 and false; texts over hash_len characters become the start of their hash."""
    text = x.cast("string")
    zero = F.when(F.typeof(x) == "string", text == "").when(F.typeof(x) == "boolean", text == "false").otherwise(text.rlike(r"^-?0(\.0*)?(E-?\d+)?$"))
    s = F.when(x.isNull() | zero, F.lit("NULL")).otherwise(text)
    return s if hash_len is None else F.when(F.char_length(s) > hash_len, F.substring(data_hash(x), 1, hash_len)).otherwise(s)


def list_to_text(x: Column, delimiter: str = "-", hash_len: int | None = None) -> Column:
    """An array's elements joined; NULL for null or empty arrays."""
    s = F.when(x.isNull() | (F.size(x) == 0), F.lit("NULL")).otherwise(F.array_join(F.transform(x, lambda v: v.cast("string")), delimiter))
    return s if hash_len is None else F.when(F.char_length(s) > hash_len, F.substring(F.md5(s.cast("binary")), 1, hash_len)).otherwise(s)


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def round8(x: Column) -> Column:
    """Eight decimals, halves to even."""
    return F.bround(x, 8)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def frame_times(n: Column, hop: int = 320) -> Column:
    """n frame times in samples: -0.5, hop - 0.5, ..."""
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: i * F.lit(float(hop)) - 0.5)).otherwise(F.array().cast("array<double>"))


def root_mean_square(level: float, x: Column) -> Column:
    """An array scaled to a root mean square of ``level``; silence stays."""
    power = F.sqrt(dot(x, x) / F.size(x))
    return F.when(power == 0, x).otherwise(F.transform(x, lambda v: v * F.lit(level) / F.when(power == 0, F.lit(1.0)).otherwise(power)))
