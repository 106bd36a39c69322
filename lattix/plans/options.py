"""Options as key and value lists, and the strings that name results by them. Configuration, not data: all on the driver."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field


def data_hash(x: object) -> str:
    return hashlib.md5(str(x).encode()).hexdigest()


def to_text(x: object, delimiter: str = "-", hash_len: int | None = None) -> str:
    """A value's text: NULL for empty or false ones, list elements joined, long texts of numbers hashed."""
    if x is None or x is False or (hasattr(x, "__len__") and len(x) == 0) or x == 0:
        return "NULL"
    if isinstance(x, str):
        return x
    if isinstance(x, (list, tuple)):
        if any(isinstance(v, (str, list, tuple)) for v in x):
            return delimiter.join(to_text(v, delimiter, hash_len) for v in x)
        s = "-".join(map(str, x))
    elif isinstance(x, (int, float, complex, bool)):
        s = str(x)
    else:
        raise ValueError(f"no text for {type(x).__name__}")
    return s if hash_len is None or len(s) <= hash_len else data_hash(x)[:hash_len]


def struct_to_text(fields: Mapping[str, object], max_len: int = 100, delimiter: str = "", omit: Iterable[str] = (), include: Sequence[str] | None = None) -> str | list[str]:
    """``k-v_k-v``, begun anew beyond max_len; the parts joined by the delimiter, or as a list where there is none and more than one part."""
    omit, parts = set(omit), [""]
    for k in fields if include is None else [k for k in include if k in fields]:
        if k in omit:
            continue
        item = f"{k}-{to_text(fields[k], hash_len=max(0, max_len - len(k) - 1))}"
        if not parts[-1]:
            parts[-1] = item
        elif len(parts[-1]) + len(item) + 1 > max_len:
            parts.append(item)
        else:
            parts[-1] += f"_{item}"
    return delimiter.join(parts) if delimiter or len(parts) == 1 else parts


@dataclass
class Options:
    values: dict[str, object]
    changed: dict[str, bool] = field(default_factory=dict)
    changed_values: dict[str, object] = field(default_factory=dict)


def parse_options(pairs: Sequence[object], defaults: Mapping[str, object] | None = None, ignore_bad_keys: bool = False, any_type: Iterable[str] = (), empty_means_unspecified: bool = False) -> Options:
    """Defaults with the given key, value, key, value ... put over them. Keys must be known strings, given once, with values of the default's type."""
    if len(pairs) % 2:
        raise ValueError(f"the last key has no value: {pairs[-1]!r}")
    keys = pairs[::2]
    if any(not isinstance(k, str) for k in keys):
        raise ValueError("all keys must be strings")
    if len(set(keys)) != len(keys):
        raise ValueError("duplicate keys")
    out = Options(dict(defaults or {}), {k: False for k in defaults or {}})
    new: dict[str, object] = {}
    for k, v in zip(keys, pairs[1::2]):
        if empty_means_unspecified and v == []:
            continue
        if defaults is not None:
            if k not in defaults:
                if ignore_bad_keys:
                    continue
                raise ValueError(f"{k!r} is not a valid key")
            if type(v) is not type(defaults[k]) and k not in set(any_type):
                raise ValueError(f"the value of {k!r} should be of type {type(defaults[k]).__name__}")
        if k not in out.values or out.values[k] != v:
            out.values[k], out.changed[k], new[k] = v, True, v
    out.changed_values = {k: new[k] for k in out.values if k in new}
    return out


def options_to_text(options: Options, always_include: Sequence[str] = (), always_exclude: Sequence[str] = (), max_len: int = 100, delimiter: str = "/") -> str:
    """What names a result: the options that are always named, then the changed ones, but for those never named."""
    if both := set(always_include) & set(always_exclude):
        raise ValueError(f"both included and excluded: {sorted(both)}")
    if missing := [k for k in (*always_include, *always_exclude) if k not in options.values]:
        raise ValueError(f"not possible fields: {missing}")
    chosen = {k: options.values[k] for k in always_include} | {k: v for k, v in options.changed_values.items() if k not in always_exclude}
    return struct_to_text(chosen, max_len, delimiter)
