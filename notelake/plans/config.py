"""Configurations: nested sections, one laid over another, with overrides by dotted name."""

from __future__ import annotations

import copy
import re

from .parameters import DEFAULTS

#: numbers with an exponent but no point or sign, which YAML 1.1 takes for text
EXPONENT = re.compile(r"[-+]?(\d+\.?\d*|\.\d+)[eE][-+]?\d+")


def laid_over(low: dict, high: dict) -> dict:
    """low with high's values; sections are merged, all else is replaced. Neither is shared with the result."""
    out = copy.deepcopy(low)
    for name, value in high.items():
        both = isinstance(value, dict) and isinstance(out.get(name), dict)
        out[name] = laid_over(out[name], value) if both else copy.deepcopy(value)
    return out


def put(config: dict, dotted: str, value) -> None:
    """Sets config[a][b] for 'a.b'. An empty part, or a part that names a value and not a section, is an error."""
    *path, last = dotted.split(".")
    if not last or not all(path):
        raise ValueError(f"not a name: {dotted!r}")
    at = config
    for i, part in enumerate(path):
        if at.get(part) is None:
            at[part] = {}
        at = at[part]
        if not isinstance(at, dict):
            raise ValueError(f"{'.'.join(path[: i + 1])} is a value, so {dotted!r} cannot be set")
    at[last] = value


def value_of(text: str):
    """The value that a text stands for: YAML's, but with numbers like 1e-4 read as numbers."""
    import yaml

    try:
        got = yaml.safe_load(text)
    except yaml.YAMLError:
        return text
    return float(got) if isinstance(got, str) and EXPONENT.fullmatch(got.strip()) else got


def load_config(*paths: str, overrides: dict | None = None) -> dict:
    """The files one over another, then the overrides (dotted names to values)."""
    import yaml

    out: dict = {}
    for path in paths:
        with open(path, encoding="utf-8") as f:
            out = laid_over(out, yaml.safe_load(f) or {})
    for name, value in (overrides or {}).items():
        put(out, name, value)
    return out


def parameters(config: dict) -> dict:
    """The views' parameters that a configuration sets, in whatever section."""
    out: dict = {}
    for name, value in config.items():
        if isinstance(value, dict):
            out |= parameters(value)
        elif name in DEFAULTS:
            out[name] = value
    return out
