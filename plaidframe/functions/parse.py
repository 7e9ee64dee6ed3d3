"""Option strings."""

from __future__ import annotations


def number(text: str) -> int | float:
    """An int if possible, otherwise a float."""
    try:
        return int(text)
    except ValueError:
        return float(text)


def typed(text: str) -> int | float | str:
    try:
        return number(text)
    except ValueError:
        return text


def key_values(text: str) -> dict:
    """``a=1,b=x`` as a dictionary with inferred types."""
    out = {}
    for item in filter(None, (t.strip() for t in text.split(","))):
        key, sep, value = item.partition("=")
        if not sep:
            raise ValueError(f"expected key=value, got {item!r}")
        out[key.strip()] = typed(value.strip())
    return out
