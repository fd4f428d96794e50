"""Argument checks; the texts of their errors are part of the interface."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import DataFrame


class ValidationError(ValueError):
    """A wrong argument."""


def table(x, name: str, kind: str = "data.frame or tbl object") -> None:
    if not isinstance(x, DataFrame):
        raise ValidationError(f"{name} must be a {kind}")


def has_columns(df: DataFrame, name: str, columns: Iterable[str], what: str = "required columns") -> None:
    missing = [c for c in columns if c is not None and c not in df.columns]
    if missing:
        raise ValidationError(f"{name} missing {what}: {', '.join(missing)}")


def positive_int(x, text: str, optional: bool = False) -> None:
    if optional and x is None:
        return
    if isinstance(x, bool) or not isinstance(x, (int, float)) or x <= 0 or x != int(x):
        raise ValidationError(text)


def level(x, text: str) -> None:
    if isinstance(x, bool) or not isinstance(x, (int, float)) or math.isnan(x) or not 0 < x < 1:
        raise ValidationError(text)


def strings(x, text: str) -> list[str]:
    found = [x] if isinstance(x, str) else list(x) if isinstance(x, (list, tuple)) else []
    if not found or not all(isinstance(s, str) for s in found):
        raise ValidationError(text)
    return found
