"""Labels, scores and file names as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .boxes import c


def binary(class_id, background: list[int]) -> Column:
    """0 for the background classes, 1 for all others."""
    return F.when(c(class_id).isin(background), 0).otherwise(1)


def softmax_top(logits: Column) -> tuple[Column, Column]:
    """Index and probability of the greatest logit, the first of equal ones."""
    top = F.array_max(logits)
    total = F.aggregate(F.transform(logits, F.exp), F.lit(0.0), lambda s, x: s + x)
    return F.array_position(logits, top).cast("int") - 1, F.exp(top) / total


def stem(path) -> Column:
    """The path without its suffix."""
    return F.regexp_extract(c(path), r"^(.*)\.[^.]*$", 1)
