"""What the operators of this subpackage share."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from types import ModuleType
from typing import TypeVar

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: the six white-space characters that separate words everywhere in this subpackage
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table, or all of them."""
    scan = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return scan.select(*columns) if columns else scan


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text; none for NULL."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def in_parts(frames: Iterator[pd.DataFrame], rows: int = 500) -> Iterator[pd.DataFrame]:
    """Arrow's batches in smaller ones, so that what is made of a batch of texts stays small."""
    for frame in frames:
        for at in range(0, len(frame), rows):
            yield frame.iloc[at : at + rows]


Made = TypeVar("Made")


def per_worker(key: tuple, make: Callable[[], Made]) -> Made:
    """What ``make`` returns, made once in a Python worker and kept there for its later tasks.

    For tables that are dear to build and of bounded size. Nothing may depend on whether they were kept.
    """
    kept = sys.modules.setdefault("_kept_by_worker", ModuleType("_kept_by_worker")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]
