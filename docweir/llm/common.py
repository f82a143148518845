"""Helpers that the corpus operators share."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame

from docweir.operators.durable import bounded, components, durable, forget, shared_dir

__all__ = ["arrow_map", "bounded", "cache", "enter", "components", "durable", "forget", "shared_dir", "tidy"]

_caches: dict[str, dict] = {}


def cache(owner: str) -> dict:
    """What an operator keeps in a Python worker from task to task."""
    return _caches.setdefault(owner, {})


def enter(owner: str) -> None:
    """Called as a task of an operator begins: what other operators kept in the worker goes, and freed
    memory goes back to the system, as workers live on from stage to stage."""
    for name, kept in _caches.items():
        if name != owner:
            kept.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(run: Callable[[Iterator], Iterator], owner: str = "") -> Callable[[Iterator], Iterator]:
    """run, which gives freed memory back to the system as its task ends as well as when it begins: a worker
    that then waits for its next task would hold it for a minute, beside the ones that work."""

    def go(batches: Iterator) -> Iterator:
        enter(owner)
        yield from run(batches)
        enter(owner)

    return go


def arrow_map(
    df: DataFrame, columns: list[str | Column], f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, owner: str = ""
) -> DataFrame:
    """f on every Arrow batch of the columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield f(b)

    bounded(df.sparkSession)
    return df.select(*columns).mapInArrow(tidy(run, owner), schema)
