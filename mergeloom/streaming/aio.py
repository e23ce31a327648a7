"""Merges for asyncio: plans are lazy, actions run in a thread."""

from __future__ import annotations

import asyncio
from collections.abc import AsyncIterator

from pyspark.sql import DataFrame, Row

from ..operators.merge import merge
from .merge import merge_sorted


async def amerge(a: DataFrame, b: DataFrame, *args, **kwargs) -> list[Row]:
    """The rows of ``merge``; other tasks run meanwhile."""
    return await asyncio.to_thread(lambda: merge(a, b, *args, **kwargs).collect())


async def abatches(df: DataFrame, size: int = 5000) -> AsyncIterator[list[Row]]:
    """Rows in batches, a partition on the driver at a time."""
    rows, batch = df.toLocalIterator(prefetchPartitions=True), []
    end = object()
    while (r := await asyncio.to_thread(next, rows, end)) is not end:
        batch.append(r)
        if len(batch) == size:
            yield batch
            batch = []
    if batch:
        yield batch


def amerge_stream(a: DataFrame, b: DataFrame, *args, size: int = 5000, **kwargs) -> AsyncIterator[list[Row]]:
    return abatches(merge(a, b, *args, **kwargs), size)


def amerge_sorted_stream(a: DataFrame, b: DataFrame, key: str, size: int = 5000, **kwargs) -> AsyncIterator[list[Row]]:
    return abatches(merge_sorted(a, b, key, **kwargs), size)
