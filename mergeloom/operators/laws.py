"""Checks that a merge is commutative, associative, idempotent and convergent."""

from __future__ import annotations

import functools
import random
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

Merge = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass
class Law:
    """The outcome of one law; differing: rows on either side that the other lacks."""

    name: str
    holds: bool
    differing: int


def differing(a: DataFrame, b: DataFrame) -> int:
    b = b.select(a.columns)
    return a.exceptAll(b).count() + b.exceptAll(a).count()


def commutative(fn: Merge, a: DataFrame, b: DataFrame) -> Law:
    n = differing(fn(a, b), fn(b, a))
    return Law("commutative", n == 0, n)


def associative(fn: Merge, a: DataFrame, b: DataFrame, c: DataFrame) -> Law:
    n = differing(fn(fn(a, b), c), fn(a, fn(b, c)))
    return Law("associative", n == 0, n)


def idempotent(fn: Merge, a: DataFrame) -> Law:
    once = fn(a, a)
    n = differing(once, fn(once, a))
    return Law("idempotent", n == 0, n)


def convergent(fn: Merge, replicas: Sequence[DataFrame], orders: int = 3, seed: int = 0) -> Law:
    """All orders give one result: as given, reversed, and shuffled ones."""
    rng, tried = random.Random(seed), [list(replicas), list(replicas)[::-1]]
    for _ in range(orders):
        tried.append(rng.sample(list(replicas), len(replicas)))
    results = [functools.reduce(fn, t) for t in tried]
    n = sum(differing(results[0], r) for r in results[1:])
    return Law("convergent", n == 0, n)


def verify(fn: Merge, a: DataFrame, b: DataFrame, c: DataFrame) -> list[Law]:
    """All four laws on three versions of a table."""
    return [commutative(fn, a, b), associative(fn, a, b, c), idempotent(fn, a), convergent(fn, [a, b, c])]


def verified(samples: Callable[[], tuple[DataFrame, DataFrame, DataFrame]]):
    """Decorator: the first call checks the laws on the samples and raises AssertionError if one fails."""
    def wrap(fn: Merge) -> Merge:
        checked = False

        @functools.wraps(fn)
        def call(a: DataFrame, b: DataFrame) -> DataFrame:
            nonlocal checked
            if not checked:
                failed = [law for law in verify(fn, *samples()) if not law.holds]
                if failed:
                    raise AssertionError(f"not a lawful merge: {failed}")
                checked = True
            return fn(a, b)

        return call

    return wrap
