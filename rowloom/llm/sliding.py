"""Sliding windows over arrays, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body names it: a lambda variable holds it. (Expressions are trees,
    and higher-order functions are interpreted, so a name that stands twice would be computed twice.)"""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def sliding(array: Column, width: int, combine: Callable[[Column, Column], Column]) -> Column:
    """combine() over each run of `width` elements; empty if the array is shorter. Runs double in length, so
    it takes about log2(width) passes. Runs that are combined may overlap."""
    out, have = array, 1
    while have < width:
        step = min(have, width - have)

        def one(x: Column, step: int = step) -> Column:
            keep = F.greatest(F.size(x) - step, F.lit(0))
            return F.zip_with(F.slice(x, 1, keep), F.slice(x, step + 1, keep), combine)

        out = let(out, one)
        have += step
    return out


def gram_hashes(hashes: Column, k: int) -> Column:
    """A hash of each run of k hashes."""
    return sliding(hashes, k, lambda a, b: F.xxhash64(a, b))
