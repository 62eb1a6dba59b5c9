"""Array expressions that Spark lacks, as SQL text."""

from __future__ import annotations

from collections.abc import Callable

CHUNK = 256


def running(values: str, fold: Callable[[str, str], str]) -> str:
    """SQL for the running fold (sums, maxima; from 0) of a bigint array, itself included.

    Chunks keep it near-linear: a plain prefix fold over an array is quadratic.
    """
    first = lambda a, n: f"aggregate(slice({a}, 1, {n}), 0L, (a, b) -> {fold('a', 'b')})"
    chunks = f"transform(sequence(0, size({values}) div {CHUNK}), c -> slice({values}, c * {CHUNK} + 1, {CHUNK}))"
    totals = f"transform({chunks}, c -> aggregate(c, 0L, (a, b) -> {fold('a', 'b')}))"
    inner = f"transform(p.c, (x, j) -> {fold(first('p.t', 'i'), first('p.c', 'j + 1'))})"
    zipped = f"transform({chunks}, (c, i) -> named_struct('c', c, 't', {totals}))"
    return f"if(size({values}) = 0, cast(array() as array<bigint>), flatten(transform({zipped}, (p, i) -> {inner})))"
