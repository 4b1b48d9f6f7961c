"""Texts in slices of bounded size, for what a task does in Python."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of text that a task works on at once.
SLICE_BYTES = 4 << 20


def arrow_slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """The texts in order, in arrays of about ``most`` bytes (a longer text stands alone)."""
    sizes = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield texts.slice(start, i - start)
            start, held = i, 0
        held += int(n) + 64
    if start < len(texts):
        yield texts.slice(start)


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[list[str | None]]:
    """As arrow_slices, in lists."""
    for x in arrow_slices(texts, most):
        yield x.to_pylist()


def text_udf(fn: Callable[[list[str | None]], pa.Array], returns: str, make: Callable | None = None, most: int = SLICE_BYTES) -> Callable[[Column], Column]:
    """An Arrow UDF of one text column. fn gets lists of about ``most`` bytes. make(), if given, builds fn once in each
    task. The results of a list leave before the next is begun, so a task holds no more of them, however large a batch is."""

    @F.arrow_udf(returns)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        f = make() if make else fn
        for batch in batches:
            yield from map(f, slices(batch, most)) if len(batch) else [f([])]

    return run
