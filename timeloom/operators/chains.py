"""Chains of rows in time, in which each row kept decides which one is kept next.

Spark deals rows by key and sorts them; each task then goes through its rows once, as they come. A row that is `gap`
or more after the one before it is kept in any case, so only the others are compared with the last one kept. All
that is held is that one row: no array, group or table holds a timeline.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_T, _S, _FRESH = "_chain_t", "_chain_s", "_chain_fresh"


def chain(df: DataFrame, key: str, time: str, order: list[Column], gap: float, strength: str | None = None, short: int | None = None,  # noqa: ARG001
          then: tuple[Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], str] | None = None) -> DataFrame:
    """Rows of each key in time, each `gap` or more after the last one kept; ties go by `order`. With `strength`:
    a stronger row closer than gap to the last one takes its place, and is then the last one. short: of no effect, as
    stretches of all lengths are gone through in the same way; callers still pass it. then: what the same task makes of
    the rows kept, which come key by key and in time, and its schema; it needs a gap."""
    if gap <= 0:
        return df
    sort = [f"_chain_o{i}" for i in range(len(order))]
    facts = [F.col(time).cast("double").alias(_T), *(c.alias(n) for c, n in zip(order, sort, strict=True))]
    d = df.select("*", *facts, *([F.col(strength).cast("double").alias(_S)] if strength else []))
    near = F.col(_T) - F.lag(_T).over(Window.partitionBy(key).orderBy(_T, *sort)) < gap
    d = d.withColumn(_FRESH, ~F.coalesce(near, F.lit(False))).sortWithinPartitions(key, _T, *sort)  # already so: costs no sort
    names, fold = df.columns, _strongest if strength else _thinned

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = fold(batches, gap, len(names))
        return then[0](kept) if then else kept

    return d.select(*(F.col(f"`{c}`") for c in names), _T, _FRESH, *([_S] if strength else [])).mapInArrow(run, then[1] if then else df.schema)


def _own(batch: pa.RecordBatch, n: int) -> pa.RecordBatch:
    """The first n columns."""
    return batch.select(list(range(n)))


def _thinned(batches: Iterable[pa.RecordBatch], gap: float, n: int) -> Iterator[pa.RecordBatch]:
    last = 0.0
    for batch in batches:
        t = batch.column(n).to_numpy(zero_copy_only=False)
        keep = batch.column(n + 1).to_numpy(zero_copy_only=False).astype(bool)
        before = -1
        for i in np.flatnonzero(~keep).tolist():
            if i != before + 1:
                last = t[i - 1]
            if not t[i] - last < gap:
                keep[i], last = True, t[i]
            before = i
        if len(t) and before != len(t) - 1:
            last = t[-1]
        yield _own(batch, n).filter(pa.array(keep))


def _stronger(a: float | None, b: float | None) -> bool:
    """As Spark compares: nothing is stronger than null, NaN is stronger than numbers."""
    return a is not None and b is not None and (a > b or (a != a and b == b))


def _strongest(batches: Iterable[pa.RecordBatch], gap: float, n: int) -> Iterator[pa.RecordBatch]:
    held, last, best = None, 0.0, None  # the row that a stronger one may still replace
    for batch in batches:
        fresh, strength = batch.column(n + 1).to_pylist(), batch.column(n + 2).to_pylist()
        keep, at = [], None
        for i, t in enumerate(batch.column(n).to_numpy(zero_copy_only=False).tolist()):
            if fresh[i] or not t - last < gap:
                if at is not None:
                    keep.append(at)
                elif held is not None:
                    yield held
                at, last, best = i, t, strength[i]
            elif _stronger(strength[i], best):
                at, last, best = i, t, strength[i]
        yield _own(batch, n).take(pa.array(keep, pa.int64()))
        if at is not None:
            held = _own(batch, n).take(pa.array([at], pa.int64()))
    if held is not None:
        yield held
