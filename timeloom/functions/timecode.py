"""Timestamps as text and as microseconds."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: [HH:]MM:SS[.mmm].
_CLOCK = r"^(?:(\d{1,2}):)?([0-5]?\d):([0-5]\d)(?:\.(\d{1,3}))?$"


def parse(text: Column) -> Column:
    """Microseconds of a clock string, null if it isn't one. The fraction is padded on the right."""
    t = F.trim(text)
    part = lambda i: F.regexp_extract(t, _CLOCK, i)
    whole = lambda c: F.concat(F.lit("0"), c).cast("long")  # noqa: E731  no digits: 0
    us = (whole(part(1)) * 3600 + whole(part(2)) * 60 + whole(part(3))) * 1_000_000 + whole(F.rpad(part(4), 3, "0")) * 1000
    return F.when(t.rlike(_CLOCK), us)


def parse_lenient(text: Column) -> Column:
    """A number of seconds, or else a clock string; negative numbers and the rest give null."""
    seconds = F.trim(text).try_cast("double")
    return F.when(seconds.isNotNull(), F.when(seconds >= 0, F.round(seconds * 1_000_000).cast("long"))).otherwise(parse(text))


def from_seconds(seconds: Column) -> Column:
    """Microseconds of a non-negative number of seconds, else null."""
    return F.when(seconds >= 0, F.round(seconds * 1_000_000).cast("long"))


def to_clock(seconds: Column) -> Column:
    """HH:MM:SS.mmm, cut (not rounded) to milliseconds, from 0 up; hours may pass 99."""
    ms = F.greatest(F.lit(0).cast("long"), (seconds * 1000).cast("long"))
    rest = lambda unit, below: F.floor(ms / unit).cast("long") % below
    hours = F.floor(ms / 3_600_000).cast("long")
    # Texts of numbers, as format_string costs several times as much.
    padded = lambda x, unit, n: F.substring((x + unit).cast("string"), 2, n)
    return F.concat(F.when(hours < 10, F.lit("0")).otherwise(F.lit("")), hours.cast("string"), F.lit(":"), padded(rest(60_000, 60), 100, 2), F.lit(":"), padded(rest(1000, 60), 100, 2),
                    F.lit("."), padded(ms % 1000, 1000, 3))


@functools.cache
def _texts(unit: int) -> pa.Array:
    """HH:MM: of the minutes below 100 hours (unit 60_000), SS.mmm of the milliseconds of a minute (unit 1)."""
    return pa.array([f"{i // 60:02d}:{i % 60:02d}:" for i in range(6000)] if unit == 60_000 else [f"{i // 1000:02d}.{i % 1000:03d}" for i in range(60_000)])


def clocks(seconds: np.ndarray) -> pa.Array:
    """As to_clock, of finite floats inside a task."""
    ms = np.maximum(0, (seconds * 1000).astype(np.int64))
    minutes, rest = np.divmod(ms, 60_000)
    if len(ms) and minutes.max() >= 6000:
        found, at = np.unique(minutes, return_inverse=True)
        head = pa.array([f"{m // 60:02d}:{m % 60:02d}:" for m in found.tolist()]).take(pa.array(at))
    else:
        head = _texts(60_000).take(pa.array(minutes))
    return pc.binary_join_element_wise(head, _texts(1).take(pa.array(rest)), "")
