"""The seam to a model that looks at segments of a timeline, with bounded retries and a fixed stand-in.

A model is asked inside Spark tasks, one request a segment; nothing here knows a network. What comes
back is text, which `timeloom.sources.replies` reads.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame

from timeloom.errors import TimelineError
from timeloom.tables import cut

# Fixed values.
ATTEMPTS, FIRST_PAUSE_SEC = 3, 0.5


class Transient(RuntimeError):
    """A failure of the transport that is worth another attempt."""


class Unusable(RuntimeError):
    """No attempt gave a reply that can be read."""


class UnavailableModel(TimelineError):
    """A provider that isn't offered, with the reason."""


class Model(Protocol):
    """What runs need of a model. `ask` gets a request (the segment's columns; `unusable`: the reply of
    the attempt before, if that couldn't be read) and returns the reply's text and its cost or None. usd_in and
    usd_out are its prices of a million tokens, None where unknown."""

    provider: str
    model: str
    sees: bool
    hears: bool
    usd_in: float | None
    usd_out: float | None

    def ask(self, request: dict) -> tuple[str, float | None]: ...


class FixedModel:
    """Answers by arithmetic on the segment: up to two clips, one at its start and one from its middle."""

    provider, model = "fixed", "fixed-1"
    usd_in = usd_out = None

    def __init__(self, sees: bool = True, hears: bool = True, usd: float | None = 0.001):
        self.sees, self.hears, self.usd = sees, hears, usd

    def ask(self, request: dict) -> tuple[str, float | None]:
        name = str(request["video_id"])
        if request["template"] == "detect":
            return json.dumps({"content_hint": ("highlights", "talk", "hybrid")[len(name) % 3], "confidence": 0.5, "reasoning": "by its name"}), self.usd
        length = request["end_sec"] - request["start_sec"]
        score = (int(request["start_sec"]) // 10 + len(name)) % 11
        clips = [(0.0, min(length, 10.0), score)]
        if length > 20:
            clips.append((length / 2, min(length, length / 2 + 15), (score + 3) % 11))
        return json.dumps({"video_id": name, "duration_sec": length, "clips": [
            {"id": f"m{i}", "start": a, "end": b, "category": "highlight", "description": "a moment", "score": s, "rationale": "by arithmetic", "tags": []}
            for i, (a, b, s) in enumerate(clips)]}), self.usd


class UnsteadyModel(FixedModel):
    """As FixedModel, but fails by arithmetic: every `dead`th timeline always, others in every `lost`th second of 300."""

    provider, model = "unsteady", "unsteady-1"

    def __init__(self, dead: int = 10, lost: int = 3, **settings):
        super().__init__(**settings)
        self.dead, self.lost = dead, lost

    def ask(self, request: dict) -> tuple[str, float | None]:
        name = int(request["video_id"])
        if name % self.dead == 0 or (name + int(request["start_sec"]) // 300) % self.lost == 0:
            raise RuntimeError(f"refused at {int(request['start_sec'])}")
        return super().ask(request)


_MAKERS: dict[str, Callable[..., Model]] = {"fixed": FixedModel, "unsteady": UnsteadyModel}
_REFUSALS: dict[str, str] = {"host": "frames are read by the caller there: use the sheet and cut operators"}


def register(name: str, maker: Callable[..., Model]) -> None:
    _MAKERS[name.strip().lower()] = maker


def refuse(name: str, reason: str) -> None:
    """Names a provider that isn't offered, and what to do instead."""
    _REFUSALS[name.strip().lower()] = reason


def make(name: str, **settings) -> Model:
    key = name.strip().lower()
    if key in _MAKERS:
        return _MAKERS[key](**settings)
    if key in _REFUSALS:
        raise UnavailableModel(f"provider {key!r}: {_REFUSALS[key]}")
    raise UnavailableModel(f"unknown provider {key!r}: one of {sorted(_MAKERS)}")


def ask_patiently(model: Model, request: dict, usable: Callable[[str], bool], sleep=time.sleep) -> tuple[str, float | None]:
    """At most ATTEMPTS attempts: after a transport failure a pause that doubles, after a reply that can't
    be read none, but the reply goes along with the next request. Any other failure ends it at once."""
    last: Exception = Unusable("no attempt was made")
    unusable = None
    for attempt in range(ATTEMPTS):
        try:
            text, usd = model.ask({**request, "unusable": unusable})
        except (Transient, TimeoutError) as failure:
            last = failure
            sleep(FIRST_PAUSE_SEC * 2**attempt)
            continue
        if text.strip() and usable(text):
            return text.strip(), usd
        unusable, last = text, Unusable(f"unusable reply: {text[:80]!r}")
    raise last


def is_object(text: str) -> bool:
    """Whether a reply holds a JSON object, code fences and chatter around it aside."""
    body = text[text.find("{") : text.rfind("}") + 1]
    try:
        return isinstance(json.loads(body), dict)
    except ValueError:
        return False


def replies(segments: DataFrame, model: Model, usable: Callable[[str], bool] = is_object, sleep=time.sleep, keep=cut) -> DataFrame:
    """segments (video_id, template, start_sec, end_sec, ...) plus raw, usd and error: one request each,
    inside the tasks; a segment that fails costs no other. Requests are paid for, so the rows are written as a
    table, which belongs to the `tables.scratch` block around the call."""
    names = segments.columns

    def run(batches):
        for batch in batches:
            found = []
            for request in batch.to_pylist():
                try:
                    found.append((*ask_patiently(model, request, usable, sleep), None))
                except Exception as failure:  # noqa: BLE001  whatever a model raises is that segment's error
                    found.append((None, None, f"{type(failure).__name__}: {failure}"))
            raw, usd, error = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(raw, pa.string()), pa.array(usd, pa.float64()), pa.array(error, pa.string())], names=[*names, "raw", "usd", "error"])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in segments.schema)
    return keep(segments.mapInArrow(run, f"{own}, raw string, usd double, error string"), "replies")
