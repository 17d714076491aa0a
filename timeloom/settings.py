"""Layered settings of the driver: a file, then the environment, then what the caller says."""

from __future__ import annotations

import dataclasses
import logging
import os
import tomllib
from collections.abc import Mapping
from pathlib import Path

log = logging.getLogger(__name__)
PREFIX = "TIMELOOM_"


def merged(base: Mapping, over: Mapping) -> dict:
    """Both mappings in one, level by level; `over` wins."""
    out = dict(base)
    for key, value in over.items():
        both = isinstance(value, Mapping) and isinstance(out.get(key), Mapping)
        out[key] = merged(out[key], value) if both else value
    return out


def from_file(path: str | Path) -> dict:
    """A TOML file; one that doesn't exist says nothing."""
    file = Path(path)
    return tomllib.loads(file.read_text("utf-8")) if file.is_file() else {}


def from_environment(values: Mapping[str, str], prefix: str = PREFIX) -> dict:
    """PREFIX_A__B=x says {"a": {"b": "x"}}."""
    out: dict = {}
    for name in sorted(values):
        if name.startswith(prefix) and name != prefix:
            at = {}
            parts = name.removeprefix(prefix).lower().split("__")
            at = {parts[-1]: values[name]}
            for part in reversed(parts[:-1]):
                at = {part: at}
            out = merged(out, at)
    return out


@dataclasses.dataclass(frozen=True)
class Settings:
    """What runs need: scoring, sampling, outputs, and a cap on costs."""

    min_score: int = 5
    max_clips: int = 20
    overlap: float = 0.5
    keyframes_per_scene: int = 2
    outputs: tuple[str, ...] = ("separate",)
    order: str = "score"
    cost_cap_usd: float = 1.0
    default_hint: str = "auto"

    @classmethod
    def load(cls, path: str | Path | None = None, environment: Mapping[str, str] | None = None, **said) -> Settings:
        layers = merged(from_file(path) if path else {}, from_environment(os.environ if environment is None else environment))
        flat = merged(layers.get("timeloom", layers), said)
        known = {f.name: f for f in dataclasses.fields(cls)}
        values = {}
        if odd := sorted(set(flat) - set(known)):
            log.warning("settings that don't exist: %s", ", ".join(odd))
        for name, value in flat.items():
            if name in known:
                default = known[name].default
                values[name] = tuple(value.split(",") if isinstance(value, str) else value) if isinstance(default, tuple) else type(default)(value)
        return cls(**values)
