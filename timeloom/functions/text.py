"""Text clean-up: file slugs, redaction of keys, isolating JSON in replies."""

from __future__ import annotations

import logging
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shapes of keys that must not be shown, in the order in which they are replaced.
KEY_SHAPES = (
    r"sk-ant-[A-Za-z0-9_\-]{20,}",
    r"sk-or-[A-Za-z0-9_\-]{20,}",
    r"\bsk-[A-Za-z0-9]{20,}\b",
    r"\bAIza[0-9A-Za-z_\-]{35}\b",
    r"(?i)Bearer\s+[A-Za-z0-9._\-]{20,}",
)
REDACTED = "[REDACTED]"


def redact(text: Column) -> Column:
    """Every key-shaped piece replaced; doing it twice changes nothing more."""
    for shape in KEY_SHAPES:
        text = F.regexp_replace(text, shape, REDACTED)
    return text


def slugify(text: Column, max_length: int = 30, empty: str = "clip") -> Column:
    """ASCII letters, digits and single hyphens, none at the ends; `empty` where nothing is left."""
    # What decides: up to the last letter or digit that can be shown. Replacing goes on to the end of a text, which may be long.
    told = F.regexp_extract(F.coalesce(text, F.lit("")), rf"\A[^A-Za-z0-9]*+((?:[A-Za-z0-9][^A-Za-z0-9]*+){{0,{max_length}}}+)", 1)
    dashed = F.btrim(F.regexp_replace(told, "[^A-Za-z0-9]+", "-"), F.lit("-"))
    cut = F.rtrim(F.substring(dashed, 1, max_length), F.lit("-"))
    return F.when(cut == "", empty).otherwise(cut)


def isolate_json(raw: Column) -> Column:
    """The object in a reply: without a code fence around it, else from the first brace to the last,
    else the trimmed reply as it is."""
    t = F.regexp_replace(raw, r"^\s+|\s+$", "")
    opened = F.regexp_replace(t, r"\A```[^\n]*\n", "")
    # The last fence and all behind it; (?s) lets the first group run over lines.
    closed = F.regexp_replace(opened, r"(?s)\A(.*)```.*\z", "$1")
    body = F.when(t.startswith("```"), F.regexp_replace(closed, r"^\s+|\s+$", "")).otherwise(t)
    span = F.regexp_extract(body, r"(?s)\{.*\}", 0)
    return F.when(body.startswith("{") | (span == ""), body).otherwise(span)


def clip_filename(score: Column, rank: Column, description: Column) -> Column:
    return F.format_string("s%02d_clip_%03d_%s.mp4", score.cast("int"), rank.cast("int"), slugify(description))


class RedactingFilter(logging.Filter):
    """Takes key-shaped pieces out of every log record; a record that can't be formatted passes as it is."""

    _shapes = tuple(re.compile(s) for s in KEY_SHAPES)

    def filter(self, record: logging.LogRecord) -> bool:
        try:
            text = record.getMessage()
            clean = text
            for shape in self._shapes:
                clean = shape.sub(REDACTED, clean)
            if clean != text:
                record.msg, record.args = clean, ()
        except Exception:  # noqa: BLE001  logging must go on
            return True
        return True


def redact_logs(logger: logging.Logger) -> None:
    """Installs the filter once."""
    if not any(isinstance(f, RedactingFilter) for f in logger.filters):
        logger.addFilter(RedactingFilter())


def data_url(content: Column, path: Column, kind: str) -> Column:
    """data:kind/suffix;base64,...; kind: image (jpg means jpeg, none jpeg) or video (none mp4)."""
    suffix = F.nullif(F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)), F.lit(""))
    mime = F.coalesce(F.when(suffix == "jpg", "jpeg").otherwise(suffix), F.lit("jpeg" if kind == "image" else "mp4"))
    return F.concat(F.lit(f"data:{kind}/"), mime, F.lit(";base64,"), F.base64(content))


def quoted_path(path: Column) -> Column:
    """For a list of files in single quotes: each quote closes, is escaped and opens again."""
    return F.replace(path, F.lit("'"), F.lit("'\\''"))


def filter_value(path: Column) -> Column:
    """For a value in a filter graph: forward slashes, colons escaped."""
    return F.replace(F.replace(path, F.lit("\\"), F.lit("/")), F.lit(":"), F.lit("\\:"))


def join_key(parts: list[Column], limit: int = 64) -> Column:
    return F.left(F.concat(*parts), F.lit(limit))
