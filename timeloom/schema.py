"""Row shapes. Times are microseconds since the start of the timeline, as longs."""

from __future__ import annotations

from pyspark.sql import types as T

_s, _l, _i, _d = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


CLIP = _struct(
    video_id=_s, clip_id=_s, start_us=_l, end_us=_l, category=_s, description=_s, score=_i, rationale=_s, tags=T.ArrayType(_s))
MEDIA = _struct(
    path=_s, duration_sec=_d, width=_i, height=_i, fps=_d, video_codec=_s, audio_codec=_s, container=_s, size_bytes=_l)
SCENE = _struct(video_id=_s, scene_index=_i, start_sec=_d, end_sec=_d)
STREAM = _struct(codec_type=_s, codec_name=_s, width=_i, height=_i, avg_frame_rate=_s, r_frame_rate=_s, duration=_s)
PROBE = _struct(format=_struct(duration=_s, size=_s, format_name=_s), streams=T.ArrayType(STREAM))
PLAN_CLIP = _struct(
    rank=_i, id=_s, start=_s, end=_s, duration_sec=_d, category=_s, description=_s, rationale=_s, vlm_score=_i, heuristic_score=_i,
    final_score=_i, tags=T.ArrayType(_s))
PLAN = _struct(video=MEDIA, clips=T.ArrayType(PLAN_CLIP), outputs=T.MapType(_s, T.ArrayType(_s)))
MODEL = _struct(
    id=_s, name=_s, context_length=_s, architecture=_struct(modality=_s, input_modalities=T.ArrayType(_s)),
    pricing=_struct(prompt=_s, completion=_s))

# The closed vocabularies of the data model.
CATEGORIES = ("highlight", "reaction", "dialogue", "transition", "filler")
HINTS = ("auto", "highlights", "talk", "hybrid")
