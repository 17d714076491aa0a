"""Queries of whole runs and of the small pieces around them, with reference SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from timeloom import views as V
from timeloom.analysis import models, runs
from timeloom.functions import text
from timeloom.operators import chunks, intervals, profiles, ranking, sampling, signals
from timeloom.plans import documents
from timeloom.queries import _EXTRAS, _IOU, _PLAN_ROWS, _RANKED, _SCENE_SAMPLES, _UNIFORM, _plans, _thin, query
from timeloom.sources import probe, replies

# part: a part is a timeline, its price the seconds.
_MEDIA = "media AS (SELECT p_partkey AS video_id, p_retailprice::DOUBLE AS duration_sec FROM part)"


def _media(spark, d):
    return V.table(spark, d, "part").select(F.col("p_partkey").alias("video_id"), F.col("p_retailprice").cast("double").alias("duration_sec"))


def _batches(over: str) -> str:
    """SQL: the batches of media, by 300 seconds."""
    return f"""SELECT video_id, i::INT AS chunk_index, i * 300.0::DOUBLE AS start_sec, least(duration_sec, i * 300 + 300 + {over})::DOUBLE AS end_sec
FROM (SELECT *, unnest(generate_series(0, greatest(0, ceil((duration_sec - 300 - {over}) / 300))::BIGINT)) AS i FROM media WHERE duration_sec > 300)
UNION ALL SELECT video_id, 0, 0, duration_sec FROM media WHERE duration_sec <= 300"""


def _clips(segments: str) -> str:
    """SQL: what FixedModel answers to segments, on the whole timeline, of equal moments the best."""
    return f"""SELECT video_id, unnest({V.fold("list({'chunk_index': chunk_index, 'pos': pos, 'start_us': start_us, 'end_us': end_us, 'score': score} ORDER BY -score, start_us, chunk_index, pos)", _IOU)}) AS k
FROM (SELECT video_id, chunk_index, pos, round(start_sec * 1e6)::BIGINT + round(a * 1e6)::BIGINT AS start_us, round(start_sec * 1e6)::BIGINT + round(b * 1e6)::BIGINT AS end_us, score::INT AS score FROM (
  SELECT *, 0 AS pos, 0.0::DOUBLE AS a, least(len, 10.0)::DOUBLE AS b, s AS score FROM (SELECT *, end_sec - start_sec AS len, (floor(start_sec)::BIGINT // 10 + length(video_id::VARCHAR)) % 11 AS s FROM {segments})
  UNION ALL SELECT *, 1, len / 2, least(len, len / 2 + 15), (s + 3) % 11 FROM (SELECT *, end_sec - start_sec AS len, (floor(start_sec)::BIGINT // 10 + length(video_id::VARCHAR)) % 11 AS s FROM {segments}) WHERE len > 20))
GROUP BY video_id"""


_SHOWN = "video_id, k.chunk_index AS chunk_index, k.pos AS pos, k.start_us AS start_us, k.end_us AS end_us, k.score AS score"


@query(f"WITH {_MEDIA}, seg AS ({_batches('10')}), merged AS ({_clips('seg')}) SELECT {_SHOWN} FROM merged")
def q_analysis(spark, d):
    found = runs.analyse(_media(spark, d).withColumn("max_sec", F.lit(20.0)), models.make("fixed"), audio=False)
    return found.clips.select("video_id", "chunk_index", "pos", "start_us", "end_us", "score")


_COARSE = f"""{_MEDIA}, seg AS ({_batches('30')}), coarse AS (SELECT {_SHOWN} FROM ({_clips('seg')})),
best AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY -score, start_us, pos) AS place FROM coarse WHERE score >= 5),
fine AS (SELECT video_id, (place - 1)::INT AS chunk_index, greatest(0, start_us / 1e6::DOUBLE - 20) AS start_sec, least(duration_sec, end_us / 1e6::DOUBLE + 20) AS end_sec
         FROM best JOIN media USING (video_id) WHERE place <= 40)"""


@query(f"""WITH {_COARSE}, merged AS (SELECT {_SHOWN} FROM ({_clips('fine')})) SELECT * FROM merged
UNION ALL SELECT * FROM coarse WHERE video_id NOT IN (SELECT video_id FROM merged)""")
def q_two_pass_analysis(spark, d):
    found = runs.analyse(_media(spark, d).withColumn("max_sec", F.lit(20.0)), models.make("fixed"), audio=False, refine=True)
    return found.clips.select("video_id", "chunk_index", "pos", "start_us", "end_us", "score")


@query(f"""WITH {_COARSE}, n AS (SELECT video_id, count(*) AS n FROM seg GROUP BY video_id), f AS (SELECT video_id, count(*) AS n FROM fine GROUP BY video_id)
SELECT video_id, 'fixed' AS provider, round(0.001 * (n.n + coalesce(f.n, 0)), 6)::DOUBLE AS cost_usd, round(duration_sec * 0.00025 * 2, 6)::DOUBLE AS estimate_usd, coalesce(f.n, n.n)::BIGINT AS n_chunks
FROM media JOIN n USING (video_id) LEFT JOIN f USING (video_id)""")
def q_analysis_costs(spark, d):
    found = runs.analyse(_media(spark, d).withColumn("max_sec", F.lit(20.0)), models.make("fixed"), audio=False, refine=True)
    return found.metadata.select("video_id", "provider", F.round("cost_usd", 6).alias("cost_usd"), F.round("estimate_usd", 6).alias("estimate_usd"), "n_chunks")


@query(f"""WITH {_MEDIA}, seg AS ({_batches('10')}), merged AS (SELECT {_SHOWN} FROM ({_clips('seg')})),
scored AS (SELECT *, CASE WHEN (end_us - start_us) / 1000000 < 3 OR (end_us - start_us) / 1000000 > 60 THEN 2 ELSE 5 END AS h FROM merged),
final AS (SELECT *, greatest(0, least(10, score + h - 5))::INT AS final_score FROM scored),
kept AS (SELECT video_id, unnest({V.fold("list({'pos': pos, 'start_us': start_us, 'end_us': end_us, 'final_score': final_score} ORDER BY -final_score, start_us, pos)",
 "greatest(0, least(x.end_us, y.end_us) - greatest(x.start_us, y.start_us))::DOUBLE / least(x.end_us - x.start_us, y.end_us - y.start_us) > 0.5")}) AS k FROM final WHERE final_score >= 7 GROUP BY video_id)
SELECT video_id, rank, k.start_us - 3000000 * (k.start_us >= 3000000)::INT - k.start_us * (k.start_us < 3000000)::INT AS start_us, k.final_score AS final_score, 'fixed-1' AS model, 'video' AS strategy
FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY -k.final_score, k.start_us, k.pos)::INT AS rank FROM kept) WHERE rank <= 20""")
def q_run_plans(spark, d):
    """The whole run: probe, profile, route, ask, rank, write; then the plans' clips."""
    p = V.table(spark, d, "part")
    payload = F.concat(F.lit('{"format": {"duration": "'), F.col("p_retailprice").cast("double").cast("string"), F.lit(
        '"}, "streams": [{"codec_type": "video", "codec_name": "h264", "width": 640, "height": 360, "avg_frame_rate": "25/1"}]}'))
    asked = p.select(F.col("p_partkey").alias("video_id"), F.concat(F.col("p_partkey").cast("string"), F.lit(".mp4")).alias("path"), payload.alias("payload"), F.lit("highlights").alias("hint"))
    none = spark.createDataFrame([], "video_id long, scene_index int, start_sec double, end_sec double")
    _, plans = runs.run(asked, none, models.make("fixed"))
    doc = plans.select("video_id", F.get_json_object("plan", "$.vlm.model").alias("model"), F.get_json_object("plan", "$.sampling.strategy").alias("strategy"), "plan")
    clips = documents.parse_documents(doc, "plan").select("video_id", "model", "strategy", F.explode("document.clips").alias("c"))
    from timeloom.functions.timecode import parse

    return clips.select("video_id", F.col("c.rank").cast("int").alias("rank"), parse(F.col("c.start")).alias("start_us"), F.col("c.final_score").cast("int").alias("final_score"), "model", "strategy")


_ROUTED = f"""{V.SCENES}, media AS (SELECT video_id, max(end_sec) AS duration_sec FROM scenes GROUP BY video_id),
asked AS (SELECT video_id, duration_sec, CASE WHEN video_id % 2 = 0 THEN 'keyframe' WHEN video_id % 3 = 1 THEN 'audio' ELSE 'video' END AS route,
  [8, 5, 5][(video_id % 3 + 1)::INT] AS least, [20.0, 30.0, 45.0][(video_id % 3 + 1)::INT]::DOUBLE AS longest, [3000000, 0, 0][(video_id % 3 + 1)::INT]::BIGINT AS roll, [7, 5, 5][(video_id % 3 + 1)::INT] AS enough FROM media),
sized AS (SELECT *, CASE route WHEN 'keyframe' THEN 1e12 WHEN 'audio' THEN 600 ELSE 300 END::DOUBLE AS size FROM asked),
seg AS (SELECT video_id, i::INT AS chunk_index, i * size AS start_sec, least(duration_sec, i * size + size + least(longest / 2, size / 2)) AS end_sec
  FROM (SELECT *, unnest(generate_series(0, greatest(0, ceil((duration_sec - size - least(longest / 2, size / 2)) / size))::BIGINT)) AS i FROM sized WHERE duration_sec > size)
  UNION ALL SELECT video_id, 0, 0, duration_sec FROM sized WHERE duration_sec <= size)"""
_FRAME_COUNTS = f"""long_scenes AS (SELECT * FROM scenes JOIN media USING (video_id) WHERE duration_sec >= 120),
raw AS (SELECT video_id, (i + 0.5) * step AS t, NULL::INT AS scene_index FROM {_UNIFORM.format(src="(SELECT *, 1.5::DOUBLE AS step FROM media WHERE duration_sec < 120)")} WHERE (i + 0.5) * step < duration_sec
  UNION ALL {_SCENE_SAMPLES.replace("FROM scenes", "FROM long_scenes")} UNION ALL {_EXTRAS.replace("FROM scenes", "FROM long_scenes")}),
h AS {_thin("SELECT * FROM raw")}, n AS (SELECT video_id, count(*) AS n FROM h GROUP BY video_id),
few AS (SELECT video_id, duration_sec, duration_sec / (least + 1) AS step FROM asked LEFT JOIN n USING (video_id) WHERE coalesce(n, 0) < least),
dense AS {_thin("SELECT video_id, (i + 0.5) * step AS t, NULL::INT AS scene_index FROM " + _UNIFORM.format(src="few") + " WHERE (i + 0.5) * step < duration_sec")},
frames AS (SELECT video_id, count(*) AS n_frames FROM (SELECT video_id FROM h WHERE video_id NOT IN (SELECT video_id FROM few) UNION ALL SELECT video_id FROM dense) GROUP BY video_id),
cuts AS (SELECT video_id, count(*) AS n_scenes FROM scenes GROUP BY video_id)"""


@query(f"""WITH {_ROUTED}, {_FRAME_COUNTS}, merged AS (SELECT {_SHOWN} FROM ({_clips('seg')})),
scored AS (SELECT *, CASE WHEN (end_us - start_us) / 1000000 < 3 OR (end_us - start_us) / 1000000 > 60 THEN 2 ELSE 5 END AS h FROM merged),
final AS (SELECT *, greatest(0, least(10, score + h - 5))::INT AS final_score FROM scored),
kept AS (SELECT video_id, unnest({V.fold("list({'pos': pos, 'start_us': start_us, 'end_us': end_us, 'final_score': final_score} ORDER BY -final_score, start_us, chunk_index, pos)",
 "greatest(0, least(x.end_us, y.end_us) - greatest(x.start_us, y.start_us))::DOUBLE / least(x.end_us - x.start_us, y.end_us - y.start_us) > 0.5")}) AS k FROM final JOIN asked USING (video_id) WHERE final_score >= enough GROUP BY video_id)
SELECT video_id, rank, (greatest(0, k.start_us - roll) // 1000 * 1000)::BIGINT AS start_us, k.final_score AS final_score, CASE route WHEN 'keyframe' THEN 'hybrid' ELSE route END AS strategy,
  CASE route WHEN 'keyframe' THEN n_frames ELSE 0 END::INT AS n_keyframes, CASE route WHEN 'keyframe' THEN n_scenes ELSE 0 END::INT AS n_scenes,
  CASE route WHEN 'keyframe' THEN round_even(((800 + 1100 * n_frames) * 3.0 + 1200 * 15.0) / 1e6::DOUBLE, 4) WHEN 'audio' THEN round(duration_sec * 0.0001, 6) ELSE round(duration_sec * 0.00025, 6) END::DOUBLE AS estimate_usd
FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY -k.final_score, k.start_us, k.pos)::INT AS rank FROM kept) JOIN asked USING (video_id) LEFT JOIN frames USING (video_id) LEFT JOIN cuts USING (video_id) WHERE rank <= 20""")
def q_run_routes(spark, d):
    """Whole runs over three routes: even timelines go to a model that neither sees nor hears, odd ones to one that does."""
    from timeloom.functions.timecode import parse

    scenes = V.scenes(spark, d)
    payload = F.concat(F.lit('{"format": {"duration": "'), F.col("duration_sec").cast("string"), F.lit(
        '"}, "streams": [{"codec_type": "video", "codec_name": "h264", "width": 640, "height": 360, "avg_frame_rate": "25/1"}]}'))
    hint = F.get(F.array(F.lit("highlights"), F.lit("talk"), F.lit("hybrid")), (F.col("video_id") % 3).cast("int"))
    asked = V.scene_media(scenes).select("video_id", F.concat(F.col("video_id").cast("string"), F.lit(".mp4")).alias("path"), payload.alias("payload"), hint.alias("hint"))
    blind = runs.run_all(asked.where("video_id % 2 = 0"), scenes, models.make("fixed", sees=False, hears=False)).plans
    seeing = runs.run_all(asked.where("video_id % 2 = 1"), scenes, models.make("fixed")).plans
    blocks = F.from_json("plan", "sampling struct<strategy: string, n_keyframes: int, n_scenes: int>, vlm struct<cost_upfront_estimate_usd: double>").alias("_b")
    doc = blind.unionByName(seeing).select("video_id", blocks, "plan").select("video_id", "_b.sampling.*", F.round("_b.vlm.cost_upfront_estimate_usd", 6).alias("estimate_usd"), "plan")
    # Clips are shared by the generator and the filter that Spark puts before it.
    clips = documents.once(documents.parse_documents(doc, "plan").select("*", F.col("document.clips").alias("clips")).drop("document", "text"), "clips").select("*", F.explode("clips").alias("c"))
    return clips.select("video_id", F.col("c.rank").cast("int").alias("rank"), parse(F.col("c.start")).alias("start_us"), F.col("c.final_score").cast("int").alias("final_score"),
                        "strategy", "n_keyframes", "n_scenes", "estimate_usd")


@query(f"""WITH {_MEDIA}, seg AS ({_batches('10')}), lost AS (SELECT *, video_id % 10 = 0 OR (video_id + floor(start_sec)::BIGINT // 300) % 3 = 0 AS gone FROM seg),
alive AS (SELECT video_id, chunk_index, start_sec, end_sec FROM lost WHERE NOT gone), merged AS (SELECT {_SHOWN} FROM ({_clips('alive')})), c AS (SELECT video_id, count(*) AS n_clips FROM merged GROUP BY video_id),
o AS (SELECT video_id, count(*) AS n_batches, count(*) FILTER (gone) AS n_lost, min(start_sec) FILTER (gone) AS first FROM lost GROUP BY video_id)
SELECT video_id, CASE WHEN n_lost = 0 THEN 'done' WHEN n_lost < n_batches THEN 'partial' ELSE 'failed' END AS status, n_batches, n_lost,
  'RuntimeError: refused at ' || first::BIGINT AS reason, coalesce(n_clips, 0) AS n_clips FROM o LEFT JOIN c USING (video_id)""")
def q_outcomes(spark, d):
    """A model that fails for some timelines: they cost the others nothing, and are told."""
    found = runs.analyse(_media(spark, d).withColumn("max_sec", F.lit(20.0)), models.make("unsteady"), audio=False, strict=False)
    n = found.clips.groupBy("video_id").agg(F.count("*").alias("n_clips"))
    return found.outcomes.join(n, "video_id", "left").withColumn("n_clips", F.coalesce("n_clips", F.lit(0)))


@query(f"WITH {_MEDIA} SELECT video_id, ['highlights', 'talk', 'hybrid'][length(video_id::VARCHAR) % 3 + 1] AS content_hint, 0.5::DOUBLE AS confidence, NULL::VARCHAR AS problem FROM media WHERE duration_sec > 0")
def q_detect_hints(spark, d):
    return runs.detect_hints(_media(spark, d), models.make("fixed")).select("video_id", "content_hint", "confidence", "problem")


@query(f"""WITH {_RANKED} SELECT video_id, count(*) AS n_clips, round(sum(end_us - start_us) / 1e6, 3)::DOUBLE AS seconds, max(final_score) AS best FROM ranked WHERE rank <= 5 GROUP BY video_id""")
def q_summary(spark, d):
    r = ranking.rank(V.clips(spark, d), 5, 5)
    meta = r.select("video_id").distinct().withColumns({"provider": F.lit("p"), "model": F.lit("m"), "cost_usd": F.lit(0.0)})
    return runs.summary(r, meta).select("video_id", "n_clips", F.round("seconds", 3).alias("seconds"), "best")


@query(f"WITH {V.MOMENTS}, c AS (SELECT video_id, (row_number() OVER (PARTITION BY video_id ORDER BY t, event_id))::INT AS cut_id, t AS a, t + 86400 AS b FROM moments) "
       "SELECT m.video_id, cut_id, event_id, round(t - a, 3) AS since FROM moments m JOIN c USING (video_id) WHERE t >= a AND t < b")
def q_range_slice(spark, d):
    m = V.moments(spark, d)
    number = F.row_number().over(Window.partitionBy("video_id").orderBy("t", "event_id"))
    cuts = m.select("video_id", number.alias("cut_id"), F.col("t").alias("start_sec"), (F.col("t") + 86400).alias("end_sec"))
    return intervals.sliced(m, cuts).select("video_id", "cut_id", "event_id", F.round("since", 3).alias("since"))


@query(f"WITH {V.CLIPS} SELECT part, count(*) AS n, sum(pos)::BIGINT AS total FROM (SELECT 0 AS part, pos FROM clips UNION ALL SELECT 1, pos FROM clips WHERE score > 5) GROUP BY part")
def q_concat(spark, d):
    c = V.clips(spark, d)
    return intervals.concat_ordered(c, c.where("score > 5")).groupBy("part").agg(F.count("*").alias("n"), F.sum("pos").alias("total"))


_CELLS = f"{V.MEDIA}, n AS (SELECT video_id, greatest(1, floor(duration_sec / 60)::INT) AS n FROM media), t AS (SELECT video_id, unnest(generate_series(0, n - 1))::INT AS i FROM n)"


def _cells(spark, d):
    w = V.media(spark, d).select("video_id", F.lit(0.0).alias("start_sec"), F.col("duration_sec").alias("end_sec"))
    return sampling.sheet_cells(sampling.sheet_times(w, 60.0), 5, 4, offset=1)


@query(f"WITH {_CELLS} SELECT video_id, (i + 1)::INT AS cell, CASE WHEN i % 7 <> 6 THEN i * 60.0::DOUBLE END AS t FROM t")
def q_cell_times(spark, d):
    times = _cells(spark, d)
    return sampling.cell_times(times.select("video_id", "cell"), times.where("frame_index % 7 <> 6"))


@query(f"WITH {_CELLS} SELECT video_id, count(*) AS n, max(i + 1)::INT AS last_cell, round(max(i) * 60.0, 3)::DOUBLE AS last_sec FROM t GROUP BY video_id")
def q_index_map(spark, d):
    m = sampling.index_map(_cells(spark, d)).select("video_id", F.from_json("index_to_sec", "map<string,double>").alias("m"))
    last = F.array_max(F.transform(F.map_keys("m"), lambda k: k.cast("int")))
    return m.select("video_id", F.size("m").cast("long").alias("n"), last.alias("last_cell"), F.element_at("m", last.cast("string")).alias("last_sec"))


@query(f"WITH {_CELLS}, s AS (SELECT DISTINCT video_id, i // 20 AS sheet FROM t) SELECT video_id, printf('sheet_%03d.png', sheet::INT) AS name, (row_number() OVER (PARTITION BY video_id ORDER BY sheet))::INT AS at FROM s")
def q_sheet_order(spark, d):
    s = _cells(spark, d).select("video_id", F.format_string("sheet_%03d.png", "sheet").alias("name")).distinct()
    return sampling.sheet_order(s)


@query(f"""WITH {V.MEDIA}, s AS (SELECT video_id, unnest(generate_series(0, greatest(0, ceil(duration_sec / 600 - 0.5))::BIGINT - 1)) AS i, duration_sec FROM media)
SELECT video_id, printf('kf_%05d_su.jpg', i::INT) AS name FROM s WHERE (i + 0.5) * 600 < duration_sec""")
def q_frame_names(spark, d):
    return sampling.frame_names(sampling.uniform(V.media(spark, d), 600.0)).select("video_id", "name")


@query(f"""WITH {V.MEDIA}, s AS (SELECT video_id, i, (i + 0.5) * 600 AS t FROM (SELECT *, unnest(generate_series(0, greatest(0, ceil(duration_sec / 600 - 0.5))::BIGINT - 1)) AS i FROM media) WHERE (i + 0.5) * 600 < duration_sec)
SELECT video_id, string_agg(i || ': ' || printf('%02d:%02d:%02d.000', t::INT // 3600, t::INT // 60 % 60, t::INT % 60), chr(10) ORDER BY i) AS lines FROM s GROUP BY video_id""")
def q_frame_lines(spark, d):
    names = sampling.frame_names(sampling.uniform(V.media(spark, d), 600.0))
    return profiles.frame_lines(names.select("video_id", F.col("frame").alias("frame_index"), "t"))


_WORDS = "SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'Talk' WHEN 2 THEN 'hybrid' ELSE 'AUTO' END AS hint, CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE ' goals ' END AS query FROM orders"


@query(f"""WITH w AS ({_WORDS}) SELECT id, CASE WHEN hint IS NULL AND id % 3 <> 2 THEN NULL ELSE coalesce(lower(hint), 'auto') END AS hint, CASE WHEN id % 3 = 2 THEN 'goals' END AS query,
coalesce(hint, 'talk') AS filled, CASE lower(hint) WHEN 'talk' THEN 8.0 ELSE 5.0 END::DOUBLE AS min_sec, CASE lower(hint) WHEN 'talk' THEN 'slow' ELSE 'any' END AS guide FROM w""")
def q_requests(spark, d):
    key = F.col("o_orderkey")
    hint = F.when(key % 4 == 1, "Talk").when(key % 4 == 2, "hybrid").when(key % 4 == 3, "AUTO")
    asked = F.when(key % 3 == 1, "  ").when(key % 3 == 2, " goals ")
    o = V.table(spark, d, "orders").select(key.alias("id"), hint.alias("hint"), asked.alias("query"), F.lit(1.0).alias("min_sec"))
    o = o.select("*", profiles.asked_for(F.col("hint"), F.col("query")).alias("said"), profiles.with_default(F.col("hint"), " Talk").alias("filled"), profiles.guidance(F.col("hint"), {"talk": "slow"}, "any").alias("guide"))
    return profiles.overlaid(o, 5).select("id", F.col("said.hint").alias("hint"), F.col("said.query").alias("query"), "filled", "min_sec", "guide")


@query("""SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'not JSON' WHEN 1 THEN 'bad video_id' WHEN 2 THEN 'bad duration_sec' WHEN 3 THEN 'unknown keys: b, x' END AS problem FROM part""")
def q_plan_problem(spark, d):
    p, kind = V.table(spark, d, "part"), F.col("p_partkey") % 5
    raw = F.when(kind == 0, "{").when(kind == 1, '{"video_id": "", "duration_sec": 3, "clips": []}').when(kind == 2, '```json\n{"video_id": "v", "duration_sec": 0}\n```').when(
        kind == 3, '{"video_id": "v", "duration_sec": 2.5, "x": 1, "b": 2}').otherwise('{"video_id": "v", "duration_sec": 2.5, "clips": [], "metadata": {}}')
    return p.select(F.col("p_partkey").alias("id"), replies.plan_problem(raw).alias("problem"))


@query("""SELECT p_partkey AS id, 'm' AS model, CASE WHEN p_size % 2 = 0 THEN p_size::VARCHAR WHEN p_partkey % 3 = 0 THEN '9' END AS cost, 'kept' AS note FROM part""")
def q_stamped(spark, d):
    p = V.table(spark, d, "part")
    theirs = F.when(F.col("p_partkey") % 3 == 0, F.create_map(F.lit("note"), F.lit("kept"), F.lit("cost_usd"), F.lit("9"), F.lit("vlm_model"), F.lit("z"))).otherwise(F.create_map(F.lit("note"), F.lit("kept")))
    m = replies.stamped(theirs, "p", "m", F.lit(1.234), F.when(F.col("p_size") % 2 == 0, F.col("p_size")))
    return p.select(F.col("p_partkey").alias("id"), m["vlm_model"].alias("model"), m["cost_usd"].alias("cost"), m["note"].alias("note"))


@query(r"""SELECT p_partkey AS id, 'data:image/' || CASE p_partkey % 3 WHEN 2 THEN 'png' ELSE 'jpeg' END || ';base64,' || base64(p_name::BLOB) AS url, 'it''\''''s ' || p_partkey AS quoted, 'c\:/fonts/' || p_partkey AS value,
p_size / 7.0::DOUBLE AS ratio, 'out/' || p_partkey || '.mp4' AS path FROM part""")
def q_encodings(spark, d):
    key = F.col("p_partkey").cast("string")
    path = F.concat(key, F.when(F.col("p_partkey") % 3 == 0, "").when(F.col("p_partkey") % 3 == 1, ".JPG").otherwise(".png"))
    return V.table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), text.data_url(F.col("p_name").cast("binary"), path, "image").alias("url"), text.quoted_path(F.concat(F.lit("it's "), key)).alias("quoted"),
        text.filter_value(F.concat(F.lit("c:\\fonts\\"), key)).alias("value"), probe.aspect_ratio(F.col("p_size"), F.lit(7.0)).alias("ratio"), documents.inside("out/", F.concat(key, F.lit(".mp4"))).alias("path"))


@query("""SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'separate,merged' WHEN 1 THEN 'merged' ELSE 'merged,separate' END AS modes FROM part""")
def q_output_modes(spark, d):
    kind = F.col("p_partkey") % 3
    m = F.when(kind == 0, F.array(F.lit("all"), F.lit("merged"))).when(kind == 1, F.array(F.lit("merged"), F.lit("merged"))).otherwise(F.array(F.lit("merged"), F.lit("all")))
    return V.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(documents.output_modes(m, ["separate", "merged"]), ",").alias("modes"))


@query(f"""WITH {_RANKED}, o AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start_us, pos)::INT AS place, greatest(0, start_us // 1000) AS ms, greatest(0, end_us // 1000) AS me FROM ranked WHERE rank <= 3)
SELECT video_id, string_agg(printf('%03d ', place) || printf('%02d:%02d:%02d.%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) || '-' || printf('%02d:%02d:%02d.%03d', me // 3600000, me // 60000 % 60, me // 1000 % 60, me % 1000)
|| printf(' score=%d clip-%d', final_score, pos), chr(10) ORDER BY place) AS log FROM o GROUP BY video_id""")
def q_order_log(spark, d):
    r = V.described(ranking.rank(V.clips(spark, d), 5, 3))
    return documents.order_log(ranking.reel_order(r, "chronological"))


@query(f"""WITH {V.FRAMES}, f AS (SELECT video_id, floor(frame / 7) AS fr, sqrt(avg(e * e)) AS e, count(*) AS n FROM frames GROUP BY video_id, floor(frame / 7))
SELECT video_id, count(*) AS n FROM f WHERE n = 7 GROUP BY video_id""")
def q_frames_per_timeline(spark, d):
    s = V.frames(spark, d).select("video_id", F.col("frame").alias("i"), F.col("e").alias("x"))
    return signals.rms_frames(s, per_frame=7, rate=100).groupBy("video_id").agg(F.count("*").alias("n"))


@query(f"WITH {_MEDIA}, seg AS ({_batches('10')}) SELECT video_id, chunk_index, start_sec, end_sec FROM seg WHERE chunk_index % 2 = 0 OR chunk_index = 0")
def q_surviving_batches(spark, d):
    b = chunks.batches(_media(spark, d), False, 20.0).withColumn("error", F.when((F.col("chunk_index") % 2 == 1), "failed"))
    return chunks.surviving(b)


@query(f"""WITH {_PLAN_ROWS}, n AS (SELECT video_id, bool_and(trunc(b * 1000) > trunc(a * 1000) AND b < 360000) AS ok FROM p WHERE final_score >= 6 GROUP BY video_id),
c AS (SELECT p.*, category, row_number() OVER (PARTITION BY video_id ORDER BY rank)::INT AS place FROM p JOIN n USING (video_id) JOIN ({V.CLIPS.removeprefix("clips AS ")}) q USING (video_id, pos) WHERE ok AND p.final_score >= 6)
SELECT video_id, place, trunc(a * 1000)::BIGINT * 1000 AS start_us, trunc(b * 1000)::BIGINT * 1000 AS end_us, printf('s%02d_clip_%03d_Moment-%d-%s.mp4', final_score::INT, place, pos::INT, category) AS file FROM c""")
def q_plan_cuts(spark, d):
    """The cuts that plans ask for, with the names of their files; plans that can't be read have none."""
    return runs.cuts_from(documents.parse_documents(_plans(spark, d), "plan"), "video_id", 6, strict=False)


@query(f"""WITH {V.CLIPS} SELECT video_id, count(*)::INT AS n_clips, round(sum(score), 6)::DOUBLE AS usd FROM clips GROUP BY video_id""")
def q_reply_cost(spark, d):
    """What replies say that they cost: a reply a timeline, its cost the sum of its scores."""
    c = V.clips(spark, d)
    clip = F.struct(F.concat(F.lit("c"), F.col("pos").cast("string")).alias("id"), F.lit(0).alias("start"), F.lit(1.5).alias("end"), F.lit("filler").alias("category"), F.lit("d").alias("description"),
                    "score", F.lit("r").alias("rationale"))
    told = c.groupBy("video_id").agg(F.collect_list(clip).alias("clips"), F.sum("score").cast("double").alias("cost"))
    raw = told.select("video_id", F.concat(F.lit("Here it is: "), F.to_json(F.struct("clips", F.struct("cost").alias("usage")))).alias("raw"))
    return replies.parse_plans(raw).select("video_id", F.size("clips").alias("n_clips"), "usd")
