"""Queries on scalar functions, transcripts and windowed reduction (I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelspark.functions import text
from reelspark.operators import reduce
from reelspark.plans.views import TIMED, duck, rows

TM = duck(TIMED)
_SECONDS = "select doc_id, cast(n_chars * 1.3337 - 400 as double) as s from {documents}"
_SEC = duck(_SECONDS)


def i1_clock(spark, d):
    return rows(spark, d, _SECONDS).select("doc_id", text.clock(F.round("s", 4)).alias("clock"))


def i2_clock_short(spark, d):
    return rows(spark, d, _SECONDS).select("doc_id", text.clock_short(F.greatest("s", F.lit(0.0))).alias("clock"))


_URL = """select page_id, case page_id % 8 when 0 then 'https://youtu.be/' || page_id || '?t=3' when 1 then 'https://m.youtube.com/watch?list=z&v=' || page_id || '&t=1' when 2 then 'https://www.youtube.com/shorts/' || page_id || '/x'
 when 3 then 'https://youtube.com/live/' || page_id when 4 then 'https://www.youtube.com/channel/' || page_id when 5 then 'https://notyoutube.com/watch?v=1' else url end as url from {pages}"""


def i3_video_id(spark, d):
    return rows(spark, d, _URL).select("page_id", text.video_id(F.col("url")).alias("id"))


_MODEL = "select p_partkey as part, p_size as size, case when p_size % 2 = 0 then 'Qwen/Qwen3-VL-' || p_size else 'qwen2.5/' || p_brand end as model from {part}"


def i4_patch_pixels(spark, d):
    return rows(spark, d, _MODEL).select("part", text.patch_size(F.col("model")).cast("long").alias("patch"), text.edge_pixels(F.col("size"), F.col("model")).cast("long").alias("pixels"))


def i5_expand_grid(spark, d):
    grid = text.expand_grid(F.col("size") % 5 + 1, F.col("size"), F.col("size") * 2)
    return rows(spark, d, _MODEL).select("part", F.posexplode(grid).alias("k", "g")).select("part", F.col("k").cast("long").alias("k"), *(F.get("g", F.lit(j)).alias(n) for j, n in enumerate("thw")))


_THINK = "select conv_id, turn, case when turn % 3 = 0 then 'plan </think> \n ' || text || '</think> x' else text end as t from {conversations}"


def i6_after_reasoning(spark, d):
    return rows(spark, d, _THINK).select("conv_id", "turn", text.after_reasoning(F.col("t")).alias("answer"))


_ERRORS = """select event_id, event_type, case when event_id % 3 = 0 then event_type when event_id % 11 = 4 then 'Failed to apply Qwen processor' else 'Code ' || (event_id % 7) end as m,
 case when event_id % 2 = 0 then '{{"error": {{"code": 400, "message": "Token count of IMAGE, truncation=''max_length''", "also": ["' || event_type || '", null, "an image: ' || chr(92) || '"x' || chr(92) || '"", {{"deep": ["one", "two"]}}]}}}}' when event_id % 5 = 0 then 'plain "text": body' end as body from {events}"""


def _flat(spark, d):
    parts = F.concat(F.array("event_type", "m"), text.error_texts(F.col("body")))
    return rows(spark, d, _ERRORS).select("event_id", text.flat_errors(parts).alias("message"))


def i7_flat_errors(spark, d):
    return _flat(spark, d)


def i8_retries(spark, d):
    return _flat(spark, d).select("event_id", text.worth_retrying(F.col("message")).alias("again"))


def i9_halvings(spark, d):
    sizes = text.halvings(F.col("size").cast("int") * 15)
    return rows(spark, d, _MODEL).select("part", F.array_join(F.transform(sizes, lambda x: x.cast("string")), ",").alias("sizes"))


_ASR = """select conv_id as media, turn as segment_index, turn * 10.0 as start, case turn % 4 when 0 then '{{"chunks":[{{"text":" one ' || conv_id || '","timestamp":[0.5,1.25]}},{{"text":"two","timestamp":[1.5,null]}},{{"text":"","timestamp":[0,1]}}]}}'
 when 1 then '{{"chunks":[{{"text":"three ","timestamps":{{"start":2,"end":3.5}}}}]}}' when 2 then '{{"text":"plain ' || turn || '"}}' else '"spoken"' end as result from {conversations}"""


def _parts(spark, d):
    return reduce.transcript_parts(rows(spark, d, _ASR).withColumn("start", F.col("start").cast("double")))


def i10_transcript(spark, d):
    return _parts(spark, d).select("media", F.col("segment_index").alias("unit"), F.col("chunk").cast("long").alias("chunk"), "text", "start_s", "end_s")


def i10_raw_text(spark, d):
    return reduce.raw_text(_parts(spark, d))


def i11_listing(spark, d):
    timed = rows(spark, d, TIMED).select("media", "ord", F.when(F.col("ord") % 5 != 3, F.col("start_s").cast("double")).alias("start_s"), F.round(F.col("end_s").cast("double"), 3).alias("end_s"), "text", F.when(F.col("media") % 2 == 0, F.lit(" all of it ")).alias("raw"))
    return reduce.rendered(timed)


def i12_frame_ranges(spark, d):
    fps = F.when(F.col("media") % 3 == 0, 0.0).otherwise(24.0)
    first, last = text.frame_range(F.round("start_s", 3), F.round("end_s", 3), fps, F.when(F.col("media") % 2 == 0, 400).otherwise(0))
    shown = F.when(F.trim("text") == "", "<no text>").otherwise(F.trim("text"))
    timed = rows(spark, d, TIMED).withColumns({c: F.col(c).cast("double") for c in ("start_s", "end_s")})
    return timed.select("media", "ord", first.cast("long").alias("first_frame"), last.cast("long").alias("last_frame"), F.length(shown).cast("long").alias("length"))


_TALKS = """select conv_id as media, 'v/' || conv_id || '.mp4' as path, cast(640 + conv_id % 3 as int) as width, cast(360 + conv_id % 2 as int) as height, cast(case when conv_id % 3 = 0 then 0 else 24 end as double) as fps, cast(case when conv_id % 4 = 0 then 0 else 200 + conv_id % 900 end as int) as num_frames,
 cast(16 + conv_id % 900 as int) as nframes, cast(case when conv_id % 5 = 0 then 0 else 1000 + conv_id end as int) as total_pixels, cast(conv_id % 4 as double) / 2 as spf, case when conv_id % 6 <> 0 then 'Describe ' || conv_id else '' end as prompt, case conv_id % 3 when 0 then 'Be brief.' when 1 then '' end as system,
 conv_id % 2 = 0 as more, case when conv_id % 5 < 3 then 'all that was said in ' || conv_id end as transcript, conv_id % 7 = 0 as video_only from (select distinct conv_id from {conversations})"""


def i13_messages(spark, d):
    """The chat message about each video, its text parts in one string."""
    told = rows(spark, d, TIMED).where("media % 8 <> 5").select("media", "ord", F.when(F.col("ord") % 5 != 2, F.round(F.col("start_s").cast("double"), 3)).alias("start_s"), F.round(F.col("end_s").cast("double"), 3).alias("end_s"), F.when(F.col("ord") % 4 != 3, F.col("text")).alias("text"))
    got = reduce.messages(rows(spark, d, _TALKS), told)
    return got.select("media", "system", "video", F.col("nframes").cast("long").alias("nframes"), F.col("total_pixels").cast("long").alias("total_pixels"), F.array_join("texts", "|").alias("texts"))


def i14_segment_prompts(spark, d):
    timed = rows(spark, d, TIMED).withColumns({c: F.col(c).cast("double") for c in ("start_s", "end_s")})
    return timed.select("media", "ord", F.concat(F.lit("[Video segment "), F.col("ord") + 1, F.lit(": "), text.clock_short(F.col("start_s")), F.lit("–"), text.clock_short(F.col("end_s")), F.lit("]")).alias("note"))


def _turns(spark, d):
    return rows(spark, d, "select conv_id as key, turn as ord, text from {conversations}")


def _short(body):
    """A stand-in for a summarising model: a digest of what it was given."""
    return F.concat(F.lit("summary "), F.md5(body))


def i15_windows(spark, d):
    return reduce.windows(_turns(spark, d), 3, _short).select("key", F.col("ord").cast("long").alias("ord"), "text")


def i16_consolidated(spark, d):
    return reduce.consolidated(_turns(spark, d), 3, "Summarise.", _short)


def i17_assembled(spark, d):
    body = reduce.consolidated(_turns(spark, d), 3, "Summarise.", _short).select("key", F.when(F.col("key") % 3 != 0, _short(F.col("body"))).alias("summary"))
    turns = _turns(spark, d).groupBy("key").agg(reduce.in_order("ord", F.col("text"), "\n\n").alias("all"))
    return body.join(turns, "key").select("key", reduce.assembled(F.col("summary"), F.col("all")).alias("output"))


_SIZES = "select o_orderkey as image, 200 + o_custkey % 3000 as w, 100 + o_orderkey % 2500 as h from {orders}"


def i18_resized(spark, d):
    w, h = text.resized(F.col("w"), F.col("h"), 1280)
    return rows(spark, d, _SIZES).select("image", w.alias("new_w"), h.alias("new_h"))


_STEMS = "select p_partkey as part, case p_size % 7 when 0 then 'UniFace_simswap' when 1 then 'hyperswap_1a' when 2 then 'x_blendswap' when 3 then 'SimSwap512' when 4 then 'inswapper_128' else p_brand end as stem from {part}"


def i19_model_family(spark, d):
    return rows(spark, d, _STEMS).select("part", text.model_family(F.concat(F.lit("models/"), "stem", F.lit(".onnx"))).alias("family"))


def i20_tensor_roles(spark, d):
    shape = F.when(F.col("size") % 5 == 0, F.array(F.lit(1), F.lit(512))).when(F.col("size") % 5 == 1, F.array(*map(F.lit, (1, 3, 128, 128)))).when(F.col("size") % 5 == 2, F.array(*map(F.lit, (1, 512, 1, 1)))).when(F.col("size") % 5 == 3, F.array(F.lit(7)))
    return rows(spark, d, _MODEL).select("part", text.tensor_role(shape).alias("role"))


def i21_output_dirs(spark, d):
    return rows(spark, d, _MODEL).select("part", text.output_dir(F.col("model")).alias("dir"))


def i22_labels(spark, d):
    return rows(spark, d, _MODEL).select("part", F.format_string("person_%02d", "size").alias("label"), F.format_string("frame%06d_face%d", "part", "size").alias("face"))


QUERIES = {f.__name__: f for f in (i1_clock, i2_clock_short, i3_video_id, i4_patch_pixels, i5_expand_grid, i6_after_reasoning, i7_flat_errors, i8_retries, i9_halvings, i10_transcript, i10_raw_text, i11_listing, i12_frame_ranges, i13_messages, i14_segment_prompts, i15_windows, i16_consolidated, i17_assembled, i18_resized, i19_model_family, i20_tensor_roles, i21_output_dirs, i22_labels)}


def _clock(s: str) -> str:
    return f"printf('%d:%02d:%02d.%03d', trunc(greatest({s}, 0.0))::bigint // 3600, trunc(greatest({s}, 0.0))::bigint % 3600 // 60, trunc(greatest({s}, 0.0))::bigint % 60, round_even((greatest({s}, 0.0) - trunc(greatest({s}, 0.0))) * 1000, 0)::bigint)"


def _short_clock(s: str) -> str:
    return f"printf('%02d:%02d:%02d', trunc({s})::bigint // 3600, trunc({s})::bigint % 3600 // 60, trunc({s})::bigint % 60)"


_URLS = duck(_URL)
_MO = duck(_MODEL)
_ER = duck(_ERRORS)
_MSG = "lower(array_to_string(list_filter([event_type, case when m <> event_type then m end, body], lambda x: x is not null), chr(10)))"
_I10 = """with u as (select conv_id as media, turn as unit, turn * 10.0 as b, turn % 4 as k from conversations),
p as (select media, unit, 0::bigint as chunk, 'one ' || media as text, (b + 0.5)::double as start_s, (b + 1.25)::double as end_s from u where k = 0 union all select media, unit, 1, 'two', null, null from u where k = 0
 union all select media, unit, 0, 'three', b + 2, b + 3.5 from u where k = 1 union all select media, unit, 0, 'plain ' || unit, null, null from u where k = 2 union all select media, unit, 0, 'spoken', null, null from u where k = 3)"""
_I15 = """with t as (select conv_id as key, text, row_number() over (partition by conv_id order by turn) as rn, count(*) over (partition by conv_id) as n from conversations),
w as (select key, (rn - 1) // 3 as ord, 'summary ' || md5(string_agg('--- Segment ' || rn || ' ---' || chr(10) || text, chr(10) || chr(10) order by rn)) as text, min(n) as n from t where n > 3 group by all union all select key, rn - 1, text, n from t where n <= 3),
c as (select key, 'Summarise.' || chr(10) || chr(10) || string_agg('--- ' || case when n > 3 then 'Window ' else 'Segment ' end || (ord + 1) || ' ---' || chr(10) || text, chr(10) || chr(10) order by ord) as body from w group by key)"""

# The strings of a payload: all that is quoted and not followed by a colon.
_FLAT = f"""select event_id, lower(array_to_string(list_filter(list_transform(p, lambda x, i: case when x is not null and x <> '' and list_position(p, x) = i then x end), lambda x: x is not null), chr(10))) as message from
 (select event_id, list_concat([event_type, m], case when body is null then [] when body like '{{%' then list_transform(list_filter(list_zip(regexp_extract_all(body, '"((?:[^"\\\\]|\\\\.)*)"(\\s*:)?', 1), regexp_extract_all(body, '"((?:[^"\\\\]|\\\\.)*)"(\\s*:)?', 2)), lambda z: coalesce(z[2], '') = ''), lambda z: ('"' || z[1] || '"')::json ->> '$') else [body] end) as p
 from ({duck(_ERRORS).replace('{{', '{').replace('}}', '}')}))"""
_I13 = f"""with v as ({duck(_TALKS)}), s as (select *, row_number() over (partition by media order by ord) as no from (select media, ord, case when ord % 5 <> 2 then round(start_s::double, 3) end as a, round(end_s::double, 3) as b, case when ord % 4 <> 3 then text end as text from ({duck(TIMED)}) where media % 8 <> 5)),
f as (select s.*, num_frames, round_even(greatest(0.0, a) * (case when fps > 0 then fps else 30.0 end), 0)::int as f1, round_even(greatest(a, b) * (case when fps > 0 then fps else 30.0 end), 0)::int as f2 from s join v using (media) where a is not null and b is not null),
g as (select *, case when num_frames > 0 then least(greatest(0, f1), num_frames - 1) else f1 end as g1 from f),
h as (select *, case when num_frames > 0 then least(greatest(g1, f2), num_frames - 1) else f2 end as g2 from g),
l as (select media, string_agg('Segment ' || no || ': ' || {_clock('a')} || ' – ' || {_clock('b')} || ' (frames ' || g1 || '–' || g2 || ')' || chr(10) || case when trim(coalesce(text, '')) = '' then '<no text>' else trim(text) end, chr(10) order by no) as lines from h group by media)
select media, case when system <> '' then system end as system, path as video, case when not video_only then least(768, case when spf > 0 then greatest(1, case when spf * fps > 0 then trunc(num_frames / (spf * fps))::int else nframes end) else nframes end) end::bigint as nframes,
 case when not video_only then case when total_pixels > 0 then total_pixels else width * height end end::bigint as total_pixels,
 concat_ws('|', 'Here is an automatic transcription of the video''s audio track. Use it together with the visual frames to better understand the scene, dialogue, speakers, and any on-screen text they mention:' || chr(10) || chr(10) || transcript,
 'Timestamp-aligned audio segments with approximate frame ranges:' || chr(10) || lines, case when prompt <> '' then prompt end, case when more then 'Continue describing the video in more detail, focusing on any aspects you haven''t mentioned yet.' end) as texts from v left join l using (media)"""

ORACLES = {
    "i1_clock": f"select doc_id, {_clock('s')} as clock from (select doc_id, round(s, 4) as s from ({_SEC}))",
    "i2_clock_short": f"select doc_id, {_short_clock('greatest(s, 0.0)')} as clock from ({_SEC})",
    "i3_video_id": "select page_id, case when page_id % 8 < 4 then page_id::varchar end as id from pages",
    "i4_patch_pixels": f"select part, case when size % 2 = 0 then 32 else 28 end::bigint as patch, (size * case when size % 2 = 0 then 1024 else 784 end)::bigint as pixels from ({_MO})",
    "i5_expand_grid": f"select part, unnest(range(size % 5 + 1)) as k, 1::bigint as t, size::bigint as h, size * 2::bigint as w from ({_MO})",
    "i6_after_reasoning": f"select conv_id, turn, case when instr(t, '</think>') > 0 then regexp_replace(substring(t, instr(t, '</think>') + 8), '^\\s+', '') else t end as answer from ({duck(_THINK)})",
    "i7_flat_errors": f"select event_id, message from ({_FLAT})",
    "i8_retries": f"""select event_id, (contains(message, 'token count') and (contains(message, 'truncation=' || chr(39) || 'max_length' || chr(39)) or contains(message, 'truncation="max_length"')) and (contains(message, 'image') or contains(message, 'video')))
 or (contains(message, 'failed to apply qwen') and contains(message, 'processor') and contains(message, 'image')) as again from ({_FLAT})""",
    "i9_halvings": f"select part, array_to_string(list_transform(range(floor(log2(size * 15))::bigint + 1), lambda k: (size * 15) // (2 ** k)::bigint), ',') as sizes from ({_MO})",
    "i10_transcript": f"{_I10} select * from p",
    "i10_raw_text": f"{_I10} select media, string_agg(text, ' ' order by unit, chunk) as raw from p group by media",
    "i11_listing": f"""select media, case when media % 2 = 0 then 'Raw transcript (no timestamps):' || chr(10) || 'all of it' || chr(10) || chr(10) else '' end || 'Transcript with timestamps:' || coalesce(chr(10) || string_agg(rn || chr(10) || {_clock('s')} || ' --> ' || {_clock('e')} || case when trim(text) <> '' then chr(10) || trim(text) else '' end, chr(10) || chr(10) order by rn) filter (where ord % 5 <> 3), '') as listing
 from (select media, ord, start_s::double as s, round(end_s::double, 3) as e, text, row_number() over (partition by media order by ord) as rn from ({TM})) group by media""",
    "i12_frame_ranges": f"""select media, ord, a as first_frame, case when n > 0 then least(greatest(a, b), n - 1) else b end as last_frame, l as length from (select *, case when n > 0 then least(greatest(0, a0), n - 1) else a0 end as a from
 (select media, ord, round_even(greatest(0.0, round(start_s::double, 3)) * fps, 0)::bigint as a0, round_even(greatest(round(start_s::double, 3), round(end_s::double, 3)) * fps, 0)::bigint as b, case when media % 2 = 0 then 400 else 0 end as n, length(case when trim(text) = '' then '<no text>' else trim(text) end) as l from (select *, case when media % 3 = 0 then 30.0 else 24.0 end::double as fps from ({TM}))))""",
    "i13_messages": _I13,
    "i14_segment_prompts": f"select media, ord, '[Video segment ' || (ord + 1) || ': ' || {_short_clock('start_s::double')} || '–' || {_short_clock('end_s::double')} || ']' as note from ({TM})",
    "i15_windows": f"{_I15} select key, ord, text from w",
    "i16_consolidated": f"{_I15} select * from c",
    "i17_assembled": f"""{_I15} select c.key, case when c.key % 3 <> 0 then '=== Consolidated Summary ===' || chr(10) || chr(10) || 'summary ' || md5(body) || chr(10) || chr(10) || '=== Per-Segment Descriptions ===' || chr(10) || chr(10) else '' end || a as output from c join (select key, string_agg(text, chr(10) || chr(10) order by rn) as a from t group by key) using (key)""",
    "i18_resized": f"select image, trunc(w * s)::int as new_w, trunc(h * s)::int as new_h from (select *, least(1.0, 1280.0::double / greatest(w, h)) as s from ({duck(_SIZES)}))",
    "i19_model_family": "select p_partkey as part, case p_size % 7 when 0 then 'uniface' when 1 then 'hyperswap' when 2 then 'blendswap' when 3 then 'simswap' else 'inswapper' end as family from part",
    "i20_tensor_roles": f"select part, case size % 5 when 0 then 'embedding' when 1 then 'image' when 2 then 'embedding' else 'unknown' end as role from ({_MO})",
    "i21_output_dirs": f"select part, 'desc-vllm-' || replace(model, '/', '_') as dir from ({_MO})",
    "i22_labels": f"select part, printf('person_%02d', size) as label, printf('frame%06d_face%d', part, size) as face from ({_MO})",
}
