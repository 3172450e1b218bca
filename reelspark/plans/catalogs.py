"""Queries on scans, configurations, lookups and set operations (A, B12-B13, H, K)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from reelspark.functions import geometry, text
from reelspark.operators import joins
from reelspark.plans.views import duck, rows
from reelspark.session import cut
from reelspark.sources import scans

_PATHS = """select source || '/' || lang || '/' || doc_id || case doc_id % 8 when 0 then '.MP4' when 1 then '.mov' when 2 then '.txt' when 3 then '.JPeG' when 4 then '.png' when 5 then '.webm' when 6 then '.tar.gz' else '' end as path, doc_id as row_ord from {documents}"""
_P = duck(_PATHS)
_KIND = "lower(regexp_extract(path, '\\.([^./]+)$', 1))"


def a1_video_scan(spark, d):
    return scans.of_kind(rows(spark, d, _PATHS), scans.VIDEO).select("path")


def a2_image_scan(spark, d):
    return scans.of_kind(rows(spark, d, _PATHS), scans.IMAGE).select("path")


def a3_flat_scan(spark, d):
    found = scans.flat_scan(rows(spark, d, _PATHS))
    return found.select("path")


def a4_input_union(spark, d):
    """Paths of a pattern, a folder's usual suffixes and a list file, each once, by the first that names it."""
    paths = rows(spark, d, _PATHS)
    line = F.when(F.col("row_ord") % 5 == 0, F.concat(F.lit("# "), "path")).when(F.col("row_ord") % 7 == 0, F.lit("  ")).when(F.col("row_ord") % 3 == 0, F.concat(F.lit(" gone/../"), "path")).otherwise(F.concat(F.lit(" ./no"), "path"))
    return scans.inputs(paths.select(F.concat(F.lit("/data/"), "path").alias("path")), "/data", patterns=["src1*/*/*.mov"], lists=paths.select("row_ord", line.alias("line")))


_DICTIONARIES = "select p_brand as dictionary, p_partkey as part, 'n' || p_partkey || case when p_size % 7 = 0 then '' else '_' || p_type end as name, case when p_size % 10 = 0 then '9' when p_size % 3 = 0 then '' else '0' end as category from {part}"


def a5_tag_dictionary(spark, d):
    """Tag dictionaries, here one text for each brand: the index is the line's place."""
    lines = F.array_sort(F.collect_list(F.struct("part", F.concat_ws(",", F.col("part"), "name", "category", F.lit("x")).alias("line"))))
    texts = rows(spark, d, _DICTIONARIES).groupBy("dictionary").agg(F.concat(F.lit("id,name,category,count\n"), F.array_join(F.transform(lines, lambda x: x["line"]), "\r\n"), F.lit("\n\n")).alias("value"))
    return scans.tag_dictionary(texts).withColumn("category", F.col("category").cast("long"))


_JSON = """select c_custkey as run, case when c_custkey % 3 = 0 then '{{"characters":[{{"find":"faces/' || c_mktsegment || '","replace":"p/x"}},{{"label":"second","reference_paths":["a","b"],"portrait_paths":[],"similarity_threshold":0.7}}]}}'
 when c_custkey % 3 = 1 then '{{"characters":[{{"source_label":"n' || c_nationkey || '","reference_paths":["r"],"portrait_paths":["p","q"]}}]}}' else '{{"characters":[]}}' end as json from {customer}"""


def a8_json_config(spark, d):
    raw = rows(spark, d, _JSON)
    got = scans.characters(raw)
    return got.select("run", F.col("ord").cast("long").alias("ord"), "source_label", "from_folders", F.coalesce(F.size("reference_paths"), F.lit(-1)).cast("long").alias("refs"), "similarity_threshold").withColumn("refs", F.when(F.col("from_folders"), -1).otherwise(F.col("refs")))


_VIDEO = "select o_orderkey as video, o_custkey * 3 + 1 as num_frames, cast(case when o_orderkey % 11 = 0 then 0 else 24 + o_orderkey % 7 end as double) as fps from {orders}"


def a9_video_info(spark, d):
    duration = geometry.duration(F.col("num_frames"), F.col("fps"))
    return rows(spark, d, _VIDEO).select("video", "num_frames", F.round(duration, 6).alias("seconds"), F.round(duration / 60, 6).alias("minutes"))


def a11_metadata(spark, d):
    """Fields of a JSON payload; null where it has none."""
    return rows(spark, d, "select event_id, props from {events}").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


def a12_sidecars(spark, d):
    """Texts written beside their files, and read again."""
    folder = f"{spark.sparkContext.getCheckpointDir()}/sidecars-{uuid.uuid4()}"
    texts = rows(spark, d, "select doc_id, text from {documents}").join(rows(spark, d, _PATHS).withColumnRenamed("row_ord", "doc_id"), "doc_id")
    made = scans.write_sidecars(texts.select(F.concat(F.lit(folder + "/"), scans.sidecar_path(F.col("path"))).alias("path"), "text"))
    back = scans.read_sidecars(cut(made))
    return back.select(F.substring(F.col("path"), F.lit(len(folder) + 2), F.length("path")).alias("sidecar"), F.md5("text").alias("md5"), "status")


def a13_media_paths(spark, d):
    return rows(spark, d, "select o_orderkey as video, cast(o_custkey % 30 as int) as person, cast(o_orderkey % 1200 as int) as seg from {orders}").select("video", text.person_segment(F.col("person"), F.col("seg")).alias("path"))


def a15_command_line(spark, d):
    options = F.create_map(F.lit("window_size"), F.array(F.col("size").cast("string")), F.lit("verbose"), F.array((F.col("size") % 2 == 0).cast("string")), F.lit("names"), F.when(F.col("size") % 3 == 0, F.array("brand", "type")).when(F.col("size") % 3 == 1, F.array().cast("array<string>")), F.lit("a_b"), F.when(F.col("size") % 5 == 0, F.array("brand")))
    return rows(spark, d, "select p_partkey as part, p_size as size, p_brand as brand, p_type as type from {part}").select("part", F.array_join(scans.command_line(options), "|").alias("argv"))


_CONF = "select c_custkey as run, case when c_custkey % 4 = 0 then '' else c_name end as input_video, case when c_custkey % 5 = 0 then null else c_name end as output_video, cast(c_nationkey % 6 as int) as n from {customer}"


def b12_config_errors(spark, d):
    runs = rows(spark, d, _CONF)
    paths = lambda kind, n: F.transform(F.slice(F.array(F.lit(1), F.lit(2), F.lit(3)), 1, n.cast("int")), lambda k: F.concat(F.lit(kind), F.col("run") + k, F.lit("_"), F.col("ord")))
    many = runs.withColumn("ord", F.explode(F.slice(F.array(*map(F.lit, range(6))), 1, F.col("n")))).select("run", "ord", F.concat(F.lit("n"), "ord").alias("source_label"), paths("r", (F.col("run") + F.col("ord")) % 3).alias("reference_paths"), paths("p", (F.col("run") + 2 * F.col("ord")) % 4).alias("portrait_paths"))
    there = rows(spark, d, "select c_name as path from {customer} where c_custkey % 7 <> 0 union all select 'r' || c_custkey || '_' || k from {customer}, (select explode(sequence(0, 5)) as k) where c_custkey % 3 <> 0 union all select 'p' || c_custkey || '_' || k from {customer}, (select explode(sequence(0, 5)) as k) where c_custkey % 4 <> 0")
    got = scans.config_errors(runs, many, there)
    return got.select("run", F.size("errors").cast("long").alias("n"), F.array_join("errors", "; ").alias("errors"))


def b13_argument_ranges(spark, d):
    return rows(spark, d, "select l_orderkey as run, l_linenumber as n, l_discount * 12 as unit, l_quantity as chunk, l_partkey as part, l_suppkey as supp from {lineitem}").select("run", "part", "supp", (F.col("n") > 3).alias("positive"), F.col("unit").between(0, 1).alias("in_unit"), ((F.col("chunk") > 0) & (F.col("chunk") <= 30)).alias("chunk_ok"))


_IMAGES = "select source as rel_dir, lang || '_' || (doc_id // 4) || case doc_id % 4 when 0 then '_orig' when 1 then '_aug' || doc_id when 2 then '_x_august_aug01' else '' end as stem, doc_id from {documents}"
_IM = duck(_IMAGES)


def _images(spark, d):
    return rows(spark, d, _IMAGES.replace("doc_id // 4", "cast(floor(doc_id / 4) as bigint)"))


def _captions(spark, d):
    found = _images(spark, d).where("doc_id % 8 < 6").select("rel_dir", text.source_stem(F.col("stem")).alias("stem"), "doc_id")
    return found.groupBy("rel_dir", "stem").agg(F.format_string("text %d", F.min("doc_id")).alias("text"))


def h1_copied_captions(spark, d):
    done = _images(spark, d).where("doc_id % 3 = 0").select("rel_dir", "stem")
    return joins.copied_captions(_images(spark, d), _captions(spark, d), done).select("doc_id", "rel_dir", "stem", "source_stem", "text", "status")


def h2_source_stem(spark, d):
    return _images(spark, d).select("doc_id", text.source_stem(F.col("stem")).alias("source_stem"))


def h3_not_yet_done(spark, d):
    return joins.not_yet_done(rows(spark, d, "select doc_id, source, lang from {documents}"), rows(spark, d, "select doc_id from {labels}"), ["doc_id"])


def h4_not_started(spark, d):
    """Customers without an urgent order."""
    return joins.not_yet_done(rows(spark, d, "select c_custkey as k, c_name as name from {customer}"), rows(spark, d, "select o_custkey as k from {orders} where o_orderpriority = '1-URGENT'"), ["k"])


def h5_scores_by_name(spark, d):
    faces = rows(spark, d, "select l_partkey as k, count(*) as faces from {lineitem} group by l_partkey")
    return faces.join(rows(spark, d, "select p_partkey as k, p_retailprice as score from {part}"), "k")


def h6_swap_pairs(spark, d):
    tracks = rows(spark, d, "select o_orderkey as track_id, case when o_custkey % 4 > 0 then o_orderpriority end as label from {orders}")
    targets = rows(spark, d, "select o_orderpriority as label, count(*) % 3 as portraits from {orders} group by o_orderpriority")
    return joins.swap_pairs(tracks, targets).select("track_id", "label", "portraits")


_SCAN3 = "select row_ord, path from ({p})"


def h8_first_wins(spark, d):
    paths = rows(spark, d, _PATHS).select(F.regexp_replace("path", r"/\d+", "/x").alias("path"), "row_ord")
    return joins.first_of_each([paths.where("row_ord % 2 = 1"), paths])


def h9_variants(spark, d):
    return joins.variants(rows(spark, d, "select p_name as stem, p_partkey as part from {part}"), 3, True).select("part", "out")


def k6_url_status(spark, d):
    """What becomes of each address: skipped (no id, or done), or fetched."""
    pages = rows(spark, d, "select page_id, 'https://www.youtube.com/watch?v=' || page_id || '&t=1' as a, url as b from {pages}")
    chosen = pages.withColumn("url", F.when(F.col("page_id") % 2 == 0, F.col("a")).otherwise(F.col("b"))).withColumn("id", text.video_id(F.col("url")))
    done = rows(spark, d, "select cast(doc_id as string) as id from {labels}").distinct().withColumn("done", F.lit(True))
    status = F.when(F.col("id").isNull(), "skipped_invalid").when(F.coalesce("done", F.lit(False)), "skipped_existing").otherwise("fetch")
    return chosen.join(done, "id", "left").select("page_id", "id", status.alias("status"))


def k11_default_ends(spark, d):
    """Segments without an end last the default duration."""
    return rows(spark, d, "select conv_id, turn, turn * 5.0 as s, case when turn % 2 = 0 then turn * 5.0 + 3 end as e from {conversations}").select("conv_id", "turn", F.coalesce(F.col("e"), F.col("s") + 30).cast("double").alias("end_s"))


QUERIES = {f.__name__: f for f in (a1_video_scan, a2_image_scan, a3_flat_scan, a4_input_union, a5_tag_dictionary, a8_json_config, a9_video_info, a11_metadata, a12_sidecars, a13_media_paths, a15_command_line, b12_config_errors, b13_argument_ranges, h1_copied_captions, h2_source_stem, h3_not_yet_done, h4_not_started, h5_scores_by_name, h6_swap_pairs, h8_first_wins, h9_variants, k6_url_status, k11_default_ends)}


def _in(names) -> str:
    return "(" + ", ".join(f"'{x}'" for x in names) + ")"


_STEM = "case when stem like '%\\_orig' escape '\\' then regexp_replace(stem, '_orig$', '') else regexp_replace(stem, '^(.*)_aug.*$', '\\1') end"

ORACLES = {
    "a1_video_scan": f"select path from ({_P}) where {_KIND} in {_in(scans.VIDEO)}",
    "a2_image_scan": f"select path from ({_P}) where {_KIND} in {_in(scans.IMAGE)}",
    "a3_flat_scan": f"select path from ({_P}) where {_KIND} in {_in(scans.IMAGE)} order by path",
    "a4_input_union": f"""select path, src_ord::int as src_ord, row_ord from (select *, row_number() over (partition by path order by src_ord, row_ord nulls first) as k from (select '/data/' || path as path, 0 as src_ord, null as row_ord from ({_P}) where regexp_full_match(path, 'src1[^/]*/[^/]*/[^/]*\\.mov')
 union all select '/data/' || path, list_position({list(scans.DEFAULT_INPUT)!r}, regexp_extract(path, '\\.[^./]+$')), null from ({_P}) where regexp_extract(path, '\\.[^./]+$') in {_in(scans.DEFAULT_INPUT)}
 union all select '/data/' || path, 1000000, row_ord from ({_P}) where row_ord % 5 <> 0 and row_ord % 7 <> 0 and row_ord % 3 = 0)) where k = 1""",
    "a5_tag_dictionary": f"select dictionary, row_number() over (partition by dictionary order by part) - 1 as idx, name, case category when '9' then 9 else 0 end::bigint as category from ({duck(_DICTIONARIES)})",
    "a8_json_config": """select c_custkey as run, 0::bigint as ord, c_mktsegment as source_label, true as from_folders, -1::bigint as refs, 0.5::double as similarity_threshold from customer where c_custkey % 3 = 0
 union all select c_custkey, 1, 'second', false, 2, 0.7 from customer where c_custkey % 3 = 0 union all select c_custkey, 0, 'n' || c_nationkey, false, 1, 0.5 from customer where c_custkey % 3 = 1""",
    "a9_video_info": f"select video, num_frames, round(s, 6) as seconds, round(s / 60, 6) as minutes from (select *, case when fps > 0 then num_frames / fps else 0.0 end as s from ({duck(_VIDEO)}))",
    "a11_metadata": "select event_id, json_extract(props, '$.k')::bigint as k from events",
    "a12_sidecars": f"select regexp_replace(path, '\\.[^./]+$', '') || '.txt' as sidecar, md5(text) as md5, 'created' as status from ({_P}) join documents on doc_id = row_ord",
    "a13_media_paths": "select o_orderkey as video, printf('person_%02d/seg_%03d', o_custkey % 30, o_orderkey % 1200) as path from orders",
    "a15_command_line": """select p_partkey as part, concat_ws('|', case when p_size % 5 = 0 then '--a-b|' || p_brand end, case when p_size % 3 = 0 then '--names|' || p_brand || '|' || p_type end, case when p_size % 2 = 0 then '--verbose' end, '--window-size|' || p_size) as argv from part""",
    "b12_config_errors": f"""with r as ({duck(_CONF)}), c as (select run, ord, 'n' || ord as l, list_transform(range(1, (run + ord) % 3 + 1), lambda k: 'r' || (run + k) || '_' || ord) as refs, list_transform(range(1, (run + 2 * ord) % 4 + 1), lambda k: 'p' || (run + k) || '_' || ord) as ports from (select run, unnest(range(n)) as ord from r)),
f as (select c_name as path from customer where c_custkey % 7 <> 0 union all select 'r' || c_custkey || '_' || k from customer, range(6) as t(k) where c_custkey % 3 <> 0 union all select 'p' || c_custkey || '_' || k from customer, range(6) as t(k) where c_custkey % 4 <> 0),
e as (select run, case when input_video = '' then 'input_video is required' else 'input_video not found: ' || input_video end as error, 0 as k, 0 as ord, 0 as part, 0 as place from r where input_video = '' or input_video not in (select path from f)
 union all select run, 'output_video is required', 1, 0, 0, 0 from r where output_video is null union all select run, 'At least one character mapping is required', 2, 0, 0, 0 from r where n = 0 union all select run, 'Maximum of 3 character replacements supported', 3, 0, 0, 0 from r where n > 3
 union all select run, 'Character ' || chr(39) || l || chr(39) || ' has no reference images (needed to identify the face in the video)', 5, ord, 0, 0 from c where len(refs) = 0
 union all select run, 'Reference image not found for ' || chr(39) || l || chr(39) || ': ' || path, 5, ord, 1, place from (select run, ord, l, unnest(refs) as path, unnest(range(len(refs))) as place from c) where path not in (select path from f)
 union all select run, 'Character ' || chr(39) || l || chr(39) || ' has no portrait images (the replacement face)', 5, ord, 2, 0 from c where len(ports) = 0
 union all select run, 'Portrait not found for ' || chr(39) || l || chr(39) || ': ' || path, 5, ord, 3, place from (select run, ord, l, unnest(ports) as path, unnest(range(len(ports))) as place from c) where path not in (select path from f))
select r.run, count(e.error) as n, coalesce(string_agg(e.error, '; ' order by k, ord, part, place), '') as errors from r left join e using (run) group by r.run""",
    "b13_argument_ranges": "select l_orderkey as run, l_partkey as part, l_suppkey as supp, l_linenumber > 3 as positive, l_discount * 12 between 0 and 1 as in_unit, l_quantity > 0 and l_quantity <= 30 as chunk_ok from lineitem",
    "h1_copied_captions": f"""with i as (select *, {_STEM} as source_stem from ({_IM})), c as (select rel_dir, source_stem, 'text ' || min(doc_id) as text from i where doc_id % 8 < 6 group by all),
o as (select distinct rel_dir, stem, true as there from ({_IM}) where doc_id % 3 = 0)
select doc_id, i.rel_dir, i.stem, i.source_stem, text, case when text is null then 'skipped_no_source' when coalesce(there, false) then 'skipped_existing' else 'created' end as status from i left join c using (rel_dir, source_stem) left join o using (rel_dir, stem)""",
    "h2_source_stem": f"select doc_id, {_STEM} as source_stem from ({_IM})",
    "h3_not_yet_done": "select doc_id, source, lang from documents where doc_id not in (select doc_id from labels)",
    "h4_not_started": "select c_custkey as k, c_name as name from customer where c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT')",
    "h5_scores_by_name": "select p_partkey as k, count(*) as faces, any_value(p_retailprice) as score from lineitem join part on l_partkey = p_partkey group by p_partkey",
    "h6_swap_pairs": "select o_orderkey as track_id, o_orderpriority as label, portraits from orders join (select o_orderpriority as p, count(*) % 3 as portraits from orders group by all) on p = o_orderpriority where o_custkey % 4 > 0 and portraits > 0",
    "h8_first_wins": f"""select path, src_ord, row_ord from (select *, row_number() over (partition by path order by src_ord, row_ord) as k from (select regexp_replace(path, '/[0-9]+', '/x') as path, 0 as src_ord, row_ord from ({_P}) where row_ord % 2 = 1 union all select regexp_replace(path, '/[0-9]+', '/x'), 1, row_ord from ({_P}))) where k = 1""",
    "h9_variants": "select p_partkey as part, p_name || printf('_aug%03d', k) as out from part, range(3) as t(k) union all select p_partkey, p_name || '_orig' from part",
    "k6_url_status": """select page_id, id, case when id is null then 'skipped_invalid' when id in (select doc_id::varchar from labels) then 'skipped_existing' else 'fetch' end as status from (select page_id, case when page_id % 2 = 0 then page_id::varchar end as id from pages)""",
    "k11_default_ends": "select conv_id, turn, coalesce(case when turn % 2 = 0 then turn * 5.0 + 3 end, turn * 5.0 + 30)::double as end_s from conversations",
}
