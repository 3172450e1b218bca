"""Queries on galleries, vectors and clustering (A6, A7, D)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelspark.functions import geometry, vec
from reelspark.operators import cluster
from reelspark.plans.timeline import cosine_sql
from reelspark.plans.views import BOXES, FACES, duck, rows

FA, BX = duck(FACES), duck(BOXES)


def _faces(spark, d):
    return rows(spark, d, FACES).withColumn("enc", F.col("enc").cast("array<double>"))


def a6_gallery_top(spark, d):
    faces = _faces(spark, d).withColumn("enc", F.when(F.col("arrival") % 7 != 0, F.col("enc"))).withColumn("path", F.format_string("img_%08d", F.col("arrival")))
    return cluster.top_per_identity(faces, 3).select("identity", "path")


def a7_largest_face(spark, d):
    faces = _faces(spark, d).withColumn("image", F.floor(F.col("arrival") / 3)).withColumn("enc", F.when(F.col("arrival") % 11 != 0, F.col("enc")))
    return cluster.largest_face(faces, ["image"], F.col("arrival") * 37 % 5, "arrival").select("image", "arrival")


def _before():
    return F.lag("enc").over(W.partitionBy("identity").orderBy("arrival"))


def d1_cosine_distance(spark, d):
    return _faces(spark, d).withColumn("p", _before()).where("p is not null").select("arrival", F.round(vec.cosine_distance(F.col("p"), F.col("enc")), 9).alias("distance"))


def d2_euclidean_distance(spark, d):
    return _faces(spark, d).withColumn("p", _before()).where("p is not null").select("arrival", F.round(vec.euclidean(F.col("p"), F.col("enc")), 9).alias("distance"))


def d3_greedy_persons(spark, d):
    return cluster.greedy_persons(_faces(spark, d), 0.75, metric="cosine")


def _references(spark, d):
    named = {0: "alice", 1: "person_05", 2: "alice"}
    found = _faces(spark, d).where(F.col("arrival").isin(list(named))).orderBy("arrival").collect()  # three named references
    return [(named[r.arrival], r.enc) for r in found]


def d3_seeded_persons(spark, d):
    return cluster.greedy_persons(_faces(spark, d), 0.75, _references(spark, d), metric="cosine")


def g11_person_groups(spark, d):
    return cluster.greedy_persons(_faces(spark, d), 0.75, metric="cosine").groupBy("video", "label").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.format_string("%08d", "arrival"))), ",").alias("members"))


def _greedy(seed: str, first: int) -> str:
    best = f"list_min(list_transform(r.known, lambda k, i: {{'d': {cosine_sql('k.e', 'f.e')}, 'i': i}}))"
    return f"""with recursive f as (select video, arrival, enc::double[] as e, row_number() over (partition by video order by arrival) as rn from ({FA})),
r as (select video, 0::bigint as rn, null::bigint as arrival, null::varchar as label, {seed}::struct(e double[], l varchar)[] as known, {first}::bigint as nxt from (select distinct video from f)
 union all select video, rn, arrival, case when best.d <= 0.75 then known[best.i].l else printf('person_%02d', nxt) end, case when best.d <= 0.75 then known else list_append(known, {{'e': e, 'l': printf('person_%02d', nxt)}}) end, case when best.d <= 0.75 then nxt else nxt + 1 end from
 (select f.video, f.rn, f.arrival, f.e, r.known, r.nxt, {best} as best from r join f on f.video = r.video and f.rn = r.rn + 1)),
d3 as (select video, arrival, label from r where rn > 0)"""


_SEED = "(select list({'e': embedding::double[], 'l': case vec_id when 1 then 'person_05' else 'alice' end} order by vec_id) from embeddings where vec_id in (0, 1, 2))"

_GALLERY = "select identity as label, arrival as ord, enc, case when identity % 4 <> 0 then 0.1 + identity * 0.02 end as threshold from ({f}) where arrival < 40"


def d5_gallery_match(spark, d):
    gallery = rows(spark, d, _GALLERY.replace("{f}", FACES)).select("ord", F.col("label").cast("string").alias("label"), F.col("enc").cast("array<double>").alias("enc"), F.col("threshold").cast("double").alias("threshold"))
    tracks = _faces(spark, d).select(F.when(F.col("arrival") % 17 == 0, -1).otherwise(F.col("arrival")).alias("track_id"), "arrival", F.when(F.col("arrival") % 13 != 0, F.col("enc")).alias("enc"))
    return cluster.gallery_match(tracks, gallery, 0.2).select("arrival", "best_label", F.round("best_sim", 9).alias("best_sim"))


def d6_centroids(spark, d):
    got = cluster.centroids(_faces(spark, d), "identity")
    return got.select("identity", F.posexplode("centroid").alias("dim", "x")).select("identity", F.col("dim").cast("long").alias("dim"), F.round("x", 9).alias("x"))


def _scored(spark, d):
    return _faces(spark, d).select(F.col("identity").alias("label"), F.col("arrival").alias("face_id"), F.when(F.col("arrival") % 19 != 0, F.col("enc")).alias("enc"), ((F.col("arrival") * 37 % 100) / 100.0).alias("det_score"))


def d7_central_order(spark, d):
    return cluster.central_order(_scored(spark, d)).select("label", "face_id", F.col("rank").cast("long").alias("rank"), F.round("centrality", 9).alias("centrality"))


def d8_representatives(spark, d):
    got = cluster.representatives(_scored(spark, d))
    return got.select("label", "face_id", F.round(vec.norm(F.col("centroid")), 9).alias("length"), F.round(F.get("centroid", F.lit(0)), 9).alias("first"))


_D7 = f"""with u as (select identity as label, arrival as face_id, case when arrival % 19 <> 0 then list_transform(enc::double[], lambda x: x / sqrt(list_dot_product(enc::double[], enc::double[]))) end as u, (arrival * 37 % 100) / 100.0 as det_score from ({FA})),
l as (select label, k, avg(u[k]) as x from (select label, u, unnest(range(1, len(u) + 1)) as k from u where u is not null) group by all),
m as (select label, list(x order by k) as m from l group by label),
c as (select label, list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) as c from m),
d7 as (select label, face_id, det_score, coalesce(list_dot_product(u, c), -1.0) as centrality, row_number() over (partition by label order by round(coalesce(list_dot_product(u, c), -1.0), 12) desc, det_score desc, face_id) as rank, c from u left join c using (label))"""


_QUERY = """select event_id % 4000 as video, cast(event_id % 7 as int) as frame_idx, cast(event_id as bigint) as q_ord, cast(20 + event_id % 160 as int) as top, cast(20 + event_id % 230 + 300 as int) as right, cast(20 + event_id % 160 + 280 as int) as bottom, cast(20 + event_id % 230 as int) as left from {events}"""


def d9_best_overlap(spark, d):
    """The encodings of query boxes: here a face's encoding is its part and supplier, some faces have none."""
    faces = rows(spark, d, BOXES).select("video", "frame_idx", F.col("det_ord").alias("f_ord"), F.array("x1", "y1", "x2", "y2").alias("box"), F.when(F.col("part") % 6 != 0, F.array(F.col("part").cast("double"), F.col("supp").cast("double"))).alias("enc"))
    got = cluster.encodings_of_boxes(rows(spark, d, _QUERY), faces, ["video", "frame_idx"], 2)
    return got.select("video", "frame_idx", "q_ord", F.round("overlap", 9).alias("overlap"), F.get("enc", F.lit(0)).alias("first"), F.get("enc", F.lit(1)).alias("second"))


def d10_top_faces(spark, d):
    """The two faces of each identity with the highest detection score."""
    ranked = _scored(spark, d).where("enc is not null").withColumn("k", F.row_number().over(W.partitionBy("label").orderBy(F.desc("det_score"), "face_id")))
    return ranked.where("k <= 2").select("label", "face_id", F.col("k").cast("long").alias("k"))


def d11_landmarks(spark, d):
    """Five points given as 5 x 2 or 2 x 5; others are no landmarks."""
    # Numbers, points given and points taken are columns of their own, so each is worked out once and in code small enough to be compiled.
    numbers = {f"{c[0]}{k}": (F.col(c) * (k + by) % 100).cast("double") for c, by in (("part", 3), ("supp", 5)) for k in range(5)}
    p = lambda k: F.array(f"p{k}", f"s{k}")
    tall = F.array(*(p(k) for k in range(5)))
    wide = F.array(F.array(*(f"p{k}" for k in range(5))), F.array(*(f"s{k}" for k in range(5))))
    nan = F.array(*(p(k) for k in range(4)), F.array(F.lit(float("nan")), F.lit(0.0)))
    given = F.when(F.col("det_ord") % 2 == 1, nan).when(F.col("frame_idx") % 3 == 0, tall).when(F.col("frame_idx") % 3 == 1, wide).otherwise(F.array(*(p(k) for k in range(4))))
    key = ["video", "frame_idx", "det_ord"]
    made = rows(spark, d, BOXES).select(*key, *(x.alias(n) for n, x in numbers.items())).select(*key, given.alias("given"))
    got = made.select(*key, vec.five_points(F.col("given")).alias("got"))
    return got.select(*key, F.col("got").isNotNull().alias("valid"), F.get(F.get("got", F.lit(4)), F.lit(1)).alias("last_y"))


def b14_without_eyewear(spark, d):
    faces = rows(spark, d, FACES).withColumn("label", F.floor(F.col("arrival") / 3)).withColumn("eyewear", (F.col("arrival") * 7 % 5 < 3))
    return cluster.without_eyewear(faces.select("label", "arrival", "eyewear"))


QUERIES = {f.__name__: f for f in (a6_gallery_top, a7_largest_face, d1_cosine_distance, d2_euclidean_distance, d3_greedy_persons, d3_seeded_persons, g11_person_groups, d5_gallery_match, d6_centroids, d7_central_order, d8_representatives, d9_best_overlap, d10_top_faces, d11_landmarks, b14_without_eyewear)}

ORACLES = {
    "a6_gallery_top": f"select identity, path from (select identity, printf('img_%08d', arrival) as path, row_number() over (partition by identity order by arrival) as k from ({FA}) where arrival % 7 <> 0) where k <= 3",
    "a7_largest_face": f"select image, arrival from (select arrival // 3 as image, arrival, row_number() over (partition by arrival // 3 order by arrival * 37 % 5 desc, arrival) as k from ({FA})) where k = 1 and arrival % 11 <> 0",
    "d1_cosine_distance": f"select arrival, round({cosine_sql('p', 'e')}, 9) as distance from (select arrival, enc::double[] as e, lag(enc::double[]) over (partition by identity order by arrival) as p from ({FA})) where p is not null",
    "d2_euclidean_distance": f"select arrival, round(list_distance(p, e), 9) as distance from (select arrival, enc::double[] as e, lag(enc::double[]) over (partition by identity order by arrival) as p from ({FA})) where p is not null",
    "d3_greedy_persons": f"{_greedy('[]', 1)} select * from d3",
    "d3_seeded_persons": f"{_greedy(_SEED, 6)} select * from d3",
    "g11_person_groups": f"{_greedy('[]', 1)} select video, label, count(*) as n, string_agg(printf('%08d', arrival), ',' order by arrival) as members from d3 group by all",
    "d5_gallery_match": f"""with g as (select label::varchar as label, ord, enc::double[] as g, threshold::double as threshold from ({_GALLERY.replace('{f}', FA)})),
t as (select arrival, case when arrival % 17 <> 0 and arrival % 13 <> 0 then enc::double[] end as e from ({FA})),
b as (select arrival, label, threshold, 1 - {cosine_sql('e', 'g')} as sim, row_number() over (partition by arrival order by 1 - {cosine_sql('e', 'g')} desc, ord) as k from t, g where e is not null)
select t.arrival, case when sim >= coalesce(threshold, 0.2) then label end as best_label, round(coalesce(sim, 0.0), 9) as best_sim from t left join b on b.arrival = t.arrival and k = 1 and sim > 0""",
    "d6_centroids": f"""with l as (select identity, k, avg(e[k]) as x from (select identity, enc::double[] as e, unnest(range(1, len(enc) + 1)) as k from ({FA})) group by all), n as (select identity, sqrt(sum(x * x)) as n from l group by identity)
select identity, k - 1 as dim, round(case when n > 0 then x / n else x end, 9) as x from l join n using (identity)""",
    "d7_central_order": f"{_D7} select label, face_id, rank, round(round(centrality, 12), 9) as centrality from d7".replace("round(round(centrality, 12), 9)", "round(centrality, 9)"),
    "d8_representatives": f"{_D7} select label, face_id, round(sqrt(list_dot_product(c, c)), 9) as length, round(c[1], 9) as first from d7 where rank = 1",
    "d9_best_overlap": f"""select video, frame_idx, q_ord, round(o, 9) as overlap, case when o > 0 and part % 6 <> 0 then part::double else 0.0 end as first, case when o > 0 and part % 6 <> 0 then supp::double else 0.0 end as second from
 (select *, row_number() over (partition by q_ord order by o desc, det_ord) as k from (select *, i / ((right_ - left_) * (bottom - top) + (x2 - x1) * (y2 - y1) - i) as o from
 (select q.video, q.frame_idx, q_ord, top, "right" as right_, bottom, "left" as left_, x1, y1, x2, y2, part, supp, det_ord, greatest(0.0, least("right", x2) - greatest("left", x1)) * greatest(0.0, least(bottom, y2) - greatest(top, y1)) as i
 from ({duck(_QUERY).replace(' as right,', ' as "right",').replace(' as left from', ' as "left" from')}) q join ({duck(BOXES)}) b on b.video = q.video and b.frame_idx = q.frame_idx))) where k = 1""",
    "d10_top_faces": f"select * from (select identity as label, arrival as face_id, row_number() over (partition by identity order by arrival * 37 % 100 desc, arrival) as k from ({FA}) where arrival % 19 <> 0) where k <= 2",
    "d11_landmarks": f"select video, frame_idx, det_ord, det_ord % 2 = 0 and frame_idx % 3 < 2 as valid, case when det_ord % 2 = 0 and frame_idx % 3 < 2 then (supp * 9 % 100)::double end as last_y from ({BX})",
    "b14_without_eyewear": f"select label, arrival, eyewear from (select *, min(eyewear::int) over (partition by label) as all_worn from (select arrival // 3 as label, arrival, arrival * 7 % 5 < 3 as eyewear from ({FA}))) where not eyewear or all_worn = 1",
}
