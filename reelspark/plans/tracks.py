"""Queries on boxes, tracks and smoothing (B6-B9, C4, E, F)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelspark.functions import geometry
from reelspark.operators import track
from reelspark.plans.views import BOXES, duck, rows

BX = duck(BOXES)
BOX = ("x1", "y1", "x2", "y2")


def _boxes(spark, d):
    return rows(spark, d, BOXES)


def _ints(spark, d):
    b = _boxes(spark, d)
    return b.select("video", "frame_idx", "det_ord", *(F.col(c).cast("int").alias(c) for c in BOX))


def b6_margin_rect(spark, d):
    c = {k: F.col(k) for k in BOX}
    rect = geometry.margin_rect(c["y1"], c["x2"], c["y2"], c["x1"], 0.4, F.lit(480), F.lit(480))
    return _ints(spark, d).select("video", "frame_idx", "det_ord", *(r.alias(n) for r, n in zip(rect, ("top", "left", "bottom", "right"), strict=True)))


def b7_padded_box(spark, d):
    rect = geometry.padded_box(*(F.col(c) for c in BOX), F.lit(480), F.lit(480))
    return _boxes(spark, d).select("video", "frame_idx", "det_ord", *(r.alias(f"p_{n}") for r, n in zip(rect, BOX, strict=True)))


def b8_clip_box(spark, d):
    shifted = [F.col("x1") - 99.5, F.col("y1") * 2.5 - 20.25, F.col("x2") - 99.5 + F.col("discount"), F.col("y2") / 2]
    rect = geometry.clip_box(*shifted, F.lit(320), F.lit(240))
    return _boxes(spark, d).select("video", "frame_idx", "det_ord", *(r.alias(f"c_{n}") for r, n in zip(rect, BOX, strict=True)))


def b9_active_tracks(spark, d):
    return _boxes(spark, d).withColumn("age_since_seen", F.col("part") % 4).where("age_since_seen = 0").select("video", "frame_idx", "det_ord")


def b11_single_face(spark, d):
    """Frames with exactly one detection keep its box; others keep none."""
    one = F.when(F.count("*") == 1, F.min("x1"))
    return _boxes(spark, d).groupBy("video", "frame_idx").agg(F.count("*").alias("faces"), one.alias("x1"))


def c4_union_rect(spark, d):
    union = _ints(spark, d).groupBy("video").agg(F.min("y1").alias("top"), F.max("x2").alias("right"), F.max("y2").alias("bottom"), F.min("x1").alias("left"))
    rect = geometry.margin_rect(*(F.col(c) for c in ("top", "right", "bottom", "left")), 0.25, F.lit(640), F.lit(480), least=1)
    return union.select("video", *(r.alias(n) for r, n in zip(rect, ("crop_top", "crop_left", "crop_bottom", "crop_right"), strict=True)))


def e1_overlap(spark, d):
    """Overlap of each detection with the one before it in its video."""
    before = W.partitionBy("video").orderBy("frame_idx", "det_ord")
    b = _boxes(spark, d).select("*", *(F.lag(c).over(before).alias(f"p_{c}") for c in BOX)).where("p_x1 is not null")
    return b.select("video", "frame_idx", "det_ord", F.round(geometry.iou([F.col(c) for c in BOX], [F.col(f"p_{c}") for c in BOX]), 9).alias("overlap"))


def _detections(spark, d):
    return _boxes(spark, d).select("video", "frame_idx", "det_ord", F.array(*BOX).alias("box"), "part", "supp")


def _named(row: dict) -> tuple[str | None, float]:
    """A stand-in for recognition: some parts have a known face."""
    return (f"id_{row['part'] % 5}", 0.5 + row["part"] % 50 / 100) if row["part"] % 3 == 0 else (None, 0.0)


def e2_tracks(spark, d):
    return track.tracked(_detections(spark, d), 0.3, 2, _named)


def e3_sticky_labels(spark, d):
    labelled = _boxes(spark, d).select("video", F.col("det_ord").alias("track_id"), "frame_idx", F.when(F.col("part") % 3 == 0, F.concat(F.lit("id_"), F.col("part") % 5)).alias("label"))
    return track.sticky_labels(labelled).select("video", "track_id", "frame_idx", "sticky_label")


def e4_reset_tracks(spark, d):
    """Tracks that a new scene forgets; numbers go on."""
    scenes = _detections(spark, d).withColumn("scene_id", F.floor(F.col("frame_idx") / 3).cast("int"))
    return track.tracked(scenes, 0.3, 2).select("video", "frame_idx", "det_ord", "track_id")


def e5_stale_tracks(spark, d):
    seen = _boxes(spark, d).select("video", F.col("det_ord").alias("track_id"), "frame_idx")
    return track.stale(seen, 7, 3)


def _points(spark, d):
    shift = lambda dx, dy: F.array(F.col("x1") + dx + F.col("discount") * 50, F.col("y1") + dy + F.col("quantity"))
    points = F.array(shift(90, 110), shift(210, 110), shift(150, 170), shift(100, 230), shift(200, 230))
    return _boxes(spark, d).select("video", F.col("det_ord").alias("track_id"), "frame_idx", F.array(*BOX).alias("box"), points.alias("points"))


def f1_damped_landmarks(spark, d):
    got = track.damped_landmarks(_points(spark, d))
    return got.select("video", "track_id", "frame_idx", F.posexplode("points").alias("point", "p")).select("video", "track_id", "frame_idx", F.col("point").cast("long").alias("point"), F.round(F.get("p", F.lit(0)), 6).alias("x"), F.round(F.get("p", F.lit(1)), 6).alias("y"))


def f2_steady_boxes(spark, d):
    got = track.steady_boxes(_points(spark, d), 480, 480)
    return got.select("video", "track_id", "frame_idx", *(F.get("box", F.lit(k)).alias(c) for k, c in enumerate(BOX)))


def f3_roi_proposal(spark, d):
    """A box of the padded one's size around a blend of the landmarks' middle and the box's."""
    p = _points(spark, d)
    cx, cy, w, h = geometry.roi(F.col("points"), [F.get("box", F.lit(k)) for k in range(4)], F.lit(480), F.lit(480))
    return p.select("video", "track_id", "frame_idx", F.round(cx, 6).alias("cx"), F.round(cy, 6).alias("cy"), F.round(w, 6).alias("w"), F.round(h, 6).alias("h"))


def f5_overlap_gate(spark, d):
    got = track.overlap_gate(_points(spark, d))
    return got.select("video", "track_id", "frame_idx", F.round("share", 9).alias("share"), "blends")


QUERIES = {f.__name__: f for f in (b6_margin_rect, b7_padded_box, b8_clip_box, b9_active_tracks, b11_single_face, c4_union_rect, e1_overlap, e2_tracks, e3_sticky_labels, e4_reset_tracks, e5_stale_tracks, f1_damped_landmarks, f2_steady_boxes, f3_roi_proposal, f5_overlap_gate)}

_CLIP = """select video, frame_idx, det_ord, floor(a1)::int as c_x1, floor(b1)::int as c_y1, ceil(least(greatest(a2, a1 + 2), 320))::int as c_x2, ceil(least(greatest(b2, b1 + 2), 240))::int as c_y2 from
 (select video, frame_idx, det_ord, least(greatest(x1 - 99.5, 0), 318) as a1, least(greatest(y1 * 2.5 - 20.25, 0), 238) as b1, x2 - 99.5 + discount as a2, y2 / 2 as b2 from ({b}))"""
_PTS = "select video, det_ord as track_id, frame_idx, x1, y1, x2, y2, x1 + discount * 50 as px, y1 + quantity as py from ({b})"
_F2 = """with recursive p as (select *, row_number() over (partition by video, track_id order by frame_idx) as rn from (select video, det_ord as track_id, frame_idx, x1, y1, x2, y2 from ({b}))),
r as (select video, track_id, frame_idx, rn, x1, y1, x2, y2 from p where rn = 1
 union all select video, track_id, frame_idx, rn, case when follows then floor(ax) else n1 end, case when follows then floor(ay) else n2 end, case when follows then ceil(least(greatest(cx + w / 2, ax + 2), 480)) else n3 end, case when follows then ceil(least(greatest(cy + h / 2, ay + 2), 480)) else n4 end from
 (select *, least(greatest(cx - w / 2, 0.0), 478) as ax, least(greatest(cy - h / 2, 0.0), 478) as ay from
 (select p.video, p.track_id, p.frame_idx, p.rn, p.frame_idx = r.frame_idx + 1 as follows, p.x1 as n1, p.y1 as n2, p.x2 as n3, p.y2 as n4, 0.65 * (r.x2 - r.x1) + 0.35 * (p.x2 - p.x1) as w, 0.65 * (r.y2 - r.y1) + 0.35 * (p.y2 - p.y1) as h,
 (r.x1 + r.x2) / 2 + greatest(-greatest(0.08 * (r.x2 - r.x1), 2), least(greatest(0.08 * (r.x2 - r.x1), 2), (p.x1 + p.x2) / 2 - (r.x1 + r.x2) / 2)) as cx,
 (r.y1 + r.y2) / 2 + greatest(-greatest(0.08 * (r.y2 - r.y1), 2), least(greatest(0.08 * (r.y2 - r.y1), 2), (p.y1 + p.y2) / 2 - (r.y1 + r.y2) / 2)) as cy from r join p on p.video = r.video and p.track_id = r.track_id and p.rn = r.rn + 1)))
select video, track_id, frame_idx, x1::int as x1, y1::int as y1, x2::int as x2, y2::int as y2 from r"""
_PAIR = "greatest(0.0, least(x2, p_x2) - greatest(x1, p_x1)) * greatest(0.0, least(y2, p_y2) - greatest(y1, p_y1))"

# The tracker as a recursion over a video's frames: a fold over its tracks, and in it one over the frame's boxes.
_IOU = "list_transform([greatest(0.0, least(t.x2, b.x2) - greatest(t.x1, b.x1)) * greatest(0.0, least(t.y2, b.y2) - greatest(t.y1, b.y1))], lambda i: i / ((t.x2 - t.x1) * (t.y2 - t.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - i))[1]"
_STATE = "struct(x1 double, y1 double, x2 double, y2 double, det int, part bigint, track int, label varchar, sim double, age int)[]"


def _struct(of: str, **more: str) -> str:
    values = {k: f"{of}.{k}" for k in (*BOX, "det", "part")} | more
    return "{" + ", ".join(f"'{k}': {v}" for k, v in values.items()) + "}"


def _track_sql(max_age: int, named: bool, scene: int | None) -> str:
    """Tracks at a threshold of 0.3; ``scene``: frames of a scene."""
    best = f"list_reduce(boxes, lambda c, b: case when not list_contains(a.used, b.det) and {_IOU} > c.v then {{'v': {_IOU}, 'k': b.det}} else c end, {{'v': 0.3::double, 'k': -1}}).k"
    taken = f"list_transform([boxes[k + 1]], lambda b: {_struct('b', track='t.track', label='t.label', sim='t.sim', age='0')})"
    older = _struct("t", track="t.track", label="t.label", sim="t.sim", age="t.age + 1")
    step = f"list_transform([{best}], lambda k: case when k >= 0 then {{'kept': list_concat(a.kept, {taken}), 'used': list_append(a.used, k)}} when t.age + 1 <= {max_age} then {{'kept': list_append(a.kept, {older}), 'used': a.used}} else a end)[1]"
    fold = f"list_reduce(tracks, lambda a, t: {step}, {{'kept': []::{_STATE}, 'used': []::int[]}})"
    fresh = f"list_transform(list_filter(boxes, lambda b: not list_contains(m.used, b.det)), lambda b, i: {_struct('b', track='nxt + i - 1', label='null::varchar', sim='0.0::double', age='0')})"
    name = f"case when t.age = 0 and t.label is null and t.part % 3 = 0 then {_struct('t', track='t.track', label=chr(39) + 'id_' + chr(39) + ' || t.part % 5', sim='0.5 + t.part % 50 / 100', age='0')} else t end"
    done = f"list_concat(m.kept, {fresh})"
    done = f"list_transform({done}, lambda t: {name})" if named else done
    start = f"case when (r.f + 1) % {scene} = 0 then []::{_STATE} else r.kept end" if scene else "r.kept"
    return f"""with recursive b as ({BX}), fr as (select video, frame_idx, list({_struct('b', det='b.det_ord')} order by det_ord) as boxes from b group by all),
tr as (select video, min(frame_idx) - 1 as f, max(frame_idx) as f1, []::{_STATE} as kept, 0::int as nxt from b group by video
 union all select video, f, f1, {done} as kept, (nxt + len(boxes) - len(m.used))::int as nxt from (select *, {fold} as m from
 (select r.video, r.f + 1 as f, r.f1, r.nxt, {start} as tracks, coalesce(fr.boxes, []) as boxes from tr r left join fr on fr.video = r.video and fr.frame_idx = r.f + 1 where r.f < r.f1)))
select video, f::int as frame_idx, k.det as det_ord, k.track as track_id, k.label as label, k.sim as sim from (select video, f, unnest(kept) as k from tr) where k.age = 0"""


def _anchor(p: str) -> str:
    middle = lambda c: f"(({p}[1].{c} + {p}[2].{c}) / 2 + {p}[3].{c}) / 2"
    return "{" + f"'x': {middle('x')}, 'y': {middle('y')}" + "}"


def _spread(p: str, m: str) -> str:
    return "sqrt((" + " + ".join(f"(({p}[{k}].x - {m}.x) ** 2 + ({p}[{k}].y - {m}.y) ** 2)" for k in (1, 2, 3)) + ") / 3)"


_SHIFTS = ((90, 110), (210, 110), (150, 170), (100, 230), (200, 230))
_F1 = f"""with recursive p as (select video, track_id, frame_idx, [{', '.join(f"{{'x': px + {a}, 'y': py + {b}}}" for a, b in _SHIFTS)}] as n, greatest(x2 - x1, y2 - y1) as side,
 row_number() over (partition by video, track_id order by frame_idx) as rn from ({_PTS.replace('{b}', BX)})),
r as (select video, track_id, frame_idx, rn, n as q from p where rn = 1
 union all select video, track_id, frame_idx, rn, case when follows then list_transform(list_transform(n, lambda z, i: {{'x': nm.x + (z.x - nm.x) * scale - o[i].x, 'y': nm.y + (z.y - nm.y) * scale - o[i].y}}),
 lambda s, i: {{'x': o[i].x + s.x * least(1.0, greatest(1.5, 0.08 * face) / greatest(sqrt(s.x ** 2 + s.y ** 2), 1e-6)) * w[i], 'y': o[i].y + s.y * least(1.0, greatest(1.5, 0.08 * face) / greatest(sqrt(s.x ** 2 + s.y ** 2), 1e-6)) * w[i]}}) else n end from
 (select *, case when least(old, size) > 1e-6 then (old + 0.35 * (least(greatest(size, old * (1 - reach)), old * (1 + reach)) - old)) / size else 1.0 end as scale, [0.45, 0.45, 0.55, 0.65, 0.65]::double[] as w from
 (select *, {_spread('o', 'om')} as old, {_spread('n', 'nm')} as size, least(greatest(3.0 / face, 0.010), 0.028) as reach from
 (select *, {_anchor('o')} as om, {_anchor('n')} as nm, greatest(side, 2.5 * sqrt((n[2].x - n[1].x) ** 2 + (n[2].y - n[1].y) ** 2), 1.0) as face from
 (select p.video, p.track_id, p.frame_idx, p.rn, p.n, p.side, r.q as o, p.frame_idx = r.frame_idx + 1 as follows from r join p on p.video = r.video and p.track_id = r.track_id and p.rn = r.rn + 1)))))
select video, track_id, frame_idx, point, round(z.x, 6) as x, round(z.y, 6) as y from (select video, track_id, frame_idx, unnest(range(5)) as point, unnest(q) as z from r)"""

ORACLES = {
    "e2_tracks": _track_sql(2, True, None),
    "e4_reset_tracks": f"select video, frame_idx, det_ord, track_id from ({_track_sql(2, False, 3)})",
    "f1_damped_landmarks": _F1,
    "b6_margin_rect": f"select video, frame_idx, det_ord, greatest(0, y1::int - 120) as top, greatest(0, x1::int - 120) as left, least(480, y2::int + 120) as bottom, least(480, x2::int + 120) as right from ({BX})",
    "b7_padded_box": f"select video, frame_idx, det_ord, greatest(0, trunc(x1 - 150)::int) as p_x1, greatest(0, trunc(y1 - 150)::int) as p_y1, least(480, trunc(x2 + 150)::int) as p_x2, least(480, trunc(y2 + 150)::int) as p_y2 from ({BX})",
    "b8_clip_box": _CLIP.replace("{b}", BX),
    "b9_active_tracks": f"select video, frame_idx, det_ord from ({BX}) where part % 4 = 0",
    "b11_single_face": f"select video, frame_idx, count(*) as faces, case when count(*) = 1 then min(x1) end as x1 from ({BX}) group by all",
    "c4_union_rect": f"""select video, greatest(0, t - trunc(h * 0.25)::int) as crop_top, greatest(0, l - trunc(w * 0.25)::int) as crop_left, least(480, b + trunc(h * 0.25)::int) as crop_bottom, least(640, r + trunc(w * 0.25)::int) as crop_right from
 (select *, greatest(1, b - t) as h, greatest(1, r - l) as w from (select video, min(y1)::int as t, max(x2)::int as r, max(y2)::int as b, min(x1)::int as l from ({BX}) group by video))""",
    "e1_overlap": f"""select video, frame_idx, det_ord, round(i / (180000.0 - i), 9) as overlap from (select *, {_PAIR} as i from (select *, {', '.join(f'lag({c}) over w as p_{c}' for c in BOX)} from ({BX}) window w as (partition by video order by frame_idx, det_ord)) where p_x1 is not null)""",
    "e3_sticky_labels": f"select video, det_ord as track_id, frame_idx, first_value(case when part % 3 = 0 then 'id_' || part % 5 end ignore nulls) over (partition by video, det_ord order by frame_idx rows unbounded preceding) as sticky_label from ({BX})",
    "e5_stale_tracks": f"select video, det_ord as track_id, max(frame_idx) as last_frame from ({BX}) group by all having 7 - max(frame_idx) > 3",
    "f2_steady_boxes": _F2.replace("{b}", BX),
    "f3_roi_proposal": f"""select video, track_id, frame_idx, round((px + 150.0) * 0.65 + (x1 + x2) / 2 * 0.35, 6) as cx, round((py + (110 + 230) / 2.0 + h * 0.08) * 0.65 + (y1 + y2) / 2 * 0.35, 6) as cy, round(w, 6) as w, round(h, 6) as h from
 (select *, greatest(least(480, trunc(x2 + 150)) - greatest(0, trunc(x1 - 150)), 2.0) as w, greatest(least(480, trunc(y2 + 150)) - greatest(0, trunc(y1 - 150)), 2.0) as h from ({_PTS.replace('{b}', BX)}))""",
    "f5_overlap_gate": f"""select video, track_id, frame_idx, round(case when p_x1 is null then 0.0 else {_PAIR} / 90000.0 end, 9) as share, p_x1 is not null and {_PAIR} / 90000.0 >= 0.35 as blends from
 (select video, det_ord as track_id, frame_idx, x1, y1, x2, y2, {', '.join(f'lag({c}) over (partition by video, det_ord order by frame_idx) as p_{c}' for c in BOX)} from ({BX}))""",
}
