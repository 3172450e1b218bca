import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspark.functions import geometry, text, vec
from reelspark.operators import cluster, reduce, segment, tags, track
from reelspark.plans import backends
from reelspark.sources import scans

BBOX = "video string, frame_idx int, enc array<double>"


def frames(spark, *rows):
    return spark.createDataFrame([("v", k, e) for k, e in rows], BBOX)


def segments(df):
    return [(r.start_frame, r.end_frame, r.frames) for r in sorted(segment.anchored_segments(df, 0.6, 30).collect(), key=lambda r: r.start_frame)]


def test_anchored_segments(spark):
    a, b = [0.0, 0.0], [0.9, 0.0]
    assert segments(frames(spark, (0, a))) == [(0, 29, [0])]
    assert [s[0] for s in segments(frames(spark, (0, a), (30, None), (60, a)))] == [0, 60]
    assert segments(frames(spark, (0, a), (30, [0.1, 0.0]), (60, [0.5, 0.0]))) == [(0, 89, [0, 30, 60])]
    assert [s[0] for s in segments(frames(spark, (0, a), (30, b)))] == [0, 30]
    # The anchor counts, not the frame before.
    assert [s[0] for s in segments(frames(spark, (0, a), (30, [0.5, 0.0]), (60, b)))] == [0, 60]
    assert segments(spark.createDataFrame([], BBOX)) == []


def split(spark, start, end, total, least, most, fps=10.0):
    df = spark.createDataFrame([(start, end)], "start_frame int, end_frame int")
    return sorted((r.start_frame, r.end_frame) for r in segment.clip_and_split(df, F.lit(fps), F.lit(total), least, most).collect())


def test_clip_and_split(spark):
    assert split(spark, 0, 99, 1000, 2.0, 3.0) == [(0, 29), (30, 59), (60, 89)]
    assert split(spark, 0, 150, 100, 0.0, 30.0) == [(0, 99)]
    assert split(spark, 0, 4, 1000, 2.0, 3.0) == []
    assert split(spark, 120, 150, 100, 0.0, 3.0) == []


def test_frame_counts(spark):
    df = spark.createDataFrame([(8, 900, 30.0, 4.0), (8, 900, 30.0, 0.0), (2000, 900, 30.0, 0.0), (8, 3, 30.0, 4.0), (9, 900, 0.0, 4.0)], "r int, n int, fps double, spf double")
    got = [r[0] for r in df.select(segment.effective_frames(F.col("r"), F.col("n"), F.col("fps"), F.col("spf"))).collect()]
    assert got == [7, 8, 768, 1, 9]


def test_overlap_buckets(spark):
    df = spark.createDataFrame([(1, 0.0, 4.9, "early", 0), (2, 2.0, 8.0, " both ", 0), (2, 0.0, 5.0, "first", 1), (2, 5.0, 5.0, "edge", 2), (2, 9.0, 99.0, "late", 3)], "media long, start double, end double, text string, ord long")
    got = {(r.media, r.bucket): (r.b_start, r.b_end, r.text) for r in segment.overlap_buckets(df, F.lit(2), F.lit(10.0)).collect()}
    assert got == {(1, 0): (0.0, 5.0, "early"), (1, 1): (5.0, 10.0, ""), (2, 0): (0.0, 5.0, "first both"), (2, 1): (5.0, 10.0, "both late")}


def test_scene_cuts(spark):
    df = spark.createDataFrame([("v", k, None if k == 0 else (170.0 if k in (1, 5, 32, 40) else 0.0)) for k in range(50)], "video string, frame_idx int, diff double")
    assert [r.frame_idx for r in segment.scene_cuts(df, 35.0).orderBy("frame_idx").collect() if r.cut] == [1, 32]
    assert segment.scene_cuts(df, 0.0).where("cut").count() == 0


def test_cosine_distance(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [round(r[0], 6) for r in df.select(vec.cosine_distance(F.col("a"), F.col("b"))).collect()] == [0, 1, 2, 1]


def test_greedy_persons(spark):
    def labels(rows, refs=()):
        df = spark.createDataFrame([("v", k, e) for k, e in enumerate(rows)], "video string, arrival long, enc array<double>")
        return [r.label for r in cluster.greedy_persons(df, 0.6, refs).orderBy("arrival").collect()]

    zero, one = [0.0] * 128, [1.0] * 128
    assert labels([zero, one]) == ["person_01", "person_02"]
    assert labels([one], [("alice", one)]) == ["alice"]
    assert labels([zero], [("person_05", one), ("bob", one)]) == ["person_06"]
    assert labels([[0.0], [0.5], [1.0], [0.7]]) == ["person_01", "person_01", "person_02", "person_02"]


def test_gallery_match(spark):
    rng = np.random.default_rng(0)
    a, b = (v / np.linalg.norm(v) for v in rng.normal(size=(2, 16)))
    gallery = spark.createDataFrame([("a", a.tolist(), 0.9, 0), ("b", b.tolist(), None, 1)], "label string, enc array<double>, threshold double, ord int")
    tracks = spark.createDataFrame([(1, a.tolist()), (2, (-a).tolist()), (3, None), (-1, a.tolist()), (4, (a + 0.9 * b).tolist())], "track_id int, enc array<double>")
    for most in (100, 1):
        got = {r.track_id: (r.best_label, round(r.best_sim, 3)) for r in cluster.gallery_match(tracks, gallery, 0.2, most).collect()}
        assert got[1] == ("a", 1.0) and got[3] == (None, 0.0) and got[-1] == (None, 0.0) and got[4][0] is None and got[4][1] > 0.5
    empty = cluster.gallery_match(tracks, gallery.limit(0), 0.2)
    assert empty.count() == 5 and empty.where("best_label is not null").count() == 0


def test_centroids_and_order(spark):
    df = spark.createDataFrame([("x", 1, [1.0, 0.0, 0.0], 0.5), ("x", 2, [0.0, 1.0, 0.0], 0.6), ("z", 3, [0.0, 0.0, 0.0], 0.1)], "label string, face_id int, enc array<double>, det_score double")
    got = {r.label: r.centroid for r in cluster.centroids(df).collect()}
    assert got["z"] == [0, 0, 0] and np.linalg.norm(got["x"]) == pytest.approx(1)
    faces = spark.createDataFrame([("x", 1, [1.0, 0.1], 0.5), ("x", 2, [1.0, -0.1], 0.6), ("x", 3, [0.0, 1.0], 0.99), ("x", 4, None, 1.0)], "label string, face_id int, enc array<double>, det_score double")
    ranks = {r.face_id: r["rank"] for r in cluster.central_order(faces).collect()}
    assert ranks == {1: 1, 2: 2, 3: 3, 4: 4}


def test_eyewear_keeps_a_last_portrait(spark):
    df = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("b", 3, True)], "label string, id int, eyewear boolean")
    assert sorted(r.id for r in cluster.without_eyewear(df).collect()) == [2, 3]


def test_overlap():
    assert track.overlap([0, 0, 10, 10], [0, 0, 10, 10]) == 1
    assert track.overlap([0, 0, 10, 10], [20, 20, 30, 30]) == 0 == track.overlap([0, 0, 0, 0], [0, 0, 0, 0])


def test_tracker_ages_and_numbers():
    t = track.Tracker(0.3, 2)
    box = {"box": [0, 0, 10, 10]}
    assert t.update([box])[0]["track"] == 0
    assert t.update([]) == [] and t.update([]) == [] and len(t.tracks) == 1
    assert t.update([]) == [] and not t.tracks
    assert t.update([box])[0]["track"] == 1
    t.reset()
    assert t.update([box])[0]["track"] == 2
    named = track.Tracker(0.3, 2, lambda b: ("x", 0.9) if b.get("known") else (None, 0.0))
    assert named.update([{**box, "known": True}])[0]["label"] == "x"
    assert named.update([box])[0]["label"] == "x"


def test_tracks_equal_a_plain_tracker(spark):
    rng = random.Random(5)
    rows = []
    for v in range(6):
        for f in sorted(rng.sample(range(20), 12)):
            for k in range(rng.randint(1, 4)):
                x, y = rng.randint(0, 60), rng.randint(0, 60)
                rows.append((v, f, k, [float(x), float(y), float(x + 50), float(y + 50)]))
    got = {(r.video, r.frame_idx, r.det_ord): r.track_id for r in track.tracked(spark.createDataFrame(rows, "video long, frame_idx int, det_ord int, box array<double>").repartition(3), 0.3, 2).collect()}
    want = {}
    for v in range(6):
        alive, n = [], 0
        frames_ = {f for w, f, _, _ in rows if w == v}
        for f in range(min(frames_), max(frames_) + 1):
            boxes = [(k, b) for w, g, k, b in rows if w == v and g == f]
            used, new = set(), []
            for name, old, age in alive:
                best, hit = 0.3, None
                for k, b in boxes:
                    if k not in used and track.overlap(old, b) > best:
                        best, hit = track.overlap(old, b), (k, b)
                if hit:
                    used.add(hit[0])
                    want[v, f, hit[0]] = name
                    new.append((name, hit[1], 0))
                elif age < 2:
                    new.append((name, old, age + 1))
            for k, b in boxes:
                if k not in used:
                    want[v, f, k] = n
                    new.append((n, b, 0))
                    n += 1
            alive = new
    assert got == want


def test_landmark_damping():
    before = np.array([[100, 100], [160, 100], [130, 130], [110, 160], [150, 160]], float)
    box = [80, 80, 180, 180]
    moved = track.damped_points(before, before + [18, 0], box)
    assert (moved[:, 0] > before[:, 0]).all() and (moved[:, 0] < before[:, 0] + 18).all()
    middle = before.mean(0)
    shrunk = track.damped_points(before, middle + (before - middle) * 0.9, box)
    assert np.linalg.norm(shrunk[1] - shrunk[0]) > 0.97 * 60


def test_damping_starts_anew_after_a_gap(spark):
    p = [[float(10 * k), float(7 * k % 5)] for k in range(5)]
    q = [[x + 3, y + 1] for x, y in p]
    rows = [("v", 1, 0, [0.0, 0.0, 90.0, 90.0], p), ("v", 1, 1, [0.0, 0.0, 90.0, 90.0], q), ("v", 1, 5, [0.0, 0.0, 90.0, 90.0], q)]
    got = {r.frame_idx: r.points for r in track.damped_landmarks(spark.createDataFrame(rows, "video string, track_id int, frame_idx int, box array<double>, points array<array<double>>")).collect()}
    assert got[0] == p and got[5] == q and got[1] != q


def test_landmark_scores(spark):
    point = lambda *xy: [dict(x=x, y=y) for x, y in xy]
    wide, shut = point((0, 5), (3, 0), (7, 0), (10, 5), (7, 8), (3, 8)), point((0, 5), (3, 5), (7, 5), (10, 5), (7, 5), (3, 5))
    df = spark.createDataFrame([(wide,), (shut,), (wide[:4],)], "p array<struct<x:int,y:int>>")
    assert [round(r[0], 6) for r in df.select(geometry.eye_aspect_ratio(F.col("p"))).collect()] == [0.8, 0.0, 0.0]
    whole = {"left_eye": wide, "right_eye": point(*[(p["x"] + 40, p["y"]) for p in wide]), "nose_tip": point((25, 24)), "chin": point((25, 54))}
    maps = spark.createDataFrame([(whole,), ({k: v for k, v in whole.items() if k != "chin"},)], "m map<string,array<struct<x:int,y:int>>>")
    scores = [r[0] for r in maps.select(geometry.frontality(F.col("m"))).collect()]
    assert scores[0] > 0.95 and scores[1] == 0
    one = spark.range(1).select(geometry.reference_score(F.lit(2), F.lit(1.0), F.lit(1.0), F.lit(1.0)), geometry.reference_score(F.lit(1), F.lit(1.0), F.lit(1.0), F.lit(1.0))).first()
    assert one[0] == 0 and one[1] == pytest.approx(1)


def test_video_captions(spark):
    df = spark.createDataFrame([("v", 0, 0, "long_hair", 0, 0.9), ("v", 0, 1, "smile", 0, 0.1), ("v", 1, 0, "long_hair", 0, 0.1), ("v", 1, 1, "smile", 0, 0.9), ("v", 1, 2, "x", 4, 1.0)], "video string, frame_idx int, tag_idx int, name string, category int, prob double")
    assert tags.video_captions(df, 0.35).first().caption == "smile, long hair"
    assert tags.video_captions(df, 0.35, " me ").first().caption == "me, smile, long hair"


def test_clock(spark):
    df = spark.createDataFrame([(0.0,), (60.0,), (3600.0,), (1.25,), (-5.0,), (0.9996,)], "s double")
    assert [r[0] for r in df.select(text.clock(F.col("s"))).collect()] == ["0:00:00.000", "0:01:00.000", "1:00:00.000", "0:00:01.250", "0:00:00.000", "0:00:00.1000"]


def test_stems(spark):
    df = spark.createDataFrame([("a_orig",), ("a_aug000",), ("photo_august",), ("a_aug1_aug2",), ("plain",)], "s string")
    assert [r[0] for r in df.select(text.source_stem(F.col("s"))).collect()] == ["a", "a", "photo", "a_aug1", "plain"]


def test_transcript(spark):
    rows = [(1, 0, 10.0, '{"chunks":[{"text":"hello","timestamp":[0,1]},{"text":"world","timestamp":[1,2]}]}')]
    parts = reduce.transcript_parts(spark.createDataFrame(rows, "media long, segment_index long, start double, result string"))
    got = parts.orderBy("chunk").collect()
    assert [(r.text, r.start_s, r.end_s) for r in got] == [("hello", 10.0, 11.0), ("world", 11.0, 12.0)]
    raw = reduce.raw_text(parts)
    assert raw.first().raw == "hello world"
    shown = reduce.rendered(parts.withColumn("ord", F.col("chunk")).join(raw, "media")).first().listing
    assert "0:00:10.000 --> 0:00:11.000" in shown and shown.startswith("Raw transcript")


def test_window_backend(spark):
    rows = [(1, k, f"t{k}") for k in range(5)] + [(2, 0, "only")]
    df = spark.createDataFrame(rows, "key long, ord long, text string")
    got = {(r.key, r.ord): r.text for r in reduce.windows(df, 3, backends.backend("first_line")).collect()}
    assert got == {(1, 0): "--- Segment 1 ---", (1, 1): "--- Segment 4 ---", (2, 0): "only"}
    with pytest.raises(KeyError):
        backends.backend("none")


def test_file_scan_and_dictionary(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    for name in ("x.MP4", "a/y.mov", "a/b/z.txt", "a/b/w.png"):
        (tmp_path / name).write_bytes(b"1")
    assert sorted(r.path.rsplit("/", 1)[1] for r in scans.scan(spark, str(tmp_path), scans.VIDEO).collect()) == ["x.MP4", "y.mov"]
    (tmp_path / "tags.csv").write_text("name,category\nlong_hair,0\ngeneral,9\nnone,\n")
    assert [tuple(r) for r in scans.read_tag_dictionary(spark, str(tmp_path / "tags.csv")).orderBy("idx").collect()] == [(0, "long_hair", 0), (1, "general", 9), (2, "none", 0)]
    with pytest.raises(ValueError):
        scans.flat_scan(spark.createDataFrame([("a.txt",)], "path string"))
    texts = spark.createDataFrame([(str(tmp_path / "out/s.txt"), "t é\n"), (str(tmp_path / "out/n.txt"), None)], "path string, text string")
    assert {r.status for r in scans.write_sidecars(texts).collect()} == {"created"}
    assert (tmp_path / "out/s.txt").read_text() == "t é\n" and sorted(x.name for x in (tmp_path / "out").iterdir()) == ["n.txt", "s.txt"]
    changed = texts.withColumn("text", F.lit("new"))
    assert {r.status for r in scans.write_sidecars(changed, overwrite=False).collect()} == {"skipped_existing"}
    assert (tmp_path / "out/s.txt").read_text() == "t é\n"


def test_dictionary_text_is_read_once(spark):
    """Nothing above the lines' rows may hold or split the whole text again: with 48,000 lines a text that is quadratic."""
    texts = spark.createDataFrame([("a", "id,name,category\r\n1,x,9\r\n2,y,\n"), ("b", "name\nz"), ("c", "")], "dictionary string, value string")
    got = scans.tag_dictionary(texts)
    above = got._jdf.queryExecution().optimizedPlan().toString().split("Generate ")[0]
    assert "split(" not in above and "value#" not in above
    assert sorted(map(tuple, got.collect())) == [("a", 0, "x", 9), ("a", 1, "y", 0), ("b", 0, "z", 0)]


def test_sidecars_are_read_by_their_names(spark, tmp_path):
    """Empty texts, odd names and more bytes than a batch come back; what a stopped attempt left is no sidecar."""
    names = ["a/x.txt", "a/_y.txt", "a b/%20 é.txt", "a/.hidden.txt", "empty.txt"]
    texts = {str(tmp_path / n): "" if n == "empty.txt" else n * 40 for n in names}
    made = scans.write_sidecars(spark.createDataFrame(list(texts.items()), "path string, text string").coalesce(1))
    made = spark.createDataFrame(made.collect(), made.schema).coalesce(1)
    back = scans.read_sidecars(made, most=300).collect()
    assert {r.path: r.text for r in back} == texts and len(back) == 5 and {r.status for r in back} == {"created"}

    (tmp_path / "left/z.txt/full").mkdir(parents=True)  # the last step fails, since a folder has the name
    left = spark.createDataFrame([(str(tmp_path / "left/z.txt"), "half")], "path string, text string")
    with pytest.raises(Exception, match="z.txt"):
        scans.write_sidecars(left).collect()
    assert sorted(x.name[0] for x in (tmp_path / "left").iterdir()) == [".", "z"]
    assert spark.read.option("recursiveFileLookup", "true").text(str(tmp_path / "left"), wholetext=True).count() == 0


def test_five_points_is_compiled(spark):
    inf, nan = float("inf"), float("nan")
    tall = [[float(k), float(k + 10)] for k in range(5)]
    wide = [[float(k) for k in range(5)], [float(k + 10) for k in range(5)]]
    bad = [None, [], tall[:4], [*tall[:4], [nan, 0.0]], [*tall[:4], [0.0, -inf]], [*tall[:4], [inf, 0.0]], [*tall[:4], [None, 0.0]], [*tall[:4], None], [*tall[:4], [1.0]], [*tall[:3], [1.0], [1.0, 2.0, 3.0]], [wide[0], wide[1][:4]], [tall[0] * 5]]
    df = spark.createDataFrame([(k, x) for k, x in enumerate([tall, wide, *bad])], "k int, p array<array<double>>")
    got = df.select("k", vec.five_points(F.col("p")).alias("f"))
    assert [r.f for r in got.orderBy("k").collect()] == [tall, tall] + [None] * len(bad)
    assert "lambda" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_measures_of_landmarks_over_columns(spark):
    rng = np.random.default_rng(2)
    sizes = {"nose_tip": 5, "left_eye": 6, "right_eye": 6, "chin": 9}
    marks = {k: rng.integers(0, 60, (40, n, 2)) + (140 if k == "chin" else 0) for k, n in sizes.items()}
    marks["left_eye"][0] = marks["right_eye"][0] = marks["nose_tip"][0] = marks["chin"][1] = 7
    rows = [(k, {name: [tuple(map(int, p)) for p in x[k]] for name, x in marks.items()}) for k in range(40)]
    df = spark.createDataFrame(rows, "k int, m map<string, array<struct<x:int,y:int>>>")
    want = df.orderBy("k").select(geometry.frontality(F.col("m")), geometry.eye_aspect_ratio(F.col("m")["left_eye"])).collect()
    marks = {k: x.astype(float) for k, x in marks.items()}
    assert geometry.frontalities(*(marks[k] for k in ("nose_tip", "left_eye", "right_eye", "chin"))) == pytest.approx([r[0] for r in want], abs=1e-12)
    assert geometry.eye_ratios(marks["left_eye"]) == pytest.approx([r[1] for r in want], abs=1e-12)
    assert want[0] == (0.0, 0.0)


@pytest.mark.parametrize("name", ["d11_landmarks", "g1_eye_aspect_ratio", "g2_frontality", "g6_reference_score", "g7_references", "k10_selected_references"])
def test_points_of_each_row_are_not_interpreted(spark, sf, name):
    import __spark_entry__

    assert "lambda" not in __spark_entry__.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()


def test_tracks_over_columns_equal_the_tracker_of_dicts(spark):
    """Frames split over batches, scenes, gaps and names: the same rows as Tracker gives frame by frame."""
    rng = random.Random(11)
    rows = []
    for v in range(8):
        for f in sorted(rng.sample(range(-3, 30), 18)):
            for k in range(rng.randint(1, 5)):
                x, y = rng.randint(0, 40), rng.randint(0, 40)
                rows.append((v, f, k, [float(x), float(y), float(x + 50), float(y + 40)], f // 7, rng.randint(0, 9)))
    name = lambda r: (f"n{r['part']}", r["box"][0] + r["track"]) if r["part"] % 3 == 0 else (None, 0.0)
    want = set()
    for v in range(8):
        tracker, scene = track.Tracker(0.3, 2, name), None
        for f in range(-3, 30):
            boxes = [dict(zip(("video", "frame_idx", "det_ord", "box", "scene_id", "part"), r, strict=True)) for r in rows if r[:2] == (v, f)]
            if boxes and boxes[0]["scene_id"] != scene:
                scene = boxes[0]["scene_id"]
                tracker.reset()
            want |= {(v, f, t["det_ord"], t["track"], t["label"], t["sim"]) for t in tracker.update(boxes)}
    df = spark.createDataFrame(rows, "video long, frame_idx int, det_ord int, box array<double>, scene_id int, part int").repartition(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("1", "7", before):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = [tuple(r) for r in track.tracked(df, 0.3, 2, name).collect()]
            assert len(got) == len(want) == len(rows) and set(got) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    # Only what the tracks need is shuffled and sent to Python.
    assert "part#" not in track.tracked(df, 0.3, 2)._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")[0]
    assert "MapInArrow" in track.tracked(df, 0.3, 2)._jdf.queryExecution().optimizedPlan().toString()


def test_sidecar_paths(spark):
    df = spark.createDataFrame([("a/b.tar.gz",), ("a.d/b",), (".hidden",), ("x/.hidden",), ("v.mp4",)], "p string")
    assert [r[0] for r in df.select(scans.sidecar_path(F.col("p"))).collect()] == ["a/b.tar.txt", "a.d/b.txt", ".hidden.txt", "x/.hidden.txt", "v.txt"]


def test_inputs(spark):
    files = spark.createDataFrame([(x,) for x in ("/d/b.mp4", "/d/a.mp4", "/d/s/c.mov", "/d/s/e.wmv", "/e/f.mkv", "g.txt", "/d/UP.MP4")], "path string")
    lists = spark.createDataFrame([(1, "# no"), (2, " g.txt "), (3, "/d/../e/./f.mkv"), (4, "/gone.mp4"), (5, "a.mp4"), (6, "")], "row_ord long, line string")
    got = scans.inputs(files, "/d", patterns=["*/c.m?v"], lists=lists).orderBy("src_ord", "row_ord", "path").collect()
    assert [(r.path, r.src_ord) for r in got] == [("/d/s/c.mov", 0), ("/d/a.mp4", 1), ("/d/b.mp4", 1), ("/d/g.txt", 1_000_000), ("/e/f.mkv", 1_000_000)]
    assert [r.path for r in scans.inputs(files, "/d", suffixes=[".wmv"]).collect()] == ["/d/s/e.wmv"]


def test_config_errors(spark):
    runs = spark.createDataFrame([(1, "v.mp4", "o.mp4"), (2, "", None), (3, "gone.mp4", "o")], "run long, input_video string, output_video string")
    people = spark.createDataFrame([(1, 0, "a", ["r1", "no"], []), (3, 0, "b", None, ["p1"])], "run long, ord int, source_label string, reference_paths array<string>, portrait_paths array<string>")
    got = {r.run: r.errors for r in scans.config_errors(runs, people, spark.createDataFrame([("v.mp4",), ("r1",), ("p1",)], "path string")).collect()}
    assert got[1] == ["Reference image not found for 'a': no", "Character 'a' has no portrait images (the replacement face)"]
    assert got[2] == ["input_video is required", "output_video is required", "At least one character mapping is required"]
    assert got[3] == ["input_video not found: gone.mp4", "Character 'b' has no reference images (needed to identify the face in the video)"]


def test_resampled_sums_step_by_step(spark):
    cases = [(0.0, 375.0, 9000, 24.0, 10.0), (0.0, 0.0, 9000, 25.0, 7.0), (1.3, 2.9, 9000, 0.0, 3.0), (2.0, 1.0, 100, 30.0, 0.0), (0.0, 5.0, 50, 30.0, 60.0), (9.0, 10.0, 5, 30.0, 1.0)]
    def plain(start, end, total, rate, fps):
        rate = rate if rate > 0 else 25.0
        stop = min(int(end * rate), total) if end > start else total
        t, out = float(int(start * rate)), []
        while t < stop:
            out.append(int(t))
            t += max(1.0, rate / fps) if fps > 0 else rate
        return out
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, s double, e double, n int, rate double, fps double")
    got = df.select("k", segment.resampled(*(F.col(c) for c in ("s", "e", "n", "rate", "fps"))).alias("f")).orderBy("k").collect()
    assert [r.f for r in got] == [plain(*c) for c in cases]


def test_totals_of_resampled_frames_without_a_list(spark):
    rng = np.random.default_rng(5)
    start, end = rng.integers(0, 300, 400).astype(float), np.floor(np.exp(rng.uniform(0, 11, 400)))
    # Steps that end halfway between two doubles, in one power of two or the next, too.
    step = np.where(np.arange(400) % 2 == 0, 1 + rng.integers(0, 2**52, 400) * 2.0**-52, 25 / (rng.integers(1, 20, 400) * 1.25)).clip(1)
    for k, got in enumerate(zip(*segment._stepped_sums(start, end, step), strict=True)):
        t, n, last, total = start[k], 0, 0.0, 0
        while t < end[k]:
            n, last, total, t = n + 1, t, total + int(t), t + step[k]
        assert got == (n, last, total)
    # A list of the frames of these videos would take gigabytes.
    most = 2**31 - 1
    df = spark.createDataFrame([(0, 0.0, 0.0, most, 25.0, 25.0), (1, 0.0, 0.0, most, 30.0, 20.0), (2, 9.0, 10.0, 5, 30.0, 1.0), (3, None, 1.0, 5, 30.0, 1.0)], "k int, s double, e double, n int, rate double, fps double")
    got = df.select("k", segment.resampled_totals(*(F.col(c) for c in ("s", "e", "n", "rate", "fps"))).alias("f")).orderBy("k").select("f.*").collect()
    steps = -(-most * 2 // 3)
    pairs = steps // 2
    assert tuple(got[0]) == (most, 0, most - 1, most * (most - 1) // 2)
    assert tuple(got[1]) == (steps, 0, (steps - 1) * 3 // 2, 3 * pairs * (pairs - 1) + pairs + (steps % 2) * 3 * pairs)
    assert tuple(got[2]) == (0, None, None, 0) and tuple(got[3]) == (None, None, None, None)


def test_large_gallery_without_nested_loop(spark):
    rng = np.random.default_rng(1)
    names = spark.createDataFrame([(f"l{k}", rng.normal(size=4).tolist(), None, k) for k in range(50)], "label string, enc array<double>, threshold double, ord int")
    tracks = spark.createDataFrame([(k, rng.normal(size=4).tolist()) for k in range(40)], "track_id int, enc array<double>")
    large = cluster.gallery_match(tracks, names, 0.2, most_gallery=10, block=7)
    plan = large._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    small = cluster.gallery_match(tracks, names, 0.2)
    assert sorted(map(str, large.collect())) == sorted(map(str, small.collect()))


def test_smoothing_equals_a_plain_loop(spark):
    rng = np.random.default_rng(9)
    rows = []
    for video in range(3):
        for track_id in range(4):
            frames = np.cumsum(rng.integers(1, 3, 30)) if track_id else np.arange(30)
            for f in frames:
                x, y = rng.uniform(0, 100, 2).tolist()
                rows.append((video if video < 2 else None, track_id, int(f), [x, y, x + 60 + rng.uniform(0, 9), y + 70], (rng.uniform(0, 9, (5, 2)) + [[10, 10], [40, 10], [25, 30], [12, 50], [38, 50]]).tolist()))
    df = spark.createDataFrame(rows, "video long, track_id int, frame_idx int, box array<double>, points array<array<double>>")
    points, boxes, before = {}, {}, None
    for video, track_id, f, box, p in sorted((r for r in rows if r[0] is not None), key=lambda r: r[:3]):
        p, box, key = np.array(p), np.array(box), (video, track_id, f)
        follows = before == (video, track_id, f - 1)
        points[key] = track.damped_points(points[before], p, box) if follows else p
        boxes[key] = track.steady_box(boxes[before], box, 120, 140) if follows else box
        before = key
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r.video, r.track_id, r.frame_idx): r.points for r in track.damped_landmarks(df).collect() if r.video is not None}
        steady = {(r.video, r.track_id, r.frame_idx): r.box for r in track.steady_boxes(df, 120, 140).collect() if r.video is not None}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got.keys() == points.keys() and all(np.allclose(got[k], points[k]) for k in got)
    assert steady == {k: [int(x) for x in v] for k, v in boxes.items()}


def test_error_texts(spark):
    bodies = ['{"a": "x", "b": {"c": ["y", 1, null, "z\\n\\"q\\""], "d": "a: b"}}', "plain", None, "[]", '["k", {"v": "w"}]']
    df = spark.createDataFrame([(b,) for b in bodies], "b string")
    assert [r[0] for r in df.select(text.error_texts(F.col("b"))).collect()] == [["x", "y", 'z\n"q"', "a: b"], ["plain"], [], [], ["k", "w"]]


def test_messages(spark):
    videos = spark.createDataFrame([(1, "v.mp4", 10, 20, 24.0, 100, 5, 0, 0.5, "p", "s", True, "heard", False), (2, "w.mp4", 10, 20, 0.0, 0, 900, 7, 0.0, "", "", False, None, False), (3, "x.mp4", 1, 1, 1.0, 1, 1, 1, 0.0, None, None, False, None, True)], "media long, path string, width int, height int, fps double, num_frames int, nframes int, total_pixels int, spf double, prompt string, system string, more boolean, transcript string, video_only boolean")
    told = spark.createDataFrame([(1, 0, 0.0, 1.0, " a "), (1, 1, None, 2.0, "b"), (1, 2, 3.0, 9.0, "")], "media long, ord int, start_s double, end_s double, text string")
    got = {r.media: r for r in reduce.messages(videos, told).collect()}
    assert (got[1].nframes, got[1].total_pixels, got[1].system) == (8, 200, "s") and (got[2].nframes, got[2].total_pixels, got[2].system, got[2].texts) == (768, 7, None, [])
    assert (got[3].nframes, got[3].total_pixels) == (None, None)
    assert got[1].texts[1].split("\n")[1:] == ["Segment 1: 0:00:00.000 – 0:00:01.000 (frames 0–24)", "a", "Segment 3: 0:00:03.000 – 0:00:09.000 (frames 72–99)", "<no text>"]
    assert got[1].texts[2] == "p" and got[1].texts[3].startswith("Continue") and got[1].texts[0].endswith("\n\nheard")


def test_encodings_of_boxes(spark):
    faces = spark.createDataFrame([(1, 0, [0.9, 0.0, 10.0, 10.0], [1.0]), (1, 1, [0.0, 0.0, 10.0, 10.0], [2.0]), (2, 0, [0.0, 0.0, 10.0, 10.0], None)], "image long, f_ord int, box array<double>, enc array<double>")
    boxes = spark.createDataFrame([(1, 0, 0, 10, 10, 0), (1, 1, 50, 60, 60, 50), (2, 0, 0, 10, 10, 0), (3, 0, 0, 1, 1, 0)], "image long, q_ord int, top int, right int, bottom int, left int")
    got = {(r.image, r.q_ord): r.enc for r in cluster.encodings_of_boxes(boxes, faces, ["image"], 1).collect()}
    assert got == {(1, 0): [1.0], (1, 1): [0.0], (2, 0): [0.0]}


def test_streams_equal_batches(spark, tmp_path):
    from reelspark.streaming import stateful

    rng = random.Random(2)
    rows = [(v, f * 30, None if rng.random() < 0.1 else rng.random() * 20) for v in range(3) for f in range(40)]
    schema = "video long, frame_idx int, v double"
    for k in range(4):
        spark.createDataFrame([r for r in rows if k * 300 <= r[1] < (k + 1) * 300], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    files = sorted((tmp_path / "in").glob("*.parquet"), key=lambda p: p.stat().st_mtime_ns)
    assert len(files) == 4
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stateful.streamed_segments(stream, 9.0, 30).writeStream.format("memory").queryName("seen_segments").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.video, r.segment): (r.start_frame, r.end_frame, r.n) for r in spark.sql("select * from seen_segments").collect()}
    batch = {(r.video, r.segment): (r.start_frame, r.end_frame, r.n) for r in segment.anchored_runs(spark.createDataFrame(rows, schema), 9.0, 30).collect()}
    last = {v: max(s for w, s in batch if w == v) for v in range(3)}
    # A video's last segment is open until it is idle, unless a null closed it.
    assert {k: v for k, v in batch.items() if k[1] != last[k[0]]}.items() <= got.items() <= batch.items()


def test_streamed_tracks_equal_batch_ones(spark, tmp_path):
    from reelspark.streaming import stateful

    rng = np.random.default_rng(4)
    rows = []
    for video in range(3):
        for frame in range(12):
            for k in range(int(rng.integers(0, 4))):
                x, y = (rng.integers(0, 40, 2) + 30 * k).tolist()
                rows.append((video, frame, k, [float(x), float(y), x + 50.0, y + 50.0]))
    schema = "video long, frame_idx int, det_ord int, box array<double>"
    for part in range(3):
        spark.createDataFrame([r for r in rows if r[1] // 4 == part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stateful.streamed_tracks(stream, 0.3, 2).writeStream.format("memory").queryName("seen_tracks").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.sql("select * from seen_tracks").collect())
    batch = track.tracked(spark.createDataFrame(rows, schema), 0.3, 2)
    assert got == sorted((r.video, r.frame_idx, r.det_ord, r.track_id) for r in batch.collect())


def test_windowed_counts_and_batches(spark, tmp_path):
    from reelspark.streaming import stateful

    rows = [(f"2024-01-01 0{h}:{m:02d}:00", kind, float(m)) for h in range(4) for m in (0, 20, 40) for kind in ("a", "b")]
    df = spark.createDataFrame(rows, "ts string, event_type string, value double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = stateful.windowed_counts(stream).writeStream.format("memory").queryName("seen_counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(str(r.window.start), r.event_type): (r.n, r.value) for r in spark.sql("select * from seen_counts").collect()}
    assert got == {(f"2024-01-01 0{h}:00:00", kind): (3, 60.0) for h in range(4) for kind in ("a", "b")}
    q = stateful.reduce_batches(stream, lambda batch: batch.groupBy("event_type").count(), str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.event_type, r["count"], r.batch) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("a", 12, 0), ("b", 12, 0)}
