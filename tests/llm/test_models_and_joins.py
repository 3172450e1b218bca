import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspark.llm import jaccard, kernels, lines, quality, shared, toxicity, vectors
from tests.llm import brute


def auc(y, x):
    order = np.argsort(x, kind="stable")
    rank = np.empty(len(x))
    rank[order] = np.arange(1, len(x) + 1)
    n1, n0 = y.sum(), (~y).sum()
    return (rank[y].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


# Kernels


def test_word_bounds_and_hashes():
    import pyarrow as pa

    texts = ["Ab  cd\nef", None, "", "cd", "x", " é ü"]
    seen = {}
    for first, end, data, offsets in kernels.chunks(pa.array(texts), 6):
        a, b, row = kernels.words(data, offsets, 1 - kernels.SPACE)
        for x, y, r, h in zip(a, b, row, kernels.word_hashes(data, a, b)):
            seen.setdefault(first + int(r), []).append((bytes(data[x:y]).decode(), int(h)))
    assert {k: [w for w, _ in v] for k, v in seen.items()} == {0: ["Ab", "cd", "ef"], 3: ["cd"], 4: ["x"], 5: ["é", "ü"]}
    assert seen[0][1][1] == seen[3][0][1] and len({h for v in seen.values() for _, h in v}) == 6


def test_summed_tables(spark):
    def fill(batch, table):
        np.add.at(table, batch.column(0).to_numpy() % 1000, 1)

    got = shared.summed(spark.range(0, 5000, 1, 3), fill, 1000)
    assert (got == 5).all()
    assert not shared.summed(spark.range(0), fill, 1000).any()
    few = spark.range(1500).where("id != 7")
    assert (shared.summed(few, fill, 1000, least=2) == (shared.summed(few, fill, 1000) >= 2)).all()
    assert not shared.summed(few.where("id < 0"), fill, 1000, least=1).any()
    assert shared.summed(few.where("id < 20"), fill, 1000, least=0).all()


def test_the_driver_gets_a_bit_for_each_leaf(spark, documents, monkeypatch):
    got, collect = [], type(documents).collect
    monkeypatch.setattr(type(documents), "collect", lambda self: [out := collect(self), got.extend(len(x) for r in out for x in r if isinstance(x, bytes))][0])
    lines.templates(documents.select("doc_id", "text"))
    assert 0 < sum(got) <= lines.PLACES // 8 + shared.SLICES  # as 64-bit counts: 32 MB, and several copies of it in the JVM


@pytest.mark.parametrize("one_task", [0, 500_000])
def test_components_of_paths_and_stars(spark, monkeypatch, one_task):
    monkeypatch.setattr(shared, "ONE_TASK", one_task)
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, x) for x in range(101, 160)] + [(500, 501), (501, 500), (7, 7)]
    got = {r.node: r.component for r in shared.components(spark.createDataFrame(edges, "u long, v long").repartition(4)).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 160)}, 500: 500, 501: 500}
    assert shared.components(spark.createDataFrame([], "u long, v long")).count() == 0


# Jaccard join


def expected_groups(rows, width, percent):
    rows = sorted(rows)
    sets = [brute.shingles(t, width) for _, t in rows]

    def linked(i, j):
        both = len(sets[i] & sets[j])
        return bool(sets[i]) and 100 * both >= percent * len(sets[i] | sets[j]) and bool(sets[j])

    return dict(zip((k for k, _ in rows), zip(map(len, sets), brute.groups([k for k, _ in rows], linked))))


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80)])
def test_groups_equal_brute_force(spark, documents, width, percent):
    rng = np.random.default_rng(2)
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    for k, (_, text) in enumerate(rows[:40]):  # near copies on both sides of the threshold
        for j in range(4):
            words = text.split(" ")
            for at in rng.integers(0, len(words), 1 + len(words) // 30 * j // 2):
                words[at] = f"w{at}{j}"
            rows.append((10_000 + 10 * k + j, " ".join(words)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), width, percent).collect()}
    assert got == expected_groups(rows, width, percent)


def test_chains_and_hot_groups(spark):
    # A chain whose ends are not alike, and many near copies of one text that also differ among themselves.
    rng = np.random.default_rng(4)
    words = [f"t{k}" for k in range(400)]
    rows = []
    for k in range(30):
        words[k * 5 : k * 5 + 5] = [f"c{k}x{j}" for j in range(5)]
        rows.append((k, " ".join(words)))
    base = [f"b{k}" for k in range(200)]
    for k in range(150):
        near = list(base)
        for at in rng.integers(0, 200, 4):
            near[at] = f"n{k}x{at}"
        rows.append((1000 + k, " ".join(near)))
    rows += [(2000 + k, " ".join(base)) for k in range(100)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()}
    assert got == expected_groups(rows, 4, 85)


def test_shared_sentences_are_no_hot_groups(spark, monkeypatch):
    # Unlike texts of all sizes from one pool of sentences, so nearly every token has many classes; and near copies of some.
    sent, keep = [], shared.Shelf.keep
    monkeypatch.setattr(shared.Shelf, "keep", lambda self, df: [out := keep(self, df), sent.append(out.agg(F.sum(F.length("diff"))).first()[0] or 0 if "diff" in df.columns else 0)][0])
    rng = np.random.default_rng(8)
    pool = [" ".join(f"p{k}w{j}" for j in range(60)) for k in range(100)]
    sizes = np.exp(rng.uniform(np.log(2), np.log(40), 500)).astype(int)
    rows = [(k, " ".join(pool[x] for x in rng.choice(100, n, replace=False))) for k, n in enumerate(sizes)]
    for k in range(0, 500, 10):
        words = rows[k][1].split(" ")
        rows.append((1000 + k, " ".join(words[: len(words) - len(words) // (8 + k // 10 % 5)])))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()}
    assert got == expected_groups(rows, 4, 85)
    assert sum(sent) < 2 * sum(len(t) for _, t in rows)  # 21 times when each class met every hub of its tokens


@pytest.mark.parametrize("percent", [80, 85, 100])
def test_scales_of_sizes_that_link(spark, percent):
    rows = spark.range(1, 3000).select(F.col("id").alias("n"), jaccard._scale(F.col("id"), percent).alias("k")).collect()
    n, k = (np.array(x) for x in zip(*rows))
    near = 100 * n[:, None] >= percent * n[None, :]
    assert (np.abs(k[:, None] - k[None, :])[near & near.T] <= 1).all()


def test_jaccard_of_odd_rows(odd_docs, no_docs):
    got = jaccard.jaccard_groups(odd_docs, 4, 85).collect()
    assert len(got) == odd_docs.count()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[0].n_shingles == by[1].n_shingles == by[2].n_shingles == 0 and by[2].component_id == 2
    assert by[7].component_id == 5 and by[9].component_id == 8 and by[3].n_shingles == 1
    assert jaccard.jaccard_groups(no_docs, 4, 85).count() == 0


def test_any_order_keeps_a_common_token():
    rng = np.random.default_rng(0)
    level = rng.integers(0, 5, jaccard.COUNTS).astype(np.uint8)
    for _ in range(200):
        n = int(rng.integers(1, 120))
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) < 0.93], rng.integers(0, 2**63, n // 20).astype(np.uint64)]))
        if len(y) and jaccard.linked(x, y, 85):
            for order in (1, 2, 3):
                least = max(jaccard.shared_tokens(len(x), 85), jaccard.shared_tokens(len(y), 85))
                assert len(np.intersect1d(jaccard.prefix(x, level, order, 85), jaccard.prefix(y, level, order, 85))) >= least


# Vectors


def expected_vectors(rows, threshold):
    ids = [k for k, _ in rows]
    good = [v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    m = np.array([v if ok else [0.0] * 8 for (_, v), ok in zip(rows, good)], np.float64)
    m = m / np.maximum(np.linalg.norm(m, axis=1), 1e-300)[:, None]
    hit = m @ m.T >= threshold
    hit &= np.array(good)[:, None] & np.array(good)
    np.fill_diagonal(hit, False)
    return dict(zip(ids, zip(hit.sum(1).tolist(), brute.groups(ids, lambda i, j: hit[i, j]))))


@pytest.mark.parametrize("percent", [50, 80, 85, 100])
def test_prefixes_are_long_enough_for_what_they_must_share(percent):
    length, least = jaccard.prefix_length, jaccard.shared_tokens
    for n in range(1, 400):
        assert length(n, percent) <= n
        for m in range(-(-percent * n // 100), n + 1):
            both = -(-percent * (n + m) // (100 + percent))
            sure = min(length(n, percent) - n + both, length(m, percent) - m + both, both)
            assert sure >= max(least(n, percent), least(m, percent))


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 8))
    rows = [(k, (centres[k % 12] + rng.normal(scale=0.35, size=8)).tolist()) for k in range(300)]
    rows += [(300 + k, (1e-160 * np.array(rows[0][1])).tolist() if k % 2 else rows[0][1]) for k in range(40)]
    rows += [(400, None), (401, [0.0] * 8), (402, [float("nan")] * 8), (403, [1.0, None, *[0.0] * 6]), (404, [float("inf")] * 8), (405, [1.0] * 3), (406, [-0.0, *rows[0][1][1:]]), (407, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("e", F.lit(1)).withColumn("node", F.lit(1)).withColumn("id", F.lit("x"))
    for tile in (16, 4096):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(df, 0.95, tile=tile).collect()}
        assert got == {k: (*v, k == v[1]) for k, v in expected_vectors(rows, 0.95).items()}


def test_vectors_of_the_table(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    df = df.unionAll(df.limit(30).select(F.col("vec_id") + 10_000, F.transform("embedding", lambda x: x * 2).alias("embedding"), "label"))
    rows = sorted((r.vec_id, r.embedding) for r in df.collect())
    m = np.array([v for _, v in rows], np.float64)
    m /= np.linalg.norm(m, axis=1)[:, None]
    hit = m @ m.T >= 0.95
    np.fill_diagonal(hit, False)
    got = {r.vec_id: r.n_links for r in vectors.near_vectors(df).collect()}
    assert got == dict(zip((k for k, _ in rows), hit.sum(1).tolist())) and sum(got.values()) >= 60


def test_vectors_of_two_lengths(spark):
    rows = [(k, [1.0, 0.1 * k, 0.0]) for k in range(3)] + [(10, [1.0, 0.0]), (11, [2.0, 0.0]), (12, [1.0, 0.0, 0.0, 0.0]), (13, [0.0, 1.0])]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {0: (2, 0, True), 1: (2, 0, False), 2: (2, 0, False), 10: (1, 10, True), 11: (1, 10, False), 12: (0, 12, True), 13: (0, 13, True)}


def test_vectors_of_many_dimensions(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(30, 70))
    rows = [(k, (centres[k % 30] + rng.normal(scale=0.25, size=70)).tolist()) for k in range(400)]
    m = np.array([v for _, v in rows])
    m /= np.linalg.norm(m, axis=1)[:, None]
    for threshold in (0.95, 0.9):
        hit = m @ m.T >= threshold
        np.fill_diagonal(hit, False)
        got = {r.vec_id: r.n_links for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), threshold, tile=32).collect()}
        assert got == dict(enumerate(hit.sum(1).tolist()))


def test_no_vectors(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vectors.near_vectors(empty).count() == 0
    odd = spark.createDataFrame([(1, None), (None, [0.0]), (None, [1.0]), (2, [1.0])], "vec_id long, embedding array<float>")
    got = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(odd).collect())
    assert got == sorted([("1", 0, 1, True), ("None", 0, None, False), ("None", 1, None, False), ("2", 1, 2, True)])


# Models


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.quality(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert auc(got.quality.values > 0, got.score.values) > 0.9
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    assert all(zlib.crc32(str(k).encode()) % 5 == 0 for k in got.doc_id)


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet").join(labels.select("doc_id"), "doc_id")
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert auc(got.toxic.values > 0, got.score.values) > 0.95
    assert got[got.toxic == 0].predicted.mean() < 0.02
    assert got.expected_severity.between(0, toxicity.GRADES).all() and got[got.toxic > 0].expected_severity.mean() > 1


def test_temperature_calibrates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 3))
    p = 1 / (1 + np.exp(-2 * x[:, 0]))
    y = (rng.random(4000) < p).astype(float)
    net = quality.fit(x[:2000], y[:2000])
    assert 0.3 < net["temperature"] < 5
    assert abs(quality.predict(x[2000:], net) - p[2000:]).mean() < 0.1


def test_thresholds_stay_in_order():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 4, 600)
    rows = [np.unique(np.concatenate([rng.integers(100, 200, 5), np.arange(k)])).astype(np.int32) for k in y]
    net = toxicity.fit(rows, y)
    assert (np.diff(net["cuts"]) > 0).all()
    score = np.array([net["weights"][x].sum() for x in rows])
    assert all(score[y == k].mean() < score[y == k + 1].mean() for k in range(3))


@pytest.mark.parametrize("model", [quality.quality, toxicity.toxicity])
def test_models_on_odd_rows(spark, odd_docs, no_docs, labels, model):
    assert model(no_docs, labels).count() == 0
    got = model(odd_docs, labels)
    assert got.count() == odd_docs.count() and got.where("score is null or score < 0 or score > 1").count() == 0
    none = labels.limit(0)
    assert model(odd_docs, none).select("score").distinct().count() == 1
    mixed = spark.createDataFrame([(1, None, None), (2, 1, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert model(odd_docs, mixed).count() == odd_docs.count()
