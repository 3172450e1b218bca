"""Each stage of the pipeline on what the one before it wrote, held against plain versions."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from reelspark.llm import jaccard, lines, quality, queries, shared
from tests.llm import brute
from tests.llm.test_text_operators import check_packed


@pytest.fixture(scope="module")
def stages(spark, sf, documents, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    out, docs = [documents], documents
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append(docs)
    return out


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "mixing sources to target weights", "packing"]


def test_columns(stages, documents):
    assert all(s.columns == documents.columns for s in stages[:-1])


def test_quality_stage(stages, labels):
    kept = quality.quality(stages[0], labels).where("predicted = 1")
    assert {r.doc_id for r in kept.collect()} == set(by_id(stages[1])) < set(by_id(stages[0]))


def test_line_stage(stages):
    before, after = by_id(stages[1]), by_id(stages[2])
    drops = {r.doc_id: set(r["drop"]) for r in lines.drops(stages[1]).collect()}
    assert drops
    for key, row in before.items():
        gone = drops.get(key, set())
        text = "\n".join(x for k, x in enumerate(row.text.split("\n")) if k not in gone)
        if gone and not text.strip():
            assert key not in after
        else:
            assert after[key].text == text and after[key].n_chars == len(text)


def test_jaccard_stage(stages):
    rows = sorted((r.doc_id, r.text) for r in stages[2].collect())
    sets = [brute.shingles(t, 5) for _, t in rows]

    def linked(i, j):
        both = len(sets[i] & sets[j])
        return both > 0 and 100 * both >= 80 * len(sets[i] | sets[j])

    assert set(by_id(stages[3])) == set(brute.groups([k for k, _ in rows], linked))


def test_jaccard_stage_of_repeated_and_null_ids(spark, sf):
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(40))
    rows = [(1, text(1)), (1, text(1)), (2, text(2)), (5, text(2)), (5, text(3)), (None, text(4)), (None, text(4)), (None, text(2) + " more"), (None, text(5)), (9, text(5)), (7, ""), (7, "")]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.one_of_each_group(spark, docs, sf).collect()]
    want = [(1, text(1)), (2, text(2)), (5, text(3)), (None, text(4)), (9, text(5)), (7, ""), (7, "")]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_jaccard_stage_of_shared_sentences(spark, sf, monkeypatch):
    # Unlike texts of all sizes from one pool of sentences all stay, and few differences are written to tell.
    sent, keep = [], shared.Shelf.keep
    monkeypatch.setattr(shared.Shelf, "keep", lambda self, df: [out := keep(self, df), sent.append(out.agg(F.sum(F.length("diff"))).first()[0] or 0 if "diff" in df.columns else 0)][0])
    rng = np.random.default_rng(8)
    pool = [" ".join(f"p{k}w{j}" for j in range(60)) for k in range(100)]
    sizes = np.exp(rng.uniform(np.log(2), np.log(40), 500)).astype(int)
    rows = [(k, " ".join(pool[x] for x in rng.choice(100, n, replace=False)), "en", "s", None) for k, n in enumerate(sizes)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.one_of_each_group(spark, docs, sf).count() == 500
    assert sum(sent) < 12 * sum(len(r[1]) for r in rows)  # measured: 9 times; 24 times when each class met every hub of its tokens


def test_jaccard_stage_of_passages_shared_by_chance(spark, sf, monkeypatch):
    # An eighth of each text's shingles lie in many others. The table of a very large corpus tells no rare ones apart.
    monkeypatch.setattr(jaccard, "levels", lambda counts: np.zeros(len(counts), np.uint8))
    sent, keep = [], shared.Shelf.keep

    def kept(self, df):
        out = keep(self, df)
        sent.extend(out.agg(F.sum(F.length(c))).first()[0] or 0 for c in ("diff", "tokens") if dict(df.dtypes).get(c) == "binary")
        return out

    monkeypatch.setattr(shared.Shelf, "keep", kept)
    rng = np.random.default_rng(9)
    text = lambda k: " ".join(f"p{p}a p{p}b p{p}c p{p}d p{p}e p{p}f " + " ".join(f"w{k}x{j}y{i}" for i in range(9)) for j, p in enumerate(rng.choice(300, 60, replace=False)))
    texts = [text(k) for k in range(300)]
    rows = [(k, t, "en", "s", None) for k, t in enumerate(texts + [f"{t} and more" for t in texts[:5]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id for r in corpus_pipeline.one_of_each_group(spark, docs, sf).collect()}
    assert got == set(range(300))
    assert 0 < sum(sent) / sum(map(len, texts)) < 0.1  # the ten near copies alone; when eight shared tokens were enough, all sets and their differences


def test_mixing_stage(stages):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    before, after = {}, {}
    largest = {}
    for r in stages[3].collect():
        before[r.source] = before.get(r.source, 0) + size(r.text)
        largest[r.source] = max(largest.get(r.source, 0), size(r.text))
    for r in stages[4].collect():
        after[r.source] = after.get(r.source, 0) + size(r.text)
    for source, target in brute.targets(before).items():
        assert abs(after.get(source, 0) - target) <= largest[source]
    assert stages[4].groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3


def test_packing_stage(stages):
    from tokenizers import Tokenizer

    assert check_packed(stages[4], stages[5], Tokenizer.from_file(queries.tokenizer_path())) < 0.05


def test_run_equals_its_stages(spark, sf, stages):
    columns = ["doc_id", "start", "length", "ids_crc32"]
    got = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, stages[5].select(columns).collect()))


def test_empty_documents(spark, sf, no_docs):
    docs = no_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.count() == 0
        docs = out if out.columns == docs.columns else docs
