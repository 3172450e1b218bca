"""The models and the template tree held against plain versions."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reelspark.llm import kernels, lines, quality, toxicity

TEXTS = ["One two-three 4 four; one two\nthree", "", None, "two three one one", "é ü 12ab 12 ab!!", "one"]


def hashed(word):
    data = np.frombuffer(word.encode(), np.uint8)
    return int(kernels.word_hashes(data, np.array([0]), np.array([len(data)]))[0])


def plain_words(text):
    """Runs of letters (anything beyond ASCII is one), of digits, of other signs."""
    return re.findall(r"[A-Za-z\u0080-\U0010ffff]+|[0-9]+|[^A-Za-z0-9\x20\x09-\x0d\u0080-\U0010ffff]+", text or "")


def plain_vectors(texts):
    place, sign = quality._index_vectors()
    sums = np.zeros((quality.BUCKETS, quality.DIMENSIONS))
    for text in texts:
        buckets = [hashed(w) % quality.BUCKETS for w in plain_words(text)]
        for i, word in enumerate(buckets):
            for j in range(max(0, i - quality.WINDOW), min(len(buckets), i + quality.WINDOW + 1)):
                if j != i:
                    for k in range(quality.ONES):
                        sums[word, place[buckets[j], k]] += sign[buckets[j], k]
    used = sums.any(1)
    unit = sums[used] / np.maximum(np.linalg.norm(sums[used], axis=1), 1)[:, None]
    unit -= unit.mean(0)
    out = np.zeros_like(sums)
    out[used] = unit / np.maximum(np.linalg.norm(unit, axis=1), 1e-12)[:, None]
    return out


def plain_pooled(text, vectors):
    words = plain_words(text)
    return np.mean([vectors[hashed(w) % quality.BUCKETS] for w in words], axis=0) if words else np.zeros(vectors.shape[1])


def test_word_vectors_and_pooling(spark, documents):
    texts = TEXTS + [r.text[:400] for r in documents.limit(10).collect()]
    got = quality.word_vectors(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    want = plain_vectors(texts)
    assert np.allclose(got, want, atol=1e-5)
    pooled = quality.pooled(pa.array(texts), got)
    assert np.allclose(pooled, [plain_pooled(t, want) for t in texts], atol=1e-5)


def test_quality_scores_are_those_of_the_network(spark, documents, labels):
    docs = documents.limit(30)
    vectors = quality.word_vectors(docs.select("text"))
    net = quality.train(docs.select("doc_id", "text"), labels, vectors)
    got = {r.doc_id: r.score for r in quality.quality(docs, labels).collect()}
    for r in docs.collect():
        x = plain_pooled(r.text, vectors.astype(np.float64))
        if "w1" in net:
            hidden = np.tanh((x - net["mean"]) / net["scale"] @ net["w1"] + net["b1"])
            want = 1 / (1 + np.exp(-(hidden @ net["w2"] + net["b2"]) / net["temperature"]))
        else:
            want = net["prior"]
        assert got[r.doc_id] == pytest.approx(want, abs=1e-4)


def test_toxicity_features():
    def plain(text):
        words = re.findall(r"[A-Za-z0-9'\u0080-\U0010ffff]+", "".join(c.lower() if c < "\x80" else c for c in text or ""))
        out = {hashed(w) % toxicity.FEATURES for w in words}
        for w in (w.encode() for w in words):
            for k in toxicity.STEMS:
                if len(w) > k:
                    stem = np.frombuffer(w[:k], np.uint8)
                    h = kernels.word_hashes(stem, np.array([0]), np.array([k]))
                    out.add(int(kernels.mix(h, k)[0]) % toxicity.FEATURES)
        return sorted(out)

    got = {k: x.tolist() for k, x in toxicity.features(pa.array(TEXTS))}
    assert got == {k: plain(t) for k, t in enumerate(TEXTS)}


def test_toxicity_likelihood_and_slopes():
    rng = np.random.default_rng(0)
    s, cuts, y = rng.normal(size=40), np.array([-0.5, 0.4, 1.1]), rng.integers(0, 4, 40)
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def plain(s, cuts):
        edges = [1.0, *([None] * 3), 0.0]
        total = 0.0
        for score, grade in zip(s, y):
            edges[1:4] = [sigmoid(score - c) for c in cuts]
            total -= np.log(edges[grade] - edges[grade + 1])
        return total / len(s)

    loss, ds, dc = toxicity.likelihood(s, cuts, y)
    assert loss == pytest.approx(plain(s, cuts))
    step = 1e-6
    for k in range(40):
        moved = s.copy()
        moved[k] += step
        assert (plain(moved, cuts) - loss) / step == pytest.approx(ds[k], abs=1e-4)
    for k in range(3):
        moved = cuts.copy()
        moved[k] += step
        assert (plain(s, moved) - loss) / step == pytest.approx(dc[k], abs=1e-4)


def test_toxicity_sums_by_group():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 900_000, 7)
    index, starts = rng.integers(0, 50, sizes.sum()).astype(np.int32), np.cumsum(sizes) - sizes
    values = rng.normal(size=50)
    want = [values[index[a : a + n]].sum() for a, n in zip(starts, sizes)]
    assert toxicity._grouped(values, index, starts) == pytest.approx(want)
    assert len(toxicity._grouped(values, index[:0], starts[:0])) == 0


# Lines


def masked(line):
    return tuple(None if re.search("[0-9]", w) else w for w in re.findall(r"[^\x20\x09-\x0d]+", line))


def tie(line):
    """The operator's name of a line, which breaks ties between lines that are equally common."""
    return int(next(lines._lines(pa.array([line])))[3].view(np.int64)[0])


def plain_templates(all_lines):
    """Template of each masked line: a leaf's lines, commonest first, join the first template of most agreeing positions."""
    count = Counter(masked(x) for x in all_lines)
    name = {masked(x): tie(x) for x in all_lines}
    leaves = defaultdict(list)
    for words in count:
        if len(words) >= lines.LEAST_MERGED:
            leaves[len(words), words[: lines.DEPTH]].append(words)
    out = {words: words for words in count}
    for leaf in leaves.values():
        known = []
        for words in sorted(leaf, key=lambda w: (-count[w], name[w])):
            agree = [sum(a == b and a is not None for a, b in zip(t, words)) / len(words) for t, _ in known]
            best = int(np.argmax(agree)) if agree else None
            if best is not None and agree[best] >= lines.ALIKE:
                known[best][0][:] = [a if a == b else None for a, b in zip(known[best][0], words)]
                out[words] = known[best][1]
            else:
                known.append((list(words), words))
    return out


def plain_drops(docs, recurs=2, least_words=3):
    """{(id, text): positions dropped}."""
    docs = sorted({(k, t) for k, t in docs if t is not None}, key=lambda d: (d[0] is None, d[0] or 0))
    parsed = {d: [(k, x) for k, x in enumerate(d[1].split("\n")) if len(masked(x)) >= least_words] for d in docs}
    template = plain_templates([x for v in parsed.values() for _, x in v])
    sets = {d: {template[masked(x)]: len(masked(x)) for _, x in v} for d, v in parsed.items()}
    holders = defaultdict(list)
    for d in docs:
        for t in sets[d]:
            holders[t].append(d)
    common = {t for t, v in holders.items() if len(v) > 1}
    mark = {}
    for d in docs:
        mark[d] = frozenset(sets[d]) if set(sets[d]) <= common else d
    final = dict(mark)
    for d in docs:
        for keeper in {holders[t][0] for t in sets[d] if t in common} - {d}:
            shared = sum(n for t, n in sets[d].items() if t in common and holders[t][0] == keeper)
            mine, theirs = sum(sets[d].values()), sum(sets[keeper].values())
            if shared >= lines.COPY * mine and shared >= lines.COPY * (mine + theirs - shared):
                final[d] = mark[keeper]
    gone = {t for t in common if len({final[d] for d in holders[t]}) >= recurs}
    out = {d: {k for k, x in parsed[d] if template[masked(x)] in gone and holders[template[masked(x)]][0] != d} for d in docs}
    return {d: v for d, v in out.items() if v}


def test_line_drops_equal_a_plain_tree(spark, documents):
    rng = np.random.default_rng(3)
    words = [f"w{chr(97 + k)}" for k in range(26)]
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    passage = " ".join(rng.choice(words, 60))
    for k in range(40):
        own = [" ".join(rng.choice(words, 9)) for _ in range(rng.integers(1, 5))]
        name = rng.choice(words)
        made = [f"please contact our office {name} for any more questions on this", f"page {k} of 40 in this long report", passage]
        rows.append((10_000 + k, "\n".join([*own, *[x for x in made if rng.random() < 0.5]])))
    rows += [(20_000 + k, rows[-1][1]) for k in range(3)] + [(20_010, rows[-5][1] + "\nshort one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.h): set(r["drop"]) for r in lines.drops(docs).collect()}
    hashes = {(r.doc_id, r.text): r.h for r in docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()}
    want = {(d[0], hashes[d]): v for d, v in plain_drops(rows).items()}
    assert got == want and len(want) > 20
