"""N-gram Jaccard join by prefix filters under several global token orders.

A document is the set of its distinct word shingles. Two sets link when their Jaccard similarity
reaches the threshold. For a set of n tokens in any fixed global order, a partner must share at
least ``l`` of the first ``n - ceil(t n) + l`` tokens, for any l; here l grows with the set, since a
long one shares some tokens by chance with very many others. The orders used here
put rare tokens first (by a table of counts over all documents) and break ties by different hashes:
the first order is indexed, the others are filters on the pairs that it gives, before the sets
themselves are compared.

Documents with equal sets form one class and only classes are compared. The links of a group of near
copies are quadratic in its size, so only its components are found, from a number of rows that
stays in proportion to the index:

* a token of at most ``SHORT`` classes gives its pairs, at most (SHORT - 1) / 2 for each row of the index;
* sets that share only tokens of more classes share ``l`` of them, so the last l - 1 of a set's such
  tokens (the commonest) are left out, and the classes of the others are parted by their sizes. What
  has at most ``SHORT`` classes then gives its pairs too, of which only those that share l tokens
  are compared;
* a larger part names one of its classes as its hub: the one with the commonest prefix, which in a
  group of near copies is the one closest to all. Its classes are compared with the hub alone. Those
  that do not link with it are compared with each other and with the rest by their differences from
  the hub, which decide the similarity exactly: |x ^ y| = |x ^ h| + |y ^ h| - 2 |(x ^ h) & (y ^ h)|. By
  the triangle inequality of the Jaccard distance only classes of neighbouring distances from
  the hub can link. They meet in blocks of bounded bytes, and a block returns a forest of its links.

The components are those of all links: a pair that is skipped already lies in one component or
fails a bound.

Defined results: a null or wordless text is the empty set, which links with nothing; a text with
fewer words than a shingle is one token; repeated rows are copies of one class; a null id keeps its
row and is ignored when another id of its component exists; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspark.llm import kernels
from reelspark.llm.shared import Shelf, components, forest, small_side, summed

#: Places of the table of token counts (a task sends it once: 4 MB), and bits of the candidate filter.
COUNTS = 1 << 20
BITS = 1 << 24
#: Tokens that two prefixes must share: so many and so many hundredths of a set; small sets need fewer.
LEAST, LEAST_SHARE = 8, 10
#: Classes of a token, or of a part of them alike in size, up to which their pairs are listed.
SHORT = 16
#: A token is common, and not gathered in one task, if its place counts this often the mean and this much more.
COMMON, COMMON_MORE = 8, 256
#: Pairs whose names may be broadcast: 24 bytes each; names of classes.
BROADCAST_PAIRS, BROADCAST_IDS = 100_000, 200_000
#: Classes that meet one copy of their hub, and differences in a block (8 bytes each).
PER_HUB, BLOCK = 512, 1 << 20
#: Set names that a task remembers, not to send a set's tokens again.
SEEN = 100_000
#: Orders after the one that is indexed; each is a filter on candidate pairs.
MORE_ORDERS = (2, 3)


def _fill(width: int):
    def fill(batch: pa.RecordBatch, table: np.ndarray) -> None:
        held, n = [], 0
        for _, tokens in kernels.sets_of_shingles(batch.column(0), width):
            held.append((tokens % np.uint64(COUNTS)).astype(np.int64))
            n += len(tokens)
            if n > 500_000:
                at, c = np.unique(np.concatenate(held), return_counts=True)
                table[at] += c
                held, n = [], 0
        if n:
            at, c = np.unique(np.concatenate(held), return_counts=True)
            table[at] += c

    return fill


def levels(counts: np.ndarray) -> np.ndarray:
    """The order's coarse key: the power of two of a place's count."""
    return np.log2(np.maximum(counts, 1)).astype(np.uint8)


def shared_tokens(n: int, percent: int) -> int:
    """How many tokens a set of n must share with any partner in their prefixes: what its smallest partner's prefix is long enough for."""
    share = -(-percent * n // 100)
    return min(LEAST + LEAST_SHARE * share // 100, share)


def prefix_length(n: int, percent: int) -> int:
    """Tokens in the prefix of a set of n."""
    share = -(-percent * n // 100)
    return n - share + min(LEAST + LEAST_SHARE * n // 100, share)


def prefix(tokens: np.ndarray, level: np.ndarray, order: int, percent: int) -> np.ndarray:
    """The set's first tokens in one global order: by level, then by that order's hash."""
    n = len(tokens)
    if not n:
        return tokens
    keep = prefix_length(n, percent)
    key = (level[(tokens % np.uint64(COUNTS)).astype(np.int64)].astype(np.uint64) << np.uint64(58)) | (kernels.mix(tokens, 16 + order) >> np.uint64(6))
    return tokens[np.argpartition(key, keep - 1)[:keep]] if keep < n else tokens


def _described(width: int, percent: int, level: np.ndarray, common: np.ndarray):
    """Size, 128-bit digest and first prefix of each document's set, common tokens apart; a task names a set's prefix once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                n, a, b, rare, often = [], [], [], [], []
                for _, tokens in kernels.sets_of_shingles(part.column(1), width):
                    x, y = _digest(tokens)
                    n.append(len(tokens))
                    a.append(x)
                    b.append(y)
                    if x in seen or not len(tokens):
                        rare.append(None)
                        often.append(None)
                        continue
                    if len(seen) > SEEN:
                        seen.clear()
                    seen.add(x)
                    first = prefix(tokens, level, 1, percent)
                    kind = common[(first % np.uint64(COUNTS)).astype(np.int64)]
                    rare.append(kernels.as_long(first[~kind]))
                    often.append(kernels.as_long(first[kind]))
                longs = lambda x: pa.array(kernels.as_long(np.array(x, np.uint64)), pa.int64())
                lists = lambda x: pa.array(x, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "n": pa.array(n, pa.int64()), "a": longs(a), "b": longs(b), "rare": lists(rare), "often": lists(often)})

    return run


def _in_company(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (token, a), sorted, once each and without the tokens of one class; the rows of one token are held at a time."""
    held = (np.zeros(0, np.int64),) * 2

    def kept(token: np.ndarray, a: np.ndarray) -> pa.RecordBatch:
        once = np.ones(len(token), bool)
        once[1:] = (token[1:] != token[:-1]) | (a[1:] != a[:-1])
        token, a = token[once], a[once]
        with_next = np.zeros(len(token), bool)
        same = token[1:] == token[:-1]
        with_next[1:] = same
        with_next[:-1] |= same
        return pa.RecordBatch.from_pydict({"token": token[with_next], "a": a[with_next]})

    for batch in batches:
        if batch.num_rows:
            token, a = (np.concatenate([h, batch.column(k).to_numpy()]) for k, h in enumerate(held))
            end = int(np.flatnonzero(token != token[-1])[-1]) + 1 if token[0] != token[-1] else 0
            yield kept(token[:end], a[:end])
            held = token[end:], a[end:]
    yield kept(*held)


def _digest(tokens: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a set."""
    with np.errstate(over="ignore"):
        return tuple(int(kernels.mix(np.sum(kernels.mix(tokens, k), keepdims=True))[0]) for k in (5, 6))


def _places(ids: pa.Array) -> np.ndarray:
    return (kernels.mix(ids.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), 9) % np.uint64(BITS)).astype(np.int64)


def _mark(batch: pa.RecordBatch, table: np.ndarray) -> None:
    at = _places(batch.column(0))
    np.bitwise_or.at(table, at >> 6, np.left_shift(np.int64(1), at & 63))


def _sets_of(width: int, bits: np.ndarray):
    """The sets, by digest, of the documents that may be wanted; a set of a task once, or again after very many others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seen, task = set(), TaskContext.get().partitionId()
        for batch in batches:
            at = _places(batch.column(0))
            batch = batch.filter(pa.array((bits[at >> 6] >> (at & 63)) & 1 == 1))
            for k in range(0, batch.num_rows, 256):
                names, sets = [], []
                for _, tokens in kernels.sets_of_shingles(batch.column(1).slice(k, 256), width):
                    a = _digest(tokens)[0]
                    if a not in seen:
                        if len(seen) > SEEN:
                            seen.clear()
                        seen.add(a)
                        names.append(a)
                        sets.append(tokens.tobytes())
                yield pa.RecordBatch.from_pydict({"a": pa.array(kernels.as_long(np.array(names, np.uint64)), pa.int64()), "task": pa.array([task] * len(sets), pa.int32()), "tokens": pa.array(sets, pa.binary())})

    return run


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 |x and y| >= percent |x or y|, for sorted sets."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _inside(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of x are in y, which is sorted and not empty."""
    return y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x


AGAINST = "u long, v long, n long, m long, linked boolean, diff binary"


def _against(percent: int, level: np.ndarray):
    """Rows (v, salt, u, far, tokens), sorted, the hub v itself first with no u: whether u links with v, and where ``far`` their difference."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, hub, own = None, np.zeros(0, np.uint64), {}
        for batch in batches:
            out = []
            for at, _, u, far, tokens in zip(*batch.columns, strict=True):
                x = np.frombuffer(tokens.as_buffer(), np.uint64)
                if not u.is_valid:
                    v, hub = at.as_py(), x
                    own = {k: np.sort(prefix(hub, level, k, percent)) for k in MORE_ORDERS}
                    continue
                if at.as_py() != v:  # a hub without an id has no set here
                    continue
                least = max(shared_tokens(len(x), percent), shared_tokens(len(hub), percent))
                if not far.as_py() and any(_inside(prefix(x, level, k, percent), own[k]).sum() < least for k in MORE_ORDERS):
                    continue
                both = _inside(x, hub)
                n = int(both.sum())
                hit = 100 * n >= percent * (len(x) + len(hub) - n)
                if far.as_py():
                    out.append((u.as_py(), v, len(x), len(hub), hit, np.concatenate([x[~both], hub[~_inside(hub, x)]]).tobytes()))
                elif hit:
                    out.append((u.as_py(), v, len(x), len(hub), hit, None))
            cols = list(zip(*out, strict=True)) if out else [()] * 6
            kinds = [pa.int64()] * 4 + [pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["u", "v", "n", "m", "linked", "diff"])

    return run


def _met(rows: list[tuple], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links of one block: rows (u, n, first side, second side, diff)."""
    one, two = [r for r in rows if r[2]], [r for r in rows if r[3]]
    tokens = [np.frombuffer(r[4], np.uint64) for r in two]
    owner = np.repeat(np.arange(len(two)), [len(x) for x in tokens])
    tokens = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    names, n = np.array([r[0] for r in two], np.int64), np.array([r[1] for r in two], np.int64)
    size = np.bincount(owner, minlength=len(two))
    u, v = np.zeros(0, np.int64), np.zeros(0, np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for name, m, _, _, diff in one if two else []:
        x = np.frombuffer(diff, np.uint64)
        low, high = np.searchsorted(tokens, x, "left"), np.searchsorted(tokens, x, "right")
        count = high - low
        at = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
        apart = len(x) + size - 2 * np.bincount(owner[at], minlength=len(two))
        hit = names[(100 * (m + n - apart) >= percent * (m + n + apart)) & (names != name)]
        if len(hit):
            found.append((np.full(len(hit), name), hit))
        if found and (len(found) > 1000 or name == one[-1][0]):
            u, v = (np.concatenate([old, *new]) for old, new in zip((u, v), zip(*found, strict=True), strict=True))
            u, v = forest(u, v)
            found = []
    return forest(np.concatenate([u, *(x for x, _ in found)]), np.concatenate([v, *(x for _, x in found)])) if found else (u, v)


def _blocks(percent: int):
    """Rows (v, low, high, i, j, u, n, first, second, diff) sorted by block: a forest of each block's links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []

        def out() -> pa.RecordBatch:
            u, v = _met(held, percent)
            return pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns)), strict=True):
                if row[:5] != block:
                    if held:
                        yield out()
                    block, held = row[:5], []
                held.append(row[5:])
        if held:
            yield out()

    return run


def _near(x: Column, y: Column, percent: int) -> Column:
    """Sizes that allow a link."""
    return (100 * F.least(x, y)) >= (percent * F.greatest(x, y))


def _scale(n: Column, percent: int) -> Column:
    """A number that differs by at most 1 between sizes that allow a link."""
    return F.floor(F.log(n) / max(math.log(100 / percent) * (1 + 1e-9), 1e-9))


def jaccard_groups(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row, as the module says; ``percent`` is the similarity in hundredths."""
    shelf = Shelf(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    counts = summed(docs.select("text"), _fill(width), COUNTS)
    level, common = levels(counts), counts > COMMON * counts.mean() + COMMON_MORE
    told = shelf.keep(docs.mapInArrow(_described(width, percent, level, common), "doc_id long, n long, a long, b long, rare array<long>, often array<long>"))

    # One class for each set: its digest's first half names it, its smallest document stands for it.
    classes = shelf.keep(told.where("n > 0 and doc_id is not null").groupBy("a").agg(F.min_by(F.struct("doc_id", "n", "b"), "doc_id").alias("x")).select("a", "x.doc_id", "x.n", "x.b"))
    share = F.ceil(percent * F.col("n") / 100)
    most = lambda n: F.least(LEAST + F.floor(LEAST_SHARE * n / 100), share)
    need = most(share)

    # The index: prefix tokens of two classes or more, of the classes that have enough of them.
    rare = told.select(F.explode("rare").alias("token"), "a").repartition("token").sortWithinPartitions("token", "a").mapInArrow(_in_company, "token long, a long")
    rows = shelf.keep(rare.unionAll(told.select(F.explode("often").alias("token"), "a").distinct()))
    able = rows.groupBy("a").count().join(classes.select("a", "n"), "a").where(F.col("count") >= need).select("a", "n")
    some = shelf.keep(rows.join(able, "a"))
    often = some.groupBy("token").agg(F.count("*").alias("classes")).where("classes > 1")
    shared = shelf.keep(some.join(often, "token"))
    of = shared.groupBy("a").agg(F.first("n").alias("n"), F.count("*").alias("all"), F.count_if(F.col("classes") > SHORT).alias("hot"), F.sum(F.log2("classes")).alias("weight"))
    of = of.where(F.col("all") >= need).select("a", "hot", (F.col("weight") / (F.col("n") - share + most(F.col("n")))).alias("weight"))
    index = shelf.keep(shared.join(of, "a"))
    shelf.drop(rows, some, shared)

    wanted = index.select("a").distinct().join(classes, "a").select("doc_id")
    bits = summed(wanted, _mark, BITS // 64, np.bitwise_or)
    raw = shelf.keep(docs.where("doc_id is not null").mapInArrow(_sets_of(width, bits), "a long, task int, tokens binary"))
    again = raw.groupBy("a").agg(F.min("task").alias("one"), F.count("*").alias("times")).where("times > 1").select("a", "one")
    sets = raw.join(small_side(again, BROADCAST_PAIRS), "a", "left").where("one is null or one = task").select("a", "tokens")

    def against(pairs: DataFrame) -> DataFrame:
        """AGAINST of pairs (u, v, far): the set of u goes to v's, of which there is a copy for each ``PER_HUB`` of its pairs."""
        salts = pairs.groupBy("v").agg((1 + F.floor(F.count("*") / PER_HUB)).alias("salts"))
        pairs = pairs.join(salts, "v").select("v", F.pmod(F.xxhash64("u"), "salts").alias("salt"), "u", "far")
        left = sets.withColumnRenamed("a", "u").join(small_side(pairs, BROADCAST_PAIRS), "u").select("v", "salt", "u", "far", "tokens")
        hubs = salts.select("v", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
        hubs = sets.withColumnRenamed("a", "v").join(small_side(hubs, BROADCAST_PAIRS), "v").select("v", "salt", F.lit(None).cast("long").alias("u"), F.lit(False).alias("far"), "tokens")
        return shelf.keep(left.unionAll(hubs).repartition("v", "salt").sortWithinPartitions("v", "salt", "u").mapInArrow(_against(percent, level), AGAINST))

    # Of its hot tokens, a class needs the first ones alone, each with classes of its size or the next: a part that no smaller one holds.
    rank = F.row_number().over(Window.partitionBy("a").orderBy("classes", "token"))
    hot = index.where((F.col("classes") > SHORT) & (F.col("hot") >= need)).withColumn("k", rank).where(F.col("k") + need <= F.col("hot") + 1)
    hot = hot.withColumn("scale", _scale(F.col("n"), percent)).withColumn("part", F.explode(F.array("scale", F.col("scale") + 1)))
    hot = hot.select(F.xxhash64("token", "part").alias("token"), "a", "n", "hot", "weight", (F.col("scale") == F.col("part")).alias("own"))
    alike = hot.groupBy("token").agg(F.count("*").alias("classes"), F.bool_or("own").alias("new")).where("classes > 1 and new").select("token", "classes")
    hot = shelf.keep(hot.drop("own").join(alike, "token"))

    # Each class against the hubs of its hot tokens, and against the commonest hub of the others.
    hub = lambda df: df.join(df.groupBy("token").agg(F.max_by("a", F.struct("weight", "a")).alias("v")), "token").where("a != v")
    listed = hot.where(F.col("classes") <= SHORT).select("token", "a", "n", "hot")
    hot = hub(hot.where(F.col("classes") > SHORT)).select(F.col("a").alias("u"), "v").distinct()
    cold = hub(index.where(F.col("classes") <= SHORT)).groupBy("a", "n", "hot", "v").count()
    cold = cold.where(F.col("count") + F.col("hot") >= need).groupBy("a", "n").agg(F.max_by("v", F.struct("count", "v")).alias("v"))
    cold = cold.join(classes.select(F.col("a").alias("v"), F.col("n").alias("m")), "v").where(_near(F.col("n"), F.col("m"), percent)).select(F.col("a").alias("u"), "v")
    pairs = shelf.keep(hot.withColumn("far", F.lit(True)).unionAll(cold.withColumn("far", F.lit(False))).groupBy("u", "v").agg(F.max("far").alias("far")))
    first = against(pairs)
    links = first.where("linked").select("u", "v")

    # What does not link with a hub, against what shares the hub, by differences from it.
    far = first.where("diff is not null")
    far = far.join(far.where("not linked").select("v").distinct(), "v", "left_semi").withColumn("d", F.expr("length(diff) div 8"))
    reach = F.greatest(F.lit(1), (F.col("n") + F.col("m") + F.col("d")) * (100 - percent))
    far = far.withColumn("band", (F.ceil(200 * F.col("d") / reach) - 1).cast("int"))
    loads = far.groupBy("v", "band").agg((1 + F.floor(F.sum(F.col("d") + 16) / BLOCK)).cast("int").alias("parts"))
    loads = loads.groupBy("v").agg(F.map_from_entries(F.collect_list(F.struct("band", "parts"))).alias("parts"))
    far = far.join(loads, "v")
    parts = lambda k: F.coalesce(F.try_element_at("parts", F.col("band") + k), F.lit(0))
    far = far.withColumn("part", F.pmod(F.xxhash64("u"), parts(0)).cast("int"))
    each = lambda k, low, make: F.when(F.lit(low) & (parts(k) > 0), F.transform(F.sequence(F.lit(0), F.greatest(parts(k) - 1, F.lit(0))), make)).otherwise(F.array().cast(BLOCK_TYPE))
    own = lambda j: _block(F.col("band"), F.col("band"), F.least("part", j), F.greatest("part", j), F.col("part") <= j, F.col("part") >= j)
    up = lambda j: _block(F.col("band"), F.col("band") + 1, F.col("part"), j, F.lit(True), F.lit(False))
    down = lambda j: _block(F.col("band") - 1, F.col("band"), j, F.col("part"), F.lit(False), F.lit(True))
    keys = ["v", "low", "high", "i", "j"]
    met = far.withColumn("b", F.explode(F.concat(each(0, F.col("band") > 0, own), each(1, F.lit(True), up), each(-1, F.lit(True), down)))).select("v", "b.low", "b.high", "b.i", "b.j", "u", "n", "b.one", "b.two", "diff")
    met = shelf.keep(met.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_blocks(percent), "u long, v long"))
    links = links.unionAll(met)
    found = components(links)

    # All pairs of a token of few classes that are not in one component yet.
    cold = index.where(F.col("classes") <= SHORT).select("token", "a", "n", "hot").unionAll(listed).join(found.withColumnRenamed("node", "a"), "a", "left").withColumn("c", F.coalesce("component", "a"))
    mixed = cold.groupBy("token").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("token")
    cold = shelf.keep(cold.join(mixed, "token").select("token", "a", "n", "hot", "c"))
    two = cold.select("token", F.col("a").alias("v"), F.col("n").alias("m"), F.col("hot").alias("hot2"), F.col("c").alias("c2"))
    both = cold.withColumnRenamed("a", "u").join(two, "token").where((F.col("u") < F.col("v")) & (F.col("c") != F.col("c2")) & _near(F.col("n"), F.col("m"), percent))
    both = both.groupBy("u", "v").agg(F.count("*").alias("count"), F.first(F.least("hot", "hot2")).alias("hot"), F.first(F.greatest("n", "m")).alias("n"))
    both = shelf.keep(both.where(F.col("count") + F.col("hot") >= need).select("u", "v", "n"))
    # Those that share enough tokens of all, in the index's own order.
    nodes = small_side(both.select(F.explode(F.array("u", "v")).alias("a")).distinct(), BROADCAST_IDS)
    prefixes = index.join(nodes, "a", "left_semi").groupBy("a").agg(F.collect_list("token").alias("tokens"))
    both = both.join(prefixes.select(F.col("a").alias("u"), F.col("tokens").alias("x")), "u").join(prefixes.select(F.col("a").alias("v"), F.col("tokens").alias("y")), "v")
    both = both.where(F.size(F.array_intersect("x", "y")) >= need).select("u", "v")
    both = both.join(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")), ["u", "v"], "left_anti")
    links = links.unionAll(against(shelf.keep(both.withColumn("far", F.lit(False)))).where("linked").select("u", "v"))
    found = components(links)

    known = classes.join(found.withColumnRenamed("node", "a"), "a", "left").withColumn("c", F.coalesce("component", "a"))
    smallest = known.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    known = known.join(smallest, "c").select("a", "b", "component_id")
    out = told.where("n > 0").select("doc_id", "n", "a", "b").join(known, ["a", "b"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return shelf.close(out.unionAll(told.where("n = 0").select("doc_id", F.lit(0).cast("long"), "doc_id")))


BLOCK_TYPE = "array<struct<low:int,high:int,i:int,j:int,one:boolean,two:boolean>>"


def _block(low: Column, high: Column, i: Column, j: Column, one: Column, two: Column) -> Column:
    """A block's name, and on which of its sides a row stands."""
    return F.struct(low.cast("int").alias("low"), high.cast("int").alias("high"), i.cast("int").alias("i"), j.cast("int").alias("j"), one.alias("one"), two.alias("two"))
