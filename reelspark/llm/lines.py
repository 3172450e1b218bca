"""Line deduplication with a log-template tree.

A line's words are masked (words with a digit become a variable) and the line falls down a tree of
fixed depth: first its number of words, then its leading words. In a leaf, lines that agree on most
positions are merged and the positions where they differ become variables of their template. A leaf
with very many different lines is merged in bounded parts, whose templates are merged again, until
they fit into one part. Each turn deals them by another segment of their words: of as many segments
as lines may differ in words and one more, lines that agree enough share one. A part that is still
too large is cut into blocks, and every two blocks of it are merged together in one of its rounds.
So no two templates of a leaf agree enough to be one, however many lines it has.

A template that recurs across documents is dropped everywhere but in its first document (the
smallest id). Recurrence is counted over independent documents: copies of one document count once,
so this step removes boilerplate and leaves whole copies to document deduplication. Copies are
documents of equal template sets, or one whose set and that of the document that keeps its lines
are similar from ``COPY`` by the lines kept there alone, so no document is a copy for one shared line.

Defined results: null and empty texts stay as they are; blank lines and lines of fewer than
``least_words`` words are always kept; rows with equal id and text are one document and are treated
alike; a null id comes last among the documents; other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.llm import kernels
from reelspark.llm.shared import free, summed
from reelspark.session import cut, ready

#: Leading words of the tree; different lines that are compared with each other in one part of a leaf.
DEPTH, LEAF = 4, 2000
#: Share of positions on which merged lines agree, and words from which lines are merged at all.
ALIKE, LEAST_MERGED = 0.8, 6
#: Independent documents from which a template recurs; similarity of the template sets, by words, from which two documents are copies.
RECURS, COPY = 2, 0.9

#: Places of the table of leaf counts; lines in leaves that are too empty to recur are not merged.
PLACES = 1 << 22

LINES = "doc_id long, h long, pos int, n int, exact long, leaf long, sig binary"
_CLASSES = np.ones(256, np.uint8)
_CLASSES[kernels.SPACE == 1] = 0
_CLASSES[10] = 2
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def _lines(text: pa.Array) -> Iterator[tuple]:
    """Of every line with words: row, position, number of words, masked hash, leaf; and its words' two-byte hashes with their bounds."""
    for first, end, data, offsets in kernels.chunks(text):
        a, b, row = kernels.words(data, offsets, _CLASSES)
        brk = data[a] == 10 if len(a) else np.zeros(0, bool)
        # A run of line ends counts each; a word's line is the line ends before it in its row.
        ends = np.where(brk, b - a, 0)
        before = np.cumsum(ends) - ends
        starts = np.searchsorted(row, np.arange(end - first))
        zero = np.append(before, ends.sum())[starts]
        word = ~brk
        a, b, row, line = a[word], b[word], row[word], (before - zero[row])[word]
        if not len(a):
            continue
        digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
        h = kernels.word_hashes(data, a, b)
        h[digits[b] > digits[a]] = 0
        new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (line[1:] != line[:-1])]))
        n = np.diff(np.append(new, len(a)))
        within = np.arange(len(a)) - np.repeat(new, n)
        with np.errstate(over="ignore"):
            placed = kernels.mix(h + kernels.mix(within.astype(np.uint64), 4))
            exact = kernels.mix(np.add.reduceat(placed, new) + n.astype(np.uint64))
            placed[within >= DEPTH] = 0
            leaf = kernels.mix(np.add.reduceat(placed, new) + n.astype(np.uint64), 7)
        sig = (h % np.uint64(65535)).astype("<u2") + (h != 0).astype("<u2")
        yield first + row[new], line[new], n, exact, leaf, sig, np.append(new, len(a))


def _places(leaf: np.ndarray) -> np.ndarray:
    return (leaf % np.uint64(PLACES)).astype(np.int64)


def _count(batch: pa.RecordBatch, table: np.ndarray) -> None:
    for _, _, n, _, leaf, _, _ in _lines(batch.column(0)):
        at, c = np.unique(_places(leaf[n >= LEAST_MERGED]), return_counts=True)
        table[at] += c


def _parsed(full: np.ndarray):
    """The lines as rows; the words' hashes only where the leaf may hold lines that recur together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, line, n, exact, leaf, sig, bounds in _lines(batch.column(2)):
                keep = full[_places(leaf)] & (n >= LEAST_MERGED)
                words = np.where(keep, n, 0)
                raw = pa.py_buffer(sig[np.repeat(keep, n)].tobytes())
                at = pa.py_buffer(np.concatenate([[0], 2 * np.cumsum(words)]).astype(np.int32).tobytes())
                valid = pa.py_buffer(np.packbits(keep, bitorder="little").tobytes())
                docs = pa.array(docs)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column(0).take(docs), "h": batch.column(1).take(docs), "pos": pa.array(line, pa.int32()), "n": pa.array(n, pa.int32()),
                    "exact": pa.array(kernels.as_long(exact)), "leaf": pa.array(kernels.as_long(leaf)), "sig": pa.Array.from_buffers(pa.binary(), len(n), [valid, at, raw]),
                })

    return run


def _merge(sigs: list[bytes], counts: list[int], exact: list[int]) -> tuple[list[int], dict[int, bytes]]:
    """The template of each line, named by its commonest line, and the words of each template; lines are taken commonest first."""
    out = list(exact)
    names: list[int] = []
    table = np.zeros((16, len(sigs[0]) // 2), np.uint16)
    for k in sorted(range(len(sigs)), key=lambda k: (-counts[k], exact[k])):
        words, used = np.frombuffer(sigs[k], "<u2"), table[: len(names)]
        if len(names):
            same = ((used == words) & (used != 0)).mean(1)
            best = int(same.argmax())
            if same[best] >= ALIKE:
                used[best][used[best] != words] = 0
                out[k] = names[best]
                continue
        if len(names) == len(table):
            table = np.concatenate([table, np.zeros_like(table)])
        table[len(names)] = words
        names.append(exact[k])
    return out, {name: row.astype("<u2").tobytes() for name, row in zip(names, table, strict=False)}


def merged(sigs: list[bytes], counts: list[int], exact: list[int]) -> list[int]:
    """The template of each line of a leaf, named by its commonest line; lines are taken commonest first."""
    return _merge(sigs, counts, exact)[0]


MERGED = "leaf long, exact long, template long, docs long, sig binary, part long, blocks long"


def _generalised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Templates of rows (leaf, group, exact, docs, sig, part, blocks) sorted by leaf and group; one group at a time is held.

    The row that names a template has its words and all its documents.
    """
    group, held = None, ([], [], [], [], [])

    def out() -> pa.RecordBatch:
        exact, docs, sigs, part, blocks = held
        template, words = _merge(sigs, docs, exact)
        total = dict.fromkeys(words, 0)
        for name, n in zip(template, docs, strict=True):
            total[name] += n
        rows = ([group[0]] * len(exact), exact, template, [total.get(x) for x in exact], [words.get(x) for x in exact], part, blocks)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if k == 4 else pa.int64()) for k, x in enumerate(rows)], [x.split()[0] for x in MERGED.split(", ")])

    for batch in batches:
        done = []
        for leaf, k, *row in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
            if (leaf, k) != group:
                if held[0]:
                    done.append(out())
                group, held = (leaf, k), ([], [], [], [], [])
            for x, y in zip(held, row, strict=True):
                x.append(y)
        if done:
            yield from pa.Table.from_batches(done).combine_chunks().to_batches()
    if held[0]:
        yield out()


def _group(block: Column, blocks: Column, turn: int) -> Column:
    """The pair of blocks, an even number, in which a block is in a turn; in blocks - 1 turns each block meets every other once."""
    last, turn = blocks - 1, F.lit(turn)
    other = F.pmod(turn - block, last)
    return F.when(block == last, F.pmod(turn * (blocks / 2).cast("long"), last)).otherwise(F.least(block, other))


def _names(open_: DataFrame) -> DataFrame:
    """(exact, template) of the merged ones of different lines (leaf, exact, docs, sig, count); ``count``: those of the leaf."""
    row = ["leaf", "exact", "docs", "sig", "part", "blocks"]
    dealt = lambda df: df.select("leaf", "group", *row[1:]).repartition("leaf", "group").sortWithinPartitions("leaf", "group").mapInArrow(_generalised, MERGED)
    names = lambda df: df.where("exact != template").select("exact", "template")
    alone = lambda df: df.select("*", *(F.lit(k).cast("long").alias(c) for c, k in (("group", 0), ("part", 0), ("blocks", 1))))

    def renamed(out: DataFrame | None, found: DataFrame) -> DataFrame:
        """``out`` and ``found``; what earlier turns named has the name of its template's template."""
        if out is None:
            return cut(found)
        then = found.select(F.col("exact").alias("template"), F.col("template").alias("next"))
        return cut(out.join(then, "template", "left").select("exact", F.coalesce("next", "template").alias("template")).unionAll(found))

    segments = F.floor((1 - ALIKE) * F.expr("length(sig) div 2") + 1e-9) + 1
    out, segment = None, 0
    while True:
        found = names(dealt(alone(open_.where(f"count <= {LEAF}"))))
        # A turn for each segment: words never come back to a template, so lines that are alike at the end have met.
        large = open_.where(f"count > {LEAF}").withColumn("s", segments).where(f"s > {segment}")
        if large.isEmpty():
            return found if out is None else renamed(out, found)
        a, b = (F.expr(f"int({k} * (length(sig) div 2) div s)") for k in (segment, segment + 1))
        large = large.withColumn("part", F.xxhash64(F.substring("sig", 2 * a + 1, 2 * (b - a))))
        sizes = large.groupBy("leaf", "part").agg(F.expr(f"if(count(*) <= {LEAF}, 1, 2 * ((count(*) + {LEAF - 1}) div {LEAF}))").cast("long").alias("blocks"))
        large = cut(large.join(sizes, ["leaf", "part"]).select(*row))
        ends = sorted({max(1, r.blocks - 1) for r in large.select("blocks").distinct().collect()})
        done = None
        # A part of one block is merged at once; in a larger one, each pair of blocks has its turn.
        for turn in range(ends[-1]):
            block = F.pmod(F.xxhash64("exact"), "blocks")
            group = F.when(F.col("blocks") == 1, F.col("part")).otherwise(F.xxhash64("part", _group(block, F.col("blocks"), turn)))
            merged_ = cut(dealt(large.withColumn("group", group)))
            found = names(merged_) if found is None else found.unionAll(names(merged_))
            out, found = renamed(out, found), None
            large = merged_.where("exact = template").select(*row)
            if turn + 1 in ends:
                left = large.where(F.greatest(F.lit(1), F.col("blocks") - 1) == turn + 1)
                done = cut(left if done is None else done.unionAll(left))
                large = large.where(F.col("blocks") - 1 > turn + 1)
        open_ = done.select("leaf", "exact", "docs", "sig")
        open_ = cut(open_.join(open_.groupBy("leaf").agg(F.count("*").alias("count")), "leaf"))
        segment += 1


def templates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = 3, recurs: int = RECURS) -> DataFrame:
    """(doc_id, h, pos, n, template) of each line with words; h: a hash of the text."""
    ready(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text")).where("text is not null")
    full = summed(slim.select("text"), _count, PLACES, least=recurs)
    lines = cut(slim.mapInArrow(_parsed(full), LINES).where(f"n >= {least_words}"))
    # Only lines with company in their leaf are merged, where together they can recur at all.
    distinct = lines.where("sig is not null").groupBy("leaf", "exact").agg(F.min("sig").alias("sig"), F.count("*").alias("docs"))
    sizes = distinct.groupBy("leaf").agg(F.count("*").alias("count"), F.sum("docs").alias("all")).where((F.col("count") > 1) & (F.col("all") >= recurs)).drop("all")
    names = _names(cut(distinct.join(sizes, "leaf")))
    names = names.groupBy("exact").agg(F.min("template").alias("template"))
    return lines.drop("sig", "leaf").join(names, "exact", "left").select("doc_id", "h", "pos", "n", F.coalesce("template", "exact").alias("template"))


def drops(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = 3, recurs: int = RECURS) -> DataFrame:
    """(doc_id, h, drop): the lines to drop from each document that has any, as positions."""
    ready(docs.sparkSession)
    d = F.xxhash64("h", "doc_id").alias("d")
    known = cut(templates(docs, id_col, text_col, least_words, recurs).withColumn("d", d))
    once = cut(known.groupBy("template", "d").agg(F.max("n").alias("n"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h")).alias("at")))
    common = once.groupBy("template").agg(F.count("*").alias("docs"), F.min("at").alias("first")).where("docs > 1")
    common = common.select("template", F.xxhash64("first.h", "first.doc_id").alias("keeper"))
    words = once.groupBy("d").agg(F.sum("n").alias("words"))
    once = cut(once.drop("at").join(common, "template"))
    # Documents of equal template sets have one mark. A set with a template of its own equals no other.
    own = once.groupBy("d").agg(F.sum("n").alias("again"), F.bit_xor(F.xxhash64("template")).alias("set")).join(words, "d")
    own = cut(own.select("d", "words", F.when(F.col("again") == F.col("words"), F.xxhash64("set", "words")).otherwise(F.col("d")).alias("mark")))
    # What a document shares with the keeper of its lines; for a copy that is nearly all of both.
    shared = once.where("d != keeper").groupBy("d", "keeper").agg(F.sum("n").alias("shared"))
    of = own.select(F.col("d").alias("keeper"), F.col("words").alias("kept"), F.col("mark").alias("copied"))
    near = shared.join(own.select("d", "words"), "d").where(F.col("shared") >= COPY * F.col("words")).join(of, "keeper")
    near = near.where(F.col("shared") >= COPY * (F.col("words") + F.col("kept") - F.col("shared"))).select("d", "copied")
    marks = own.join(near, "d", "left").select("d", F.coalesce("copied", "mark").alias("mark"))
    told = once.select("template", "d", "keeper").join(marks, "d").groupBy("template", "mark").agg(F.min("keeper").alias("keeper"))
    support = told.groupBy("template").agg(F.count("*").alias("support"), F.min("keeper").alias("keeper"))
    dropped = support.where(F.col("support") >= recurs).select("template", "keeper")
    gone = known.join(dropped, "template").where("d != keeper")
    return gone.groupBy("doc_id", "h").agg(F.collect_set("pos").alias("drop"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = 3, recurs: int = RECURS) -> DataFrame:
    """``docs`` with recurring lines gone from the text, and ``n_dropped``: how many (instead of a column of that name)."""
    key, hash_, own, drop = free(docs, "key", "hash", "own", "drop")
    gone = drops(docs, id_col, text_col, least_words, recurs).select(F.col("doc_id").alias(key), F.col("h").alias(hash_), F.col("drop").alias(drop))
    both = docs.withColumn(own, F.xxhash64(text_col)).join(gone.hint("shuffle_hash"), F.col(id_col).cast("long").eqNullSafe(F.col(key)) & (F.col(own) == F.col(hash_)), "left")
    kept = F.array_join(F.filter(F.split(text_col, "\n"), lambda x, i: ~F.array_contains(drop, i)), "\n")
    columns = [F.when(F.col(drop).isNull(), F.col(c)).otherwise(kept).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c != "n_dropped"]
    return both.select(*columns, F.coalesce(F.size(drop), F.lit(0)).alias("n_dropped"))
