"""Harmonic packing of tokenised documents into sequences of one capacity.

A document's ids are cut into pieces whose lengths fill reciprocal classes: class k takes lengths of
which exactly k fit into a sequence, and its bins take k pieces each. Whole sequences are cut off
first; what is left stays in one piece if k like it would waste at most a share ``WASTE`` of a
sequence, else the largest part of the form ``capacity // j`` is cut off. The cuts depend on the
document's length alone. Very short pieces share one class that is filled one after another.

Each task packs its own rows, class by class, and streams finished bins out, so nothing is shuffled
and a task holds only its unfinished bins: at most k - 1 pieces for each class. When its input
ends, those few pieces are placed largest first into common bins.

Defined results: a null or empty text is its end id alone; repeated rows are packed as often as they
occur; a null id is carried along; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from reelspark.session import ready

CAPACITY = 2048
END_ID = 1
WASTE = 1 / 32
#: Pieces of at most a sequence's 64th share one class.
SMALL = 64
#: The pattern that parts a text before merges; its letters and numbers are those letters and numbers of any script.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: White space in one run that the ranks' pattern takes; it fails near a million.
RUN = 100_000
SPACES = re.compile(r"\s+")


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the rest 256 and up in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Token ids of a text as little-endian 32-bit bytes.

    The file's vocabulary is a byte-level one whose ids are the order of its merges, so its merges
    can be applied by ranks, which is several times faster. The file's own tokenizer takes the texts
    that hold one of its special tokens or a run of white space of more than ``RUN`` characters.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = {x.content for x in self.tokenizer.get_added_tokens_decoder().values()}
        byte = _byte_of()
        ranks = {bytes(byte[c] for c in word): k for word, k in self.tokenizer.get_vocab(with_added_tokens=False).items() if word not in added}
        self.special = sorted(added)
        self.encode = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ids(self, text: str) -> bytes:
        if any(x in text for x in self.special) or len(text) > RUN and any(m.end() - m.start() > RUN for m in SPACES.finditer(text)):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return array("I", self.encode(text)).tobytes()


def cuts(length: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of a document of ``length`` ids."""
    out, rest = [capacity] * (length // capacity), length % capacity
    while rest:
        k = capacity // rest
        if k >= SMALL or k * rest >= capacity * (1 - WASTE):
            out.append(rest)
            break
        out.append(capacity // (k + 1))
        rest -= out[-1]
    return out


class Bins:
    """The bins of one task. Pieces come back with a bin number and an offset once their bin is full."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity, self.open, self.used, self.n = capacity, {}, 0, 0

    def _close(self, pieces: list[tuple]) -> Iterator[tuple]:
        at = 0
        for piece in pieces:
            yield (*piece, self.n, at)
            at += piece[2]
        self.n += 1

    def add(self, piece: tuple) -> Iterator[tuple]:
        """piece: (id, start, length, ...)."""
        k = min(self.capacity // piece[2], SMALL)
        bin_ = self.open.setdefault(k, [])
        if k == SMALL:
            if self.used + piece[2] > self.capacity:
                yield from self._close(bin_)
                self.open[k], bin_, self.used = (new := []), new, 0
            self.used += piece[2]
            bin_.append(piece)
            return
        bin_.append(piece)
        if len(bin_) == k:
            yield from self._close(self.open.pop(k))

    def rest(self) -> Iterator[tuple]:
        bins: list[list] = []
        for piece in sorted((p for b in self.open.values() for p in b), key=lambda p: -p[2]):
            bin_ = next((b for b in bins if b[0] + piece[2] <= self.capacity), None)
            if bin_ is None:
                bins.append(bin_ := [0, []])
            bin_[0] += piece[2]
            bin_[1].append(piece)
        self.open, self.used = {}, 0
        for _, pieces in bins:
            yield from self._close(pieces)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece, with its place in a sequence, as the module says. ``tokenizer``: path of its file."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, bins, out = None, Bins(capacity), []
        base = TaskContext.get().partitionId() << 40

        def batch_of() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (*cols[:5], [base + n for n in cols[5]], cols[6])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            encoder = encoder or Encoder(tokenizer)
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = memoryview(encoder.ids(text.as_py() or "") + END_ID.to_bytes(4, "little"))
                key, total, at = key.as_py(), len(ids) // 4, 0
                for n in cuts(total, capacity):
                    out += bins.add((key, at, n, zlib.crc32(ids[4 * at : 4 * (at + n)]), total))
                    at += n
                if len(out) > 20_000:
                    yield batch_of()
        out += bins.rest()
        if out:
            yield batch_of()

    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text_col}` text").mapInArrow(run, SCHEMA)
