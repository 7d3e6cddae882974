"""Packing: bounded-space online packing of tokenised documents into sequences.

Each task keeps at most ``windows`` open sequences. A document gives full
sequences as long as it can; its rest goes to the open sequence it fits best. When
it fits none and all are open, the fullest is filled up with the head of the rest
and emitted. At the end the task merges what is open and cuts the last remainder
into powers of two, which need no padding. Nothing is shuffled; memory is the
open sequences and a bounded cache of words.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import common as C

LENGTH, WINDOWS = 2048, 32
END = np.array([1], "<u4").tobytes()
CACHE = 700_000
#: A blank before white space, or at the end, belongs to a run that the pieces between blanks do not show.
AWKWARD = re.compile(r" (?:\s|\Z)")


@functools.cache
def added_tokens(path: str) -> dict[str, int]:
    """Added tokens of a JSON vocabulary, which are found in texts before anything else; read once per worker."""
    with open(path, encoding="utf-8") as file:
        found = json.load(file)["added_tokens"]
    odd = [t["content"] for t in found if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]
    if odd:
        raise ValueError(f"added tokens that are not matched as they stand: {odd}")
    return {t["content"]: t["id"] for t in found}


class Encoder:
    """Byte-level BPE ids as little-endian 32-bit numbers; ranks and added tokens are those of the JSON vocabulary.

    A text without awkward blanks is a first piece and pieces with one blank
    before them, whose ids do not depend on each other; ids of pieces are kept.
    Texts with an added token are encoded whole. ``added`` is by default that of
    the installed vocabulary, and empty for other ranks.
    """

    def __init__(self, ranks: str | None = None, added: dict[str, int] | None = None) -> None:
        import base64

        import public_tokenizers
        import tiktoken

        with open(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        if added is None:
            added = {} if ranks else added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
        self.added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.bpe = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=added)
        self.encode = self.bpe.encode_ordinary
        self.width = np.zeros(max(table.values()) + 1, np.int64)
        for word, rank in table.items():
            self.width[rank] = len(word)
        self.known: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        special = self.added and self.added.search(text)
        return np.array(self.bpe.encode(text, allowed_special="all") if special else self.encode(text), "<u4").tobytes()

    def learn(self, pieces: list[str]) -> None:
        """Encode new pieces together and part the ids by the bytes they stand for."""
        ids = np.array(self.encode(" " + " ".join(pieces)), "<u4")
        ends = np.cumsum([len(p.encode()) + 1 for p in pieces])
        cut = np.searchsorted(np.cumsum(self.width[ids]), ends) + 1
        raw, start = ids.tobytes(), 0
        for piece, stop in zip(pieces, (4 * cut).tolist(), strict=True):
            self.known[piece] = raw[start:stop]
            start = stop

    def batch(self, texts: list[str]) -> Iterator[bytes]:
        parts = [None if AWKWARD.search(t) or self.added and self.added.search(t) else t.split(" ") for t in texts]
        if len(self.known) > CACHE:
            self.known.clear()
        new = set().union(*(p[1:] for p in parts if p)) - self.known.keys()
        if new:
            self.learn(list(new))
        known = self.known
        for text, part in zip(texts, parts, strict=True):
            yield self.whole(text) if part is None else b"".join([self.whole(part[0]), *map(known.__getitem__, part[1:])])


class Packer:
    """Sequences under way in one task; ``out`` collects finished pieces."""

    def __init__(self, task: int, length: int = LENGTH, windows: int = WINDOWS) -> None:
        self.length, self.windows = length, windows
        self.open: list[tuple[int, list]] = []
        self.next = task << 33
        self.out: list[tuple] = []

    def emit(self, pieces: list) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.out.append((doc, start, n, zlib.crc32(ids), total, self.next, offset))
            offset += n
        self.next += 1

    def add(self, doc: int | None, ids: bytes) -> None:
        total, start, full = len(ids) // 4, 0, self.length
        while total - start >= full:
            self.emit([(doc, start, ids[4 * start: 4 * (start + full)], total)])
            start += full
        while start < total:
            rest = total - start
            fitting = [i for i, (used, _) in enumerate(self.open) if full - used >= rest]
            if fitting:
                at, taken = max(fitting, key=lambda i: self.open[i][0]), rest
            elif len(self.open) < self.windows:
                self.open.append((0, []))
                at, taken = len(self.open) - 1, rest
            else:
                at = max(range(len(self.open)), key=lambda i: self.open[i][0])
                taken = full - self.open[at][0]
            used, pieces = self.open[at]
            pieces.append((doc, start, ids[4 * start: 4 * (start + taken)], total))
            start += taken
            if used + taken == full:
                self.emit(pieces)
                del self.open[at]
            else:
                self.open[at] = (used + taken, pieces)

    def finish(self) -> None:
        """Merge the open sequences; the last remainder goes into sequences of powers of two."""
        pieces = [p for _, held in sorted(self.open, key=lambda w: -w[0]) for p in held]
        left = sum(len(p[2]) // 4 for p in pieces)
        self.open = []
        at = 0
        while left:
            room = min(self.length, 1 << (left.bit_length() - 1))
            left -= room
            out = []
            while room:
                doc, start, ids, total = pieces[at]
                n = min(room, len(ids) // 4)
                out.append((doc, start, ids[: 4 * n], total))
                pieces[at] = (doc, start + n, ids[4 * n:], total)
                room -= n
                at += n == len(ids) // 4
            self.emit(out)


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(docs: DataFrame, length: int = LENGTH, windows: int = WINDOWS, ranks: str | None = None, text: str = "text",
         added: dict[str, int] | None = None) -> DataFrame:
    """One row per piece. ``length`` is a power of two.

    A null or empty text is the end id alone; repeated rows are packed each. An
    empty table gives an empty result; other columns are ignored. ``ranks`` is the
    rank file on the executors, by default that of the installed vocabulary;
    ``added`` are the added tokens of another one.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = None, Packer(TaskContext.get().partitionId(), length, windows)

        def rows() -> pa.RecordBatch:
            out, packer.out = packer.out, []
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(len(NAMES))], names=NAMES)

        for part in C.slices(batches, "text"):
            encoder = encoder or Encoder(ranks, added)
            for doc, ids in zip(part.column("doc_id").to_pylist(), encoder.batch(part.column("text").to_pylist()), strict=True):
                packer.add(doc, ids + END)
            yield rows()
        packer.finish()
        yield rows()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.text_or_empty(text).alias("text")).mapInArrow(
        run, ", ".join(f"{n} long" for n in NAMES))


def query(spark: SparkSession, folder: str) -> DataFrame:
    return pack(C.documents(spark, folder))
