"""Document fingerprints from closed syncmers.

A k-mer of bytes is chosen when the smallest of its inner s-mers lies at its
first or last place. Whether a k-mer is chosen depends on its own bytes alone, so
two texts that share a passage choose the same anchors inside it wherever it
stands. All anchors are kept, with their places; the fingerprint lists the first 40
bits of all their distinct hashes, and likeness compares two such lists.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import common as C

K, S = 12, 5
KEPT = np.uint64(24)  # bits of a hash that a fingerprint leaves out
STARTS, HASHES = pa.list_(pa.int32()), pa.list_(pa.int64())


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of ``width`` values, from running minima of blocks."""
    n = len(values)
    if n < width:
        return values[:0]
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    table = padded.reshape(blocks, width)
    left = np.minimum.accumulate(table, axis=1).ravel()
    right = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1: n])


def anchors(data: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the closed syncmers of a byte string; one of a shorter string as a whole."""
    rolling = C.Rolling(data)
    if len(data) < k:
        ends = np.array([len(data)]) if len(data) else np.empty(0, np.int64)
        return ends * 0, rolling.of(ends * 0, ends)
    inner = rolling.windows(s)
    width = k - s + 1
    low = sliding_min(inner, width)
    starts = np.flatnonzero((inner[: len(low)] == low) | (inner[width - 1:] == low))
    return starts, rolling.of(starts, starts + k)


def sketch(data: bytes, k: int = K, s: int = S) -> np.ndarray:
    """The distinct anchors of a text in order, by the first 40 bits of their hashes."""
    return distinct(anchors(np.frombuffer(data, np.uint8), k, s)[1])


def distinct(hashes: np.ndarray) -> np.ndarray:
    return np.unique(hashes >> KEPT)


def text_of(found: np.ndarray) -> str:
    """Fingerprint of distinct anchors: ten hexadecimal digits each, in order."""
    return found.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of anchors as fingerprints list them.

    Two empty sets are alike, an empty and another one are not.
    """
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def printed(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and hashes of all anchors, and the distinct ones in order."""
    starts, hashes = anchors(np.frombuffer(data, np.uint8))
    return starts.astype(np.int32), C.signed(hashes), distinct(hashes)


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of every row, with all anchors of the text and ``fingerprint``: the operator by itself.

    ``anchor_starts`` are byte positions in order, ``anchor_hashes`` stand beside
    them. Null texts are empty.
    """
    names = [c for c in docs.columns if c not in ("anchor_starts", "anchor_hashes", "fingerprint", "_printed")]
    inner = docs.select(*names, C.text_or_empty(text).alias("_printed"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in C.slices(batches, "_printed"):
            prints = [printed(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in part.column("_printed").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:-1], pa.array([p[0] for p in prints], STARTS), pa.array([p[1] for p in prints], HASHES),
                 pa.array([text_of(p[2]) for p in prints], pa.string())], names=[*names, "anchor_starts", "anchor_hashes", "fingerprint"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema.fields[:-1])
    return inner.mapInArrow(run, f"{schema}, anchor_starts array<int>, anchor_hashes array<bigint>, fingerprint string")


def tree(value: Column, cuts: list[int], low: int = 0) -> Column:
    """How many of ``cuts`` (descending) are at or above ``value``, in log2 comparisons."""
    if not cuts:
        return F.lit(low)
    half = len(cuts) // 2
    return F.when(value <= F.lit(cuts[half]), tree(value, cuts[half + 1:], low + half + 1)).otherwise(tree(value, cuts[:half], low))


def placed(spark: SparkSession, weights: list[int], n: int) -> list[int]:
    """For each part a number whose hash falls into the partition (of n) that has least to do so far, largest parts first."""
    numbers = spark.range(20 * n + 200).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("p")).groupBy("p").agg(F.min("id").alias("id")).collect()
    free = [(0, r["p"], r["id"]) for r in sorted(numbers, key=lambda r: r["p"])]
    heapq.heapify(free)
    out = [0] * len(weights)
    for part in sorted(range(len(weights)), key=lambda i: -weights[i]):
        load, p, number = heapq.heappop(free)
        out[part] = number
        heapq.heappush(free, (load + weights[part] + 1, p, number))
    return out


PARTS = 4  # parts for each partition, so that partitions can be made equal in bytes


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (slot, part, tail, doc_id, text, at, tie): every part in descending doc_id, closed by the first row of the next part.

    Parts are ranges of doc_id between a bounded number of quantiles, and ranges of a
    text hash for null ids, which stand last in the order of that hash; repeated ids
    stand by their text. Parts with equal ``slot`` share a partition; the text is
    shuffled once.
    """
    spark = docs.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    low = -(1 << 63)
    tie = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(0).cast("long")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(low)).alias("at"), F.col("doc_id").cast("long").alias("doc_id"), C.text_or_empty().alias("text"))
    rows = rows.withColumn("tie", tie)
    marks = [i / (PARTS * n) for i in range(1, PARTS * n)]
    known = F.when(F.col("doc_id").isNotNull(), F.col("at"))
    seen = rows.agg(F.percentile_approx(known, marks, 10000).alias("q"), F.count("*").alias("n"), F.count("doc_id").alias("ids")).first()
    cuts = sorted(set(seen["q"] or []), reverse=True)
    nulls = -(-(seen["n"] - seen["ids"]) * PARTS * n // max(seen["n"], 1))
    spread = F.least(F.floor((F.col("tie") / 2.0**64 + 0.5) * nulls), F.lit(max(nulls - 1, 0)))
    rows = rows.withColumn("part", F.when(F.col("doc_id").isNull(), spread + len(cuts) + 1).otherwise(tree(F.col("at"), cuts)).cast("int"))
    heads = rows.groupBy("part").agg(F.max("at").alias("at"), F.min("tie").alias("tie"), F.sum(F.octet_length("text")).alias("size")).orderBy("part").collect()
    if not heads:
        return rows.select(F.lit(0).cast("long").alias("slot"), "part", F.lit(0).alias("tail"), "doc_id", "text", "at", "tie")
    slots = placed(spark, [r["size"] for r in heads], n)
    # What a part is followed by is found by its place in these lists.
    lists = {"at": [], "tie": [], "slot": [], "before": [], "before_slot": []}
    of = {r["part"]: i for i, r in enumerate(heads)}
    for part in range(heads[-1]["part"] + 1):
        i = of.get(part, 0)
        for name, value in zip(lists, (heads[i]["at"], heads[i]["tie"], slots[i], heads[i - 1]["part"], slots[i - 1]), strict=True):
            lists[name].append(value)
    own = {name: F.element_at(F.lit(values).cast("array<long>"), F.col("part") + 1) for name, values in lists.items()}
    here = F.struct(own["slot"].alias("slot"), F.col("part"), F.lit(0).alias("tail"))
    there = F.struct(own["before_slot"].alias("slot"), own["before"].cast("int").alias("part"), F.lit(1).alias("tail"))
    first = (F.col("at") == own["at"]) & (F.col("tie") == own["tie"])
    places = F.when(first, F.array(here, there)).otherwise(F.array(here))
    return rows.select(F.explode(places).alias("p"), "doc_id", "text", "at", "tie").select("p.*", "doc_id", "text", "at", "tie")


KINDS = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
         ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
ALL = [("anchor_starts", STARTS), ("anchor_hashes", HASHES), ("edited_anchor_starts", STARTS), ("edited_anchor_hashes", HASHES)]
RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")
ALL_RESULT = ", anchor_starts array<int>, anchor_hashes array<bigint>, edited_anchor_starts array<int>, edited_anchor_hashes array<bigint>"


def compare(docs: DataFrame, places: bool = True) -> DataFrame:
    """Fingerprint of every text and of its edited text, the likeness of both, and with ``places`` all anchors with their places.

    Null texts are empty; a table of one row has itself as next document; an empty
    table gives an empty result; columns besides doc_id and text are ignored.
    """
    parts = with_next(docs)
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    order = ["part", "tail", F.col("at").desc(), "tie", "text"]
    dealt = parts.repartition(n, "slot").sortWithinPartitions(*order).select("part", "tail", "doc_id", "text")
    schema = pa.schema(KINDS + (ALL if places else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (part, doc_id, text, anchors) of the row that waits for its next one
        for batch in C.slices(batches, "text"):
            out = []
            for part, tail, doc, text in zip(*(batch.column(c).to_pylist() for c in ("part", "tail", "doc_id", "text")), strict=True):
                mark = printed(text.encode()) if not tail or held is not None and held[0] == part else None
                if held is not None and held[0] == part:
                    out.append(row(*held[1:], text, mark, places))
                    held = None
                if not tail:
                    held = (part, doc, text, mark)
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return dealt.mapInArrow(run, RESULT + (ALL_RESULT if places else ""))


def row(doc: int | None, text: str, mark: tuple, following: str, next_mark: tuple, places: bool) -> dict:
    half = len(text) // 2
    edited = (text[: len(text) - half] + following[:half]).encode()
    other = printed(edited)
    found = {
        "doc_id": doc, "n_chars": len(text), "edited_sha256": hashlib.sha256(edited).hexdigest(), "fingerprint": text_of(mark[2]),
        "edited_fingerprint": text_of(other[2]), "near_edited": likeness(mark[2], other[2]), "near_next": likeness(mark[2], next_mark[2])}
    if places:
        found |= {"anchor_starts": mark[0], "anchor_hashes": mark[1], "edited_anchor_starts": other[0], "edited_anchor_hashes": other[1]}
    return found


def query(spark: SparkSession, folder: str) -> DataFrame:
    return compare(C.documents(spark, folder), places=False)
