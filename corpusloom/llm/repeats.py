"""Exact removal of repeated 400-byte strings by a prefix-free parse and suffix arrays.

A trigger is a place whose rolling hash is the smallest among all places of some
400-byte string; it belongs to the *phrase* of all string starts it is smallest
for. Triggers depend on the bytes around them alone, so equal strings lie at the
same distance from equal triggers, and only phrases with equal triggers need be
compared: one row per phrase, not per byte, is shuffled.

1. Parse: every text becomes phrases; a phrase with the bytes its strings reach is
   a dictionary entry. An entry that occurs twice is repeated as a whole; a trigger
   that occurs once has nothing repeated.
2. What is left lies at the edges of repeated passages: entries of their own whose
   trigger occurs elsewhere. These entries, and one copy of each repeated entry
   with the same trigger, meet in one group per trigger, where a suffix array to
   a depth of 400 bytes puts their strings into corpus order; neighbours that
   share 400 bytes are repeated. Triggers with very many entries are settled
   by counting the hashes of their strings instead, which no group holds at once.
3. Each text drops the bytes covered by repeated strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.scale import cut
from corpusloom.llm import common as C
from corpusloom.llm.syncmers import sliding_min

MATCH, TRIGGER = 400, 64
#: Occurrences of a trigger up to which its entries are sorted in one group: an entry has at
#: most 2 * MATCH - TRIGGER bytes, so a group at most 6 MB.
GROUP = 8000
SORT_BYTES = 1 << 20
LOW32 = np.uint64(0xFFFFFFFF)


def parse(data: np.ndarray, offsets: np.ndarray, match: int = MATCH, width: int = TRIGGER) -> tuple[np.ndarray, ...]:
    """Phrases of a slice of texts: text number, first and last string start, trigger place, trigger, entry.

    Of equal smallest hashes the rightmost is the trigger. Texts shorter than
    ``match`` bytes have no phrases.
    """
    rolling = C.Rolling(data)
    hashes = rolling.windows(width)
    key = (hashes & ~LOW32) | (LOW32 - np.arange(len(hashes), dtype=np.uint64))
    least = (LOW32 - (sliding_min(key, match - width + 1) & LOW32)).astype(np.int64)
    start = np.arange(len(least))
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(least)]
    inside = start + match <= offsets[doc + 1]
    start, least, doc = start[inside], least[inside], doc[inside]
    new = np.flatnonzero(np.append(True, (least[1:] != least[:-1]) | (doc[1:] != doc[:-1]))) if len(start) else start
    lo, hi, at = start[new], start[np.append(new[1:], len(start)) - 1] if len(new) else start, least[new]
    trigger = hashes[at]
    entry = C.mixed(rolling.of(lo, hi + match) ^ C.mixed(trigger + (at - lo).astype(np.uint64)))
    return doc[new], lo, hi, at, trigger, entry


PARSED = pa.schema([
    ("doc_id", pa.int64()), ("doc", pa.int64()), ("tag", pa.int64()), ("n_bytes", pa.int64()), ("sha", pa.string()),
    ("trigger", pa.list_(pa.int64())), ("entry", pa.list_(pa.int64())), ("at", pa.list_(pa.int32())), ("lo", pa.list_(pa.int32())),
    ("hi", pa.list_(pa.int32()))])


def keyed(docs: DataFrame, text: str) -> DataFrame:
    """A row is known by its id and a hash of its text; rows with both equal are equal."""
    body = C.text_or_empty(text)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"),
        F.xxhash64(body).alias("tag"), body.alias("text"))


def phrases(rows: DataFrame, match: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in C.slices(batches, "text"):
            data, offsets = C.text_bytes(part.column("text"))
            doc, lo, hi, at, trigger, entry = parse(data, offsets, match)
            ends = np.searchsorted(doc, np.arange(len(offsets))).astype(np.int32)
            base = offsets[doc]
            raw = data.tobytes()
            sha = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]

            def lists(values: np.ndarray, ends: np.ndarray = ends) -> pa.Array:
                return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))

            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), part.column("doc"), part.column("tag"), pa.array(np.diff(offsets)), pa.array(sha, pa.string()),
                lists(C.signed(trigger)), lists(C.signed(entry)), *(lists((x - base).astype(np.int32)) for x in (at, lo, hi))], schema=PARSED)

    return rows.mapInArrow(run, "doc_id long, doc long, tag long, n_bytes long, sha string, trigger array<long>, entry array<long>, "
                                "at array<int>, lo array<int>, hi array<int>")


def judged(parsed: DataFrame) -> DataFrame:
    """Phrases with a trigger that occurs twice: (doc, tag, trigger, lo, hi, kind); ``rows`` is how many rows a text stands for.

    kind 1: repeated as a whole; 2: so, and one copy is compared with single entries;
    3: a single entry. 10 is added where the trigger has too many occurrences for one group.
    """
    single = parsed.select("doc", "tag", "rows", F.explode(F.arrays_zip("trigger", "entry", "at", "lo", "hi")).alias("p")).select("doc", "tag", "rows", "p.*")
    triggers = single.groupBy("trigger").agg(F.sum("rows").alias("met"), F.min("entry").alias("e1"), F.max("entry").alias("e2")).filter("met > 1").select(
        "trigger", (F.col("e1") != F.col("e2")).alias("torn"), (F.col("met") > GROUP).alias("many"))
    flagged = cut(single.join(triggers, "trigger"))
    torn = flagged.filter("torn")
    entries = torn.groupBy("trigger", "entry").agg(F.sum("rows").alias("n"), F.min(F.struct("doc", "tag", "at")).alias("first"))
    kind = F.when(F.col("n") == 1, 3).when(F.col("first") == F.struct("doc", "tag", "at"), 2).otherwise(1) + F.when(F.col("many"), 10).otherwise(0)
    out = ["doc", "tag", "trigger", "lo", "hi"]
    return torn.join(entries, ["trigger", "entry"]).select(*out, kind.alias("kind")).union(flagged.filter("not torn").select(*out, F.lit(1)))


def open_strings(marked: DataFrame, match: int) -> DataFrame:
    """Entries to compare: (trigger, doc, tag, lo, n, need, body) or, where there are many, one hash per string."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in C.slices(batches, "text"):
            data, offsets = C.text_bytes(part.column("text"))
            rows: list[tuple] = []
            for doc, tag, marks, base in zip(*(part.column(c).to_pylist() for c in ("doc", "tag", "marks")), offsets, strict=False):
                for m in marks:
                    kind, lo, hi = m["kind"], m["lo"], m["hi"]
                    body = data[base + lo: base + hi + match]
                    if kind in (2, 3):
                        rows.append((m["trigger"], doc, tag, lo, hi - lo + 1, kind == 3, body.tobytes(), None))
                    elif kind in (12, 13):
                        strings = C.signed(C.Rolling(body).windows(match)).tolist()
                        rows += [(m["trigger"], doc, tag, lo + i, 1, kind == 13, None, h) for i, h in enumerate(strings)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(OPEN)], schema=OPEN)

    return marked.select("doc", "tag", "text", "marks").mapInArrow(
        run, "trigger long, doc long, tag long, lo int, n int, need boolean, body binary, string long")


OPEN = pa.schema([
    ("trigger", pa.int64()), ("doc", pa.int64()), ("tag", pa.int64()), ("lo", pa.int32()), ("n", pa.int32()), ("need", pa.bool_()),
    ("body", pa.binary()), ("string", pa.int64())])


def suffix_ranks(data: np.ndarray, depth: int) -> np.ndarray:
    """Rank of every suffix by its first ``depth`` bytes, by prefix doubling from eight bytes on; equal prefixes share a rank.

    Bytes past the end count as zero: only suffixes of at least ``depth`` bytes may be compared.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | padded[i: i + n]
    reach = 8
    while True:
        order = np.argsort(key)
        placed = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.append(False, placed[1:] != placed[:-1])).astype(np.uint64)
        if reach >= depth:
            return rank
        step = min(reach, depth - reach)
        after = np.zeros(n, np.uint64)
        after[: n - step] = rank[step:]
        key = (rank << np.uint64(32)) | after
        reach += step


def sorted_strings(rows: DataFrame, match: int) -> DataFrame:
    """(doc, tag, lo, hi) of the strings that have an equal among the entries of their trigger."""
    def settle(table: pa.Table) -> Iterator[pa.RecordBatch]:
        body = table.column("body").combine_chunks().cast(pa.binary())
        data, offsets = C.text_bytes(body)
        count = np.array(table.column("n"))
        first = np.concatenate([[0], np.cumsum(count)])
        row = np.repeat(np.arange(len(count)), count)
        start = np.arange(first[-1]) - first[row] + offsets[row]
        ranks = suffix_ranks(data, match)[start]
        order = np.argsort(ranks, kind="stable")  # the strings in corpus order
        same = ranks[order[1:]] == ranks[order[:-1]]
        equal = np.zeros(len(start), bool)
        equal[order[1:]] = same
        equal[order[:-1]] |= same
        hit = np.flatnonzero(equal & np.array(table.column("need"))[row])
        ends = np.flatnonzero(np.append(True, (np.diff(hit) > 1) | (row[hit][1:] != row[hit][:-1]))) if len(hit) else hit
        lo = hit[ends]
        hi = hit[np.append(ends[1:], len(hit)) - 1] if len(hit) else hit
        r = row[lo]
        base = np.array(table.column("lo"))[r] - first[r]
        yield pa.RecordBatch.from_arrays([
            table.column("doc").combine_chunks().take(pa.array(r)), table.column("tag").combine_chunks().take(pa.array(r)),
            pa.array((lo + base).astype(np.int32)), pa.array((hi + base).astype(np.int32))], names=["doc", "tag", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for part in C.slices(batches, "body", SORT_BYTES // 4):
            held.append(part)
            size += int(C.lengths(part.column("body")).sum())
            if size >= SORT_BYTES:
                table = pa.Table.from_batches(held).combine_chunks()
                trigger = np.array(table.column("trigger"))
                whole = int(np.searchsorted(trigger, trigger[-1]))  # the last trigger may go on
                if whole:
                    yield from settle(table.slice(0, whole))
                    held = table.slice(whole).to_batches()
                    size = sum(int(C.lengths(b.column("body")).sum()) for b in held)
        if held:
            yield from settle(pa.Table.from_batches(held).combine_chunks())

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select("trigger", "doc", "tag", "lo", "n", "need", "body").repartition(n, "trigger").sortWithinPartitions("trigger").mapInArrow(
        run, "doc long, tag long, lo int, hi int")


DROPPED = "doc long, tag long, n_removed long, n_spans long, kept_sha string, kept_text string"


def dropped(marked: DataFrame, match: int, with_text: bool) -> DataFrame:
    """(doc, tag, n_removed, n_spans, kept_sha, kept_text) of texts with repeated strings."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in C.slices(batches, "text"):
            data, offsets = C.text_bytes(part.column("text"))
            out = []
            columns = (part.column(c).to_pylist() for c in ("doc", "tag", "marks", "hits"))
            for i, (doc, tag, marks, hits) in enumerate(zip(*columns, strict=True)):
                text = data[offsets[i]: offsets[i + 1]]
                edge = np.zeros(len(text) + 1, np.int64)
                spans = [(m["lo"], m["hi"]) for m in marks if m["kind"] % 10 != 3] + [(h["lo"], h["hi"]) for h in hits or []]
                for lo, hi in spans:
                    edge[lo] += 1
                    edge[hi + match] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                left = text[~gone].tobytes()
                runs = int(gone[:1].sum() + np.count_nonzero(gone[1:] & ~gone[:-1]))
                out.append((doc, tag, int(gone.sum()), runs, hashlib.sha256(left).hexdigest(), left.decode(errors="replace") if with_text else None))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["doc", "tag", "n_removed", "n_spans", "kept_sha", "kept_text"])

    return marked.select("doc", "tag", "text", "marks", "hits").mapInArrow(run, DROPPED)


def remove(docs: DataFrame, match: int = MATCH, text: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept_text on demand) of every row.

    A byte goes when a string of ``match`` bytes over it starts anywhere else, in
    this text or another; bytes cut inside a character are replaced in kept_text.
    Null and empty texts, and texts shorter than ``match`` bytes, lose nothing.
    Repeated rows are repeated texts: those long enough lose everything, and one of
    them stands for all in the comparison with others. An empty table gives an empty
    result; other columns are ignored.
    """
    rows = keyed(docs, text)
    parsed = C.written(phrases(rows, match), "parsed")
    key = ["doc", "tag"]
    again = cut(parsed.filter(F.col("n_bytes") >= match).groupBy(*key).agg(F.count("*").alias("rows")).filter("rows > 1"))
    units, texts = parsed.withColumn("rows", F.lit(1).cast("long")), rows.select(*key, "text")
    repeated = not again.isEmpty()
    if repeated:  # one row for each of them, with a count
        names = ["trigger", "entry", "at", "lo", "hi"]
        same = parsed.join(again, key).groupBy(*key, "rows").agg(*[F.first(c).alias(c) for c in names])
        units = units.select(*key, "rows", *names).join(again, key, "left_anti").unionByName(same)
        one = texts.join(again, key, "left_semi").groupBy(*key).agg(F.first("text").alias("text"))
        texts = texts.join(again, key, "left_anti").unionByName(one)
    mark = F.struct("trigger", "lo", "hi", "kind")
    marks = judged(units).groupBy(*key).agg(F.collect_list(mark).alias("marks"))
    marked = C.written(texts.join(marks, key), "marked")
    rest = cut(open_strings(marked.filter(F.exists("marks", lambda m: m["kind"].isin(2, 3, 12, 13))), match))
    many = rest.filter("body is null")
    twice = many.groupBy("trigger", "string").count().filter("count > 1").select("trigger", "string")
    hits = sorted_strings(rest.filter("body is not null"), match).union(
        many.filter("need").join(twice, ["trigger", "string"]).select(*key, "lo", F.col("lo").alias("hi")))
    hits = hits.groupBy(*key).agg(F.collect_list(F.struct("lo", "hi")).alias("hits"))
    found = dropped(marked.join(hits, key, "left"), match, with_text)
    whole = parsed.select("doc_id", *key, "n_bytes", "sha")
    if with_text:
        whole = whole.join(texts.groupBy(*key).agg(F.first("text").alias("text")), key)

    def told(rows: DataFrame) -> DataFrame:
        return rows.select(
            "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
            F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha", "sha").alias("kept_sha256"),
            *([F.coalesce("kept_text", "text").alias("kept_text")] if with_text else []))

    if not repeated:
        return told(whole.join(found, key, "left"))
    gone = {"n_removed": F.col("n_bytes"), "n_spans": F.lit(1), "kept_sha": F.lit(hashlib.sha256(b"").hexdigest()), "kept_text": F.lit("")}
    return told(whole.join(again, key, "left_anti").join(found, key, "left")).union(told(whole.join(again, key, "left_semi").withColumns(gone)))


def query(spark: SparkSession, folder: str) -> DataFrame:
    return remove(C.documents(spark, folder))
