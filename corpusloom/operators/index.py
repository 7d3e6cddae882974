"""A stored inverted index over chunks, with block maxima, membership bitmaps, upserts and deletes.

An index is a folder of immutable Parquet tables. A *segment* deals its chunks by a hash
to shards of some thousand; inside a shard chunks are numbered by length, and a term's
postings are cut into windows of 16 numbers. One row per (shard, field, term) holds which
windows have postings, their bytes, and the largest frequency and least length of each,
from which no score in the window can be larger than a bound. Deleted and replaced
chunks are rows of *dead* tables; a *version* names the segments and dead tables that
count, and is written last, so a broken write leaves the former version in place.

A batch of queries is dealt to blocks; each (shard, block) is one group that holds the
postings of the block's terms in that shard, so neither queries nor texts pass through
the driver, and no group grows with the corpus. Filters are ANDed as bitmaps before
anything is ranked.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import expr as X
from corpusloom.functions.scale import broadcast_checked, cut, top_per_key
from corpusloom.operators.retrieve import B, IDF_FLOOR, K1, TITLE_WEIGHT, by_score, filters_of, members_of, query_terms

SHARD, WINDOW, QUERIES, BUCKETS = 16384, 16, 32, 16
#: Query terms that are looked up by a pushed filter; more are joined.
FILTERED = 8000
FORWARD = -1  # the bucket of forward rows
FIELDS = {"text": 1.0, "title": TITLE_WEIGHT}
#: Shards that one task writes, a file per term bucket, and groups (shards times blocks) that one task searches, on average.
TOGETHER, SEARCHED = 8, 4
NO_DAY = -(1 << 31)

POSTINGS = "seg string, shard int, field string, term string, bucket int, n int, windows binary, starts binary, max_tf binary, min_dl binary, places binary, tfs binary"
DOCS = "seg string, shard int, place int, chunk_id string, document_id string, day int, doc_type string, dl int, title_dl int, terms array<string>, tf_counts array<int>, title_terms array<string>, title_tfs array<int>"
COLUMNS = [x.split()[0] for x in DOCS.split(", ")]


def tokens(chunks: DataFrame) -> DataFrame:
    """Forward rows of chunks (chunk_id, document_id, text, and where known title, day, doc_type): terms with their counts.

    Null texts have no terms; a null title is no title.
    """
    for name, kind in (("title", "string"), ("day", "int"), ("doc_type", "string"), ("document_id", "string")):
        if name not in chunks.columns:
            chunks = chunks.withColumn(name, F.lit(None).cast(kind))
    return chunks.select(
        "chunk_id", "document_id", F.col("day").cast("int").alias("day"), "doc_type",
        F.coalesce(X.search_terms(F.col("text")), F.array().cast("array<string>")).alias("terms"), X.search_terms(F.col("title")).alias("title_terms"))


class Index:
    """One version of an index folder."""

    def __init__(self, spark: SparkSession, path: str, segments: list[str], dead: list[str], version: int) -> None:
        self.spark, self.path, self.segments, self.dead, self.version = spark, path, segments, dead, version

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Index:
        """The newest version in the folder."""
        rows = spark.read.schema("segments array<string>, dead array<string>, version int").parquet(f"{path}/versions/*")
        last = rows.orderBy(F.col("version").desc()).first()
        return cls(spark, path, list(last["segments"]), list(last["dead"]), last["version"])

    @classmethod
    def build(cls, chunks: DataFrame, path: str, shard: int = SHARD) -> Index:
        """A new index over ``chunks`` with one segment."""
        spark = chunks.sparkSession
        return cls(spark, path, [], [], 0)._commit([write_segment(counted(tokens(chunks)), chunks.count(), path, shard)], [])

    def _commit(self, segments: list[str], dead: list[str]) -> Index:
        segments = [s for s in segments if s]
        row = [(segments, dead, self.version + 1)]
        made = self.spark.createDataFrame(row, "segments array<string>, dead array<string>, version int")
        made.coalesce(1).write.parquet(f"{self.path}/versions/{self.version + 1}")
        return Index(self.spark, self.path, segments, dead, self.version + 1)

    # -- tables ------------------------------------------------------------
    def docs(self) -> DataFrame:
        """Forward rows of all segments; they lie in a bucket of their own."""
        parts = [self._of(s, DOCS, f"/bucket={FORWARD}") for s in self.segments]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], DOCS)

    def postings(self) -> DataFrame:
        parts = [self._of(s, POSTINGS).filter(F.col("bucket") != FORWARD) for s in self.segments]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], POSTINGS)

    def _of(self, seg: str, columns: str, folder: str = "") -> DataFrame:
        """Rows of one segment; its name is that of its folder and not written with every row."""
        rows = self.spark.read.schema(columns.removeprefix("seg string, ")).parquet(f"{self.path}/{seg}{folder}")
        return rows.select(F.lit(seg).alias("seg"), "*")

    def dead_docs(self) -> DataFrame:
        paths = [f"{self.path}/{d}" for d in self.dead]
        return self.spark.read.schema(DOCS).parquet(*paths) if paths else self.spark.createDataFrame([], DOCS)

    def live(self) -> DataFrame:
        """Forward rows of all chunks that count."""
        return self.docs().join(self.dead_docs().select("seg", "shard", "place"), ["seg", "shard", "place"], "left_anti") if self.dead else self.docs()

    # -- changes -----------------------------------------------------------
    def upsert(self, chunks: DataFrame, shard: int = SHARD) -> Index:
        """Chunks replace those with their ids; new ids are added. One more segment and one more dead table."""
        ready = cut(tokens(chunks))
        dead = self._write_dead(ready.select("chunk_id"))
        return self._commit([*self.segments, write_segment(counted(ready), ready.count(), self.path, shard)], [*self.dead, dead])

    def delete(self, ids: DataFrame) -> Index:
        """Chunks with these ids (chunk_id) count no more; unknown ids change nothing."""
        return self._commit(self.segments, [*self.dead, self._write_dead(ids.select("chunk_id"))])

    def _write_dead(self, ids: DataFrame) -> str:
        name = f"dead-{uuid.uuid4().hex}"
        self.live().join(broadcast_checked(ids.distinct()), "chunk_id", "left_semi").select(*COLUMNS).write.parquet(f"{self.path}/{name}")
        return name

    def merge(self, shard: int = SHARD) -> Index:
        """One segment of all live chunks, made from forward rows; no text is cut into terms again."""
        rows = self.live()
        return self._commit([write_segment(rows.drop("seg", "shard", "place"), rows.select("chunk_id").count(), self.path, shard)], [])

    # -- statistics --------------------------------------------------------
    def statistics(self, terms: DataFrame, posted: DataFrame | None = None) -> DataFrame:
        """(field, term, df, n, mean) of the wanted terms among live chunks; ``terms`` has a column term.

        ``posted``: their postings, where the caller has narrowed them down.
        """
        wanted = terms.select("term").distinct()
        few = broadcast_checked(wanted) if posted is None or self.dead else None
        found = (self.postings().join(few, "term") if posted is None else posted).groupBy("field", "term").agg(F.sum("n").alias("df"))
        totals = [self._totals(self.docs(), 1)]
        if self.dead:
            gone = self.dead_docs()
            totals.append(self._totals(gone, -1))
            for field, column in (("text", "terms"), ("title", "title_terms")):
                spread = X.unfold(gone, [], F.col(column), "term").join(few, "term").groupBy("term").agg((-F.count("*")).alias("df"))
                found = found.unionByName(spread.select(F.lit(field).alias("field"), "term", "df"))
            found = found.groupBy("field", "term").agg(F.sum("df").alias("df")).filter("df > 0")
        total = reduce(DataFrame.unionByName, totals).groupBy("field").agg(F.sum("n").alias("n"), F.sum("length").alias("length"))
        mean = F.when((F.col("n") > 0) & (F.col("length") > 0), F.col("length") / F.col("n")).otherwise(1.0).alias("mean")
        return found.join(F.broadcast(total.select("field", "n", mean)), "field")

    @staticmethod
    def _totals(docs: DataFrame, sign: int) -> DataFrame:
        """Chunks and terms of each field; two rows."""
        both = docs.agg(
            F.count("*").alias("a"), F.coalesce(F.sum("dl"), F.lit(0)).alias("b"), F.count("title_dl").alias("c"), F.coalesce(F.sum("title_dl"), F.lit(0)).alias("d"))
        rows = F.explode(F.array(
            F.struct(F.lit("text").alias("field"), F.col("a").alias("n"), F.col("b").alias("length")),
            F.struct(F.lit("title").alias("field"), F.col("c").alias("n"), F.col("d").alias("length"))))
        return both.select(rows.alias("r")).select("r.field", (F.col("r.n") * sign).alias("n"), (F.col("r.length") * sign).alias("length"))

    # -- search ------------------------------------------------------------
    def topk(self, queries: DataFrame, k: int, sources: DataFrame | None = None) -> DataFrame:
        """(qid, chunk_id, score, rank): the k best chunks of every query among those that pass its filters.

        ``queries``: qid, text and where asked notebook_id, source_ids, doc_types,
        date_after, date_before. ``sources``: source_id, notebook_id, document_id, needed
        where a query names notebooks or sources. Statistics stay corpus-wide.
        """
        return top_per_key(self._rows(queries, k, None, sources).drop("title_match"), ["qid"], by_score(), k)

    def titled(self, queries: DataFrame, k: int, sources: DataFrame | None = None, tier: bool = True) -> DataFrame:
        """(qid, chunk_id, score, title_match): at least the k best of text and title.

        The score is the better of both; with ``tier`` title matches come before all others.
        """
        return self._rows(queries, k, tier, sources)

    def blocks(self, queries: DataFrame, k: int, sources: DataFrame | None = None) -> DataFrame:
        """(blocks_read, blocks) of ``topk``, summed over all queries and shards."""
        return self._groups(queries, k, None, sources).agg(F.sum("blocks_read").alias("blocks_read"), F.sum("blocks").alias("blocks"))

    def _rows(self, queries: DataFrame, k: int, titles: bool | None, sources: DataFrame | None) -> DataFrame:
        found = self._groups(queries, k, titles, sources).filter("chunk_id is not null")
        return found.select("qid", "chunk_id", X.rounded(F.col("score")).alias("score"), "title_match")

    def _groups(self, queries: DataFrame, k: int, titles: bool | None, sources: DataFrame | None) -> DataFrame:
        spark = self.spark
        terms = query_terms(queries).withColumn("bucket", _bucket(F.col("term")))
        head = terms.limit(FILTERED + 1).collect()
        if len(head) <= FILTERED:
            terms, n = spark.createDataFrame(head, terms.schema), len({r["qid"] for r in head})
            few = {r["term"] for r in head}
            posted = self.postings().filter(F.col("bucket").isin(list({r["bucket"] for r in head})))
            if len(few) <= 64:  # a pushed filter reads the row groups of these terms only
                posted = posted.filter(F.col("term").isin(list(few)))
            else:
                posted = posted.join(F.broadcast(terms.select("term").distinct()), "term", "left_semi")
            statistics = self.statistics(terms, posted)
        else:
            terms = cut(terms)
            n, posted = terms.select("qid").distinct().count(), self.postings().join(broadcast_checked(terms.select("term").distinct()), "term")
            statistics = broadcast_checked(self.statistics(terms))
        idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(IDF_FLOOR))
        weighted = terms.join(statistics, "term").select("qid", "field", "term", (idf * F.col("qtf")).alias("w"), "mean")
        if titles is None:
            weighted, posted = weighted.filter("field = 'text'"), posted.filter("field = 'text'")
        member = F.struct("field", "term", "w", "mean")
        asked = weighted.groupBy("qid").agg(F.collect_list(member).alias("terms")).join(filters_of(queries, sources), "qid")
        blocks = max(1, -(-n // QUERIES))
        asked = cut(asked.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int")))
        wanted = asked.select("block", F.explode("terms").alias("t")).select("block", "t.field", "t.term").distinct()
        posted = posted.withColumn("block", F.lit(0)) if blocks == 1 else posted.join(wanted, ["field", "term"])
        group = "array<struct<qid:bigint,after:int,before:int,kinds:array<string>,keys:array<string>,terms:array<struct<field:string,term:string,w:double,mean:double>>>>"
        blank = {"name": "string", "field": "string", "n": "int", "windows": "binary", "starts": "binary", "max_tf": "binary", "min_dl": "binary", "places": "binary",
                 "tfs": "binary", "ids": "array<string>", "lens": "array<int>", "title_lens": "array<int>", "days": "array<int>", "types": "array<string>", "asked": group}

        def filled(df: DataFrame, kind: int) -> DataFrame:
            return df.select("seg", "shard", "block", F.lit(kind).alias("kind"), *[
                F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in blank.items()])

        one = F.struct("place", "chunk_id", "dl", "title_dl", "day", "doc_type")
        shards = self.docs().groupBy("seg", "shard").agg(F.array_sort(F.collect_list(one)).alias("d"))  # a shard is bounded
        # What no query asks for is not sent to the groups.
        days = F.transform("d", lambda x: F.coalesce(x["day"], F.lit(NO_DAY))) if {"date_after", "date_before"} & {*queries.columns} else F.lit(None)
        title_lens = F.lit(None) if titles is None else F.transform("d", lambda x: F.coalesce(x["title_dl"], F.lit(-1)))
        types = F.col("d.doc_type") if "doc_types" in queries.columns else F.lit(None)
        shards = shards.select(
            "seg", "shard", F.col("d.chunk_id").alias("ids"), F.col("d.dl").alias("lens"), title_lens.alias("title_lens"), days.alias("days"), types.alias("types"))
        block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
        places = [_shards_of(seg) for seg in self.segments] or [F.array().cast("array<struct<seg:string,shard:int>>")]
        member = F.struct("qid", "after", "before", "kinds", "keys", "terms")
        batches = asked.groupBy("block").agg(F.collect_list(member).alias("asked"))
        everywhere = batches.select("block", "asked", F.explode(F.concat(*places)).alias("p")).select("p.*", "block", "asked")
        parts = [filled(shards.select("*", block), 0), filled(posted.withColumn("name", F.col("term")), 1), filled(everywhere, 2)]
        if sources is not None:
            parts.append(filled(self._members(asked, sources), 3))
        if self.dead:
            gone = self.dead_docs().groupBy("seg", "shard").agg(F.collect_list("place").alias("lens"))
            parts.append(filled(gone.select("*", block), 4))
        rows = reduce(DataFrame.unionByName, parts)
        schema = "qid long, chunk_id string, score double, title_match int, blocks_read long, blocks long"
        groups = blocks * sum(_count_of(seg) for seg in self.segments)
        tasks = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism, -(-groups // SEARCHED))

        def search(table: pa.Table) -> pa.Table:
            return search_shard(table, k, titles)

        return rows.repartition(tasks, "seg", "shard", "block").groupBy("seg", "shard", "block").applyInArrow(search, schema)

    def _members(self, asked: DataFrame, sources: DataFrame) -> DataFrame:
        """Bitmaps (seg, shard, block, name, n, places) of the notebooks and sources that the queries name."""
        wanted = broadcast_checked(asked.filter("keys is not null").select("block", F.explode("keys").alias("name")).distinct())
        rows = members_of(sources).join(wanted, "name").select("block", "name", "document_id").distinct()
        placed = self.docs().select("seg", "shard", "place", "document_id").join(rows, "document_id")
        return placed.groupBy("seg", "shard", "block", "name").agg(F.bitmap_construct_agg(F.col("place").cast("long")).alias("places"))


def _shards_of(seg: str) -> Column:
    """All shards of a segment."""
    return F.transform(F.sequence(F.lit(0), F.lit(_count_of(seg) - 1)), lambda x: F.struct(F.lit(seg).alias("seg"), x.alias("shard")))


def _count_of(seg: str) -> int:
    """The number of shards of a segment ends its name."""
    return int(seg.rpartition("-")[2])


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


# -- writing ---------------------------------------------------------------
def counted(rows: DataFrame) -> DataFrame:
    """Terms of forward rows with their counts, each once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c) for c in ("chunk_id", "document_id", "day", "doc_type")]
            for name in ("terms", "title_terms"):
                terms, tfs, total = unique_terms(batch.column(name))
                columns += [total, terms, tfs]
            yield pa.RecordBatch.from_arrays(columns, names=["chunk_id", "document_id", "day", "doc_type", "dl", "terms", "tf_counts", "title_dl", "title_terms", "title_tfs"])

    return rows.mapInArrow(
        run, "chunk_id string, document_id string, day int, doc_type string, dl int, terms array<string>, tf_counts array<int>, "
             "title_dl int, title_terms array<string>, title_tfs array<int>")


def unique_terms(lists: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Distinct terms of each list, their counts, and the length of the list (null for a null list)."""
    flat = lists.flatten().dictionary_encode()
    sizes = np.nan_to_num(np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), dtype=float)).astype(np.int64)
    owner = np.repeat(np.arange(len(lists)), sizes)
    width = max(len(flat.dictionary), 1)
    pairs, tfs = np.unique(owner * width + flat.indices.to_numpy(), return_counts=True)
    ends = np.concatenate([[0], np.cumsum(np.bincount(pairs // width, minlength=len(lists)))]).astype(np.int32)
    terms = flat.dictionary.take(pa.array(pairs % width)) if len(flat.dictionary) else flat.dictionary
    mask = lists.is_null()
    return (pa.ListArray.from_arrays(pa.array(ends), terms, mask=mask), pa.ListArray.from_arrays(pa.array(ends), pa.array(tfs.astype(np.int32)), mask=mask),
            pa.array(sizes.astype(np.int32), mask=np.asarray(mask)))


STAGED = f"{POSTINGS.removeprefix('seg string, ')}, place int, chunk_id string, document_id string, day int, doc_type string, dl int, title_dl int, terms array<string>, tf_counts array<int>, title_terms array<string>, title_tfs array<int>"


def write_segment(forward: DataFrame, count: int, path: str, size: int = SHARD) -> str:
    """Write ``count`` forward rows as a segment of the folder; its name, empty if there are no rows.

    Terms are exchanged to shards once; the task that settles a shard also writes its
    files. Tasks grow in number with the shards, so none sorts more as the corpus grows.
    """
    spark = forward.sparkSession
    shards = -(-count // size)
    if not shards:
        return ""
    name = f"seg-{uuid.uuid4().hex}-{shards}"
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, -(-shards // TOGETHER))
    dealt = forward.withColumn("shard", F.pmod(F.xxhash64("chunk_id"), F.lit(shards)).cast("int"))

    def settle(table: pa.Table) -> pa.Table:
        return shard_rows(table)

    made = dealt.repartition(tasks, "shard").groupBy("shard").applyInArrow(settle, STAGED)
    made = made.withColumn("bucket", F.when(F.col("term").isNull(), FORWARD).otherwise(_bucket(F.col("term"))))
    made.sortWithinPartitions("bucket", "term", "shard").write.partitionBy("bucket").parquet(f"{path}/{name}")
    return name


def shard_rows(table: pa.Table) -> pa.Table:
    """Forward and posting rows of one shard; chunks are numbered by length, then id."""
    table = table.combine_chunks()
    ids = table.column("chunk_id").to_pylist()
    lens = table.column("dl").to_numpy().astype(np.int64)
    order = np.lexsort((np.array(ids, dtype=object).astype(str), lens)) if len(ids) else np.empty(0, np.int64)
    table = table.take(pa.array(order))
    n = table.num_rows
    shard = table.column("shard")[0].as_py() if n else 0
    schema = pa.schema([(x.split()[0], _ARROW[x.split()[1]]) for x in STAGED.split(", ")])
    given = {"shard": pa.array(np.full(n, shard, np.int32)), "place": pa.array(np.arange(n, dtype=np.int32))}
    given |= {c: table.column(c).combine_chunks() for c in table.column_names if c != "shard"}
    tables = [pa.Table.from_arrays([given[f.name].cast(f.type) if f.name in given else pa.nulls(n, f.type) for f in schema], schema=schema)]
    for field, terms, tfs, length in (("text", "terms", "tf_counts", "dl"), ("title", "title_terms", "title_tfs", "title_dl")):
        lists = table.column(terms).combine_chunks()
        flat = lists.flatten().dictionary_encode()
        if not len(flat):
            continue
        sizes = np.nan_to_num(np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), dtype=float)).astype(np.int64)
        place = np.repeat(np.arange(n), sizes)
        tf = table.column(tfs).combine_chunks().flatten().to_numpy().astype(np.int64)
        dl = np.nan_to_num(np.asarray(table.column(length).to_numpy(), dtype=float)).astype(np.int64)
        code = flat.indices.to_numpy()
        by = np.lexsort((place, code))
        place, tf, code = place[by], tf[by], code[by]
        windows = (n + WINDOW - 1) // WINDOW
        cell = code.astype(np.int64) * windows + place // WINDOW
        first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        top, low = np.maximum.reduceat(tf, first), np.minimum.reduceat(dl[place], first)
        window = (cell[first] % windows).astype("<u2")
        owner = code[first]
        opens = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        closes = np.append(opens[1:], len(owner))
        ends = np.append(first, len(code))
        inner = (place % WINDOW).astype(np.uint8)
        tf2, top, low = tf.clip(max=65535).astype("<u2"), top.clip(max=65535).astype("<u2"), low.astype("<u4")
        cuts, at = np.append(opens, len(owner)), ends[np.append(opens, len(owner))]
        # Where the blocks of each term open, counted from its first posting, and the end of the last one.
        many = np.diff(cuts) + 1
        term = np.repeat(np.arange(len(opens)), many)
        spot = np.arange(len(term)) - term
        starts = (ends[spot] - at[term]).astype("<u4")
        m = len(opens)
        made = {
            "shard": pa.array(np.full(m, shard, np.int32)), "field": pa.array([field] * m), "term": flat.dictionary.take(pa.array(owner[opens])),
            "n": pa.array(np.diff(at).astype(np.int32)), "windows": _sliced(window, cuts), "starts": _sliced(starts, np.append(0, np.cumsum(many))),
            "max_tf": _sliced(top, cuts), "min_dl": _sliced(low, cuts), "places": _sliced(inner, at), "tfs": _sliced(tf2, at)}
        tables.append(pa.Table.from_arrays([made[f.name].cast(f.type) if f.name in made else pa.nulls(m, f.type) for f in schema], schema=schema))
    return pa.concat_tables(tables)


def _sliced(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The bytes of values[cuts[i]:cuts[i + 1]] for every i, without copying them one by one."""
    offsets = (cuts * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])


_ARROW = {"string": pa.string(), "int": pa.int32(), "binary": pa.binary(), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32())}


# -- reading ---------------------------------------------------------------
class Shard:
    """Postings of all wanted terms of one shard and field side by side: blocks (a term in a window), and what they hold."""

    def __init__(self, rows: list[dict], lens: np.ndarray, mean: float, weight: float) -> None:
        self.lens, self.mean, self.weight = lens, mean, weight
        self.windows = _joined(rows, "windows", "<u2").astype(np.int64)
        sizes = [len(r["windows"]) // 2 for r in rows]
        ends = np.cumsum([0, *sizes])
        self.of = {r["name"]: (int(a), int(b)) for r, a, b in zip(rows, ends[:-1], ends[1:], strict=True)}
        starts, stops, base = [], [], 0
        for r in rows:
            own = np.frombuffer(r["starts"], "<u4").astype(np.int64) + base
            starts.append(own[:-1])
            stops.append(own[1:])
            base = int(own[-1])
        self.start, self.stop = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (starts, stops))
        self.places, self.tfs = _joined(rows, "places", "u1"), _joined(rows, "tfs", "<u2")
        self.bound = gain(_joined(rows, "max_tf", "<u2"), _joined(rows, "min_dl", "<u4"), mean, weight)

    def blocks(self, terms: list[tuple[str, float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Blocks of a query's terms, the weight of each, and the number of its term."""
        spans = [(*self.of[t], w) for t, w in terms if t in self.of]
        if not spans:
            return np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
        counts = [b - a for a, b, _ in spans]
        return np.concatenate([np.arange(a, b) for a, b, _ in spans]), np.repeat([w for *_, w in spans], counts), np.repeat(np.arange(len(spans)), counts)

    def add(self, score: np.ndarray, blocks: np.ndarray, weights: np.ndarray) -> None:
        """Read blocks: add the weighted gains of their postings to the scores of their chunks."""
        count = self.stop[blocks] - self.start[blocks]
        total = int(count.sum())
        if total:
            at = np.repeat(self.start[blocks] - np.cumsum(count) + count, count) + np.arange(total)
            place = np.repeat(self.windows[blocks] * WINDOW, count) + self.places[at]
            score += np.bincount(place, np.repeat(weights, count) * gain(self.tfs[at], self.lens[place], self.mean, self.weight), len(score))


def _joined(rows: list[dict], name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(r[name] for r in rows), kind)


def gain(tf: np.ndarray, dl: np.ndarray, mean: float, weight: float) -> np.ndarray:
    tf = tf * weight
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))


def search_shard(table: pa.Table, k: int, titles: bool | None) -> pa.Table:
    """The best chunks of one shard for one block of queries; a superset where rounded scores tie.

    ``titles``: None for texts alone, else whether title matches come first.
    """
    table = table.combine_chunks()
    kinds_of = table.column("kind").to_numpy()

    def rows_of(kind: int, *names: str) -> list[dict]:
        return table.select(names).take(pa.array(np.flatnonzero(kinds_of == kind))).to_pylist()

    def values(name: str, at: int) -> pa.Array:
        """One list of the table, as it lies there."""
        return table.column(name).chunk(0)[at].values

    shards, batches = (np.flatnonzero(kinds_of == kind) for kind in (0, 2))
    out: dict[str, list] = {c: [] for c in ("qid", "chunk_id", "score", "title_match", "blocks_read", "blocks")}
    kinds = [pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int64(), pa.int64()]
    if len(shards) and len(batches):
        at = int(shards[0])
        ids = values("ids", at)
        n = len(ids)
        alive = np.ones(n, bool)
        for i in np.flatnonzero(kinds_of == 4):
            alive[values("lens", int(i)).to_numpy()] = False
        asked = values("asked", int(batches[0])).to_pylist()
        lens, days, types = {"text": values("lens", at).to_numpy().astype(np.int64), "title": np.empty(0, np.int64)}, None, None
        if titles is not None:
            lens["title"] = values("title_lens", at).to_numpy().astype(np.int64)
        if any(q["after"] is not None or q["before"] is not None for q in asked):
            days = values("days", at).to_numpy()
        if any(q["kinds"] is not None for q in asked):
            types = values("types", at).to_numpy(zero_copy_only=False).astype(str)
        means = {t["field"]: t["mean"] for q in asked for t in q["terms"]}
        postings = rows_of(1, "name", "field", "windows", "starts", "max_tf", "min_dl", "places", "tfs")
        fields = {f: Shard([r for r in postings if r["field"] == f], lens[f], means.get(f, 1.0), FIELDS[f]) for f in FIELDS}
        bits = {r["name"]: np.unpackbits(np.frombuffer(r["places"], np.uint8), bitorder="little")[:n].astype(bool) for r in rows_of(3, "name", "places")}
        for q in asked:
            allowed = alive.copy()
            if q["keys"] is not None:
                any_of = np.zeros(n, bool)
                for name in q["keys"]:
                    if name in bits:
                        any_of[: len(bits[name])] |= bits[name]
                allowed &= any_of
            if q["kinds"] is not None:
                allowed &= np.isin(types, q["kinds"])
            if q["after"] is not None:
                allowed &= (days >= q["after"]) & (days != NO_DAY)
            if q["before"] is not None:
                allowed &= (days <= q["before"]) & (days != NO_DAY)
            own = {f: fields[f].blocks([(t["term"], t["w"]) for t in q["terms"] if t["field"] == f]) for f in FIELDS}
            blocks = sum(len(x[0]) for x in own.values())
            if titles is not None:
                best, score, titled = both_fields(fields, own, allowed, k, titles)
                read = blocks
            else:
                best, score, read = pruned(fields["text"], *own["text"], allowed, k)
                titled = np.zeros(len(best), bool)
            for column, values in zip(out, ([q["qid"]] * len(best), ids.take(pa.array(best)).to_pylist(), score.tolist(), titled.astype(int).tolist(), [0] * len(best), [0] * len(best)), strict=True):
                out[column] += values
            for column, value in zip(out, (q["qid"], None, None, None, int(read), int(blocks)), strict=True):
                out[column].append(value)
    return pa.Table.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))


TIE = 1e-6  # scores are rounded to as much before they are ranked


def kth(values: np.ndarray, k: int) -> float:
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else 0.0


def pruned(
    shard: Shard, blocks: np.ndarray, weights: np.ndarray, term: np.ndarray, allowed: np.ndarray, k: int, floor: float = 0.0,
) -> tuple[np.ndarray, np.ndarray, int]:
    """Places and scores of the k best, and how many blocks were read; chunks below ``floor`` need not be found.

    The most promising windows are scored in full first; their k-th score is a floor.
    Then terms are read in rounds from the largest bound to the smallest, and a window
    is read on only while one of its chunks can still reach the floor.
    """
    n = len(allowed)
    windows = -(-n // WINDOW)
    if not len(blocks) or not allowed.any():
        return np.empty(0, np.int64), np.empty(0), 0
    window, bound = shard.windows[blocks], weights * shard.bound[blocks]
    rest = np.bincount(window, bound, windows)
    rest[np.add.reduceat(allowed, np.arange(0, n, WINDOW)) == 0] = -1
    score = np.zeros(windows * WINDOW)
    best = np.argsort(-rest, kind="stable")[: max(FIRST, 2 * k // WINDOW)]
    done = np.zeros(windows, bool)
    done[best] = rest[best] >= floor - TIE
    chosen = done[window]
    read = int(chosen.sum())
    shard.add(score, blocks[chosen], weights[chosen])
    floor = max(floor, kth(score[:n][allowed & np.repeat(done, WINDOW)[:n]], k))
    # Terms by their largest bound; a round takes those that hold a share of the sum.
    top = np.zeros(int(term[-1]) + 1)
    np.maximum.at(top, term, bound)
    order = np.argsort(-top, kind="stable")
    share = np.cumsum(top[order]) / top.sum()
    turn = np.empty(len(top), np.int64)
    turn[order] = np.minimum((share - top[order] / top.sum()) * ROUNDS, ROUNDS - 1).astype(np.int64)
    # Blocks in the order of their rounds; a window that was given up once is never looked at again.
    own = turn[term]
    by = np.argsort(own, kind="stable")
    ends = np.searchsorted(own[by], np.arange(ROUNDS + 1))
    blocks, weights, window, bound = blocks[by], weights[by], window[by], bound[by]
    alive, high = ~done & (rest >= 0), score.reshape(windows, WINDOW)
    for first, last in zip(ends[:-1], ends[1:], strict=True):
        left = np.flatnonzero(alive)
        left = left[high[left].max(axis=1) + rest[left] >= floor - TIE]
        if not len(left):
            break
        alive[:] = False
        alive[left] = True
        mine = slice(int(first), int(last))
        chosen = alive[window[mine]]
        if not chosen.any():
            continue
        read += int(chosen.sum())
        shard.add(score, blocks[mine][chosen], weights[mine][chosen])
        rest -= np.where(rest >= 0, np.bincount(window[mine], bound[mine], windows), 0)
        rest[(rest < 0) & (rest > -0.5)] = 0
    # Windows that were given up hold parts of scores below the floor.
    final = np.where(allowed, score[:n], 0)
    found = np.flatnonzero((final > 0) & (final >= max(kth(final, k), floor) - TIE))
    return found, final[found], read


#: Windows scored in full at first, and rounds in which terms are read.
FIRST, ROUNDS = 64, 16


def both_fields(fields: dict[str, Shard], own: dict[str, tuple], allowed: np.ndarray, k: int, tier: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best by title match (with ``tier``), then the better of both scores."""
    n = len(allowed)
    score = {f: np.zeros(-(-n // WINDOW) * WINDOW) for f in own}
    for f, (blocks, weights, _) in own.items():
        fields[f].add(score[f], blocks, weights)
    titled = score["title"][:n] > 0
    final = np.maximum(score["text"], score["title"])[:n]
    found = allowed & (final > 0)
    key = np.where(found, final + tier * titled * 1e6, 0)
    best = np.flatnonzero(found & (key >= kth(key, k) - TIE))
    return best, final[best], titled[best]
