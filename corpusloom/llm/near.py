"""Near-duplicates: one-permutation MinHash with optimal densification, banded buckets, star-shaped candidates.

Equal shingle sets form classes first. The smallest document of a class enters
one bucket per band. Every bucket proposes a star: its smallest member against the
others, so pairs grow with the members and not with their square. Links are
confirmed on full shingle sets. A star can miss a link between two leaves. Where a
bucket still holds several components, its members outside the largest one are
compared with the others inside tasks, in blocks of bounded size, on full sets; out
of a block come only links that join components. Nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.scale import cut
from corpusloom.llm import common as C

SHINGLE, LIMIT = 5, 85
BANDS, ROWS = 24, 5
BINS = BANDS * ROWS
STEP = np.uint64(0xD6E8FEB86659FD93)
#: Donors of empty bins: for each bin and attempt a fixed random bin.
ATTEMPTS = 64
DONOR = (C.mixed(np.arange(1, BINS * ATTEMPTS + 1, dtype=np.uint64)) % np.uint64(BINS)).astype(np.int64).reshape(BINS, ATTEMPTS)
#: Members of one centre that are compared in one group; further ones go to groups of their own.
GROUP = 64
#: Hashes that one side of a block holds.
BLOCK = 1 << 17


def shingle_sets(column: pa.Array, width: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text of an Arrow column."""
    data, offsets = C.text_bytes(column)
    data = C.LOWER[data]
    start, stop = C.word_bounds(data, offsets)
    with np.errstate(over="ignore"):
        word = C.Rolling(data).of(start, stop) + (stop - start).astype(np.uint64) * STEP
        gram = word.copy()
        for i in range(1, width):
            left = max(len(word) - i, 0)
            gram[:left] = gram[:left] * STEP + word[i:]
    first = np.searchsorted(start, offsets)
    for lo, hi in zip(first[:-1], first[1:], strict=True):
        if hi - lo >= width:
            yield np.unique(C.mixed(gram[lo: hi - width + 1]))
        elif hi > lo:
            whole = np.uint64(hi - lo)
            with np.errstate(over="ignore"):
                for w in word[lo:hi]:
                    whole = whole * STEP + w
            yield C.mixed(np.array([whole], np.uint64))
        else:
            yield np.empty(0, np.uint64)


def bands(values: np.ndarray) -> np.ndarray:
    """One hash per band of the densified one-permutation signature of a sorted set."""
    bins = ((values >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)
    head = np.flatnonzero(np.append(True, bins[1:] != bins[:-1]))
    filled = np.zeros(BINS, bool)
    signature = np.zeros(BINS, np.uint64)
    filled[bins[head].astype(np.int64)] = True
    signature[bins[head].astype(np.int64)] = values[head]
    empty = np.flatnonzero(~filled)
    for t in range(ATTEMPTS):
        if not len(empty):
            break
        donor = DONOR[empty, t]
        found = filled[donor]
        signature[empty[found]] = signature[donor[found]]
        empty = empty[~found]
    signature[empty] = values[0]
    with np.errstate(over="ignore"):
        out = np.arange(1, BANDS + 1, dtype=np.uint64)
        for i in range(ROWS):
            out = C.mixed(out * STEP + signature[i::ROWS])
    return out


SKETCH = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("key1", pa.int64()), ("key2", pa.int64()), ("bands", pa.list_(pa.int64()))])


def sketches(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, set size, 128-bit key of the set, and band hashes of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in C.slices(batches, "text"):
            sizes, one, two, found = [], [], [], []
            for values in shingle_sets(part.column("text")):
                sizes.append(len(values))
                with np.errstate(over="ignore"):
                    one.append(C.mixed(values).sum(dtype=np.uint64))
                    two.append(C.mixed(values ^ STEP).sum(dtype=np.uint64))
                found.append(C.signed(bands(values)) if len(values) else np.empty(0, np.int64))
            ends = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(C.signed(np.array(one, np.uint64))),
                pa.array(C.signed(np.array(two, np.uint64))), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))], schema=SKETCH)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.text_or_empty(text).alias("text")).mapInArrow(
        run, "doc_id long, n long, key1 long, key2 long, bands array<long>")


def confirm(pairs: DataFrame, texts: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= limit * union.

    The members of a centre are dealt to groups of bounded size, each opened by a
    copy of the centre, so neither a task nor memory holds all members of one.
    """
    degree = pairs.groupBy("a").agg(F.count("*").alias("degree"))
    dealt = pairs.join(degree, "a").select(
        "a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("degree") / GROUP)).cast("int").alias("g"))
    leaves = dealt.join(texts, dealt.b == texts.doc_id).select("a", "g", "b", "text")
    centres = dealt.select("a", "g").distinct().join(texts, F.col("a") == texts.doc_id).select("a", "g", F.lit(None).cast("long").alias("b"), "text")
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = leaves.unionByName(centres).repartition(n, "a", "g").sortWithinPartitions("a", "g", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, centre = None, None
        for part in C.slices(batches, "text"):
            a, g, b = (part.column(c).to_pylist() for c in ("a", "g", "b"))
            out = []
            for i, values in enumerate(shingle_sets(part.column("text"))):
                if b[i] is None:
                    held, centre = (a[i], g[i]), values
                elif held == (a[i], g[i]):
                    both = len(np.intersect1d(centre, values, assume_unique=True))
                    if 100 * both >= limit * (len(centre) + len(values) - both):
                        out.append((a[i], b[i]))
            yield pair_batch(out)

    return rows.select("a", "g", "b", "text").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(a, b) with b the smallest node reachable from a, for all nodes but the smallest ones.

    Alternating large and small stars; every round is a minimum per node and a join.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    mark = state(edges)
    while mark[0]:
        both = edges.union(edges.select("b", "a").toDF("a", "b"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").filter("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        leaf = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut(leaf.union(least.toDF("a", "b")).distinct())
        before, mark = mark, state(edges)
        if before == mark:
            break
    return edges


def state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def compatible(limit: int) -> F.Column:
    """Sets whose sizes alone rule a link out need no comparison."""
    return F.expr(f"100 * least(n_a, n_b) >= {limit} * greatest(n_a, n_b)")


def link_components(docs: DataFrame, limit: int = LIMIT, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(row table with class representative, stars of representatives)."""
    rows = cut(sketches(docs, text))
    usable = rows.filter("n > 0 and doc_id is not null")
    classes = usable.groupBy("key1", "key2", "n").agg(F.min(F.struct("doc_id", "bands")).alias("first"))
    classes = cut(classes.select("key1", "key2", "n", F.col("first.doc_id").alias("rep"), F.col("first.bands").alias("bands")))
    rows = rows.drop("bands").join(classes.drop("bands"), ["key1", "key2", "n"], "left")
    entries = classes.select(F.explode("bands").alias("bucket"), "rep", "n")
    shared = entries.groupBy("bucket").agg(F.count("*").alias("members"), F.min(F.struct("rep", "n")).alias("first")).filter("members > 1")
    members = cut(entries.join(shared.select("bucket", F.col("first.rep").alias("a"), F.col("first.n").alias("n_a")), "bucket"))
    nodes = members.select(F.col("rep").alias("doc_id")).distinct()
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.text_or_empty(text).alias("text"))
    texts = C.written(source.join(nodes, "doc_id", "left_semi"), "near-texts")
    pairs = members.filter("rep <> a").select("a", F.col("rep").alias("b"), "n_a", F.col("n").alias("n_b"))
    tested = cut(pairs.filter(compatible(limit)).select("a", "b").distinct())
    stars = components(confirm(tested, texts, limit))
    fresh = torn_pairs(members.select("bucket", "rep", "n"), stars, texts, limit)
    return rows, components(stars.union(fresh))


def torn_pairs(members: DataFrame, stars: DataFrame, texts: DataFrame, limit: int) -> DataFrame:
    """Links (a, b) that join components inside buckets that hold several.

    Of any two members of different components one is outside the largest
    component of the bucket. These and all members are dealt to a grid of blocks
    whose sides hold a bounded number of hashes; a block counts the common
    hashes of its pairs from an index of the outer side, and passes over pairs
    that its links have joined already.
    """
    placed = members.join(stars.toDF("rep", "comp"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    counts = placed.groupBy("bucket", "comp").agg(F.sum("n").alias("hashes"))
    torn = counts.groupBy("bucket").agg(
        F.max(F.struct("hashes", "comp")).alias("main"), F.sum("hashes").alias("total"), F.count("*").alias("parts")).filter("parts > 1")
    grid = torn.select(
        "bucket", F.col("main.comp").alias("main"), F.ceil((F.col("total") - F.col("main.hashes")) / BLOCK).alias("tall"),
        F.ceil(F.col("total") / BLOCK).alias("wide"))
    spot = placed.join(grid, "bucket").select(
        "bucket", "rep", "n", "comp", (F.col("comp") != F.col("main")).alias("outer"), "tall", "wide",
        F.pmod(F.xxhash64("rep"), "tall").alias("i"), F.pmod(F.xxhash64("rep", F.lit(1)), "wide").alias("j"))
    row = F.transform(F.sequence(F.lit(0), F.col("wide") - 1), lambda y: F.struct(F.col("i").cast("long").alias("x"), y.cast("long").alias("y")))
    column = F.transform(F.sequence(F.lit(0), F.col("tall") - 1), lambda x: F.struct(x.cast("long").alias("x"), F.col("j").cast("long").alias("y")))
    blocks = spot.select("*", F.explode(F.array_distinct(F.concat(F.when(F.col("outer"), row).otherwise(F.slice(row, 1, 0)), column))).alias("at"))
    blocks = blocks.select(
        "bucket", F.col("at.x").alias("x"), F.col("at.y").alias("y"), "rep", "comp",
        (F.col("outer") & (F.col("at.x") == F.col("i"))).alias("outer"), (F.col("at.y") == F.col("j")).alias("inner"))
    sets = texts.select("doc_id", "text").mapInArrow(full_sets, "doc_id long, hashes binary")
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ready = blocks.join(sets, blocks.rep == sets.doc_id).drop("doc_id").repartition(n, "bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group = None, []
        for part in C.slices(batches, "hashes"):
            found: list[tuple[int, int]] = []
            columns = (part.column(c).to_pylist() for c in ("bucket", "x", "y", "rep", "comp", "outer", "inner", "hashes"))
            for bucket, x, y, *member in zip(*columns, strict=True):
                if held != (bucket, x, y):
                    found += links_of_block(group, limit)
                    held, group = (bucket, x, y), []
                group.append(member)
            yield pair_batch(found)
        yield pair_batch(links_of_block(group, limit))

    return ready.select("bucket", "x", "y", "rep", "comp", "outer", "inner", "hashes").mapInArrow(run, "a long, b long").distinct()


def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in C.slices(batches, "text"):
        sets = [v.tobytes() for v in shingle_sets(part.column("text"))]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sets, pa.binary())], names=["doc_id", "hashes"])


def pair_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])


def links_of_block(group: list[list], limit: int) -> list[tuple[int, int]]:
    """Links between members of different components, fewer than there are components.

    ``group``: rep, component, outer, inner, bytes of the sorted set.
    """
    outer = [m for m in group if m[2]]
    if not outer or len(group) < 2:
        return []
    roots: dict[int, int] = {}

    def root(comp: int) -> int:
        while comp in roots:
            comp = roots[comp]
        return comp

    sets = [np.frombuffer(m[4], np.uint64) for m in outer]
    sizes, comps = np.array([len(s) for s in sets]), np.array([m[1] for m in outer])
    owner = np.repeat(np.arange(len(sets)), sizes)
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    out = []
    for rep, comp, _, inner, raw in group:
        own = np.frombuffer(raw, np.uint64)
        comp = root(comp)
        open_ = (comps != comp) & (100 * np.minimum(sizes, len(own)) >= limit * np.maximum(sizes, len(own)))
        if not inner or not open_.any():
            continue
        lo, hi = np.searchsorted(values, own), np.searchsorted(values, own, side="right")
        width = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(width)[:-1]]), width) + np.arange(width.sum())
        both = np.bincount(owner[at], minlength=len(sets))
        for o in np.flatnonzero(open_ & (100 * both >= limit * (sizes + len(own) - both))):
            if comps[o] != comp:
                out.append((rep, outer[o][0]))
                roots[int(comps[o])] = comp
                comps[comps == comps[o]] = comp
    return out


def dedup(docs: DataFrame, limit: int = LIMIT, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Null and empty texts have no shingles and are linked with nothing. Rows with
    the same doc_id are one node of the graph; a null doc_id is linked with
    nothing, has a null component and is kept. Equal sets are links without
    comparison. An empty table gives an empty result; other columns are ignored.
    """
    rows, stars = link_components(docs, limit, text)
    stars = stars.toDF("rep", "comp")
    component = F.coalesce("comp", "rep", "doc_id")
    return rows.join(stars, "rep", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def survivors(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The rows of ``docs`` whose id stands for its group, one row per id; null ids stay.

    Rows that share an id are one node, so the first of them by text stays.
    """
    rows, stars = link_components(docs, limit)
    gone = rows.join(stars.toDF("rep", "comp"), "rep", "left").filter(F.coalesce("comp", "rep", "doc_id") != F.col("doc_id")).select("doc_id")
    row = docs.select(F.struct("*").alias("row"))  # columns of any name stay inside
    left = row.join(gone.distinct(), F.col("row.doc_id") == F.col("doc_id"), "left_anti")
    twice = cut(rows.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    if twice.isEmpty():
        return left.select("row.*")
    again = left.join(twice, F.col("row.doc_id") == F.col("doc_id"))
    place = Window.partitionBy("doc_id").orderBy(F.col("row.text").asc_nulls_last(), F.xxhash64("row"))
    again = again.withColumn("place", F.row_number().over(place)).filter("place = 1").select("row")
    return left.join(twice, F.col("row.doc_id") == F.col("doc_id"), "left_anti").unionByName(again).select("row.*")


def query(spark: SparkSession, folder: str) -> DataFrame:
    return dedup(C.documents(spark, folder))


SQL = r"""
WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
listed AS MATERIALIZED (SELECT doc_id, len(w) AS size, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM words),
grams AS MATERIALIZED (
  SELECT doc_id, size, i, hash(word || ' ' || coalesce(lead(word, 1) OVER p, '') || ' ' || coalesce(lead(word, 2) OVER p, '') || ' '
    || coalesce(lead(word, 3) OVER p, '') || ' ' || coalesce(lead(word, 4) OVER p, '')) AS x
  FROM listed WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
items AS MATERIALIZED (SELECT DISTINCT doc_id, x FROM grams WHERE i <= greatest(size - 4, 1)),
sets AS MATERIALIZED (SELECT doc_id, count(*) AS n, list(x ORDER BY x) AS key FROM items GROUP BY doc_id),
classes AS MATERIALIZED (SELECT min(doc_id) AS rep, any_value(n) AS n, key FROM sets GROUP BY key),
member AS (SELECT s.doc_id, s.n, c.rep FROM sets s JOIN classes c USING (key)),
ritems AS MATERIALIZED (SELECT i.doc_id, c.n, i.x FROM items i JOIN classes c ON i.doc_id = c.rep),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM ritems a JOIN ritems b ON a.x = b.x AND a.doc_id < b.doc_id
    AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
links AS MATERIALIZED (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT rep AS node, rep AS low FROM classes UNION SELECT l.b, r.low FROM reach r JOIN links l ON l.a = r.node),
comp AS (SELECT node, min(low) AS low FROM reach GROUP BY node)
SELECT d.doc_id, CAST(coalesce(m.n, 0) AS BIGINT) AS n_shingles, coalesce(c.low, d.doc_id) AS component_id, d.doc_id = coalesce(c.low, d.doc_id) AS kept
FROM documents d LEFT JOIN member m USING (doc_id) LEFT JOIN comp c ON c.node = m.rep
"""
