"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Every document of a source expects the same number of copies, at most ``most``.
Documents stand in the order of their size; the running sum of expected copies,
shifted by one random offset per source, gives a document one copy for every
integer it crosses. Neighbours are alike in size, so the words taken follow the
target as well as the number of documents does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.scale import cut, running_number
from corpusloom.llm.common import WORD, documents

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, target from one row (source, source_size) per source.

    Sources stand by code point, null last, and take the weights in turn. Resharing
    the excess over the caps ends where every open source has the same ``level``
    per weight: caps fill up in the order of cap per weight, so running sums in
    that order give the level for any number of closed sources.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (turn + 1).cast("int")).cast("long"))
    cap = F.col("source_size") * most
    fill = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    everything = fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.sum("source_size").over(everything).cast("double") * share
    level = (budget - F.coalesce(F.sum(cap).over(before), F.lit(0))) / F.sum("weight").over(after)
    steps = weighed.withColumn("cap", cap).withColumn("level", level)
    # Once a source stays under its cap, so do all later ones, at the level found there.
    open_level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(everything)
    found = steps.withColumn("open", open_level["level"])
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("open") * F.col("weight"), F.col("cap").cast("double")))
    return found.select("source", "source_size", target.alias("target"))


def offset(source: Column) -> Column:
    """A fixed random number in [0, 1) per source."""
    digest = F.md5(F.concat(F.lit("mix:"), F.coalesce(source, F.lit("\0"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """doc_id, size, source, tag (a hash of the text), source_size, target, copies for every row.

    Null texts have size 0; a null source is a source of its own, after all others.
    A source of size 0 has target 0 and takes nothing. Repeated rows stand one
    after another and count each. No row is dropped; an empty table gives an empty
    result. Positions come from a range sort and counters per partition, so that no
    source is sorted in one task.
    """
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), text_tag().alias("tag"))
    order = [F.col("source").asc_nulls_last(), F.col("size").asc(), F.col("doc_id").asc_nulls_last(), F.col("tag").asc()]
    placed = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order))
    number = F.monotonically_increasing_id()
    placed = placed.select(
        "*", F.shiftright(number, 33).alias("part"), number.bitwiseAND(F.lit((1 << 33) - 1)).alias("at"))
    # One row per partition and source it holds: their number is bounded by partitions + sources.
    runs = placed.groupBy("source", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = targets(runs.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    runs = runs.withColumn("skip", F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first"))
    runs = runs.join(whole.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select(
        F.col("source").alias("s"), F.col("part").alias("p"), "skip", "source_size", "target")
    known = placed.join(runs, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    position = (F.col("at") + F.col("skip")).cast("double")
    crossed = F.floor((position + 1) * rate + offset(F.col("source"))) - F.floor(position * rate + offset(F.col("source")))
    return known.select("doc_id", "size", "source", "tag", "source_size", "target", F.least(crossed, F.lit(most)).cast("long").alias("copies"))


def mix(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs``, each as often as the mixture takes it, with the columns of ``docs``.

    Copies are joined back by id, source and a hash of the text. Rows equal in all
    three are numbered on both sides where their copies differ, so each row takes
    its own copies.
    """
    key = ["doc_id", "source", "tag"]
    each = copies(docs, **settings).select(*key, "copies")
    groups = cut(each.groupBy(*key).agg(F.min("copies").alias("low"), F.max("copies").alias("high")))
    rows = docs.select(F.struct("*").alias("row"))  # columns of any name stay inside
    same = F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & F.col("row.source").eqNullSafe(F.col("source"))
    same = same & (text_tag("row.text") == F.col("tag"))
    taken = rows.join(groups.filter("low = high and low > 0"), same).select("row", F.col("low").cast("int").alias("times"))
    uneven = groups.filter("low < high").select(*key, F.to_json(F.struct(*key)).alias("group"))  # never null
    if not uneven.isEmpty():
        # The tie spreads a group over range partitions; it is not the order of anything.
        numbered = running_number(rows.join(uneven, same).select("row", "group", tie()), ["group"], [F.col("tie")], "turn")
        slots = each.select("copies", F.to_json(F.struct(*key)).alias("group")).join(uneven.select("group"), "group", "left_semi")
        slots = running_number(slots.withColumn("tie", tie()), ["group"], [F.col("tie")], "turn")
        own = numbered.join(slots.select("group", "turn", "copies"), ["group", "turn"])
        taken = taken.unionByName(own.filter("copies > 0").select("row", F.col("copies").cast("int").alias("times")))
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def tie() -> Column:
    return F.xxhash64(F.monotonically_increasing_id()).alias("tie")


def text_tag(name: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(name), F.lit("")))


def query(spark: SparkSession, folder: str) -> DataFrame:
    return copies(documents(spark, folder)).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS BIGINT) AS weight,
         source_size * 2 AS cap FROM s),
l AS (
  SELECT *, cap / weight AS fill,
    (CAST(sum(source_size) OVER () AS DOUBLE) * CAST(1.5 AS DOUBLE)
      - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
o AS (SELECT arg_min(level, fill) AS level FROM l WHERE level * weight <= cap),
t AS (
  SELECT source, source_size, weight,
         least(CAST(cap AS DOUBLE), coalesce((SELECT level FROM o) * weight, CAST(cap AS DOUBLE))) AS target FROM l),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    CAST(('0x' || substr(md5('mix:' || coalesce(d.source, chr(0))), 1, 8)) AS BIGINT) / CAST(4294967296 AS DOUBLE) AS shift,
    CAST(row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id ASC NULLS LAST) - 1 AS DOUBLE) AS pos
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(least(floor((pos + 1) * rate + shift) - floor(pos * rate + shift), 2) AS BIGINT) * size AS taken
FROM p
"""
