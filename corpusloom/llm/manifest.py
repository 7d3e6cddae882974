"""Merkle manifest of a table, with leaf coordinates from bitmap ranks.

Leaves of a group (a source) ascend by ``doc_id``. Their coordinates are not found by
sorting: ids are merged into 64-bit words of a bitmap per group (only words with an id
exist, so sparse ids cost one word each), and a directory of counts is built over the
words with a fan-out of 512 per level until one node is left. An id's coordinate is the
directory's offset of its word plus the number of lower bits set in the word. Words
that hold an id several times, and null ids, are numbered by a range sort instead.

Coordinates then key arrays of 16 slots; each array becomes one digest, level by level,
for all groups at once. The way back down hands every node the digests left and right
of it on each level, from which the proofs follow. No step holds more than 16 slots or
512 counts of a key together, whatever the size of a group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.functions.scale import cut, running_number
from corpusloom.llm import common as C

#: Nodes hashed together.
FAN = 16
#: Bits of an id that number it inside a bitmap word, and those that each directory level takes.
WORD_BITS, NODE_BITS = 6, 9
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, source, leaf, changed): binary digests; ``changed`` is null where tampering leaves the row alone."""
    plain = [field(F.col(c)) for c in FIELDS]
    lower = F.translate(F.col("text").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.unhex(digest(*plain)).alias("leaf"),
        F.when(tampered, F.unhex(digest(*plain[:-1], field(lower)))).alias("changed"))


def directory(words: DataFrame) -> DataFrame:
    """``words`` (grp, word, n, ...) with ``before``: how many rows of the group lie in earlier words.

    A trie of counts: a node sums up to 512 nodes of the level below; the top has one node per group and sign.
    """
    low, high = words.agg(F.min("word"), F.max("word")).first()
    levels, shift = [words], 0
    while low is not None and (high >> shift) - (low >> shift) >= 1 << NODE_BITS:
        parent = F.shiftright("word", NODE_BITS).alias("word")
        levels.append(cut(levels[-1].groupBy("grp", parent).agg(F.sum("n").alias("n"))))
        shift += NODE_BITS
    found = None
    for level in reversed(levels):
        node = F.shiftright("word", NODE_BITS) if found is not None else F.lit(0)
        inner = W.partitionBy("grp", "parent").orderBy("word").rowsBetween(W.unboundedPreceding, -1)
        placed = level.withColumn("parent", node).withColumn("inside", F.coalesce(F.sum("n").over(inner), F.lit(0)))
        if found is not None:
            above = found.select("grp", F.col("word").alias("parent"), F.col("before").alias("above"))
            placed = placed.join(above, ["grp", "parent"]).withColumn("inside", F.col("inside") + F.col("above"))
        found = placed.withColumn("before", F.col("inside")).drop("parent", "inside", "above")
    return found


def coordinates(rows: DataFrame) -> DataFrame:
    """``rows`` (grp, doc_id, leaf, ...) with ``at``, the 0-based coordinate of the row in its group, and ``total``.

    Rows with a null id come first; equal ids stand by leaf, equal leaves in any order.
    """
    word = F.shiftright("doc_id", WORD_BITS)
    place = F.col("doc_id").bitwiseAND(F.lit((1 << WORD_BITS) - 1)).cast("int")
    keyed = rows.withColumn("word", word)
    merged = keyed.groupBy("grp", "word").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place)).alias("bits"), F.count("*").alias("n"))
    merged = cut(merged.withColumn("torn", F.col("word").isNull() | (F.bit_count("bits") < F.col("n"))))
    totals = merged.groupBy("grp").agg(F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col("word").isNull(), F.col("n"))), F.lit(0)).alias("nulls"))
    offsets = directory(merged.filter("word IS NOT NULL")).select("grp", "word", "bits", "torn", "before")
    lower = F.bit_count(F.col("bits").bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), place))))
    ranked = keyed.join(offsets.filter("NOT torn").drop("torn"), ["grp", "word"]).withColumn("at", F.col("before") + lower)
    names = [*rows.columns, "at"]
    ranked = ranked.select(*names)
    if merged.filter("torn").isEmpty():
        return ranked.join(F.broadcast(totals.select("grp", "total")), "grp") if few(totals) else ranked.join(totals.select("grp", "total"), "grp")
    torn = merged.filter("torn").select("grp", F.coalesce("word", F.lit(0)).alias("word"), F.col("word").isNull().alias("none"))
    inside = keyed.withColumn("none", F.col("word").isNull()).withColumn("word", F.coalesce("word", F.lit(0)))
    inside = inside.join(torn, ["grp", "word", "none"], "left_semi").withColumn("tie", F.monotonically_increasing_id())
    numbered = running_number(inside, ["grp", "none", "word"], [F.col("doc_id"), F.col("leaf"), F.col("tie")], "nth")
    start = offsets.filter("torn").select("grp", "word", F.lit(False).alias("none"), "before")
    odd = numbered.join(start, ["grp", "word", "none"], "left").withColumn("at", F.coalesce("before", F.lit(0)) + F.col("nth") - 1)
    ranked = ranked.withColumn("none", F.lit(False)).unionByName(odd.select(*names, "none"))
    ranked = ranked.join(totals, "grp").withColumn("at", F.col("at") + F.when(F.col("none"), 0).otherwise(F.col("nulls")))
    return ranked.select(*names, "total")


def few(df: DataFrame, most: int = 100_000) -> bool:
    return df.limit(most + 1).count() <= most


SLOT = "slot int, value string"


def climb(nodes: DataFrame) -> list[DataFrame]:
    """Levels of slot arrays over ``nodes`` (grp, at, total, value): one row (grp, at, total, slots, value) per run.

    ``value`` is the digest of the run, ``at`` its place, ``total`` how many runs the group has on that level.
    The last level's ``total`` is 1 for all groups; groups with a single node have no row at all.
    """
    most = nodes.agg(F.max("total")).first()[0] or 0
    levels, below = [], nodes
    while most > 1:
        member = F.struct((F.col("at") % FAN).cast("int").alias("slot"), F.col("value"))
        runs = below.filter("total > 1").groupBy("grp", F.floor(F.col("at") / FAN).alias("at"), F.ceil(F.col("total") / FAN).alias("total")).agg(
            F.array_sort(F.collect_list(member)).alias("slots"))
        texts = F.transform("slots", lambda x: F.lower(F.hex(x["value"])))
        runs = cut(runs.select("grp", "at", "total", texts.alias("slots"), F.unhex(F.sha2(F.array_join(texts, ""), 256)).alias("value")))
        levels.append(runs)
        below, most = runs.select("grp", "at", "total", "value"), -(-most // FAN)
    return levels


def tops(nodes: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(grp, value): what remains of each group."""
    parts = [nodes, *levels]
    return reduce(DataFrame.unionByName, [p.filter("total = 1").select("grp", "value") for p in parts])


def descend(levels: list[DataFrame], above: DataFrame) -> DataFrame | None:
    """(grp, at, slots, path) of the lowest level: ``path`` lists what stands left and right of the run on its way up.

    ``above`` (grp, path) is the way from the group's top on.
    """
    path = None
    for level in reversed(levels):
        whole = level.filter("total = 1").select("grp", "at", "slots").join(above, "grp")
        if path is not None:
            lower = level.filter("total > 1").select("grp", "at", "slots", F.floor(F.col("at") / FAN).alias("up"), (F.col("at") % FAN).cast("int").alias("slot"))
            upper = path.select("grp", F.col("at").alias("up"), F.col("slots").alias("upper"), "path")
            lower = lower.join(upper, ["grp", "up"])
            whole = whole.unionByName(lower.select("grp", "at", "slots", F.concat(F.array(beside("upper", F.col("slot"))), "path").alias("path")))
        path = whole
    return path


def beside(slots: str, slot: Column) -> Column:
    """Digests left and right of a slot, each side as one string."""
    left = F.array_join(F.slice(slots, F.lit(1), slot), "")
    right = F.array_join(F.slice(slots, slot + 2, F.lit(FAN)), "")
    return F.struct(left.alias("l"), right.alias("r"))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda value, step: F.sha2(F.concat(step["l"], value, step["r"]), 256))


PATH = "array<struct<l:string,r:string>>"


def build(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: its keys, leaf, place, group digest, root, proof and check of a tampered copy.

    Columns: doc_id, source, at (0-based place of the leaf in its source), leaf, subroot,
    root, proof (digests left and right of each level, leaf first), folded_root, verified.
    Null ids come first in their source; equal ids stand by leaf and each row is a leaf of
    its own; a null source is a source of its own and comes first. Null fields enter as
    ``-``. An empty table gives an empty result. Columns besides the five fields play no part.
    """
    spark = docs.sparkSession
    base = C.written(leaves(docs), "leaves")
    groups = running_number(base.select("source").distinct(), [], [F.col("source").asc_nulls_first()], "nth")
    groups = cut(groups.select((F.col("nth") - 1).alias("grp"), "source"))
    known = F.broadcast(groups) if few(groups) else groups
    rows = base.join(known, base["source"].eqNullSafe(known["source"])).select("grp", "doc_id", "leaf", "changed")
    placed = C.written(coordinates(rows), "coordinates")
    nodes = placed.select("grp", "at", "total", F.col("leaf").alias("value"))
    inner = climb(nodes)
    subroots = cut(tops(nodes, inner))
    # The same reduction over the groups' digests gives the root.
    sources = groups.agg(F.count("*").alias("total")).first()["total"]
    crowns = subroots.select(F.lit(0).cast("long").alias("grp"), F.col("grp").alias("at"), F.lit(sources).cast("long").alias("total"), "value")
    outer = climb(crowns)
    root = tops(crowns, outer).first()
    root = root["value"].hex() if root else None
    empty = F.from_json(F.lit("[]"), PATH)
    if outer:
        start = spark.range(1).select(F.lit(0).cast("long").alias("grp"), empty.alias("path"))
        ways = descend(outer, start).select(F.posexplode("slots").alias("slot", "v"), "at", "slots", "path")
        ways = ways.select((F.col("at") * FAN + F.col("slot")).alias("grp"), F.concat(F.array(beside("slots", F.col("slot"))), "path").alias("path"))
    else:
        ways = subroots.select("grp", empty.alias("path"))
    above = cut(ways)
    heads = groups.join(subroots, "grp").join(above.withColumnRenamed("path", "crown"), "grp")
    heads = cut(heads.select("grp", "source", F.lower(F.hex("value")).alias("subroot"), "crown"))
    paths = descend(inner, above)
    alone = placed.filter("total = 1").join(heads, "grp").withColumn("path", F.col("crown"))
    if paths is not None:
        paths = paths.select("grp", F.col("at").alias("up"), "slots", F.col("path").alias("way"))
        among = placed.filter("total > 1").withColumn("up", F.floor(F.col("at") / FAN)).join(paths, ["grp", "up"])
        among = among.join(F.broadcast(heads) if few(heads) else heads, "grp")
        way = F.concat(F.array(beside("slots", (F.col("at") % FAN).cast("int"))), "way")
        alone = among.withColumn("path", way).select(*alone.columns).unionByName(alone)
    leaf, changed = F.lower(F.hex("leaf")), F.lower(F.hex(F.coalesce("changed", "leaf")))
    end = folded(changed, F.col("path"))
    done = alone.select("doc_id", "source", "at", leaf.alias("leaf"), "subroot", F.lit(root).alias("root"), F.col("path").alias("proof"), end.alias("folded_root"))
    return done.withColumn("verified", F.col("folded_root") == F.col("root"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    steps = F.transform("proof", lambda s: F.concat(s["l"], s["r"]))
    return build(C.documents(spark, folder)).select(
        "doc_id", "leaf", "subroot", "root", F.sha2(F.array_join(steps, ""), 256).alias("proof_sha256"), "folded_root", "verified")


def sql(inner: int = 6, outer: int = 3) -> str:
    """DuckDB SQL of the query, for up to 16 ** ``inner`` rows of a source and 16 ** ``outer`` sources."""
    def h(names: list[str]) -> str:
        return "sha256(" + " || ".join(names) + ")"

    def size(name: str) -> str:
        return f"coalesce(strlen({name}::VARCHAR)::VARCHAR || ':' || {name}::VARCHAR, '-')"

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    plain = [size(c) for c in FIELDS]
    steps = [f"""
    crc0(i, k, c) AS (SELECT i, 0, i FROM range(256) t(i) UNION ALL
        SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc0 WHERE k < 8),
    crc1 AS (SELECT i, c AS t FROM crc0 WHERE k = 8),
    crc2(doc_id, k, c) AS (SELECT DISTINCT doc_id, 0, 4294967295 FROM documents WHERE doc_id IS NOT NULL UNION ALL
        SELECT doc_id, k + 1, xor(c >> 8, t) FROM crc2 JOIN crc1 ON i = xor(c & 255, ascii(substr(doc_id::VARCHAR, k + 1, 1))) WHERE k < length(doc_id::VARCHAR)),
    crc AS (SELECT doc_id, xor(c, 4294967295) AS crc FROM crc2 WHERE k = length(doc_id::VARCHAR)),
    base AS (SELECT d.doc_id, source, {h(plain)} AS leaf, CASE WHEN crc % 5 = 0 THEN {h([*plain[:-1], size(lower)])} ELSE {h(plain)} END AS changed,
        row_number() OVER () AS rid FROM documents d LEFT JOIN crc USING (doc_id)),
    s0 AS (SELECT rid, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS grp, leaf AS v, count(*) OVER (PARTITION BY source) AS n,
        row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS pos FROM base)"""]
    state = "s0"

    def climb(name: str, depth: int, source: str) -> str:
        """Levels name0 .. nameN of (grp, pos, n, v), and the list of siblings left and right of each node."""
        steps.append(f"{name}0 AS (SELECT grp, pos, n, v FROM {source})")
        for k in range(depth):
            steps.append(f"""{name}{k + 1} AS (SELECT grp, pos // 16 AS pos, CASE WHEN max(n) > 1 THEN (max(n) + 15) // 16 ELSE 1 END AS n,
        CASE WHEN max(n) > 1 THEN sha256(string_agg(v, '' ORDER BY pos)) ELSE max(v) END AS v FROM {name}{k} GROUP BY grp, pos // 16)""")
            steps.append(f"""{name}x{k} AS (SELECT a.grp, a.pos, coalesce(string_agg(b.v, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
        coalesce(string_agg(b.v, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r, max(a.n) > 1 AS up
        FROM {name}{k} a JOIN {name}{k} b ON a.grp = b.grp AND a.pos // 16 = b.pos // 16 GROUP BY a.grp, a.pos)""")
        return f"{name}{depth}"

    sub = climb("m", inner, state)
    steps.append(f"c AS (SELECT 0 AS grp, grp AS pos, (SELECT count(*) FROM {sub}) AS n, v FROM {sub})")
    top = climb("t", outer, "c")
    steps.append("f0 AS (SELECT rid, grp, pos, '' AS proof, changed AS folded FROM s0 JOIN base USING (rid))")
    k = 0
    for name, depth in (("m", inner), ("t", outer)):
        if name == "t":
            steps.append(f"f{k + 1} AS (SELECT rid, 0 AS grp, grp AS pos, proof, folded FROM f{k})")
            k += 1
        for level in range(depth):
            steps.append(f"""f{k + 1} AS (SELECT rid, f.grp, f.pos // 16 AS pos, CASE WHEN up THEN proof || l || r ELSE proof END AS proof,
        CASE WHEN up THEN sha256(l || folded || r) ELSE folded END AS folded FROM f{k} f JOIN {name}x{level} x ON f.grp = x.grp AND f.pos = x.pos)""")
            k += 1
    return "WITH RECURSIVE " + ",\n".join(steps) + f"""
SELECT doc_id, leaf, g.v AS subroot, t.v AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = t.v AS verified
FROM base JOIN s0 USING (rid) JOIN f{k} USING (rid) JOIN {sub} g ON g.grp = s0.grp CROSS JOIN {top} t"""


SQL = sql()
