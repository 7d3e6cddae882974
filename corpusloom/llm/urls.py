"""URL filter: allow and block rules, and gradient-boosted trees on lexical features for what no rule decides.

The labelled URLs are those that a rule decides. Features are length, depth, digit
ratio, entropy, parameter counts, and how often labelled URLs with the same host
suffix or first path segment are blocked. Features and scoring are DataFrame expressions and the tree
ensemble of Spark's own library.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.scale import broadcast_checked, cut

#: Bound of the labelled rows that the trees are fitted on, in the order of a hash.
SAMPLE = 20_000
TREES, DEPTH = 10, 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


# The rules of the registered query.
RULES = (
    Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)
LEXICAL = ["n_chars", "host_chars", "labels", "depth", "path_chars", "params", "query_chars", "digit_ratio", "host_digits", "hyphens", "entropy",
           "host_entropy"]
LEVELS = ("top", "second", "lead")
SUFFIX = [f"{level}_rate" for level in LEVELS]


def parts(url: Column) -> tuple[Column, Column, Column]:
    """Host in lower case, path, and the rest of the URL."""
    body = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(body, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(body, r"^[^/?#]*([^?#]*)", 1)
    rest = F.regexp_extract(body, r"(?s)^[^?#]*(.*)$", 1)
    return tuple(F.coalesce(c, F.lit("")) for c in (host, path, rest))


def ruled(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """Rule text and verdict of the longest rule that fits, else null. A rule fits its host and all subdomains."""
    name = verdict = None
    for rule in sorted(rules, key=lambda r: -len(r.host + r.path)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name = F.when(fits, rule.host + rule.path) if name is None else name.when(fits, rule.host + rule.path)
        verdict = F.when(fits, rule.verdict) if verdict is None else verdict.when(fits, rule.verdict)
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name, verdict)


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    n = F.length(text)
    share = lambda c: (n - F.length(F.replace(text, c))) / n
    letters = F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(.)"), 1))
    return F.coalesce(F.aggregate(letters, F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c))), F.lit(0.0))


def featured(pages: DataFrame, url: str = "url") -> DataFrame:
    """All columns, with host, path, host suffixes and lexical features; a null URL has empty parts and zero features."""
    text = F.coalesce(F.col(url), F.lit(""))
    host, path, rest = parts(F.col(url))
    digits = lambda c: F.length(c) - F.length(F.translate(c, "0123456789", ""))
    count = lambda c, s: F.length(c) - F.length(F.replace(c, F.lit(s)))
    with_parts = pages.withColumns({"host": host, "path": path, "_rest": rest})
    h, p, r = F.col("host"), F.col("path"), F.col("_rest")
    asked = F.split(r, "#")[0]
    return with_parts.withColumns({
        "n_chars": F.length(text), "host_chars": F.length(h), "labels": count(h, "."), "depth": count(p, "/"), "path_chars": F.length(p),
        "params": F.when(F.length(asked) > 1, count(asked, "&") + 1).otherwise(0), "query_chars": F.length(r),
        "digit_ratio": digits(text) / F.greatest(F.length(text), F.lit(1)), "host_digits": digits(h), "hyphens": count(h, "-"),
        "entropy": entropy(text), "host_entropy": entropy(h),
        "top": F.substring_index(h, ".", -1), "second": F.substring_index(h, ".", -2), "lead": F.regexp_extract(p, r"^/([^/]*)/", 1),
    }).drop("_rest")


FOLDS = 5


def with_rates(rows: DataFrame, labelled: DataFrame, apart: bool = False) -> DataFrame:
    """``rows`` with the smoothed share of blocked URLs among the labelled ones of their host suffixes, and all features.

    With ``apart``, for labelled rows themselves, the labelled rows of the same fold do
    not count, so no row's rate holds its own label. Counts go to the rows as a checked broadcast.
    """
    for level in LEVELS:
        key, counts = f"{level}_key", [F.sum("label").alias("_b"), F.count("*").alias("_n")]
        whole = labelled.groupBy(F.col(level).alias(key)).agg(*counts)
        rows = rows.join(broadcast_checked(whole), rows[level] == F.col(key), "left").drop(key)
        blocked, seen = F.coalesce("_b", F.lit(0.0)), F.coalesce("_n", F.lit(0))
        if apart:
            own = labelled.groupBy(F.col(level).alias(key), F.col("fold").alias("_fold")).agg(F.sum("label").alias("_ob"), F.count("*").alias("_on"))
            rows = rows.join(broadcast_checked(own), (rows[level] == F.col(key)) & (rows["fold"] == F.col("_fold")), "left")
            blocked, seen = blocked - F.coalesce("_ob", F.lit(0.0)), seen - F.coalesce("_on", F.lit(0))
        rows = rows.withColumn(f"{level}_rate", (blocked + 0.5) / (seen + 1)).drop("_b", "_n", "_ob", "_on", "_fold", key)
    return VectorAssembler(inputCols=LEXICAL + SUFFIX, outputCol="features", handleInvalid="keep").transform(rows)


def fit(labelled: DataFrame) -> Model | str:
    """Trees from at most ``SAMPLE`` labelled rows (label 1: block), or the only verdict there is.

    Null URLs have empty parts and count as they are labelled; repeated rows fall into
    one fold; an empty table gives allow. Columns besides those of ``featured`` and the label are ignored.
    """
    kinds = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(kinds) < 2:
        return "block" if kinds.get(1.0) else "allow"
    labelled = labelled.withColumn("fold", F.pmod(F.xxhash64("host", "path"), F.lit(FOLDS)))
    sample = labelled.orderBy(F.xxhash64("host", "path", "page_id"), "page_id").limit(SAMPLE)
    sample = cut(with_rates(sample, labelled, apart=True).select("features", "label").repartition(4))
    return GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7, checkpointInterval=-1, subsamplingRate=0.8).fit(sample)


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of every row.

    Null URLs and URLs without :// have empty host and path and are judged by the
    trees alone. Repeated rows are judged each; an empty table gives an empty
    result; columns besides page_id and url are ignored. Where the rules decide
    nothing, or always alike, there is nothing to learn: all other URLs get the
    only verdict known, or allow.
    """
    rows = featured(pages.select("page_id", "url"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "ruling": verdict})
    labelled = rows.filter("ruling is not null").withColumn("label", (F.col("ruling") == "block").cast("double"))
    model = fit(labelled)
    if isinstance(model, str):
        return rows.select("page_id", "host", "path", "rule", F.coalesce("ruling", F.lit(model)).alias("verdict"))
    told = F.when(F.col("prediction") == 1, "block").otherwise("allow")
    return model.transform(with_rates(rows, labelled)).select("page_id", "host", "path", "rule", F.coalesce("ruling", told).alias("verdict"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    return judge(spark.read.parquet(f"{folder}/pages.parquet"))
