"""Text normalisation, repeated-block removal, language, canonical blocks."""

from __future__ import annotations

import math
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import expr as X
from corpusloom.functions.scale import broadcast_checked, cut

MIN_LANGUAGE_CHARS, MAX_LANGUAGES = 5, 500
SKETCH_ROWS, SKETCH_WIDTH = 2, 4096


def _compose(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc(text: Column) -> Column:
    """Canonical composition; Spark has no builtin, so one Arrow function."""
    return F.pandas_udf(_compose, T.StringType())(text)


def clean_prose(text: Column) -> Column:
    """Join hyphenated line breaks, collapse white space, compose."""
    joined = F.regexp_replace(text, f"-{X.WS}*\n{X.WS}*", "")
    return nfc(X.squeeze(joined))


def clean_blocks(blocks: DataFrame) -> DataFrame:
    """Code and equations are only composed; other text is normalised, lists per line."""
    raw = F.col("kind").isin("code", "equation")
    prose = X.squeeze(F.regexp_replace("text", f"-{X.WS}*\n{X.WS}*", ""))
    items = F.array_join(F.transform(F.split("text", "\n"), lambda x: X.squeeze(x)), "\n")
    shaped = blocks.withColumn(
        "text", F.when(raw, F.col("text")).when(F.col("kind") == "list", items).otherwise(prose))
    return shaped.withColumn("text", nfc(F.col("text")))


def drop_repeated(blocks: DataFrame, keep_order: bool = True) -> DataFrame:
    """Drop heading/text that stands on more than half of a document's pages.

    Applies from two pages on, and also to blocks without a page. Distinct pages
    are counted after a map-side distinct; the noise list is joined back.
    """
    comparable = F.col("kind").isin("text", "heading")
    paged = blocks.filter(F.col("page").isNotNull()).select("document_id", "page", "kind", "text").distinct()
    totals = paged.groupBy("document_id").agg(F.count_distinct("page").alias("pages")).filter("pages >= 2")
    seen = paged.filter(comparable & (F.col("text") != "")).groupBy("document_id", "text").agg(F.count_distinct("page").alias("on_pages"))
    noise = seen.join(totals, "document_id").filter("on_pages * 2 > pages").select("document_id", "text")
    others = blocks.filter(~comparable)
    kept = blocks.filter(comparable).join(noise, ["document_id", "text"], "left_anti").select(blocks.columns)
    return kept.unionByName(others)


def _cells(width: int) -> list[Column]:
    """Two counters of a line's hash; a line is not lighter than any of its counters says."""
    return [F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(width)).cast("int") for seed in range(SKETCH_ROWS)]


def source_noise(blocks: DataFrame, share: float = 0.5, least: int = 5, width: int = SKETCH_WIDTH) -> DataFrame:
    """(source, text, documents): headings and text lines in more than ``share`` of a source's documents.

    ``blocks``: source, document_id, kind, text. Counts are of distinct documents
    with a block; sources with fewer than ``least`` documents have no noise, a null
    source is a source of its own. Lines are first counted in ``width`` shared
    counters per source and row, which add up inside tasks before they are shuffled and
    never count a line too low; only lines whose counters are all heavy are counted
    exactly. A row has at most as many heavy counters of a source as its documents have
    lines on average, divided by the share. No text is shuffled but candidates.
    """
    comparable = F.col("kind").isin("text", "heading") & (F.coalesce("text", F.lit("")) != "")
    lines = blocks.select("source", "document_id", F.when(comparable, F.col("text")).alias("text"))
    totals = cut(lines.groupBy("source").agg(F.count_distinct("document_id").alias("_of")).filter(F.col("_of") >= least))
    listed = lines.filter(F.col("text").isNotNull() & F.col("document_id").isNotNull())
    marks = F.array(*[F.struct(F.lit(i).alias("row"), c.alias("cell")) for i, c in enumerate(_cells(width))])
    counted = listed.select("source", F.explode(marks).alias("m")).groupBy("source", "m.row", "m.cell").agg(F.count("*").alias("_n"))
    sizes = broadcast_checked(totals.select(F.col("source").alias("_s"), "_of"))
    heavy = cut(counted.join(sizes, F.col("source").eqNullSafe(F.col("_s"))).filter(F.col("_n") > F.col("_of") * share).select("source", "row", "cell"))
    candidates = listed
    for i, cell in enumerate(_cells(width)):
        marked = broadcast_checked(heavy.filter(F.col("row") == i).select(F.col("source").alias("_s"), F.col("cell").alias("_c")))
        candidates = candidates.join(marked, candidates["source"].eqNullSafe(F.col("_s")) & (cell == F.col("_c")), "left_semi")
    exact = candidates.distinct().groupBy("source", "text").agg(F.count("*").alias("documents"))
    found = exact.join(sizes, F.col("source").eqNullSafe(F.col("_s")))
    return found.filter(F.col("documents") > F.col("_of") * share).select("source", "text", "documents")


def drop_source_noise(blocks: DataFrame, noise: DataFrame) -> DataFrame:
    """Blocks without the noise lines of their source; kinds other than heading and text stay."""
    lines = broadcast_checked(cut(noise.select(F.col("source").alias("_s"), F.col("text").alias("_t"))))
    same = F.col("source").eqNullSafe(F.col("_s")) & (F.col("text") == F.col("_t")) & F.col("kind").isin("text", "heading")
    return blocks.join(lines, same, "left_anti")


def reordinal(blocks: DataFrame) -> DataFrame:
    """Contiguous ordinals from 0 within each document."""
    window = W.partitionBy("document_id").orderBy("ordinal")
    return blocks.withColumn("ordinal", F.row_number().over(window) - 1)


def _grams(word: Column) -> Column:
    padded = F.concat(F.lit(" "), word, F.lit(" "))
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.substring(padded, i, F.lit(3)))


def trigrams(texts: DataFrame, keys: list[str]) -> DataFrame:
    """Character trigrams of every word with its edges, one row each."""
    words = X.unfold(texts, keys, X.search_terms(F.col("text")), "word")
    return X.unfold(words, keys, _grams(F.col("word")), "gram")


def held_out(key: Column) -> Column:
    """A fifth of the rows, by a hash of their key, that profiles are not fitted on."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 4), 16, 10).cast("int") % 5 == 0


def language_profiles(labelled: DataFrame) -> DataFrame:
    """(lang, gram, n, total, vocabulary) from labelled texts (lang, text).

    Words are counted first, combined before the exchange, so that each distinct
    word of a language is cut into grams once.
    """
    words = X.unfold(labelled, ["lang"], X.search_terms(F.col("text")), "word").groupBy("lang", "word").agg(F.count("*").alias("times"))
    counts = X.unfold(words, ["lang", "times"], _grams(F.col("word")), "gram").groupBy("lang", "gram").agg(F.sum("times").alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"), F.count("*").alias("vocabulary"))
    # Read for gains and for totals, and far smaller than the texts: stored once.
    return cut(counts.join(broadcast_checked(totals), "lang"))


def detect_language(texts: DataFrame, profiles: DataFrame) -> DataFrame:
    """Best language per text by smoothed trigram likelihood.

    A gram a language has not seen adds ln(1) - ln(total + vocabulary), so only
    seen grams carry a gain and the rest enters through the gram count of the
    text. Gains of all languages stand in one row per gram: each gram occurrence
    meets one row, and texts, hashed by id once, are summed in place.
    """
    totals = profiles.select("lang", (F.col("total") + F.col("vocabulary")).alias("base")).distinct().limit(
        MAX_LANGUAGES + 1).toPandas()
    if len(totals) > MAX_LANGUAGES:
        raise ValueError("too many languages in the profiles")
    languages = sorted(totals["lang"])
    base = {lang: math.log(n) for lang, n in zip(totals["lang"], totals["base"])}
    gains = profiles.groupBy("gram").pivot("lang", languages).agg(F.first(F.log(F.col("n") + 1)))
    long_enough = F.length(F.trim("text")) >= MIN_LANGUAGE_CHARS
    rows = texts.filter(long_enough).select("text_id", "text").repartition("text_id")
    hits = trigrams(rows, ["text_id"]).join(broadcast_checked(gains), "gram", "left")
    summed = hits.groupBy("text_id").agg(F.count("*").alias("_length"), *[F.sum(f"`{lang}`").alias(lang) for lang in languages])
    scores = [
        F.when(F.col(f"`{lang}`").isNotNull(), F.struct(
            X.rounded(F.col(f"`{lang}`") - F.col("_length") * base[lang]).alias("score"), F.lit(lang).alias("lang")))
        for lang in languages]
    best = summed.select("text_id", F.array_max(F.array(*scores))["lang"].alias("lang"))
    return texts.select("text_id").join(best, "text_id", "left")


def canonicalize(blocks: DataFrame, assets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Raw to canonical blocks; images and assets must match one to one.

    ``blocks``: document_id, ordinal, kind, text, local_id. ``assets``:
    document_id, local_id, asset_id. Unmatched rows of either side are rejects.
    """
    images = blocks.filter("kind = 'image'").select("document_id", "local_id", F.lit(True).alias("used"))
    matched = images.join(assets, ["document_id", "local_id"], "full_outer")
    rejects = matched.filter("used is null or asset_id is null").select(
        "document_id", "local_id", F.when(F.col("used").isNull(), "unexpected asset").otherwise("missing asset").alias("reason"))
    bad = rejects.select("document_id").distinct()
    linked = blocks.join(assets, ["document_id", "local_id"], "left").join(bad, "document_id", "left_anti")
    kind = F.when(F.col("kind") == "list", "text").when(F.col("kind") == "math", "equation").otherwise(F.col("kind"))
    return linked.select("document_id", "ordinal", kind.alias("kind"), "text", "asset_id"), rejects
