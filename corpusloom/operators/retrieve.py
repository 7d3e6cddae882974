"""Lexical and dense top-k for batches of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import expr as X
from corpusloom.functions.scale import BROADCAST_ROWS, broadcast_checked, cut, top_per_key

# BM25 constants and the floor of the inverse document frequency.
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
TITLE_WEIGHT = 3.0
DENSE_BLOCK = 4096


def query_terms(queries: DataFrame) -> DataFrame:
    """(qid, term, qtf): letter/mark/number runs; a repeated term counts again."""
    spread = X.unfold(queries, ["qid"], X.search_terms(F.col("text")), "term")
    return spread.groupBy("qid", "term").agg(F.count("*").cast("int").alias("qtf"))


def postings(chunks: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(chunk_id, dl, term, tf): the inverted table.

    Chunks are hashed by id once; counting terms per chunk, and any later sum per
    (query, chunk), then finds its rows in place.
    """
    keep = keep or []
    rows = chunks.select("chunk_id", *keep, "text").repartition("chunk_id").select(
        "chunk_id", *keep, X.search_terms(F.col("text")).alias("terms"))
    spread = X.unfold(rows, ["chunk_id", *keep, F.size("terms").alias("dl")], F.col("terms"), "term")
    return spread.groupBy("chunk_id", *keep, "dl", "term").agg(F.count("*").alias("tf"))


def corpus_statistics(chunks: DataFrame, terms: DataFrame, small: bool) -> tuple[DataFrame, int, float]:
    """Document frequencies of the wanted terms, chunk count and mean length.

    The empty term stands for "the chunk itself", so that one map-side combined
    aggregation yields all three. Only one row of totals reaches the driver.
    ``small`` says that the query terms were seen to fit a broadcast.
    """
    spark = chunks.sparkSession
    wanted = terms.select("term").distinct().unionByName(spark.range(1).select(F.lit("").alias("term")))
    rows = chunks.select(X.search_terms(F.col("text")).alias("terms"))
    marks = F.array_append(F.array_distinct("terms"), F.lit(""))
    spread = X.unfold(rows, [F.size("terms").alias("dl")], marks, "term")
    counted = cut(
        spread.join(F.broadcast(wanted) if small else wanted, "term", "left_semi")
        .groupBy("term").agg(F.count("*").alias("df"), F.sum("dl").alias("length")))
    total = counted.filter("term = ''").first()
    n, length = (total["df"], total["length"]) if total else (0, 0)
    return counted.filter("term <> ''").select("term", "df"), n, (length / n if n else 1.0)


def lexical_scores(
    chunks: DataFrame, queries: DataFrame, weight: float = 1.0, keep: list[str] | None = None
) -> DataFrame:
    """(qid, chunk_id, score) of every chunk that shares a term with the query.

    Statistics are corpus-wide. Postings stay where their chunk was hashed to, so
    the sum per (query, chunk) and the partial top-k after it need no exchange: no
    table of queries times chunks is ever shuffled.
    """
    keep = keep or []
    terms = cut(query_terms(queries))
    small = terms.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    frequencies, n, mean_length = corpus_statistics(chunks, terms, small)
    idf = F.greatest(F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(IDF_FLOOR))
    weights = terms.join(frequencies, "term").select("qid", "term", (idf * F.col("qtf")).alias("w"))
    tf = F.col("tf") * weight
    gain = tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.lit(float(mean_length))))
    found = postings(chunks, keep).select("chunk_id", *keep, "term", gain.alias("gain"))
    hits = found.join(F.broadcast(weights) if small else weights, "term")
    return hits.groupBy("qid", "chunk_id", *keep).agg(X.rounded(F.sum(F.col("w") * F.col("gain"))).alias("score"))


#: What filters are told by: of queries (keys: names of which a document must have one) and of chunks (members: its names).
QUERY_FILTERS = {"keys": "array<string>", "after": "int", "before": "int", "kinds": "array<string>"}
CHUNK_FILTERS = {"members": "array<string>", "day": "int", "doc_type": "string"}


def _with_nulls(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.withColumns({name: F.lit(None).cast(kind) for name, kind in columns.items() if name not in df.columns})


def filters_of(queries: DataFrame, sources: DataFrame | None) -> DataFrame:
    """(qid, after, before, kinds, keys): days, document types, and names of memberships of which one must hold.

    ``queries`` may have notebook_id, source_ids, doc_types, date_after, date_before. A
    source must lie in the asked notebook, as one source row must meet both; a query
    whose sources all lie elsewhere keeps an empty list and finds nothing.
    """
    epoch = F.lit("1970-01-01").cast("date")
    have = set(queries.columns)
    day = lambda c: F.date_diff(c, epoch) if c in have else F.lit(None).cast("int")
    given = lambda c, kind: F.col(c) if c in have else F.lit(None).cast(kind)
    rows = queries.select(
        "qid", day("date_after").alias("after"), day("date_before").alias("before"), given("doc_types", "array<string>").alias("kinds"),
        given("notebook_id", "string").alias("notebook_id"), given("source_ids", "array<string>").alias("source_ids"))
    if sources is None:
        return rows.select("qid", "after", "before", "kinds", F.lit(None).cast("array<string>").alias("keys"))
    book = F.when(F.col("notebook_id").isNotNull(), F.array(F.concat(F.lit("n:"), "notebook_id")))
    if "source_ids" not in have or "source_id" not in sources.columns:
        return rows.select("qid", "after", "before", "kinds", book.alias("keys"))
    named = rows.filter("size(source_ids) > 0").select("qid", "notebook_id", F.explode("source_ids").alias("source_id"))
    own = sources.select("source_id", F.col("notebook_id").alias("book")).distinct()
    fit = own.join(broadcast_checked(named), "source_id").filter("notebook_id is null or notebook_id = book")
    fit = fit.groupBy("qid").agg(F.collect_set(F.concat(F.lit("s:"), "source_id")).alias("own"))
    asked = F.coalesce(F.size("source_ids") > 0, F.lit(False))
    keys = F.when(asked, F.coalesce("own", F.array().cast("array<string>"))).otherwise(book)
    return rows.join(fit, "qid", "left").select("qid", "after", "before", "kinds", keys.alias("keys"))


def members_of(sources: DataFrame) -> DataFrame:
    """(document_id, name): the notebooks (n:) and sources (s:) that a document is in."""
    names = [F.concat(F.lit(mark), column) for mark, column in (("n:", "notebook_id"), ("s:", "source_id")) if column in sources.columns]
    return sources.select("document_id", F.explode(F.array(*names)).alias("name"))


def by_score() -> list:
    return [F.col("score").desc(), F.col("chunk_id")]


def _best(key: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest keys, ties by id."""
    if len(key) > k:
        floor = np.partition(key, len(key) - k)[len(key) - k]
        kept = np.flatnonzero(key >= floor)
    else:
        kept = np.arange(len(key))
    return kept[np.lexsort((ids[kept].astype(str), -key[kept]))[:k]]


def bm25_topk(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Without a stored index: one pass over the texts. ``index.Index.topk`` reads postings instead."""
    return top_per_key(lexical_scores(chunks, queries), ["qid"], by_score(), k)


def with_titles(chunks: DataFrame, titles: DataFrame, queries: DataFrame) -> DataFrame:
    """Text and title branches united: best score and any title match per chunk.

    ``titles`` has one row (chunk_id, text) per chunk of a titled version.
    """
    text = lexical_scores(chunks, queries).withColumn("title_match", F.lit(0))
    title = lexical_scores(titles, queries, TITLE_WEIGHT).withColumn("title_match", F.lit(1))
    return text.unionByName(title).groupBy("qid", "chunk_id").agg(
        F.max("score").alias("score"), F.max("title_match").alias("title_match"))


def title_tier_topk(scored: DataFrame, k: int) -> DataFrame:
    """Select k by title match, then score; emit in score order."""
    tier = [F.col("title_match").desc(), *by_score()]
    bounded = top_per_key(scored, ["qid"], tier, k, "tier")
    return top_per_key(bounded.drop("tier"), ["qid"], by_score(), k)


def _filter_side(queries: pd.DataFrame) -> dict:
    keys = [None if k is None else list(k) for k in queries["keys"]]
    names = sorted({name for k in keys for name in k or []})
    return {
        "qid": queries["qid"].to_numpy(),
        "names": {name: i for i, name in enumerate(names)},
        "keys": np.array([[k is not None and name in k for k in keys] for name in names], dtype=bool).reshape(len(names), len(keys)),
        "free": np.array([k is None for k in keys], dtype=bool),
        "kinds": [None if t is None else set(t) for t in queries["kinds"]],
        "after": pd.to_numeric(queries["after"]).fillna(-np.inf).to_numpy(dtype=float),
        "before": pd.to_numeric(queries["before"]).fillna(np.inf).to_numpy(dtype=float),
        "dated": (queries["after"].notna() | queries["before"].notna()).to_numpy(),
    }


def _query_side(queries: pd.DataFrame) -> dict:
    vectors = np.vstack([np.asarray(v, dtype=np.float64) for v in queries["vec"]])
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return {**_filter_side(queries), "unit": vectors / np.where(norms == 0, 1.0, norms)}


def _allowed(chunks: pd.DataFrame, side: dict) -> np.ndarray:
    """Which (chunk, query) pairs pass membership, dates and types; a missing date or type fails closed."""
    codes, kinds = pd.factorize(chunks["doc_type"])
    typed = np.array([[t is None or kind in t for t in side["kinds"]] for kind in kinds] + [[t is None for t in side["kinds"]]])
    inside_any = np.zeros((len(chunks), len(side["qid"])), dtype=bool) | side["free"][None, :]
    names = side["names"]
    if names:
        for i, own in enumerate(chunks["members"]):
            rows = [names[name] for name in (own if own is not None else ()) if name in names]
            if rows:
                inside_any[i] |= side["keys"][rows].any(axis=0)
    days = pd.to_numeric(chunks["day"]).to_numpy(dtype=float)[:, None]
    with np.errstate(invalid="ignore"):
        inside = (days >= side["after"][None, :]) & (days <= side["before"][None, :])
    return inside_any & (inside | ~side["dated"][None, :]) & typed[codes]


def _partial_topk(chunks: pd.DataFrame, side: dict, k: int) -> pd.DataFrame:
    """Best k chunks of one batch for every query, ties by id."""
    vectors = np.vstack([np.asarray(v, dtype=np.float64) for v in chunks["vec"]])
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    scores = np.round((vectors / np.where(norms == 0, 1.0, norms)) @ side["unit"].T, 6) + 0.0
    allowed = _allowed(chunks, side)
    ids = chunks["chunk_id"].to_numpy(dtype=object)
    out: list[list] = [[], [], []]
    for column, qid in enumerate(side["qid"]):
        rows = np.flatnonzero(allowed[:, column])
        if len(rows):
            best = rows[_best(scores[rows, column], ids[rows], k)]
            for target, values in zip(out, ([qid] * len(best), ids[best], scores[best, column])):
                target.extend(values)
    return pd.DataFrame({
        "qid": pd.Series(out[0], dtype="int64"), "chunk_id": pd.Series(out[1], dtype=object), "score": pd.Series(out[2], dtype="float64")})


def dense_topk(chunks: DataFrame, queries: DataFrame, k: int, block: int = DENSE_BLOCK) -> DataFrame:
    """Exact cosine top-k; filters first.

    ``chunks``: chunk_id, vec and optionally members, day, doc_type. ``queries``: qid, vec
    and optionally keys, after, before (days as integers), kinds. A query with keys sees
    only chunks with one of them among their members.

    Up to ``block`` queries travel to the tasks as one matrix; each Arrow batch of
    chunks is one matrix product and emits at most k rows per query. Beyond that,
    chunks and queries are tiled and every pair of tiles meets in one group of
    bounded size, so nothing passes through the driver.
    """
    spark = chunks.sparkSession
    left = _with_nulls(chunks, CHUNK_FILTERS).select("chunk_id", "vec", *CHUNK_FILTERS)
    right = _with_nulls(queries, QUERY_FILTERS).select("qid", "vec", *QUERY_FILTERS)
    schema = "qid long, chunk_id string, score double"
    head = right.limit(block + 1).toPandas()
    if len(head) == 0:
        return spark.createDataFrame([], schema + ", rank int")
    if len(head) <= block:
        shared = spark.sparkContext.broadcast(_query_side(head))

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            step = max(1, 2_000_000 // len(shared.value["qid"]))
            for batch in batches:
                for low in range(0, len(batch), step):
                    yield _partial_topk(batch.iloc[low:low + step], shared.value, k)

        partial = left.mapInPandas(score, schema)
    else:
        partial = _tiled(left, right, k, block, schema)
    return top_per_key(partial, ["qid"], by_score(), k)


def _tiled(left: DataFrame, right: DataFrame, k: int, block: int, schema: str) -> DataFrame:
    """Fragment-and-replicate: every tile of chunks meets every tile of queries once."""
    rows = max(1, -(-left.count() // block))
    cols = max(1, -(-right.count() // block))
    tiles = (
        left.withColumn("r", F.pmod(F.xxhash64("chunk_id"), F.lit(rows)).cast("int"))
        .withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(cols - 1)))))
    asked = (
        right.withColumn("c", F.pmod(F.xxhash64("qid"), F.lit(cols)).cast("int"))
        .withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))))

    def meet(chunk_tile: pd.DataFrame, query_tile: pd.DataFrame) -> pd.DataFrame:
        if not len(query_tile):
            return pd.DataFrame({"qid": [], "chunk_id": [], "score": []})
        return _partial_topk(chunk_tile, _query_side(query_tile), k)

    return tiles.groupBy("r", "c").cogroup(asked.groupBy("r", "c")).applyInPandas(meet, schema)


def filtered_dense(
    vectors: DataFrame, queries: DataFrame, query_vectors: DataFrame,
    versions: DataFrame, sources: DataFrame, k: int,
) -> DataFrame:
    """Cosine top-k among the chunks that pass each query's filters. A chunk has one row, whatever it is a member of."""
    epoch = F.lit("1970-01-01").cast("date")
    asked = cut(queries.select("qid").join(query_vectors, "qid").join(filters_of(queries, sources), "qid"))
    wanted = asked.select(F.explode("keys").alias("name")).distinct()
    member = members_of(sources).join(broadcast_checked(wanted), "name").groupBy("document_id").agg(F.collect_set("name").alias("members"))
    kind = F.col("doc_type") if "doc_type" in versions.columns else F.lit(None).cast("string")
    dated = versions.select("document_id", F.date_diff("publication_date", epoch).alias("day"), kind.alias("doc_type"))
    rows = vectors.join(dated, "document_id").join(member, "document_id", "left")
    return dense_topk(rows, asked, k)


def _inverted(vectors: DataFrame, query_vectors: DataFrame, lists: int, sample: int) -> tuple[DataFrame, DataFrame]:
    """Chunks (chunk_id, vec, list, part), and queries for every list that holds chunks.

    Queries: qid, vec, list, part, place (1 for the nearest list) and bound, which no
    cosine in the list exceeds: the list's widest angle to its centroid is known.
    """
    spark = vectors.sparkSession
    head = vectors.orderBy(F.xxhash64("chunk_id"), "chunk_id").select("vec").limit(sample).toPandas()
    centroids = _centroids(np.array(head["vec"].tolist(), dtype=float), lists) if len(head) else np.zeros((1, 1))
    shared = spark.sparkContext.broadcast(centroids)

    def nearest(count: int):
        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    rows = np.array(batch["vec"].tolist(), dtype=float)
                    dots = rows @ shared.value.T
                    near = np.argsort(-dots, axis=1, kind="stable")[:, :count]
                    norms = np.linalg.norm(rows, axis=1, keepdims=True)
                    angles = np.arccos(np.clip(np.take_along_axis(dots, near, axis=1) / np.where(norms == 0, 1.0, norms), -1, 1))
                    yield batch.assign(lists=list(near.astype("int32")), angles=list(angles))
        return assign

    schema = "vec array<double>, lists array<int>, angles array<double>"
    placed = vectors.select("chunk_id", "vec").mapInPandas(nearest(1), f"chunk_id string, {schema}").select(
        "chunk_id", "vec", F.element_at("lists", 1).alias("list"), F.element_at("angles", 1).alias("angle"))
    parts = cut(placed.groupBy("list").agg(
        F.ceil(F.count("*") / DENSE_BLOCK).cast("int").alias("parts"), F.max("angle").alias("radius")))  # one row per list
    chunks = placed.join(F.broadcast(parts), "list").select(
        "chunk_id", "vec", "list", F.pmod(F.xxhash64("chunk_id"), "parts").cast("int").alias("part"))
    asked = query_vectors.select("qid", "vec").mapInPandas(nearest(len(centroids)), f"qid long, {schema}")
    asked = asked.select("qid", "vec", F.posexplode(F.arrays_zip("lists", "angles")).alias("at", "l")).select(
        "qid", "vec", F.col("l.lists").alias("list"), (F.col("at") + 1).alias("place"), F.col("l.angles").alias("angle"))
    bound = F.cos(F.greatest(F.col("angle") - F.col("radius"), F.lit(0.0)))
    return chunks, asked.join(F.broadcast(parts), "list").select(
        "qid", "vec", "list", "place", bound.alias("bound"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))


def ann_candidates(
    vectors: DataFrame, query_vectors: DataFrame, lists: int = 16, probes: int = 8, sample: int = 20_000
) -> tuple[DataFrame, DataFrame]:
    """Inverted file: chunks (chunk_id, vec, list, part) and queries (qid, vec, list, part) that meet first.

    Centroids are fitted on at most ``sample`` vectors, in the order of a hash;
    every chunk enters the list of its nearest centroid, every query asks
    ``probes`` lists. Long lists are parted, so a group has a bounded number of
    chunks. Vectors without clusters need many probes for the same recall.
    """
    chunks, asked = _inverted(vectors, query_vectors, lists, sample)
    return chunks, asked.filter(F.col("place") <= probes).select("qid", "vec", "list", "part")


def _centroids(rows: np.ndarray, lists: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means of a bounded sample."""
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    unit = rows / np.where(norms == 0, 1.0, norms)
    centres = unit[np.linspace(0, len(unit) - 1, min(lists, len(unit))).astype(int)].copy()
    for _ in range(rounds):
        owner = np.argmax(unit @ centres.T, axis=1)
        for j in range(len(centres)):
            if (owner == j).any():
                mean = unit[owner == j].mean(axis=0)
                centres[j] = mean / (np.linalg.norm(mean) or 1.0)
    return centres


def _meet(chunks: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    def meet(tile: pd.DataFrame, questions: pd.DataFrame) -> pd.DataFrame:
        if not len(questions) or not len(tile):
            return pd.DataFrame({
                "qid": pd.Series([], dtype="int64"), "chunk_id": pd.Series([], dtype=object), "score": pd.Series([], dtype="float64")})
        none = {"keys": None, "after": np.nan, "before": np.nan, "kinds": None}
        return _partial_topk(tile.assign(members=None, day=np.nan, doc_type=None), _query_side(questions.assign(**none)), k)

    return chunks.groupBy("list", "part").cogroup(asked.groupBy("list", "part")).applyInPandas(meet, "qid long, chunk_id string, score double")


def unread_lists(asked: DataFrame, first: DataFrame, k: int, probes: int) -> DataFrame:
    """Queries and lists beyond the first ``probes`` whose bound reaches the k-th score of ``first``, or that lack k results."""
    kth = first.groupBy("qid").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
    left = asked.filter(F.col("place") > probes).join(kth, "qid", "left")
    return left.filter(F.col("kth").isNull() | (F.col("bound") + 1e-6 >= F.col("kth"))).select("qid", "vec", "list", "part")  # scores have 6 decimals


def ann_topk(vectors: DataFrame, query_vectors: DataFrame, k: int, lists: int = 16, probes: int = 8) -> DataFrame:
    """Cosine top-k by an inverted file: the nearest lists first, then those that can still hold a better chunk.

    Nothing is lost. Clustered vectors leave most lists unread; vectors without
    clusters have wide lists, which are all read.
    """
    chunks, asked = _inverted(vectors, query_vectors, lists, 20_000)
    first = cut(top_per_key(_meet(chunks, asked.filter(F.col("place") <= probes), k), ["qid"], by_score(), k).drop("rank"))
    more = _meet(chunks, unread_lists(asked, first, k, probes), k)
    return top_per_key(first.unionByName(more), ["qid"], by_score(), k)
