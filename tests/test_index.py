"""The stored index against scores from the texts, before and after changes."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import index as I
from corpusloom.operators import retrieve as Q
from corpusloom.plans.search import Search
from corpusloom.plans.tables import Library

COLUMNS = ["qid", "chunk_id", "score", "rank"]


def rows(df):
    return {tuple(r) for r in df.select(*COLUMNS).collect()}


@pytest.fixture(scope="module")
def search(spark, folder):
    return Search(Library(spark, folder))


@pytest.fixture(scope="module")
def built(search, tmp_path_factory):
    """Small shards, so that there are many."""
    return I.Index.build(search.chunks(), str(tmp_path_factory.mktemp("index")), shard=200)


def test_topk_equals_scores_from_texts(search, built):
    want = Q.bm25_topk(search.indexed(), search.queries, 7)
    assert rows(built.topk(search.queries.select("qid", "text"), 7)) == rows(want)


def test_titled_equals_scores_from_texts(search, built):
    want = Q.with_titles(search.indexed(), search.lib.titles(), search.queries)
    asked = search.queries.select("qid", "text")
    assert rows(Q.title_tier_topk(built.titled(asked, 5), 5)) == rows(Q.title_tier_topk(want, 5))
    plain = lambda df: rows(Q.top_per_key(df, ["qid"], Q.by_score(), 5))
    assert plain(built.titled(asked, 5, tier=False)) == plain(want)


def test_blocks_of_queries_and_many_terms(search, built, monkeypatch):
    """Several blocks of queries, and terms that are joined instead of filtered, give the same rows."""
    asked = search.queries.select("qid", "text")
    want = rows(built.topk(asked, 5))
    monkeypatch.setattr(I, "QUERIES", 7)
    assert rows(built.topk(asked, 5)) == want
    monkeypatch.setattr(I, "FILTERED", 3)
    assert rows(built.topk(asked, 5)) == want


def test_changes_equal_a_rebuild(spark, search, tmp_path):
    """Random upserts and deletes, then a merge; versions that are left are still readable."""
    rng = random.Random(3)
    asked = search.queries.select("qid", "text").limit(20)
    ids = [r.chunk_id for r in search.indexed().select("chunk_id").orderBy("chunk_id").collect()]
    first = rng.sample(ids, len(ids) * 2 // 3)
    pick = lambda some: search.indexed().join(spark.createDataFrame([(i,) for i in some], "chunk_id string"), "chunk_id")
    index = I.Index.build(pick(first), str(tmp_path), shard=300)
    old = rows(index.topk(asked, 5))
    alive = dict.fromkeys(first, "plain")
    for step in range(2):
        gone, new = rng.sample(sorted(alive), 60), rng.sample(ids, 80)
        index = index.delete(pick(gone))
        for i in gone:
            alive.pop(i)
        upper = pick(new).withColumn("text", F.concat_ws(" ", "text", F.lit(f"step{step} extra")))
        index = index.upsert(upper, shard=300)
        alive.update(dict.fromkeys(new, step))
    now = search.indexed().join(spark.createDataFrame([(i, str(v)) for i, v in alive.items()], "chunk_id string, v string"), "chunk_id")
    now = now.withColumn("text", F.when(F.col("v") == "plain", F.col("text")).otherwise(F.concat(F.col("text"), F.lit(" step"), F.col("v"), F.lit(" extra"))))
    want = rows(Q.bm25_topk(now, asked, 5))
    assert rows(index.topk(asked, 5)) == want
    again = I.Index.open(spark, str(tmp_path))
    assert again.version == index.version == 5 and rows(again.topk(asked, 5)) == want
    merged = index.merge()
    assert len(merged.segments) == 1 and not merged.dead and rows(merged.topk(asked, 5)) == want
    # A segment that no version names, as a broken write leaves it, changes nothing.
    I.write_segment(I.counted(I.tokens(pick(ids[:50]))), 50, str(tmp_path), 300)
    assert rows(I.Index.open(spark, str(tmp_path)).topk(asked, 5)) == want
    assert rows(I.Index(spark, str(tmp_path), [s for s in index.segments[:1]], [], 1).topk(asked, 5)) == old


def test_filters_are_anded_before_ranking(spark, tmp_path):
    chunks = spark.createDataFrame(
        [(f"c{i}", f"d{i}", "red fox " * (i + 1), i if i else None, "book" if i % 2 else "paper") for i in range(8)],
        "chunk_id string, document_id string, text string, day int, doc_type string")
    # Padding: the words stay rare enough to weigh something.
    chunks = chunks.unionByName(spark.range(40).selectExpr("concat('x', id) chunk_id", "'none' document_id", "'blue bird' text", "1 day", "'book' doc_type"))
    sources = spark.createDataFrame([(f"n{i % 2}:d{i}", f"n{i % 2}", f"d{i}") for i in range(8)], "source_id string, notebook_id string, document_id string")
    index = I.Index.build(chunks, str(tmp_path))

    def found(notebook=None, source_ids=None, types=None, after=None):
        asked = spark.createDataFrame(
            [(1, "fox", notebook, source_ids, types, after)], "qid long, text string, notebook_id string, source_ids array<string>, doc_types array<string>, a string")
        asked = asked.withColumn("date_after", F.to_date("a"))
        return {r.chunk_id for r in index.topk(asked, 50, sources).collect()}

    assert found() == {f"c{i}" for i in range(8)}
    assert found("n1") == {"c1", "c3", "c5", "c7"} and found(source_ids=["n0:d2", "n1:d3"]) == {"c2", "c3"}
    assert found("n1", ["n0:d2", "n1:d3"]) == {"c3"}  # one source row must meet both
    assert found("n1", ["n0:d2"]) == set() and found(source_ids=[]) == {f"c{i}" for i in range(8)} and found("none") == set()
    assert found(types=["paper"]) == {"c0", "c2", "c4", "c6"} and found(after="1970-01-06") == {"c5", "c6", "c7"}  # no day: fails closed


def test_odd_chunks(spark, tmp_path):
    rows_ = [("a", None, None), ("b", "", ""), ("c", "only words here", None), ("c2", "only words here", " "), ("d", "?? !!", "only")]
    chunks = spark.createDataFrame(rows_, "chunk_id string, text string, title string")
    index = I.Index.build(chunks, str(tmp_path / "x"))
    asked = spark.createDataFrame([(1, "only"), (2, ""), (3, None), (4, "unknown")], "qid long, text string")
    assert [(r.qid, r.chunk_id) for r in index.topk(asked, 9).orderBy("rank").collect()] == [(1, "c"), (1, "c2")]
    assert {(r.chunk_id, r.title_match) for r in index.titled(asked, 9).collect()} == {("c", 0), ("c2", 0), ("d", 1)}
    empty = I.Index.build(chunks.limit(0), str(tmp_path / "y"))
    assert empty.topk(asked, 3).collect() == [] and empty.upsert(chunks).topk(asked, 3).count() == 2


def test_pruning_reads_less_and_loses_nothing():
    """Windows that cannot reach the k-th score stay unread."""
    rng = np.random.default_rng(2)
    n = 4096
    lens = np.sort(rng.integers(5, 200, n))
    terms = []
    for t in range(12):
        place = np.sort(rng.choice(n, int(n / (2 + 6 * t)), replace=False))
        tf = rng.geometric(0.6, len(place))
        window = place // I.WINDOW
        first = np.flatnonzero(np.append(True, window[1:] != window[:-1]))
        terms.append({
            "name": f"t{t}", "windows": window[first].astype("<u2").tobytes(), "starts": np.append(first, len(place)).astype("<u4").tobytes(),
            "max_tf": np.maximum.reduceat(tf, first).astype("<u2").tobytes(), "min_dl": np.minimum.reduceat(lens[place], first).astype("<u4").tobytes(),
            "places": (place % I.WINDOW).astype(np.uint8).tobytes(), "tfs": tf.astype("<u2").tobytes()})
    shard = I.Shard(terms, lens, float(lens.mean()), 1.0)
    own = shard.blocks([(f"t{t}", 0.2 + t) for t in range(12)])
    allowed = rng.random(n) < 0.7
    place, score, read = I.pruned(shard, *own, allowed, 10)
    whole = np.zeros(n)
    shard.add(whole, own[0], own[1])
    whole[~allowed] = 0
    want = np.sort(whole)[-10:]
    assert np.allclose(np.sort(score)[-10:], want) and set(np.flatnonzero(whole >= want[0])) <= set(place)
    assert read < 0.6 * len(own[0])


def test_searched_passages_need_no_exchange_and_a_segment_one(spark, folder, tmp_path, monkeypatch):
    s = Search(Library(spark, folder))
    chunks = s.chunks()
    plan = chunks._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    day = F.date_diff("publication_date", F.lit("1970-01-01").cast("date")).alias("day")
    titled = F.when(F.trim("title") != "", F.col("title")).alias("title")
    joined = s.indexed().join(s.lib.versions().select("document_id", titled, day, "doc_type"), "document_id").select(chunks.columns)
    assert chunks.exceptAll(joined).isEmpty() and joined.exceptAll(chunks).isEmpty()
    # A task writes a few shards, so a segment of many shards has more files per bucket than there are shuffle partitions.
    monkeypatch.setattr(I, "TOGETHER", 1)
    name = I.write_segment(I.counted(I.tokens(chunks.limit(400))), 400, str(tmp_path), 4)
    assert name.endswith("-100") and len(list((tmp_path / name / "bucket=-1").glob("*.parquet"))) > 20


def test_a_segment_is_named_by_its_folder_alone(spark, tmp_path):
    chunks = spark.createDataFrame([(f"c{i}", f"d{i}", f"word{i % 7} common", None) for i in range(60)], "chunk_id string, document_id string, text string, title string")
    index = I.Index.build(chunks, str(tmp_path), 20).upsert(chunks.limit(5).withColumn("text", F.lit("late words")), 20)
    for seg in index.segments:
        assert "seg" not in spark.read.parquet(f"{tmp_path}/{seg}").columns
    for rows in (index.docs(), index.postings(), index.live()):
        assert {r.seg for r in rows.select("seg").distinct().collect()} == {*index.segments}
    assert index.live().count() == 60 and index.docs().count() == 65
    found = index.topk(spark.createDataFrame([(1, "late")], "qid long, text string"), 10).collect()
    assert len(found) == 5 and index.merge().topk(spark.createDataFrame([(1, "late")], "qid long, text string"), 10).count() == 5
