"""Operators against brute force in plain Python on small fixtures."""

import heapq
import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import expr as X
from corpusloom.functions.scale import running_number
from corpusloom.operators import chunk as H
from corpusloom.operators import classify as C
from corpusloom.operators import clean as N
from corpusloom.operators import context as K
from corpusloom.operators import library as B
from corpusloom.operators import rank as R
from corpusloom.operators import quantise
from corpusloom.operators import retrieve as Q
from corpusloom.operators import threads as M
from corpusloom.plans import tables
from corpusloom.sources import files as S
from corpusloom.sources import tabular


def test_uuid5_matches_python(spark):
    import uuid

    names = ["a", "citation:v1:x:1:é", ""]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", X.uuid5(F.col("n")).alias("u")).collect()
    assert all(r.u == str(uuid.uuid5(uuid.NAMESPACE_URL, r.n)) for r in rows)


def test_token_counts_add_up_over_white_space(spark):
    rng = random.Random(3)
    words = ["word", "x.", "(ab", "12345", "é", "--", "a1b2", "Ünï"]
    rows = [(rng.choice(words) + rng.choice(words), rng.choice([" ", "\n\n", "\n"]), rng.choice(words)) for _ in range(200)]
    df = spark.createDataFrame(rows, "a string, s string, b string").select(
        X.token_count(F.concat("a", "s", "b")).alias("whole"),
        (X.token_count(F.col("a")) + X.token_count(F.concat("s", "b"))).alias("parts"))
    assert df.filter("whole <> parts").count() == 0


def python_pack(units, target, limit):
    """units: (text, sep, key, start); the straightforward sequential packing."""
    chunks = []
    for unit in units:
        if chunks:
            cur = chunks[-1]
            joined = cur["n"] + unit["jc"]
            if cur["key"] == unit["key"] and unit["start"] <= cur["end"] + 1 and (
                    joined <= target or (cur["n"] < 15 and joined <= limit)):
                cur.update(n=joined, end=unit["start"], text=cur["text"] + unit["sep"] + unit["t"])
                continue
        chunks.append({"n": unit["c"], "first": unit, "key": unit["key"], "end": unit["start"], "text": unit["t"]})
    if len(chunks) > 1 and chunks[-1]["n"] < 15:
        last, prev = chunks[-1], chunks[-2]
        joined = prev["n"] + last["n"] - last["first"]["c"] + last["first"]["jc"]
        if prev["key"] == last["key"] and last["first"]["start"] <= prev["end"] + 1 and joined <= limit:
            prev["text"] += last["first"]["sep"] + last["text"]
            chunks.pop()
    return [c["text"] for c in chunks]


def test_packing_equals_sequential_loop(spark, folder):
    blocks = tables.Library(spark, folder).blocks()
    docs = H.generic_units(blocks, 96, 192).cache()
    packed = H.pack(docs, 96, 192).orderBy("document_id", "chunk_no").collect()
    got = {}
    for row in packed:
        got.setdefault(row.document_id, []).append(row.text)
    for row in docs.collect():
        units = [
            {"t": u.t, "sep": u.sep, "c": u.c, "jc": u.jc, "start": u.start,
             "key": (u.mkey, u.section) if u.ok else (u.mkey, u.section, i)} for i, u in enumerate(row.us)]
        assert got.get(row.document_id, []) == python_pack(units, 96, 192)


def test_chunks_stay_within_the_maximum_and_cover_the_text(spark, folder):
    lib = tables.Library(spark, folder)
    chunks, rejects = H.chunk_generic(lib.blocks(), 96, 1024)
    assert chunks.filter(X.token_count(F.col("text")) > 192).count() == 0
    assert chunks.join(rejects, "document_id", "left_semi").count() == 0


def test_skipped_heading_level_keeps_the_deeper_heading(spark):
    rows = [("d", 0, "heading", 1, "A"), ("d", 1, "text", None, "x"), ("d", 2, "heading", 3, "C"), ("d", 3, "text", None, "y"),
            ("d", 4, "heading", 2, "B"), ("d", 5, "text", None, "z"), ("d", 6, "heading", 3, "D"), ("d", 7, "text", None, "w")]
    df = spark.createDataFrame(rows, "document_id string, ordinal int, kind string, level int, text string")
    got = {r.ordinal: r.path for r in H.heading_paths(df).collect()}
    assert got == {1: ["A"], 3: ["A", "C"], 5: ["A", "B"], 7: ["A", "B", "D"]}


def test_word_over_the_maximum_refuses_the_document(spark):
    rows = [("bad", 0, "text", None, "a1" * 400 + " end", 1), ("good", 0, "text", None, "plain words here", 1)]
    df = spark.createDataFrame(rows, "document_id string, ordinal int, kind string, level int, text string, page int")
    chunks, rejects = H.chunk_generic(df, 16, 32)
    assert [r.document_id for r in rejects.collect()] == ["bad"]
    assert [r.document_id for r in chunks.collect()] == ["good"]


def test_line_windows_join_back(spark, folder):
    docs = tables.Library(spark, folder).documents().select(F.col("doc_id").cast("string").alias("symbol"), "text")
    parts = H.line_windows(docs, 60).groupBy("symbol").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part_index", "text"))), lambda p: p["text"]), "").alias("joined"))
    assert docs.join(parts, "symbol").filter("text <> joined").count() == 0


def test_greedy_batches_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(tabular, "BLOCK", 64)
    rng = random.Random(5)
    costs = [rng.choice([1, 5, 30, 200, 500]) for _ in range(1000)]
    rows = [("f", i, c, 9) for i, c in enumerate(costs)]
    df = spark.createDataFrame(rows, "file_id string, row_no long, cost int, header_cost int")
    got = [r.batch for r in tabular.greedy_batches(df, 400, 50).orderBy("row_no").collect()]
    want, used, held, batch = [], 9, 0, 0
    for cost in costs:
        if held and (used + cost > 400 or held >= 50):
            batch, used, held = batch + 1, 9, 0
        used, held = used + cost, held + 1
        want.append(batch)
    assert got == want


def test_running_number_for_one_hot_key(spark):
    rows = [("hot" if i % 3 else "k%d" % (i % 7), (i * 7919) % 1000) for i in range(1000)]
    df = spark.createDataFrame(rows, "k string, v int")
    got = {(r.k, r.v): r.n for r in running_number(df, ["k"], [F.col("v")], "n").collect()}
    by_key = {}
    for k, v in sorted(rows):
        by_key.setdefault(k, []).append(v)
    assert got == {(k, v): i + 1 for k, vs in by_key.items() for i, v in enumerate(sorted(vs))}


def test_thread_order_equals_heap_order(spark):
    rng = random.Random(11)
    n = 120
    parents = {i: None for i in range(n)}
    order = list(range(n))
    rng.shuffle(order)
    for pos, node in enumerate(order):
        if pos and rng.random() < 0.85:
            parents[node] = order[rng.randrange(pos)]
    df = spark.createDataFrame([(k, v) for k, v in parents.items()], "source_index long, parent long")
    got = [r.source_index for r in M.order_keys(df).orderBy("order_key").collect()]
    children, ready, want = {}, [], []
    for child, parent in parents.items():
        children.setdefault(parent, []).append(child)
    ready = list(children[None])
    heapq.heapify(ready)
    while ready:
        node = heapq.heappop(ready)
        want.append(node)
        for child in children.get(node, []):
            heapq.heappush(ready, child)
    assert got == want


def test_cycles_and_components(spark):
    parents = spark.createDataFrame(
        [(1, 2), (2, 3), (3, 1), (4, 1), (5, None), (6, 5), (7, 7)], "source_index long, parent long")
    assert {r.source_index for r in M.cycle_members(parents).collect()} == {1, 2, 3, 7}
    chain = [("n%03d" % i, "n%03d" % (i + 1)) for i in range(60)] + [("z1", "z2")]
    edges = spark.createDataFrame(chain, "parent string, child string")
    nodes = edges.selectExpr("explode(array(parent, child)) id").distinct()
    labels = {r.id: r.component for r in M.components(nodes, edges).collect()}
    assert set(labels.values()) == {"n000", "z1"} and labels["n060"] == "n000"


def test_tiled_dense_equals_broadcast(spark, folder):
    lib = tables.Library(spark, folder)
    whole = Q.dense_topk(lib.vectors(), lib.query_vectors(), 5).collect()
    tiled = Q.dense_topk(lib.vectors(), lib.query_vectors(), 5, block=16).collect()
    key = lambda rows: {(r.qid, r.chunk_id, r.score, r["rank"]) for r in rows}
    assert key(whole) == key(tiled)


def test_ann_recall(spark, folder):
    lib = tables.Library(spark, folder)
    exact = {(r.qid, r.chunk_id) for r in Q.dense_topk(lib.vectors(), lib.query_vectors(), 10).collect()}
    near = {(r.qid, r.chunk_id) for r in Q.ann_topk(lib.vectors(), lib.query_vectors(), 10).collect()}
    assert len(exact & near) / len(exact) > 0.75
    chunks, asked = Q.ann_candidates(lib.vectors(), lib.query_vectors())
    pairs = chunks.join(asked, ["list", "part"]).count()
    assert pairs < 0.6 * lib.vectors().count() * lib.query_vectors().count()


def test_quantised_search(spark):
    """Nine tenths of the true neighbours with a fraction of the exact distances; odd vectors do no harm."""
    lib = tables.Library(spark, "/root/testdata/sf0.01")
    vectors, asked = lib.vectors(), lib.query_vectors()
    exact = {(r.qid, r.chunk_id): (r.score, r["rank"]) for r in Q.dense_topk(vectors, asked, 10).collect()}
    coded = quantise.encode(vectors)
    found = {(r.qid, r.chunk_id): (r.score, r["rank"]) for r in quantise.topk(coded, asked, 10).collect()}
    assert len(exact.keys() & found.keys()) / len(exact) >= 0.9
    assert all(found[x][0] == exact[x][0] for x in exact.keys() & found.keys())
    assert quantise.candidates(coded, asked, 10).count() <= 0.3 * vectors.count() * asked.count()
    odd = spark.createDataFrame([("z", [0.0, 0.0, 0.0]), ("n", None), ("a", [1.0, 0.0, 0.0]), ("b", [1.0, 0.0, 0.0])], "chunk_id string, vec array<double>")
    one = spark.createDataFrame([(1, [2.0, 0.0, 0.0]), (2, None)], "qid long, vec array<double>")
    got = quantise.topk(quantise.encode(odd), one, 3).orderBy("rank").collect()
    assert [(r.qid, r.chunk_id, r.score) for r in got] == [(1, "a", 1.0), (1, "b", 1.0), (1, "z", 0.0)]
    assert quantise.topk(quantise.encode(odd.limit(0)), one, 3).collect() == []


def test_quantised_search_holds_few_rows_and_queries_at_a_time(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vectors = spark.createDataFrame([(f"v{i:03}", v.tolist()) for i, v in enumerate(rng.normal(size=(300, 10)))], "chunk_id string, vec array<double>").coalesce(1)
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(7, 10)))], "qid long, vec array<double>")
    books, whole = quantise.fit(vectors), quantise.pieces
    want = sorted(map(tuple, quantise.topk(quantise.encode(vectors, books), asked, 3).collect()))

    def few(rows, piece):
        assert len(rows) <= 16, "a whole batch at once"
        return whole(rows, piece)

    monkeypatch.setattr(quantise, "pieces", few)
    monkeypatch.setattr(quantise, "ROWS", 16)
    monkeypatch.setattr(quantise, "ASKED", 2)
    assert sorted(map(tuple, quantise.topk(quantise.encode(vectors, books), asked, 3).collect())) == want and len(want) == 21
    odd = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0, 2.0, 3.0, 4.0])], "chunk_id string, vec array<double>").coalesce(1)
    with pytest.raises(Exception, match="differ in length"):
        quantise.encode(odd, books).collect()


def test_ann_leaves_far_lists_unread(spark):
    rng = np.random.default_rng(5)
    rows = [(f"c{i:04d}", (np.eye(16)[i % 16] + 0.02 * rng.normal(size=16)).tolist()) for i in range(800)]
    vectors = spark.createDataFrame(rows, "chunk_id string, vec array<double>")
    asked = spark.createDataFrame([(i, rows[i * 37][1]) for i in range(20)], "qid long, vec array<double>")
    exact = {(r.qid, r.chunk_id) for r in Q.dense_topk(vectors, asked, 10).collect()}
    assert {(r.qid, r.chunk_id) for r in Q.ann_topk(vectors, asked, 10, probes=1).collect()} == exact
    chunks, every = Q._inverted(vectors, asked, 16, 20_000)
    first = Q._meet(chunks, every.filter("place <= 1"), 10)
    top = Q.top_per_key(first, ["qid"], Q.by_score(), 10)
    assert Q.unread_lists(every, top, 10, 1).count() < 0.2 * 20 * 16


def test_ann_prunes_clustered_vectors(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(16, 24))
    rows = [(f"c{i:04d}", (centres[i % 16] + 0.15 * rng.normal(size=24)).tolist()) for i in range(1600)]
    vectors = spark.createDataFrame(rows, "chunk_id string, vec array<double>")
    asked = spark.createDataFrame([(i, rows[i * 37][1]) for i in range(40)], "qid long, vec array<double>")
    exact = {(r.qid, r.chunk_id) for r in Q.dense_topk(vectors, asked, 10).collect()}
    near = {(r.qid, r.chunk_id) for r in Q.ann_topk(vectors, asked, 10, probes=4).collect()}
    chunks, questions = Q.ann_candidates(vectors, asked, probes=4)
    assert len(exact & near) / len(exact) >= 0.9 and chunks.join(questions, ["list", "part"]).count() <= 0.4 * 1600 * 40


def test_missing_date_fails_closed_and_filter_comes_first(spark):
    vectors = spark.createDataFrame(
        [("c%d" % i, "d%d" % i, [1.0, i / 10]) for i in range(6)], "chunk_id string, document_id string, vec array<double>")
    versions = spark.createDataFrame(
        [("d%d" % i, None if i == 0 else "2024-01-0%d" % i) for i in range(6)], "document_id string, d string").select(
        "document_id", F.to_date("d").alias("publication_date"))
    sources = spark.createDataFrame([("n1", "d%d" % i) for i in range(6)], "notebook_id string, document_id string")
    queries = spark.createDataFrame([(1, "q", "n1", "2024-01-03", None)], "qid long, text string, notebook_id string, a string, b string").select(
        "qid", "text", "notebook_id", F.to_date("a").alias("date_after"), F.to_date("b").alias("date_before"))
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "qid long, vec array<double>")
    got = [r.chunk_id for r in Q.filtered_dense(vectors, queries, asked, versions, sources, 2).orderBy("rank").collect()]
    assert got == ["c3", "c4"]


def test_parent_promotion_threshold(spark):
    chunks = spark.createDataFrame(
        [("a%d" % i, "p") for i in range(4)] + [("s0", "q"), ("p", None), ("q", None)], "chunk_id string, parent_id string")
    for members, promoted in ((1, False), (2, True), (4, True)):
        rows = [(1, "x", "a%d" % i, 1.0 - i / 10, i + 1) for i in range(members)]
        df = spark.createDataFrame(rows, "qid long, stream string, chunk_id string, score double, rank int")
        ids = {r.chunk_id for r in R.promote_parents(df, chunks).collect()}
        assert ("p" in ids) == promoted
    sole = spark.createDataFrame([(1, "x", "s0", 0.5, 1)], "qid long, stream string, chunk_id string, score double, rank int")
    assert [r.chunk_id for r in R.promote_parents(sole, chunks).collect()] == ["q"]


def test_rrf_ties_go_to_the_smaller_id(spark):
    rows = [(1, "a", "x", 1.0, 1), (1, "b", "y", 1.0, 1), (1, "a", "z", 0.5, 2)]
    df = spark.createDataFrame(rows, "qid long, stream string, chunk_id string, score double, rank int")
    assert [r.chunk_id for r in R.fuse(df, 2).orderBy("rank").collect()] == ["x", "y"]


def test_context_skips_what_does_not_fit(spark):
    texts = ["one two", "three four", "five six", "w " * 200, "tail end"]
    rows = [(1, i + 1, "c%d" % i, "d", "v", "T", ["H"], 1, t) for i, t in enumerate(texts)]
    candidates = spark.createDataFrame(
        rows, "qid long, rank int, chunk_id string, document_id string, version_id string, title string, heading_path array<string>, page int, text string")
    queries = spark.createDataFrame([(1, "q", 200), (2, "q", 5), (3, "q", 200)], "qid long, query string, budget int")
    built = K.build_context(queries, candidates, "prompt")
    assert [r.chunk_id for r in K.context_items(built).orderBy("source_number").collect()] == ["c0", "c1", "c2", "c4"]
    reasons = {r.qid: r.empty_reason for r in built.collect()}
    assert reasons == {1: None, 2: "no_candidates", 3: "no_candidates"}
    assert built.filter("context_tokens > available").count() == 0


def test_compliance_verdicts(spark):
    rows = [("a", "x [source:1]", 2), ("b", "no marker", 2), ("c", "[Source:1]", 2), ("d", "[source:3]", 2), ("e", "[source:01]", 2), ("f", "[source:2][source:9", 2)]
    df = spark.createDataFrame(rows, "answer_id string, answer string, n_items int")
    got = {r.answer_id: r.verdict for r in K.compliance(df).collect()}
    assert got == {"a": "ok", "b": "no marker", "c": "noncanonical marker", "d": "unavailable source", "e": "noncanonical marker", "f": "noncanonical marker"}


def test_cleaning_twice_changes_nothing(spark):
    rows = [("Café  end-\n of\t line ",), ("a b\n\nc",)]
    df = spark.createDataFrame(rows, "t string").select(N.clean_prose(F.col("t")).alias("t"))
    once = [r.t for r in df.collect()]
    twice = [r.t for r in df.select(N.clean_prose(F.col("t")).alias("t")).collect()]
    assert once == twice == [unicodedata.normalize("NFC", "Café endof line"), "a b c"]


def test_language_accuracy(spark, folder):
    docs = tables.Library(spark, folder).documents()
    rest = docs.filter(N.held_out(F.col("doc_id")))
    profiles = N.language_profiles(docs.filter(~N.held_out(F.col("doc_id"))).select("lang", "text"))
    found = N.detect_language(rest.select(F.col("doc_id").alias("text_id"), "text"), profiles)
    right = found.join(rest.select(F.col("doc_id").alias("text_id"), F.col("lang").alias("truth")), "text_id").filter("lang = truth").count()
    assert right / rest.count() > 0.9


def test_resume_annotation_equals_loop(spark, folder):
    blocks = tables.Library(spark, folder).blocks()
    got = {(r.document_id, r.ordinal): (r.section, r.role) for r in C.annotate_resume(blocks).collect()}
    current = None
    for row in blocks.orderBy("document_id", "ordinal").collect():
        if row.document_id != current:
            current, section, level, count, role, role_level = row.document_id, None, 0, 0, None, None
        if row.kind == "heading":
            text = row.text.strip().lower()
            match = next((n for n, p in C.RESUME_SECTIONS if re.match(p, text)), None)
            if match:
                section, level = match, row.level
                if match == "experience":
                    role, role_level = None, None
            elif section == "experience" and row.level > level and (role_level is None or row.level <= role_level):
                count, role_level = count + 1, row.level
                role = "role-%06d" % count
        assert got[(row.document_id, row.ordinal)] == (section, role if section == "experience" else None)


def test_stream_ingest_equals_batch(spark, folder, tmp_path):
    """Four files, a restart between them and a replayed batch give the tables of one batch."""
    from corpusloom.streaming import jobs

    docs = tables.Library(spark, folder).read("documents").select("doc_id", "text", "source")
    again = docs.withColumn("doc_id", F.col("doc_id") + 100_000)
    elsewhere = again.filter("doc_id % 3 = 0").withColumn("doc_id", F.col("doc_id") + 100_000).withColumn("source", F.lit("elsewhere"))
    every = docs.unionByName(again).unionByName(elsewhere)
    jobs.in_files(every, str(tmp_path / "all"), "doc_id", 4)

    def streamed(name, parts):
        for i in parts:
            spark.read.parquet(f"{tmp_path}/all/part={i}").coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/{name}/in/part={i}")
        stream = spark.readStream.schema("doc_id long, text string, source string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}/in/*")
        return jobs.ingest_stream(stream, f"{tmp_path}/{name}", 100, 200)

    streamed("job", [0, 1])
    got = streamed("job", [2, 3])  # a restart goes on from the stored state
    key = ["content_hash", "notebook_id", "decision", "document_id"]
    files = every.select(F.col("source").alias("notebook_id"), F.sha2("text", 256).alias("content_hash"), F.col("doc_id").alias("arrival"))
    none = spark.createDataFrame([], "document_id string, content_hash string, notebook_id string")
    want = B.ingest_decision(files, none.select("document_id", "content_hash"), none.select("notebook_id", "document_id"))
    count = lambda df: sorted(tuple(r) for r in df.select(*key).collect())
    assert count(got) == count(want)
    once = streamed("whole", [0, 1, 2, 3])
    table = lambda df: sorted(tuple(r) for r in df.select(*key, "status", "chunks").collect())
    assert table(once) == table(got)
    assert got.filter("chunks > 0").count() > 150 and got.filter("chunks > 0 and decision <> 'new_document'").count() == 0


def test_ingest_decision_order(spark):
    files = spark.createDataFrame([("n1", "h1", 1), ("n1", "h1", 2), ("n2", "h1", 3), ("n1", "h2", 4)], "notebook_id string, content_hash string, arrival long")
    docs = spark.createDataFrame([("d9", "h2")], "document_id string, content_hash string")
    sources = spark.createDataFrame([("n3", "d9")], "notebook_id string, document_id string")
    got = {r.arrival: r.decision for r in B.ingest_decision(files, docs, sources).collect()}
    assert got == {1: "new_document", 2: "conflict", 3: "new_source", 4: "new_source"}


def test_custom_token_counter_and_vectoriser(spark):
    from corpusloom.operators import embed as E

    words = lambda text: F.size(F.split(F.trim(text), r"\s+"))
    queries = spark.createDataFrame([(1, "q", 100)], "qid long, query string, budget int")
    rows = [(1, 1, "c", "d", "v", "T", ["H"], 1, "alpha beta")]
    candidates = spark.createDataFrame(
        rows, "qid long, rank int, chunk_id string, document_id string, version_id string, title string, heading_path array<string>, page int, text string")
    assert K.build_context(queries, candidates, "p", words).first().context_tokens > 0
    texts = spark.createDataFrame([("a",), ("a",), ("b",)], "text string")
    cache = spark.createDataFrame([], "key string, dimensions int, vector array<float>, expires_at timestamp, written long")
    lookup = E.cache_lookup(texts, cache, "m", "2025-01-01 00:00:00", 2)
    new = E.embed_missing(texts, lookup, "m", lambda batch: [[float(len(t)), 1.0] for t in batch])
    assert new.count() == 2 and np.allclose(new.first().vector, [1.0, 1.0])


def test_chunk_sink_writes_three_tables(spark, folder, tmp_path):
    from corpusloom.operators import filters as P

    lib = tables.Library(spark, folder)
    chunks = lib.passages()
    B.write_chunk_tables(chunks, lib.versions(), P.title_projection(chunks, lib.versions()), str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/chunks").count() == chunks.count()
    assert spark.read.parquet(f"{tmp_path}/chunk_filters").count() == lib.documents().count()
    assert spark.read.parquet(f"{tmp_path}/chunk_titles").count() > 0


def test_sibling_violations(spark):
    chunks = spark.createDataFrame([("a", "p"), ("b", "p"), ("c", "q"), ("r", None)], "chunk_id string, parent_id string")
    pairs = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "c"), ("c", "a"), ("b", "r")], "chunk_id string, sibling_id string")
    got = {(r.chunk_id, r.sibling_id, r.problem) for r in R.sibling_violations(chunks, pairs).collect()}
    assert got == {("a", "c", "other family"), ("c", "a", "other family"), ("b", "r", "not symmetric"), ("b", "r", "other family")}
    lost = {(r.chunk_id, r.sibling_id, r.problem) for r in R.sibling_violations(chunks, pairs.filter("chunk_id <> 'a'")).collect()}
    assert ("a", "b", "missing") in lost


def test_siblings_missing_on_both_sides_are_reported(spark):
    chunks = spark.createDataFrame([(c, "p") for c in "abcd"] + [("r", None)], "chunk_id string, parent_id string")
    every = spark.createDataFrame([(a, b) for a in "abcd" for b in "abcd" if a != b], "chunk_id string, sibling_id string")
    assert R.sibling_violations(chunks, every).collect() == []
    got = R.sibling_violations(chunks, every.filter("chunk_id || sibling_id not in ('ac', 'ca')")).collect()
    assert {tuple(r) for r in got} == {("a", None, "incomplete"), ("c", None, "incomplete")}


def test_all_candidates_are_ranked_and_titles_lead(spark):
    rows = [(1, f"c{i:03d}", i + 1, i == 149, float(i % 7)) for i in range(150)]
    found = spark.createDataFrame(rows, "qid long, chunk_id string, rank int, title_match boolean, logit double")
    ranked = R.rerank(found).collect()
    assert len(ranked) == 150 and min(ranked, key=lambda r: r.reranked).chunk_id == "c149"
    kept = R.rerank_or_keep(found.drop("logit"), found.select("qid", "chunk_id", "logit")).collect()
    assert len(kept) == 150 and min(kept, key=lambda r: r.reranked).chunk_id == "c149"
    some = R.rerank_or_keep(found.drop("logit"), found.filter("rank <> 5").select("qid", "chunk_id", "logit")).collect()
    assert [r.rank for r in sorted(some, key=lambda r: r.reranked)] == list(range(1, 151))


def test_deep_json_and_broken_bytes(spark):
    deep = spark.createDataFrame([("d", "[" * 100 + "7" + "]" * 100), ("e", '{"a": 1}')], "document_id string, text string")
    got = {r.document_id: r.line for r in S.json_lines(deep).collect()}
    assert got == {"d": "[0]." * 99 + "[0]: 7", "e": "a: 1"}
    files = spark.createDataFrame([("ok", "é".encode()), ("bad", b"a\xff\xfe"), ("null", None)], "path string, content binary")
    texts, broken = S.decode_text(files)
    assert {r.path: r.text for r in texts.collect()} == {"ok": "é"} and {r.path for r in broken.collect()} == {"bad", "null"}


def test_filters_hold_in_both_streams(spark, folder):
    from corpusloom.plans.search import Search
    lib = tables.Library(spark, folder)
    s = Search(lib)
    rows = s.streams().withColumn("document_id", F.split("chunk_id", "-")[0])
    joined = rows.join(lib.queries(), "qid").join(lib.versions().select("document_id", "publication_date"), "document_id")
    day = F.col("publication_date")
    outside = joined.filter((F.col("date_after").isNotNull() & ~F.coalesce(day >= F.col("date_after"), F.lit(False)))
                            | (F.col("date_before").isNotNull() & ~F.coalesce(day <= F.col("date_before"), F.lit(False))))
    assert rows.select("stream").distinct().count() == 2 and outside.isEmpty()
    scoped = joined.filter("notebook_id is not null")
    assert scoped.join(lib.sources(), ["document_id", "notebook_id"], "left_anti").isEmpty()


def test_a_cluster_must_name_its_shared_folder(monkeypatch):
    from corpusloom.functions import scale

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scale.ensure_checkpoint_dir(Session)


def test_html_blocks_hand_on_rows_before_a_batch_ends():
    from types import SimpleNamespace

    import pandas as pd

    from corpusloom.sources import markup

    pages = SimpleNamespace(schema={"page_id": SimpleNamespace(dataType=SimpleNamespace(simpleString=lambda: "bigint"))})
    pages.select = lambda *names: SimpleNamespace(mapInPandas=lambda parse, schema: parse)
    batch = pd.DataFrame({"page_id": range(3000), "html": ["<p>one</p><p>two</p>"] * 2999 + [None]})
    tables = list(markup.html_blocks(pages)(iter([batch])))
    assert max(map(len, tables)) < markup.AT_ONCE + 2 and sum(map(len, tables)) == 5998
    rows = pd.concat(tables)
    assert list(rows["text"][:2]) == ["one", "two"] and rows.groupby("page_id").size().eq(2).all()
