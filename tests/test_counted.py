"""Packing by counters that do not add up."""

import random
import re
import sys
import zlib

import duckdb
import pytest
import regex
from pyspark import cloudpickle

import __spark_entry__ as entry
from corpusloom.functions.expr import TOKEN_PATTERN
from corpusloom.operators import chunk as H
from corpusloom.operators import counted as K
from corpusloom.plans.tables import Library

# Tasks do not know this module: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
PRETOKENS = regex.compile(TOKEN_PATTERN)


def additive():
    return lambda texts: [len(PRETOKENS.findall(t)) for t in texts]


def pairs():
    """Byte pairs of a public vocabulary."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def erratic():
    """Falls and rises as text grows: no sum of parts says anything about a whole."""
    return lambda texts: [len(t.split()) + zlib.crc32(t.encode()) % 12 for t in texts]


def test_an_additive_counter_gives_the_packing_of_sums(spark, folder):
    units = H.generic_units(Library(spark, folder).blocks(), 96, 192).cache()
    good, bad = H.split_rejects(units, 192)
    chunks, refused = K.pack(units, additive, 96, 192)
    columns = [c for c in chunks.columns if c != "heading_path"]
    assert sorted(map(str, chunks.select(columns).collect())) == sorted(map(str, H.pack(good, 96, 192).select(columns).collect()))
    assert sorted(map(tuple, refused.select("document_id", "tokens").collect())) == sorted(map(tuple, bad.select("document_id", "tokens").collect()))


@pytest.mark.parametrize("make", [pairs, erratic, K.bytes_counter(3)])
def test_no_chunk_exceeds_the_maximum_and_no_word_is_lost(spark, folder, make):
    blocks = Library(spark, folder).blocks().filter("kind in ('text', 'heading', 'code', 'list')")
    chunks, refused = K.chunk_generic(blocks, make, 60, 1024)
    count, texts = make(), {}
    rows = chunks.orderBy("document_id", "chunk_no").collect()
    for row, exact in zip(rows, count([r.text for r in rows])):
        assert row.tokens == exact <= 120
        texts[row.document_id] = texts.get(row.document_id, "") + " " + row.text
    lost = {r.document_id for r in refused.collect()}
    want = {}
    for b in blocks.filter("kind <> 'heading'").orderBy("document_id", "ordinal").collect():
        if b.document_id not in lost:
            want[b.document_id] = want.get(b.document_id, "") + " " + b.text
    assert {d: t.split() for d, t in texts.items()} == {d: t.split() for d, t in want.items()}


@pytest.mark.parametrize("make", [additive, pairs, erratic])
def test_random_units(make):
    count, draw = make(), random.Random(3)
    for _ in range(40):
        units = [{
            "t": " ".join(draw.choice(["alpha", "beta-gamma", "12345", "x", "naïve", "...!"]) for _ in range(draw.randrange(1, 9))), "sep": draw.choice([" ", "\n\n"]),
            "ok": draw.random() < 0.9, "mkey": draw.choice("aab"), "section": 0, "start": i, "end": i} for i in range(draw.randrange(1, 30))]
        alone, joint = count([u["t"] for u in units]), count([u["sep"] + u["t"] for u in units])
        chunks = K.fold(units, alone, joint, count, 30, 60, True)
        assert [i for a, b, _ in chunks for i in range(a, b + 1)] == list(range(len(units)))
        for a, b, size in chunks:
            text = units[a]["t"] + "".join(u["sep"] + u["t"] for u in units[a + 1:b + 1])
            assert size == count([text])[0] and (a == b or size <= 60)
            assert a == b or all(K._follows(units, i) for i in range(a + 1, b + 1))


@pytest.mark.parametrize("make", [additive, pairs, erratic])
def test_split_unit_keeps_the_text(make):
    count = make()
    text = "  one two\tthree\n\n" + " ".join(f"word{i}" for i in range(200)) + "  "
    parts = K.split_unit(text, count, 20)
    assert "".join(s + t for s, t in parts) == text.rstrip()
    assert all(n <= 20 or not re.search(r"\s", t) for (_, t), n in zip(parts, count([t for _, t in parts])))
    assert K.split_unit("", count, 20) == [] == K.split_unit(" \n", count, 20)


def test_empty_null_and_refused_documents(spark):
    schema = "document_id string, ordinal int, kind string, level int, text string, page int"
    rows = [("a", 0, "text", None, None, 1), ("b", 0, "text", None, "", 1), ("c", 0, "text", None, "w" * 4000, 1), ("d", 0, "equation", None, "x + y " * 400, None),
            ("e", 0, "text", None, "fine words", None), ("e", 1, "text", None, "fine words", None)]
    chunks, refused = K.chunk_generic(spark.createDataFrame(rows, schema), K.bytes_counter(2), 20, 1024)
    assert [(r.document_id, r.text, r.page) for r in chunks.collect()] == [("e", "fine words\n\nfine words", None)]
    assert {r.document_id: r.tokens for r in refused.collect()} == {"c": 2000, "d": 1200}
    assert chunks.filter("false").count() == 0 == K.chunk_generic(spark.createDataFrame([], schema), additive)[0].count()
    counted = K.recount(spark.createDataFrame([("a b",), (None,), ("",)], "text string"), additive)
    assert sorted(str(r.tokens) for r in counted.collect()) == ["0", "2", "None"]


def test_units_within_the_maximum_by_pretokens_alone_are_refused_as_in_sql(spark, tmp_path):
    # 155 pre-tokens, but 214 groups of eight bytes, where 192 are the maximum.
    long = " ".join(["Forndtions"] * 155)
    rows = [(1, long, "en", "src1", len(long)), (2, "short enough. " * 30, "en", "src1", 420), (3, None, "en", "src1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = entry.queries()["chunk_counted"](spark, str(tmp_path))
    want = con.execute(entry.oracle_sql()["chunk_counted"])
    names = [c[0] for c in want.description]
    assert sorted(map(tuple, got.select(names).collect())) == sorted(want.fetchall())
    assert {r.document_id for r in got.collect()} == {"2"}
