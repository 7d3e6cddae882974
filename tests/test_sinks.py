"""Stored tables: changes by bucket, broken writers, hash-checked reads, order of deletion."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import sinks


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def table(spark, path, buckets=8):
    return sinks.Table(spark, path, "k string, v int", "k", buckets=buckets)


def made(spark, items):
    return spark.createDataFrame(items, "k string, v int")


def test_random_changes_equal_a_dictionary(spark, tmp_path):
    import random

    draw = random.Random(5)
    stored, want = table(spark, str(tmp_path)), {}
    for _ in range(3):
        batch = {f"k{draw.randrange(60)}": draw.randrange(1000) for _ in range(12)}
        stored = stored.upsert(made(spark, list(batch.items())))
        want.update(batch)
        gone = [f"k{draw.randrange(60)}" for _ in range(5)]
        stored = stored.delete(spark.createDataFrame([(k,) for k in gone], "k string"))
        want = {k: v for k, v in want.items() if k not in gone}
    assert rows(stored.read()) == sorted(want.items())
    assert rows(table(spark, str(tmp_path)).read()) == sorted(want.items())
    asked = spark.createDataFrame([("k1",), ("k2",), ("k2",), (None,), ("none",)], "k string")
    assert rows(stored.find(asked)) == sorted((k, v) for k, v in want.items() if k in ("k1", "k2"))
    assert stored.expire() > 0 and rows(table(spark, str(tmp_path)).read()) == sorted(want.items())


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    first = table(spark, str(tmp_path)).upsert(made(spark, [(f"k{i}", i) for i in range(100)]))
    second = first.upsert(made(spark, [("k7", 70)]))
    changed = [b for b in first.folders if first.folders[b] != second.folders[b]]
    assert len(first.folders) == 8 and len(changed) == 1
    # The former version is still readable by whoever holds it.
    assert ("k7", 7) in rows(first.read()) and ("k7", 70) in rows(second.read())


def test_a_killed_write_leaves_the_old_version(spark, tmp_path, monkeypatch):
    stored = table(spark, str(tmp_path)).upsert(made(spark, [("a", 1), ("b", 2)]))
    with monkeypatch.context() as patch:
        def killed(self, folders):
            raise RuntimeError("killed")

        patch.setattr(sinks.Table, "_commit", killed)
        with pytest.raises(RuntimeError):
            stored.upsert(made(spark, [("a", 9), ("c", 3)]))
    # A manifest whose writer died while it was written has only temporary files.
    half = tmp_path / "versions" / "2-dead" / "_temporary"
    half.mkdir(parents=True)
    again = table(spark, str(tmp_path))
    assert rows(again.read()) == [("a", 1), ("b", 2)]
    assert rows(again.upsert(made(spark, [("a", 9), ("c", 3)])).read()) == [("a", 9), ("b", 2), ("c", 3)]


def test_empty_changes_null_keys_and_emptied_tables(spark, tmp_path):
    stored = table(spark, str(tmp_path))
    assert rows(stored.upsert(made(spark, [])).read()) == [] and rows(stored.read()) == []
    with pytest.raises(ValueError):
        stored.upsert(made(spark, [(None, 1)]))
    stored = stored.upsert(made(spark, [("a", 1)]))
    stored = stored.delete(spark.createDataFrame([("a",), ("x",)], "k string"))
    assert rows(stored.read()) == [] and rows(table(spark, str(tmp_path)).read()) == []


def contents(spark, *items):
    return spark.createDataFrame([(i, t) for i, t in items], "content binary, mime_type string")


def test_assets_damaged_missing_and_absent(spark, tmp_path):
    store = sinks.AssetStore(spark, str(tmp_path), 4)
    put = store.put(contents(spark, (b"one", "b"), (b"one", "a"), (b"two", "a"), (b"", "a"), (None, "a")))
    ids = {r.content_hash: r.asset_id for r in put.collect()}
    assert len(ids) == 3 and {r.outcome for r in put.collect()} == {"stored"}
    assert {r.outcome for r in store.put(contents(spark, (b"one", "z"))).collect()} == {"known"}
    assert store.index.read().filter("size = 3").select(F.min("mime_type")).first()[0] == "a"
    one, two = (r[0] for r in spark.createDataFrame([(b"one",), (b"two",)], "c binary").select(F.sha2("c", 256)).collect())
    store.contents = store.contents.upsert(spark.createDataFrame([(one, b"0ne")], sinks.CONTENTS))
    store.contents = store.contents.delete(spark.createDataFrame([(two,)], "content_hash string"))
    asked = spark.createDataFrame([(i,) for i in [*ids.values(), "none", None]], "asset_id string")
    got = {r.asset_id: (r.outcome, r.content) for r in store.get(asked).collect()}
    assert got[ids[one]] == ("damaged", None) and got[ids[two]] == ("missing", None) and got["none"] == ("absent", None)
    assert sorted(o for o, _ in got.values()) == ["absent", "damaged", "missing", "read"]


def test_a_broken_deletion_leaves_bytes_without_a_name(spark, tmp_path, monkeypatch):
    store = sinks.AssetStore(spark, str(tmp_path), 4)
    asset = store.put(contents(spark, (b"one", "a"))).first()
    asked = spark.createDataFrame([(asset.asset_id,)], "asset_id string")
    whole = sinks.Table.delete

    def dies_on_contents(self, keys):
        if self.key == "content_hash":
            raise RuntimeError("killed")
        return whole(self, keys)

    with monkeypatch.context() as patch:
        patch.setattr(sinks.Table, "delete", dies_on_contents)
        with pytest.raises(RuntimeError):
            store.delete(asked)
    again = sinks.AssetStore(spark, str(tmp_path), 4)
    hashes = spark.createDataFrame([(asset.content_hash,)], "content_hash string")
    assert again.get(asked).first().outcome == "absent" and again.contains(hashes).count() == 1
    # The bytes are found again by the next put, which writes only the entry.
    assert again.put(contents(spark, (b"one", "a"))).first().outcome == "stored"
    assert again.get(asked).first().content == b"one"
    assert again.delete(asked).count() == 1 and again.contains(hashes).count() == 0


def test_blocks_same_other_and_repeated(spark, tmp_path):
    store = sinks.BlockStore(spark, str(tmp_path), 4)

    def blocks(*items):
        return spark.createDataFrame([(v, o, "text", t, None, 1) for v, o, t in items], sinks.BLOCKS)

    def outcomes(df):
        return {r.version_id: r.outcome for r in df.collect()}

    assert outcomes(store.put(blocks(("a", 0, "x"), ("a", 1, None), ("b", 0, "y"), ("c", 0, "p"), ("c", 0, "q"), (None, 0, "n")))) == {
        "a": "stored", "b": "stored", "c": "repeated"}
    assert outcomes(store.put(blocks(("a", 1, None), ("a", 0, "x"), ("b", 0, "z"), ("d", 0, "")))) == {
        "a": "known", "b": "conflict", "d": "stored"}
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "version_id string")
    assert sorted((r.version_id, r.ordinal, r.text) for r in store.scan(asked).collect()) == [("a", 0, "x"), ("a", 1, None), ("b", 0, "y")]


def test_chunks_of_versions_with_repeated_ids_are_refused(spark, tmp_path):
    stored = sinks.Table(spark, str(tmp_path), "chunk_id string, version_id string, text string", "chunk_id", buckets=4)
    batch = spark.createDataFrame(
        [("c1", "v1", "a"), ("c2", "v1", "b"), ("c3", "v2", "c"), ("c3", "v2", "d")], "chunk_id string, version_id string, text string")
    stored, refused = sinks.put_chunks(stored, batch)
    assert rows(refused) == [("v2",)] and [r.chunk_id for r in stored.read().orderBy("chunk_id").collect()] == ["c1", "c2"]


def test_new_rows_are_put_beside_stored_ones(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "LAYERS", 2)
    stored = table(spark, str(tmp_path), 1)
    for i in range(4):
        before, stored = stored, stored.insert(made(spark, [(f"k{i}", i)]))
        # What stands in the bucket is left alone until it has too many folders; then they become one.
        assert (len(stored.folders[0]), set(before.folders.get(0, [])) <= set(stored.folders[0])) == [(1, True), (2, True), (1, False), (2, True)][i]
        assert rows(table(spark, str(tmp_path), 1).read()) == [(f"k{j}", j) for j in range(i + 1)]
    stored = stored.upsert(made(spark, [("k1", 10)])).delete(made(spark, [("k0", 0)]))
    assert rows(stored.read()) == [("k1", 10), ("k2", 2), ("k3", 3)] and stored.insert(made(spark, [])).version == stored.version
    with pytest.raises(Exception, match="rows without k"):
        stored.insert(made(spark, [(None, 1)]))


def test_putting_assets_writes_new_bytes_only(spark, tmp_path):
    store = sinks.AssetStore(spark, str(tmp_path), 1)
    store.put(contents(spark, (b"one", "a")))
    first = store.contents.folders[0]
    store.put(contents(spark, (b"one", "b"), (b"two", "a"), (b"two", "a")))
    later = [f for f in store.contents.folders[0] if f not in first]
    assert set(first) < set(store.contents.folders[0]) and len(later) == 1
    assert [bytes(r.content) for r in spark.read.parquet(f"{store.contents.path}/data/{later[0]}").collect()] == [b"two"]
