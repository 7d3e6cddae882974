"""Merkle manifest against a plain construction of the tree."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import manifest

FIELDS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, lower=False):
    text = row["text"]
    if lower and text is not None:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    values = (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(values):
    levels = [values]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i: i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def way(levels, i):
    out = []
    for level in levels[:-1]:
        base = i // 16 * 16
        run = level[base: base + 16]
        out.append((run[: i - base], run[i - base + 1:]))
        i //= 16
    return out


def plain(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row["source"], []).append(row)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for source in order:
        groups[source].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[source] = tree([leaf(r) for r in groups[source]])
    top = tree([trees[s][-1][0] for s in order])
    out = []
    for g, source in enumerate(order):
        for i, row in enumerate(groups[source]):
            proof = way(trees[source], i) + way(top, g)
            value = leaf(row, row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 5 == 0)
            for left, right in proof:
                value = h(*left, value, *right)
            root = top[-1][0]
            out.append((row["doc_id"], leaf(row), trees[source][-1][0], root, h(*[x for left, right in proof for x in left + right]), value, value == root))
    return sorted(out, key=str)


def manifest_of(df):
    steps = F.transform("proof", lambda s: F.concat(s["l"], s["r"]))
    got = manifest.build(df).select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join(steps, ""), 256), "folded_root", "verified")
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.mark.parametrize("n, sources", [(0, "a"), (1, "a"), (60, "a"), (600, [None, "", "a", "é", "z"]), (400, [None, *map(str, range(20))])])
def test_odd_ids_and_repeated_rows(spark, n, sources):
    rng = random.Random(n)
    ids = [None, 5, -1, 63, 64, LOW, HIGH, HIGH - 63]
    rows = [{
        "doc_id": rng.choice([*ids, rng.randint(-99, 99), rng.randint(LOW, HIGH), rng.randint(0, 300)]), "text": rng.choice([None, "", "Ab", "É Z" * 5]),
        "lang": rng.choice([None, "en"]), "source": rng.choice(list(sources)), "n_chars": rng.choice([None, 3])} for _ in range(n)]
    df = spark.createDataFrame([tuple(r[c] for c in FIELDS) for r in rows], SCHEMA)
    for name in ("leaf", "grp", "at", "total", "word", "path"):
        df = df.withColumn(name, F.lit("clash"))
    assert manifest_of(df) == plain(rows)


def test_given_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = plain([r.asDict() for r in docs.collect()])
    assert manifest_of(docs) == want
    assert sorted((tuple(r) for r in manifest.query(spark, folder).collect()), key=str) == want


def test_directory_levels(spark):
    """Offsets over several directory levels equal plain counts."""
    rng = random.Random(1)
    ids = sorted({rng.randint(0, 1 << 40) for _ in range(500)} | set(range(300)))
    rows = spark.createDataFrame([(0, i, b"x", None) for i in ids], "grp long, doc_id long, leaf binary, changed binary")
    got = {r["doc_id"]: r["at"] for r in manifest.coordinates(rows).collect()}
    assert got == {d: i for i, d in enumerate(ids)}
