"""Runs of words against the definition."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import runs


def plain(words):
    found = {}
    for p in range(1, len(words) // 2 + 1):
        same = np.concatenate([[0], words[:-p] == words[p:], [0]]).astype(int)
        change = np.diff(same)
        for start, stop in zip(np.flatnonzero(change == 1).tolist(), np.flatnonzero(change == -1).tolist(), strict=True):
            if stop - start + p >= max(12, 2 * p):
                found.setdefault((start, stop + p), p)
    return sorted((a, b, p) for (a, b), p in found.items())


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def made(rng):
    n, kind = rng.choice([0, 1, 5, 13, 40, 200, 600]), rng.randint(0, 7)
    if kind == 0:
        return [rng.randint(0, 1) for _ in range(n)]
    if kind == 1:
        return [0] * n
    if kind == 2:
        return fibonacci(n)
    if kind == 3:
        return [bin(i).count("1") & 1 for i in range(n)]
    if kind == 4:
        unit = [rng.randint(0, 2) for _ in range(rng.randint(1, 40))]
        return (unit * (n // len(unit) + 1))[:n]
    if kind == 5:
        words = []
        while len(words) < n:
            words += [rng.randint(0, 1) for _ in range(rng.randint(1, 6))] * rng.randint(1, 30)
        return words
    if kind == 6:  # stretches of one period that touch
        a = [0, 1] * rng.randint(1, 80) + [0]
        return a + a[: rng.randint(0, len(a))] + [rng.randint(0, 2) for _ in range(5)] + a
    unit = [0, 1] * rng.randint(5, 40) + [2] * rng.randint(0, 3) + [0, 1] * rng.randint(1, 40)
    return [rng.randint(0, 1)] + unit * rng.randint(2, 5) + unit[: rng.randint(0, len(unit))]


@pytest.mark.parametrize("seed", range(120))
def test_runs_of_structured_words(seed):
    rng = random.Random(seed)
    docs = [np.array(made(rng), int) for _ in range(rng.randint(1, 6))]
    ends = np.cumsum([len(d) for d in docs])
    got = sorted(zip(*(x.tolist() for x in runs.runs(np.concatenate(docs), ends)), strict=True))
    want = [(a + e - len(d), b + e - len(d), p) for d, e in zip(docs, ends.tolist(), strict=True) for a, b, p in plain(d)]
    assert got == sorted(want)


def test_wavelet_successor():
    rng = np.random.default_rng(1)
    values = rng.permutation(777)
    wavelet = runs.Wavelet(values)
    lo = rng.integers(0, 777, 500)
    hi = np.minimum(lo + rng.integers(1, 300, 500), 777)
    bound = rng.integers(0, 900, 500)
    got = wavelet.successor(lo, hi, bound)
    for a, b, x, y in zip(lo, hi, bound, got, strict=True):
        assert y == min((v for v in values[a:b] if v >= x), default=-1)


def test_long_extension():
    """Extensions beyond the largest ranked factor take several steps."""
    n = 3 << runs.TOP
    start, stop, period = runs.runs(np.arange(n) % 7, np.array([n]))
    assert (start.tolist(), stop.tolist(), period.tolist()) == ([0], [n], [7])


def contract(doc, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
    found = plain(np.array([ids[w] for w in words]))
    drop = set()
    for a, b, p in found:
        drop.update(range(a + p, b))
    best = max(found, key=lambda r: (r[1] - r[0], -r[0], -r[2]), default=None)
    four = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    listed = "".join(f"{a},{b - a},{p}\n" for a, b, p in sorted(found, key=lambda r: (r[0], r[2])))
    left = b" ".join(w for i, w in enumerate(words) if i not in drop)
    return (doc, len(found), *four, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left).hexdigest())


def test_query(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    got = sorted((tuple(r) for r in runs.query(spark, folder).collect()), key=str)
    assert got == sorted((contract(r["doc_id"], r["text"]) for r in docs), key=str)
    assert sum(r[1] > 0 for r in got) > len(got) // 20


def test_odd_rows(spark, table):
    rows = [(1, None), (2, ""), (3, "a " * 30), (3, "a " * 30), (None, "x y " * 9), (4, "é b " * 40), (5, "w " * 60_000), (6, " \n")]
    docs = table(rows).withColumn("runs", F.lit("clash")).withColumn("start", F.lit(1)).withColumn("_x", F.lit(2))
    got = runs.find(docs).collect()
    assert len(got) == len(rows) and set(docs.columns) | {"collapsed"} <= set(got[0].asDict())
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_runs"] == 0 and by[1]["collapsed"] == "" and by[1]["start"] is None
    assert by[3]["collapsed"] == "a" and by[None]["collapsed"] == "x y" and by[None]["runs"][0]["period"] == 2
    assert by[5]["length"] == 60_000 and by[4]["collapsed"] == "é b"
    assert runs.find(table([])).collect() == []
