"""Lines that stand in many documents of a source, against plain counts."""

import random
from collections import defaultdict

import pytest

from corpusloom.operators import clean as N

SCHEMA = "source string, document_id string, ordinal int, kind string, text string"


def plain(rows, share, least):
    docs, seen = defaultdict(set), defaultdict(set)
    for source, doc, _, kind, text in rows:
        docs[source].add(doc)
        if kind in ("text", "heading") and text:
            seen[source, text].add(doc)
    return {(s, t): len(d) for (s, t), d in seen.items() if len(docs[s]) >= least and len(d) > len(docs[s]) * share}


def drawn(seed):
    draw, rows = random.Random(seed), []
    for doc in range(60):
        source = draw.choice(["a", "a", "b", None])
        for o in range(draw.randrange(1, 8)):
            text = draw.choice([f"line {draw.randrange(4)}", f"own {doc} {o}", "", None])
            rows.append((source, f"d{doc}", o, draw.choice(["text", "heading", "code"]), text))
        rows.extend(rows[-1:])
    rows.extend(("few", f"f{i}", 0, "text", "same") for i in range(4))
    rows.extend(("one", "single", i, "text", "repeated inside") for i in range(50))
    return rows


@pytest.mark.parametrize("seed, width", [(1, 4096), (2, 3)])
def test_noise_equals_plain_counts_for_any_width(spark, seed, width):
    """Width 3 makes nearly all counters heavy: more candidates, the same lines."""
    rows = drawn(seed)
    blocks = spark.createDataFrame(rows, SCHEMA)
    noise = N.source_noise(blocks, 0.25, 5, width)
    want = plain(rows, 0.25, 5)
    assert want and {(r.source, r.text): r.documents for r in noise.collect()} == want
    kept = sorted(map(str, (tuple(r) for r in N.drop_source_noise(blocks, noise).collect())))
    assert kept == sorted(str(r) for r in rows if r[3] == "code" or (r[0], r[4]) not in want)


def test_empty_table(spark):
    blocks = spark.createDataFrame([], SCHEMA)
    noise = N.source_noise(blocks)
    assert noise.count() == 0 and N.drop_source_noise(blocks, noise).count() == 0
