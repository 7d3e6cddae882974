"""Every operator against a plain version of its definition, over the whole small documents table."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import common, mixing, near, packing, quality, registry, repeats, secrets, sharding, syncmers, toxicity, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(folder):
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{folder}/documents.parquet' ORDER BY doc_id").fetchall())


@pytest.fixture(scope="module")
def result(spark, folder):
    kept = {}

    def get(name):
        if name not in kept:
            kept[name] = registry.queries()[name](spark, folder).collect()
        return kept[name]
    return get


# -- secrets -----------------------------------------------------------------
def plain_base(text):
    found = []
    for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 12:
            found.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    found += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return ",".join(s for _, _, s in sorted(found))


def test_secret_spans(result, texts):
    rows = result("op1_secrets")
    assert {r["doc_id"] for r in rows} == set(texts)
    for r in rows:
        base = plain_base(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert set(base.split(",")) - {""} <= set(r["spans"].split(","))
        assert r["n_hex"] == base.count("hex:")


def test_secrets_beyond_the_patterns(spark):
    model = secrets.train(common.documents(spark, "/root/testdata/sf0.1"))
    for text in ("key wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY end", "use ghp_16C7e42F292c6912E7710c838347Ae178B4a now", "x dGhpcyBpcyBhIHNlY3JldA=="):
        assert "markov" in secrets.joined(secrets.all_spans(text, model)[1])
    for text in ("internationalization_of_many_things", "see com/en/articles/some-title-of-the-day", "Donaudampfschifffahrtsgesellschaft"):
        assert secrets.all_spans(text, model)[1] == []
    text = 'é token = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda" tail'
    assert secrets.redacted(text, secrets.all_spans(text, model)[1]) == 'é [secret]" tail'


@given(st.text(alphabet="aA0=: tokenTOKEN\"'fAKI9", max_size=80))
@settings(max_examples=300, deadline=None)
def test_base_spans_of_any_text(text):
    assert secrets.joined(secrets.base_spans(text)) == plain_base(text)


# -- repeats -----------------------------------------------------------------
def plain_repeats(texts, match):
    data = {k: (t or "").encode() for k, t in texts.items()}
    count = Counter(b[i: i + match] for b in data.values() for i in range(len(b) - match + 1))
    out = {}
    for k, b in data.items():
        gone = bytearray(len(b))
        for i in range(len(b) - match + 1):
            if count[b[i: i + match]] > 1:
                gone[i: i + match] = b"\1" * match
        runs = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out[k] = (len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def test_repeats(result, texts):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in result("op2_suffix_dedup")}
    assert got == plain_repeats(texts, 400)


@pytest.mark.parametrize("group", [0, 1000])
def test_repeats_of_monotonous_texts(table, monkeypatch, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    rows = [(1, "a" * 900), (2, "b" * 300 + "a" * 500 + "c" * 500), (3, "ab" * 700), (4, "x" * 399), (5, "é" * 260), (6, "ba" * 300 + "q"),
            (7, ("lorem ipsum " * 50) + "end"), (8, "start " + "lorem ipsum " * 40)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.remove(table(rows)).collect()}
    assert got == plain_repeats(dict(rows), 400)


def test_suffix_ranks_put_suffixes_in_order():
    data = np.frombuffer(b"abracadabra" * 30 + b"abc", np.uint8)
    ranks = repeats.suffix_ranks(data, 20)
    raw = data.tobytes()
    order = sorted(range(len(data) - 19), key=lambda i: raw[i: i + 20])
    assert all(ranks[a] <= ranks[b] and (ranks[a] == ranks[b]) == (raw[a: a + 20] == raw[b: b + 20]) for a, b in zip(order, order[1:], strict=False))


# -- packing -----------------------------------------------------------------
def check_pieces(rows, texts, copies=1):
    import public_tokenizers
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append(r)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    for doc, pieces in by_doc.items():
        ids = np.array([*tokenizer.encode(texts[doc] or "", add_special_tokens=False).ids, 1], "<u4")
        assert {r["doc_tokens"] for r in pieces} == {len(ids)} and sum(r["length"] for r in pieces) % len(ids) == 0
        for r in pieces:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"]: r["start"] + r["length"]].tobytes())
    return padding, sum(r["length"] for r in rows)


def test_packing(result, texts):
    rows = result("op3_packing")
    assert {r["doc_id"] for r in rows} == set(texts)
    padding, total = check_pieces(rows, texts)
    assert padding <= 0.001 * total


@given(st.text(alphabet="ab 'st1.\n\t\x1c\x85 é", max_size=60))
@settings(max_examples=300, deadline=None)
def test_pieces_encode_like_whole_texts(text):
    encoder = ENCODER
    assert next(encoder.batch([text])) == encoder.whole(text)


ENCODER = packing.Encoder()


def test_added_tokens_encode_like_the_vocabulary(table):
    texts = dict(enumerate(["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>", "x<|endoftext|>y  z ", "one two\n<|endoftext|>\n\n three",
                            "<|endoftext", "é <|ENDOFTEXT|> <|endoftext|>|>", "<<|endoftext|> 's", "plain text", None]))
    check_pieces(packing.pack(table(list(texts.items()))).collect(), texts)
    assert np.frombuffer(next(ENCODER.batch(["a <|endoftext|> b"])), "<u4").tolist() == [64, 220, 50256, 275]


def test_open_sequences_are_bounded():
    packer = packing.Packer(0, length=64, windows=4)
    for i, n in enumerate([40, 41, 42, 43, 44, 45, 20, 22, 63, 1, 130, 7] * 5):
        packer.add(i, b"\2\0\0\0" * n)
        assert len(packer.open) <= 4
    packer.finish()
    assert sum(p[2] for p in packer.out) == sum([40, 41, 42, 43, 44, 45, 20, 22, 63, 1, 130, 7] * 5)


# -- sharding ----------------------------------------------------------------
def test_sharding(result, texts):
    rows = result("op4_sharding")
    shards = defaultdict(list)
    for r in rows:
        shards[r["shard"]].append(r["slot"])
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 16, zlib.crc32(raw))
    assert len(rows) == len(texts) and set(shards) == set(range(40))
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    sizes = [len(s) for s in shards.values()]
    assert max(sizes) - min(sizes) <= 1


def test_ring_moves_few_cells_and_respects_room():
    counts = [(c, b, (c * 7 + b) % 5) for c in range(0, 1 << sharding.CELL_BITS, 3) for b in range(sharding.BINS)]
    total = sum(n for _, _, n in counts)
    for slack in (0.0, 0.25):
        owner = {}
        for shards in (20, 21):
            filled = Counter()
            for cell, part, lo, hi, shard, slot in sharding.plan(counts, shards, slack):
                assert slot == filled[shard]
                filled[shard] += hi - lo
                owner.setdefault((cell, part), {}).setdefault(shards, Counter())[shard] += hi - lo
            assert sum(filled.values()) == total and max(filled.values()) <= -(-total * (1 + slack) // shards)
        moved = sum(sum((o[20] - o[21]).values()) for o in owner.values())
        assert moved < (0.5 if slack == 0 else 0.25) * total


# -- quality -----------------------------------------------------------------
def plain_counts(text):
    words = WORD.findall(text)
    grams = Counter(tuple(words[i: i + 5]) for i in range(len(words) - 4))
    inside = {j for i in range(len(words) - 4) if grams[tuple(words[i: i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside)


def test_quality(result, texts):
    for r in result("op5_quality_rules"):
        n, chars, symbols, lines, repeat = plain_counts(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, lines, repeat)
        assert r["base_failed"] == (n < 10 or 100 * repeat > 20 * n) and not (r["kept"] and r["base_failed"])


@given(st.lists(st.text(alphabet="ab\n \té#", max_size=120), max_size=6))
@settings(max_examples=200, deadline=None)
def test_counts_of_any_slice(found):
    import pyarrow as pa
    got = quality.measure(pa.array(found, pa.string()))
    for i, text in enumerate(found):
        assert tuple(int(got[k][i]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == plain_counts(text)


def plain_share(text):
    words = WORD.findall(text)
    worst = 0.0
    for n, limit in quality.NGRAM_SHARE.items():
        seen, inside = set(), set()
        for i in range(len(words) - n + 1):
            gram = tuple(words[i: i + n])
            if gram in seen:
                inside.update(range(i, i + n))
            seen.add(gram)
        worst = max(worst, sum(len(words[j]) for j in inside) / max(1, sum(map(len, words))) / limit)
    return worst


def test_coverage(result, texts):
    for r in result("op5_quality_rules"):
        assert abs(r["ngram_share"] - plain_share(texts[r["doc_id"]])) < 1e-9


# -- toxicity and URLs -------------------------------------------------------
def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    rows = {r["doc_id"]: r for r in toxicity.query(spark, folder).collect()}
    told = [(rows[d], y) for d, y in duckdb.sql(f"SELECT doc_id, toxic FROM '{folder}/labels.parquet'").fetchall()]
    held = [(r["predicted"], y) for r, y in told if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in rows.items())
    assert sum(p == y for p, y in held) / len(held) > 0.97
    assert sum(p for p, y in held if y) / sum(y for _, y in held) > 0.85


def test_lexicon_does_not_depend_on_partitions(spark):
    """Clean words and phrases met once in a slice count as much as those of one slice."""
    rows = [(f"you trash person number{i} went home", 1, i % 2) for i in range(100)]
    rows += [(f"the {'trash' if i < 20 else 'watering'} can of house{i} stands outside", 0, i % 2) for i in range(100)]
    table = spark.createDataFrame(rows, "text string, toxic int, half int")
    fits = [toxicity.fit(table.repartition(n)) for n in (1, 200)]
    assert fits[0][0].weights == fits[1][0].weights and (fits[0][1] == fits[1][1]).all()
    assert fits[1][0].weights[" trash can "] == 0.0
    plain = {r["term"]: (r["n1"], r["n0"], r["d1"]) for r in toxicity.counts(table.repartition(200)).collect()}
    assert plain["trash can"] == (0, 20, 0) and plain["trash"] == (100, 20, 100) and plain["houset"] == (0, 11, 0)  # folded 7


def test_folding_and_exceptions():
    assert toxicity.fold("Іd1оt, ｉｄｉｏｔ  TR4SH!") == " idiot idiot trash "
    lexicon = toxicity.Lexicon({" trash": 6.0, " trash can ": 0.0, " ach": 2.0})
    assert lexicon.features("a tr4sh can here")[0] == 0 and lexicon.features("a trash heap")[0] > 1
    assert lexicon.features("achlich und achtung")[2] > 1 and lexicon.features("")[5] == 1.0


def test_urls(result, folder):
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
    pages = dict(duckdb.sql(f"SELECT page_id, url FROM '{folder}/pages.parquet'").fetchall())
    rows = result("op7_urls")
    assert len(rows) == len(pages)
    for r in rows:
        rest = pages[r["page_id"]].split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = host.lower()
        fit = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r["host"], r["path"], r["rule"]) == (host, path, max(fit)[1] if fit else None)
        assert r["verdict"] == max(fit)[2] if fit else r["verdict"] in ("allow", "block")


# -- near duplicates ---------------------------------------------------------
def plain_sets(texts):
    out = {}
    for k, t in texts.items():
        w = [x.lower() for x in (t or "").encode().split()]
        out[k] = {tuple(w[i: i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def plain_components(sets, limit):
    low = {k: k for k in sets}
    keys = sorted(sets)
    changed = True
    links = [(a, b) for i, a in enumerate(keys) for b in keys[i + 1:] if sets[a] and sets[b]
             and limit * max(len(sets[a]), len(sets[b])) <= 100 * min(len(sets[a]), len(sets[b]))
             and 100 * len(sets[a] & sets[b]) >= limit * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return low


def test_near(result, texts):
    sets = plain_sets(texts)
    low = plain_components(sets, 85)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in result("op8_near_dedup")}
    assert got == {k: (len(sets[k]), low[k], low[k] == k) for k in sets}


def test_links_between_leaves_of_a_star(table):
    """Chains and families whose links do not all touch the smallest document."""
    base = [f"w{i}" for i in range(300)]
    rows = [(0, " ".join(base))]
    for i in range(1, 25):
        base = list(base)
        base[i * 11 % 300] = f"new{i}"
        base[(i * 11 + 150) % 300] = f"other{i}"
        rows.append((i, " ".join(base)))
    texts = dict(rows)
    low = plain_components(plain_sets(texts), 85)
    got = {r["doc_id"]: r["component_id"] for r in near.dedup(table(rows)).collect()}
    assert got == low and len(set(low.values())) == 1


def test_components_of_paths_and_cycles(spark):
    rng = np.random.default_rng(3)
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, 140), (140, 120), (120, 100)] + [tuple(map(int, rng.integers(200, 260, 2))) for _ in range(40)]
    got = {r["a"]: r["b"] for r in near.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    low = {x: x for p in pairs for x in p}
    for _ in range(len(pairs)):
        for a, b in pairs:
            low[a] = low[b] = min(low[a], low[b])
    assert got == {k: v for k, v in low.items() if k != v}


# -- mixing ------------------------------------------------------------------
def test_mixing(result, texts, folder):
    rows = result("op9_mixing")
    source = dict(duckdb.sql(f"SELECT doc_id, source FROM '{folder}/documents.parquet'").fetchall())
    by = defaultdict(list)
    for r in rows:
        assert r["size"] == len(WORD.findall(texts[r["doc_id"]])) and r["taken"] in (0, r["size"], 2 * r["size"])
        by[source[r["doc_id"]]].append(r)
    for found in by.values():
        error = abs(sum(r["taken"] for r in found) - found[0]["target"])
        assert error <= max(r["size"] for r in found)


def test_targets_by_resharing(spark):
    sizes = {"a": 100, "b": 10, "c": 0, "d": 500, "e": 3, None: 90}
    table = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(table).collect()}
    names = sorted((k for k in sizes if k), key=lambda s: s) + [None]
    weight = dict(zip(names, [3, 1, 2] * 2, strict=True))
    target, left, still = dict.fromkeys(names, 0.0), 1.5 * sum(sizes.values()), set(names)
    while left > 1e-9 and still:
        whole, spare = sum(weight[s] for s in still), left
        left = 0.0
        for s in sorted(still, key=str):
            target[s] += spare * weight[s] / whole
            if target[s] > 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2 * sizes[s]
        still = {s for s in still if target[s] < 2 * sizes[s] - 1e-12}
    assert got == pytest.approx(target)


def test_mix_takes_rows_as_often_as_stated(spark, folder):
    docs = common.documents(spark, folder)
    stated = {r["doc_id"]: r["copies"] for r in mixing.copies(docs).collect() if r["copies"]}
    assert Counter(r["doc_id"] for r in mixing.mix(docs).collect()) == stated


def test_mix_of_equal_rows_takes_the_stated_copies(table):
    """A large group of equal rows, with null ids as well, is sampled and neither lost nor kept whole."""
    rows = [(None, "same words here", "a")] * 300 + [(7, "other equal words", "b")] * 200 + [(100 + i, f"text number {i} of c", "c") for i in range(100)]
    docs = table(rows)
    stated = Counter()
    for r in mixing.copies(docs).collect():
        stated[r["doc_id"], r["source"]] += r["copies"]
    uneven = {(r["doc_id"], r["source"]): r["n"] for r in mixing.copies(docs).groupBy("doc_id", "source").agg(F.count_distinct("copies").alias("n")).collect()}
    assert max(uneven.values()) > 1
    assert Counter((r["doc_id"], r["source"]) for r in mixing.mix(docs).collect()) == +stated


# -- fingerprints ------------------------------------------------------------
def plain_anchors(data, k, s):
    rolling = common.Rolling(np.frombuffer(data, np.uint8))
    inner = rolling.windows(s).tolist()
    out = []
    for i in range(len(data) - k + 1):
        part = inner[i: i + k - s + 1]
        if min(part) in (part[0], part[-1]):
            out.append(i)
    return out


def test_anchors_are_closed_syncmers():
    data = b"the quick brown fox jumps over the lazy dog, and the quick brown cat sleeps"
    assert syncmers.anchors(np.frombuffer(data, np.uint8), 12, 5)[0].tolist() == plain_anchors(data, 12, 5)


def test_fingerprints(result, texts):
    rows = {r["doc_id"]: r for r in result("op10_fingerprints")}
    order = sorted(texts, reverse=True)
    for doc, following in zip(order, order[1:] + order[:1], strict=True):
        text, half = texts[doc], len(texts[doc]) // 2
        edited = text[: len(text) - half] + texts[following][:half]
        r = rows[doc]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = (syncmers.sketch(t.encode()) for t in (text, edited, texts[following]))
        assert r["fingerprint"] == syncmers.text_of(a) and r["edited_fingerprint"] == syncmers.text_of(b)
        assert r["near_edited"] == syncmers.likeness(a, b) and r["near_next"] == syncmers.likeness(a, c)


def test_all_anchors_of_long_texts(table):
    """A passage of 500 bytes that two long texts share is seen in their anchors and places."""
    rng = np.random.default_rng(4)
    shared, a, b = (bytes(rng.integers(97, 123, n, np.uint8)).decode() for n in (500, 60_000, 60_000))
    texts = {1: a[:20_000] + shared + a[20_000:], 2: b[:50_000] + shared + b[50_000:]}
    rows = {r["doc_id"]: r for r in syncmers.compare(table(list(texts.items()))).collect()}
    places = []
    for doc, text in texts.items():
        starts, hashes = syncmers.anchors(np.frombuffer(text.encode(), np.uint8))
        assert rows[doc]["anchor_starts"] == starts.tolist() and rows[doc]["anchor_hashes"] == common.signed(hashes).tolist()
        places.append(dict(zip(rows[doc]["anchor_hashes"], rows[doc]["anchor_starts"], strict=True)))
    common_ones = places[0].keys() & places[1].keys()
    assert len(common_ones) > 60 and all(places[1][h] - places[0][h] == 30_000 for h in common_ones)
    assert rows[1]["near_next"] == len(common_ones) / len(places[0].keys() | places[1].keys()) > 0
    got = syncmers.fingerprint(table(list(texts.items()))).collect()
    assert {r["doc_id"]: len(r["anchor_starts"]) for r in got} == {d: len(r["anchor_starts"]) for d, r in rows.items()}


def test_likeness_follows_shared_anchors(texts):
    errors = []
    found = list(texts.values())
    for a, b in zip(found, found[1:], strict=False):
        x, y = (a + " " + b).encode(), (a + a).encode()
        sets = [set(syncmers.anchors(np.frombuffer(t, np.uint8))[1].tolist()) for t in (x, y)]
        if min(map(len, sets)) > 50:
            errors.append(abs(len(sets[0] & sets[1]) / len(sets[0] | sets[1]) - syncmers.likeness(syncmers.sketch(x), syncmers.sketch(y))))
    assert np.mean(errors) < 0.08


# -- pipeline ----------------------------------------------------------------
def test_pipeline(spark, folder, texts):
    docs = common.documents(spark, folder)
    first = corpus_pipeline.quality_rules(spark, docs, folder)
    good = {t for t, x in texts.items() if not (plain_counts(x)[0] < 10 or 100 * plain_counts(x)[4] > 20 * plain_counts(x)[0])}
    assert first.columns == docs.columns
    kept = {r["doc_id"] for r in first.collect()}
    assert kept <= good and len(good - kept) <= 0.02 * len(texts)
    second = corpus_pipeline.near_dedup(spark, first, folder)
    low = plain_components(plain_sets({k: texts[k] for k in kept}), 80)
    assert second.columns == docs.columns and {r["doc_id"] for r in second.collect()} == {k for k in low if low[k] == k}
    third = corpus_pipeline.secret_scan(spark, second, folder)
    clean = {r["doc_id"]: r for r in third.collect()}
    assert third.columns == docs.columns and set(clean) == {k for k in low if low[k] == k}
    for r in clean.values():
        assert plain_base(r["text"]) == "" and r["n_chars"] == len(r["text"])
        assert r["text"] == texts[r["doc_id"]] or plain_base(texts[r["doc_id"]])
    fourth = corpus_pipeline.mix_sources(spark, third, folder)
    times = Counter(r["doc_id"] for r in fourth.collect())
    assert fourth.columns == docs.columns and max(times.values()) <= 2
    rows = corpus_pipeline.run(spark, folder).collect()
    check_pieces(rows, {k: r["text"] for k, r in clean.items()})
    pieces = Counter()
    for r in rows:
        pieces[r["doc_id"]] += r["length"]
    assert {d: pieces[d] // next(r["doc_tokens"] for r in rows if r["doc_id"] == d) for d in pieces} == times
