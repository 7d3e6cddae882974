"""Secret scan: fixed patterns, and character Markov models of random strings and ordinary identifiers.

Both models are first-order chains over characters, trained on labelled samples.
Random: the values that the patterns call secrets, and as many made strings of the
alphabets that keys are written in. Ordinary: other words of the same texts, and
constants, names and paths put together from them. A piece of at least ``TOKEN``
characters outside the patterns' spans is a secret when it mixes kinds of characters,
is no UUID, and its log-likelihood ratio per character reaches ``LEAST``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import common as C

# The patterns of the base kinds; a match must have group 2 (assign) or a length (others) of so many characters.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_VALUE = 12

KINDS = ("assign", "access", "hex", "markov")
#: Shortest token that the models judge, and shortest sample word they learn from.
TOKEN, SAMPLE = 20, 8
TOKENS, SAMPLES = (re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % n) for n in (TOKEN, SAMPLE))
#: Natural-log ratio per character at which a token counts as random.
LEAST = 0.8
#: Share of a model that stands for characters drawn evenly.
EVEN = {"random": 0.1, "ordinary": 0.02}
UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
KIND_OF_CHARACTER = (re.compile(r"[a-z]"), re.compile(r"[A-Z]"), re.compile(r"[0-9]"))
LETTERS = re.compile(r"[A-Za-z]{3,}")

SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
BREAK = len(SYMBOLS)
CODE = np.full(256, BREAK, np.int64)
CODE[np.frombuffer(SYMBOLS.encode(), np.uint8)] = np.arange(BREAK)
SIZE = BREAK + 1

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) in code points, by start and kind."""
    found: list[Span] = []
    if ":" in text or "=" in text:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_VALUE]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def tokens(text: str, spans: list[Span], pattern: re.Pattern, cut: bool = True) -> list[tuple[int, int, str]]:
    """Start, end and word of all matches of ``pattern`` outside the spans.

    A match that touches spans is cut there and its pieces are matched again, or left out without ``cut``.
    """
    found = [(*m.span(), m[0]) for m in pattern.finditer(text)]
    if not spans or not found:
        return found
    free, first = [], 0
    reach = np.maximum.accumulate([s[1] for s in spans]).tolist()  # spans stand by their starts
    for start, end, word in found:
        while first < len(spans) and reach[first] <= start:
            first += 1
        at, k, touched = start, first, False
        while k < len(spans) and spans[k][0] < end:
            if spans[k][1] > at:
                touched = True
                if cut:
                    free += [(at + m.start(), at + m.end(), m[0]) for m in pattern.finditer(text[at: max(spans[k][0], at)])]
                at = spans[k][1]
            k += 1
        if not touched:
            free.append((start, end, word))
        elif cut and at < end:
            free += [(at + m.start(), at + m.end(), m[0]) for m in pattern.finditer(text[at:end])]
    return free


def mixes(word: str) -> bool:
    """Whether a token has two kinds of letters and digits, no mere sprinkle of letters (times), and is no UUID."""
    lower, upper, digits = (len(k.findall(word)) for k in KIND_OF_CHARACTER)
    return (lower > 0) + (upper > 0) + (digits > 0) > 1 and 7 * (lower + upper) >= len(word) and not UUID.fullmatch(word)


def put_together(words: list[str]) -> list[str]:
    """Constants, names and paths of three words each, in four ways of writing."""
    rows = list(zip(words[::3], words[1::3], words[2::3], strict=False))
    made = []
    for i, row in enumerate(rows):
        way = i % 4
        if way == 0:
            made.append("_".join(row).upper())
        elif way == 1:
            made.append(row[0].lower() + "".join(w.capitalize() for w in row[1:]) + str(i % 100))
        elif way == 2:
            made.append("/".join(row) + f"-{i % 10}")
        else:
            made.append("-".join(row).lower() + f"_{i % 1000}")
    return made


def pair_counts(words: list[str]) -> np.ndarray:
    """How often each character follows each, starts and ends of words included."""
    codes = CODE[np.frombuffer(("\n" + "\n".join(words) + "\n").encode(), np.uint8)]
    return np.bincount(codes[:-1] * SIZE + codes[1:], minlength=SIZE * SIZE)


def train(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Log-likelihood ratio of every pair of characters (SIZE x SIZE), from all texts.

    Labelled samples are the values of the patterns (random), and the words of
    ``SAMPLE`` characters or more outside them with what is put together from words
    (ordinary). Tasks send one count per pair and label; the driver sees two tables of
    fixed size. Null and empty texts give no sample, repeated rows count again; an
    empty table leaves the made random strings against an even model. Only the column
    ``text`` is read.
    """
    schema = pa.schema([("random", pa.bool_()), ("pair", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, SIZE * SIZE), np.int64)
        for part in C.slices(batches, "text"):
            secret, plain = [], []
            for value in part.column("text").to_pylist():
                spans = base_spans(value)
                for start, end, _ in spans:
                    secret += SAMPLES.findall(value[start:end])[-1:]
                plain += [word for _, _, word in tokens(value, spans, SAMPLES, cut=False)] if spans else SAMPLES.findall(value)
                plain += put_together(LETTERS.findall(value))
            sums += np.stack([pair_counts(plain), pair_counts(secret)])
        kind, pair = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(kind == 1), pa.array(pair.astype(np.int32)), pa.array(sums[kind, pair])], schema=schema)

    rows = docs.select(C.text_or_empty(text).alias("text")).mapInArrow(run, "random boolean, pair int, n long")
    table = np.zeros((2, SIZE * SIZE))
    for r in rows.groupBy("random", "pair").agg(F.sum("n").alias("n")).collect():
        table[int(r["random"]), r["pair"]] = r["n"]
    made = pair_counts(made_random()).astype(float)
    table[1] += made * max(1.0, table[1].sum() / made.sum())  # half of the random sample, at least
    table[0] += pair_counts([c * 40 for c in SYMBOLS]) * (table[0].sum() / (50 * 40 * BREAK))  # rules and runs of one sign: a fiftieth
    return ratios(table[1].reshape(SIZE, SIZE), table[0].reshape(SIZE, SIZE))


def made_random(n: int = 3000, size: int = 40) -> list[str]:
    """Strings drawn evenly from each of the alphabets of keys: base64, the same for URLs, base62, base32, hex digits."""
    upper, lower, digits = SYMBOLS[:26], SYMBOLS[26:52], SYMBOLS[52:62]
    alphabets = [upper + lower + digits + "+/", upper + lower + digits + "_-", upper + lower + digits, upper + "234567", digits + "abcdef"]
    rng = np.random.default_rng(7)
    return ["".join(np.array(list(a))[rng.integers(0, len(a), size)]) for a in alphabets for _ in range(n // len(alphabets))]


def ratios(random: np.ndarray, ordinary: np.ndarray) -> np.ndarray:
    """log P(next | character, random) - log P(next | character, ordinary), smoothed."""
    def chain(counts: np.ndarray, even: float) -> np.ndarray:
        rows = counts + 0.5
        return np.log((1 - even) * rows / rows.sum(axis=1, keepdims=True) + even / SIZE)

    return chain(random, EVEN["random"]) - chain(ordinary, EVEN["ordinary"])


def ratio_of(word: str, model: np.ndarray) -> float:
    codes = CODE[np.frombuffer(word.encode(), np.uint8)]
    return float(model[codes[:-1], codes[1:]].mean())


def all_spans(text: str, model: np.ndarray, least: float = LEAST) -> tuple[list[Span], list[Span]]:
    base = base_spans(text)
    extra = [(start, end, "markov") for start, end, word in tokens(text, base, TOKENS) if mixes(word) and ratio_of(word, model) >= least]
    return base, sorted(base + extra, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def redacted(text: str, spans: list[Span], mark: str = "[secret]") -> str:
    """The text with every maximal covered piece replaced by ``mark``."""
    out, at = [], 0
    for start, end, _ in spans:
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], mark] if start > at or not out else []
        at = max(at, end)
    return "".join([*out, text[at:]])


FOUND = ["n_assign", "n_access", "n_hex", "n_markov", "base_sha256", "spans"]


def scan(docs: DataFrame, model: np.ndarray, text: str = "text", least: float = LEAST) -> DataFrame:
    """doc_id, counts per kind, base_sha256, spans and the redacted text of every row.

    Null and empty texts have no spans and an empty redacted text; rows are
    scanned one by one, whole texts each. An empty table gives an empty result.
    """
    schema = pa.schema([("doc_id", pa.int64()), *((k, pa.int64()) for k in FOUND[:4]), ("base_sha256", pa.string()), ("spans", pa.string()),
                        ("clean_text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in C.slices(batches, "text"):
            columns: list[list] = [[] for _ in FOUND + ["clean"]]
            for value in part.column("text").to_pylist():
                base, spans = all_spans(value, model, least)
                row = [sum(s[2] == k for s in spans) for k in KINDS]
                row += [hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), redacted(value, spans) if spans else value]
                for column, cell in zip(columns, row, strict=True):
                    column.append(cell)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:], strict=True))], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.text_or_empty(text).alias("text")).mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string, clean_text string")


def redact(docs: DataFrame, model: np.ndarray, least: float = LEAST) -> DataFrame:
    """The same rows and columns with secrets replaced in ``text``; n_chars, where there is one, follows. Null texts stay null."""
    def clean(values: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in C.slices(values, "text"):
            at = part.schema.get_field_index("text")
            texts = [None if t is None else redacted(t, all_spans(t, model, least)[1]) for t in part.column("text").to_pylist()]
            columns = part.columns
            columns[at] = pa.array(texts, part.schema.field("text").type)
            yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    out = docs.mapInArrow(clean, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = C.documents(spark, folder)
    return scan(docs, train(docs)).drop("clean_text")
