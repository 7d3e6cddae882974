"""Quality rules: repetition coverage from rolling hashes of several n-gram lengths.

Whole slices of documents are worked on at once in numpy: word boundaries from the
bytes, one polynomial hash per word and line, n-gram hashes rolled from word to
word, and coverage as a running sum over the words. A longer n-gram can only be
duplicated where its first and last five words are, so only those are tested.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import common as C

#: Largest share of characters inside duplicated n-grams, by length.
NGRAM_SHARE = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Largest share of characters in later copies of lines. Lines are not counted for the
#: verdict: of three lines, one short line that recurs would be a third.
LINE_CHAR_SHARE = 0.20
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
STEP = np.uint64(0xC2B2AE3D27D4EB4F)

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
SHARES = "ngram_share double, line_share double, line_char_share double"
VERDICT = "base_failed boolean, kept boolean"


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur at least twice, and which of them are not the first of their kind."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    twice, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    twice[order[1:]] = same
    later[order[1:]] = same
    twice[order[:-1]] |= same
    return twice, later


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n words lie in a window of ``width`` words from one of the starts."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.subtract.at(edge, starts + width, 1)
    return np.cumsum(edge[:n]) > 0


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """All counts and shares of the texts of one Arrow column."""
    data, offsets = C.text_bytes(column)
    docs, n = len(offsets) - 1, len(data)

    def per_doc(doc: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(doc, weights=weights, minlength=docs).astype(np.int64)

    start, stop = C.word_bounds(data, offsets)
    point = np.zeros(n + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=point[1:])
    symbol = np.zeros(n + 1, np.int64)
    np.cumsum(SYMBOLS[data], out=symbol[1:])
    doc = np.searchsorted(offsets, start, side="right") - 1
    chars = point[stop] - point[start]
    n_words, word_chars = per_doc(doc), per_doc(doc, chars)
    rolling = C.Rolling(data)
    salt = C.mixed(np.arange(1, docs + 1, dtype=np.uint64))

    # Lines with a word; a line is known by its bytes and its document.
    line = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(data == 10) + 1]))
    line = line[line < n]
    line_stop = np.append(line[1:], n)
    line_stop = line_stop - (data[line_stop - 1] == 10) if len(line) else line_stop
    inked = np.searchsorted(start, line_stop) > np.searchsorted(start, line)
    line, line_stop = line[inked], line_stop[inked]
    line_doc = np.searchsorted(offsets, line, side="right") - 1
    _, line_later = repeated(C.mixed(rolling.of(line, line_stop) ^ salt[line_doc]) + (line_stop - line).astype(np.uint64))
    line_chars = point[line_stop] - point[line]
    n_lines, n_dup_lines = per_doc(line_doc), per_doc(line_doc[line_later])
    dup_line_chars, all_line_chars = per_doc(line_doc[line_later], line_chars[line_later]), per_doc(line_doc, line_chars)

    # n-grams of words, rolled from one word to the next.
    words = len(start)
    word = rolling.of(start, stop) + (stop - start).astype(np.uint64) * STEP
    gram, n_repeat = word, np.zeros(docs, np.int64)
    share = np.zeros(docs)
    hot = np.zeros(words, bool)
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        for width in range(2, max(NGRAM_SHARE) + 1):
            if words < width:
                break
            gram = gram[:-1] * STEP + word[width - 1:]
            if width not in NGRAM_SHARE:
                continue
            inside = doc[: words - width + 1] == doc[width - 1:]
            if width > 5:
                inside &= hot[: words - width + 1] & hot[width - 5: words - 4]
            at = np.flatnonzero(inside)
            twice, later = repeated(C.mixed(gram[at] ^ salt[doc[at]]))
            if width == 5:
                hot[at[twice]] = True
                n_repeat = per_doc(doc[covered(at[twice], 5, words)])
            mask = covered(at[later], width, words)
            part = per_doc(doc[mask], chars[mask]) / np.maximum(word_chars, 1)
            share = np.maximum(share, part / NGRAM_SHARE[width])
        out = {
            "n_words": n_words, "word_chars": word_chars, "n_symbols": np.diff(symbol[offsets]), "n_dup_lines": n_dup_lines,
            "n_repeat_words": n_repeat, "ngram_share": share, "line_share": n_dup_lines / np.maximum(n_lines, 1),
            "line_char_share": dup_line_chars / np.maximum(all_line_chars, 1)}
    out["base_failed"] = (n_words < 10) | (100 * n_repeat > 20 * n_words)
    clean = (share <= 1) & (out["line_char_share"] <= LINE_CHAR_SHARE)
    out["kept"] = clean & ~out["base_failed"]
    return out


def rate(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns of every row (all by default) with counts, shares, base_failed and kept.

    ``ngram_share`` is the share of word characters in later copies of n-grams,
    divided by the limit of its length, at its largest; ``line_share`` and
    ``line_char_share`` count later copies of lines. Null texts have no words and
    fail. Rows are judged one by one, so ties, repeated rows and empty tables need
    no rule. Columns of the input that clash with a result are replaced by it.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "ngram_share", "line_share", "line_char_share",
            "base_failed", "kept"]
    names = [c for c in (docs.columns if keep is None else keep) if c not in made]
    inner = docs.select(*names, C.text_or_empty(text).alias("_measured"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in C.slices(batches, "_measured"):
            got = measure(part.column("_measured"))
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:-1], *(pa.array(got[c]) for c in made)], names=[*names, *made])

    return inner.mapInArrow(run, ", ".join(filter(None, [schema, COUNTS, SHARES, VERDICT])))


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, unchanged; columns of any name stay as they are."""
    row = docs.select(F.struct("*").alias("row"), C.text_or_empty().alias("text"))
    return rate(row, keep=["row"]).filter("kept").select("row.*")


def query(spark: SparkSession, folder: str) -> DataFrame:
    return rate(C.documents(spark, folder), keep=["doc_id"])
