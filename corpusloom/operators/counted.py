"""Packing by token counters that do not add up, such as exact byte-pair encoding.

The packer in ``chunk`` adds counts of units, which is right for counters that are
additive over white space. Here any counter may be passed: sums of unit counts only
guess where a chunk ends, and the joined text of each chunk is counted again, seams
included, before it is accepted. A chunk costs about three counts of its text.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.scale import cut
from corpusloom.operators import chunk as H

Counter = Callable[[list[str]], list[int]]
PIECES = (
    "document_id string, chunk_no int, section_index int, chunk_index int, start_ordinal int, end_ordinal int, page int, chunk_type string, "
    "heading_path array<string>, mkey string, n_units int, tokens int, text string, reason string")
_ARROW = {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}
#: What the fold looks at in every unit, and what only the first unit of a chunk is asked for.
_LOOKED, _FIRST = ("t", "sep", "ok", "mkey", "section", "start", "end"), ("page", "ctype", "path")
#: Characters of chunk text that a task holds before it hands them on.
HELD = 1 << 22


def bytes_counter(width: int) -> Callable[[], Counter]:
    """Started groups of ``width`` UTF-8 bytes: a cheap estimate that no longer adds up over joints."""
    return lambda: lambda texts: [-(-len(t.encode()) // width) for t in texts]


def split_unit(text: str, count: Counter, target: int) -> list[tuple[str, str]]:
    """(separator, piece) of one text at white space: the longest pieces within the target by the counter.

    Joined again they are the text. A single word over the target stays whole.
    """
    words = re.findall(r"(^|\s+)(\S+)", text)
    sums = [0]
    for n in count([s + w for s, w in words]):
        sums.append(sums[-1] + n)
    out, at = [], 0
    while at < len(words):
        end = max(at + 1, bisect_right(sums, sums[at] + target) - 1)

        def joined(stop: int) -> str:
            return words[at][1] + "".join(s + w for s, w in words[at + 1:stop])

        while end > at + 1 and count([joined(end)])[0] > target:
            end -= 1
        while end < len(words) and count([joined(end + 1)])[0] <= target:
            end += 1
        out.append((words[at][0], joined(end)))
        at = end
    return out


def _plain(values: pa.Array) -> list:
    """Python values; by way of numpy, which is several times faster, where that keeps nulls apart."""
    return values.to_pylist() if values.null_count and pa.types.is_integer(values.type) else values.to_numpy(zero_copy_only=False).tolist()


def _join(units: list[dict], first: int, last: int) -> str:
    return units[first]["t"] + "".join(u["sep"] + u["t"] for u in units[first + 1:last + 1])


def _follows(units: list[dict], i: int) -> bool:
    a, b = units[i - 1], units[i]
    return bool(a["ok"] and b["ok"] and a["mkey"] == b["mkey"] and a["section"] == b["section"] and b["start"] <= a["end"] + 1)


def fold(units: list[dict], alone: list[int], joint: list[int], count: Counter, target: int, maximum: int, tail: bool) -> list[tuple[int, int, int]]:
    """(first, last, tokens) of the chunks of one document; no chunk of several units is over ``maximum``.

    A chunk takes a unit while the joined text counts within the target, or while the
    chunk is short and the joined text within the maximum; a short last chunk folds back.
    For counters that never fall when text is appended, this is the greedy packing.
    """
    sums = [0, *accumulate(joint)]
    out, at, n = [], 0, len(units)
    while at < n:
        reach, most = at, target - alone[at] + sums[at + 1]
        while reach + 1 < n and sums[reach + 2] <= most and _follows(units, reach + 1):
            reach += 1
        last, size = reach, alone[at]
        if last > at:
            size = count([_join(units, at, last)])[0]
        while last > at and size > target:
            last -= 1
            size = count([_join(units, at, last)])[0] if last > at else alone[at]
        while last + 1 < n and _follows(units, last + 1):
            more = count([_join(units, at, last + 1)])[0]
            if more > target and not (size < H.SHORT and more <= maximum):
                break
            last, size = last + 1, more
        out.append((at, last, size))
        at = last + 1
    if tail and len(out) > 1 and out[-1][2] < H.SHORT and _follows(units, out[-1][0]):
        both = count([_join(units, out[-2][0], out[-1][1])])[0]
        if both <= maximum:
            out[-2:] = [(out[-2][0], out[-1][1], both)]
    return out


def pack(
    docs: DataFrame, make_counter: Callable[[], Counter], target: int, maximum: int, tail: bool = True, cut_units: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Chunks and rejects of documents with ``us`` (see ``chunk.pack``) by any counter.

    ``make_counter`` is called once per task and returns a function from texts to
    counts. Units over the maximum are cut at white space if they may be cut; a
    document with a word or a whole unit over the maximum is refused. Without
    ``cut_units`` units stay as they come, and any over the maximum refuses its document.
    Null or empty ``us`` give no chunk. One document is one row and is folded at once.
    """
    schema = pa.schema([(name, _ARROW[kind]) for name, kind in map(str.split, PIECES.split(", "))])

    def one(document: str, us: pa.StructArray, count: Counter) -> list[list]:
        units = [dict(zip(_LOOKED, u)) for u in zip(*(_plain(us.field(c)) for c in _LOOKED))]
        fine: list[dict] = []
        for k, (unit, size) in enumerate(zip(units, count([u["t"] for u in units]))):
            unit["k"] = k
            if size <= maximum or not unit["ok"] or not cut_units:
                fine.append({**unit, "n": size})
            else:
                parts = split_unit(unit["t"], count, target)
                sizes = count([t for _, t in parts])
                fine += [{**unit, "sep": s if i else unit["sep"], "t": t, "n": z} for i, ((s, t), z) in enumerate(zip(parts, sizes))]
        alone = [u["n"] for u in fine]
        if max(alone) > maximum:
            return [[document, *[None] * 10, max(alone), None, "unit exceeds the token maximum"]]
        spans = fold(fine, alone, count([u["sep"] + u["t"] for u in fine]), count, target, maximum, tail)
        firsts = pa.array([fine[a]["k"] for a, _, _ in spans])
        rows, seen = [], {}
        for no, ((a, b, size), page, ctype, path) in enumerate(zip(spans, *(us.field(c).take(firsts).to_pylist() for c in _FIRST))):
            u = fine[a]
            seen.setdefault(u["section"], no)
            rows.append([
                document, no, u["section"], no - seen[u["section"]], u["start"], fine[b]["end"], page, ctype, path, u["mkey"], b - a + 1, size, _join(fine, a, b), None])
        return rows

    def made(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(values, f.type) for values, f in zip(zip(*rows), schema)], schema=schema)

    def fold_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = make_counter()
        rows, held = [], 0
        for batch in batches:
            us = batch.column("us")
            # One document at a time, and what is held is handed on: this bounds the memory of a task.
            for i, (document, size) in enumerate(zip(batch.column("document_id").to_pylist(), us.value_lengths().to_pylist())):
                if not size:
                    continue
                done = one(document, us[i].values, count)
                rows += done
                held += sum(len(r[-2] or "") for r in done)
                if held > HELD:
                    yield made(rows)
                    rows, held = [], 0
        if rows:
            yield made(rows)

    rows = cut(docs.select("document_id", "us").mapInArrow(fold_batches, PIECES))
    bad = rows.filter("reason is not null").select("document_id", "reason", "tokens")
    return rows.filter("reason is null").drop("reason"), bad


def chunk_generic(
    blocks: DataFrame, make_counter: Callable[[], Counter], target: int = H.TARGET, maximum: int = H.MAXIMUM, cut_units: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """The general strategy with a counter of the caller."""
    limit = H.hard_max(target, maximum)
    return pack(H.generic_units(blocks, target, limit), make_counter, target, limit, cut_units=cut_units)


def recount(chunks: DataFrame, make_counter: Callable[[], Counter], name: str = "tokens") -> DataFrame:
    """Rows with a column ``text`` and its exact count, one call per Arrow batch."""
    schema = chunks.drop(name).withColumn(name, F.lit(None).cast("int")).schema

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = make_counter()
        for batch in batches:
            full = batch["text"].notna()
            batch[name] = pd.Series(pd.NA, index=batch.index, dtype="Int32")
            batch.loc[full, name] = count(list(batch.loc[full, "text"]))
            yield batch

    return chunks.drop(name).mapInPandas(counted, schema)
