"""Tables of rows into header-repeating blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.scale import broadcast_checked, cut, running_number

# Token budget and row bound of one CSV block, rows of one sheet block.
CSV_TOKENS, CSV_ROWS, SHEET_ROWS = 400, 50, 50
BLOCK = 4096
#: Rows that a task holds before it hands them on.
AT_ONCE = 1 << 16


def row_cost(cells: Column) -> Column:
    """Estimated tokens of a row: (characters + columns + 3) // 4, at least 1."""
    chars = F.length(F.array_join(cells, "")) + F.size(cells)
    return F.greatest(F.lit(1), F.floor((chars + 3) / 4)).cast("int")


def _following(costs: np.ndarray, header: int, budget: int, max_rows: int, length: int) -> np.ndarray:
    """For every row: where the batch after the one that starts here begins."""
    sums = np.concatenate([[0], np.cumsum(costs)])
    total = len(costs)
    starts = np.arange(length)
    reach = np.searchsorted(sums, sums[starts] + budget - header, side="right") - 1
    return np.minimum(np.minimum(np.maximum(reach, starts + 1), starts + max_rows), total)


def greedy_batches(rows: DataFrame, budget: int = CSV_TOKENS, max_rows: int = CSV_ROWS) -> DataFrame:
    """Batch number of every data row (file_id, row_no from 0, cost, header_cost).

    A batch closes when the next row would exceed the budget or the row bound. The
    fold is sequential per file, yet no file is handled whole: for each block of
    rows the batch that is open at its start can begin at no more than ``max_rows``
    places, so a block is a small table "entry -> (exit, batches)". These tables are
    composed per run of blocks, then per file, and handed down again.
    """
    number = F.floor(F.col("row_no") / BLOCK).cast("long")
    own = rows.withColumn("block", number).withColumn("ahead", F.lit(False))
    early = own.filter((F.col("row_no") % BLOCK < max_rows) & (F.col("block") > 0))
    ahead = early.withColumn("block", F.col("block") - 1).withColumn("ahead", F.lit(True))
    # One row per block; files of one block begin at its first row and need no tables.
    both = own.unionByName(ahead)
    groups = cut(both.groupBy("file_id", "block").agg(
        F.array_sort(F.collect_list(F.struct("row_no", "cost"))).alias("rows"), F.count_if(~F.col("ahead")).cast("int").alias("length"),
        F.min("header_cost").alias("header_cost")))
    large = broadcast_checked(cut(groups.filter("block > 0").select("file_id").distinct()))
    spread = groups.join(large, "file_id", "left_semi").select("file_id", "block", "length", "header_cost", F.posexplode("rows").alias("place", "r"))
    spread = spread.select("file_id", "block", "header_cost", "r.*", (F.col("place") >= F.col("length")).alias("ahead"))

    def table(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_no")
        length = int((~pdf["ahead"]).sum())
        nxt = _following(pdf["cost"].to_numpy(), int(pdf["header_cost"].iloc[0]), budget, max_rows, length)
        leave, count = np.zeros(length, dtype=int), np.zeros(length, dtype=int)
        for i in range(length - 1, -1, -1):
            far = nxt[i] >= length
            leave[i] = nxt[i] - length if far else leave[nxt[i]]
            count[i] = 1 + (0 if far else count[nxt[i]])
        exits, counts = [], []
        for entry in range(max_rows):
            inside = entry < length
            exits.append(int(leave[entry]) if inside else entry - length)
            counts.append(int(count[entry]) if inside else 0)
        return pd.DataFrame({"file_id": [pdf["file_id"].iloc[0]], "block": [pdf["block"].iloc[0]],
                             "exits": [exits], "counts": [counts]})

    maps = spread.groupBy("file_id", "block").applyInPandas(
        table, "file_id string, block long, exits array<int>, counts array<int>")
    maps = cut(maps.withColumn("run", F.floor(F.col("block") / BLOCK).cast("long")))

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        exits, counts = np.arange(max_rows), np.zeros(max_rows, dtype=int)
        for e, c in zip(pdf["exits"], pdf["counts"]):
            counts = counts + np.asarray(c)[exits]
            exits = np.asarray(e)[exits]
        return pd.DataFrame({"file_id": [pdf["file_id"].iloc[0]], "block": [pdf["run"].iloc[0]],
                             "exits": [exits.tolist()], "counts": [counts.tolist()]})

    def enter(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        entry, base = int(pdf["entry"].iloc[0]), int(pdf["base"].iloc[0])
        out = []
        for block, e, c in zip(pdf["block"], pdf["exits"], pdf["counts"]):
            out.append((pdf["file_id"].iloc[0], block, entry, base))
            base, entry = base + c[entry], e[entry]
        return pd.DataFrame(out, columns=["file_id", "block", "entry", "base"])

    entries = "file_id string, block long, entry int, base long"
    runs = maps.groupBy("file_id", "run").applyInPandas(
        compose, "file_id string, block long, exits array<int>, counts array<int>")
    run_entries = runs.withColumn("entry", F.lit(0)).withColumn("base", F.lit(0)).groupBy("file_id").applyInPandas(enter, entries)
    opened = maps.join(run_entries.withColumnRenamed("block", "run"), ["file_id", "run"])
    block_entries = opened.groupBy("file_id", "run").applyInPandas(enter, entries)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            made, size = [], 0
            columns = (given.column(c) for c in ("file_id", "numbers", "costs", "length", "header_cost", "entry", "base"))
            for file, numbers, costs, length, header, entry, base in zip(*columns, strict=True):
                length, at, current = length.as_py(), entry.as_py(), base.as_py()
                nxt = _following(costs.values.to_numpy(), header.as_py(), budget, max_rows, length)
                batch = np.full(length, current - 1)
                while at < length:
                    batch[at:nxt[at]] = current
                    at, current = nxt[at], current + 1
                made.append(pa.RecordBatch.from_arrays(
                    [pa.array([file.as_py()] * length, pa.string()), numbers.values[:length], pa.array(batch)], names=["file_id", "row_no", "batch"]))
                size += length
                if size > AT_ONCE:
                    yield pa.concat_batches(made)
                    made, size = [], 0
            if made:
                yield pa.concat_batches(made)

    started = groups.join(block_entries, ["file_id", "block"], "left").select(
        "file_id", F.col("rows.row_no").alias("numbers"), F.col("rows.cost").alias("costs"), "length", "header_cost",
        F.coalesce("entry", F.lit(0)).alias("entry"), F.coalesce("base", F.lit(0).cast("long")).alias("base"))
    return started.mapInArrow(assign, "file_id string, row_no long, batch long")


def csv_blocks(cells: DataFrame, header: DataFrame) -> DataFrame:
    """Table blocks of delimited files.

    ``cells``: file_id, row_no (data rows from 0), cells. ``header``: file_id,
    header. Blocks hold at most CSV_ROWS rows, so collecting a block is bounded.
    """
    costed = cells.withColumn("cost", row_cost(F.col("cells"))).join(
        header.withColumn("header_cost", row_cost(F.col("header"))), "file_id")
    batches = greedy_batches(costed.select("file_id", "row_no", "cost", "header_cost"))
    rows = cells.join(batches, ["file_id", "row_no"])
    return rows.groupBy("file_id", "batch").agg(
        F.sum(row_cost(F.col("cells"))).cast("int").alias("tokens"), F.count("*").alias("n_rows"),
        F.array_sort(F.collect_list(F.struct("row_no", "cells"))).alias("items")
    ).join(header, "file_id").select(
        "file_id", F.col("batch").alias("ordinal"), "n_rows", "tokens",
        F.concat(F.array("header"), F.transform("items", lambda r: r["cells"])).alias("rows"))


def cell_text(column: Column, kind: str) -> Column:
    """One stable text per cell: booleans upper-case, dates ISO, null empty."""
    if kind == "boolean":
        text = F.when(column, "TRUE").otherwise("FALSE")
        return F.when(column.isNull(), "").otherwise(text)
    if kind in ("date", "timestamp"):
        pattern = "yyyy-MM-dd" if kind == "date" else "yyyy-MM-dd'T'HH:mm:ss"
        return F.coalesce(F.date_format(column, pattern), F.lit(""))
    return F.coalesce(column.cast("string"), F.lit(""))


def sheet_blocks(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Block number of every non-empty sheet row (sheet, cells): header + 49 rows each."""
    filled = rows.filter(F.array_join("cells", "") != "")
    numbered = running_number(filled, ["sheet"], order, "rn")
    sizes = numbered.groupBy("sheet").agg(F.max("rn").alias("total"))
    block = F.when((F.col("total") <= SHEET_ROWS) | (F.col("rn") == 1), 0).otherwise(
        F.floor((F.col("rn") - 2) / (SHEET_ROWS - 1)))
    return numbered.join(sizes, "sheet").select(
        "sheet", F.col("rn").cast("long").alias("rn"), block.cast("long").alias("block"), (F.col("rn") == 1).alias("is_header"), "cells")
