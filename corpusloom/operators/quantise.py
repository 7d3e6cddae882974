"""Approximate vector search by product quantisation with exact re-scoring.

A unit vector is cut into short pieces, each known by the nearest of 256 centroids of
its piece, so a row is a few bytes. A query has a table of products with all centroids;
the sum over a row's bytes approximates the cosine. The best rows by that sum, a fixed
number for each query, are measured exactly; all others never meet the query's vector.
Centroids are fitted on at most ``SAMPLE`` rows, chosen by a hash of their id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.scale import broadcast_checked, cut, top_per_key
from corpusloom.operators.retrieve import DENSE_BLOCK, by_score

SAMPLE, PIECE, CENTROIDS, ROUNDS = 20_000, 4, 256, 8
#: Rows measured exactly for every row that is asked for.
DEPTH = 12
#: Rows coded at a time and queries scored at a time, which bound a task's Python however long batches are.
ROWS, ASKED = 1024, 64


def fit(vectors: DataFrame, piece: int = PIECE) -> np.ndarray:
    """Centroids (pieces x 256 x length) from a bounded sample; a last short piece is filled with zeros."""
    head = vectors.filter("vec is not null").orderBy(F.xxhash64("chunk_id"), "chunk_id").select("vec").limit(SAMPLE).toPandas()
    if not len(head):
        return np.zeros((1, 1, piece))
    cut_up = pieces(unit(np.array(head["vec"].tolist(), dtype=float)), piece)
    return np.stack([centroids(cut_up[:, j]) for j in range(cut_up.shape[1])])


def unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms == 0, 1.0, norms)


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows, without an object per number."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    width = len(flat) // len(column)
    if not pc.all(pc.equal(pc.list_value_length(column), width)).as_py():
        raise ValueError("vectors differ in length")
    return flat.astype(float).reshape(len(column), width)


def pieces(rows: np.ndarray, piece: int) -> np.ndarray:
    width = -(-rows.shape[1] // piece) * piece
    filled = np.zeros((len(rows), width))
    filled[:, : rows.shape[1]] = rows
    return filled.reshape(len(rows), -1, piece)


def centroids(rows: np.ndarray, k: int = CENTROIDS) -> np.ndarray:
    """Lloyd's rounds from evenly spaced rows; empty centroids stay where they are."""
    k = min(k, len(rows))
    centres = rows[np.linspace(0, len(rows) - 1, k).astype(int)].copy()
    for _ in range(ROUNDS):
        owner = nearest(rows, centres)
        count = np.bincount(owner, minlength=k)
        for d in range(rows.shape[1]):
            total = np.bincount(owner, rows[:, d], k)
            centres[:, d] = np.where(count > 0, total / np.maximum(count, 1), centres[:, d])
    return centres


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(rows @ centres.T - 0.5 * (centres**2).sum(axis=1), axis=1)


def encode(vectors: DataFrame, books: np.ndarray | None = None) -> DataFrame:
    """``vectors`` (chunk_id, vec) with ``codes``, a byte per piece; a null vector has null codes and is never found.

    The centroids travel with the rows' DataFrame as ``books``. Write the result to keep an index.
    """
    books = fit(vectors) if books is None else books
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                codes: list = [None] * batch.num_rows
                vec = batch.column("vec")
                known = np.flatnonzero(np.asarray(vec.is_valid()))
                if len(known):
                    rows = pieces(unit(matrix(vec.drop_null())), given.shape[2])
                    coded = np.stack([nearest(rows[:, j], given[j]) for j in range(given.shape[0])], axis=1).astype(np.uint8)
                    for i, row in zip(known.tolist(), coded, strict=True):
                        codes[i] = row.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column("chunk_id"), vec, pa.array(codes, pa.binary())], names=["chunk_id", "vec", "codes"])

    coded = vectors.select("chunk_id", F.col("vec").cast("array<double>").alias("vec")).mapInArrow(run, "chunk_id string, vec array<double>, codes binary")
    coded.books = shared
    return coded


def candidates(coded: DataFrame, queries: DataFrame, k: int, depth: int = DEPTH, books=None) -> DataFrame:
    """(qid, chunk_id): the ``depth * k`` rows of each query (qid, vec) with the largest approximate cosine."""
    books = coded.books if books is None else books
    spark = coded.sparkSession
    want = depth * k
    queries = queries.filter("vec is not null").select("qid", "vec")
    parts = max(1, -(-queries.count() // DENSE_BLOCK))
    found = []
    for part in range(parts):  # a block of queries travels to the tasks as one table
        block = queries.filter(F.pmod(F.xxhash64("qid"), F.lit(parts)) == part).toPandas()
        if not len(block):
            continue
        asked = pieces(unit(np.array(block["vec"].tolist(), dtype=float)), books.value.shape[2])
        tables = np.einsum("jcd,qjd->jcq", books.value, asked).astype(np.float32)
        side = spark.sparkContext.broadcast((block["qid"].to_numpy(), tables))

        def run(batches: Iterator[pa.RecordBatch], side=side) -> Iterator[pa.RecordBatch]:
            qids, tables = side.value
            for batch in batches:
                codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                count = min(want, batch.num_rows)
                for start in range(0, len(qids) if count else 0, ASKED):
                    asked = qids[start:start + ASKED]
                    scores = np.zeros((batch.num_rows, len(asked)), np.float32)
                    for j in range(codes.shape[1]):
                        scores += tables[j][:, start:start + ASKED][codes[:, j]]
                    rows = np.argpartition(-scores, count - 1, axis=0)[:count].T.ravel()
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.repeat(asked, count)), batch.column("chunk_id").take(pa.array(rows)),
                        pa.array(scores[rows, np.repeat(np.arange(len(asked)), count)].astype(float))], names=["qid", "chunk_id", "score"])

        near = coded.filter("codes is not null").select("chunk_id", "codes").mapInArrow(run, "qid long, chunk_id string, score double")
        found.append(top_per_key(near, ["qid"], by_score(), want).select("qid", "chunk_id"))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "qid long, chunk_id string")


def cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def topk(coded: DataFrame, queries: DataFrame, k: int, depth: int = DEPTH) -> DataFrame:
    """(qid, chunk_id, score, rank) by exact cosine among the candidates; ties by id."""
    near = cut(candidates(coded, queries, k, depth))
    rows = coded.select("chunk_id", "vec").join(broadcast_checked(near), "chunk_id")
    asked = broadcast_checked(queries.select("qid", F.col("vec").cast("array<double>").alias("asked")))
    scored = rows.join(asked, "qid").select("qid", "chunk_id", (F.round(cosine(F.col("vec"), F.col("asked")), 6) + 0.0).alias("score"))
    return top_per_key(scored, ["qid"], by_score(), k)
