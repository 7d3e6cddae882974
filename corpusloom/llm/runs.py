"""Periodic runs of words, found by internal pattern matching.

A run of period p and length >= max(12, 2p) holds, in its first ``length - p``
words, a whole dyadic block whose copy stands p words further on. Blocks of 2**k
words start at every 2**(k - 1)-th word; level k answers for the periods
3 * 2**(k - 1) - 1 to 3 * 2**k - 2 (level 2 for all smaller ones), so a copy lies in
the window of 3 * 2**k - 2 words behind its block. The occurrences of a block are an
interval of the suffix array; a wavelet matrix over that array answers range count
and range successor, so that the occurrences inside the window are found without
reading others. Up to 8 occurrences are candidates one by one. More can only stand
in progressions whose difference is the period of the block: then the maximal
stretches of that period are compared by their ends, and stretches that touch give
one candidate per step. Each candidate is extended word by word in both directions
(ranks of dyadic factors), so nothing is reported that is not a run.

Everything happens inside a document; texts are not shuffled. Memory is some hundred
bytes for each word of a slice of texts, or of the longest text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import common as C

LEAST = 12
#: Factors of up to 2 ** TOP words keep their ranks; longer extensions take several steps.
TOP = 12
#: A block with more occurrences in its window repeats at less than half its length.
FEW = 8


class Factors:
    """Suffix array of documents side by side, and ranks of their factors of 1, 2, 4 ... words.

    ``ids`` are words as numbers, ``ends`` the end of each document. Equal ranks of a
    level mean equal factors of the same document; a factor that its document cuts
    short equals no other.
    """

    def __init__(self, ids: np.ndarray, ends: np.ndarray) -> None:
        n = self.n = len(ids)
        sizes = np.diff(ends, prepend=0)
        doc = np.repeat(np.arange(len(ends)), sizes)
        self.end = np.repeat(ends, sizes)
        start = self.end - np.repeat(sizes, sizes)
        key = doc * (int(ids.max(initial=0)) + 1) + ids
        self.array = np.argsort(key, kind="stable")
        rank = self._ranked(np.arange(n), key[self.array])
        self.levels = []
        blocks = []
        level, open_ = 0, None
        while True:
            size = np.bincount(rank, minlength=n)
            if level <= TOP:
                self.levels.append(np.append(rank, -1).astype(np.int32))
            repeated = size[rank] > 1
            if level >= 2:
                step = 1 << (level - 1)
                at = np.flatnonzero(repeated)
                at = at[(at - start[at]) % step == 0]
                blocks.append((level, at, rank[at], rank[at] + size[rank[at]]))
            slots = np.flatnonzero(size[rank[self.array]] > 1)
            if not len(slots):
                break
            open_ = self.array[slots]
            ahead = open_ + (1 << level)
            inside = ahead < self.end[open_]
            second = np.where(inside, rank[np.minimum(ahead, n - 1)] + 1, 0)
            key = rank[open_] * (n + 1) + second
            order = np.argsort(key, kind="stable")
            self.array[slots] = open_[order]
            rank = rank.copy()
            self._ranked(slots, key[order], rank)
            level += 1
        self.blocks = blocks

    def _ranked(self, slots: np.ndarray, keys: np.ndarray, rank: np.ndarray | None = None) -> np.ndarray:
        """Rank of a suffix: the first slot of its group in the array."""
        rank = np.empty(self.n, np.int64) if rank is None else rank
        if len(slots):
            new = np.append(True, keys[1:] != keys[:-1])
            rank[self.array[slots]] = slots[new][np.cumsum(new) - 1]
        return rank

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i on equal those from j on (i < j)."""
        return self._extend(i, j, 1)

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i equal those before j (i < j)."""
        return self._extend(i, j, -1)

    def _extend(self, i: np.ndarray, j: np.ndarray, way: int) -> np.ndarray:
        i, j = i.astype(np.int64), j.astype(np.int64)
        done = np.zeros(len(i), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            rank, width = self.levels[level], 1 << level
            active = np.arange(len(i))
            while len(active):
                a, b = i[active] + way * done[active], j[active] + way * done[active]
                if way < 0:
                    a, b = a - width, b - width
                same = (a >= 0) & (b < self.n)
                same &= rank[np.where(a >= 0, a, self.n)] == rank[np.clip(b, 0, self.n)]
                active = active[same]
                done[active] += width
                if level < len(self.levels) - 1:
                    break
        return done


class Wavelet:
    """Wavelet matrix over a list of numbers below its length; questions come in batches."""

    def __init__(self, values: np.ndarray) -> None:
        self.bits = max(len(values) - 1, 0).bit_length()
        self.zeros = []
        for bit in range(self.bits - 1, -1, -1):
            low = (values >> bit) & 1 == 0
            before = np.zeros(len(values) + 1, np.int32)
            np.cumsum(low, out=before[1:])
            self.zeros.append(before)
            values = np.concatenate([values[low], values[~low]])

    def below(self, lo: np.ndarray, hi: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many numbers at places lo to hi - 1 are below ``bound``."""
        found = np.zeros(len(lo), np.int64)
        over = bound >> self.bits > 0
        found[over] = (hi - lo)[over]
        for bit, before in zip(range(self.bits - 1, -1, -1), self.zeros, strict=True):
            one = (bound >> bit) & 1 == 1
            a, b = before[lo], before[hi]
            found += np.where(one & ~over, b - a, 0)
            lo, hi = np.where(one, lo - a + before[-1], a), np.where(one, hi - b + before[-1], b)
        return found

    def nth(self, lo: np.ndarray, hi: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """The number with ``nth`` smaller ones among those at places lo to hi - 1."""
        found = np.zeros(len(lo), np.int64)
        nth = nth.copy()
        for bit, before in zip(range(self.bits - 1, -1, -1), self.zeros, strict=True):
            a, b = before[lo], before[hi]
            one = nth >= b - a
            nth -= np.where(one, b - a, 0)
            found |= one.astype(np.int64) << bit
            lo, hi = np.where(one, lo - a + before[-1], a), np.where(one, hi - b + before[-1], b)
        return found

    def successor(self, lo: np.ndarray, hi: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The smallest number from ``bound`` on among those at places lo to hi - 1; -1 if there is none."""
        nth = self.below(lo, hi, bound)
        there = nth < hi - lo
        return np.where(there, self.nth(lo, hi, np.minimum(nth, hi - lo - 1)), -1)


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``counts`` things its number and 0, 1, ... inside it."""
    item = np.repeat(np.arange(len(counts)), counts)
    return item, np.arange(len(item)) - np.repeat(np.cumsum(counts) - counts, counts)


def candidates(factors: Factors) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (place, period) that hold one place inside the first part of every run."""
    places, periods = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    wavelet = None
    for level, at, lo, hi in factors.blocks:
        if not len(at):
            continue
        wavelet = wavelet or Wavelet(factors.array)
        width, least, most = 1 << level, 3 * (1 << (level - 1)) - 1 if level > 2 else 1, 3 * (1 << level) - 2
        first = wavelet.below(lo, hi, at + 1)
        number = wavelet.below(lo, hi, np.minimum(at + most, factors.end[at] - 1) + 1) - first
        few = np.flatnonzero((number > 0) & (number <= FEW))
        item, nth = spread(number[few])
        block = few[item]
        places.append(at[block])
        periods.append(wavelet.nth(lo[block], hi[block], first[block] + nth) - at[block])
        many = np.flatnonzero(number > FEW)
        if len(many):
            for place, period in progressions(factors, wavelet, at[many], lo[many], hi[many], first[many], width, most):
                places.append(place)
                periods.append(period)
        keep = (periods[-1] >= least) & (periods[-1] <= most)
        places[-1], periods[-1] = places[-1][keep], periods[-1][keep]
    return np.concatenate(places), np.concatenate(periods)


def progressions(
    factors: Factors, wavelet: Wavelet, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, first: np.ndarray, width: int, most: int,
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidates of blocks that repeat at a distance of less than half their width."""
    item, nth = spread(np.full(len(at), FEW + 1))
    seen = wavelet.nth(lo[item], hi[item], first[item] + nth).reshape(len(at), FEW + 1)
    unit = np.diff(np.column_stack([at, seen]), axis=1).min(axis=1)
    start, stop = at - factors.behind(at, at + unit), at + unit + factors.ahead(at, at + unit)
    yield at, unit
    ask, rows = stop - width + 1, np.arange(len(at))
    while len(rows):
        here = at[rows]
        found = wavelet.successor(lo[rows], hi[rows], ask)
        inside = (found >= 0) & (found <= np.minimum(here + most, factors.end[here] - 1))
        rows, found, here = rows[inside], found[inside], here[inside]
        d = unit[rows]
        start2, stop2 = found - factors.behind(found, found + d), found + d + factors.ahead(found, found + d)
        yield here, start2 - start[rows]
        yield here, stop2 - stop[rows]
        # Stretches that touch: every occurrence of the block in the second one.
        last = np.minimum(stop2 - width, here + most)
        touch = np.flatnonzero(stop[rows] >= start2)
        item, step = spread((last - found)[touch] // d[touch] + 1)
        yield here[touch][item], found[touch][item] - here[touch][item] + step * d[touch][item]
        ask = stop2 - width + 1


def runs(ids: np.ndarray, ends: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of documents side by side, by start and then period.

    ``least`` is the least length, of 12 words or more.
    """
    factors = Factors(ids, ends)
    place, period = candidates(factors)
    good = (period > 0) & (place + period < factors.end[place]) if len(place) else np.zeros(0, bool)
    pairs = np.unique(np.column_stack([period[good], place[good]]), axis=0)
    period, place = pairs[:, 0], pairs[:, 1]
    start = place - factors.behind(place, place + period)
    stop = place + period + factors.ahead(place, place + period)
    long = stop - start >= np.maximum(least, 2 * period)
    start, stop, period = start[long], stop[long], period[long]
    order = np.lexsort((period, stop, start))
    start, stop, period = start[order], stop[order], period[order]
    # The same stretch at a multiple of its period is the same run.
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])
    start, stop, period = start[new], stop[new], period[new]
    order = np.lexsort((period, start))
    return start[order], stop[order], period[order]


def planted(n: int, doc: int | None) -> np.ndarray | None:
    """Which original word stands at each place of a text of n words under the query's repetition; None: all stay."""
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    place = np.arange(n)
    place[a:] = a + (place[a:] - a) % p
    return place


KIND = "array<struct<start: bigint, length: bigint, period: bigint>>"
FOUND = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
DIGEST = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def _slice(texts: list[bytes], docs: list | None) -> Iterator[tuple[list[tuple[int, int, int]], bytes]]:
    """Runs and collapsed text of each text."""
    numbers: dict[bytes, int] = defaultdict(count().__next__)
    words, ids = [], []
    for k, text in enumerate(texts):
        own = text.split()
        place = planted(len(own), docs[k]) if docs is not None else None
        if place is not None:
            own = [own[i] for i in place.tolist()]
        words.append(own)
        ids.append(np.fromiter((numbers[w] for w in own), np.int64, len(own)))
    ends = np.cumsum([len(w) for w in words])
    start, stop, period = runs(np.concatenate(ids), ends)
    owner = np.searchsorted(ends, start, side="right")
    cuts = np.searchsorted(owner, np.arange(len(words) + 1))
    total = int(ends[-1]) if len(ends) else 0
    covered = np.zeros(total + 1, np.int64)
    np.add.at(covered, start + period, 1)
    np.add.at(covered, stop, -1)
    kept = np.cumsum(covered) == 0
    for k, own in enumerate(words):
        base = int(ends[k]) - len(own)
        a, b = cuts[k], cuts[k + 1]
        found = list(zip((start[a:b] - base).tolist(), (stop[a:b] - start[a:b]).tolist(), period[a:b].tolist(), strict=True))
        left = [own[i] for i in np.flatnonzero(kept[base: base + len(own)]).tolist()] if a < b else own
        yield found, b" ".join(left)


def find(docs: DataFrame, text: str = "text", edit_by: str | None = None) -> DataFrame:
    """All columns of every row, with ``runs`` (start, length, period), ``collapsed`` text and a digest of both.

    ``runs`` go by start, then period; ``collapsed`` joins by one space the words
    that no run holds after its first period. Null and empty texts have no runs and an
    empty collapsed text. With ``edit_by``, the name of an integer column, words of
    the texts are first repeated as the query's contract says; a null there changes
    nothing. Repeated rows are treated alike; an empty table gives an empty result;
    input columns with the names of new ones are replaced.
    """
    new = ["runs", "collapsed", *DIGEST]
    names = [c for c in docs.columns if c not in new]
    inner = docs.select(*[f"`{c}`" for c in names], C.text_or_empty(text).alias("_runs_text"),
                        *([docs[edit_by].cast("long").alias("_runs_edit")] if edit_by else []))
    extra = 2 if edit_by else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in C.slices(batches, "_runs_text"):
            texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in part.column("_runs_text").cast(pa.large_binary())]
            out = []
            for found, left in _slice(texts, part.column("_runs_edit").to_pylist() if edit_by else None):
                best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
                listed = "".join(f"{s},{n},{p}\n" for s, n, p in found).encode()
                out.append((
                    [{"start": s, "length": n, "period": p} for s, n, p in found], left.decode(), len(found), *best,
                    1000 * best[1] // best[2] if found else None, hashlib.sha256(listed).hexdigest(), hashlib.sha256(left).hexdigest()))
            kinds = [FOUND, pa.string(), *[pa.int64()] * 5, pa.string(), pa.string()]
            made = [pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns[:-extra], *made], names=[*names, *new])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema.fields[:-extra])
    kinds = f"runs {KIND}, collapsed string, " + ", ".join(f"{c} {'string' if 'sha256' in c else 'long'}" for c in DIGEST)
    return inner.mapInArrow(run, ", ".join(x for x in (kept, kinds) if x))


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = C.documents(spark, folder).select("doc_id", "text")
    return find(docs, edit_by="doc_id").select("doc_id", *DIGEST)
