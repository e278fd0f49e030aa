"""Periodic runs of words, found online by catchers over dyadic blocks.

Words are appended to a stream. Whenever a block of 2**k words that starts at a multiple of 2**k is
complete, a catcher waits for its next copies 2 to 4 block lengths further on (1 to 3 words for blocks
of one word): the left half of every square of that period contains such a block. A copy starts two
suffix comparisons at its distance, the period: one backwards at once, one forwards, which each appended
word advances until it meets a different word. A comparison that has matched a period's worth of words
has caught a square; squares with the same period that touch are one comparison and so one run.

The steps of all words of one append are taken by numpy at once, level by level. Words are compared by
prefix sums of random numbers; every reported run is verified word by word, and another seed is taken in
the (never seen) case that a sum has lied.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

STREAM_WORDS = 400_000  # words of several documents that share a stream
APPENDED = 131_072  # words of one append
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))


def _mixed(words: np.ndarray, seed: int) -> np.ndarray:
    """A pseudo-random 64-bit number for each word number."""
    x = words.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64((seed * 0x94D049BB133111EB + 1) % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 0xD6E8FEB86659FD93)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(29))


class Catchers:
    """Online search for runs: stretches of words with a period that repeat it min_exponent times or more.

    Words are whole numbers. longest: no run is longer than this (the longest document of the stream).
    """

    def __init__(self, min_exponent: int = 3, min_length: int = 24, longest: int | None = None, seed: int = 1):
        if min_exponent < 2:
            raise ValueError("a run repeats its period at least twice")
        self.min_exponent, self.min_length, self.longest, self.seed = min_exponent, min_length, longest, seed
        self.n = 0
        self.words = np.zeros(0, np.int64)
        self.sums = np.zeros(1, np.uint64)  # sums[i]: of the first i words, the j-th times base**j
        self.powers, self.inverse = np.ones(1, np.uint64), np.ones(1, np.uint64)
        self.open = np.zeros((3, 0), np.int64)  # start, end, period of comparisons that have met no different word
        self.found = np.zeros((3, 0), np.int64)

    def _grow(self, size: int) -> None:
        if size <= len(self.words):
            return
        size = max(size, 2 * len(self.words))
        for name, extra in (("words", 0), ("sums", 1)):
            old = getattr(self, name)
            new = np.zeros(size + extra, old.dtype)
            new[: len(old)] = old
            setattr(self, name, new)
        for name, base in (("powers", _BASE), ("inverse", _INVERSE)):
            steps = np.full(size + 1, base)
            steps[0] = 1
            setattr(self, name, np.multiply.accumulate(steps))

    def _same(self, a: np.ndarray, c: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """Whether the words from a and from c (a < c) on are equal, for `length` words."""
        return (self.sums[a + length] - self.sums[a]) * self.powers[c - a] == self.sums[c + length] - self.sums[c]

    def _common(self, a: np.ndarray, c: np.ndarray, forward: bool) -> np.ndarray:
        """Number of equal words from a and c on, or before them; strides double while words agree, then halve."""
        ext, room = np.zeros(len(a), np.int64), (self.n - c if forward else a)
        step, rising = np.ones(len(a), np.int64), np.ones(len(a), bool)
        left = np.flatnonzero(room > 0)
        while len(left):
            s, e = step[left], ext[left]
            fits = e + s <= room[left]
            at = e if forward else -e - s
            ok = fits.copy()
            some = left[fits]
            ok[fits] = self._same(a[some] + at[fits], c[some] + at[fits], s[fits])
            ext[left] += np.where(ok, s, 0)
            rising[left] &= ok
            step[left] = np.where(rising[left], 2 * s, s // 2)
            left = left[step[left] > 0]
        return ext

    def append(self, words: np.ndarray) -> np.ndarray:
        """Take in further words; returns start, end and period of the runs whose first square ends in them."""
        before, self.n = self.n, self.n + len(words)
        self._grow(self.n)
        self.words[before : self.n] = words
        self.sums[before + 1 : self.n + 1] = self.sums[before] + np.cumsum(_mixed(words, self.seed) * self.powers[before : self.n])
        ends = self.open[1] + self._common(self.open[1] - self.open[2], self.open[1], forward=True)
        had = self.open[1] - self.open[0] >= 2 * self.open[2]
        now = [np.vstack([self.open[0], ends, self.open[2]])]
        k, least = 0, 1  # least: smallest period of the level
        while least + (1 << k) <= self.n and (self.longest is None or self.min_exponent * least <= self.longest):
            now.append(self._caught(before, k))
            k += 1
            least = 2 << k
        runs = np.concatenate(now, axis=1)
        had = np.concatenate([had, np.zeros(runs.shape[1] - len(had), bool)])
        length = runs[1] - runs[0]
        is_open = runs[1] == self.n
        self.open = runs[:, is_open]
        enough = ~is_open & (length >= np.maximum(self.min_length, self.min_exponent * runs[2]))
        self.found = np.concatenate([self.found, runs[:, enough]], axis=1)
        return runs[:, ~had & (length >= 2 * runs[2])]

    def _caught(self, before: int, k: int) -> np.ndarray:
        """Comparisons started by copies of blocks of 2**k words that end among the words from `before` on."""
        w = 1 << k
        first, last = max(0, before - w + 1), self.n - w  # where such copies start
        none = np.zeros((3, 0), np.int64)
        if last < first:
            return none
        here = (self.sums[first + w : last + w + 1] - self.sums[first : last + 1]) * self.inverse[first : last + 1]
        low = max(0, first // w - 3)
        starts = np.arange(low, last // w + 1, dtype=np.int64) * w
        blocks = (self.sums[starts + w] - self.sums[starts]) * self.inverse[starts]
        place = np.arange(first, last + 1, dtype=np.int64) // w - low
        copies, sources = [], []
        for back in (1, 2, 3) if k == 0 else (2, 3):
            known = int(np.searchsorted(place, back))  # before that no block lies far enough back
            at = known + np.flatnonzero(here[known:] == blocks[place[known:] - back])
            copies.append(at + first)
            sources.append(starts[place[at] - back])
        i, b = np.concatenate(copies), np.concatenate(sources)
        if not len(i):
            return none
        # A copy whose predecessor also is one, at the same distance, belongs to that one's comparison.
        behind = np.flatnonzero(b >= w)
        follows = np.zeros(len(i), bool)
        follows[behind] = self._same(b[behind] - w, i[behind] - w, w)
        i, b = i[~follows], b[~follows]
        start = b - self._common(b, i, forward=False)
        end = i + w + self._common(b + w, i + w, forward=True)
        return np.vstack([start, end, i - b])

    def finish(self) -> np.ndarray:
        """End of the stream: start, length and smallest period of all runs, by start and period."""
        runs = np.concatenate([self.found, self.open], axis=1)
        length = runs[1] - runs[0]
        runs = runs[:, length >= np.maximum(self.min_length, self.min_exponent * runs[2])]
        runs = runs[:, np.lexsort((runs[2], runs[1], runs[0]))]
        if runs.shape[1]:  # of one stretch's periods the others are multiples of the smallest
            new = np.ones(runs.shape[1], bool)
            new[1:] = (np.diff(runs[0]) != 0) | (np.diff(runs[1]) != 0)
            runs = runs[:, new]
        for s, e, p in runs.T.tolist():
            x = self.words[: self.n]
            maximal = (s == 0 or x[s - 1] != x[s - 1 + p]) and (e == self.n or x[e] != x[e - p])
            if not (maximal and np.array_equal(x[s : e - p], x[s + p : e])):
                raise ArithmeticError("a sum of words has lied")
        runs = runs[:, np.lexsort((runs[2], runs[0]))]
        return np.vstack([runs[0], runs[1] - runs[0], runs[2]])


def runs_of(documents: list[np.ndarray], min_exponent: int = 3, min_length: int = 24) -> tuple[np.ndarray, np.ndarray]:
    """Runs of several documents, given as word numbers >= 0: their document, and start, length and period."""
    lengths = np.array([len(d) for d in documents], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])
    stream = np.empty(starts[-1], np.int64)
    for k, (at, words) in enumerate(zip(starts.tolist(), documents)):
        stream[at : at + len(words)] = words
        stream[at + len(words)] = -1 - k  # equal to no other word
    seed = 1
    while True:
        catchers = Catchers(min_exponent, min_length, int(lengths.max(initial=0)), seed)
        try:
            for at in range(0, len(stream), APPENDED):
                catchers.append(stream[at : at + APPENDED])
            found = catchers.finish()
            break
        except ArithmeticError:
            seed += 1
    owner = np.searchsorted(starts, found[0], side="right") - 1
    found[0] -= starts[owner]
    return owner, found


def _streams(texts: pa.Array) -> Iterator[tuple[list[int], list[list[bytes]]]]:
    """Rows and their words, rows of similar length together, up to STREAM_WORDS words unless one text is longer."""
    size = np.diff(np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1 + texts.offset)[texts.offset :])
    rows: list[int] = []
    words: list[list[bytes]] = []
    held = 0
    for row in np.argsort(size, kind="stable").tolist():
        own = texts[row].as_py().split()  # bytes are split at the space and 9 to 13
        if rows and held + len(own) > STREAM_WORDS:
            yield rows, words
            rows, words, held = [], [], 0
        rows.append(row)
        words.append(own)
        held += len(own)
    if rows:
        yield rows, words


def _lists(values: np.ndarray, counts: np.ndarray, names: list[str]) -> pa.Array:
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(v) for v in values], names))


def _rows(words: list[list[bytes]], min_exponent: int, min_length: int) -> list[pa.Array]:
    """The result columns of one stream."""
    flat = pa.array([w for own in words for w in own], pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    ends = np.cumsum([len(own) for own in words])
    owner, found = runs_of([flat[e - len(own) : e] for e, own in zip(ends.tolist(), words)], min_exponent, min_length)
    counts = np.bincount(owner, minlength=len(words))
    left = [b" ".join(own) if not c else b"" for own, c in zip(words, counts.tolist())]
    strongest: list[dict | None] = [None] * len(words)
    last = np.cumsum(counts)
    for d in np.flatnonzero(counts).tolist():
        own = found[:, last[d] - counts[d] : last[d]].T.tolist()
        start, length, period = min(own, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
        strongest[d] = {"start": start, "length": length, "period": period}
        dropped = np.zeros(len(words[d]), bool)
        for start, length, period in own:
            dropped[start + period : start + length] = True
        left[d] = b" ".join([words[d][k] for k in np.flatnonzero(~dropped).tolist()])
    names = ["start", "length", "period"]
    kind = pa.struct([(n, pa.int64()) for n in names])
    return [pa.array([len(own) for own in words], pa.int64()), _lists(found, counts, names), pa.array(strongest, kind), pa.array(left, pa.binary()).cast(pa.string())]


def find_runs(df: DataFrame, text: str = "text", id_column: str = "doc_id", min_exponent: int = 3, min_length: int = 24) -> DataFrame:
    """Periodic runs of the words of every text, and the text without their repetitions.

    Returns per row the id, n_words, runs (array of start, length, period in words, by start, then period),
    strongest (the run with the greatest length / period; of equal ones the first, then the shortest
    period; null without runs) and collapsed (the words left, joined by one space, when every run loses
    what follows its first period). Words are runs of anything but the space and characters 9 to 13.
    A run is a stretch that repeats its smallest period min_exponent times or more, has min_length words
    or more and cannot be extended. Null, empty and blank texts have no words and collapse to the empty
    text. Rows are independent: null and repeated ids are kept as they are; other columns are not read.
    """
    data = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary")
    rows = df.select(F.col(f"`{id_column}`").alias("id"), data.alias("data"))
    kind = next(f.dataType for f in rows.schema if f.name == "id").simpleString()
    run = "struct<start:bigint,length:bigint,period:bigint>"
    schema = f"id {kind}, n_words bigint, runs array<{run}>, strongest {run}, collapsed string"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for places, words in _streams(texts):
                columns = _rows(words, min_exponent, min_length)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(places)), *columns], ["id", "n_words", "runs", "strongest", "collapsed"])

    return rows.mapInArrow(work, schema).withColumnRenamed("id", id_column)
