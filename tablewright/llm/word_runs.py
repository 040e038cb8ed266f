"""Periodic stretches of words: recursive splitting at words too rare to repeat, then a scan of lags.

A run of period q and exponent 4 or more holds each of its words at least four times. A word that occurs less often in a
segment therefore lies in no run of it and splits the segment; in the smaller segments other words become too rare, and
so on until nothing changes. Few words of ordinary text survive that. All texts of a batch are split together.

The surviving segments are scanned for lags at which words recur. Lags come in classes, from b = 2**k up to 2b. A run
with such a period holds, from one multiple of b to the next, at least two whole blocks of b words that recur one lag
later, so only lags at which a block recurs are looked at, and neighbouring blocks with the same lag are joined and
extended word by word. Blocks are told apart by exact names, made from the names of their halves. So a text of n words
takes about n log n steps at any n, and one task holds about 100 bytes for each word of its longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tablewright.llm.batches import importable, pieces

#: A run has at least this many words, and its period at least this many times.
LEAST_LENGTH, LEAST_EXPONENT = 6, 4


def _names(*columns: np.ndarray) -> np.ndarray:
    """Numbers from 0 that are equal where all columns are equal. Columns hold small numbers that are not negative."""
    key = columns[0]
    for column in columns[1:]:
        key = key * (int(column.max(initial=0)) + 1) + column
    return np.unique(key, return_inverse=True)[1]


def split_segments(words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words that survive, and the number of each one's segment. ``text`` numbers the texts in order."""
    at, segment, settled = np.arange(len(words)), text, [np.empty(0, np.int64)]
    while len(at):
        pair = _names(segment, words[at])
        often = np.bincount(pair)[pair] >= LEAST_EXPONENT
        changed = np.zeros(int(segment[-1]) + 1, bool)
        changed[segment[~often]] = True
        changed = changed[segment]
        settled.append(at[~changed])
        at, segment = at[often & changed], segment[often & changed]
        if len(at):
            segment = np.cumsum(np.r_[0, (np.diff(at) != 1) | (np.diff(segment) != 0)])
            long = np.bincount(segment)[segment] >= LEAST_LENGTH
            at, segment = at[long], _names(segment[long])
    at = np.sort(np.concatenate(settled))
    return at, np.cumsum(np.r_[0, (np.diff(at) != 1) | (np.diff(text[at]) != 0)])[: len(at)]


def _candidates(name: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, lag): multiples of ``block`` whose block recurs ``lag`` words later, for lags from block to 2 * block."""
    size = len(name)
    anchors = np.arange(0, size, block)
    anchors = anchors[name[anchors] >= 0]
    held = np.flatnonzero(name >= 0)
    keys = np.sort(name[held] * size + held)
    low = np.searchsorted(keys, name[anchors] * size + np.minimum(anchors + block, size - 1))
    high = np.searchsorted(keys, name[anchors] * size + np.minimum(anchors + 2 * block, size))
    # The last place of all may be met by the clipped lower end itself.
    many = high - low
    first = np.repeat(np.cumsum(many) - many, many)
    found = keys[np.repeat(low, many) + np.arange(int(many.sum())) - first] % size
    anchor = np.repeat(anchors, many)
    lag = found - anchor
    ok = (lag >= block) & (lag < 2 * block)
    return anchor[ok], lag[ok]


class _Cover:
    """Known runs, to ask whether one of them holds a stretch."""

    def __init__(self, start: np.ndarray, end: np.ndarray):
        order = np.argsort(start, kind="stable")
        self.start, self.reach = start[order], np.maximum.accumulate(end[order]) if len(end) else end

    def holds(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if not len(self.start):
            return np.zeros(len(start), bool)
        last = np.searchsorted(self.start, start, "right") - 1
        return (last >= 0) & (self.reach[np.maximum(last, 0)] >= end)


def scan_lags(words: np.ndarray, segment: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs in ``words``; ``segment`` numbers the segments, one after the other."""
    runs: list[tuple[int, int, int]] = []
    place = np.arange(len(words))
    word = _names(segment, words) if len(words) else words
    name, block = word.copy(), 1
    while len(place):
        sizes = np.bincount(segment)
        long = (sizes >= max(LEAST_LENGTH, LEAST_EXPONENT * block))[segment]
        place, word, name, segment = place[long], word[long], name[long], _names(segment[long])
        if not len(place):
            break
        ends = np.cumsum(np.bincount(segment))
        end, begin = ends[segment], np.r_[0, ends[:-1]][segment]
        # Shorter periods are all known: a longer one cannot share so many words with one of their runs.
        back = np.full(len(words) + 1, -1)
        back[place] = np.arange(len(place))
        inside = [(int(back[s]), int(back[s + n - 1]) + 1) for s, n, _ in runs if back[s] >= 0]
        cover = _Cover(np.array([s for s, _ in inside], np.int64), np.array([e for _, e in inside], np.int64))
        anchor, lag = _candidates(name, block)
        fresh = ~cover.holds(anchor, anchor + lag + block)
        anchor, lag = anchor[fresh], lag[fresh]
        order = np.lexsort((anchor, lag))
        anchor, lag = anchor[order], lag[order]
        heads = np.flatnonzero(np.r_[True, (np.diff(lag) != 0) | (np.diff(anchor) != block)]) if len(anchor) else np.empty(0, np.int64)
        tails = np.r_[heads[1:], len(anchor)] - 1 if len(heads) else heads
        start, stop, lag = anchor[heads], anchor[tails] + block, lag[heads]
        # A run needs LEAST_EXPONENT - 1 lags of recurring words, of which less than a block at each end is not seen yet.
        wanted = np.maximum(LEAST_LENGTH, LEAST_EXPONENT * lag) - lag
        seen = stop - start > wanted - 2 * block
        for s, e, q, least in zip(start[seen].tolist(), stop[seen].tolist(), lag[seen].tolist(), wanted[seen].tolist()):
            reach = min(block, s - int(begin[s]))
            differ = np.flatnonzero(word[s - reach : s] != word[s - reach + q : s + q])
            s = s - reach + (int(differ[-1]) + 1 if len(differ) else 0)
            reach = min(block, int(end[s]) - q - e)
            differ = np.flatnonzero(word[e : e + reach] != word[e + q : e + q + reach])
            e += int(differ[0]) if len(differ) else reach
            if e - s >= least and not cover.holds(np.array([s]), np.array([e + q]))[0]:
                runs.append((int(place[s]), e + q - s, q))
        # Blocks of twice the size, named by their halves.
        whole = np.flatnonzero(np.arange(len(name)) + 2 * block <= end)
        longer = np.full(len(name), -1)
        if len(whole):
            longer[whole] = _names(name[whole], name[whole + block])
        name, block = longer, 2 * block
    return runs


def _runs_of(words: np.ndarray, text: np.ndarray) -> list[tuple[int, int, int]]:
    at, segment = split_segments(words, text)
    return [(int(at[s]), n, q) for s, n, q in scan_lags(words[at], segment)] if len(at) else []


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    for batch in pieces(batches, "text", 4 << 20):
        split = pc.ascii_split_whitespace(batch.column("text").fill_null(""))
        values, counts = split.flatten(), pc.list_value_length(split).to_numpy(zero_copy_only=False)
        text = np.repeat(np.arange(len(counts)), counts)
        real = pc.binary_length(values).to_numpy(zero_copy_only=False) > 0
        if not real.all():
            values, text = values.filter(pa.array(real)), text[real]
        first = np.searchsorted(text, np.arange(len(counts) + 1))
        codes = values.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        dropped = np.zeros(len(codes), bool)
        listed: list[list[dict]] = [[] for _ in counts]
        for start, length, period in sorted(_runs_of(codes, text), key=lambda r: (r[0], r[2])) if len(codes) else ():
            row = int(text[start])
            listed[row].append({"start": start - int(first[row]), "length": length, "period": period})
            dropped[start + period : start + length] = True
        kept = np.bincount(text[~dropped], minlength=len(counts))
        offsets = pa.array(np.r_[0, np.cumsum(kept)].astype(np.int32))
        remaining = values.filter(pa.array(~dropped)) if dropped.any() else values
        collapsed = pc.binary_join(pa.ListArray.from_arrays(offsets, remaining), " ")
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.diff(first).astype(np.int64)), pa.array(listed, pa.list_(run)), collapsed],
            ["doc_id", "n_words", "runs", "collapsed"],
        )


def word_runs(documents: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): the periodic stretches of each text, and the text with each of them once.

    Words are what stands between spaces, tabs and line ends (U+0020, U+0009 to U+000D), numbered from 0. A run
    (start, length, period) is a stretch with this smallest period, of at least ``LEAST_EXPONENT`` periods and
    ``LEAST_LENGTH`` words, that no neighbouring word continues; ``runs`` are ordered by start, then period.
    ``collapsed`` are the words, joined by spaces, without those that lie in a run behind its first period. Null and empty
    texts have no words and no runs and collapse to an empty text. Each row is told by itself: repeated rows and null
    ids stay as they are, and other columns are ignored.
    """
    importable(documents.sparkSession)
    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", "text").mapInArrow(
        _scan, f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    )
