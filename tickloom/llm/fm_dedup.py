"""Remove words in windows that occur again anywhere, by an FM-index per shard.

Per shard of anchors (see ``passages``) the distinct segments, sorted by word number, make a
text whose Burrows-Wheeler transform is kept in a wavelet matrix of packed bits with
counted blocks. The segments are then streamed against it: from each possible window end
words are matched backwards while the interval holds two places; the length reached is
the matching statistic of that end, and ends that reach the window's length are reported.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrays import SPACED, binaries, dense, flat, ranges, slices, words
from .passages import Search, Shard, Symbols, covered, flagged, row_slices, search_windows
from .suffix_dedup import bucket_pointers

WINDOW, ANCHOR = 35, 8
SCHEMA = "doc_id long, n_words long, n_removed long, intervals array<struct<start:long,end:long>>, kept binary"


class WaveletMatrix:
    """Numbers below 2**levels; counts how often one stands before a place."""

    def __init__(self, values: np.ndarray, levels: int):
        self.levels, self.rows = levels, []
        values = values.astype(np.int64)
        for level in reversed(range(levels)):
            bit = ((values >> level) & 1).astype(bool)
            packed = np.packbits(np.r_[bit, np.zeros(-len(bit) % 64 + 64, bool)], bitorder="little").view(np.uint64)
            block = np.r_[0, np.cumsum(np.bitwise_count(packed))].astype(np.int64)
            self.rows.append((packed, block, len(bit) - int(bit.sum())))
            values = np.r_[values[~bit], values[bit]]

    def _ones(self, row, place: np.ndarray) -> np.ndarray:
        packed, block, _ = row
        word, rest = place >> 6, (place & 63).astype(np.uint64)
        below = packed[word] & ((np.uint64(1) << rest) - np.uint64(1))
        return block[word] + np.bitwise_count(below)

    def count(self, value: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the interval [low, high) of the text lies among the places of ``value``."""
        begin = np.zeros_like(low)
        for level, row in zip(reversed(range(self.levels)), self.rows, strict=True):
            bit = ((value >> level) & 1).astype(bool)
            ones = [self._ones(row, x) for x in (begin, low, high)]
            begin, low, high = (np.where(bit, row[2] + o, x - o) for x, o in zip((begin, low, high), ones, strict=True))
        return low - begin, high - begin


class FMIndex:
    """Of a text of numbers from 1, sorted to ``depth`` numbers; patterns no longer than that."""

    def __init__(self, text: np.ndarray, depth: int):
        text = np.r_[text, 0]
        order = np.argsort(bucket_pointers(text, 1, depth), kind="stable")
        self.first = np.r_[0, np.cumsum(np.bincount(text))]
        self.levels = max(1, int(text.max()).bit_length())
        self.bwt = WaveletMatrix(text[order - 1], self.levels)
        self.size = len(text)

    def backward(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray):
        """Intervals of the patterns with ``symbol`` put in front."""
        a, b = self.bwt.count(symbol, low, high)
        return self.first[symbol] + a, self.first[symbol] + b


def matching_statistics(index: FMIndex, text: np.ndarray, ends: np.ndarray, most: int, least: int = 2) -> np.ndarray:
    """Longest stretch before each end, ``most`` at most, that stands ``least`` times in the index."""
    reached = np.zeros(len(ends), np.int64)
    lane = np.arange(len(ends))
    low, high = np.zeros(len(ends), np.int64), np.full(len(ends), index.size)
    for step in range(most):
        low, high = index.backward(text[ends[lane] - 1 - step], low, high)
        going = high - low >= least
        lane, low, high = lane[going], low[going], high[going]
        if not len(lane):
            break
        reached[lane] += 1
    return reached


#: Ends that are streamed at a time.
LANES = 1 << 18


def _read(column):
    def read(data, offsets):
        w = words(data, offsets, SPACED)
        hashes = w.hashes()
        return Symbols(hashes, hashes, w.offsets)
    return row_slices(column, read)


def _count(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.diff(np.r_[first, len(ids)])


def _repeated(shard: Shard, window: int) -> np.ndarray:
    """For each window of each entry: does it stand anywhere else?"""
    count = shard.size - (window - 1)
    copies = np.zeros(len(shard.start), np.int64)
    np.add.at(copies, shard.entry, shard.weight)
    again = np.repeat(copies > 1, count)
    begin = np.cumsum(count) - count
    many = np.flatnonzero(~shard.lone)
    if len(many):
        size = shard.size[many]
        raw = shard.raw[ranges(shard.start[many], size)]
        order, first = dense(raw)
        text = np.empty(len(raw), np.int64)
        text[order] = np.repeat(np.arange(1, len(first) + 1), np.diff(np.r_[first, len(raw)]))
        # each segment is followed by an end mark, 0, and so are windows that would cross
        starts = np.cumsum(size + 1) - (size + 1)
        marked = np.zeros(len(raw) + len(many), np.int64)
        marked[ranges(starts, size)] = text
        index = FMIndex(marked, window)
        single = copies[many] == 1
        ends = ranges(starts[single] + window, count[many][single])
        found = np.concatenate([matching_statistics(index, marked, ends[a:a + LANES], window) >= window
                                for a in range(0, len(ends), LANES)] or [np.zeros(0, bool)])
        again[ranges(begin[many][single], count[many][single])] = found
    return again[ranges(begin[shard.entry], count[shard.entry])]


def _finish(search: Search):
    def run(docs: pa.Table, replies: pa.Table, shards: int) -> pa.Table:
        data, offsets = flat(docs.column("text"))
        removed = np.zeros(0, bool)
        if len(data):
            raw, flags = flagged(docs, replies, search, shards)
            removed = covered(flags, search.window)
        n_words, kept_words, lengths, pieces, spans = [], [], [], [], []
        done = 0
        for a, b in slices(offsets):
            w = words(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], SPACED)
            gone = removed[done:done + len(w.start)]
            done += len(gone)
            keep = ~gone
            kept_at = np.r_[0, np.cumsum(keep)][w.offsets]
            start, end, kept = w.start[keep], w.end[keep], np.diff(kept_at)
            last = kept_at[1:][kept > 0] - 1
            stop = end + 1
            stop[last] -= 1
            edge = np.zeros(len(w.data) + 2, np.int8)
            edge[start] += 1
            np.subtract.at(edge, stop, 1)
            inside = np.cumsum(edge, dtype=np.int8)[:len(w.data)] > 0
            text = w.data.copy()
            text[np.minimum(end, len(text) - 1)[stop > end]] = 0x20
            pieces.append(text[inside])
            bytes_at = np.r_[0, np.cumsum(stop - start)]
            lengths.append(np.diff(bytes_at[kept_at]))
            n_words.append(np.diff(w.offsets))
            kept_words.append(kept)
            run_first = gone.copy()
            run_last = gone.copy()
            if len(gone):
                inner = np.ones(len(gone) + 1, bool)
                inner[w.offsets] = False
                run_first[1:] &= ~(gone[:-1] & inner[1:-1])
                run_last[:-1] &= ~(gone[1:] & inner[1:-1])
            first, stops = np.flatnonzero(run_first), np.flatnonzero(run_last) + 1
            at = np.searchsorted(first, w.offsets)
            base = np.repeat(w.offsets[:-1], np.diff(at))
            spans.append((np.diff(at), first - base, stops - base))
        join = lambda xs: np.concatenate(xs) if xs else np.zeros(0, np.int64)
        n = join(n_words)
        items = pa.StructArray.from_arrays([pa.array(join([s[1] for s in spans]), pa.int64()),
                                            pa.array(join([s[2] for s in spans]), pa.int64())], ["start", "end"])
        list_at = np.r_[0, np.cumsum(join([s[0] for s in spans]))]
        kept_bytes = join(pieces).astype(np.uint8)
        return pa.table({
            "doc_id": docs.column("id"), "n_words": pa.array(n, pa.int64()),
            "n_removed": pa.array(n - join(kept_words), pa.int64()),
            "intervals": pa.ListArray.from_arrays(pa.array(list_at, pa.int32()), items),
            "kept": binaries(kept_bytes, np.r_[0, np.cumsum(join(lengths))])})
    return run


def dedup_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW,
                   anchor: int = ANCHOR, hot: int | None = None) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, intervals (removed runs of words) and kept (the
    other words joined by one space, UTF-8).

    A word goes if a window of ``window`` words around it also starts anywhere else, the
    same document included; windows are judged on the input and don't cross documents.
    Words are what stands between blanks (0x20, 0x09-0x0D), told apart by 64-bit hashes.
    Null and empty texts keep their row without words; repeated rows count as elsewhere;
    ids may be null or repeated. Other columns are not read."""
    if not 1 <= anchor < window:
        raise ValueError("the anchor must be shorter than the window")
    search = Search(window, anchor, _read, np.uint64, _count, _repeated)
    extra = {} if hot is None else {"hot": hot}
    return search_windows(docs, key, text, search, _finish(search), SCHEMA, **extra)
