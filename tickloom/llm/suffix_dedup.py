"""Remove byte strings that an earlier document holds, by suffix sorting.

Per shard of anchors (see ``passages``) the distinct segments are laid out as one text and
its places are sorted up to the window length by bucket-pointer refinement: buckets of
q-grams first, then every bucket of several places is sorted on the bucket pointers of the
places a bucket's depth further on, so each refinement reuses all before it.
Places left in one bucket start equal windows; the smallest document of each bucket
decides.
"""

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrays import BYTE_VALUES, binaries, dense, flat, ranges
from .passages import (NO_ID, Search, Shard, Symbols, covered, flagged, ids_of, row_slices,
                       search_windows)

WINDOW, ANCHOR, QGRAM = 50, 16, 8
SCHEMA = ("doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, "
          "kept binary")


def qgram_keys(raw: np.ndarray, q: int) -> np.ndarray:
    """The next q bytes (8 at most) of each place as a number; past the end zeros."""
    padded = np.r_[raw, np.zeros(q, np.uint8)].astype(np.uint64)
    keys = np.zeros(len(raw), np.uint64)
    for i in range(q):
        keys = (keys << np.uint64(8)) | padded[i:i + len(raw)]
    return keys


def bucket_pointers(keys: np.ndarray, depth: int, to: int) -> np.ndarray:
    """Rank of each place's first ``to`` symbols, equal for equal ones.

    keys order the first ``depth`` symbols. A rank is the bucket's first place in the
    order of suffixes; places past the end count as smallest."""
    n = len(keys)
    order, first = dense(keys)
    size = np.diff(np.r_[first, n])
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(first, size)
    active = order[np.repeat(size > 1, size)]
    while depth < to and len(active):
        step = min(depth, to - depth)
        ahead = active + step
        pointer = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        own = rank[active]
        inner, start = dense(own * (n + 1) + pointer)
        active, own = active[inner], own[inner]
        size = np.diff(np.r_[start, len(active)])
        bucket = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        base = np.repeat(bucket, np.diff(np.r_[bucket, len(own)]))
        rank[active] = own + np.repeat(start, size) - base
        active = active[np.repeat(size > 1, size)]
        depth += step
    return rank


def _read(column):
    return row_slices(column, lambda data, offsets: Symbols(BYTE_VALUES[data], data, offsets))


def _smallest(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.minimum.reduceat(ids, first) if len(first) else np.zeros(0, np.int64)


def _earlier(shard: Shard, window: int) -> np.ndarray:
    """For each window of each entry: does a smaller document than the entry's hold it?"""
    n = len(shard.start)
    count = shard.size - (window - 1)
    own = np.full(n, NO_ID)
    np.minimum.at(own, shard.entry, shard.weight)
    best = np.repeat(own, count)
    many = np.flatnonzero(~shard.lone)
    if len(many):
        size = shard.size[many]
        text = shard.raw[ranges(shard.start[many], size)]
        rank = bucket_pointers(qgram_keys(text, QGRAM), QGRAM, window)
        begin = np.cumsum(size) - size
        rank = rank[ranges(begin, count[many])]
        holder = np.repeat(own[many], count[many])
        order, first = dense(rank)
        least = np.minimum.reduceat(holder[order], first)
        holder[order] = np.repeat(least, np.diff(np.r_[first, len(order)]))
        best[ranges((np.cumsum(count) - count)[many], count[many])] = holder
    begin = np.cumsum(count) - count
    windows = count[shard.entry]
    return best[ranges(begin[shard.entry], windows)] < np.repeat(shard.weight, windows)


def _later(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Instances in documents after the part's first document with the segment."""
    return ids > np.repeat(_smallest(ids, first), np.diff(np.r_[first, len(ids)]))


def whole_characters(data: np.ndarray, removed: np.ndarray) -> None:
    """Mark all bytes of the UTF-8 characters that have a marked byte, in place. A character has
    at most three bytes after its first, so marks move three places at most either way."""
    inner = (data & 0xC0) == 0x80
    for _ in range(3):
        removed[:-1] |= removed[1:] & inner[1:]
    for _ in range(3):
        removed[1:] |= removed[:-1] & inner[1:]


def counted_in(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many places of each text are marked, without a number for every place."""
    return np.array([np.count_nonzero(marks[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], np.int64)


def _finish(search: Search, characters: bool):
    def run(docs: pa.Table, replies: pa.Table, shards: int) -> pa.Table:
        data, offsets = flat(docs.column("text"))
        removed = np.zeros(len(data), bool)
        if len(data):
            raw, flags = flagged(docs, replies, search, shards, _later)
            removed = covered(flags, search.window)
            if characters:
                whole_characters(data, removed)
        n_bytes = np.diff(offsets)
        kept_at = np.r_[0, np.cumsum(n_bytes - counted_in(removed, offsets))]
        begin = removed.copy()
        begin[1:] &= ~removed[:-1]
        firsts = offsets[:-1][n_bytes > 0]
        begin[firsts] = removed[firsts]
        stop = removed.copy()
        stop[:-1] &= ~removed[1:]
        lasts = offsets[1:][n_bytes > 0] - 1
        stop[lasts] = removed[lasts]
        start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        at = np.searchsorted(start, offsets)
        base = np.repeat(offsets[:-1], np.diff(at))
        spans = pa.StructArray.from_arrays([pa.array(start - base), pa.array(end - base)], ["start", "end"])
        return pa.table({
            "doc_id": docs.column("id"), "n_bytes": n_bytes, "n_removed": n_bytes - np.diff(kept_at),
            "spans": pa.ListArray.from_arrays(pa.array(at, pa.int32()), spans),
            "kept": binaries(data[~removed], kept_at)})
    return run


def dedup_substrings(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW,
                     anchor: int = ANCHOR, hot: int | None = None, characters: bool = False,
                     carry: Sequence[str] = ()) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, spans (removed runs) and kept (the other bytes).

    A byte goes if a string of ``window`` bytes around it also starts in a document with a
    smaller id; strings are judged on the input. Null and empty texts keep their row with
    no bytes. Rows with one id don't remove one another. A null id counts as largest and is
    returned as null. With ``characters`` a character goes whole if any of its bytes does.
    Other columns are not read, but those in ``carry`` are added."""
    if not QGRAM <= anchor < window:
        raise ValueError("the anchor must have 8 bytes at least and be shorter than the window")
    search = Search(window, anchor, _read, np.uint8, _smallest, _earlier)
    extra = {} if hot is None else {"hot": hot}
    return search_windows(docs, key, text, search, _finish(search, characters), SCHEMA, carry=carry, **extra)
