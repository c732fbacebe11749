"""Find every window of L symbols that occurs again, without moving whole texts to one place.

A window of L symbols is matched through its anchor: of the k-grams inside it, the
leftmost with the smallest hash. Equal windows have equal anchors at equal places, and
neighbouring windows mostly share theirs, so about 2 / (L - k + 2) of all places are
anchors. Windows in a row with one anchor form a segment.

Texts are dealt by id and text into parts, so rows without an id, or of an id that very many
share, are spread like all others. Every part asks, for each distinct anchor it holds,
whether it occurs again (first round); then it sends its distinct segments with such
anchors to the shard of the anchor, once however often it holds them, and gets a bit for
each window (second round). Requests and replies are packed arrays, one row for each
part and shard. A copy held by a third of all documents therefore costs one entry for
each part. An anchor with very many occurrences (a common line with ever new
surroundings) is split: its segments are dealt by longer stretches around the anchor,
which each of its windows holds to the left or to the right.

Every step is a function of the rows of its part or shard, whatever their order, so a lost
executor's work is repeated with the same result. Hashes find candidates; what decides
is the ``resolve`` of the operator on the segments' symbols.
"""

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import (BYTE_VALUES, U64, dense, flat, gram_hashes, mix, pack, prefix_hashes, ranges,
                     slices, stretch_hashes, unpack)

#: Symbols of a shard that are resolved at a time (more only for one anchor's), and windows
#: of a part whose flags are spread at a time.
PIECE, BLOCK = 1 << 20, 1 << 21
#: Occurrences from which an anchor's segments are dealt by longer stretches.
HOT = 20_000
NO_ID = np.iinfo(np.int64).max


@dataclass
class Symbols:
    """Symbols of a slice of texts: ``values`` for hashing, ``raw`` for shipping."""
    values: np.ndarray
    raw: np.ndarray
    offsets: np.ndarray


@dataclass
class Segment:
    """Segments of a part: windows start in [first, last) of the part's symbols."""
    route: np.ndarray
    content: np.ndarray
    first: np.ndarray
    last: np.ndarray
    doc: np.ndarray


@dataclass(frozen=True)
class Search:
    """read: texts of an Arrow column, slice by slice. weigh: of equal segments of a part
    (ids in order, first places), what the shard is told. resolve: see ``Shard``."""
    window: int
    anchor: int
    read: Callable[[object], Iterator[Symbols]]
    raw: type
    weigh: Callable[[np.ndarray, np.ndarray], np.ndarray]
    resolve: Callable[["Shard", int], list[np.ndarray]]


@dataclass
class Shard:
    """Distinct segments (``raw`` at ``start``, ``size`` symbols, total ``weights`` by entry)
    and the entries of all parts that name them."""
    raw: np.ndarray
    start: np.ndarray
    size: np.ndarray
    lone: np.ndarray
    entry: np.ndarray
    weight: np.ndarray


def segments(s: Symbols, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Anchor place and windows [first, last) of each segment, its text, and the hashes."""
    n = len(s.values)
    prefix = prefix_hashes(s.values)
    grams = gram_hashes(prefix, anchor)
    if n < window:
        none = np.zeros(0, np.int64)
        return none, none, none, none, prefix, grams
    bits = U64(max(28, n.bit_length()))
    low = (grams >> bits << bits) | np.arange(len(grams), dtype=U64)
    width, size = window - anchor + 1, 1
    while size * 2 <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < width:
        low = np.minimum(low[:size - width], low[width - size:])
    place = (low & ((U64(1) << bits) - U64(1))).astype(np.int64)
    cut = np.zeros(n + 1, bool)
    cut[1:len(place)] = place[1:] != place[:-1]
    cut[s.offsets] = True
    cut[np.maximum(s.offsets[1:] - window + 1, s.offsets[:-1])] = True
    first = np.flatnonzero(cut)
    first, last = first[:-1], first[1:]
    text = np.searchsorted(s.offsets, first, "right") - 1
    good = first + window <= s.offsets[text + 1]
    first, last, text = first[good], last[good], text[good]
    return place[first], first, last, text, prefix, grams


def part_segments(column, search: Search, status=None):
    """All anchors of a part; with ``status`` the segments of anchors that occur again."""
    found, raws, symbols, texts = [], [], 0, 0
    for s in search.read(column):
        place, first, last, text, prefix, grams = segments(s, search.window, search.anchor)
        route = mix(grams[place] + U64(1))  # anchors have small hashes; routes are even
        if status is None:
            found.append((route,))
            continue
        keys, states = status
        state = states[np.searchsorted(keys, route)]
        some = state > 0
        place, first, last, text, route, state = (x[some] for x in (place, first, last, text, route, state))
        half = (search.window - search.anchor) // 2
        hot = state > 1
        if hot.any():
            p, a, b = place[hot], first[hot], last[hot]
            middle = np.clip(p - half + 1, a, b)
            left, right = a < middle, middle < b
            wide = [stretch_hashes(prefix, q[k], q[k] + search.anchor + half) + U64(i)
                    for i, (q, k) in enumerate(((p - half, left), (p, right)))]
            first = np.r_[first[~hot], a[left], middle[right]]
            last = np.r_[last[~hot], middle[left], b[right]]
            route = np.r_[route[~hot], mix(wide[0]), mix(wide[1])]
            text = np.r_[text[~hot], text[hot][left], text[hot][right]]
        content = stretch_hashes(prefix, first, last + search.window - 1)
        found.append((route, content, first + symbols, last + symbols, text + texts))
        raws.append(s.raw)
        symbols, texts = symbols + len(s.values), texts + len(s.offsets) - 1
    if status is None:
        return np.concatenate([x[0] for x in found]) if found else np.zeros(0, U64)
    kinds = (U64, U64, np.int64, np.int64, np.int64)
    joined = [np.concatenate([x[i] for x in found]) if found else np.zeros(0, k) for i, k in enumerate(kinds)]
    return Segment(*joined), np.concatenate(raws) if raws else np.zeros(0, search.raw)


def shard_of(route: np.ndarray, shards: int) -> np.ndarray:
    """Rises with the route, so sorted routes are sorted by shard."""
    return ((route >> U64(32)) * U64(shards) >> U64(32)).astype(np.int64)


def counted(anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order, first = dense(anchors)
    return anchors[order][first], np.diff(np.r_[first, len(order)])


def distinct(found: Segment) -> tuple[np.ndarray, np.ndarray]:
    """Order that puts equal segments together, by route, and their first places."""
    order = np.lexsort((found.content, found.route))
    route, content = found.route[order], found.content[order]
    new = np.r_[True, (route[1:] != route[:-1]) | (content[1:] != content[:-1])] if len(order) else np.zeros(0, bool)
    return order, np.flatnonzero(new)


def ids_of(table) -> np.ndarray:
    return table.column("id").fill_null(NO_ID).to_numpy()


REQUEST = "shard int, part int, n long, routes binary, counts binary, raw binary"
REPLY = "part int, shard int, round int, bits binary"


def _rows(schema: str, columns: list) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)],
                    names=[f for f, _ in fields])


def _cut(shard: np.ndarray) -> Iterator[tuple[int, slice]]:
    if not len(shard):
        return
    first = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
    for a, b in zip(first, [*first[1:], len(shard)], strict=True):
        yield int(shard[a]), slice(a, b)


def _ask_anchors(search: Search, shards: int):
    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        keys, counts = counted(part_segments(table.column("text"), search))
        out = [(s, part, c.stop - c.start, pack(keys[c]), pack(counts[c]), b"")
               for s, c in _cut(shard_of(keys, shards))]
        return _rows(REQUEST, [*zip(*out, strict=True)] if out else [[]] * 6)
    return run


def _answer_anchors(hot: int):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        keys = [unpack(r["routes"], r["n"], U64) for r in rows]
        counts = np.concatenate([unpack(r["counts"], r["n"], np.int64) for r in rows])
        order, first = dense(np.concatenate(keys))
        total = np.add.reduceat(counts[order], first)
        state = np.empty(len(order), np.uint8)
        state[order] = np.repeat((total > 1).astype(np.uint8) + (total > hot), np.diff(np.r_[first, len(order)]))
        ends = np.cumsum([0, *map(len, keys)])
        return _rows(REPLY, [[r["part"] for r in rows], [r["shard"] for r in rows], [1] * len(rows),
                             [pack(state[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]])
    return run


def _known(docs: pa.Table, replies: pa.Table, search: Search, shards: int):
    """The part's segments, its symbols and the distinct ones, by the first round's replies."""
    keys, _ = counted(part_segments(docs.column("text"), search))
    cuts = dict(_cut(shard_of(keys, shards)))
    state = np.zeros(len(keys), np.uint8)
    for r in replies.to_pylist():
        if r["round"] == 1:
            c = cuts[r["shard"]]
            state[c] = unpack(r["bits"], c.stop - c.start, np.uint8)
    found, raw = part_segments(docs.column("text"), search, (keys, state))
    return found, raw, *distinct(found)


def _ask_segments(search: Search, shards: int):
    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _rows(REQUEST, [[]] * 6)
        part, ids = docs.column("part")[0].as_py(), ids_of(docs)
        found, raw, order, first = _known(docs, replies, search, shards)
        weight = search.weigh(ids[found.doc[order]], first)
        one = order[first]
        route, start = found.route[one], found.first[one]
        size = found.last[one] + search.window - 1 - start
        out = []
        for s, c in _cut(shard_of(route, shards)):
            body = raw[ranges(start[c], size[c])]
            out.append((s, part, c.stop - c.start, pack(route[c]),
                        pack(np.stack([size[c], weight[c]])), pack(body)))
        return _rows(REQUEST, [*zip(*out, strict=True)] if out else [[]] * 6)
    return run


def _answer_segments(search: Search):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        sizes, routes, weights, raws = [], [], [], []
        for r in rows:
            size, weight = unpack(r["counts"], 2 * r["n"], np.int64).reshape(2, -1)
            sizes.append(size)
            weights.append(weight)
            routes.append(unpack(r["routes"], r["n"], U64))
            raws.append(unpack(r["raw"], int(size.sum()), search.raw))
        size, weight, route, raw = map(np.concatenate, (sizes, weights, routes, raws))
        start = np.cumsum(size) - size
        content = np.concatenate([_contents(x, n) for x, n in zip(raws, sizes, strict=True)])
        order, first = distinct(Segment(route, content, start, start, start))
        count = size - (search.window - 1)
        begin = np.cumsum(count) - count
        bits = np.zeros(int(count.sum()), bool)
        for a, b in _pieces(route[order[first]], size[order[first]]):
            low, high = first[a], first[b] if b < len(first) else len(order)
            some, one = order[low:high], order[first[a:b]]
            entry = np.repeat(np.arange(b - a), np.diff(np.r_[first[a:b], high]))
            own = route[one]
            same = np.r_[False, own[1:] == own[:-1]]
            lone = ~(same | np.r_[same[1:], False])
            shard = Shard(raw, start[one], size[one], lone, entry, weight[some])
            bits[ranges(begin[some], count[some])] = search.resolve(shard, search.window)
        ends = np.cumsum([0, *[int(x.sum()) - (search.window - 1) * len(x) for x in sizes]])
        return _rows(REPLY, [[r["part"] for r in rows], [r["shard"] for r in rows], [2] * len(rows),
                             [pack(np.packbits(bits[a:b])) for a, b in zip(ends[:-1], ends[1:], strict=True)]])
    return run


def _pieces(route: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cut distinct segments, sorted by route, where routes change, at about PIECE symbols."""
    ends = np.flatnonzero(np.r_[route[1:] != route[:-1], True]) + 1 if len(route) else np.zeros(0, int)
    total, done = np.cumsum(size), 0
    while done < len(route):
        goal = (total[done - 1] if done else 0) + PIECE
        fit = ends[(ends > done) & (total[ends - 1] <= goal)]
        stop = int(fit[-1]) if len(fit) else int(ends[np.searchsorted(ends, done, "right")])
        yield done, stop
        done = stop


def _contents(raw: np.ndarray, size: np.ndarray) -> np.ndarray:
    end = np.cumsum(size)
    return stretch_hashes(prefix_hashes(BYTE_VALUES[raw] if raw.dtype == np.uint8 else raw), end - size, end)


def flagged(docs: pa.Table, replies: pa.Table, search: Search, shards: int,
            local: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None):
    """The part's symbols and, for each, whether a flagged window starts there.

    local: from ids and first places of equal segments (in order) to those instances
    that are flagged whatever the shard says."""
    found, raw, order, first = _known(docs, replies, search, shards)
    one = order[first]
    count = found.last[one] - found.first[one]
    cuts = {s: (c, np.cumsum([0, *count[c]])) for s, c in _cut(shard_of(found.route[one], shards))}
    begin = np.cumsum(count) - count
    bits = np.zeros(int(count.sum()), bool)
    for r in replies.to_pylist():
        if r["round"] == 2:
            c, ends = cuts[r["shard"]]
            n = int(ends[-1])
            bits[begin[c.start]:begin[c.start] + n] = np.unpackbits(unpack(r["bits"], -(-n // 8), np.uint8), count=n)
    which = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(order)]))
    own = local(ids_of(docs)[found.doc[order]], first) if local is not None else np.zeros(len(which), bool)
    flags = np.zeros(len(raw), bool)
    total = np.cumsum(count[which])
    done = 0
    while done < len(which):
        stop = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + BLOCK, "right")))
        w, some = which[done:stop], order[done:stop]
        hit = bits[ranges(begin[w], count[w])] | np.repeat(own[done:stop], count[w])
        flags[ranges(found.first[some], count[w])[hit]] = True
        done = stop
    return raw, flags


def covered(flags: np.ndarray, window: int) -> np.ndarray:
    """Symbols within ``window`` from a flagged start, counted for a block of places at a time."""
    out = np.empty(len(flags), bool)
    for a in range(0, len(flags), PIECE):
        before = min(a, window - 1)
        total = np.cumsum(flags[a - before:a + PIECE], dtype=np.int32)
        total[window:] -= total[:-window].copy()
        out[a:a + PIECE] = total[before:] > 0
    return out


def search_windows(docs: DataFrame, key: str, text: str, search: Search, finish, schema: str,
                   hot: int = HOT, carry: Sequence[str] = ()) -> DataFrame:
    """Run both rounds; ``finish(docs, replies, shards)`` makes the rows of each part, in
    their order. The columns in ``carry`` are added as they are."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.pmod(F.xxhash64(F.col(key), F.col(text)), F.lit(n)).cast("int")
    parts = docs.select(part.alias("part"), F.col(key).cast("long").alias("id"),
                        F.col(text).cast("string").alias("text"),
                        *(F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry))).repartition(n, "part")
    anchors = parts.groupBy("part").applyInArrow(_ask_anchors(search, n), REQUEST)
    first = anchors.repartition(n, "shard").groupBy("shard").applyInArrow(_answer_anchors(hot), REPLY)
    asked = parts.groupBy("part").cogroup(first.repartition(n, "part").groupBy("part")).applyInArrow(_ask_segments(search, n), REQUEST)
    second = asked.repartition(n, "shard").groupBy("shard").applyInArrow(_answer_segments(search), REPLY)
    replies = first.unionByName(second).repartition(n, "part")

    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        out = finish(docs, replies, n)
        for i, name in enumerate(carry):
            out = out.append_column(name, docs.column(f"carry_{i}"))
        return out

    whole = ", ".join([schema, *(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)])
    return parts.groupBy("part").cogroup(replies.groupBy("part")).applyInArrow(run, whole)


def row_slices(column, read: Callable) -> Iterator[Symbols]:
    """Apply ``read(data, offsets)`` to slices of whole texts."""
    data, offsets = flat(column)
    for a, b in slices(offsets):
        yield read(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
