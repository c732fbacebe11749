"""Tokens of two tokenizers aligned over the same bytes.

Both token lists of a text are lists of byte offsets at which tokens end. The shorter list
drives: each of its ends gallops into the longer one, by steps of 1, 2, 4, ... and then by
halving, from the place that an end before it has found. Ends that both lists hold cut the
tokens into groups. Differences of the places found tell which tokens' bytes overlap: these
are the links. A pair of ids is counted over all links of the corpus.

Texts are cut into blocks of some megabytes. A block names each of its id pairs once, however
many links hold it, gets the pair's count over all blocks back once, and then sums its texts.
So a pair that every text holds costs one row a block, and no list of links is shuffled.
"""

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .arrays import pack, ranges, unpack

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"
# Fixed value: how the byte-level tokenizer cuts a text before merging bytes.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of text that make a block; a longer text makes one of its own.
BLOCK = 1 << 22
COUNTS = ("n_a", "n_b", "n_groups", "n_links")
SCHEMA = ("block long, at long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, "
          "packed struct<n_pairs:long,n_links:long,pairs:binary,links:binary,ends:binary>")


def byte_alphabet() -> dict[str, int]:
    """The printable characters by which byte-level vocabularies write bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class ByteTokens:
    """A byte-level BPE from its JSON file. ``bytes_of``: each id's bytes."""

    def __init__(self, text: str):
        file = json.loads(text)
        cut, model = file["pre_tokenizer"] or {}, file["model"]
        if (cut.get("type"), cut.get("use_regex"), cut.get("add_prefix_space")) != ("ByteLevel", True, False) \
                or file["normalizer"] or model["type"] != "BPE":
            raise ValueError("not a plain byte-level BPE")
        alphabet = byte_alphabet()
        special = {t["content"] for t in file["added_tokens"]}
        ranks = {bytes(alphabet[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        # the encoder merges by id, so ids have to rise with the merges
        if merged != sorted(merged):
            raise ValueError("ids are not in the order of merges")
        self.encoder = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes_of[i] = token

    def encode(self, text: str) -> list[int]:
        return self.encoder.encode_ordinary(" " + text)


class PieceTokens:
    """A sentencepiece model, which puts a space before each text."""

    def __init__(self, proto: bytes):
        self.model = model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.bytes_of = [b""] * model.get_piece_size()
        for i in range(len(self.bytes_of)):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i)):
                self.bytes_of[i] = piece.replace("▁", " ").encode()

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)


def gallop(values: np.ndarray, wanted: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """For each wanted value the first place in [first, last) of ``values``, ascending there,
    that isn't below it, or ``last``; all search at once, each from its own ``first``."""
    low, high = first.copy(), first.copy()
    run, step = np.flatnonzero(first < last), 1
    while len(run):
        at = high[run]
        run = run[values[at] < wanted[run]]
        at = high[run]
        low[run] = at + 1
        high[run] = np.minimum(at + step, last[run])
        run = run[high[run] < last[run]]
        step *= 2
    run = np.flatnonzero(low < high)
    while len(run):
        middle = (low[run] + high[run]) >> 1
        below = values[middle] < wanted[run]
        low[run[below]] = middle[below] + 1
        high[run[~below]] = middle[~below]
        run = run[low[run] < high[run]]
    return low


def places(values: np.ndarray, wanted: np.ndarray, starts: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Places of ascending runs of wanted values; run r starts at starts[r] and searches
    [first[r], last[r]). A run's first value gallops from there, then the one in the middle
    from its place, then those at a quarter from the places before them, and so on."""
    size = np.diff(np.r_[starts, len(wanted)])
    end = np.repeat(last, size)
    number = np.arange(len(wanted)) - np.repeat(starts, size)
    found = np.empty(len(wanted), np.int64)
    found[starts] = gallop(values, wanted[starts], first, last)
    stride = 1 << max(int(size.max(initial=1)) - 1, 0).bit_length()
    lowest = number & -number
    while stride:
        at = np.flatnonzero(lowest == stride)
        found[at] = gallop(values, wanted[at], found[at - stride], end[at])
        stride >>= 1
    return found


@dataclass
class Alignment:
    """Texts with tokens, one after the other; A's and B's tokens stand in text order.

    ``a_cut`` and ``b_cut``: the tokens' numbers after which a group ends; ``groups``: number
    of groups by text; ``a_link`` and ``b_link``: the two tokens of each link, by text and then
    by place; ``links``: number of links by text."""
    a_cut: np.ndarray
    b_cut: np.ndarray
    groups: np.ndarray
    a_link: np.ndarray
    b_link: np.ndarray
    links: np.ndarray


def align(a_end: np.ndarray, a_start: np.ndarray, b_end: np.ndarray, b_start: np.ndarray) -> Alignment:
    """``a_end`` and ``b_end``: byte offsets at which tokens end, rising over all texts; text t's
    tokens are [start[t], start[t + 1]), and each text's last ends are equal."""
    ends = np.r_[a_end, b_end]
    n_a, n_b = np.diff(a_start), np.diff(b_start)
    a_drives = n_a <= n_b
    b_base = b_start[:-1] + len(a_end)
    first = np.where(a_drives, a_start[:-1], b_base)
    size = np.where(a_drives, n_a, n_b)
    other, other_size = np.where(a_drives, b_base, a_start[:-1]), np.where(a_drives, n_b, n_a)
    driver = ranges(first, size)
    starts = np.r_[0, np.cumsum(size)[:-1]].astype(np.int64) if len(size) else np.zeros(0, np.int64)
    at = places(ends, ends[driver], starts, other, other + other_size)
    common = ends[at] == ends[driver]
    # a driver's bytes begin where the one before ends, so they overlap from that place on
    begin = np.r_[0, at[:-1] + common[:-1]] if len(at) else at
    begin[starts] = other
    width = at - begin + 1
    x, y = np.repeat(driver, width), ranges(begin, width)
    swap = x >= len(a_end)
    last_x, last_y = driver[common], at[common]
    turned = last_x >= len(a_end)
    total = np.r_[0, np.cumsum(width)]
    held = np.r_[0, np.cumsum(common)]
    bound = np.r_[starts, len(driver)]
    return Alignment(np.where(turned, last_y, last_x), np.where(turned, last_x, last_y) - len(a_end),
                     np.diff(held[bound]), np.where(swap, y, x), np.where(swap, x, y) - len(a_end),
                     np.diff(total[bound]))


def _digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0 to n - 1, left-bound, and how many."""
    size = np.array([len(str(i)) for i in range(n)])
    table = np.frombuffer("".join(str(i).ljust(10) for i in range(n)).encode(), np.uint8).reshape(n, 10)
    return table, size


def written(a_id, a_start, b_id, b_start, found: Alignment, digits) -> tuple[np.ndarray, np.ndarray]:
    """Each text's groups as ``a1,a2|b1;a3|b2,b3``: bytes, and where each text begins."""
    table, width = digits
    a_size, b_size = np.diff(np.r_[-1, found.a_cut]), np.diff(np.r_[-1, found.b_cut])
    begin = np.cumsum(a_size + b_size) - (a_size + b_size)
    at_a = ranges(begin, a_size)
    at_b = ranges(begin + a_size, b_size)
    token = np.empty(len(a_id) + len(b_id), np.int64)
    token[at_a], token[at_b] = a_id, b_id
    after = np.full(len(token), ord(","), np.uint8)
    after[begin + a_size - 1] = ord("|")
    after[begin + a_size + b_size - 1] = ord(";")
    size = width[token] + 1
    ends = np.cumsum(size)
    text_end = (a_start + b_start)[1:]
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    start = ends - size
    for k in range(int(size.max(initial=1)) - 1):
        some = np.flatnonzero(size > k + 1)
        out[start[some] + k] = table[token[some], k]
    out[ends - 1] = after
    # a text's last mark goes
    with_tokens = np.diff(np.r_[0, text_end]) > 0
    keep = np.ones(len(out), bool)
    keep[ends[text_end[with_tokens] - 1] - 1] = False
    bound = np.r_[0, np.r_[0, ends][text_end]] - np.r_[0, np.cumsum(with_tokens)]
    return out[keep], bound


class Block:
    """Texts until there are enough of them."""

    def __init__(self, a: ByteTokens, b: PieceTokens):
        self.a, self.b = a, b
        self.length = [np.array([len(x) for x in t.bytes_of]) for t in (a, b)]
        self.digits = _digits(max(len(a.bytes_of), len(b.bytes_of)))
        self.clear()

    def clear(self) -> None:
        self.ids, self.a_ids, self.b_ids, self.size = [], [], [], 0

    def add(self, key, text: str | None) -> None:
        a = b = ()
        if text:
            a, b = self.a.encode(text), self.b.encode(text)
            want = (" " + text).encode()
            self.size += len(want)
            for tokens, kind in ((a, self.a), (b, self.b)):
                if b"".join(map(kind.bytes_of.__getitem__, tokens)) != want:
                    a = b = ()
                    break
        self.ids.append(key)
        self.a_ids.append(np.array(a, np.int32))
        self.b_ids.append(np.array(b, np.int32))

    def batch(self, number: int) -> pa.RecordBatch:
        n = len(self.ids)
        ids, starts, ends = [], [], []
        for tokens, length in zip((self.a_ids, self.b_ids), self.length, strict=True):
            ids.append(np.concatenate(tokens).astype(np.int64))
            starts.append(np.r_[0, np.cumsum([len(t) for t in tokens])])
            ends.append(np.cumsum(length[ids[-1]]))
        (a, b), (a_start, b_start) = ids, starts
        some = np.flatnonzero(np.diff(a_start))
        used = [np.r_[s[:-1][some], s[-1]] for s in starts]
        found = align(ends[0], used[0], ends[1], used[1])
        groups, links = np.zeros(n, np.int64), np.zeros(n, np.int64)
        groups[some], links[some] = found.groups, found.links
        text, bound = written(a, a_start, b, b_start, found, self.digits)
        pair, link = np.unique(a[found.a_link] << 32 | b[found.b_link], return_inverse=True)
        packed = {"n_pairs": len(pair), "n_links": len(link), "pairs": pack(pair.astype(np.int64)),
                  "links": pack(link.astype(np.uint32)), "ends": pack(np.cumsum(links))}
        kind = pa.struct([("n_pairs", pa.int64()), ("n_links", pa.int64()), ("pairs", pa.binary()),
                          ("links", pa.binary()), ("ends", pa.binary())])
        strings = pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(bound.astype(np.int32)), pa.py_buffer(text)])
        columns = [pa.array(np.full(n, number)), pa.array(np.arange(n)), pa.array(self.ids, pa.int64()), pa.array(np.diff(a_start)),
                   pa.array(np.diff(b_start)), pa.array(groups), pa.array(links), strings,
                   pa.array([packed] + [None] * (n - 1), kind)]
        return pa.RecordBatch.from_arrays(columns, names=["block", "at", "doc_id", *COUNTS, "groups", "packed"])


def alignments(docs: DataFrame, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE,
               key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK) -> DataFrame:
    """Per row: doc_id, n_a and n_b (tokens), n_groups, n_links, groups (``a1,a2|b1;a3|b2,b3``,
    ids of each group); for ``weighed``: its block, its place there, and on a block's first row the packed links.

    Null and empty texts, and those whose tokens don't spell a space and the text, have no
    tokens: zeros and an empty string. Repeated rows are aligned each; further columns are not
    read. The two files are read on the driver and sent to the executors (some megabytes)."""
    context = docs.sparkSession.sparkContext
    with open(byte_bpe, encoding="utf-8") as f, open(piece_bpe, "rb") as g:
        sent = context.broadcast((f.read(), g.read()))

    def run(batches) -> Iterator[pa.RecordBatch]:
        block = Block(ByteTokens(sent.value[0]), PieceTokens(sent.value[1]))
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            # one text at a time becomes a string
            for doc_id, value in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                block.add(doc_id, value.as_py())
                if block.size >= block_bytes or len(block.ids) >= BLOCK // 64:
                    yield block.batch(number)
                    block.clear()
                    number += 1
        if block.ids:
            yield block.batch(number)

    return (docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
            .mapInArrow(run, SCHEMA))


def _links(packed: dict) -> tuple[np.ndarray, np.ndarray]:
    return (unpack(packed["pairs"], packed["n_pairs"], np.int64), unpack(packed["links"], packed["n_links"], np.uint32))


def _pairs(aligned: DataFrame) -> DataFrame:
    """block, pair and how many of the block's links hold it."""
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                pair, link = _links(row["packed"])
                yield pa.record_batch({"block": np.full(len(pair), row["block"]), "pair": pair,
                                       "n": np.bincount(link, minlength=len(pair))})

    return aligned.where("packed is not null").select("block", "packed").mapInArrow(run, "block long, pair long, n long")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, a and b (ids), n (links of the corpus that hold the pair), best (no other pair
    of this b has more). An id b has at most as many pairs as A has ids, and the table of
    greatest counts has one row for each id b: both are bounded by the vocabularies."""
    counts = (_pairs(aligned).groupBy("pair").agg(F.sum("n").alias("n"))
              .select("pair", F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b"), "n"))
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(most), "b").select("pair", "a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def weighed(aligned: DataFrame) -> DataFrame:
    """``aligned`` (``alignments``, whose ``groups`` may have been replaced) without packed links,
    and per row n_best (links whose pair no other pair of the same b exceeds) and count_sum
    (the links' pairs' counts over all rows, added up).

    It is read several times, so it is settled first. Joins are by pair with one row for each
    block that holds it, and by block."""
    aligned = settle(aligned)
    answers = _pairs(aligned).join(pair_counts(aligned).select("pair", F.col("n").alias("count"), "best"), "pair")
    kept = [c for c in aligned.columns if c != "packed"]
    schema = ", ".join(f"{c} {t}" for c, t in aligned.select(kept).dtypes) + ", n_best long, count_sum long"

    def run(rows: pa.Table, told: pa.Table) -> pa.Table:
        n = rows.num_rows
        best, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
        rows = rows.sort_by("at")  # a shuffle keeps no order
        packed = rows.column("packed").drop_null().to_pylist()[0]
        pair, link = _links(packed)
        if len(link):
            order = np.argsort(told.column("pair").to_numpy())
            count = told.column("count").to_numpy()[order]
            good = told.column("best").to_numpy()[order].astype(np.int64)
            ends = unpack(packed["ends"], n, np.int64)
            for out, value in ((total, count), (best, good)):
                so_far = np.r_[0, np.cumsum(value[link])]
                out += so_far[ends] - so_far[np.r_[0, ends[:-1]]]
        return rows.select(kept).append_column("n_best", pa.array(best)).append_column("count_sum", pa.array(total))

    return (aligned.groupBy("block").cogroup(answers.select("block", "pair", "count", "best").groupBy("block"))
            .applyInArrow(run, schema))

