import hashlib
import tracemalloc

import numpy as np
import pytest
from brute import brute1, brute2

from tickloom.llm.fm_dedup import FMIndex, dedup_passages, matching_statistics
from tickloom.llm.passages import PIECE, covered
from tickloom.llm.suffix_dedup import bucket_pointers, counted_in, dedup_substrings, qgram_keys


def digest(kept):
    return hashlib.sha256(bytes(kept)).hexdigest()


@pytest.mark.parametrize("hot", [None, 1])
def test_bytes_against_brute_force(docs, rows, hot):
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), digest(r.kept)) for r in dedup_substrings(docs, hot=hot).collect())
    assert got == brute1(rows)
    assert sum(x[2] for x in got) > 1000


@pytest.mark.parametrize("hot", [None, 1])
def test_words_against_brute_force(docs, rows, hot):
    got = sorted((r.doc_id, r.n_words, r.n_removed, digest(r.kept)) for r in dedup_passages(docs, hot=hot).collect())
    assert got == brute2(rows)
    assert sum(x[2] for x in got) > 100


def test_null_ids_repeated_rows_and_empty_tables(spark, docs, none):
    text = "a passage that is longer than fifty bytes in all of its copies"
    rows = spark.createDataFrame([(None, text), (3, text), (3, text)], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.n_removed) for r in dedup_substrings(rows).collect()) == [(-1, len(text)), (3, 0), (3, 0)]
    assert dedup_substrings(none).count() == dedup_passages(none).count() == 0


def test_whole_characters_and_carried_columns(docs, rows):
    got = {r.doc_id: r for r in dedup_substrings(docs, characters=True, carry=("lang", "part")).collect()}
    texts = dict(rows)
    for d, r in got.items():
        assert set(bytes(r.kept).decode()) <= set(texts[d] or "")
        assert r.part == "x" and r.lang == ("en" if d % 2 else None)


def test_bucket_pointers_order_suffixes():
    raw = np.frombuffer(b"abracadabra" * 9 + b"zz" * 30, np.uint8)
    rank = bucket_pointers(qgram_keys(raw, 8), 8, 50)
    keys = [bytes(raw[i:i + 50]).ljust(50, b"\0") for i in range(len(raw))]
    order = sorted(range(len(raw)), key=lambda i: keys[i])
    assert [sum(k < keys[i] for k in keys) for i in order] == [int(rank[i]) for i in order]


def test_matching_statistics_against_counting():
    rng = np.random.default_rng(3)
    text = np.r_[rng.integers(1, 4, 300), 0, rng.integers(1, 4, 200)]
    ends = np.arange(20, 290)
    got = matching_statistics(FMIndex(text, 12), text, ends, 12)
    rows = ["".join(map(str, text[:300])), "".join(map(str, text[301:]))]
    for e, n in zip(ends, got, strict=True):
        def held(k, e=e):
            p = rows[0][e - k:e]
            return sum(r.startswith(p, i) for r in rows for i in range(len(r))) >= 2
        assert n == max((k for k in range(1, 13) if held(k)), default=0)


def test_marks_take_few_bytes_a_place():
    """What tells the bytes that go holds no number for each byte of a part's texts."""
    rng = np.random.default_rng(3)
    flags = rng.random(6 * PIECE + 5) < 0.001
    tracemalloc.start()
    got = covered(flags, 100)
    offsets = np.r_[0, np.sort(rng.integers(0, len(flags), 500)), len(flags)]
    offsets[7] = offsets[8]
    counts = counted_in(got, offsets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * len(flags)
    total = np.cumsum(flags)
    assert (got == (total - np.r_[np.zeros(100, int), total[:-100]] > 0)).all()
    assert list(counts) == [int(got[a:b].sum()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    assert not len(covered(flags[:0], 100)) and list(covered(flags[:1] | True, 100)) == [True]
