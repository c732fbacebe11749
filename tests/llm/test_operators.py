import base64
import collections
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from brute import brute3, brute5, brute10
from texts import prose
from pyspark.sql import functions as F

from tickloom.llm import licences, mixing, quality, warc
from tickloom.llm import minhash
from tickloom.llm.minhash import codes, near_duplicates, parities
from tickloom.llm.postings import contamination, proximity_matches
from tickloom.llm.rollups import PATTERN, VOCABULARY, Rollups, changes, count_tokens
from tickloom.llm.url_trees import filter_urls, train


def test_contamination_against_brute_force(spark, docs, rows, none):
    shared = rows[3][1].split("\n")[0]
    items = [(1, shared), (2, "One two"), (3, None), (4, "--"), (10, " ".join(rows[15][1].split()[50:70])), (11, "漢字"), (None, "tau0 not there")]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.n_hit > 0)
                 for r in contamination(docs, table).collect())
    assert got == brute3(rows, items)
    assert sum(x[2] for x in got) > 100
    assert contamination(none, table).count() == 0
    assert contamination(docs, table.where("1 = 0")).where("n_hit > 0").count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red x x blue red"), (2, "blue x x x x red")], "doc_id long, text string")
    assert sorted(map(tuple, proximity_matches(docs, "red", "blue", 3).collect())) == [(1, 0, 3), (1, 4, 3)]


def test_urls(spark):
    urls = ["http://A.com/x", "https://www.example.com/en/1", "http://m.example.com/en/2", "http://b.example.com/fr/", "http://com", None, "nothing",
            "http://x.net/es/a?b#c", "http://net/fr/", "http://y.org/q", "ftp://Z.NET/de/", "http://xcom/", "a\nb://q.com/\n?x"]
    # trees learn that deep paths with digits are blocked
    urls += [f"http://h{i}.com/a" for i in range(60)] + [f"http://h{i}.net/fr/{i}/{i * 7}/{i * 13}" for i in range(60)]
    urls += [f"http://h{i}.org/fr/{i}/{i * 7}/{i * 13}" for i in range(20)] + [f"http://h{i}.org/a" for i in range(20)]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, suffix string")
    got = {r.page_id: r for r in filter_urls(pages).collect()}
    rules = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}
    for i, u in enumerate(urls):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [r for r in rules for h, p in [r.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        rule = max(fits, key=len, default=None)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        if rule:
            assert got[i].verdict == rules[rule]
    held = [got[i].verdict for i in range(len(urls) - 40, len(urls))]
    assert np.mean([v == w for v, w in zip(held, ["block"] * 20 + ["allow"] * 20, strict=True)]) >= 0.9
    assert filter_urls(pages.where("1 = 0")).count() == 0


def test_copies_of_a_url_do_not_fill_the_sample(spark):
    urls = [(f"http://h{i}.com/a{i}", f"h{i}.com", f"/a{i}", "block" if i % 2 else "allow") for i in range(40)]
    shape = "url string, host string, path string, verdict string"
    first = spark.createDataFrame(urls, shape).orderBy(F.xxhash64("url")).first()
    model = train(spark.createDataFrame(urls + [tuple(first)] * 100, shape), trees=1, depth=1, sample_rows=30)
    assert not isinstance(model, str)


def test_quality_base_and_training(spark, docs, rows, none):
    good = [(100 + i, prose(i, 60)) for i in range(60)]
    bad = [(200 + i, " | ".join(prose(i, 60).upper().split())) for i in range(60)]
    every = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(d, int(d < 200), 0) for d, _ in good[:40] + bad[:40]] + [(None, 1, 0), (5, None, 0), (6, 9, 0)],
                                   "doc_id long, quality int, toxic int")
    model = quality.train(every, labels)
    got = {r.doc_id: r.kept for r in quality.judge(every, model).collect()}
    assert np.mean([got[d] == (d < 200) for d, _ in good[40:] + bad[40:]]) == 1.0
    judged = quality.judge(docs, model)
    assert sorted(tuple(r)[:7] for r in judged.collect()) == brute5(rows)
    kept = {r.doc_id for r in judged.where("kept").collect()}
    left = quality.keep_good(docs, model)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == kept
    assert quality.judge(none, model).count() == 0
    nothing = quality.train(docs, labels.where("1 = 0"))
    assert quality.judge(docs, nothing).where("kept = base_failed").count() == 0


def test_scores_equal_features_times_weights():
    data = np.frombuffer("Some words, ünd more\nwords of a text".encode(), np.uint8)
    at = np.array([0, 12, 12, len(data)])
    w = np.random.default_rng(1).normal(size=64)
    assert np.allclose(quality.features(data, at, 32) @ w + 0.5, quality.scores(data, at, w, 0.5))


def test_mixture_meets_targets(docs, rows):
    documents, draws = mixing.mixture(docs, block=16, shards=4)
    got = documents.toPandas()
    words = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows}
    assert dict(zip(got.doc_id, got["size"], strict=True)) == words
    assert (got.taken <= 3 * got["size"]).all()
    for _, x in got.groupby(got.source.fillna("")):
        assert abs(x.taken.sum() - x.target.iloc[0]) <= 1 and x["size"].sum() == x.source_size.iloc[0]
    assert mixing.mixture(docs.repartition(3), block=16, shards=4)[0].toPandas().sort_values("doc_id").taken.tolist() == got.sort_values("doc_id").taken.tolist()
    drawn = draws.toPandas()
    # blocks are disjoint and add up to what is taken, and shards are even
    assert not drawn.duplicated(["source", "begin"]).any()
    assert (drawn.stop - drawn.begin).sum() == got.taken.sum()
    assert drawn.groupby("shard").size().max() - drawn.groupby("shard").size().min() <= 2


@pytest.mark.parametrize("block", [16, 500])
def test_mixture_deals_documents_to_shards(docs, rows, block, monkeypatch):
    odd = docs.select("doc_id", "text", "source").union(docs.sparkSession.createDataFrame(
        [(None, prose(70, 90), "s1"), (None, prose(71, 40), "s1"), (1, prose(72, 70), "s2"), (900, "a b c", "tiny")],
        "doc_id long, text string, source string"))
    documents, draws, pieces = mixing.mix(odd, block=block, shards=4, carry=("text",))
    got, drawn, held = documents.toPandas(), draws.toPandas(), pieces.toPandas()
    assert sorted(got.text.fillna("")) == sorted((r.text or "") for r in odd.collect())
    for _, x in drawn.groupby("shard"):
        assert sorted(x.position) == list(range(len(x)))
    assert any(drawn.stop > drawn.source_size), "some source goes round again"
    # every word of every block, found again by walking the source's order
    orders = {s: [d for d in x.sort_values("begin").itertuples() if d.size] for s, x in got.assign(source=got.source.fillna("")).groupby("source")}
    want, taken = [], collections.Counter()
    for b in drawn.itertuples():
        order = [(d, w) for d in orders[b.source or ""] for w in range(d.size)]
        for w in range(b.begin, b.stop):
            d, at = order[w % len(order)]
            want.append((b.shard, b.position, w - b.begin, None if np.isnan(d.doc_id) else d.doc_id, at))
            taken[b.source or "", d.begin] += 1
    have = [(p.shard, p.position, p.place + w - p.begin, None if np.isnan(p.doc_id) else p.doc_id, w)
            for p in held.itertuples() for w in range(p.begin, p.stop)]
    assert sorted(have, key=str) == sorted(want, key=str)
    assert all(d.taken == (taken[d.source, d.begin] if d.size else 0) for d in got.assign(source=got.source.fillna("")).itertuples())
    # without the tree's blocks nothing is taken
    monkeypatch.setattr(mixing, "split_quotas", lambda quotas, shards, seed: np.zeros((shards, len(quotas)), np.int64))
    assert mixing.mix(odd, block=block, shards=4)[0].where("taken > 0").count() == 0


def test_targets_stop_at_three_times_the_size():
    got = mixing.targets({"a": 10, "b": 100, None: 890})
    assert got["a"] == 30 and got["b"] == 300 and abs(got[None] - 670) < 1e-9
    split = mixing.split_quotas(np.array([100, 7, 0, 3000]), 8)
    assert split.sum(axis=0).tolist() == [100, 7, 0, 3000] and np.ptp(split.sum(axis=1)) <= 1
    assert mixing.targets({}) == {}


def test_licences(docs, rows, none):
    got = {r.doc_id: r for r in licences.scan(docs).collect()}
    assert got[18].labels == ["mit", "mit-release"] and got[18].score == 1.0
    assert got[19].base_labels == ["cc-by", "gpl"] and "cc-by-nc" in got[19].labels and got[19].n_base == 2
    assert got[5].n_words == 0 and got[5].first_word is None and got[5].labels == []
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    for d, t in rows:
        assert got[d].n_words == len(low(t))
        for b in got[d].blocks:
            have = set(low(t)[b["first"]:b["last"]])
            want = set(low(licences.TEMPLATES[b.template]))
            assert b.share == len(have & want) / len(want) >= 0.9
    assert licences.scan(none).count() == 0


def licences_by_hand(text):
    """Places of the base phrases, and (template, first, last) of every block that reaches it."""
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    every = low(text or "")
    places = [(i, label) for phrase, label in licences.PHRASES for i in range(len(every))
              if every[i:i + len(phrase.split())] == phrase.split()]
    spans, run, at = set(), [], 0
    for line in [*(text or "").split("\n"), ""]:
        n = len(low(line))
        if n:
            spans.add((at, at + n))
            run.append((at, at + n))
        elif run:
            spans.add((run[0][0], run[-1][1]))
            run = []
        at += n
    found = set()
    for name, template in licences.TEMPLATES.items():
        words = set(low(template))
        for a, b in spans:
            if len(set(every[a:b]) & words) >= max(1, math.ceil(licences.THRESHOLD * len(words) - 1e-9)):
                found.add((name, a, b))
    return places, found


def test_no_licence_is_missed(spark, docs, rows):
    r = random.Random(3)
    texts = [t for _, t in rows]
    for template in licences.TEMPLATES.values():
        words = template.split()
        for keep in (1.0, 0.95, 0.9, 0.8):
            some = [w for w in words if r.random() < keep]
            r.shuffle(some)
            cut = r.randrange(len(some) + 1)
            texts.append(prose(r.randrange(99), 9) + "\n\n" + " ".join(some[:cut]) + "\n" + " ".join(some[cut:]).upper() + "\n \nend")
    texts.append(("MIT License " + prose(5, 3000) + "\n") * 60)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x for x in licences.scan(frame).collect()}
    for d, text in enumerate(texts):
        places, found = licences_by_hand(text)
        x = got[d]
        assert {(b.template, b["first"], b["last"]) for b in x.blocks} == found
        assert (x.n_base, x.first_word, x.last_word) == (len(places), min(places)[0] if places else None,
                                                        max(places)[0] if places else None)
        assert x.base_labels == sorted({p[1] for p in places})
        assert x.labels == sorted({p[1] for p in places} | {f[0] for f in found})
    none_known = {x.doc_id: x for x in licences.scan(frame, templates={}).collect()}
    assert all(x.labels == x.base_labels == got[d].base_labels and x.score == 0 for d, x in none_known.items())
    assert all(x.n_base == 0 for x in licences.scan(frame, phrases=[("", "x"), ("--", "y")], templates={"empty": "-"}).collect())


def test_archives_round_trip(spark):
    pages = [(i, f"http://h/{i}\r\nX: y", h) for i, h in enumerate(["a" * 500, "b", "a" * 500, None, "", "é\r\n\r\n" * 9, "b", "c" * 100_000])]
    pages += [(7, "http://h/7", "c" * 100_000), (None, None, "b")]
    table = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, shard int")
    folder = warc.new_folder(spark, "warc")
    one = warc.write_archives(table, folder, shards=3, file_bytes=600).toPandas()
    assert one.records.sum() == len(pages)
    other = warc.write_archives(table.repartition(5), warc.new_folder(spark, "warc"), shards=3, file_bytes=600).toPandas()
    assert sorted(one.sha256) == sorted(other.sha256)
    first = {}
    for p, _, h in pages:
        if p is not None:
            first[h or ""] = min(first.get(h or "", p), p)
    want = collections.Counter()
    for p, _, h in pages:
        body = (h or "").encode()
        of = None if p is None or first[h or ""] == p else first[h or ""]
        want[p, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if of is None else "revisit", of] += 1
    got = warc.read_archives(spark, folder)
    assert collections.Counter(tuple(r)[:5] for r in got.collect()) == want
    assert {r.page_id: bytes(r.payload) for r in got.where("record_type = 'response' and page_id = 5").collect()} == {5: ("é\r\n\r\n" * 9).encode()}
    empty = warc.new_folder(spark, "warc")
    warc.write_archives(table.where("1 = 0"), empty)
    assert warc.read_archives(spark, empty).count() == 0


def test_rollups(spark, docs, rows):
    import tiktoken
    with open(VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("x", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    counts = count_tokens(docs).cache()
    assert {r.doc_id: r.n_tokens for r in counts.collect()} == {d: len(plain.encode_ordinary(t or "")) for d, t in rows}
    store = Rollups(spark, warc.new_folder(spark, "rollups"))
    assert store.totals().count() == 0
    assert store.commit("in", changes(counts, "v", "n_tokens", 1)) and not store.commit("in", changes(counts, "v", "n_tokens", 1))
    gone = counts.where("doc_id < 10")
    assert store.commit("out", changes(gone, "v", "n_tokens", -1))
    want = collections.Counter()
    for r in counts.where("doc_id >= 10").collect():
        want[r.source, r.lang] += r.n_tokens
    held = lambda: {(r.source, r.lang): r.n_tokens for r in store.totals().collect() if r.n_tokens}
    assert held() == {k: v for k, v in want.items() if v}
    store.compact("all")
    assert held() == {k: v for k, v in want.items() if v} and not store.commit("out", changes(gone, "v", "n_tokens", -1))
    assert Rollups(spark, store.folder).committed().keys() == {"all"}
    # a name that is known already would cover itself
    for name in ("all", "in"):
        with pytest.raises(ValueError):
            store.compact(name)
    with pytest.raises(ValueError):
        store.commit("all", changes(gone, "v", "n_tokens", 1))
    store.compact("again")
    assert held() == {k: v for k, v in want.items() if v}


def test_parities_and_codes_bound_differences():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    for size in (1, 40, 900, 3000):
        x, y = (np.unique(rng.choice(pool, size)) for _ in range(2))
        p = parities(np.r_[x, y], np.array([0, len(x)]))
        assert np.bitwise_count(p[0] ^ p[1]).sum() <= len(np.setxor1d(x, y))
        assert not (parities(x, np.array([0])) ^ p[0]).any()
    values = rng.integers(0, 1 << 63, (2, 200), dtype=np.uint64)
    a, b = codes(values).view(np.uint64)
    unlike = np.bitwise_count((a[:4] ^ b[:4]) | (a[4:] ^ b[4:])).sum()
    assert unlike == ((values[0] & np.uint64(3)) != (values[1] & np.uint64(3))).sum()


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_against_brute_force(spark, docs, rows, none, size):
    chain = [" ".join(f"w{j}" for j in range(i * 3, i * 3 + 60)) for i in range(12)]
    extra = [(100 + i, t) for i, t in enumerate(chain)] + [(200 + i, prose(50, 80) + f" v{i}") for i in range(40)]
    more = docs.select("doc_id", "text", "id").union(spark.createDataFrame([(d, t, 0) for d, t in extra], "doc_id long, text string, id long"))
    got = sorted(map(tuple, near_duplicates(more, size=size).collect()))
    assert got == brute10(rows + extra, size)
    assert near_duplicates(none).count() == 0
    nulls = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (4, "a b c")], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.kept) for r in near_duplicates(nulls, size=size).collect()) == [(-1, True), (4, True), (4, True)]


def test_an_id_has_the_links_of_all_its_texts(spark):
    a, b, c = prose(60, 90), prose(61, 90), prose(62, 90)
    rows = [(1, a), (5, b), (5, a + " tail"), (7, b + " end"), (8, c), (9, c + " x"), (9, c + " x")]
    for order in (rows, rows[::-1]):
        got = near_duplicates(spark.createDataFrame(order, "doc_id long, text string")).collect()
        assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [
            (1, 1, True), (5, 1, False), (5, 1, False), (7, 1, False), (8, 8, True), (9, 8, False), (9, 8, False)]


def test_joins_spread_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SHARE", 10)
    left = spark.range(3000).selectExpr("id", "if(id % 3 = 0, 7, id % 50) as k")
    right = spark.range(40).selectExpr("id as k", "id * 10 as v")
    sizes = left.groupBy("k").agg(F.count("*").alias("held"))
    got = minhash.spread(left, right, sizes, ["k"], "id")
    assert got.columns == ["k", "id", "v"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, left.join(right, "k").collect()))


@pytest.mark.parametrize("pick", [0, 1_000_000])
def test_rows_of_a_bucket_meet_its_pivot_either_way(docs, rows, pick, monkeypatch):
    """Pivots broadcast or shuffled; a bucket's last bits are its band, so no row carries that."""
    monkeypatch.setattr(minhash, "PICK", pick)
    assert sorted(map(tuple, near_duplicates(docs, size=2).collect())) == brute10(rows, 2)
    keys = np.arange(40, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    batch = pa.record_batch({"id": pa.array([7]), "n": pa.array([3]), "bands": pa.array([keys.tobytes()], pa.binary())})
    out, = minhash._band_rows(40)([batch])
    assert out.schema.names == ["bucket", "id", "n"]
    assert [b & 63 for b in out.column("bucket").to_pylist()] == list(range(40))


def test_last_round_with_hot_buckets(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SHARE", 5)
    monkeypatch.setattr(minhash, "ROUNDS", ((1, 1),))
    monkeypatch.setattr(minhash, "LAST", 2)
    # one long passage in all, own words in each, so a bucket holds many sets that are no links
    rows = [(i, prose(70, 60) + " " + prose(100 + i // 2, 20) + " x" * (i % 2)) for i in range(60)]
    got = sorted(map(tuple, near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=2).collect()))
    assert got == brute10(rows, 2) and sum(x[3] for x in got) < 60


def test_pipeline_stages(spark, docs, rows):
    import corpus_pipeline as p
    folder = "/root/testdata/sf0.001"
    some = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in p.STAGES[:-1]:
        assert stage(spark, some, folder).columns == list(p.COLUMNS)
    kept = {r.doc_id for r in p.one_of_near_duplicates(spark, some, folder).collect()}
    assert kept == {d for d, *_, k in brute10(rows, 5) if k}
    texts = {r.doc_id: r.text for r in p.new_passages(spark, some, folder).collect()}
    assert 1 not in texts and texts[0] == rows[0][1] and rows[3][1].split("\n")[0] not in texts[4]


def test_pipeline_judges_rows(spark, tmp_path):
    import corpus_pipeline as p
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    clean = [prose(400 + i, 80) for i in range(12)]
    leak, near = prose(500, 60), prose(501, 120)
    # id 1 holds a clean text, a near copy and a leak; id 2 repeats a row; three rows have no id
    rows = [(1, clean[0]), (1, near + " tail"), (1, clean[1] + " " + leak), (0, near), (2, clean[2]), (2, clean[2]),
            (3, clean[3]), (3, clean[4]), (None, clean[5]), (None, clean[6]), (None, clean[7] + " " + leak),
            (4, clean[8]), (5, clean[9] + "\n" + clean[3]), (6, "| | |"), (None, "| | |"), (7, None), (1, "| | |")]
    rows = [(d, t, "en", f"s{i % 2}", i) for i, (d, t) in enumerate(rows)]
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, shape).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame = lambda x: spark.createDataFrame(x, shape).repartition(3)
    result = lambda stage, x: sorted(map(tuple, stage(spark, frame(x), str(tmp_path)).select(*p.COLUMNS).collect()), key=str)
    failed = [r[6] for r in sorted(brute5([(i, r[1]) for i, r in enumerate(rows)]))]
    good = [r for r, bad in zip(rows, failed, strict=True) if not bad]
    assert len(good) < len(rows) and result(p.good_quality, rows) == sorted(good, key=str)
    # near duplicates: rows by id and then anyhow, as no other texts are alike
    with_id = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    texts = list(dict.fromkeys(r[:2] for r in with_id))
    kept = {texts[d] for d, *_, k in brute10(list(enumerate(t for _, t in texts)), 5) if k}
    few = [r for r in rows if r[0] is None or r[:2] in kept or r[1] == "| | |"]
    got = result(p.one_of_near_duplicates, rows)
    assert [r for r in got if r[1] != "| | |"] == sorted((r for r in few if r[1] != "| | |"), key=str)
    assert sum(r[1] == "| | |" for r in got) == 2 and (1, near + " tail") not in {r[:2] for r in got} and (1, clean[0]) in {r[:2] for r in got}
    # passages: all that a row of a smaller id holds goes, no row else
    less = [(*r[:1], clean[9] + "\n", *r[2:4], len(clean[9]) + 1) if r[0] == 5 else r for r in rows]
    apart = [r for r in less if leak not in (r[1] or "") and near not in (r[1] or "")]
    got = result(p.new_passages, [r for r in rows if leak not in (r[1] or "") and near not in (r[1] or "")])
    assert [r[:4] for r in got] == sorted(((*r[:1], r[1] or "", *r[2:4]) for r in apart), key=str)
    assert result(p.without_benchmarks, rows) == sorted((r for r in rows if leak not in (r[1] or "")), key=str)
    # mixing: each row once, with sums that meet the targets
    mixed = p.mixed(spark, frame(good), str(tmp_path))
    assert mixed.columns == [*p.COLUMNS, "size", "target", "taken"]
    taken = mixed.toPandas()
    assert not taken.n_chars.duplicated().any() and taken["size"].tolist() == [words(t) for t in taken.text] and taken.doc_id.isna().any()
    for _, x in taken.groupby("source"):
        assert abs(x.taken.sum() - x.target.iloc[0]) <= 1
    # the whole of it
    done = p.run(spark, str(tmp_path)).toPandas()
    left = {r.text for r in done.itertuples()}
    assert left <= {*clean, near, clean[9] + "\n"} and done.doc_id.isna().any()
    assert not done[["doc_id", "text"]].query("doc_id != 2").duplicated().any()
    assert (done["size"] == [words(t) for t in done.text]).all() and (done.taken <= 3 * done["size"]).all()
    for _, x in done.groupby("source"):
        assert abs(x.taken.sum() - x.target.iloc[0]) <= 1


def test_pipeline_mixes_without_moving_texts(spark, monkeypatch):
    import corpus_pipeline as p
    rows = [(d, prose(d, 5 + d % 60), "en", f"s{d % 3}") for d in range(60)]
    # alike rows, rows of one id, swapped nulls and rows without an id
    rows += [rows[3], rows[3], (4, prose(99, 30), "en", "s1"), (4, prose(4, 9), None, "s1"), (4, prose(4, 9), "s1", None),
             (None, prose(98, 20), "en", "s0"), (None, prose(98, 20), "en", "s0"), (None, prose(97, 20), None, "s2"), (70, None, "en", "s0")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    carried = []
    monkeypatch.setattr(p, "mix", lambda docs, carry: carried.extend(carry) or mixing.mix(docs, carry=carry))
    got = p.mixed(spark, docs, "").toPandas()
    assert list(got.columns) == [*p.COLUMNS, "size", "target", "taken"]
    assert "text" not in carried
    want = mixing.mix(docs, carry=("text", "lang", "n_chars"))[0].where("taken > 0").toPandas()
    assert sorted(map(str, got[["doc_id", "text", "lang", "source", "size"]].values.tolist())) == sorted(
        map(str, want[["doc_id", "text", "lang", "source", "size"]].values.tolist()))
    for _, x in got.groupby(got.source.fillna("")):
        assert abs(x.taken.sum() - x.target.iloc[0]) <= 1


def test_sets_are_shuffled_only_to_their_parts(spark):
    from tickloom.llm import minhash
    rows = [(d, d, prose(d, 12), d) for d in range(6)]
    docs = spark.createDataFrame(rows, "id long, hash long, text string, class long")
    pairs = spark.createDataFrame([(0, 1), (0, 2), (3, 4)], "a long, b long")
    found = minhash.confirm(pairs, docs.drop("class"), docs.select("class", "id", "hash"), 2, 0)
    assert sorted(map(tuple, found.collect())) == [(0, 1), (0, 2), (3, 4)]
    plan = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
    made = next(i for i, x in enumerate(plan) if "MapInArrow" in x)
    assert not any("Join" in x for x in plan[:made]), "sets are joined, so shuffled, before they go to their parts"
