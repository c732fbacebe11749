"""Near duplicates by min-max hashing, confirmed on full shingle sets, and their groups.

Each permutation gives two signature values, the least and the greatest hash, so half as
many permutations fill the bands. Equal sets are one class, looked up once. In a bucket of
a band, classes are compared with the bucket's first one; what that joins is not
compared again. Buckets that still hold several groups go on with the next twenty pivots,
then the rest, until no two groups of a bucket are uncompared: no pairs
within a joined group are made, and none between groups is left out. Two classes meet
in several bands; they are paired in the first that they share by 32 bits of each, and only if
their whole signatures differ no more than those of sets at the threshold may. A pair whose
sets' parities differ in more bits than its sets may in shingles is surely no link, and left out.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import written
from .arrays import SPACED, U64, binaries, flat, gram_hashes, mix, prefix_hashes, ranges, slices, stretch_hashes, words

#: 40 bands of 5 values: two sets with similarity 0.8 share none once in 8 million times.
BANDS, ROWS = 40, 5
#: Places in a bucket of the pivots of the second round, and of the first of the rest.
ROUNDS, LAST = ((1, 20),), 21
#: Rows of a key that are never dealt to several tasks.
SHARE = 1000
#: Tables of ids and links are this much narrower than texts, and have so many fewer partitions.
NARROW = 8
#: Ids that may be broadcast to pick documents, 16 MB at most, and pivots to pick rows, 32 MB at most.
PICK = 1_000_000
#: Standard deviations by which signatures may differ more than the similarity lets expect:
#: two sets with similarity 0.8 are beyond it less than once in 20 million times.
SLACK = 6.5
#: Longs of the parities of a set's shingles, each shingle falling on one bit.
PARITY = 16
SKETCH = "id long, hash long, n long, set_a long, set_b long, bands binary, code binary"


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and where each text's start. A text
    with fewer words than ``size`` has one shingle of all its words, without words none."""
    w = words(data, offsets, SPACED, lower=True)
    hashes, n = w.hashes(), np.diff(w.offsets)
    prefix = prefix_hashes(hashes)
    grams = gram_hashes(prefix, size)
    count = np.maximum(n - size + 1, 0)
    doc = np.repeat(np.arange(len(n)), count)
    grams = grams[ranges(w.offsets[:-1], count)]
    few = np.flatnonzero((n > 0) & (n < size))
    grams = np.r_[grams, stretch_hashes(prefix, w.offsets[few], w.offsets[few] + n[few])]
    doc = np.r_[doc, few]
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    new = np.r_[True, (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])][:len(grams)]
    grams, doc = grams[new], doc[new]
    return grams, np.searchsorted(doc, np.arange(len(n) + 1))


def signatures(grams: np.ndarray, at: np.ndarray, permutations: int) -> np.ndarray:
    """Least and greatest hash of each set under each permutation; sets aren't empty."""
    seeds = mix(np.arange(1, 2 * permutations + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)).reshape(2, -1)
    out = np.empty((len(at), 2 * permutations), U64)
    for i, (a, b) in enumerate(seeds.T):
        h = (grams ^ a) * (b | U64(1))
        h ^= h >> U64(32)
        out[:, i] = np.minimum.reduceat(h, at)
        out[:, permutations + i] = np.maximum.reduceat(h, at)
    return out


def codes(values: np.ndarray) -> np.ndarray:
    """Two bits of each signature value, as one plane of whole longs for each bit."""
    padded = np.zeros((len(values), -(-values.shape[1] // 64) * 64), U64)
    padded[:, :values.shape[1]] = values
    return np.concatenate([np.packbits((padded >> U64(bit) & U64(1)).astype(np.uint8), axis=1) for bit in (0, 1)], axis=1)


def parities(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether an odd number of each set's shingles falls on each bit; sets aren't empty."""
    place = grams % U64(64 * PARITY)
    bit, long = U64(1) << (place & U64(63)), place >> U64(6)
    return np.stack([np.bitwise_xor.reduceat(np.where(long == U64(i), bit, U64(0)), at) for i in range(PARITY)], axis=1)


def odd(values: int) -> str:
    """SQL: how many of the parities differ; no more than shingles that one set alone has."""
    first = 2 * -(-values // 64)
    return " + ".join(f"bit_count(code[{i}] ^ ac[{i}])" for i in range(first, first + PARITY))


def differing(values: int) -> str:
    """SQL: how many of the values have unlike bits in ``code`` and ``ac``."""
    longs = -(-values // 64)
    return " + ".join(f"bit_count((code[{i}] ^ ac[{i}]) | (code[{longs + i}] ^ ac[{longs + i}]))" for i in range(longs))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _sketch(size: int, bands: int, rows: int):
    permutations = -(-bands * rows // 2)

    def run(batches):
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            n, set_a, set_b, keys, planes = [], [], [], [], []
            for a, b in slices(offsets, 1 << 18):
                grams, at = shingle_sets(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], size)
                some = np.diff(at) > 0
                sums = [np.r_[U64(0), np.cumsum(mix(grams ^ U64(s)), dtype=U64)] for s in (0x51, 0x1F83D9ABFB41BD6B)]
                n.append(np.diff(at))
                set_a.append(np.diff(sums[0][at]))
                set_b.append(np.diff(sums[1][at]))
                key = np.zeros((b - a, bands), U64)
                code = np.zeros((b - a, 16 * -(-bands * rows // 64) + 8 * PARITY), np.uint8)
                if some.any():
                    values = signatures(grams, at[:-1][some], permutations)[:, :bands * rows]
                    # a band takes its values from different permutations
                    values = mix(values.reshape(-1, bands, rows))
                    code[some] = np.concatenate([codes(values.reshape(-1, bands * rows)),
                                                 parities(grams, at[:-1][some]).view(np.uint8)], axis=1)
                    key[some] = mix(values.sum(axis=2, dtype=U64) + np.arange(bands, dtype=U64) * U64(0xC2B2AE3D27D4EB4F))
                keys.append(key)
                planes.append(code)
            if not n:
                continue
            whole, code = np.concatenate(keys), np.concatenate(planes)
            yield pa.record_batch({
                "id": batch.column("id"), "hash": batch.column("hash"), "n": np.concatenate(n), "set_a": _signed(np.concatenate(set_a)),
                "set_b": _signed(np.concatenate(set_b)),
                "bands": binaries(whole.reshape(-1).view(np.uint8), np.arange(len(whole) + 1) * 8 * bands),
                "code": binaries(code.reshape(-1), np.arange(len(code) + 1) * code.shape[1])})
    return run


def _band_rows(bands: int):
    """The last bits of a bucket tell its band, which therefore needs no column of its own."""
    bits = U64((bands - 1).bit_length())

    def run(batches):
        for batch in batches:
            data, _ = flat(batch.column("bands"))
            keys = data.view(U64) >> bits << bits
            yield pa.record_batch({"bucket": _signed(keys | np.tile(np.arange(bands, dtype=U64), batch.num_rows)),
                                   "id": np.repeat(batch.column("id").to_numpy(), bands),
                                   "n": np.repeat(batch.column("n").to_numpy(), bands)})
    return run


def _digest_rows(batches):
    """32 bits of each band, to tell which bands two classes share, and the code as longs."""
    for batch in batches:
        data, offsets = flat(batch.column("bands"))
        code, at = flat(batch.column("code"))
        yield pa.record_batch({
            "id": batch.column("id"),
            "digests": pa.ListArray.from_arrays(pa.array(offsets // 8, pa.int32()),
                                                pa.array((data.view(np.int64) >> 32).astype(np.int32))),
            "code": pa.ListArray.from_arrays(pa.array(at // 8, pa.int32()), pa.array(code.view(np.int64)))})


def _set_rows(size: int):
    def run(batches):
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            for a, b in slices(offsets):
                grams, at = shingle_sets(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], size)
                yield pa.record_batch({**{c: batch.column(c).slice(a, b - a) for c in ("id", "parts")},
                                       "grams": binaries(grams.view(np.uint8), 8 * at)})
    return run


def _confirm(percent: int):
    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        held = dict(zip(sets.column("id").to_pylist(), (np.frombuffer(x.as_buffer(), U64) for x in sets.column("grams")), strict=True))
        good = []
        for a, b in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist(), strict=True):
            x, y = held[a], held[b]
            common = len(np.intersect1d(x, y, assume_unique=True))
            good.append(100 * common >= percent * (len(x) + len(y) - common))
        return pairs.select(["a", "b"]).filter(pa.array(good, pa.bool_()))
    return run


def confirm(pairs: DataFrame, docs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs of classes whose full sets reach the similarity. A class's set is made from the
    text of one of its rows. Sets go once to each part that has pairs with them, so a pivot of
    very many pairs is sent to each part once."""
    spark = pairs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = pairs.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(n)).cast("int"))
    wanted = written(dealt.select(F.explode(F.array("a", "b")).alias("class"), F.col("part").alias("to"))
                     .groupBy("class").agg(F.collect_set("to").alias("parts")))
    rows = narrow(wanted.select("class").join(classes.select("class", "id", "hash"), "class"))
    rows = F.broadcast(rows) if rows.count() <= PICK else rows
    # parts come to the text where its class has met, so sets are shuffled only to their parts
    picked = (docs.join(rows, ["id", "hash"]).select("class", "text").dropDuplicates(["class"])
              .join(wanted.hint("merge"), "class").select(F.col("class").alias("id"), "parts", "text"))
    sets = (picked.mapInArrow(_set_rows(size), "id long, parts array<int>, grams binary")
            .select(F.explode("parts").alias("part"), "id", "grams"))
    return (dealt.repartition(n, "part").groupBy("part")
            .cogroup(sets.repartition(n, "part").groupBy("part"))
            .applyInArrow(_confirm(percent), "a long, b long"))


def spread(left: DataFrame, right: DataFrame, sizes: DataFrame, keys: list[str], salt: str) -> DataFrame:
    """Inner join on ``keys`` in which no key of very many left rows meets one task.

    sizes: ``held``, how many left rows there are, by key (for the larger ones at least). Keys
    that hold more than a quarter of a task's even share, so fewer than four for each task, are
    broadcast; their left rows are dealt by the column ``salt`` and their right rows repeated."""
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = max(SHARE, (sizes.agg(F.sum("held")).first()[0] or 0) // (4 * n))
    hot = F.broadcast(sizes.where(F.col("held") > share).select(*keys, F.ceil(F.col("held") / share).cast("int").alias("deal")))
    dealt = F.coalesce(F.pmod(F.xxhash64(salt), F.col("deal")), F.lit(0)).cast("int")
    left = left.join(hot, keys, "left").withColumn("salt", dealt).drop("deal")
    right = right.join(hot, keys, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("deal", F.lit(1)) - 1))).drop("deal")
    return left.join(right, [*keys, "salt"]).drop("salt")


def narrow(df: DataFrame) -> DataFrame:
    """A written table of ids or links, in fewer files than texts would need."""
    return written(df.coalesce(max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // NARROW)))


def components(links: DataFrame) -> DataFrame:
    """(id, label): the smallest id reachable, for all ids that have links. Labels spread
    along links, and every third time jump to their own label's, until none changes."""
    both = narrow(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = narrow(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("label"))
                    .withColumn("label", F.least("id", "label")))
    turn = 0
    while True:
        turn += 1
        if turn % 3 == 0:
            far = labels.select(F.col("id").alias("label"), F.col("label").alias("far"))
            labels = narrow(labels.join(far, "label").select("id", F.col("far").alias("label")))
        near = (both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id"))
                .agg(F.min("label").alias("near")))
        after = narrow(labels.join(near, "id").select("id", F.least("label", "near").alias("label"),
                                                      (F.col("near") < F.col("label")).alias("moved")))
        labels = after.select("id", "label")
        if after.where("moved").isEmpty():
            return labels


def merged(labels: DataFrame, more: DataFrame) -> DataFrame:
    """Labels after further links. Those join whole groups, so only the groups' labels are
    walked, and ids that had no links come in with the label found for them."""
    ends = more
    for side in ("a", "b"):
        ends = (ends.join(labels.select(F.col("id").alias(side), "label"), side, "left")
                .withColumn(side, F.coalesce("label", side)).drop("label"))
    found = components(ends.distinct())
    old = (labels.join(found.select(F.col("id").alias("label"), F.col("label").alias("to")), "label", "left")
           .select("id", F.coalesce("to", "label").alias("label")))
    return narrow(old.union(found.join(labels.select("id"), "id", "left_anti").select("id", "label")))


def groups(docs: DataFrame, key: str, text: str, size: int, percent: int, bands: int, rows: int) -> DataFrame:
    """(id, hash, n, label) of each row, where ``label`` is the smallest class linked to its own.

    A class is a set of shingles, whatever the rows that hold it; its number says nothing.
    Rows without shingles or id have no label; ``hash`` is the text's and tells rows of one id
    apart."""
    docs = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")).withColumn("hash", F.xxhash64("text"))
    sketch = written(docs.mapInArrow(_sketch(size, bands, rows), SKETCH))
    some = sketch.where("n > 0 and id is not null")
    first = some.groupBy("set_a", "set_b").agg(
        F.min(F.struct("id", "hash", "n", "bands", "code")).alias("one"), F.count("*").alias("held"))
    classes = written(first.select("set_a", "set_b", "held", "one.*").withColumn("class", F.monotonically_increasing_id()))
    banded = classes.select(F.col("class").alias("id"), "n", "bands").mapInArrow(
        _band_rows(bands), "bucket long, id long, n long")
    # sizes are looked up for the pivots that are left: a number less to shuffle for each band of each class
    pivots = written(banded.groupBy("bucket").agg(F.min("id").alias("a"), F.count("*").alias("held")).where("held > 1")
                     .join(classes.select(F.col("class").alias("a"), F.col("n").alias("an")), "a").select("bucket", "held", "a", "an"))
    met = pivots.drop("held")
    met = (banded.join(F.broadcast(met), "bucket") if met.count() <= PICK
           else spread(banded, met, pivots, ["bucket"], "id"))
    crowded = written(met.withColumn("band", F.col("bucket").bitwiseAND(F.lit((1 << (bands - 1).bit_length()) - 1))))
    close = F.expr(f"100 * least(an, n) >= {percent} * greatest(an, n)")
    texts = docs.where("id is not null")
    tested = narrow(crowded.where("id <> a").where(close).select("a", F.col("id").alias("b")).distinct())
    labels = components(narrow(confirm(tested, texts, classes, size, percent)))

    def grouped(frame: DataFrame) -> DataFrame:
        return (frame.join(labels, "id", "left")
                .withColumn("label", F.coalesce("label", "id")))

    mixed = narrow(grouped(crowded).groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"),
                                                          F.count("*").alias("held")).where("low < high and held > 2"))
    open_ = narrow(crowded.select("bucket", "band", "id", "n").join(mixed.select("bucket"), "bucket", "left_semi"))
    # the limit on the rank is applied before rows are shuffled as well
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("id")) - 1
    ranked = narrow(open_.withColumn("rank", rank).where(F.col("rank") < LAST))
    beyond = ranked.where(F.col("rank") == LAST - 1).select("bucket", F.col("id").alias("from"))
    told = narrow(open_.select("id").distinct())
    told = F.broadcast(told) if told.count() <= PICK else told
    digests = narrow(classes.withColumn("id", F.col("class")).join(told, "id", "left_semi")
                     .select("id", "bands", "code").mapInArrow(_digest_rows, "id long, digests array<int>, code array<long>"))
    new = F.expr(f"not exists(sequence(0, {bands - 1}), i -> i < band and digests[i] = ad[i])")
    # two bits differ in three quarters of the values that do
    unlike = 0.75 * (1 - percent / 100)
    most = int(bands * rows * unlike + SLACK * (bands * rows * unlike * (1 - unlike)) ** 0.5)
    alike = F.expr(f"{100 + percent} * ({odd(bands * rows)}) <= {100 - percent} * (n + an) "
                   f"and {differing(bands * rows)} <= {most}")
    for low, high in (*ROUNDS, (LAST, None)):
        if high is None:
            first = grouped(open_.join(beyond, "bucket").where("id > from").drop("from"))
        else:
            first = grouped(ranked.where(F.col("rank").between(low, high)).drop("rank"))
        first = narrow(first)
        if first.isEmpty():
            break
        # only rows of another label than some pivot of their bucket can make a pair
        seen = first.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("id").alias("from"))
        rest = spread(grouped(open_), seen, mixed, ["bucket"], "id").where("id > from and (label <> low or label <> high)")
        pivot = first.join(digests, "id").select(
            "bucket", F.col("id").alias("a"), F.col("n").alias("an"),
            F.col("label").alias("al"), F.col("digests").alias("ad"), F.col("code").alias("ac"))
        pairs = (spread(rest.drop("low", "high", "from").join(digests, "id"), pivot, mixed, ["bucket"], "id")
                 .where("id > a and label <> al").where(close).where(alike).where(new)
                 .select("a", F.col("id").alias("b")).distinct())
        pairs = narrow(pairs.join(tested, ["a", "b"], "left_anti"))
        if not pairs.isEmpty():
            more = narrow(confirm(pairs, texts, classes, size, percent))
            tested = tested.union(pairs)
            if not more.isEmpty():
                labels = merged(labels, more)
    known = (classes.select("set_a", "set_b", "class").join(labels.withColumnRenamed("id", "class"), "class", "left")
             .withColumn("label", F.coalesce("label", "class")))
    held = spread(some.drop("bands", "code"), known, classes.select("set_a", "set_b", "held"), ["set_a", "set_b"], "id")
    columns = ("id", "hash", "n")
    alone = sketch.where("n = 0 or id is null").select(*columns, F.lit(None).cast("long").alias("label"))
    return written(held.select(*columns, "label").union(alone))


def least(members: DataFrame, *by: str) -> DataFrame:
    """Rows with ``first``, the smallest of the columns ``by`` (a struct) under their label; rows
    without a label or alone under it have their own."""
    own = F.struct(*by)
    low = (members.where("label is not null").groupBy("label")
           .agg(F.min(own).alias("least"), F.max(own).alias("most"), F.count("*").alias("held")).where("least < most"))
    low = narrow(low.drop("most"))
    single = members.join(F.broadcast(low.select("label")) if low.count() <= PICK else low.select("label"), "label", "left_anti")
    many = spread(members.where("label is not null"), low.drop("held"), low, ["label"], "id")
    return (many.select("id", "hash", "n", F.col("least").alias("first"))
            .union(single.select("id", "hash", "n", own.alias("first"))))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80,
                    bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest id reachable over links of
    ``percent`` similarity) and kept (the row is that document).

    Texts without words (null, empty, blank) have no shingles and no links. Rows with
    one id count as one document that has the links of all its texts. Rows with a null id
    take no part and are kept. Other columns are not read."""
    members = groups(docs, key, text, size, percent, bands, rows)
    # labels that share an id are linked
    labelled = members.where("label is not null")
    of_id = labelled.groupBy("id").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("held"))
    of_id = narrow(of_id.where("low < high").drop("high"))
    if not of_id.isEmpty():
        shared = spread(labelled, of_id.drop("held"), of_id, ["id"], "label").where("label > low")
        joined = components(narrow(shared.select(F.col("low").alias("a"), F.col("label").alias("b")).distinct()))
        joined = joined.select(F.col("id").alias("label"), F.col("label").alias("to"))
        sizes = labelled.groupBy("label").agg(F.count("*").alias("held"))
        moved = spread(labelled, joined, sizes, ["label"], "id").select("id", "hash", "n", F.col("to").alias("label"))
        members = written(moved.union(members.join(joined, "label", "left_anti").select("id", "hash", "n", "label")))
    return least(members, "id").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("first.id").alias("component_id"),
        F.col("id").eqNullSafe(F.col("first.id")).alias("kept"))


def copies(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80,
           bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, hash): rows that go if of each group of near duplicates only the smallest stays.

    Rows are documents of their own, in the order of their ids and of the ``xxhash64`` of their
    texts, by which rows of one id are told apart; equal rows stay or go together. Rows without
    an id or words stay."""
    members = groups(docs, key, text, size, percent, bands, rows)
    return (least(members, "id", "hash").where("id <> first.id or hash <> first.hash")
            .select(F.col("id").alias("doc_id"), "hash"))
