"""Mix sources to target weights: exact quotas, a splitting tree, disjoint permuted blocks.

A source's documents stand in an order drawn by hash; its words, laid out in that order, are
cut into blocks of equal size. A source's quota is a number of blocks, its last one cut so
that the words meet the target exactly; beyond its size it goes round again. A tree splits
the quotas among the output shards: each node gives its left half a draw without
replacement from the blocks of all sources (multivariate hypergeometric), so shards have equal
block counts and a random but exact mix. A shard takes its next blocks of each source's
order and shuffles them by a hash. Blocks are joined to the documents they overlap; what is
taken of a document is the sum of the pieces that the shards hold of it.
"""

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import settle

WEIGHTS, MOST, BLOCK, SHARDS, SEED = (5, 2, 1), 3, 128, 16, 11
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: dict, weights=WEIGHTS, most: float = MOST) -> dict:
    """Target of each source: shares of the total by weight, at most ``most`` times its size,
    the excess shared out again by weight. Sources by code point, null last."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, out, free = float(sum(sizes.values())), {}, list(order)
    while free:
        rest, all_weights = total - sum(out.values()), sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] / all_weights > most * sizes[s]]
        if not over:
            return out | {s: rest * weight[s] / all_weights for s in free}
        out |= {s: float(most * sizes[s]) for s in over}
        free = [s for s in free if s not in out]
    return out


def split_quotas(quotas: np.ndarray, shards: int, seed: int = SEED) -> np.ndarray:
    """Blocks of each source (columns) for each shard (rows); columns add up to the quotas."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def split(first: int, last: int, left: np.ndarray) -> None:
        if last - first == 1:
            out[first] = left
            return
        middle = (first + last) // 2
        rng = np.random.default_rng([seed, first, last])
        draws = int(left.sum()) * (middle - first) // (last - first)
        part, remaining = np.zeros_like(left), int(left.sum())
        for i, n in enumerate(left):
            part[i] = _draw(rng, int(n), remaining - int(n), draws)
            draws, remaining = draws - int(part[i]), remaining - int(n)
        split(first, middle, part)
        split(middle, last, left - part)

    split(0, shards, quotas)
    return out


def _draw(rng, good: int, bad: int, draws: int) -> int:
    """Hypergeometric; numpy's takes less than 10**9 of each, so larger ones are scaled to
    a normal draw of the same mean and spread, held within what is possible."""
    if not draws or not good:
        return 0
    if good < 10**9 and bad < 10**9:
        return int(rng.hypergeometric(good, bad, draws)) if good + bad else 0
    n = good + bad
    mean, spread = draws * good / n, (draws * good / n * bad / n * (n - draws) / max(n - 1, 1)) ** 0.5
    return int(min(good, draws, max(0, draws - bad, round(rng.normal(mean, spread)))))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
        weights=WEIGHTS, most: float = MOST, block: int = BLOCK, shards: int = SHARDS,
        seed: int = SEED, carry: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, draws, pieces). documents: doc_id, source, size, source_size, target, taken,
    begin (its first word in the source's order) and the columns in ``carry``. draws: source,
    shard, position in the shard (0, 1, ... in shuffled order), and the words [begin, stop) of
    the source's order that the block holds, counted on when it goes round. pieces: shard,
    position of the block, place (words of the block before the piece), doc_id, source, and the
    words [begin, stop) of the document, sorted within each shard. taken is summed from pieces.

    Sizes are words; a null or empty text has none and is never taken. A null source is a
    source of its own. Every row counts for itself, whatever its id: ties in the order are
    settled by size and the carried columns, and rows equal in all of them are alike. A row
    per source, with its sums, goes through the driver."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    carried = [F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)]
    # rows without an id are dealt by their text, else they'd all meet in one cell
    rows = settle(docs.select(F.col(key).alias("id"), F.col(source).cast("string").alias("source"),
                              F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0))
                              .cast("long").alias("size"),
                              F.xxhash64(F.col(text), *(F.col(c) for c in carry)).alias("tie"), *carried)
                  .withColumn("at", F.when(F.col("id").isNull(), F.xxhash64("tie", F.lit(seed)))
                              .otherwise(F.xxhash64("id", F.lit(seed)))))
    # cells cut each source's order in ranges of the hash, so no task holds a whole source
    rows = rows.withColumn("cell", _cell("at", 64 * parts))
    sums = settle(rows.groupBy("source", "cell").agg(F.sum("size").alias("words")))
    by_source = {r["source"]: r["words"] for r in sums.groupBy("source").agg(F.sum("words").alias("words")).collect()}
    target = targets(by_source, weights, most)
    names = sorted(by_source, key=lambda s: (s is None, s or ""))
    goal = [min(round(target[s]), int(most * by_source[s])) for s in names]
    quotas = np.array([-(-g // block) for g in goal], np.int64)
    split = split_quotas(quotas, shards, seed)
    plan = spark.createDataFrame(
        [(s, i, by_source[s], float(target[s])) for i, s in enumerate(names)],
        "same string, stratum int, source_size long, target double")
    before = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("cell").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(F.col("source").alias("same"), "cell", before.alias("base"))
    within = Window.partitionBy("source", "cell").orderBy("at", "id", "size", "tie")
    placed = (rows.withColumn("inner", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
              .join(starts, F.expr("source <=> same") & (rows["cell"] == starts["cell"]))
              .drop("same")
              .withColumn("begin", F.col("base") + F.col("inner")))
    placed = (placed.join(F.broadcast(plan), F.expr("source <=> same"))
              .select("id", "source", "stratum", "size", "source_size", "target", "begin",
                      *(f"carry_{i}" for i in range(len(carry)))))
    first = np.cumsum(split, axis=0) - split
    cuts = [(s, i, int(by_source[s]), g, k, int(first[k, i]), int(split[k, i]))
            for i, (s, g) in enumerate(zip(names, goal, strict=True)) for k in range(shards) if split[k, i]]
    blocks = (spark.createDataFrame(cuts, "source string, stratum int, source_size long, goal long, shard int, first long, n long")
              .select("*", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("block"))
              .withColumns({"begin": F.col("block") * block, "stop": F.least((F.col("block") + 1) * block, "goal")})
              .withColumn("drawn", F.xxhash64("shard", "source", "block", F.lit(seed))))
    draws = settle(_ranked(blocks, parts).select("source", "stratum", "source_size", "shard", "position", "begin", "stop"))
    pieces = settle(_pieces(placed.select("id", "stratum", "size", "begin"), draws, block)
                    .repartitionByRange(parts, "shard", "position").sortWithinPartitions("shard", "position", "place"))
    # documents with words begin at different words of their source
    taken = pieces.groupBy("stratum", F.col("at").alias("begin")).agg(F.sum(F.col("stop") - F.col("begin")).alias("taken"))
    held = placed.withColumn("full", F.col("size") > 0)
    documents = (held.join(taken.withColumn("full", F.lit(True)), ["stratum", "begin", "full"], "left")
                 .select(F.col("id").alias(key), "source", "size", "source_size", "target",
                         F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "begin",
                         *(F.col(f"carry_{i}").alias(c) for i, c in enumerate(carry))))
    return (documents, draws.drop("stratum"),
            pieces.select("shard", "position", "place", F.col("id").alias(key), "source", "begin", "stop"))


def mixture(docs: DataFrame, *args, **options) -> tuple[DataFrame, DataFrame]:
    """documents and draws of ``mix``."""
    documents, draws, _ = mix(docs, *args, **options)
    return documents, draws


def _cell(column: str, cells: int):
    """Number of the range of a 64-bit hash, of ``cells`` equal ones."""
    return F.floor((F.col(column).cast("double") / 2.0**63 + 1) / 2 * cells).cast("int")


def _ranked(blocks: DataFrame, cells: int) -> DataFrame:
    """With ``position``: 0, 1, ... in each shard by the hash ``drawn``, counted per range of the hash."""
    blocks = blocks.withColumn("cell", _cell("drawn", cells))
    held = blocks.groupBy("shard", "cell").agg(F.count("*").alias("held"))
    before = F.coalesce(F.sum("held").over(Window.partitionBy("shard").orderBy("cell").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    inner = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("drawn", "stratum", "block")) - 1
    return (blocks.withColumn("inner", inner).join(held.select("shard", "cell", before.alias("base")), ["shard", "cell"])
            .withColumn("position", F.col("base") + F.col("inner")))


def _pieces(placed: DataFrame, draws: DataFrame, block: int) -> DataFrame:
    """Stretches of documents that blocks hold. Both sides are cut at multiples of ``block``
    words of the source's order, so a cell has at most ``block`` documents with words and, each
    time round, two blocks."""
    size = F.col("source_size")
    rounds = F.sequence(F.expr("begin div source_size"), F.expr("(stop - 1) div source_size"))
    turns = (draws.withColumn("round", F.explode(rounds))
             .withColumns({"low": F.greatest("begin", F.col("round") * size) - F.col("round") * size,
                           "high": F.least(F.col("stop") - F.col("round") * size, size),
                           "place": F.greatest("begin", F.col("round") * size) - F.col("begin")})
             .select("source", "stratum", "shard", "position", "low", "high", "place",
                     F.explode(F.expr(f"sequence(low div {block}, (high - 1) div {block})")).alias("cell")))
    spread = (placed.where("size > 0").withColumnRenamed("begin", "at")
              .select("id", "stratum", "at", "size",
                      F.explode(F.expr(f"sequence(at div {block}, (at + size - 1) div {block})")).alias("cell")))
    start, stop = F.greatest("low", "at"), F.least("high", F.col("at") + F.col("size"))
    # a piece that lies in several cells is told in the first
    return (turns.join(spread, ["stratum", "cell"]).withColumns({"start": start, "end": stop})
            .where(F.expr(f"start < end and start div {block} = cell"))
            .select("shard", "position", (F.col("place") + F.col("start") - F.col("low")).alias("place"), "id", "source",
                    "stratum", "at", (F.col("start") - F.col("at")).alias("begin"), (F.col("end") - F.col("at")).alias("stop")))
