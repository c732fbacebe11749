"""Benchmark passages in documents, from a positional inverted index.

All on DataFrames. The index has one row for each place of a term; only the terms that a
search needs are stored. A phrase is looked up by its rarest terms: the documents' counts
of the benchmark's words come first, then the postings of each phrase's two rarest words
are shifted to the phrase's start and intersected, and the surviving starts are held
against the documents' words in full.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import settle

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 10
#: Rows and words that a broadcast side may have; above it the join shuffles.
PHRASES_BROADCAST = 500_000


def lower_ascii(c: Column) -> Column:
    """A-Z only; plain ASCII takes the quick way."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def terms(text: Column) -> Column:
    """Words of a text as they stand (A-Z not lowered yet)."""
    return F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD), 0)


def phrases(items: DataFrame, key: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(phrase, words, items): each distinct window of the items' words; an item of
    fewer words is one window, an item without words none."""
    words = F.transform(terms(F.col(text)), lower_ascii)
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0))),
                      lambda i: F.slice("w", i + 1, window))
    rows = (items.select(F.col(key).cast("string").alias("item"), words.alias("w")).where(F.size("w") > 0)
            .select("item", F.explode(cut).alias("words")))
    return (rows.groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("items"))
            .withColumn("phrase", F.xxhash64("words")))


def positions(docs: DataFrame) -> DataFrame:
    """(doc, pos, term): the index of (doc, text), unstored."""
    return (docs.select("doc", F.posexplode(terms(F.col("text"))).alias("pos", "term"))
            .withColumn("term", lower_ascii(F.col("term"))))


def postings(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Index rows of the wanted terms (a column ``term`` without repeats)."""
    return positions(docs).join(bounded(wanted), "term")


def bounded(frame: DataFrame, most: int = PHRASES_BROADCAST) -> DataFrame:
    """Broadcast where the counted rows are few enough."""
    return F.broadcast(frame) if frame.count() <= most else frame


def rarest(found: DataFrame, counts: DataFrame, n: int) -> DataFrame:
    """(phrase, term, offset, place): the n rarest different terms of each phrase, by count."""
    rows = (found.select("phrase", F.posexplode("words").alias("offset", "term"))
            .groupBy("phrase", "term").agg(F.min("offset").alias("offset")))
    order = Window.partitionBy("phrase").orderBy("count", "term")
    return (rows.join(counts, "term").withColumn("place", F.row_number().over(order))
            .where(F.col("place") <= n).select("phrase", "term", "offset", "place"))


def phrase_starts(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc, start, phrase): places of (doc, text) where a phrase's rarest words stand."""
    vocabulary = settle(found.select(F.explode("words").alias("term")).distinct())
    counts = settle(positions(docs).join(bounded(vocabulary), "term", "left_semi")
                    .groupBy("term").agg(F.count("*").alias("count")))
    # a phrase with a word that no document has isn't anywhere
    heard = found.select("phrase", F.explode(F.array_distinct("words")).alias("term")).join(counts, "term", "left")
    absent = heard.where("count is null").select("phrase").distinct()
    keys = settle(rarest(found.join(absent, "phrase", "left_anti"), counts, 2))
    wanted = settle(keys.groupBy("term").agg(F.collect_list(F.struct("phrase", "offset", "place")).alias("uses")))
    needs = settle(keys.groupBy("phrase").agg(F.bit_or("place").alias("need")))
    placed = (postings(docs, wanted).select("doc", "pos", F.explode("uses").alias("use"))
              .select("doc", (F.col("pos") - F.col("use.offset")).alias("start"), "use.phrase", "use.place")
              .where("start >= 0"))
    # the lists intersected on document, start and phrase
    met = placed.groupBy("doc", "start", "phrase").agg(F.bit_or("place").alias("met"))
    return met.join(bounded(needs), "phrase").where("met = need").select("doc", "start", "phrase")


def phrase_matches(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc, matches): for each (doc, text) with any phrase, the places where one stands in
    full, with its size and items. A document's matches stay in one row, as its text does."""
    candidates = settle(phrase_starts(docs, found))
    held = settle(candidates.select("doc").distinct())
    texts = docs.join(bounded(held), "doc", "left_semi").select("doc", terms(F.col("text")).alias("all"))
    places = (candidates.join(bounded(found), "phrase").groupBy("doc")
              .agg(F.collect_list(F.struct("start", "words", "items")).alias("places")))
    sure = F.filter("places", lambda p: F.transform(
        F.slice("all", p["start"] + 1, F.size(p["words"])), lower_ascii) == p["words"])
    return (texts.join(places, "doc").select("doc", F.transform(sure, lambda p: F.struct(
        p["start"].alias("start"), F.size(p["words"]).alias("size"), p["items"].alias("items"))).alias("matches"))
        .where(F.size("matches") > 0))


def proximity_matches(docs: DataFrame, first: str, second: str, within: int, key: str = "doc_id",
                      text: str = "text") -> DataFrame:
    """(doc_id, pos, other): places of ``first`` with ``second`` at most ``within`` words away."""
    rows = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"))
    near = Window.partitionBy("doc").orderBy("pos").rangeBetween(-within, within)
    others = F.collect_list(F.when(F.col("term") == second, F.col("pos"))).over(near)
    return (positions(rows).where(F.col("term").isin(first, second)).withColumn("others", others)
            .where(F.col("term") == first).select(F.col("doc").alias(key), "pos", F.explode("others").alias("other"))
            .where("pos <> other"))


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
                  item_key: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Per row: doc_id, n_words, n_hit (words inside occurrences), items (ids of benchmark
    items with occurring windows, sorted as strings), matches (start, size, items of each).

    Null and empty texts have no words. Rows with one id or a null id are judged each by
    its own text. A null item id is no item, but its windows hit. Other columns, whatever
    their names, are not read; empty tables give no hits."""
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    doc = F.struct(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), F.xxhash64("text").alias("hash"))
    rows = rows.withColumn("doc", doc)
    found = settle(phrases(items, item_key, item_text, window))
    matches = phrase_matches(rows.select("doc", "text"), found).dropDuplicates(["doc"])
    hit = F.array_distinct(F.flatten(F.transform("matches", lambda m: F.sequence(m["start"], m["start"] + m["size"] - 1))))
    names = F.array_sort(F.array_distinct(F.flatten("matches.items")))
    hits = matches.select("doc", F.size(hit).cast("long").alias("n_hit"), names.alias("items"), "matches")
    return (rows.select("doc", "id", F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words"))
            .join(hits, "doc", "left")
            .select(F.col("id").alias(key), F.coalesce("n_words", F.lit(0)).alias("n_words"),
                    F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items"), "matches"))
