"""Documents to a training mix: quality, near duplicates, repeated passages, benchmarks, mixing.

Each stage reads what the one before wrote and returns the columns of documents, the last one
also the words that the mix takes of each document. Stages judge rows, not ids: rows that share
an id go or stay each by its own text, and so do rows with a null id, save that these take no
part in near-dedup and all stay there.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import quality
from tickloom.llm.minhash import copies
from tickloom.llm.mixing import mix
from tickloom.llm.postings import bounded, contamination
from tickloom.llm.queries import table
from tickloom.llm.suffix_dedup import dedup_substrings
from tickloom.llm.warc import new_folder
from tickloom.session import settle

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Bytes of a repeated passage, shorter than any 50 words of prose, and of its anchors.
PASSAGE, PASSAGE_ANCHOR = 100, 24
#: Ids that may be broadcast to drop documents: 16 MB at most.
DROP = 1_000_000


#: Tells the rows of an id apart; rows equal in id and text are alike.
HASH = F.xxhash64("text")


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Documents without those that equal a row of ``gone`` in doc_id (null equals null) and in
    the hash of the text."""
    gone = bounded(settle(gone.select(F.col("doc_id").alias("gone_id"), F.col("hash").alias("gone_hash")).distinct()), DROP)
    same = "doc_id <=> gone_id and hash <=> gone_hash"
    return docs.withColumn("hash", HASH).join(gone, F.expr(same), "left_anti").drop("hash")


def good_quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the base rules and the classifier keep."""
    docs = docs.select(*COLUMNS)
    return quality.keep_good(docs, quality.train(docs, table(spark, folder, "labels")))


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The smallest document of each group of near duplicates (five words, 0.8).

    Different texts under one id are documents of their own, in the order of their hashes;
    equal ones stay or go together. Rows with a null id stay."""
    docs = docs.select(*COLUMNS)
    return without(docs, copies(docs))


def new_passages(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Texts without the passages that a smaller document holds; a text of which nothing is left
    goes."""
    found = dedup_substrings(docs, window=PASSAGE, anchor=PASSAGE_ANCHOR, characters=True, carry=("lang", "source"))
    text = F.col("kept").cast("string")
    return (found.where("n_removed < n_bytes or n_bytes = 0")
            .select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars")))


def without_benchmarks(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without any passage of the benchmark, each row judged by its own text."""
    rows = docs.withColumn("row", F.struct("doc_id", HASH.alias("hash")))
    found = contamination(rows, table(spark, folder, "benchmark"), key="row")
    return without(docs, found.where("n_hit > 0").select("row.doc_id", "row.hash")).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the mix takes, with their words, their source's target and the words taken
    of each row. The mix moves hashes for texts; a text is shuffled once, to the rows of its key."""
    key = ["same_id", "no_id", "hash"]
    # a hash skips nulls, so where they stand is told as well
    docs = docs.select(*COLUMNS).withColumn("hash", F.xxhash64(*COLUMNS[1:], *(F.col(c).isNull() for c in COLUMNS[1:])))
    documents, _, _ = mix(docs, carry=("hash",))
    named = {"same_id": F.coalesce("doc_id", F.lit(0)), "no_id": F.col("doc_id").isNull()}
    taken = documents.where("taken > 0").withColumns(named).select(*key, "size", "target", "taken")
    # rows of a key are alike, so one of them stands for all that are taken
    texts = docs.withColumns(named).dropDuplicates(key)
    return texts.join(taken, key).select(*COLUMNS, "size", "target", "taken")


STAGES = [("quality rules", good_quality), ("minhash near-dedup", one_of_near_duplicates),
          ("suffix-array dedup", new_passages), ("benchmark decontamination", without_benchmarks),
          ("mixing to target weights", mixed)]

#: The classifier, suffix sorting and the hashed order have no SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs, place = table(spark, folder, "documents"), new_folder(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, folder).write.parquet(f"{place}/{i}")
        docs = spark.read.parquet(f"{place}/{i}")
    return docs
