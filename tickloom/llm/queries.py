"""Registered queries of the numbered operators, over the whole of their tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settle
from . import licences, quality, warc, whitening
from .alignment import alignments, weighed
from .fm_dedup import dedup_passages
from .minhash import near_duplicates
from .mixing import mix
from .postings import contamination
from .rollups import Rollups, changes, count_tokens
from .secrets import find_secrets
from .suffix_dedup import dedup_substrings
from .url_trees import filter_urls


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = dedup_substrings(table(spark, folder, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"))


def op2_fm_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = dedup_passages(table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_postings(spark: SparkSession, folder: str) -> DataFrame:
    found = contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def op4_url_trees(spark: SparkSession, folder: str) -> DataFrame:
    return filter_urls(table(spark, folder, "pages"))


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality.judge(docs, quality.train(docs, table(spark, folder, "labels")))


def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    documents, _, _ = mix(table(spark, folder, "documents"))
    return documents.select("doc_id", "size", "source_size", "target", "taken")


def op7_licences(spark: SparkSession, folder: str) -> DataFrame:
    found = licences.scan(table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word",
                        F.array_join("base_labels", ",").alias("base_labels"),
                        F.array_join("labels", ",").alias("labels"), "score")


def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    archives = warc.new_folder(spark, "warc")
    warc.write_archives(table(spark, folder, "pages"), archives)
    return warc.read_archives(spark, archives).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_rollups(spark: SparkSession, folder: str) -> DataFrame:
    """All documents come in, with their words counted by blanks only at first; that count is
    revised, and documents whose text an earlier one has go. The last batch is sent twice."""
    docs = table(spark, folder, "documents")
    rough = F.coalesce(F.length("text") - F.length(F.replace("text", F.lit(" "))) + 1, F.lit(0))
    counts = settle(count_tokens(docs))
    sized = docs.select("source", "lang", rough.alias("rough"))
    text = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))
    first = text.groupBy("hash").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = counts.join(text.join(first, "hash").where("doc_id <> first").select("doc_id"), "doc_id", "left_semi")
    store = Rollups(spark, warc.new_folder(spark, "rollups"))
    store.commit("bpe", changes(counts, "byte_bpe_50k", "n_tokens", 1))
    store.commit("words", changes(sized, "words", "rough", 1))
    store.commit("revised", changes(sized, "words", "rough", -1).union(changes(counts, "words", "n_words", 1)))
    for _ in range(2):
        store.commit("copies", changes(copies, "byte_bpe_50k", "n_tokens", -1)
                     .union(changes(copies, "words", "n_words", -1)))
    return store.totals()


def op10_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"), size=2)


def op11_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """The groups are long texts, so their digests are taken before the pairs' counts are known."""
    found = alignments(table(spark, folder, "documents"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return weighed(found.withColumn("groups_sha256", digest).drop("groups")).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = find_secrets(table(spark, folder, "documents"))
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    base = F.filter("spans", lambda s: s.kind != "random")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(written(base), 256).alias("base_sha256"),
                        written(F.col("spans")).alias("spans"))


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    rows, size = whitening.vectors(table(spark, folder, "embeddings"))
    fit = whitening.fit(rows, size)
    found = whitening.whiten(rows, fit)
    explained = F.array(*[F.lit(float(x)) for x in fit.explained]).cast("array<double>")
    return found.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(whitening.identity_error(found)).alias("identity_error"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, folder)


QUERIES = {f.__name__: f for f in (
    op1_suffix_dedup, op2_fm_dedup, op3_postings, op4_url_trees, op5_quality, op6_mixing,
    op7_licences, op8_warc, op9_rollups, op10_minhash, op11_alignment, op12_secrets, op13_whitening, pipeline)}
SQL: dict[str, str] = {}
