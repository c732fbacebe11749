"""Token counts by source, language and tokenizer version, kept up to date by signed batches.

A batch of changes (sign +1 for a document's count that comes, -1 for one that goes; a
revised count is one of each) is summed first; only the sums are written, under a folder named
for the batch, and then a commit mark. Totals add up the committed batches, so a batch that is
sent again, by a retry or twice, changes nothing. ``compact`` folds batches into one.
"""

import base64
import json

import pyarrow as pa
import tiktoken
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import SPACED, flat, slices, words

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how this vocabulary's tokenizer cuts a text before merging bytes.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KEYS = ("source", "lang", "version")


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, source, lang, n_tokens (byte-level BPE of the vocabulary file), n_words (stretches
    without white space) of each row. Null and empty texts have none. The file is read on the
    driver and sent to the executors; it has about 50,000 entries."""
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    sent = spark.sparkContext.broadcast(ranks)

    def run(batches):
        encoder = tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=sent.value, special_tokens={})
        for batch in batches:
            tokens = [len(encoder.encode_ordinary(t)) if t else 0 for t in batch.column("text").to_pylist()]
            data, offsets = flat(batch.column("text"))
            n_words = []
            for a, b in slices(offsets):
                at = words(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], SPACED).offsets
                n_words += (at[1:] - at[:-1]).tolist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), batch.column("lang"),
                                              pa.array(tokens, pa.int64()), pa.array(n_words, pa.int64())],
                                             names=["doc_id", "source", "lang", "n_tokens", "n_words"])

    return (docs.select(F.col(key).cast("long").alias("doc_id"), F.col("source").cast("string"), F.col("lang").cast("string"),
                        F.col(text).cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, source string, lang string, n_tokens long, n_words long"))


def changes(counts: DataFrame, version: str, count: str, sign: int) -> DataFrame:
    """Signed rows of a batch from (source, lang, count)."""
    return counts.select("source", "lang", F.lit(version).alias("version"),
                         F.col(count).cast("long").alias("tokens"), F.lit(sign).alias("sign"))


class Rollups:
    """Totals in ``folder``, a URI that all executors reach."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.store, self.path = fs.FileSystem.from_uri(folder)
        self.store.create_dir(f"{self.path}/commits", recursive=True)

    def committed(self) -> dict[str, str]:
        """Folder of the sums of each committed batch; a compaction stands for its batches."""
        marks = {}
        for f in self.store.get_file_info(fs.FileSelector(f"{self.path}/commits")):
            if f.is_file and f.base_name.endswith(".json"):
                with self.store.open_input_stream(f.path) as stream:
                    mark = json.loads(stream.read())
                marks[mark["batch"]] = mark
        gone = {b for m in marks.values() for b in m.get("covers", [])}
        return {b: m["sums"] for b, m in marks.items() if b not in gone}

    def known(self) -> set[str]:
        return {f.base_name.removesuffix(".json") for f in self.store.get_file_info(
            fs.FileSelector(f"{self.path}/commits")) if f.base_name.endswith(".json")}

    def commit(self, batch: str, rows: DataFrame) -> bool:
        """Apply a batch once; False if it was applied before. Null sources and languages are
        groups of their own, a null count counts as no tokens; further columns are not read."""
        if not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError("a batch is named by letters, digits, - and _")
        if batch in self.known():
            if self._mark(batch)["covers"]:
                raise ValueError(f"{batch} is the name of a compaction")
            return False
        sums = rows.groupBy(*KEYS).agg(F.sum(F.col("sign").cast("long")).alias("n_docs"),
                                       F.sum(F.col("sign") * F.coalesce("tokens", F.lit(0))).alias("n_tokens"))
        self._write(batch, sums, [])
        return True

    def _write(self, batch: str, sums: DataFrame, covers: list[str]) -> None:
        sums.write.mode("overwrite").parquet(f"{self.folder}/sums/{batch}")
        mark = f"{self.path}/commits/{batch}"
        with self.store.open_output_stream(f"{mark}.tmp") as f:
            f.write(json.dumps({"batch": batch, "sums": f"{self.folder}/sums/{batch}", "covers": covers}).encode())
        self.store.move(f"{mark}.tmp", f"{mark}.json")

    def totals(self) -> DataFrame:
        """source, lang, version, n_docs, n_tokens; groups that came to nothing are left out."""
        schema = "source string, lang string, version string, n_docs long, n_tokens long"
        parts = sorted(self.committed().values())
        sums = self.spark.read.schema(schema).parquet(*parts) if parts else self.spark.createDataFrame([], schema)
        return (sums.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
                .where("n_docs <> 0 or n_tokens <> 0"))

    def _mark(self, batch: str) -> dict:
        with self.store.open_input_stream(f"{self.path}/commits/{batch}.json") as stream:
            return json.loads(stream.read())

    def compact(self, batch: str) -> None:
        """Fold the committed batches into one of a new name; their names stay known. A name that
        is known is refused: its sums would be replaced, and it would stand for itself."""
        if batch in self.known():
            raise ValueError(f"{batch} is committed already")
        self._write(batch, self.totals(), sorted(self.committed()))
