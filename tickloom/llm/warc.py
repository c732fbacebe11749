"""Deterministic sharded WARC archives: written, committed and read back.

Records are sorted by page and cut into shards at bounds that depend on the ids alone; within a
shard files roll by compressed size. Every record is a gzip member of its own with
regenerated headers and digests and no clock in it, so reruns give the same bytes. A task
writes under a temporary name and renames; the manifest, written last and renamed too, names the
files that count, so half-written or repeated attempts are never read.
"""

import base64
import gzip
import hashlib
import json
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settle, shared_folder

MIN_BYTES, FILE_BYTES, DATE = 0, 1 << 26, "2000-01-01T00:00:00Z"
#: Ids per shard that the bounds are taken from.
SAMPLE = 64
MANIFEST = "shard int, file string, records long, bytes long, sha256 string"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}/{digest}')}>"


def encode(page: int | None, url: str | None, payload: bytes, refers: int | None) -> bytes:
    """One gzip member: a response with its payload, or a revisit that names the response."""
    digest = base32_sha1(payload)
    target = "".join(c for c in url or "" if c.isprintable())
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http + (payload if refers is None else b"")
    head = [("WARC-Type", "response" if refers is None else "revisit"), ("WARC-Record-ID", record_id(page, digest)),
            ("WARC-Date", DATE), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}"),
            ("WARC-Block-Digest", f"sha1:{base32_sha1(body)}"), ("Content-Type", "application/http; msgtype=response")]
    if refers is not None:
        head += [("WARC-Refers-To", record_id(refers, digest)), ("X-Refers-To-Page", str(refers)),
                 ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    if page is not None:
        head.append(("X-Page", str(page)))
    head += [("X-Payload-Length", str(len(payload))), ("Content-Length", str(len(body)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return gzip.compress(text.encode() + body + b"\r\n\r\n", 6, mtime=0)


def decode(stream):
    """(headers, payload) of each record of an archive; block and payload digests are checked."""
    data = b""
    inflate = zlib.decompressobj(31)
    out = bytearray()
    while True:
        data = data or stream.read(1 << 20)
        if not data:
            break
        out += inflate.decompress(data)
        data = inflate.unused_data
        if inflate.eof:
            yield _parse(bytes(out))
            inflate, out = zlib.decompressobj(31), bytearray()
    if out:
        raise ValueError("the archive ends within a record")


def _parse(record: bytes):
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    if "sha1:" + base32_sha1(block) != fields["WARC-Block-Digest"]:
        raise ValueError(f"block digest of {fields['WARC-Record-ID']}")
    payload = block.partition(b"\r\n\r\n")[2]
    if fields["WARC-Type"] == "response" and "sha1:" + base32_sha1(payload) != fields["WARC-Payload-Digest"]:
        raise ValueError(f"payload digest of {fields['WARC-Record-ID']}")
    return fields, payload


def _put(store: fs.FileSystem, path: str, data: bytes) -> None:
    with store.open_output_stream(path) as f:
        f.write(data)


def _writer(uri: str, file_bytes: int):
    def run(batches):
        store, folder = fs.FileSystem.from_uri(uri)
        attempt = TaskContext.get().taskAttemptId()
        state = {"shard": None, "file": 0, "out": None}
        done = []

        def close():
            if state["out"] is not None:
                state["out"].close()
                name = f"shard-{state['shard']:05d}-{state['file']:05d}.warc.gz"
                store.move(state["temp"], f"{folder}/{name}")
                done.append((state["shard"], name, state["records"], state["bytes"], state["sha"].hexdigest()))
                state["out"] = None
                state["file"] += 1

        mark = None
        for batch in batches:
            for r in batch.to_pylist():
                if r["mark"] == 0:
                    mark = (r["page"], r["digest"], r["refers"])
                    continue
                if r["shard"] != state["shard"]:
                    close()
                    state |= {"shard": r["shard"], "file": 0}
                if state["out"] is None:
                    temp = f"{folder}/_temporary/{r['shard']:05d}-{state['file']:05d}.{attempt}"
                    state |= {"temp": temp, "out": store.open_output_stream(temp, compression=None), "records": 0, "bytes": 0, "sha": hashlib.sha256()}
                refers = mark[2] if mark is not None and mark[:2] == (r["page"], r["digest"]) else None
                member = encode(r["page"], r["url"], r["payload"], refers)
                state["out"].write(member)
                state["sha"].update(member)
                state["records"] += 1
                state["bytes"] += len(member)
                if state["bytes"] >= file_bytes:
                    close()
        close()
        columns = list(zip(*done, strict=True)) if done else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(
            columns, (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)],
            names=["shard", "file", "records", "bytes", "sha256"])
    return run


def shard_bounds(rows: DataFrame, shards: int) -> list[int]:
    """Smallest ids of all shards but the first, from the ids with the smallest hashes."""
    ids = sorted(r[0] for r in rows.where("page is not null").select("page").distinct()
                 .orderBy(F.xxhash64("page"), "page").limit(SAMPLE * shards).collect())
    return sorted({ids[len(ids) * i // shards] for i in range(1, shards)}) if ids else []


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html",
                   min_bytes: int = MIN_BYTES, file_bytes: int = FILE_BYTES, shards: int | None = None) -> DataFrame:
    """Write all pages to archives in ``folder`` (a URI all executors reach) and return the
    manifest: shard, file, records, bytes, sha256.

    A null html is an empty payload, a null url an empty target. Of records with equal
    payloads of ``min_bytes`` or more, those with the smallest page_id are responses and the
    others revisit it; a page repeated with one payload is alike in both rows. Rows with a null
    page_id are responses. Further columns are not read."""
    spark = pages.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = pages.select(F.col(key).cast("long").alias("page"), F.col(url).cast("string").alias("url"),
                        F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    bounds = shard_bounds(rows, shards)
    shard = F.coalesce(F.size(F.filter(F.lit(bounds).cast("array<bigint>"), lambda b: b <= F.col("page"))), F.lit(0))
    known = rows.where(F.col("page").isNotNull() & (F.octet_length("payload") >= min_bytes)).select("page", "digest")
    first = known.groupBy("digest").agg(F.min("page").alias("refers"), F.count("*").alias("n")).where("n > 1")
    marks = (known.join(first.select("digest", "refers"), "digest").where("page <> refers").distinct()
             .select("page", "digest", "refers"))
    both = rows.select("page", "digest", F.lit(None).cast("long").alias("refers"), F.lit(1).alias("mark"), "url", "payload").unionByName(
        marks.select("page", "digest", "refers", F.lit(0).alias("mark"), F.lit("").alias("url"), F.lit(b"").alias("payload")))
    dealt = (both.withColumn("shard", shard.cast("int")).repartition(shards, "shard")
             .sortWithinPartitions("shard", "page", "digest", "mark", "url"))
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(f"{path}/_temporary", recursive=True)
    manifest = settle(dealt.mapInArrow(_writer(folder, file_bytes), MANIFEST))
    lines = "".join(json.dumps(r.asDict()) + "\n" for r in manifest.orderBy("file").collect())
    _put(store, f"{path}/_temporary/manifest", lines.encode())
    store.move(f"{path}/_temporary/manifest", f"{path}/manifest.jsonl")
    return manifest


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the files that the manifest in ``folder`` names. Sizes and digests of a file,
    of blocks and of payloads are checked; a wrong one fails."""
    store, path = fs.FileSystem.from_uri(folder)
    with store.open_input_stream(f"{path}/manifest.jsonl") as f:
        files = [json.loads(x) for x in f.read().decode().splitlines()]
    listed = spark.createDataFrame([(x["file"], x["records"]) for x in files], "file string, records long")

    def run(batches):
        store, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for file, records in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, seen = [], 0
                with store.open_input_stream(f"{path}/{file}", compression=None) as f:
                    for h, payload in decode(f):
                        seen += 1
                        page, refers = h.get("X-Page"), h.get("X-Refers-To-Page")
                        rows.append((int(page) if page else None, int(h["X-Payload-Length"]),
                                     h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"],
                                     int(refers) if refers else None, h["WARC-Target-URI"], payload))
                        if len(rows) == 500:
                            yield _records(rows)
                            rows = []
                if seen != records:
                    raise ValueError(f"{file} has {seen} records, the manifest {records}")
                if rows:
                    yield _records(rows)

    return listed.repartition(max(1, len(files))).mapInArrow(run, RECORDS)


def _records(rows: list) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                      names=[f.split()[0] for f in RECORDS.split(", ")])


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the cluster's shared one."""
    shared = shared_folder(spark)
    if shared is None:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{shared if '://' in shared else 'file://' + shared}/{name}-{uuid.uuid4().hex}"
