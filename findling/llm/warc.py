"""Deterministic sharded WARC writer, and the reader of its archives.

Records are range-sorted by page id. Exact running sums of payload bytes over that order cut the ids into
shards of about ``SHARD_BYTES`` (more for very large tables: at most ``MOST_SHARDS``), so shards depend on the table alone,
not on partitions or sampling. A page id whose rows alone fill several shards is dealt to them by payload digest. One task
writes a shard, and each task gets as many shards as any other: it sorts its records, makes headers and digests anew,
compresses each record as a gzip member of its own and rolls to the next file once the compressed size passes
``ROLL_BYTES``. A file is written under a temporary name and moved to its own when whole; the manifest (a table in the same folder, committed
last) names each file with its size, records and digest. Readers open only files of the manifest, so what
a lost or repeated task left behind is never read.

Of pages with equal payloads of at least ``min_bytes`` bytes, the one with the largest page id is a response
and the others are revisits of it (headers only). Null html is an empty payload, a null url an empty target.
Of repeated rows with the largest page id one is the response, the others revisit it. Rows with a null
page id sort first. Extra columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import MOST_TASKS, Workspace, dealt, ordered

SHARD_BYTES = 32 << 20
#: Bounds what every task gets of the shards' first ids (8 bytes each).
MOST_SHARDS = 1 << 20
ROLL_BYTES = 8 << 20
LEVEL = 6
#: Revisit rows of a payload beyond which the search for its response is dealt to this many tasks.
HOT_PAYLOAD, SALTS = 10_000, 64
#: What stands for a null id in the order of ids.
NO_ID = -(1 << 63)
DATE = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page_of(name: str) -> int | None:
    part = name.strip("<>").rpartition(":")[2]
    return None if part == "none" else int(part)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, digest: str) -> bytes:
    """One WARC record; ``digest`` is the base32 SHA-1 of the full payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    target = "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode(errors="surrogatepass")) for c in url or "")
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if revisit:
        fields[3:3] = [("WARC-Refers-To", record_id(refers_to)), ("WARC-Profile", REVISIT_PROFILE)]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


class _File:
    """One archive under a temporary name until it is whole."""

    def __init__(self, fs: pafs.FileSystem, base: str, name: str):
        self.fs, self.path, self.name = fs, f"{base}/{name}", name
        self.scratch = f"{base}/.{name}.{uuid.uuid4().hex}"
        self.out = fs.open_output_stream(self.scratch, compression=None)
        self.size = self.records = 0
        self.sha = hashlib.sha256()
        self.first = self.last = None

    def add(self, page_id: int | None, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.size += len(data)
        self.first = page_id if not self.records else self.first
        self.last, self.records = page_id, self.records + 1

    def close(self) -> tuple:
        self.out.close()
        self.fs.move(self.scratch, self.path)
        return self.name, self.records, self.size, self.sha.hexdigest(), self.first, self.last


MANIFEST = "file string, records long, bytes long, sha256 string, first_id long, last_id long"


def _write(folder: str, roll_bytes: int, sent):
    def run(pages, plans):
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        shard = int(np.flatnonzero(sent.value[1] == plans.column("shard")[0].as_py())[0]) if plans.num_rows else 0
        # Both sides have one row for each page; equal ids are paired in the order of their digests.
        plan = sorted(zip(*(plans.column(c).to_pylist() for c in ("page_id", "digest", "revisit", "refers_to")), strict=True), key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2] is True))
        html, ids, urls = pages.column("html"), pages.column("page_id").to_pylist(), pages.column("url").to_pylist()
        digests = [hashlib.sha1((html[i].as_py() or "").encode()).hexdigest() for i in range(len(ids))]
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, digests[i], urls[i] or ""))
        done, file = [], None
        for i, (_, digest, revisit, refers_to) in zip(order, plan, strict=True):
            if digest != digests[i]:
                raise ValueError(f"the digest of page {ids[i]} changed between two reads")
            if file is None:
                file = _File(fs, base, f"shard-{shard:08d}-{len(done):04d}.warc.gz")
            payload = (html[i].as_py() or "").encode()
            data = record(ids[i], urls[i], payload, refers_to, revisit, base32_sha1(payload))
            file.add(ids[i], gzip.compress(data, LEVEL, mtime=0))
            if file.size >= roll_bytes:
                done.append(file.close())
                file = None
        if file is not None:
            done.append(file.close())
        columns = list(zip(*done, strict=True)) if done else [[]] * 6
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("file", "records", "bytes", "sha256", "first_id", "last_id"), columns, kinds, strict=True)})

    return run


def _plan(pages: DataFrame, space: Workspace, min_bytes: int) -> DataFrame:
    """Rows ``(page_id, digest, n, revisit, refers_to)`` without payloads."""
    rows = pages.select("page_id", F.sha1("html").alias("digest"), F.octet_length("html").cast("long").alias("n"))
    rows = space.save(rows.withColumn("row", F.monotonically_increasing_id()), "digests")
    best = F.max(F.struct(F.col("page_id"), F.col("row")))
    many = rows.where(F.col("n") >= min_bytes).groupBy("digest").agg(best.alias("best"), F.count("*").alias("copies")).where("copies > 1")
    many = space.save(many.select("digest", F.col("best.page_id").alias("target"), F.col("best.row").alias("target_row"), "copies"), "copies")
    # A payload that very many pages share is looked up by many tasks.
    salted = many.withColumn("salt", F.explode(F.when(F.col("copies") > HOT_PAYLOAD, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(-1)))))
    hot = many.where(f"copies > {HOT_PAYLOAD}").select(F.col("digest").alias("hot"))
    marked = rows.join(hot, rows.digest == hot.hot, "left").withColumn("salt", F.when(F.col("hot").isNull(), -1).otherwise(F.pmod(F.col("row"), F.lit(SALTS)).cast("int")))
    found = marked.join(salted, ["digest", "salt"], "left")
    revisit = F.coalesce(F.col("target_row") != F.col("row"), F.lit(False))
    return space.save(found.select("page_id", "digest", "n", revisit.alias("revisit"), F.when(revisit, F.col("target")).alias("refers_to")), "plan")


def _keys(spark: SparkSession, shards: int) -> np.ndarray:
    """For each shard a number that Spark's hash deals to a task of its own, or to the task of as many others as any."""
    tasks = min(MOST_TASKS, shards)
    each = -(-shards // tasks)
    slot = F.expr(f"pmod(hash(id), {tasks})")
    rank = F.row_number().over(Window.partitionBy("slot").orderBy("id")) - 1
    found = spark.range(tasks * (2 * each + 40)).withColumn("slot", slot).withColumn("rank", rank).where(F.col("rank") < each)
    out = np.full(tasks * each, -1, np.int64)
    for r in found.toLocalIterator():  # about one row a shard
        out[r["rank"] * tasks + r["slot"]] = r["id"]
    if (out[:shards] < 0).any():
        raise ValueError("too few numbers for the shards")
    return out[:shards]


def write_archives(pages: DataFrame, space: Workspace, min_bytes: int = 0, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> tuple[str, DataFrame]:
    """Writes ``pages (page_id, url, html)``: the archives' folder and the committed manifest."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    plan = _plan(pages, space, min_bytes)
    placed = space.save(ordered(plan, "page_id", "n"), "placed")
    total = placed.agg(F.max(F.col("before") + F.col("n"))).first()[0] or 0
    shard_bytes = max(shard_bytes, -(-total // MOST_SHARDS))
    cuts = placed.groupBy(F.floor(F.col("before") / shard_bytes).alias("shard")).agg(F.min(F.coalesce("page_id", F.lit(NO_ID))).alias("first")).where("shard > 0")
    starts = np.array(sorted(row["first"] for row in cuts.select("first").toLocalIterator()), np.int64)  # one id a shard, so MOST_SHARDS at most
    keys = _keys(pages.sparkSession, len(starts) + 1)
    sent = pages.sparkSession.sparkContext.broadcast((starts, keys))

    def shard_of(ids: pd.Series, digests: pd.Series) -> pd.Series:
        first, key = sent.value
        lo, hi = (np.searchsorted(first, ids.to_numpy(np.int64), side) for side in ("left", "right"))
        wide = hi > lo + 1  # the id begins several shards
        salt = digests.str.slice(0, 8).map(lambda x: int(x, 16)).to_numpy(np.int64)
        return pd.Series(key[np.where(wide, lo + salt % (hi - lo + 1), hi)])

    key = F.coalesce("page_id", F.lit(NO_ID))
    folder = f"{space.path}/archives"
    shard = F.pandas_udf(shard_of, "long")
    tasks = min(MOST_TASKS, len(keys))
    left = pages.withColumn("shard", shard(key, F.sha1("html"))).repartition(tasks, "shard").groupBy("shard")
    right = plan.withColumn("shard", shard(key, "digest")).repartition(tasks, "shard").groupBy("shard")
    written = left.cogroup(right).applyInArrow(_write(folder, roll_bytes, sent), MANIFEST)
    return folder, space.save(written, "manifest")


def parse(data: bytes) -> list[dict]:
    """The records of an archive: header fields by lower-case name, the HTTP head and the payload."""
    out = []
    while data:
        inflate = zlib.decompressobj(31)
        member = inflate.decompress(data) + inflate.flush()
        data = inflate.unused_data
        stream = io.BytesIO(member)
        if stream.readline().rstrip(b"\r\n") != b"WARC/1.1":
            raise ValueError("not a WARC/1.1 record")
        fields = {}
        while line := stream.readline().rstrip(b"\r\n"):
            name, _, value = line.partition(b":")
            fields[name.strip().lower().decode()] = value.strip().decode()
        block = stream.read(int(fields["content-length"]))
        if stream.read() != b"\r\n\r\n":
            raise ValueError("a record doesn't end where its length says")
        if fields["warc-block-digest"] != f"sha1:{base32_sha1(block)}":
            raise ValueError("a block digest doesn't fit")
        head, _, payload = block.partition(b"\r\n\r\n")
        out.append({"fields": fields, "head": head, "payload": payload})
    return out


def _read(folder: str):
    def run(batches):
        fs, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{base}/{name}", compression=None) as f:
                    found = parse(f.read())
                rows = []
                for x in found:
                    fields, revisit = x["fields"], x["fields"]["warc-type"] == "revisit"
                    length = int(next(v for k, v in (h.split(b":", 1) for h in x["head"].split(b"\r\n")[1:]) if k.lower() == b"content-length"))
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    if not revisit and (digest != base32_sha1(x["payload"]) or length != len(x["payload"])):
                        raise ValueError(f"the payload of {fields['warc-record-id']} doesn't fit its digest")
                    page = _page_of(fields["warc-record-id"])
                    rows.append((page, length, digest, fields["warc-type"], _page_of(fields["warc-refers-to"]) if revisit else None, None if revisit else x["payload"].decode()))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "html")
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], list(names))

    return run


def read_archives(folder: str, manifest: DataFrame) -> DataFrame:
    """The records of all files of a manifest, with digests and lengths checked; ``html`` is null for revisits."""
    files = dealt(manifest.select("file"))
    return files.mapInArrow(_read(folder), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, html string")


def warc_report(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes and reads back; one row for each row of ``pages``."""
    space = Workspace(pages.sparkSession, "warc")
    folder, manifest = write_archives(pages, space, min_bytes)
    return read_archives(folder, manifest).drop("html")
