"""Operator 2: WARC archives with a two-level capture index.

Archives: one gzip member for each record, a file for each task, names of their
own for each attempt, so a repeated task leaves no trace in the index. Records
with equal payloads of at least MIN_REVISIT bytes: the largest page_id is
written as a response, the others as revisits that refer to it.

Index: captures sorted by reversed-host URL key (and page_id) over range
partitions. Each partition writes a shard: compressed blocks of BLOCK_LINES
lines, and a sparse directory with each block's first key and place. A lookup
finds the shard, then the block, by binary search over first keys, reads and
searches that block, and reads the record's range from its archive.

Defined results: null html is an empty payload; null and malformed URLs are
their own keys; rows that repeat page_id and url are separate captures with one
key, all found; a null page_id sorts before others (a record without page_id is
referred to by null); of rows that repeat page_id, url and payload each is a
response if one is; an empty table gives no archive and an empty result. Other
columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import near_ids, over_batches, prepare, shared_path, table

MIN_REVISIT, BLOCK_LINES = 1000, 512
#: Keys that the copies of one payload are spread over.
SALTS = 32
#: Fixed value: pages carry no time of capture.
DATE = "1970-01-01T00:00:00Z"
_ID = "urn:page:"
_FIRST = -(1 << 63)
CAPTURES = "key string, page_id long, file string, start long, length long"
FOUND = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def url_key(url: str | None) -> str:
    """Host labels reversed, then path and query: net,example,www)/a?b."""
    try:
        parts = urlsplit((url or "").strip())
        host = (parts.hostname or "").lower()
        port = f":{parts.port}" if parts.port not in (None, 80, 443) else ""
    except ValueError:
        return url or ""
    if not host:
        return url or ""
    return ",".join(reversed(host.split("."))) + port + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def _open(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path)


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None) -> bytes:
    """One WARC record, compressed on its own."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{_ID}{page_id}>"), ("WARC-Target-URI", (url or "").replace("\r", "%0D").replace("\n", "%0A")), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Payload-Length", str(len(payload)))]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if kind == "revisit":
        head += [("WARC-Refers-To", f"<{_ID}{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        block = http
    else:
        block = http + payload
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    squeeze = zlib.compressobj(4, wbits=31)
    return squeeze.compress(b"WARC/1.1\r\n" + lines.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def _id_of(header: str) -> int | None:
    text = header.strip("<>").removeprefix(_ID)
    return None if text == "None" else int(text)


def parse(raw: bytes) -> dict:
    """A record's fields; ValueError if it is damaged."""
    data = zlib.decompress(raw, wbits=31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    h = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(h["Content-Length"])]
    digest = base64.b32decode(h["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    size, payload = int(h["WARC-Payload-Length"]), None
    if h["WARC-Type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"payload of {h['WARC-Record-ID']} is damaged")
    return {"page_id": _id_of(h["WARC-Record-ID"]), "url": h["WARC-Target-URI"], "payload": payload, "payload_bytes": size, "payload_digest": digest, "record_type": h["WARC-Type"], "refers_to": _id_of(h["WARC-Refers-To"]) if "WARC-Refers-To" in h else None}


def with_record_types(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, record_type, refers_to."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    p = p.withColumn("sha", F.sha1("payload")).withColumn("x", F.xxhash64("payload")).withColumn("n", F.octet_length("payload")).withColumn("u", F.xxhash64("url"))
    same = p.where(F.col("n") >= MIN_REVISIT).groupBy("sha", "x", "n").agg(F.max(F.struct("page_id", "u")).alias("top"), F.count("*").alias("copies")).where("copies > 1")
    same = table(same.select("sha", "x", "n", F.col("top.page_id").alias("to"), F.col("top.u").alias("tu"), F.lit(True).alias("again")), "equal_payloads")
    # only pages whose payload may stand in the table meet it by key; copies of one payload are spread over SALTS
    # keys, as the table's rows are small and payloads are not
    salted = same.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    known = near_ids(p, same, on="sha").withColumn("salt", F.pmod(F.xxhash64("page_id", "u"), F.lit(SALTS)).cast("int")).join(salted, ["sha", "x", "n", "salt"], "left")
    revisit = F.coalesce(F.col("again"), F.lit(False)) & ~(F.col("page_id").eqNullSafe(F.col("to")) & F.col("u").eqNullSafe(F.col("tu")))
    known = known.select("page_id", "url", "payload", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("to")).alias("refers_to"))
    alone = near_ids(p, same, inside=False, on="sha").select("page_id", "url", "payload", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    return known.unionByName(alone)


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write the archives; the captures, as a written table."""
    prepare(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, at = None, "", 0
        try:
            for batch in batches:
                rows = []
                for page_id, url, payload, kind, to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None:
                        path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                        fs, local = _open(path)
                        fs.create_dir(local.rpartition("/")[0], recursive=True)
                        out = fs.open_output_stream(local, compression=None)
                    raw = record(page_id, url, payload, kind, to)
                    out.write(raw)
                    rows.append((url_key(url), page_id, path, at, len(raw)))
                    at += len(raw)
                if rows:
                    cols = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["key", "page_id", "file", "start", "length"])
        finally:
            if out is not None:
                out.close()

    return table(with_record_types(pages).mapInArrow(run, CAPTURES), "captures")


def _place(key: str, page_id: int | None) -> tuple[str, int]:
    return key, _FIRST if page_id is None else page_id


def write_index(captures: DataFrame, folder: str) -> list[dict]:
    """Write shards and directories; where each shard begins, one entry for each range partition."""
    n = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, first, directory, lines = None, 0, None, [], []
        name = f"{folder}/{uuid.uuid4().hex}"

        def block() -> None:
            nonlocal at
            raw = zlib.compress("\n".join(json.dumps(x) for x in lines).encode("utf-8", "surrogatepass"), 4)
            directory.append([*_place(*lines[0][:2]), at, len(raw)])
            out.write(raw)
            at += len(raw)
            lines.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    fs, local = _open(name + ".blocks")
                    fs.create_dir(local.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(local, compression=None)
                    first = _place(row[0], row[1])
                lines.append(row)
                if len(lines) == BLOCK_LINES:
                    block()
        if out is None:
            return
        if lines:
            block()
        out.close()
        fs, local = _open(name + ".directory")
        with fs.open_output_stream(local, compression=None) as f:
            f.write(json.dumps(directory).encode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_pydict({"key": [first[0]], "page_id": pa.array([first[1]], pa.int64()), "name": [name]})

    dealt = captures.repartitionByRange(n, "key", "page_id").sortWithinPartitions("key", "page_id")
    shards = dealt.mapInArrow(run, "key string, page_id long, name string").collect()  # a row for each partition
    return sorted((r.asDict() for r in shards), key=lambda r: (r["key"], r["page_id"]))


class Index:
    """Lookups in a written index; blocks and open archives are kept in bounded number."""

    def __init__(self, shards: list[dict]) -> None:
        self.shards = shards
        self.first = [(s["key"], s["page_id"]) for s in shards]
        self.directory = lru_cache(8)(self._directory)
        self.block = lru_cache(16)(self._block)
        self.file = lru_cache(64)(self._file)

    def _file(self, path: str):
        fs, local = _open(path)
        return fs.open_input_file(local)

    def _read(self, path: str, start: int, length: int) -> bytes:
        f = self.file(path)
        f.seek(start)
        return f.read(length)

    def _directory(self, shard: int) -> tuple[list[tuple[str, int]], list[tuple[int, int]]]:
        fs, local = _open(self.shards[shard]["name"] + ".directory")
        with fs.open_input_stream(local, compression=None) as f:
            entries = json.loads(f.read().decode("utf-8", "surrogatepass"))
        return [(k, p) for k, p, _, _ in entries], [(a, n) for _, _, a, n in entries]

    def _block(self, shard: int, number: int) -> tuple[list[tuple[str, int]], list[list]]:
        raw = self._read(self.shards[shard]["name"] + ".blocks", *self.directory(shard)[1][number])
        lines = [json.loads(x) for x in zlib.decompress(raw).decode("utf-8", "surrogatepass").split("\n")]
        return [_place(x[0], x[1]) for x in lines], lines

    def find(self, key: str, page_id: int | None) -> list[list]:
        """The captures of that key and page: (key, page_id, file, start, length)."""
        wanted, out = _place(key, page_id), []
        # the last shard and block that begin before the wanted place, and what follows as long as it matches
        shard = max(0, bisect.bisect_left(self.first, wanted) - 1)
        while shard < len(self.shards) and (self.first[shard] <= wanted):
            starts = self.directory(shard)[0]
            number = max(0, bisect.bisect_left(starts, wanted) - 1)
            while number < len(starts) and starts[number] <= wanted:
                places, lines = self.block(shard, number)
                at = bisect.bisect_left(places, wanted)
                while at < len(places) and places[at] == wanted:
                    out.append(lines[at])
                    at += 1
                number += 1
            shard += 1
        return out

    def fetch(self, entry: list) -> dict:
        return parse(self._read(entry[2], entry[3], entry[4]))


def read_back(wanted: DataFrame, shards: list[dict], with_payload: bool = True) -> DataFrame:
    """The records of all captures of the distinct (page_id, url) in wanted, by the index."""
    prepare(wanted.sparkSession)

    def keys(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([url_key(u) for u in batch.column(1).to_pylist()], pa.string())], names=["page_id", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(shards)
        kinds = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64())
        names = [x.split()[0] for x in FOUND.split(", ")]
        for batch in batches:
            entries = [e for page_id, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for e in index.find(key, page_id)]
            entries.sort(key=lambda e: (e[2], e[3]))
            for at in range(0, len(entries), 256):
                rows = [index.fetch(e) for e in entries[at : at + 256]]
                if not with_payload:
                    for r in rows:
                        r["payload"] = None
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in zip(names, kinds, strict=True)], names=names)

    n = int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # sorted like the index, so that a task reads few blocks and each of them once
    asked = over_batches(wanted.select(F.col("page_id").cast("long").alias("page_id"), "url"), keys, "page_id long, key string").dropDuplicates(["page_id", "key"])
    return asked.repartitionByRange(n, "key", "page_id").sortWithinPartitions("key", "page_id").mapInArrow(run, FOUND)


def archive(pages: DataFrame) -> list[dict]:
    """Write archives and index into the shared folder; the shards."""
    folder = shared_path(pages.sparkSession, "warc")
    return write_index(write_archives(pages, folder), folder)


def query(spark, sf_dir: str) -> DataFrame:
    import os

    pages = spark.read.parquet(os.path.join(sf_dir, "pages.parquet"))
    return read_back(pages, archive(pages), with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n FROM pages),
t AS (
  SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY h) END AS top FROM p)
SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN top IS NOT NULL AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN top IS NOT NULL AND page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM t
"""
