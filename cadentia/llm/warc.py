"""WARC archives of web pages, and one ordered index over them by external merging.

Writing: one record per page through Spark's text writer with the record separator as line separator, so
files are committed by Spark on whatever file system the shared folder is.  The first page with a payload
is a response; later ones are revisits that name it and hold only their HTTP headers.

Reading: each file is parsed by Content-Length, its entries are sorted by URL key and time, and so each
file is a sorted run.  Tasks own ranges of keys; a task spools its part of every run and merges the runs by
a loser tree, a block of each run in memory and FAN_IN runs at once; of more runs it makes longer ones first.
"""

from __future__ import annotations

import base64
import hashlib
import tempfile
from collections.abc import Iterator
from itertools import islice
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadentia.llm.common import shared_folder, written

RECORDS_PER_FILE = 1_000
#: Bytes of payload in a file at most, or one record.
FILE_BYTES = 256_000_000
BLOCK_ROWS = 256
FAN_IN = 64
#: Seconds from 2024-01-01 to the end of the year 9999; a larger page_id starts again.
SECONDS = 251_698_233_600
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
ENTRY = "url_key string, capture_ts string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long, length long"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums = [digest32(x.as_buffer().to_pybytes()) for x in batch.column("payload").cast(pa.large_binary())]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.string())], [*batch.schema.names, "digest"])


def write_warc(pages: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE, file_bytes: int = FILE_BYTES) -> None:
    """Archives of pages (page_id, url, html), a record per row.

    Null html is empty, a null url the empty URI; control characters of a URL are percent-encoded.  Equal
    payloads: the least page_id is the response; rows that repeat it are responses too (one capture
    written twice), and null page_ids are revisits if another page has the payload.  The capture time is
    the page_id (modulo SECONDS; null: 0) in seconds from 2024-01-01.

    A file has records_per_file records at most, and file_bytes of payload or one record.  So that a long page decides for none but
    those of its size, payloads longer than file_bytes / records_per_file are written apart, in folders by size (each twice that
    of the one before): a task writes one file more than its bytes ask, for each size that it has."""
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"))
    content = F.sha2("payload", 256)
    firsts = rows.select("page_id", content.alias("content")).groupBy("content").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    firsts = written(firsts, "warc-firsts")
    usual = max(1, file_bytes // records_per_file)
    size = F.ceil(F.log2(F.greatest(F.octet_length("payload") / usual, F.lit(1.0)))).cast("int")
    sizes = sorted(r.size for r in rows.groupBy(size.alias("size")).count().collect())
    marked = rows.withColumn("content", content).join(firsts, "content", "left").drop("content")
    for k in sizes or [0]:
        own = marked if len(sizes) < 2 else marked.filter(size == k)
        _write(own, path if k == 0 else f"{path}/long-{k}", max(1, min(records_per_file, file_bytes // (usual * 2**k))))


def _write(marked: DataFrame, path: str, records: int) -> None:
    schema = T.StructType([*marked.schema, T.StructField("digest", T.StringType())])
    summed = marked.mapInArrow(_digests, schema)
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    name = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))
    n = F.octet_length("payload")
    head = F.concat(F.lit(HTTP), n.cast("string"), F.lit("\r\n\r\n"))
    block = F.when(again, head).otherwise(F.concat(head, F.col("payload")))
    uri = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A"), "\t", "%09")
    when = F.date_format(F.timestamp_seconds(F.lit(1_704_067_200) + F.pmod(F.coalesce(F.col("page_id"), F.lit(0)), F.lit(SECONDS))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), name),
        F.concat(F.lit("WARC-Date: "), when),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(again, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("first").cast("string"), F.lit(">"))),
        F.when(again, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    record = F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), block)
    summed.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records).text(path)


def url_key(url: str) -> str:
    """Host labels from the right, then path and query; lower case, without scheme, port, fragment or www.  A text that is
    no URL counts as a path without a host."""
    try:
        parts = urlsplit(url if "//" in url else f"//{url}")
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return f"){url}".lower()
    return f"{','.join(reversed(host.split('.')))}){parts.path or '/'}{'?' + parts.query if parts.query else ''}".lower()


def _page(name: str) -> int | None:
    number = name.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, length, headers and block of each record of an archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at) + 4
        version, *lines = data[at : end - 4].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
        stop = end + int(headers["Content-Length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"record at {at} doesn't end where it says")
        yield at, stop + 4 - at, headers, data[end:stop]
        at = stop + 4


def read_runs(spark, path: str) -> DataFrame:
    """Index entries of the archives, read back from the files' bytes; each file's in order of URL key,
    time and page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, data in zip(batch["path"], batch["content"], strict=True):
                rows = []
                for offset, length, h, block in records(data):
                    http, _, body = block.partition(b"\r\n\r\n")
                    again = h["WARC-Type"] == "revisit"
                    size = int(http.rpartition(b"Content-Length: ")[2]) if again else len(body)
                    digest = h["WARC-Payload-Digest"].removeprefix("sha1:") if again else digest32(body)
                    if not again and digest != h["WARC-Payload-Digest"].removeprefix("sha1:"):
                        raise ValueError(f"{file}: the payload at {offset} isn't what was written")
                    url = h["WARC-Target-URI"]
                    rows.append((url_key(url), h["WARC-Date"], _page(h["WARC-Record-ID"]), url, size, digest, h["WARC-Type"], _page(h["WARC-Refers-To"]) if again else None, file.rpartition("/")[2], offset, length))
                rows.sort(key=lambda r: (r[0], r[1], -1 if r[2] is None else r[2]))
                out = pd.DataFrame(rows, columns=[c.split()[0] for c in ENTRY.split(", ")])
                yield out.astype({"page_id": "Int64", "refers_to": "Int64"})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(run, ENTRY)


class LoserTree:
    """Merges sorted iterators: each inner node keeps the loser of its match, so a step replays one path."""

    def __init__(self, sources: list[Iterator[tuple]]):
        self.sources, self.k = sources, max(1, len(sources))
        self.heads = [next(s, None) for s in sources] or [None]
        self.losers = [0] * self.k
        self.winner = self._play(1) if self.k > 1 else 0

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def _play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        winner, self.losers[node] = (a, b) if self._less(a, b) else (b, a)
        return winner

    def __iter__(self) -> Iterator[tuple]:
        while (head := self.heads[self.winner]) is not None:
            yield head
            at = self.winner
            self.heads[at] = next(self.sources[at], None)
            node = (at + self.k) // 2
            while node:
                if self._less(self.losers[node], at):
                    at, self.losers[node] = self.losers[node], at
                node //= 2
            self.winner = at


def merge_runs(runs: DataFrame, block_rows: int = BLOCK_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """The entries of all runs in order of URL key, time and page: partition after partition of the result.

    Ranges are cut by the whole key, so one URL captured very often is shared by many tasks."""
    names = runs.columns
    schema = runs.schema

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryFile() as spool:
            runs_at: dict[str, list[tuple[int, int]]] = {}
            arrow = None

            def put(block: pa.RecordBatch) -> tuple[int, int]:
                raw, at = block.serialize(), spool.seek(0, 2)
                spool.write(raw)
                return at, raw.size

            for batch in batches:
                arrow = batch.schema
                files = batch.column("file").to_pylist()
                low = 0
                for high in range(1, len(files) + 1):
                    if high == len(files) or files[high] != files[low] or high - low == block_rows:
                        runs_at.setdefault(files[low], []).append(put(batch.slice(low, high - low)))
                        low = high

            def rows(blocks):
                for at, size in blocks:
                    spool.seek(at)
                    block = pa.ipc.read_record_batch(pa.py_buffer(spool.read(size)), arrow).to_pydict()
                    columns = [block[c] for c in names]
                    for row in zip(*columns, strict=True):
                        yield (row[0], row[1], -1 if row[2] is None else row[2], row[8], row[9], row)

            def merged(blocks) -> Iterator[pa.RecordBatch]:
                tree = iter(LoserTree([rows(b) for b in blocks]))
                while out := [row[-1] for row in islice(tree, block_rows)]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), arrow.types, strict=True)], names)

            sorted_runs = list(runs_at.values())
            while len(sorted_runs) > fan_in:
                sorted_runs = [[put(b) for b in merged(sorted_runs[k : k + fan_in])] for k in range(0, len(sorted_runs), fan_in)]
            if sorted_runs:
                yield from merged(sorted_runs)

    ranged = runs.repartitionByRange("url_key", "capture_ts", "page_id", "file", "offset")
    return ranged.sortWithinPartitions("file", "url_key", "capture_ts", "page_id", "offset").mapInArrow(merge, schema)


def archive(pages: DataFrame, path: str | None = None, records_per_file: int = RECORDS_PER_FILE) -> DataFrame:
    """Writes the pages' archives below `path` (default: a new shared folder) and returns their merged index.

    An empty table gives an empty index.  Extra columns of pages are not read."""
    spark = pages.sparkSession
    path = path or shared_folder(spark, "warc")
    write_warc(pages, path, records_per_file)
    return merge_runs(written(read_runs(spark, path), "warc-runs"))


def op6_warc(spark, sf_dir: str) -> DataFrame:
    return archive(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(x, (1 + 5 * (i // 4))::INT, 5))::BIGINT) >> (5 * (3 - i % 4))::INT) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM p
"""
