"""WARC archives of captures, and their index merged from locally sorted runs by a loser tree."""

from __future__ import annotations

import hashlib
import itertools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.batches import by_bytes
from graphloom.storage import broadcast_if_small, materialize, scratch_path

BROADCAST_ROWS = 200_000
ARCHIVE_BYTES = 64 << 20  # an archive holds no more than this, or one record
SMALL_BYTES = 64 << 10  # records up to this are written together, larger ones by powers of two
ROWS_PER_MERGE = 200_000  # narrow index rows that one task merges
MIN_REVISIT_BYTES = 100
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
EPOCH = 1_704_067_200  # capture times of tables without one: this plus the id, in seconds

INDEX = (
    "url_key string, capture_ts string, page_id bigint, payload_bytes bigint, payload_digest string, "
    "record_type string, refers_to bigint, run string, seq bigint, record_offset bigint, record_bytes bigint"
)


def url_key(url):
    """Sort key of a URL: host labels reversed, then path and query, in lower case ('' for null)."""
    host = F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))
    rest = F.coalesce(F.try_parse_url(url, F.lit("FILE")), F.lit(""))
    return F.lower(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write a WARC record per row. Of equal payloads of at least 100 bytes the smallest id is
    the response and the others are revisits without a body; smaller payloads are all responses.

    A null payload is empty; a null id is written as ``null`` and is a response unless an equal
    payload has an id; rows that repeat both id and payload of a response are responses too.
    Spark's text sink writes the archives, so failed tasks leave no part of one behind. Records are
    written by classes of size, so that a number of records bounds the bytes of an archive.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    # the record of a response at most: the URL comes twice, other headers are below a KiB
    size = F.octet_length(html) + 2 * F.octet_length(F.coalesce(F.col(url_col), F.lit(""))) + 1024
    rows = pages.select(
        size.alias("size"),
        F.col(id_col).cast("bigint").alias("id"), F.col(url_col).alias("url"), html.alias("html"),
        F.octet_length(html).cast("bigint").alias("n"), F.sha2(html, 256).alias("digest"),
    )
    firsts = materialize(
        rows.where(F.col("n") >= MIN_REVISIT_BYTES).select(F.unhex("digest").alias("d"), "id")
        .groupBy("d").agg(F.min("id").alias("first"), F.count("*").alias("c")).where("c > 1").drop("c"),
        "warc-firsts",
    )
    rows = rows.withColumn("d", F.unhex("digest")).join(broadcast_if_small(firsts, BROADCAST_ROWS), "d", "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    ident = F.coalesce(F.col("id").cast("string"), F.lit("null"))
    when = F.date_format(F.timestamp_seconds(F.lit(EPOCH) + F.coalesce("id", F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    line = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "%0A")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), ident, F.lit(">\r\nWARC-Date: "), when,
        F.lit("\r\nWARC-Target-URI: "), line,
        F.lit("\r\nX-URL-Key: "), F.regexp_replace(url_key(F.col("url")), r"[\r\n]", ""),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"),
        F.lit("\r\nX-Payload-Length: "), F.col("n").cast("string"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), F.col("first").cast("string"), F.lit(">"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        (F.when(revisit, 0).otherwise(F.col("n")) + len(HTTP)).cast("string"), F.lit("\r\n\r\n" + HTTP),
        F.when(revisit, "").otherwise(F.col("html")),
    )
    rows = rows.select("size", head.alias("value"))
    largest = pages.agg(F.max(size)).first()[0] or 0
    low = -1
    while low < max(largest, 1):  # sizes up to SMALL_BYTES, then up to twice as much each
        high = max(SMALL_BYTES, 2 * low)
        some = rows.where((F.col("size") > low) & (F.col("size") <= high)).select("value")
        most = max(1, ARCHIVE_BYTES // high)
        some.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", most).mode("append").text(path)
        low = high


def parse_archive(name: str, data: bytes):
    """Index rows of one archive in record order; the body length comes from Content-Length."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"{name}: no record at byte {at}")
        head = dict(x.split(": ", 1) for x in (y if ": " in y else y + " " for y in lines[1:]))
        size = int(head["Content-Length"])
        body = data[end + 4 : end + 4 + size]
        after = end + 4 + size + 4
        if len(body) < size or data[after - 4 : after] != b"\r\n\r\n":
            raise ValueError(f"{name}: record at byte {at} is cut off")
        payload = body[body.index(b"\r\n\r\n") + 4 :]
        digest, kind = head["WARC-Payload-Digest"].removeprefix("sha256:"), head["WARC-Type"]
        n = int(head["X-Payload-Length"])
        if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != n):
            raise ValueError(f"{name}: payload of the record at byte {at} does not match its digest")
        ident = head["WARC-Record-ID"][len("<urn:page:") : -1]
        to = head.get("WARC-Refers-To")
        yield (
            head["X-URL-Key"].strip(), head["WARC-Date"], None if ident == "null" else int(ident), n, digest, kind,
            int(to[len("<urn:page:") : -1]) if to else None, name, at, after - at,
        )
        at = after


def _order(row) -> tuple:
    return (row[0].encode(), row[1], row[2] is not None, row[2] or 0)


def _runs(batches):
    names = [x.split()[0] for x in INDEX.split(", ")]
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            run = sorted(parse_archive(path.rsplit("/", 1)[-1], bytes(content)), key=_order)
            yield pd.DataFrame([(*r[:8], i, *r[8:]) for i, r in enumerate(run)], columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})


class LoserTree:
    """Merges sorted iterators: inner nodes keep the loser of each match, so that replacing the
    winner replays one path of log2(k) matches."""

    def __init__(self, runs, key):
        self.runs, self.key = [iter(r) for r in runs], key
        self.k = max(1, len(self.runs))
        self.heads = [None] * self.k
        self.keys = [None] * self.k
        for i in range(len(self.runs)):
            self._pull(i)
        self.losers = [0] * self.k
        winners = [0] * self.k + list(range(self.k))
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._before(a, b) else (b, a)
        self.winner = winners[1] if self.k > 1 else 0

    def _pull(self, i):
        self.heads[i] = next(self.runs[i], None) if i < len(self.runs) else None
        self.keys[i] = None if self.heads[i] is None else self.key(self.heads[i])

    def _before(self, a, b) -> bool:
        x, y = self.keys[a], self.keys[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return x < y or (x == y and a < b)

    def __iter__(self):
        while self.heads[self.winner] is not None:
            w = self.winner
            yield self.heads[w]
            self._pull(w)
            node = (w + self.k) // 2
            while node:
                rival = self.losers[node]
                if self._before(rival, w):
                    self.losers[node], w = w, rival
                node //= 2
            self.winner = w


def _rows(run: pa.Table):
    """The rows of a run, made one small slice at a time; the run itself stays in columns."""
    for s in range(0, run.num_rows, 1024):
        yield from zip(*run.slice(s, 1024).to_pydict().values())


def _merge(batches):
    """Merge the runs of one key range; its rows come grouped by run, in the order of the run."""
    runs: dict[str, list] = {}
    for batch in batches:
        names = batch["run"].to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)] if len(names) else []
        for s, e in zip(edges[:-1], edges[1:]):
            runs.setdefault(names[s], []).append(batch.slice(s, e - s))
    if not runs:
        return
    schema = next(iter(runs.values()))[0].schema
    merged = iter(LoserTree([_rows(pa.Table.from_batches(r)) for r in runs.values()], _order))
    while out := list(itertools.islice(merged, 10_000)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def read_index(spark, path: str) -> DataFrame:
    """Capture histories of the archives in ``path``, globally ordered by URL key, time and id.

    Each archive gives a locally sorted run. Key ranges of all runs (cut by a sample on URL key,
    time, id and place, so that neither a URL with many captures nor equal rows are one range) are
    merged by a loser tree each. A range is about 200000 narrow rows (no payload); they are held in
    columns, and the tree draws them a slice at a time. A folder without records gives no rows.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    runs = materialize(by_bytes(files).mapInPandas(_runs, INDEX), "warc-runs")
    n = max(1, math.ceil(runs.count() / ROWS_PER_MERGE))
    parts = max(n, min(runs.rdd.getNumPartitions(), 64))
    ranged = runs.repartitionByRange(parts, "url_key", "capture_ts", "page_id", "run", "seq").sortWithinPartitions("run", "seq")
    return ranged.mapInArrow(_merge, INDEX)


def capture_index(pages: DataFrame, archives: str | None = None) -> DataFrame:
    """Archive ``pages`` (page_id, url, html; other columns are ignored), read the archives
    back and return the merged index. Payloads are checked against their digests on the way."""
    archives = archives or scratch_path(pages.sparkSession, "warc")
    write_archives(pages, archives)
    return read_index(pages.sparkSession, archives)
