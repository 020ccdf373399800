"""WARC archives and a globally ordered capture index.

Archives go through Spark's text writer, so they land in any store and a lost
task is written again: a record is a string, and its last line feed is the
line separator. Each archive read back gives a run of captures sorted by URL key
and timestamp. Runs are cut at the same keys, and each range is merged by a
loser tree over its pieces of runs, which orders the captures globally.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from covalens.llm import common

#: Payloads from this many bytes on can be revisits.
LEAST = 1000
#: Bytes of records in one archive, about; a reader holds one archive at a time.
ARCHIVE_BYTES = 16 << 20

INDEX = "urlkey string, ts string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long"


def url_key(url: Column) -> Column:
    """Host reversed with commas, a closing bracket, path and query: sorts a site's captures together."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    bare = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://|#.*$", "")
    host = F.lower(F.regexp_extract(bare, r"^([^/?:]*)", 1))
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_replace(bare, r"^[^/?]*", ""))


def decided(pages: DataFrame) -> DataFrame:
    """(page_id, refers_to) of the pages that revisit another: equal payloads of LEAST bytes or more refer to the largest page_id.

    Rows that share the largest page_id are all responses. A null page_id counts as smaller than any other.
    """
    seen = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("html", F.lit("")).cast("binary").alias("b"))
    seen = seen.where(F.octet_length("b") >= LEAST).select("page_id", F.sha1("b").alias("digest"))
    last = seen.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").select("digest", "refers_to")
    out = seen.join(last, "digest").where("page_id is null and refers_to is not null or page_id < refers_to")
    return out.select("page_id", "refers_to").distinct()


def records(pages: DataFrame, revisits: DataFrame) -> DataFrame:
    """One string a page: its WARC record but for the last line feed."""
    revisits = revisits.select(F.col("page_id").alias("__p"), "refers_to")
    if revisits.limit(100_001).count() <= 100_000:
        revisits = F.broadcast(revisits)
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    df = own.join(revisits, F.col("page_id").eqNullSafe(F.col("__p")), "left")
    again = F.col("refers_to").isNotNull() & (F.octet_length("html") >= LEAST)
    # two rows of one page_id may have different payloads; a small one is a response anyhow
    eol = "\r\n"
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{eol}Content-Type: text/html; charset=utf-8{eol}Content-Length: "), F.octet_length("html"), F.lit(eol + eol))
    block = F.when(again, head).otherwise(F.concat(head, F.col("html")))
    date = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.coalesce("page_id", F.lit(0)) % 1_000_000_000), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    fields = [
        ("WARC-Type", F.when(again, "revisit").otherwise("response")),
        ("WARC-Record-ID", name(F.col("page_id"))),
        ("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", " ")),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.sha1(F.col("html").cast("binary")))),
        ("WARC-Payload-Length", F.octet_length("html").cast("string")),
        ("X-URL-Key", F.regexp_replace(url_key(F.col("url")), r"[\r\n]", " ")),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", F.octet_length("__block").cast("string")),
    ]
    lines = [F.lit(f"WARC/1.1{eol}")]
    for key, value in fields:
        lines += [F.lit(f"{key}: "), value, F.lit(eol)]
    refers = F.when(again, F.concat(F.lit("WARC-Refers-To: "), name(F.col("refers_to")), F.lit(f"{eol}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{eol}"))).otherwise("")
    return df.withColumn("__block", block).select(F.concat(*lines, refers, F.lit(eol), F.col("__block"), F.lit(eol + "\r")).alias("value"))


def write_archives(pages: DataFrame, path: str) -> None:
    """Writes gzipped archives with a record for each row of ``pages`` (page_id, url, html) under ``path``."""
    largest = pages.agg(F.max(F.octet_length("html"))).first()[0] or 0
    per_file = max(1, min(10_000, ARCHIVE_BYTES // (largest + 1024)))
    writer = records(pages, common.stored(decided(pages), "revisits")).write.option("lineSep", "\n")
    writer.option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def parsed(raw: bytes):
    """(offset, length, fields, block) of each record of an archive; gzip, also member by member, is unpacked first.

    Offsets count unpacked bytes. Fields have lower-cased names. A broken archive raises ValueError.
    """
    if raw[:2] == b"\x1f\x8b":
        parts = []
        while raw:
            unzip = zlib.decompressobj(31)
            parts.append(unzip.decompress(raw) + unzip.flush())
            raw = unzip.unused_data
        raw = b"".join(parts)
    at = 0
    while at < len(raw):
        stop = raw.find(b"\r\n\r\n", at)
        if stop < 0 or not raw.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {}
        for line in raw[at:stop].split(b"\r\n")[1:]:
            key, _, value = line.partition(b":")
            fields[key.decode().strip().lower()] = value.decode("utf-8", "replace").strip()
        body = stop + 4
        end = body + int(fields["content-length"])
        if raw[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} has another length")
        yield at, end + 4 - at, fields, raw[body:end]
        at = end + 4


def _page(urn: str | None) -> int | None:
    name = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return None if name in ("", "none") else int(name)


def _capture(archive: str, record) -> dict:
    at, length, fields, block = record
    _, _, payload = block.partition(b"\r\n\r\n")
    again = fields["warc-type"] == "revisit"
    digest = fields["warc-payload-digest"].removeprefix("sha1:") if again else hashlib.sha1(payload).hexdigest()  # noqa: S324
    if not again and fields["warc-payload-digest"] != f"sha1:{digest}":
        raise ValueError(f"{archive}: the payload at byte {at} has another digest")
    return {"urlkey": fields["x-url-key"], "ts": "".join(x for x in fields["warc-date"] if x.isdigit()), "page_id": _page(fields["warc-record-id"]), "payload_bytes": int(fields["warc-payload-length"]) if again else len(payload), "payload_digest": digest, "record_type": fields["warc-type"], "refers_to": _page(fields.get("warc-refers-to")), "archive": archive, "offset": at, "length": length}


def _key(row: dict) -> tuple:
    page = row["page_id"]
    return row["urlkey"], row["ts"], page is not None, page or 0, row["archive"], row["offset"]


def runs(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all archives under ``path``, each archive's in the order of the index."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")

    def read(batches):
        for batch in batches:
            for name, raw in zip(batch.column("path"), batch.column("content"), strict=True):
                archive = name.as_py().rsplit("/", 1)[-1]
                own = sorted((_capture(archive, r) for r in parsed(raw.as_py())), key=_key)
                yield pa.RecordBatch.from_pylist(own, schema=_SCHEMA)

    return files.mapInArrow(read, INDEX)


_SCHEMA = pa.schema([(name, pa.int64() if kind == "long" else pa.string()) for name, kind in (x.split() for x in INDEX.split(", "))])


class LoserTree:
    """Merges sorted iterators: each inner node holds the loser of its match, so an item costs log2(k) comparisons."""

    def __init__(self, sources, key):
        self.sources = [iter(s) for s in sources]
        self.key = key
        self.k = len(self.sources)
        self.heads = [self._pull(i) for i in range(self.k)]
        self.tree = [-1] * max(self.k, 1)
        for i in range(self.k):
            self._play(i, True)

    def _pull(self, i):
        item = next(self.sources[i], None)
        return None if item is None else (self.key(item), i, item)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or x[:2] < y[:2])

    def _play(self, i: int, building: bool) -> None:
        node = (i + self.k) >> 1
        while node:
            other = self.tree[node]
            if other < 0 and building:  # the first to come waits for its match
                self.tree[node] = i
                return
            if self._beats(other, i):
                self.tree[node], i = i, other
            node >>= 1
        self.tree[0] = i

    def __iter__(self):
        while self.k and self.heads[top := self.tree[0]] is not None:
            yield self.heads[top][2]
            self.heads[top] = self._pull(top)
            self._play(top, False)


def merged(captures: DataFrame) -> DataFrame:
    """All captures by URL key, timestamp and page: ranges of keys in order of partition, each merged from its pieces of runs.

    Ranges are cut by (URL key, timestamp, page), so a site or URL with any share of the captures spans many.
    """
    spark = captures.sparkSession
    order = ["urlkey", "ts", "page_id", "archive", "offset"]
    dealt = captures.repartitionByRange(common.partitions(spark), *order)
    # a range gets its rows from each archive in that archive's order
    dealt = dealt.sortWithinPartitions("archive", *order)

    def merge(batches):
        pieces: dict[str, list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                pieces.setdefault(row["archive"], []).append(row)
        out = []
        for row in LoserTree(pieces.values(), _key):
            out.append(row)
            if len(out) == 4096:
                yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)

    return dealt.mapInArrow(merge, INDEX)


def archived(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) as archives, reads them back, and returns their merged index.

    Columns: INDEX. One row for each input row, a repeated page_id's too. A null
    html is an empty payload, a null url an empty key, a null page_id stays null;
    other columns are ignored. The digest of each response is computed anew from
    the archive and compared. An empty table gives no rows.
    """
    spark = pages.sparkSession
    path = path or common.new_path(spark, "archives")
    write_archives(pages, path)
    return merged(common.stored(runs(spark, path), "runs"))
