"""WARC archives: write them, index them, read selected records by coalesced byte ranges.

`write` turns pages into `response` records, or `revisit` records where a page with a larger id
has the same payload. Spark's text writer puts the records out: a WARC record ends with two line
breaks, which is what the writer puts after each row, so a task that is lost leaves no half file.
`index` scans the archives once for offset, length, URL and digest of each record. `read` takes
any selection of index rows, sorts them by file and offset, joins ranges that lie close together
and reads each joined range at once.

A null payload is empty, a null URL too; a null page id is written as an empty id and never
referred to. Of rows that repeat the largest page id of a payload all are responses. An empty
table gives an empty folder, index and result.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import functions as F

from retentia.sources.staging import new_path, stage

BREAK = "\r\n"
#: Payloads below this size are always written in full.
SMALL = 1000
#: Ranges closer than this are read together, up to the second size.
GAP, MOST = 64 << 10, 8 << 20
#: A task reads the records of so many bytes of a file.
STRETCH = 64 << 20

INDEX = (
    "path string, offset long, length long, record_id string, url string, digest string, "
    "record_type string"
)
RECORD = (
    "record_id string, url string, record_type string, digest string, refers_to string, "
    "payload binary, full_bytes long"
)


def _named(page_id, digest):
    return F.concat(
        F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(":"), digest,
        F.lit(">"),
    )


def page_of(record_id):
    """The page id in a record id; null if it has none."""
    return F.nullif(F.regexp_extract(record_id, "^<urn:page:([^:]*):", 1), F.lit(""))


def with_links(pages, smallest=SMALL):
    """Pages with payload, digest and, for repeated payloads, the page that holds the payload."""
    p = pages.select(
        F.col("`page_id`").alias("page_id"),
        F.coalesce(F.col("`url`"), F.lit("")).alias("url"),
        F.coalesce(F.col("`html`"), F.lit("")).alias("html"),
    ).select(
        "*",
        F.octet_length("html").cast("long").alias("bytes"),
        F.sha1(F.col("html").cast("binary")).alias("digest"),
    )
    large = p.where(F.col("bytes") >= smallest).select("page_id", "digest")
    # only payloads that repeat; staged, so that a payload with many pages can be split in the join
    held = stage(
        large.groupBy("digest").agg(F.max("page_id").alias("held"), F.count("*").alias("n"))
        .where("n > 1 and held is not null").select("digest", "held"),
        "warc-held",
    )
    links = (
        large.join(held, "digest").where("page_id is null or page_id <> held").distinct()
        .select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "held")
    )
    links = stage(links, "warc-links")
    same = F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest"))
    return p.join(links, same, "left").drop("_page", "_digest")


def records(linked, date="2024-01-01T00:00:00Z"):
    """One string per record, without the two line breaks that end it."""
    full = F.col("held").isNull()
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("bytes").cast("string"), F.lit(BREAK + BREAK),
    )
    # line breaks and spaces cannot stand in a header
    url = F.regexp_replace("url", r"\s", "%20")
    length = F.octet_length(head) + F.when(full, F.col("bytes")).otherwise(0)

    def line(name, value):
        return F.concat(F.lit(f"{name}: "), value, F.lit(BREAK))

    revisit = F.concat(
        line("WARC-Refers-To", _named(F.col("held"), F.col("digest"))),
        line("WARC-Profile", F.lit(
            "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
    )
    return linked.select(
        F.concat(
            F.lit("WARC/1.1" + BREAK),
            line("WARC-Type", F.when(full, "response").otherwise("revisit")),
            line("WARC-Record-ID", _named(F.col("page_id"), F.col("digest"))),
            line("WARC-Date", F.lit(date)),
            line("WARC-Target-URI", url),
            line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            F.when(full, "").otherwise(revisit),
            line("Content-Type", F.lit("application/http; msgtype=response")),
            line("Content-Length", length.cast("string")),
            F.lit(BREAK),
            head,
            F.when(full, F.col("html")).otherwise(""),
        ).alias("value")
    )


def write(pages, path, smallest=SMALL):
    """Write the archives of the pages to a folder."""
    (
        records(with_links(pages, smallest)).write
        .option("lineSep", BREAK + BREAK).option("maxRecordsPerFile", 200_000).text(path)
    )


def _opened(path):
    """A file of the shared store; Hadoop writes local paths as file:/x."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:") :]
    store, inside = fs.FileSystem.from_uri(path)
    return store.open_input_file(inside)


def _headers(block):
    lines = block.decode("utf-8", "replace").split(BREAK)
    return dict(x.split(": ", 1) for x in lines[1:] if ": " in x)


def _scan(path, chunk=4 << 20):
    """(offset, length, headers) of each record of an archive, reading it in order."""
    with _opened(path) as f:
        size, at, have, start = f.size(), 0, b"", 0
        while at < size:
            end = have.find(b"\r\n\r\n", at - start)
            while end < 0:
                more = f.read_at(chunk, start + len(have))
                if not more:
                    return
                have, start = have[at - start :] + more, at
                end = have.find(b"\r\n\r\n")
            headers = _headers(have[at - start : end])
            length = end + 4 + start - at + int(headers["Content-Length"])
            yield at, length, headers
            at += length + 4
            if at - start >= len(have):
                have, start = b"", at


def _index_files(batches):
    for batch in batches:
        for path in batch.column("path").to_pylist():
            rows = [
                (path, at, n, h["WARC-Record-ID"], h.get("WARC-Target-URI", ""),
                 h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"])
                for at, n, h in _scan(path)
            ]
            names = [x.split()[0] for x in INDEX.split(", ")]
            for k in range(0, len(rows), 10_000):
                part = list(zip(*rows[k : k + 10_000]))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in part], names=names)


def index(spark, path):
    """One row per record: file, offset, length, id, URL, digest and type; staged."""
    files = spark.read.format("binaryFile").load(path).select("path")
    files = files.repartition(max(1, spark.sparkContext.defaultParallelism * 4), "path")
    return stage(files.mapInArrow(_index_files, INDEX), "warc-index")


def _record(block):
    """(headers, payload) of one record's bytes."""
    head, _, rest = block.partition(b"\r\n\r\n")
    http, _, payload = rest.partition(b"\r\n\r\n")
    return _headers(head), _headers(http), payload


def _read_ranges(batches):
    """Index rows in the order of file and offset -> records, by joined reads."""
    for batch in batches:
        paths = batch.column("path").to_pylist()
        offsets = batch.column("offset").to_numpy().astype(np.int64)
        ends = offsets + batch.column("length").to_numpy().astype(np.int64)
        out, size, k, opened = [], 0, 0, (None, None)
        while k < len(paths):
            last = k
            while (
                last + 1 < len(paths)
                and paths[last + 1] == paths[k]
                and offsets[last + 1] - ends[last] <= GAP
                and ends[last + 1] - offsets[k] <= MOST
            ):
                last += 1
            if opened[0] != paths[k]:
                if opened[1]:
                    opened[1].close()
                opened = (paths[k], _opened(paths[k]))
            first = int(offsets[k])
            data = opened[1].read_at(int(ends[last]) - first, first)
            for i in range(k, last + 1):
                headers, http, payload = _record(data[offsets[i] - first : ends[i] - first])
                digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                full = headers["WARC-Type"] == "response"
                if full and hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError(f"damaged record at {paths[i]}:{offsets[i]}")
                out.append((
                    headers["WARC-Record-ID"], headers.get("WARC-Target-URI", ""),
                    headers["WARC-Type"], digest, headers.get("WARC-Refers-To"),
                    payload if full else None, int(http["Content-Length"]),
                ))
                size += len(payload)
            k = last + 1
            if size >= MOST or k == len(paths):
                yield _records_batch(out)
                out, size = [], 0
        if opened[1]:
            opened[1].close()


def _records_batch(rows):
    kinds = [pa.string()] * 5 + [pa.binary(), pa.int64()]
    names = [x.split()[0] for x in RECORD.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names
    )


def read(selected):
    """The records of the selected index rows, digests verified.

    Revisits have no payload; the digest and size of the full one come with them.
    """
    spark = selected.sparkSession
    rows = selected.select("path", "offset", "length").withColumn(
        "_stretch", F.floor(F.col("offset") / STRETCH)
    )
    parts = max(1, spark.sparkContext.defaultParallelism * 4)
    rows = rows.repartition(parts, "path", "_stretch").sortWithinPartitions("path", "offset")
    return rows.drop("_stretch").mapInArrow(_read_ranges, RECORD)


def round_trip(pages):
    """Write all pages, index the archives, read every record back: one row per page."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write(pages, path)
    back = read(index(spark, path))
    kind = dict(pages.dtypes)["page_id"]
    return back.select(
        page_of(F.col("record_id")).cast(kind).alias("page_id"),
        F.col("full_bytes").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        "record_type",
        page_of(F.col("refers_to")).cast(kind).alias("refers_to"),
        "url",
    )
