"""WARC archives with an index written first-hand: offset, length, URL and digest of each record.

Writing: each task appends its records to archives of its own in a folder that driver and executors
share, and returns the index rows, which Spark commits as Parquet. Archive names carry a random part,
so a task that is run again never touches the files of the run that counts: the index names only those.
Reading: index rows are chosen first, sorted by archive and offset, and read as coalesced byte ranges.
"""

from __future__ import annotations

import gzip
import hashlib
import posixpath
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import few_files, local_path, map_arrow, materialize, salted, slices, split_bytes, with_salt, work_folder

INDEX = "page_id long, url string, archive string, offset long, length long, digest string, record_type string, refers_to long"
RECORDS = "page_id long, url string, record_type string, refers_to long, digest string, payload binary"


def mark_revisits(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """page_id, url, payload, digest, record_type and refers_to of every page.

    Of pages with equal payloads of at least ``min_bytes``, that with the largest page_id is the
    response (several rows with that page_id and payload all are; a null page_id counts as least)
    and others revisit it. Null html is an empty payload. An empty table gives no rows.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    large = rows.filter(F.octet_length("payload") >= min_bytes)
    groups = large.groupBy("digest").agg(F.max("page_id").alias("__to"), F.count(F.lit(1)).alias("__n")).filter("__n > 1").drop("__n")
    marked = with_salt(rows, F.col("page_id")).join(salted(groups), ["digest", "__salt"], "left")
    revisit = F.col("__to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("__to"))
    return marked.select(
        "page_id", "url", "payload", "digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("__to")).alias("refers_to"),
    )


def _record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {page_id}')}>"


def _clean(value: str | None) -> str:
    """A header value on one line."""
    return (value or "").replace("\r", "%0D").replace("\n", "%0A")


def record_bytes(row: dict, date: str) -> bytes:
    """A WARC 1.0 record: a response with its payload, or a revisit that names the response's record."""
    revisit = row["record_type"] == "revisit"
    head = [
        "WARC/1.0",
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: {_record_id(row['page_id'])}",
        f"WARC-Target-URI: {_clean(row['url'])}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{row['digest']}",
        f"X-Page-ID: {'' if row['page_id'] is None else row['page_id']}",
    ]
    if row["url"] is None:
        head.remove("WARC-Target-URI: ")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(row['refers_to'])}", f"X-Refers-To-Page: {row['refers_to']}"]
    body = b"" if revisit else row["payload"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The fields of one record; ValueError if it is cut short or damaged."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not sep or lines[0] != "WARC/1.0":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("the record's length is wrong")
    to, page = fields.get("X-Refers-To-Page"), fields["X-Page-ID"]
    return {"page_id": int(page) if page else None, "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "refers_to": int(to) if to else None, "digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "payload": rest[:n]}


def write_archives(marked: DataFrame, folder: str, date: str = "2000-01-01T00:00:00Z", roll_bytes: int = 256 << 20, compress: bool = True) -> DataFrame:
    """Write every row of :func:`mark_revisits` as a record; returns the written index.

    With ``compress`` each record is a gzip member of its own, as ``.warc.gz`` has it, so a byte range still holds whole records.
    Archives end once they exceed ``roll_bytes``. Tasks without rows write nothing.
    """

    def run(batches):
        fs = base = out = None
        name, at = "", 0
        try:
            for batch in batches:
                for part in slices(batch, 2):
                    index = []
                    for row in part.to_pylist():
                        if out is None or at >= roll_bytes:
                            if out is not None:
                                out.close()
                            else:
                                fs, base = local_path(folder)
                                fs.create_dir(base, recursive=True)
                            name, at = f"pages-{uuid.uuid4().hex}.warc{'.gz' * compress}", 0
                            out = fs.open_output_stream(posixpath.join(base, name), compression=None)
                        data = record_bytes(row, date)
                        if compress:
                            data = gzip.compress(data, 1, mtime=0)
                        out.write(data)
                        index.append(row | {"archive": name, "offset": at, "length": len(data)})
                        at += len(data)
                    yield {c.split()[0]: [r[c.split()[0]] for r in index] for c in INDEX.split(", ")}
        finally:
            if out is not None:
                out.close()

    ordered = marked.select("page_id", "url", "payload", "digest", "record_type", "refers_to")
    return materialize(map_arrow(ordered, run, INDEX), "warc-index", spread=True)


def read_records(index: DataFrame, folder: str, gap: int = 64 << 10, span: int = 8 << 20, task_bytes: int | None = None) -> DataFrame:
    """Read the records that ``index`` (any selection of its rows) names; no rows give none.

    Rows are dealt by archive and ``span``-sized stretch and sorted by offset; neighbours no more
    than ``gap`` bytes apart are read as one range of about ``span`` bytes at most. There is a task for each
    ``task_bytes`` of the chosen records (by default what a scan's tasks take), and one a core at least.
    ``index`` is read twice and must give the same rows.
    """
    spark = index.sparkSession
    total = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // (task_bytes or split_bytes(spark))))

    def run(batches):
        fs, base = local_path(folder)
        name, file = None, None
        for batch in batches:
            rows = batch.to_pylist()
            at = 0
            while at < len(rows):
                first = rows[at]
                end, last = first["offset"] + first["length"], at + 1
                while last < len(rows) and rows[last]["archive"] == first["archive"] and first["offset"] <= rows[last]["offset"] <= end + gap and rows[last]["offset"] + rows[last]["length"] - first["offset"] <= span:
                    end, last = max(end, rows[last]["offset"] + rows[last]["length"]), last + 1
                if name != first["archive"]:
                    name, file = first["archive"], fs.open_input_file(posixpath.join(base, first["archive"]))
                file.seek(first["offset"])
                data = file.read(end - first["offset"])
                cuts = [data[r["offset"] - first["offset"] : r["offset"] - first["offset"] + r["length"]] for r in rows[at:last]]
                found = [parse_record(gzip.decompress(c) if name.endswith(".gz") else c) for c in cuts]
                yield {c.split()[0]: [r[c.split()[0]] for r in found] for c in RECORDS.split(", ")}
                at = last

    dealt = index.select("archive", "offset", "length", F.expr(f"offset div {span}").alias("stretch"))
    dealt = dealt.repartition(tasks, "archive", "stretch").sortWithinPartitions("archive", "offset").drop("stretch")
    return map_arrow(dealt, run, RECORDS)


def op5_warc(spark, sf_dir: str) -> DataFrame:
    """Write all pages as WARC, read all records back, and resolve revisits to the payloads they name."""
    folder = work_folder(spark, "warc")
    index = write_archives(mark_revisits(spark.read.parquet(f"{sf_dir}/pages.parquet")), folder)
    read = read_records(index, folder)

    def digest(batches):
        for batch in batches:
            cols = {n: batch.column(n) for n in ("page_id", "record_type", "refers_to", "digest")}
            bodies = batch.column("payload").to_pylist()
            yield cols | {"n": [len(b) for b in bodies], "sha1": [hashlib.sha1(b).hexdigest() for b in bodies]}

    rows = materialize(map_arrow(read, digest, "page_id long, record_type string, refers_to long, digest string, n long, sha1 string"), "warc-read", spread=True)
    bodies = rows.filter("record_type = 'response'").select(F.col("page_id").alias("refers_to"), F.col("sha1").alias("digest"), F.col("n").alias("__n")).dropDuplicates(["refers_to", "digest"])
    joined = with_salt(rows.filter("record_type = 'revisit'"), F.col("page_id")).join(salted(bodies), ["refers_to", "digest", "__salt"], "left")
    revisits = joined.select("page_id", F.col("__n").alias("payload_bytes"), F.when(F.col("__n").isNotNull(), F.col("digest")).alias("payload_digest"), "record_type", "refers_to")
    responses = rows.filter("record_type = 'response'").select("page_id", F.col("n").alias("payload_bytes"), F.col("sha1").alias("payload_digest"), "record_type", "refers_to")
    return few_files(responses.unionByName(revisits))


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
g AS (SELECT page_id, strlen(body) AS n, sha1(body) AS d, max(page_id) OVER (PARTITION BY body) AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
FROM g
"""
