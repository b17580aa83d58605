"""WARC archives: written with an index, read by coalesced byte ranges."""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Mapper, bitmap, in_bitmap, in_short_batches, new_folder, stage

#: Payloads below this many bytes are never replaced by a reference.
LEAST_BYTES = 100
#: Records whose ranges begin in one stretch of this many bytes are read by one task; neighbours by one read.
STRETCH_BYTES = 4 << 20
#: Unwanted bytes that a read rather takes along than stops at.
GAP_BYTES = 64 << 10
DATE = "2024-01-01T00:00:00Z"
INDEX = "page_id long, url string, digest string, file string, offset long, length long"


def record(page_id: int | None, url: str, digest: str, n_bytes: int, body: bytes, first: int | None) -> bytes:
    """One record as a gzip member of its own; ``first``: the page that a revisit refers to."""
    revisit = first is not None
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {url.translate({10: ' ', 13: ' '})}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Payload-Length: {n_bytes}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(first)}"]
    lines += [f"Content-Length: {len(body)}", "", ""]
    return gzip.compress("\r\n".join(lines).encode() + body + b"\r\n\r\n", 6, mtime=0)


def _flags(shared, firsts, alone=None) -> Mapper:
    """Add whether a row's digest may be shared (``shared``), and whether its payload is surely another row's (``spare``).

    Without ``alone``, the digests that the first map takes for shared ones, the
    latter is only a guess, and payloads aren't there; with it, spare payloads go.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, own = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("h", "own"))
            hit = in_bitmap(shared.value, h)
            spare = hit & ~in_bitmap(firsts.value, own)
            columns = {c: batch.column(c) for c in batch.schema.names}
            if alone is not None:
                spare &= ~in_bitmap(alone.value, h)
                columns["payload"] = columns["payload"].take(pa.array(np.arange(batch.num_rows), mask=spare))
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(hit), pa.array(spare)], [*columns, "shared", "spare"])

    return in_short_batches(run)


def _write(folder: str):
    """Write a task's rows as one archive file; its index rows say where each record is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        # A file of an attempt that is lost, or that another one overtakes, is in no index.
        file = f"{folder}/{uuid.uuid4().hex}.warc.gz"
        system, path = fs.FileSystem.from_uri(file)
        out, at = None, 0
        for batch in batches:
            if out is None:
                system.create_dir(path.rpartition("/")[0], recursive=True)
                out = system.open_output_stream(path, compression=None)
            offsets, lengths = [], []
            cols = [batch.column(c).to_pylist() for c in ("page_id", "url", "digest", "n", "payload", "first")]
            for page_id, url, digest, n, payload, first in zip(*cols, strict=True):
                data = record(page_id, url, digest, n, b"" if payload is None else payload.encode(), first)
                out.write(data)
                offsets.append(at)
                lengths.append(len(data))
                at += len(data)
            names = ["page_id", "url", "digest", "file", "offset", "length"]
            yield pa.RecordBatch.from_arrays([batch.column("page_id").cast(pa.int64()), batch.column("url"), batch.column("digest"), pa.array([file] * len(offsets), pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], names)
        if out is not None:
            out.close()

    return run


def write_archive(pages: DataFrame, folder: str) -> DataFrame:
    """Write one WARC record for each row of ``pages`` (page_id, url, html) and return the archive's index.

    Index columns: page_id, url, digest, file, offset, length.  Of records of
    equal payloads of ``LEAST_BYTES`` or more, that of the smallest page_id (and
    each row that repeats it) is a response; others are revisits that refer to
    it.  A task writes its rows to a file of its own, one gzip member a record,
    and the index, which is staged once, names only files of committed tasks.

    Digests are counted first, and a bit map, sized by their count, says which
    may be shared: all other payloads go from the table to the archive without a
    shuffle.  Of the rest a second map tells which rows may be their group's
    first, and a third one which digests the first map took for shared ones; all
    other payloads go before anything moves.
    """
    spark = pages.sparkSession
    payload = F.coalesce("html", F.lit(""))
    seen = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("n"))
    firsts = seen.where(F.col("n") >= LEAST_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    firsts = stage(firsts.select("digest", "first", F.xxhash64("digest").alias("h"), F.xxhash64("first", "digest").alias("own")), "firsts")
    sent = [spark.sparkContext.broadcast(bitmap(firsts, c)) for c in ("h", "own")]
    seen = seen.withColumns({"h": F.xxhash64("digest"), "own": F.xxhash64("page_id", "digest")})
    guessed = seen.select("digest", "h", "own").mapInArrow(_flags(*sent), "digest string, h long, own long, shared boolean, spare boolean").where("spare")
    wrong = stage(guessed.select("digest", "h").distinct().join(firsts.select("digest"), "digest", "left_anti").select("h"), "wrong")
    sent.append(spark.sparkContext.broadcast(bitmap(wrong, "h")))
    flagged = seen.mapInArrow(_flags(*sent), "page_id long, url string, payload string, digest string, n long, h long, own long, shared boolean, spare boolean")
    alone = flagged.where("not shared").select("page_id", "url", "digest", "n", "payload", F.lit(None).cast("long").alias("first"))
    copies = flagged.where("shared").join(firsts.select("digest", "first"), "digest", "left")
    # Where all ids of a group are null there is no first, and all are responses.
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    copies = copies.select("page_id", "url", "digest", "n", F.when(~revisit, F.col("payload")).alias("payload"), F.when(revisit, F.col("first")).alias("first"))
    written = [x.mapInArrow(_write(folder), INDEX) for x in (alone, copies)]
    return stage(written[0].unionAll(written[1]), "index")


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one record."""
    head, _, block = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record at this offset")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    return headers, block[: int(headers["content-length"])]


def _ranges(rows: pd.DataFrame, gap: int, most: int) -> Iterator[pd.DataFrame]:
    """Rows sorted by offset, in runs that one read covers."""
    cuts = (rows["file"] != rows["file"].shift()) | (rows["offset"] - (rows["offset"] + rows["length"]).shift() > gap)
    stretch = rows["offset"] // most
    yield from (run for _, run in rows.groupby((cuts | (stretch != stretch.shift())).cumsum(), sort=False))


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    for rows in batches:
        for run in _ranges(rows, GAP_BYTES, STRETCH_BYTES):
            system, path = fs.FileSystem.from_uri(run["file"].iloc[0])
            first = int(run["offset"].iloc[0])
            with system.open_input_file(path) as f:
                data = f.read_at(int((run["offset"] + run["length"]).max()) - first, first)
            out = []
            for page_id, digest, offset, length in zip(run["page_id"], run["digest"], run["offset"], run["length"], strict=True):
                at = int(offset) - first
                headers, block = parse(gzip.decompress(data[at : at + int(length)]))
                named = headers["warc-payload-digest"].removeprefix("sha256:")
                found = hashlib.sha256(block).hexdigest() if headers["warc-type"] == "response" else named
                if found != named or found != digest:
                    raise ValueError(f"payload digest differs for page {page_id}")
                to = headers.get("warc-refers-to", "").removeprefix("<urn:page:").removesuffix(">")
                own = headers["warc-record-id"].removeprefix("<urn:page:").removesuffix(">")
                out.append((int(own) if own else None, int(headers["warc-payload-length"]), found, headers["warc-type"], int(to) if to else None, headers["warc-target-uri"], block))
            got = pd.DataFrame(out, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "block"])
            yield got.astype({"page_id": "Int64", "refers_to": "Int64"})


def read_archive(index: DataFrame) -> DataFrame:
    """The records of ``index`` (all, or those that a filter of it selected), read back from the archives.

    Columns: page_id, payload_bytes, payload_digest, record_type, refers_to, url,
    block.  Ranges are dealt by stretches of a file, sorted, and neighbours are
    read at once; each payload is hashed again and compared with the header and the index.
    """
    stretch = F.floor(F.col("offset") / STRETCH_BYTES)
    dealt = index.repartition("file", stretch).sortWithinPartitions("file", "offset")
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, block binary"
    return dealt.mapInPandas(_read, schema)


def archive_roundtrip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read every record back.

    A null html is an empty payload, a null url an empty one (line breaks in it
    become blanks), a null page_id an empty record id that never is a target.
    Rows that repeat a page_id are records of their own.  An empty table writes
    no record and gives no rows.  A very long page is one record, made and read
    in the memory of one task.  Other columns are not written, whatever their
    names.
    """
    return read_archive(write_archive(pages, new_folder(pages.sparkSession, "warc")))
