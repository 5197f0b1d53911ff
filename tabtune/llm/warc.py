"""Deterministic sharded WARC archives.

Records are range-sorted by page id into shards of about ``shard_bytes``; the
shard borders come from a histogram of the ids, so they depend on the data
alone.  One task writes one shard and rolls to a new file once the compressed
size passes ``roll_bytes``.  All headers, lengths and digests are computed
anew from the payload; record ids and dates are fixed functions of the rows,
so the same table gives the same bytes.

A task writes each file under ``_temporary`` with a name of its own attempt,
renames it to its final name when it is whole, and reports it.  A file's name
and bytes follow from the rows alone, so a repeated task replaces it by the
same bytes.  The reports are the parts of the manifest, a table that Spark
writes; the manifest itself, written last and under a temporary name too, names
that table and is what readers go by.  A lost executor leaves nothing but files
that the repeated task replaces, and ``_temporary`` is deleted in the end.

Duplicate payloads: of the records with equal payloads of at least
``min_bytes`` bytes, those with the largest page id are responses, the others
revisit them.

Defined results: a null html is an empty payload; a null page id sorts first,
is a response only if no equal payload has an id, and is never referred to;
rows that share an id are records of their own; a null url is written as the
page's urn; other columns are not read; an empty table gives an archive of no
files.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabtune.llm.frames import saved, scratch

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bits by which a range of ids is split while borders are sought.
BIN_BITS = 6


#: Files share tasks beyond this number.
MOST_TASKS = 1 << 15


def _sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(page_id: int | None, digest: str) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}').urn}>"


def _record(kind: str, fields: list[tuple[str, str]], block: bytes, level: int) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Date", DATE), *fields,
            ("WARC-Block-Digest", "sha1:" + _sha1(block)), ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(text.encode() + block + b"\r\n\r\n") + pack.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None,
                level: int = 6) -> bytes:
    """One gzip member: a response, or a revisit if ``refers_to`` is given."""
    digest = _sha1(payload)
    uri = f"urn:page:{page_id}" if url is None else re.sub(
        r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    fields = [("WARC-Record-ID", _urn(page_id, digest)), ("WARC-Target-URI", uri),
              ("WARC-Payload-Digest", "sha1:" + digest),
              ("Content-Type", "application/http; msgtype=response"),
              ("X-Page-Id", "" if page_id is None else str(page_id))]
    if refers_to is None:
        return _record("response", fields, http.encode() + payload, level)
    fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn(refers_to, digest)),
               ("X-Refers-To-Page-Id", str(refers_to))]
    return _record("revisit", fields, http.encode(), level)


def borders(sizes: DataFrame, shard_bytes: int) -> list[int]:
    """Last ids of all shards but the last, from columns id and bytes (null ids
    count as the smallest).

    Ids are counted by their leading bits; only bins that are still too heavy
    are split by the next ones, found by an equal prefix."""
    low, high, total = sizes.agg(F.min("id"), F.max("id"), F.sum("bytes")).first()
    if low is None or total <= shard_bytes:
        return []
    shift = max(0, ((low ^ high) & ((1 << 64) - 1)).bit_length() - BIN_BITS)
    done: list[tuple[int, int]] = []        # (last id, bytes) of bins
    rows = sizes.where("id IS NOT NULL")
    while True:
        bins = rows.groupBy(F.shiftright("id", shift).alias("bin")).agg(F.sum("bytes").alias("bytes")).collect()
        heavy = []                          # 2^BIN_BITS bins for each heavy one before
        for r in bins:
            if r.bytes > shard_bytes and shift:
                heavy.append((r.bin,))
            else:
                done.append((((r.bin + 1) << shift) - 1, r.bytes))
        if not heavy:
            break
        again = sizes.sparkSession.createDataFrame(heavy, "_bin bigint")
        rows = rows.join(F.broadcast(again), F.shiftright("id", shift) == F.col("_bin"), "left_semi")
        shift = max(0, shift - BIN_BITS)
    cuts, held = [], 0
    for last, size in sorted(done):
        if held and held + size > shard_bytes:
            cuts.append(before)
            held = 0
        held, before = held + size, last
    return cuts


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url: str = "url", html: str = "html",
               min_bytes: int = 0, shard_bytes: int = 32 << 20, roll_bytes: int = 8 << 20,
               level: int = 6) -> str:
    """Write the archive below ``path`` (a URI that all executors reach) and
    return the path of its manifest."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url).alias("url"),
                        F.coalesce(F.col(html), F.lit("")).alias("html"))
    sizes = saved(rows.select("id", F.sha1("html").alias("sha"),
                              F.octet_length("html").cast("long").alias("bytes")), "payloads")
    last = sizes.groupBy("sha").agg(F.max("id").alias("last"))
    refers = F.when((F.col("bytes") >= min_bytes) & ~F.col("id").eqNullSafe(F.col("last")), F.col("last"))
    notes = sizes.join(last, "sha").select("id", "sha", refers.alias("refers_to")).distinct()
    cuts = np.array(borders(sizes.withColumn("bytes", F.col("bytes") + 512), shard_bytes), dtype=np.int64)

    @F.pandas_udf("int")
    def shard_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, ids.fillna(np.iinfo(np.int64).min).to_numpy(dtype=np.int64))
                         .astype(np.int32))

    # A page's notes come before its payload; the payload is shuffled once.
    stream = notes.select("id", F.lit(0).alias("order"), "sha", "refers_to", F.lit(None).cast("string").alias("url"),
                          F.lit(None).cast("string").alias("html")).unionAll(
        rows.select("id", F.lit(1), F.lit(None), F.lit(None), "url", "html"))
    stream = (stream.withColumn("shard", shard_of("id")).repartitionById(len(cuts) + 1, F.col("shard"))
              .sortWithinPartitions("shard", "id", "order", "url", "html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = pafs.FileSystem.from_uri(path)
        out, files, known, page = None, [], {}, object()

        def close() -> None:
            if out is not None:
                out.close()
                files[-1][6] = seal.hexdigest()
                _rename(where, f"{base}/{files[-1][3]}", f"{base}/{files[-1][2]}")

        for batch in batches:
            for i in range(batch.num_rows):
                shard, page_id, order, sha, refers_to, uri, content = (
                    batch.column(j)[i].as_py() for j in range(7))
                if page_id != page:
                    page, known = page_id, {}
                if order == 0:
                    known[sha] = refers_to
                    continue
                payload = content.encode()
                record = page_record(page_id, uri, payload, known[hashlib.sha1(payload).hexdigest()], level)
                if out is None or files[-1][0] != shard or files[-1][5] >= roll_bytes:
                    close()
                    seq = files[-1][1] + 1 if files and files[-1][0] == shard else 0
                    name = f"part-{shard:05d}-{seq:05d}.warc.gz"
                    temp = f"_temporary/{name}.{uuid.uuid4().hex}"
                    out = where.open_output_stream(f"{base}/{temp}", compression=None)
                    info = f"software: tabtune\r\nformat: WARC/1.1\r\nfilename: {name}\r\n".encode()
                    head = _record("warcinfo", [("WARC-Record-ID", f"<{uuid.uuid5(uuid.NAMESPACE_URL, name).urn}>"),
                                                ("WARC-Filename", name), ("Content-Type", "application/warc-fields")],
                                   info, level)
                    out.write(head)
                    seal = hashlib.sha256(head)
                    files.append([shard, seq, name, temp, 0, len(head), ""])
                out.write(record)
                seal.update(record)
                files[-1][4] += 1
                files[-1][5] += len(record)
        close()
        columns = [[f[i] for f in files] for i in (2, 4, 5, 6)]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                         names=["name", "records", "bytes", "sha256"])

    where, base = pafs.FileSystem.from_uri(path)
    where.create_dir(f"{base}/_temporary", recursive=True)
    parts = f"manifest-{uuid.uuid4().hex}.parquet"
    stream.select("shard", "id", "order", "sha", "refers_to", "url", "html").mapInArrow(
        run, PARTS).write.parquet(f"{path}/{parts}")
    totals = pages.sparkSession.read.schema(PARTS).parquet(f"{path}/{parts}").agg(
        F.count(F.lit(1)), F.coalesce(F.sum("records"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    manifest = {"parts": parts, **dict(zip(("files", "records", "bytes"), totals))}
    with where.open_output_stream(f"{base}/_temporary/manifest.json", compression=None) as out:
        out.write(json.dumps(manifest, indent=1).encode())
    _rename(where, f"{base}/_temporary/manifest.json", f"{base}/manifest.json")
    where.delete_dir(f"{base}/_temporary")
    return f"{path}/manifest.json"


#: A row of the manifest's parts for each file.
PARTS = "name string, records bigint, bytes bigint, sha256 string"


def _rename(where: pafs.FileSystem, temp: str, name: str) -> None:
    """Also where an earlier attempt has left the same file."""
    if where.get_file_info(name).type != pafs.FileType.NotFound:
        where.delete_file(name)
    where.move(temp, name)


def manifest_parts(spark: SparkSession, manifest: str) -> DataFrame:
    """name, records, bytes and sha256 of the archive's files."""
    path = manifest.rpartition("/")[0]
    where, base = pafs.FileSystem.from_uri(path)
    with where.open_input_stream(f"{base}/manifest.json", compression=None) as f:
        parts = json.loads(f.read())["parts"]
    return spark.read.schema(PARTS).parquet(f"{path}/{parts}")


def _headers(stream: io.BufferedReader) -> tuple[str, dict[str, str]] | None:
    line = stream.readline()
    if not line:
        return None
    fields = {}
    while (entry := stream.readline().rstrip(b"\r\n")):
        key, _, value = entry.decode().partition(":")
        fields[key.strip().lower()] = value.strip()
    return line.decode().strip(), fields


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a gzipped archive, checked."""
    plain = io.BufferedReader(gzip.GzipFile(fileobj=stream))
    while (head := _headers(plain)) is not None:
        version, fields = head
        if not version.startswith("WARC/"):
            raise ValueError(f"not a record: {version[:40]}")
        block = plain.read(int(fields["content-length"]))
        if "sha1:" + _sha1(block) != fields["warc-block-digest"] or plain.read(4) != b"\r\n\r\n":
            raise ValueError(f"damaged record {fields['warc-record-id']}")
        yield fields, block


def read_warc(spark: SparkSession, manifest: str, with_payload: bool = False) -> DataFrame:
    """The pages of an archive; lengths and digests are those of the blocks
    that were read, for a revisit those that its headers state."""
    path = manifest.rpartition("/")[0]
    schema = ("page_id bigint, url string, payload_bytes bigint, payload_digest string, "
              "record_type string, refers_to bigint") + ", payload binary" * with_payload
    columns = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = pafs.FileSystem.from_uri(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with where.open_input_stream(f"{base}/{name}", compression=None) as f:
                    for fields, block in records(f):
                        if fields["warc-type"] == "warcinfo":
                            continue
                        http = io.BufferedReader(io.BytesIO(block))
                        size = int(_headers(http)[1]["content-length"])
                        digest = fields["warc-payload-digest"].partition(":")[2]
                        payload = http.read()
                        if fields["warc-type"] == "response" and (len(payload) != size or _sha1(payload) != digest):
                            raise ValueError(f"payload of {fields['warc-record-id']} differs")
                        number = fields["x-page-id"]
                        other = fields.get("x-refers-to-page-id")
                        rows.append((int(number) if number else None, fields["warc-target-uri"], size, digest,
                                     fields["warc-type"], int(other) if other else None, payload)[:len(columns)])
                        held += len(payload) if with_payload else 200
                        if held >= 4 << 20:
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=columns)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=columns)

    files = manifest_parts(spark, manifest).select("name")
    return files.repartition(max(1, min(files.count(), MOST_TASKS)), "name").mapInArrow(run, schema)


def query(pages: DataFrame) -> DataFrame:
    manifest = write_warc(pages, scratch(pages.sparkSession, "warc"))
    return read_warc(pages.sparkSession, manifest).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages
), b AS (
  SELECT *, max(page_id) OVER (PARTITION BY h) AS last,
    list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      (1 + ((('0x' || substr(x, 1 + (i // 8) * 10, 10))::BIGINT >> (35 - 5 * (i % 8))::INT) & 31))::INT, 1)) AS d
  FROM p
)
SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, array_to_string(d, '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to
FROM b
"""
