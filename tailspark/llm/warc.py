"""WARC archives: a writer with revisit records and a sequential, verifying reader; one gzip member per record."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Work, delete_path, hot_values, small_batches, work_path

DATE = "2020-01-01T00:00:00Z"
CHUNK = 1 << 16
#: Longest head of a record or of its HTTP message.
HEAD = 1 << 20
_ID = re.compile(r"<urn:page:(-?\d+|none)(?::[0-9a-f]+)?>")


class WarcError(ValueError):
    """An archive that breaks the format: framing, truncation, or a digest that doesn't fit."""


def b32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode("ascii")


def _uri(page_id: int | None, again: bool = False) -> str:
    """A page's record id; further records of a page (`again`), and those of pages without id, get one of their own."""
    if page_id is not None and not again:
        return f"<urn:page:{page_id}>"
    return f"<urn:page:{'none' if page_id is None else page_id}:{uuid.uuid4().hex}>"


def _member(headers: list[tuple[str, str]], block: bytes, level: int) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))]) + "\r\n"
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(head.encode("utf-8", "surrogatepass")) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, level: int = 4, digest: str | None = None, size: int | None = None) -> bytes:
    """One record as a gzip member. With refers_to a revisit: it holds the HTTP head only, digest and size describe the payload."""
    size = len(payload) if size is None else size
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode("ascii")
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _uri(page_id, refers_to == page_id)), ("WARC-Date", DATE)]
    if url is not None:
        headers.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    headers.append(("WARC-Payload-Digest", "sha1:" + (digest or b32_sha1(hashlib.sha1(payload).digest()))))
    headers.append(("Content-Type", "application/http; msgtype=response"))
    if refers_to is None:
        return _member(headers, http + payload, level)
    profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    return _member([*headers, ("WARC-Profile", profile), ("WARC-Refers-To", _uri(refers_to))], http, level)


def _fields(lines: list[str]) -> dict[str, str]:
    """Named fields by lower-case name; blanks around a value don't matter, folded lines go on with the one before."""
    out: dict[str, str] = {}
    name = None
    for x in lines:
        if x[:1] in (" ", "\t") and name:
            out[name] += " " + x.strip()
            continue
        name, colon, value = x.partition(":")
        name = name.strip().lower()
        if colon:
            out[name] = value.strip()
    return out


def _count(text: str | None, what: str) -> int:
    if text is None or not text.isascii() or not text.isdigit():
        raise WarcError(f"{what} must be a number: {text!r}")
    return int(text)


def _sha1_of(said: str | None) -> str | None:
    """A digest as bare base32 SHA-1; None if there is none or it is of another kind, which isn't verified."""
    kind, colon, value = (said or "").partition(":")
    if not colon or kind.lower() not in ("sha1", "sha-1"):
        return None
    if len(value) == 40:
        try:
            return b32_sha1(bytes.fromhex(value))
        except ValueError as e:
            raise WarcError(f"not a SHA-1: {said}") from e
    return value.upper()


def read_records(stream, keep_payload: bool = True) -> Iterator[dict]:
    """The records of an archive, in order, in memory bounded by CHUNK and HEAD (and a payload, if kept).

    Each gzip member is inflated piece by piece; its head ends at the blank line, its block is framed by Content-Length. Where
    the block is HTTP (responses, requests, revisits with a head) the payload is what follows the HTTP head, else (warcinfo,
    metadata, resources and others) the whole block. Block and payload are digested on the way. Raises WarcError where a member
    is cut off or no record, the length doesn't match, or a SHA-1 of the block, or of a payload that is there, isn't its own. A
    record without digest gets its payload's; a revisit, which has no payload, is given the digest and length that it states.
    """
    rest = stream.read(CHUNK)
    while rest:
        z, buffer, head, body = zlib.decompressobj(31), b"", None, []
        http, has_http, seen, size, sha, block_sha = None, False, 0, 0, hashlib.sha1(), hashlib.sha1()
        while True:
            try:
                data = z.decompress(rest, CHUNK)
            except zlib.error as e:
                raise WarcError(f"not a gzip member: {e}") from e
            rest = z.unconsumed_tail
            buffer += data
            if head is None:
                if (end := buffer.find(b"\r\n\r\n")) >= 0:
                    lines = buffer[:end].decode("utf-8", "surrogateescape").split("\r\n")
                    if not lines[0].startswith("WARC/"):
                        raise WarcError("a record must begin with WARC/")
                    head = _fields(lines[1:])
                    length, buffer = _count(head.get("content-length"), "Content-Length"), buffer[end + 4 :]
                    has_http = head.get("content-type", "").lower().startswith("application/http") and length > 0
                elif len(buffer) > HEAD:
                    raise WarcError("a record's head doesn't end")
            if head is not None and has_http and http is None:
                end = buffer.find(b"\r\n\r\n", 0, length)
                if end >= 0 or len(buffer) >= length:  # a head that nothing follows may end with its block
                    end = end + 4 if end >= 0 else length
                    http = _fields(buffer[:end].decode("latin-1").split("\r\n")[1:])
                    block_sha.update(buffer[:end])
                    seen, buffer = end, buffer[end:]
                elif len(buffer) > HEAD:
                    raise WarcError("an HTTP head doesn't end")
            if head is not None and (http is not None or not has_http) and seen < length and buffer:
                part, buffer = buffer[: length - seen], buffer[length - seen :]
                sha.update(part)
                block_sha.update(part)
                seen, size = seen + len(part), size + len(part)
                if keep_payload:
                    body.append(part)
            if z.eof:
                rest = z.unused_data or stream.read(CHUNK)
                break
            if not rest and not data:
                rest = stream.read(CHUNK)
                if not rest:
                    raise WarcError("the archive ends within a record")
            elif not rest:
                rest = stream.read(CHUNK)
        if head is None or seen != length or buffer != b"\r\n\r\n":
            raise WarcError("a record's block doesn't fit its Content-Length")
        kind, name = head.get("warc-type"), head.get("warc-record-id", "")
        if kind is None:
            raise WarcError(f"record {name} has no WARC-Type")
        said, block_said, made = _sha1_of(head.get("warc-payload-digest")), _sha1_of(head.get("warc-block-digest")), b32_sha1(sha.digest())
        if block_said is not None and block_said != b32_sha1(block_sha.digest()):
            raise WarcError(f"block digest of {name}: {b32_sha1(block_sha.digest())}, said {block_said}")
        revisit = kind == "revisit"
        if not revisit and said is not None and said != made:
            raise WarcError(f"payload digest of {name}: {made}, said {said}")
        page, refers = _ID.fullmatch(name), _ID.fullmatch(head.get("warc-refers-to", ""))
        stated = (http or {}).get("content-length")
        yield {
            "page_id": int(page[1]) if page and page[1] != "none" else None, "url": head.get("warc-target-uri"), "record_type": kind, "payload_digest": said or (None if revisit else made),
            "payload_bytes": (_count(stated, "an HTTP Content-Length") if stated is not None else None) if revisit else size,
            "refers_to": int(refers[1]) if refers and refers[1] != "none" else None, "payload": b"".join(body) if keep_payload and not revisit else None,
        }


def _open(path: str):
    """The file system of a URI and the path in it. s3a:// and s3n:// name what pyarrow calls s3://."""
    from pyarrow import fs as afs

    return afs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", path))


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, archive_bytes: int = 64 << 20, root: str | None = None) -> DataFrame:
    """Write one record per row to archives under root (in the shared folder) and return (archive, records, bytes).

    Of rows with equal payloads of min_bytes or more, one with the largest id is the response (of several such rows the one of
    the least url) and all others revisit it. Null html is an empty payload; rows with a null id revisit where their payload has
    an id, else are responses. An empty table gives no archives; other columns are ignored, whatever their names.

    Plan: payload digests are counted first (a slim table); payloads are equal where SHA-1, length and a 64-bit hash agree.
    Payloads become gzip members before they move, then meet the digests that occur twice or more; digests that hold over 1/500
    of the rows (at most 500) are met by broadcast. A task writes archives of its own name, and only those in the returned
    table count: files that lost or repeated attempts leave are deleted at the end.
    """
    spark, work = pages.sparkSession, Work()
    root = root or work_path(spark, "warc")
    payload = F.coalesce(F.col(html_col).cast("binary"), F.lit("").cast("binary"))
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    base = base.withColumn("sha", F.concat_ws(":", F.sha1("payload"), F.length("payload"), F.xxhash64("payload")))
    slim = work.save(base.select("page_id", "sha", F.length("payload").alias("bytes")), "warc-slim")
    counts = slim.filter(F.col("bytes") >= min_bytes).groupBy("sha", "page_id").agg(F.count(F.lit(1)).alias("same"))
    counts = counts.groupBy("sha").agg(F.max("page_id").alias("top"), F.sum("same").alias("count"), F.max_by("same", F.coalesce("page_id", F.lit(-(1 << 63)))).alias("ties")).filter("count > 1")
    counts = work.save(counts, "warc-repeats")
    hot = hot_values(counts, "sha", slim.count())
    is_hot = F.col("sha").isin(hot) if hot else F.lit(False)

    def packed(batches):
        for b in batches:
            rows = zip(*[b.column(c).to_pylist() for c in ("page_id", "url", "payload", "sha")], strict=True)
            members = [record(i, u, p, digest=b32_sha1(bytes.fromhex(s[:40]))) for i, u, p, s in rows]
            sizes = pc.binary_length(b.column("payload")).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), b.column("sha"), sizes, pa.array(members, pa.binary())], ["page_id", "url", "sha", "bytes", "member"])

    def members(rows: DataFrame) -> DataFrame:
        return rows.mapInArrow(packed, "page_id long, url string, sha string, bytes long, member binary")

    known = counts.select("sha", "top", "ties")
    met = members(base.filter(~is_hot)).join(known.filter(~is_hot), "sha", "left")
    if hot:
        met = met.unionByName(members(base.filter(is_hot)).join(F.broadcast(known.filter(is_hot)), "sha", "left"))
    first = F.col("top").isNull() | F.col("page_id").eqNullSafe(F.col("top"))
    tied = F.col("top").isNotNull() & first & (F.col("ties") > 1)
    columns = ["page_id", "url", "sha", "bytes"]
    rows = met.filter(~tied).select(*columns, F.when(~first, F.col("top")).alias("refers_to"), F.when(first, F.col("member")).alias("member"))
    if not counts.filter("top IS NOT NULL AND ties > 1").isEmpty():
        # rows of one id, payload and url are counted, and one row of the least url answers for the payload
        like = met.filter(tied).groupBy(*columns).agg(F.first("member").alias("member"), F.count(F.lit(1)).alias("same"))
        like = like.withColumn("n", F.row_number().over(Window.partitionBy("sha").orderBy("url"))).select("*", F.explode(F.sequence(F.lit(1).cast("long"), "same")).alias("k"))
        one = (F.col("n") == 1) & (F.col("k") == 1)
        rows = rows.unionByName(like.select(*columns, F.when(~one, F.col("page_id")).alias("refers_to"), F.when(one, F.col("member")).alias("member")))

    def write(batches):
        fs, top_dir = _open(root)
        fs.create_dir(top_dir, recursive=True)
        name, out, n, size = "", None, 0, 0
        for b in batches:
            for r in b.to_pylist():
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, n, size = fs.open_output_stream(f"{top_dir}/{name}", compression=None), 0, 0
                data = r["member"] if r["refers_to"] is None else record(r["page_id"], r["url"], b"", r["refers_to"], digest=b32_sha1(bytes.fromhex(r["sha"][:40])), size=r["bytes"])
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= archive_bytes:
                    out.close()
                    out = None
                    yield _listed(name, n, size)
        if out is not None:
            out.close()
            yield _listed(name, n, size)

    def _listed(name, n, size):
        return pa.RecordBatch.from_arrays([pa.array([f"{root}/{name}"]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], ["archive", "records", "bytes"])

    with small_batches(spark):
        out = work.done(rows.mapInArrow(write, "archive string, records long, bytes long"), "warc-list")
    _sweep(spark, root, out)
    return out


def _sweep(spark, root: str, listed: DataFrame) -> None:
    """Delete the archives under root that the list doesn't name: what lost or repeated attempts left. The names come to the
    driver: one per archive of 64 MB."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return
    found = [x.getPath().getName() for x in fs.listStatus(path)]
    known = {r["archive"].rsplit("/", 1)[1] for r in listed.select("archive").toLocalIterator()}
    for name in found:
        if name.endswith(".warc.gz") and name not in known:
            delete_path(spark, f"{root}/{name}")


def read_archives(archives: DataFrame, keep_payload: bool = False) -> DataFrame:
    """The records of the listed archives: page_id, url, record_type, payload_digest, payload_bytes, refers_to[, payload].

    Archives of other makers are read alike; their records' ids, which aren't pages', give null. An empty list gives no rows.
    """
    schema = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long" + ", payload binary" * keep_payload

    def read(batches):
        names = [x.split()[0] for x in schema.split(", ")]
        types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
        of = pa.schema([(x.split()[0], types[x.split()[1]]) for x in schema.split(", ")])
        for b in batches:
            for path in b.column("archive").to_pylist():
                fs, name = _open(path)
                rows = []
                with fs.open_input_stream(name, compression=None) as stream:
                    for r in read_records(stream, keep_payload):
                        rows.append({k: r[k] for k in names})
                        if len(rows) >= (64 if keep_payload else 2000):
                            yield pa.RecordBatch.from_pylist(rows, of)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, of)

    lists = archives.select("archive")
    n = max(1, min(lists.count(), 10_000))
    return lists.repartition(n, "archive").mapInArrow(read, schema)


# ids are unique in the table; base32 takes 20 bits (5 hex digits) as 4 letters
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(h, CAST(5 * (j // 4) + 1 AS INTEGER), 5) AS BIGINT) >> (15 - 5 * (j % 4))) & 31) AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM d
"""
