"""WARC derivatives: response records become linked metadata and plain-text
conversion records.

Both derivatives name the response they come from (WARC-Refers-To), keep its
target URI, date and payload digest, and carry a record id and a block digest
of their own. The metadata record lists the HTTP status line and headers and
the page's title and links count; the conversion record holds the text.

Records are kept as a Parquet column (key, record) or as WARC files: whole
records, one after the other, gzipped, a bounded number to a file.

Defined results: a null URL or body is empty; a null date is ``DATE``; a record
that is not a response or cannot be parsed yields no derivative, and in an index a
row with its key alone; a response's id follows from its key, URL, date and payload, so
equal responses yield equal derivatives and others do not share an id; an empty
table yields none; a WARC file ends where a record cannot be parsed.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transitrisk.llm.common import stored

EOL = b"\r\n"
DATE = "2024-01-01T00:00:00Z"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL namespace of RFC 4122
RECORD_SCHEMA = "key long, record binary"

_DROPPED = re.compile(r"<!--.*?-->|<(script|style|template|noscript)\b[^>]*>.*?</\1\s*>", re.I | re.S)
_BREAKS = re.compile(r"</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|"
                     r"html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>", re.I)
_TAGS = re.compile(r"<[!/?a-zA-Z][^>]*>")
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title", re.I | re.S)
_LINKS = re.compile(r"<a\s[^>]*\bhref\s*=", re.I)
_BLANKS = re.compile(r"[^\S\n]+")


def html_text(page: str) -> str:
    """Visible text: one line per block, blanks collapsed, no empty lines."""
    text = _TAGS.sub("", _BREAKS.sub("\n", _DROPPED.sub("", page)))
    lines = (_BLANKS.sub(" ", line).strip() for line in html.unescape(text).split("\n"))
    return "\n".join(line for line in lines if line)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def build_record(kind: str, record_id: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}",
             *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + EOL + EOL + block + EOL + EOL


def parse_record(record: bytes) -> tuple[dict[str, str], bytes] | None:
    head, found, rest = record.partition(EOL + EOL)
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        return None
    headers = dict((k.strip(), v.strip()) for k, _, v in (line.partition(":") for line in lines[1:]))
    size = headers.get("Content-Length", "")
    if not size.isdigit() or len(rest) < int(size):
        return None
    return headers, rest[:int(size)]


def responses(pages: DataFrame, id_col="page_id", url_col="url", html_col="html", date_col: str | None = None) -> DataFrame:
    """(key, record): a response record per page; ``date_col`` holds the time of capture."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, url, page, date in zip(*(batch[c].to_pylist() for c in ("key", "url", "html", "date"))):
                url, body = _one_line(url or ""), (page or "").encode()
                block = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                         b"Content-Length: %d\r\n\r\n" % len(body)) + body
                payload = digest(body)
                record_id = f"<{uuid.uuid5(NAMESPACE, f'{key} {date} {payload} {url}').urn}>"
                out.append(build_record("response", record_id, [
                    ("WARC-Target-URI", url), ("WARC-Date", date), ("WARC-Payload-Digest", payload),
                    ("WARC-Block-Digest", digest(block)),
                    ("Content-Type", "application/http; msgtype=response")], block))
            yield pa.RecordBatch.from_arrays([batch["key"], pa.array(out, pa.binary())], ["key", "record"])

    date = F.lit(DATE)
    if date_col is not None:
        date = F.coalesce(F.date_format(F.col(date_col).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'"), date)
    src = pages.select(F.col(id_col).cast("long").alias("key"), F.col(url_col).alias("url"), F.col(html_col).alias("html"),
                       date.alias("date"))
    return src.mapInArrow(run, RECORD_SCHEMA)


def _one_line(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value)


def derive(record: bytes) -> list[bytes]:
    """The metadata and the conversion record of a response record."""
    parsed = parse_record(record)
    if parsed is None or parsed[0].get("WARC-Type") != "response":
        return []
    headers, block = parsed
    http, found, body = block.partition(EOL + EOL)
    if not found:
        http, body = b"", block
    page = body.decode("utf-8", "replace")
    source = headers.get("WARC-Record-ID", "")
    links = [("WARC-Refers-To", source), ("WARC-Refers-To-Target-URI", headers.get("WARC-Target-URI", "")),
             ("WARC-Refers-To-Date", headers.get("WARC-Date", "")), ("WARC-Target-URI", headers.get("WARC-Target-URI", "")),
             ("WARC-Date", headers.get("WARC-Date", ""))]
    payload = headers.get("WARC-Payload-Digest") or digest(body)
    title = _TITLE.search(page)
    fields = [("source-payload-digest", payload), ("source-block-digest", headers.get("WARC-Block-Digest") or digest(block)),
              *(("http-header", line) for line in http.decode("utf-8", "replace").split("\r\n") if line),
              ("title", _one_line(html.unescape(title[1]).strip()) if title else ""),
              ("links", str(len(_LINKS.findall(page))))]
    meta = "".join(f"{k}: {v}\r\n" for k, v in fields).encode()
    text = html_text(page).encode("utf-8", "surrogatepass")
    out = []
    for kind, content_type, data in (("metadata", "application/warc-fields", meta), ("conversion", "text/plain", text)):
        record_id = f"<{uuid.uuid5(NAMESPACE, f'{kind} {source}').urn}>"
        out.append(build_record(kind, record_id, [
            *links, ("WARC-Source-Payload-Digest", payload), ("WARC-Block-Digest", digest(data)),
            ("Content-Type", content_type)], data))
    return out


def derivatives(records: DataFrame) -> DataFrame:
    """(key, record): two records for every response of (key, record)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, at = [], []
            for i, record in enumerate(batch["record"].to_pylist()):
                made = derive(record) if record else []
                out += made
                at += [i] * len(made)
            yield pa.RecordBatch.from_arrays([batch["key"].take(pa.array(at, pa.int64())), pa.array(out, pa.binary())],
                                             ["key", "record"])

    return records.select("key", "record").mapInArrow(run, RECORD_SCHEMA)


INDEX_SCHEMA = ("key long, record_type string, record_id string, refers_to string, target_uri string, warc_date string, "
                "source_digest string, block_digest string, digest_ok boolean, content_length long, text_sha256 string")


def read_index(records: DataFrame) -> DataFrame:
    """One row per record, read back from its bytes; the block digest is checked. What is
    no record keeps its key, all else null."""
    names = [c.split()[0] for c in INDEX_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, record in zip(batch["key"].to_pylist(), batch["record"].to_pylist()):
                parsed = parse_record(record) if record else None
                if parsed is None:
                    rows.append((key, *[None] * (len(names) - 1)))
                    continue
                h, block = parsed
                rows.append((key, h.get("WARC-Type"), h.get("WARC-Record-ID"), h.get("WARC-Refers-To"),
                             h.get("WARC-Target-URI"), h.get("WARC-Date"), h.get("WARC-Source-Payload-Digest"),
                             h.get("WARC-Block-Digest"), digest(block) == h.get("WARC-Block-Digest"), len(block),
                             hashlib.sha256(block).hexdigest()))
            kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
            cols = list(zip(*rows)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, kinds[s.split()[1]]) for c, s in zip(cols, INDEX_SCHEMA.split(", "))], names)

    return records.mapInArrow(run, INDEX_SCHEMA)


def build_derivatives(pages: DataFrame, **kw) -> DataFrame:
    """Pages -> responses -> derivatives, written as one table of records."""
    return stored(derivatives(responses(pages, **kw)), "warc-derivatives")


def write_warc(records: DataFrame, path: str, per_file: int = 10_000) -> str:
    """(key, record) as gzipped WARC files of at most ``per_file`` records each; null records are left out."""
    # the bytes as they are: a record ends in a line feed, which the writer adds
    block = F.col("record").substr(F.lit(1), F.length("record") - 1).cast("string")
    (records.where("record IS NOT NULL").select(block.alias("value"))
     .write.option("lineSep", "\n").option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path))
    return path


def split_records(data: bytes) -> Iterator[bytes]:
    """The records of a WARC file, found by their stated lengths."""
    at = 0
    while at < len(data):
        head = data.find(EOL + EOL, at)
        size = re.search(rb"(?i)\r\ncontent-length:[ \t]*(\d+)[ \t]*(?=\r\n|$)", data[at:head]) if head > 0 else None
        if size is None or not data.startswith(b"WARC/", at):
            return
        end = head + 4 + int(size[1])
        if data[end:end + 4] != EOL + EOL:
            return
        yield data[at:end + 4]
        at = end + 4


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(key, record) of WARC files, plain or gzipped (also a record at a time): the key is
    the record's place in its file. A task holds one file."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = batch["content"][i].as_py()
                found = list(split_records(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data))
                for k in range(0, len(found), 1000):
                    part = found[k:k + 1000]
                    yield pa.RecordBatch.from_arrays([pa.array(range(k, k + len(part)), pa.int64()), pa.array(part, pa.binary())],
                                                     ["key", "record"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD_SCHEMA)
