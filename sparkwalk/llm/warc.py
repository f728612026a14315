"""WARC derivatives: responses become linked metadata and plain-text conversion records.

From each response two records are derived.  The metadata record (``application/warc-fields``) keeps what the
conversion drops: the status line and every HTTP header of the source, its record id, and the digests of its block and
payload.  The conversion record holds the shown text of an HTML payload.  Both carry the target URI and date of
the response and name it in ``WARC-Refers-To``; the metadata record also names the conversion.  Record ids are made from
the source's id and the kind of derivative, so a repeated run, or task, gives the same records.

Defined results: records that are no responses, or have no id, give nothing; a response whose block has no header
end is all header; a payload that is null, empty or not HTML gives an empty conversion text, one of another text
type its text; a null URI or date leaves its line out; bytes that are not UTF-8 are replaced in the text, never
in digests; repeated responses give repeated derivatives; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from sparkwalk.llm.common import map_batches
from sparkwalk.llm.html import plain_text

VERSION = b"WARC/1.1"
SPACE_OF_IDS = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122


def digest(data: bytes) -> str:
    return "sha256:" + hashlib.sha256(data).hexdigest()


def derived_id(source: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE_OF_IDS, f'{kind} of {source}')}>"


def one_line(value: str) -> str:
    """A header value; line ends would start another header."""
    return re.sub(r"[\r\n]+", " ", value)


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers in order, payload of an HTTP response block; folded header lines are joined."""
    head, _, payload = block.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    headers: list[tuple[str, str]] = []
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and headers:
            headers[-1] = (headers[-1][0], f"{headers[-1][1]} {line.strip()}")
        elif ":" in line:
            name, value = line.split(":", 1)
            headers.append((name.strip(), value.strip()))
    return lines[0], headers, payload


def as_text(payload: bytes, headers: list[tuple[str, str]]) -> str:
    kind = next((v for n, v in headers if n.lower() == "content-type"), "").lower()
    charset = re.search(r"charset=[\"']?([\w.:-]+)", kind)
    try:
        told = payload.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        told = payload.decode("utf-8", "replace")
    if "html" in kind:
        return plain_text(told)
    return told if kind.startswith("text/") else ""


def serialise(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """One record: version line, headers (null ones left out), block."""
    lines = [f"{n}: {one_line(v)}".encode() for n, v in [*headers, ("Content-Length", str(len(block)))] if v is not None]
    return b"\r\n".join([VERSION, *lines, b"", block, b"", b""])


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a serialised record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines)
    length = int(headers["Content-Length"])
    if version.encode() != VERSION or rest[length:] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    return headers, rest[:length]


def derivatives(source_id: str, uri: str | None, date: str | None, block: bytes) -> list[tuple[str, str, bytes]]:
    """(kind, record id, serialised record) of the two derivatives of one response."""
    status, headers, payload = split_http(block)
    meta_id, text_id = derived_id(source_id, "metadata"), derived_id(source_id, "conversion")
    text = as_text(payload, headers).encode("utf-8", "surrogatepass")
    told = [
        ("source-record-id", source_id), ("source-block-digest", digest(block)), ("source-payload-digest", digest(payload)),
        ("source-payload-length", str(len(payload))), ("conversion-record-id", text_id), ("source-status", status),
        *[("source-header", f"{n}: {v}") for n, v in headers],
    ]
    fields = "".join(f"{n}: {one_line(v)}\r\n" for n, v in told).encode("utf-8", "surrogatepass")
    out = []
    for kind, own, mime, body in (
        ("metadata", meta_id, "application/warc-fields", fields), ("conversion", text_id, "text/plain; charset=utf-8", text)
    ):
        lines = [
            ("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Refers-To", source_id), ("WARC-Target-URI", uri), ("WARC-Date", date),
            ("WARC-Block-Digest", digest(body)), ("Content-Type", mime),
        ]
        out.append((kind, own, serialise(lines, body)))
    return out


def build(
    records: DataFrame, key: str = "page_id", tell: Callable[[bytes], tuple] | None = None, told: dict[str, str] | None = None
) -> DataFrame:
    """(key, warc_type, record_id, refers_to, record) of the derivatives.

    ``records`` has key, warc_type, record_id, target_uri, warc_date and block (the HTTP response, bytes).  With
    ``tell`` the columns ``told`` (name: type), made from each record in the task that built it, stand in its place.
    """
    names = ["key", "warc_type", "record_id", "refers_to", *(told or ["record"])]

    def run(batch):
        rows = []
        for k, source, uri, date, block in zip(*(batch.column(c).to_pylist() for c in ("key", "record_id", "target_uri", "warc_date", "block"))):
            rows += [(k, kind, own, source, *(tell(record) if tell else (record,))) for kind, own, record in derivatives(source, uri, date, block or b"")]
        return dict(zip(names, zip(*rows))) if rows else {n: [] for n in names}

    asked = records.filter((F.col("warc_type") == "response") & F.col("record_id").isNotNull()).select(
        F.col(key).cast("long").alias("key"), "record_id", "target_uri", F.col("warc_date").cast("string").alias("warc_date"), "block"
    )
    kinds = {"key": "long", "warc_type": "string", "record_id": "string", "refers_to": "string", **(told or {"record": "binary"})}
    return map_batches(asked, run, kinds).withColumnRenamed("key", key)


def responses(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Pages (page_id, url, html) as response records; the id is made of all three."""
    body = F.coalesce(F.col("html"), F.lit(""))
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    whole = F.sha2(F.concat_ws("\n", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit("")), body), 256)
    part = lambda a, n: F.substring(whole, a, n)
    name = F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("8"), part(14, 3)), F.concat(F.lit("8"), part(18, 3)), part(21, 12))
    return pages.select(
        "page_id", F.lit("response").alias("warc_type"), F.concat(F.lit("<urn:uuid:"), name, F.lit(">")).alias("record_id"),
        F.col("url").alias("target_uri"), F.lit(date).alias("warc_date"), F.encode(F.concat(head, body), "utf-8").alias("block"),
    )
