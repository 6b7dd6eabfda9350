"""WARC derivatives: metadata and plain-text conversion records of responses.

A response record has an id, a target URI, a date, the WARC and HTTP header lines
and a payload. Each gives two records that refer to it (WARC-Refers-To): a
metadata record of WARC fields (the source's headers, its digests among them,
sizes, title, links), and a conversion record with the payload as plain text. Ids
derive from the response id and the record type, so a rerun makes the same
records. The block digest is SHA-256 of the block; the source digest is the one
the source record has, or else SHA-256 of the payload's bytes.

Ids, digests and records are DataFrame functions; pages are read by one linear
scan in Arrow batches. All references of HTML are decoded (in links those that
end in a semicolon). Links are those of ``a`` elements with any quoting, outside
comments, scripts and other raw text, resolved against the page's ``base`` or URI
where that is absolute.

Defined results: a null payload is empty and its records say so; a null URI,
date or header is the empty value; a comment, script or tag that is not closed
runs to the end; repeated responses give repeated records; further columns are
ignored. Of a damaged file the records before the damage are read; a record whose
length is missing or no number is left out, and so is a cut-off last one. A
payload is decoded from its transfer and content encoding (what can't be is taken
as it is) and by its charset, or else as UTF-8 with replacements.
"""

from __future__ import annotations

import codecs
import gzip
import hashlib
import io
import re
import zlib
from collections.abc import Iterator
from html import unescape
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectide.llm.common import slices
from vectide.llm.html import attributes_of
from vectide.sources.files import listed, opened, rows_of
from vectide.sources.tables import fresh

CRLF = "\r\n"

# Elements that break lines, and the patterns of the SQL, which knows
# the references and links of the driver's pages only.
_BREAKS = frozenset("address article aside blockquote br dd div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
_DROP = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>"
_BREAK = rf"(?i)</?(?:{'|'.join(sorted(_BREAKS))})\b[^>]*>"
_TAG = r"<[^>]*>"
_REFERENCES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]
_TITLE = r"(?is)<title\b[^>]*>(.*?)</title\s*>"
_LINK = r'(?i)<a\b[^>]*?\bhref="([^"]*)"'

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style|title|textarea|xmp)\b[^>]*>(.*?)(?:</\1\b[^>]*+(?:>|\Z)|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>|</?[a-zA-Z!?/][^>]*(?:>|\Z)""",
    re.S | re.I,
)
_SPACE = re.compile(r"[ \t\n\x0b\x0c\r]+")
_LINES = re.compile(r" *\n[ \n]*")
_SCHEME = re.compile(r"[a-zA-Z][a-zA-Z0-9+.-]*:")
_ROOT = re.compile(r"([a-zA-Z][a-zA-Z0-9+.-]*:)//[^/?#]+")


def decoded(text: str) -> str:
    """Text with its references decoded, in one pass; a no-break space is a space."""
    return unescape(text).replace("\xa0", " ") if "&" in text else text


def resolved(target: str, base: str) -> str:
    """An absolute form of a link, if the base is absolute."""
    root = _ROOT.match(base)
    if not root or _SCHEME.match(target):
        return target
    if target.startswith("//"):
        return root[1] + target
    if target.startswith("/") and "/." not in target:
        return root[0] + target
    try:
        return urljoin(base, target)
    except ValueError:
        return target


def read_page(page: str, uri: str = "") -> tuple[str, str, list[str]]:
    """(title, plain text, links) of a page.

    Plain text has line breaks at block tags, blank runs as one space, and no empty
    lines; the head, scripts, styles and comments are no text.
    """
    title: str | None = None
    base, links, pieces = uri, [], []
    at, in_head, has_base = 0, False, False
    for m in _TOKEN.finditer(page):
        if m.start() > at and not in_head:
            pieces.append(_SPACE.sub(" ", page[at : m.start()]))
        at = m.end()
        raw, name = m[1], m[4]
        if raw:
            raw = raw.lower()
            if raw == "title" and title is None:
                title = decoded(_SPACE.sub(" ", m[2])).strip(" ")
            elif raw in ("textarea", "xmp") and not in_head:
                pieces.append(_SPACE.sub(" ", m[2]))
            else:
                pieces.append(" ")
        elif name:
            name, end = name.lower(), bool(m[3])
            if name == "head" or name == "body":
                in_head = name == "head" and not end
                pieces.append(" ")
            elif name in _BREAKS and not in_head:
                pieces.append("\n")
            elif name in ("a", "base") and not end:
                target = attributes_of(m[5], decode).get("href")
                if target is not None:
                    target = re.sub(r"[\r\n\t]", "", target).strip(" ")
                    if name == "a":
                        links.append(target)
                    elif not has_base:
                        base, has_base = resolved(target, uri), True
        elif m[0].startswith("<!--"):
            pieces.append(" ")
    if at < len(page) and not in_head:
        pieces.append(_SPACE.sub(" ", page[at:]))
    text = _LINES.sub("\n", re.sub(" +", " ", decoded("".join(pieces))))
    return title or "", text.strip("\n").strip(" "), [resolved(t, base) for t in links]


_REFERENCE = re.compile(r"&(?:#\d+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);")


def decode(text: str) -> str:
    """An attribute's value: references that end in a semicolon are decoded."""
    return _REFERENCE.sub(lambda m: unescape(m[0]).replace("\xa0", " "), text) if "&" in text else text


def _with_pages(records: DataFrame, payload_col: str, uri_col: str, into: tuple[str, str, str]) -> DataFrame:
    """``records`` with title, plain text and links in place of the payload."""
    names = [c for c in records.columns if c != payload_col]
    schema = records.drop(payload_col).schema.add(into[0], "string").add(into[1], "string").add(into[2], T.ArrayType(T.StringType()))
    at, uri_at = records.columns.index(payload_col), records.columns.index(uri_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [read_page(p or "", u or "") for p, u in zip(batch.column(at).to_pylist(), batch.column(uri_at).to_pylist())]
            made = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.list_(pa.string())))]
            kept = [c for k, c in enumerate(batch.columns) if k != at]
            yield pa.RecordBatch.from_arrays([*kept, *made], names=[*names, *into])

    return records.mapInArrow(run, schema)


def record_id(*parts) -> F.Column:
    """``<urn:uuid:...>`` from a digest of the parts."""
    h = F.sha2(F.concat_ws("|", *parts), 256)
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in cuts]), F.lit(">"))


def digest(text) -> F.Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def responses(pages: DataFrame, uri_col: str = "url", payload_col: str = "html", keep: tuple[str, ...] = ("page_id",), date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Response records of a table of pages: ``keep``, ``record_id``, ``target_uri``,
    ``date``, ``http_headers``, ``payload``."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    uri = F.coalesce(F.col(uri_col), F.lit(""))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(payload).cast("string"))
    return pages.select(*keep, record_id(F.lit("response"), uri, F.sha2(payload, 256)).alias("record_id"), uri.alias("target_uri"), F.lit(date).alias("date"), head.alias("http_headers"), payload.alias("payload"))


def derive(records: DataFrame, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Two rows a response: ``keep``, ``warc_type``, ``record_id``, ``refers_to``,
    ``target_uri``, ``date``, ``content_type``, ``source_digest``,
    ``block_digest``, ``content_length``, ``block``.

    ``warc_headers`` and ``payload_digest`` are used where the records have them.
    """
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    own = F.col("payload_digest") if "payload_digest" in records.columns else F.lit(None).cast("string")
    names = [fresh(c, records) for c in ("__uri", "__payload", "__digest", "__size", "__http", "__warc", "__title", "__plain", "__links")]
    uri, payload, source_digest, size, http, warc, title, plain, outlinks = names
    some = records.select(
        *keep,
        F.col("record_id").alias("refers_to"),
        empty("date").alias("date"),
        empty("target_uri").alias(uri),
        F.coalesce(own, digest(empty("payload"))).alias(source_digest),
        F.octet_length(empty("payload")).cast("string").alias(size),
        empty("http_headers").alias(http),
        (empty("warc_headers") if "warc_headers" in records.columns else F.lit("")).alias(warc),
        empty("payload").alias(payload),
    )
    read = _with_pages(some, payload, uri, (title, plain, outlinks))
    lines = lambda name, values: F.array_join(F.transform(values, lambda v: F.concat(F.lit(f"{name}: "), v, F.lit(CRLF))), "")
    fields = F.concat(
        F.when(F.col(warc) == "", "").otherwise(lines("warc-header", F.split(warc, CRLF))),
        lines("http-header", F.split(http, CRLF)),
        F.lit("payload-length: "), F.col(size), F.lit(CRLF),
        F.lit("payload-digest: "), F.col(source_digest), F.lit(CRLF),
        F.lit("title: "), F.col(title), F.lit(CRLF),
        lines("outlink", F.col(outlinks)),
    )
    kinds = F.array(
        F.struct(F.lit("metadata").alias("warc_type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("warc_type"), F.lit("text/plain").alias("content_type"), F.col(plain).alias("block")),
    )
    both = read.select(*keep, "refers_to", "date", uri, source_digest, F.explode(kinds).alias("x"))
    block = F.col("x.block")
    return both.select(
        *keep,
        F.col("x.warc_type").alias("warc_type"),
        record_id(F.col("x.warc_type"), F.col("refers_to")).alias("record_id"),
        "refers_to",
        F.col(uri).alias("target_uri"),
        "date",
        F.col("x.content_type").alias("content_type"),
        F.col(source_digest).alias("source_digest"),
        digest(block).alias("block_digest"),
        F.octet_length(block).cast("long").alias("content_length"),
        block.alias("block"),
    )


def serialise(derived: DataFrame) -> DataFrame:
    """One column ``record``: each derived record as a WARC/1.1 record."""
    heads = [
        ("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "date"),
        ("Content-Type", "content_type"), ("WARC-Source-Payload-Digest", "source_digest"), ("WARC-Block-Digest", "block_digest"), ("Content-Length", "content_length"),
    ]
    lines = [F.concat(F.lit(f"{name}: "), F.col(c).cast("string"), F.lit(CRLF)) for name, c in heads]
    return derived.select(F.concat(F.lit(f"WARC/1.1{CRLF}"), *lines, F.lit(CRLF), "block", F.lit(CRLF * 2)).alias("record"))


_LONGEST_LINE = 1 << 16


def parse(source: bytes | io.IOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record of a WARC file, gzipped
    or not, as far as it can be read. Continued header lines are joined."""
    stream = io.BufferedReader(io.BytesIO(source) if isinstance(source, bytes) else source)
    if stream.peek(2)[:2] == b"\x1f\x8b":
        stream = gzip.GzipFile(fileobj=stream)  # gives what it has before it meets damage
    try:
        while line := stream.readline(_LONGEST_LINE):
            if not line.startswith(b"WARC/"):
                continue
            fields: dict[str, str] = {}
            name = ""
            while (line := stream.readline(_LONGEST_LINE)).strip():
                text = line.decode("utf-8", "replace")
                if text[0] in " \t" and name:
                    fields[name] += " " + text.strip()
                    continue
                name, _, value = text.partition(":")
                name = name.strip().lower()
                fields.setdefault(name, value.strip())
            size = fields.get("content-length", "")
            if not (size.isascii() and size.isdigit()):
                continue
            block = stream.read(int(size))
            if len(block) == int(size):
                yield fields, block
    except (EOFError, OSError, zlib.error):
        return


def _dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            size = int(body[at : end if end >= 0 else at].split(b";")[0], 16)
        except ValueError:
            return body  # not chunked after all, or cut off
        if size == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size


def content(head: str, body: bytes) -> str:
    """The text of an HTTP body: transfer and content encodings undone, then decoded."""
    held: dict[str, str] = {}
    for line in head.split("\n")[1:]:
        name, _, value = line.partition(":")
        held.setdefault(name.strip().lower(), value.strip().lower())
    if "chunked" in held.get("transfer-encoding", ""):
        body = _dechunked(body)
    kind = held.get("content-encoding", "")
    if kind in ("gzip", "x-gzip", "deflate"):
        for bits in (47, -15):  # with a header of either kind, or none
            try:
                body = zlib.decompressobj(bits).decompress(body)
                break
            except zlib.error:
                continue
    named = re.search(r"charset=[\"']?([^\s;\"']+)", held.get("content-type", "")) or re.search(rb"""<meta[^>]{0,200}?charset=["']?([^\s;"'/>]{1,40})""", body[:2048], re.I)
    charset = (named[1].decode("ascii", "replace") if isinstance(named[1], bytes) else named[1]) if named else "utf-8"
    try:
        charset = codecs.lookup(charset).name
        return body.decode(charset, "replace")
    except (LookupError, ValueError):
        return body.decode("utf-8", "replace")


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Response records of the WARC files at ``path``, as ``responses`` gives them
    (with ``file`` in place of kept columns), and ``warc_headers``,
    ``payload_digest``: the source's, or SHA-256 of the payload's bytes as stored.

    A task reads its files as streams, a record at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file in rows_of(batches):
            system, place = opened(file["path"])
            with system.open_input_stream(place, compression=None) as raw:
                for fields, block in parse(raw):
                    if fields.get("warc-type", "").lower() != "response":
                        continue
                    head, _, payload = block.partition(b"\r\n\r\n")
                    head = head.decode("latin-1")
                    own = fields.get("warc-payload-digest") or "sha256:" + hashlib.sha256(payload).hexdigest()
                    headers = CRLF.join(f"{k}: {v}" for k, v in fields.items())
                    row = {"file": file["path"], "record_id": fields.get("warc-record-id", ""), "target_uri": fields.get("warc-target-uri", ""), "date": fields.get("warc-date", ""), "http_headers": head}
                    yield pa.RecordBatch.from_pylist([row | {"payload": content(head, payload), "warc_headers": headers, "payload_digest": own}])

    schema = "file string, record_id string, target_uri string, date string, http_headers string, payload string, warc_headers string, payload_digest string"
    return listed(spark, path).mapInArrow(run, schema)


def _sql_digest(x: str) -> str:
    return f"'sha256:' || sha256({x})"


def _sql_id(x: str) -> str:
    h = f"sha256({x})"
    return f"'<urn:uuid:' || substr({h},1,8) || '-' || substr({h},9,4) || '-' || substr({h},13,4) || '-' || substr({h},17,4) || '-' || substr({h},21,12) || '>'"


def _sql_quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _sql_decoded(text: str) -> str:
    for name, value in _REFERENCES:
        text = f"replace({text}, {_sql_quote(name)}, {_sql_quote(value)})"
    return text


def _sql_resolved(u: str) -> str:
    root = "regexp_extract(target_uri, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+')"
    return f"case when starts_with({u}, '/') and not starts_with({u}, '//') then {root} || {u} else {u} end"


def _sql_plain() -> str:
    text = f"regexp_replace(payload, {_sql_quote(_DROP)}, ' ', 'g')"
    text = rf"regexp_replace({text}, '\s+', ' ', 'g')"
    text = f"regexp_replace({text}, {_sql_quote(_BREAK)}, chr(10), 'g')"
    text = _sql_decoded(f"regexp_replace({text}, {_sql_quote(_TAG)}, '', 'g')")
    text = f"regexp_replace({text}, ' +', ' ', 'g')"
    return rf"trim(regexp_replace(regexp_replace({text}, ' *\n[ \n]*', chr(10), 'g'), '^\n|\n$', '', 'g'))"


#: The query ``derive(responses(pages))`` in SQL.
SQL = rf"""
with source as (
  select page_id, coalesce(url, '') as target_uri, coalesce(html, '') as payload from pages
), response as (
  select *, {_sql_id("'response|' || target_uri || '|' || sha256(payload)")} as refers_to from source
), both_kinds as (
  select page_id, refers_to, target_uri, payload, 'metadata' as warc_type, 'application/warc-fields' as content_type,
    'http-header: HTTP/1.1 200 OK' || chr(13) || chr(10) || 'http-header: Content-Type: text/html; charset=utf-8' || chr(13) || chr(10)
    || 'http-header: Content-Length: ' || strlen(payload) || chr(13) || chr(10)
    || 'payload-length: ' || strlen(payload) || chr(13) || chr(10) || 'payload-digest: ' || {_sql_digest("payload")} || chr(13) || chr(10)
    || 'title: ' || trim({_sql_decoded(f"regexp_replace(regexp_extract(payload, {_sql_quote(_TITLE)}, 1), '{chr(92)}s+', ' ', 'g')")}) || chr(13) || chr(10)
    || coalesce(array_to_string(['outlink: ' || {_sql_resolved('u')} || chr(13) || chr(10) for u in regexp_extract_all(payload, {_sql_quote(_LINK)}, 1)], ''), '') as block
  from response
  union all
  select page_id, refers_to, target_uri, payload, 'conversion', 'text/plain', {_sql_plain()} from response
)
select page_id, warc_type, {_sql_id("warc_type || '|' || refers_to")} as record_id, refers_to, target_uri,
  '1970-01-01T00:00:00Z' as date, content_type, {_sql_digest("payload")} as source_digest, {_sql_digest("block")} as block_digest,
  cast(strlen(block) as bigint) as content_length, block
from both_kinds
"""
