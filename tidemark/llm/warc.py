"""WARC derivatives: metadata and plain-text conversion records of response records.

``responses`` writes a table of pages as WARC/1.1 response records; records of
real archives, one in each row, serve as well: chunked bodies are joined and
gzip and deflate undone. ``derive`` reads such records and makes two of each: a
``metadata`` record (title, language, links, the source's HTTP headers, its
identifier and digests) and a ``conversion`` record (the page's text). Both
refer to the response by WARC-Refers-To, to its address by WARC-Target-URI and
to its date by WARC-Date, and to one another by WARC-Concurrent-To; identifiers
are derived from the source's, so a task that runs again makes the same ones.
``serialized`` and ``parse`` are an exact round trip of a record. Pages are
read in one pass whose cost is linear in their length.

Defined results: a null or empty page is a response with an empty payload, and
its conversion an empty text; a null address is the empty string, and blanks
and control characters in an address are percent-encoded; a record that is no
response or cannot be read (its body, decoded, beyond ``LARGEST`` bytes or in
an encoding other than the named ones) yields one row of type ``invalid`` with
the reason as its text; a digest that does not fit the block or payload is
carried along and marked in ``digest_ok``; of a header that repeats in a record
the first counts, and HTTP headers are carried along each; rows that repeat, or
have no id, are derived each and have identifiers of their own; an empty table
gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches, materialize, small

#: Dates stand for when pages were fetched; tables without one get this.
DATE = "2024-01-01T00:00:00Z"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
#: Bytes of a decoded body at most.
LARGEST = 1 << 30

#: Elements whose content isn't text, and those that end a line.
HIDDEN = frozenset("script style noscript template svg".split())
BLOCKS = frozenset(
    "address article aside blockquote body br dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html li main nav ol option p pre section table tbody td tfoot th thead title tr ul".split()
)
NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9]*)")
SPECIAL = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
LONG_NUMBER = re.compile(r"&#0*([0-9]*);?")
LANGUAGE = re.compile(r"[A-Za-z0-9-]+")


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def urn(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, ' '.join(parts))}>"


def serialized(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return b"WARC/1.1\r\n" + head.encode() + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def fields(lines: list[str]) -> list[tuple[str, str]]:
    """Names and values of header lines; one that begins with a blank goes on with the one before."""
    out: list[tuple[str, str]] = []
    for line in lines:
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}".strip())
        elif line:
            name, _, value = line.partition(":")
            out.append((name.strip(), value.strip()))
    return out


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of a record; ValueError if it is none."""
    head, found, rest = record.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not found or not first.startswith("WARC/"):
        raise ValueError("no WARC record")
    headers: dict[str, str] = {}
    for name, value in fields(lines):
        headers.setdefault(name.lower(), value)
    if not headers.get("content-length", "").isdigit():
        raise ValueError("no content length")
    size = int(headers["content-length"])
    if len(rest) < size:
        raise ValueError("block is cut off")
    return headers, rest[:size]


def address(url: str) -> str:
    """An address without blanks and control characters."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url.strip())


def response_record(key: str, url: str, page: str, date: str, place: str = "") -> bytes:
    """``place`` tells records apart that are equal otherwise."""
    payload = page.encode("utf-8", "replace")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload
    headers = [
        ("WARC-Type", "response"),
        ("WARC-Record-ID", urn("response", key, url, sha1(payload), place)),
        ("WARC-Date", date),
        ("WARC-Target-URI", address(url)),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Block-Digest", sha1(block)),
        ("WARC-Payload-Digest", sha1(payload)),
    ]
    return serialized(headers, block)


class Page:
    """Text, title, language and links of a page, read from the left in one pass.

    No piece of the page is gone over again and again: closers that are known
    not to follow are not looked for once more, and quotes from which no tag
    came to an end are remembered.
    """

    def __init__(self, page: str):
        self.page, self.title, self.language, self.links = page, None, None, []
        self.lacking: set[str] = set()
        self.dead: set[int] = set()
        self.text = self.read()

    def find(self, what: str, start: int) -> int:
        """Where ``what`` follows, or -1."""
        if what in self.lacking:
            return -1
        at = self.page.find(what, start)
        if at < 0:
            self.lacking.add(what)
        return at

    def closer(self, name: str, start: int) -> re.Match | None:
        what = f"</{name}"
        if what in self.lacking:
            return None
        found = re.compile(rf"</{name}\s*>", re.I).search(self.page, start)
        if not found:
            self.lacking.add(what)
        return found

    def tag_end(self, start: int) -> int:
        """The end of a tag whose attributes begin at ``start``: behind the first > outside of quotes, or -1."""
        page, passed, at = self.page, [], start
        while m := SPECIAL.search(page, at):
            if m[0] == ">":
                return m.end()
            passed.append(m.start())
            if m.start() in self.dead or (end := page.find(m[0], m.end())) < 0:
                break
            at = end + 1
        self.dead.update(passed)
        return -1

    def read(self) -> str:
        page, out, done = self.page, [], 0
        last = page.rfind(">")
        at = page.find("<")
        while 0 <= at < last:
            end, name = self.markup(at)
            if end > at:
                out.append(page[done:at])
                if name in BLOCKS:
                    out.append("\n")
                done = end
            at = page.find("<", max(end, at + 1))
        out.append(page[done:])
        lines = (" ".join(x.split()) for x in unescaped("".join(out)).split("\n"))
        return "\n".join(x for x in lines if x)

    def markup(self, at: int) -> tuple[int, str]:
        """(end, element) of what stands at a <; the end is ``at`` if it is no markup."""
        page = self.page
        for opening, closing in (("<!--", "-->"), ("<![CDATA[", "]]>")):
            if page.startswith(opening, at) and (end := self.find(closing, at + len(opening))) >= 0:
                return end + len(closing), ""
        m = NAME.match(page, at + 1)
        if m is None and page[at + 1 : at + 2] not in ("!", "/", "?"):
            return at, ""
        end = self.tag_end(m.end()) if m else -1
        if end < 0:
            end = self.find(">", at + 1) + 1
            if not end:
                return at, ""
        if m is None:
            return end, ""
        name = m[2].lower()
        if not m[1]:
            if name in HIDDEN and (last := self.closer(name, end)):
                return last.end(), ""
            self.note(name, page[m.end() : end - 1], end)
        return end, name

    def note(self, name: str, attributes: str, end: int) -> None:
        """Keep what a metadata record tells of an opening tag."""
        if name == "title" and self.title is None and (last := self.closer(name, end)):
            self.title = " ".join(unescaped(self.page[end : last.start()]).split())
        elif name == "html" and self.language is None and (found := LANGUAGE.match(attribute(attributes, "lang") or "")):
            self.language = found[0]
        elif name == "a" and (link := attribute(attributes, "href")) is not None:
            self.links.append(" ".join(unescaped(link).split()))


def attribute(text: str, name: str) -> str | None:
    """The value of the first attribute of that name."""
    for m in ATTRIBUTE.finditer(text):
        if m[1].lower() == name and m[0] != m[1]:
            return next((v for v in m.groups()[1:] if v is not None), None)
    return None


def unescaped(text: str) -> str:
    """Character references resolved; numbers too long for a character give its replacement."""
    return html.unescape(LONG_NUMBER.sub(lambda m: m[0] if len(m[1]) < 8 else "\ufffd", text))


def plain_text(page: str) -> str:
    """The text of a page: no tags, comments or hidden elements, a line for each block, characters unescaped."""
    return Page(page).text


def joined_chunks(body: bytes) -> bytes:
    """A chunked body without its chunk sizes; ValueError if it isn't one."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at, at + 1024)
        size = int(body[at:end].split(b";")[0], 16) if end >= 0 else -1
        if size < 0 or end + 2 + size > len(body):
            raise ValueError("no chunked body")
        if not size:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size


def inflated(body: bytes, encoding: str) -> bytes:
    """A body without one content encoding."""
    if encoding in ("", "identity"):
        return body
    kinds = {"gzip": (31,), "x-gzip": (31,), "deflate": (15, -15)}.get(encoding)
    if kinds is None:
        raise ValueError(f"encoding {encoding}")
    for bits in kinds:
        stream = zlib.decompressobj(bits)
        try:
            out = stream.decompress(body, LARGEST)
        except zlib.error:
            continue
        if stream.unconsumed_tail:
            raise ValueError("body too large")
        return out
    raise ValueError(f"broken {encoding} body")


def page_of(block: bytes) -> tuple[list[tuple[str, str]], list[bytes], str]:
    """HTTP headers, the payload as stored and without chunks, and the decoded page of a response's block."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("no HTTP headers")
    lines = head.decode("latin-1").split("\r\n")
    headers = [(lines[0], ""), *fields(lines[1:])]
    value = {}
    for k, v in headers[1:]:
        value.setdefault(k.lower(), v)
    payloads = [body]
    if "chunked" in value.get("transfer-encoding", "").lower():
        try:
            payloads.append(joined_chunks(body))
        except ValueError:  # archives often keep the header of a body that they joined
            pass
    content = payloads[-1]
    for encoding in reversed(value.get("content-encoding", "").lower().split(",")):
        content = inflated(content, encoding.strip())
    found = re.search(r"charset=\"?([\w.:-]+)", value.get("content-type", ""), re.I)
    try:
        return headers, payloads, content.decode(found[1] if found else "utf-8", "replace")
    except (LookupError, ValueError):
        return headers, payloads, content.decode("utf-8", "replace")


COLUMNS = (
    "record_type string, record_id string, refers_to string, concurrent_to string, target_uri string, warc_date string, "
    "content_type string, block_digest string, source_block_digest string, source_payload_digest string, digest_ok boolean, content string"
)
NAMES = [x.split()[0] for x in COLUMNS.split(", ")]


def derived(record: bytes | None) -> list[tuple]:
    """The two rows, in the order of NAMES, that come of a response record."""
    try:
        headers, block = parse(record or b"")
        if headers.get("warc-type") != "response":
            raise ValueError(f"a {headers.get('warc-type')} record")
        http, payloads, raw = page_of(block)
    except ValueError as e:
        return [("invalid", *[None] * 9, False, str(e))]
    source, uri, date = (headers.get(k, "") for k in ("warc-record-id", "warc-target-uri", "warc-date"))
    given = [headers.get(k) for k in ("warc-block-digest", "warc-payload-digest")]
    held = ([block], payloads)
    fits = all(d is None or not d.startswith("sha1:") or d in map(sha1, xs) for d, xs in zip(given, held, strict=True))
    ids = {kind: urn(kind, source) for kind in ("metadata", "conversion")}
    page = Page(raw)
    facts = [("title", page.title or ""), ("language", page.language or ""), *(("outlink", link) for link in page.links)]
    facts += [("http-status", http[0][0])] + [(f"http-header-{k.lower()}", v) for k, v in http[1:]]
    facts += [("source-record-id", source), ("source-block-digest", given[0] or ""), ("source-payload-digest", given[1] or "")]
    contents = {
        "metadata": ("application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in facts)),
        "conversion": ("text/plain; charset=utf-8", page.text),
    }
    return [
        (kind, ids[kind], source, ids[other], uri, date, mime, sha1(text.encode("utf-8", "replace")), *given, fits, text)
        for (kind, (mime, text)), other in zip(contents.items(), ("conversion", "metadata"), strict=True)
    ]


def record_of(row: dict) -> bytes:
    """A derived row as a WARC record."""
    names = {
        "record_type": "WARC-Type",
        "record_id": "WARC-Record-ID",
        "refers_to": "WARC-Refers-To",
        "concurrent_to": "WARC-Concurrent-To",
        "target_uri": "WARC-Target-URI",
        "warc_date": "WARC-Date",
        "content_type": "Content-Type",
        "block_digest": "WARC-Block-Digest",
    }
    return serialized([(h, row[c]) for c, h in names.items()], row["content"].encode("utf-8", "replace"))


def placed(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """``(id, url, html, __place)``: a number of its own for each row whose id repeats, else null."""
    rows = pages.select(id_col, url_col, html_col, F.monotonically_increasing_id().alias("__at"))
    again = materialize(pages.groupBy(F.col(id_col).alias("__id")).agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    joined = rows.join(small(again.withColumn("__again", F.lit(True))), F.col(id_col).eqNullSafe(F.col("__id")), "left")
    return joined.select(id_col, url_col, html_col, F.when(F.col("__again"), F.col("__at")).alias("__place"))


def records_of(batch: pa.RecordBatch, date: str) -> list[bytes]:
    """The response records of a batch of ``placed`` rows."""
    columns = (batch.column(k).to_pylist() for k in range(4))
    return [response_record(str(i), u or "", t or "", date, "" if p is None else str(p)) for i, u, t, p in zip(*columns, strict=True)]


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE) -> DataFrame:
    """``(id, record)``: each page as a WARC response record."""

    def work():
        return lambda batch: {id_col: batch.column(0), "record": records_of(batch, date)}

    kind = pages.schema[id_col].dataType.simpleString()
    return map_batches(placed(pages, id_col, url_col, html_col), [id_col, url_col, html_col, "__place"], work, f"`{id_col}` {kind}, record binary")


def derived_rows(ids: pa.Array, records: list[bytes | None], id_col: str) -> dict:
    lists = [derived(r) for r in records]
    at = [i for i, rows in enumerate(lists) for _ in rows]
    columns = zip(*(r for rows in lists for r in rows), strict=True)
    return {id_col: ids.take(pa.array(at, pa.int64()))} | dict(zip(NAMES, map(list, columns), strict=True))


def derive(records: DataFrame, id_col: str = "page_id", record_col: str = "record") -> DataFrame:
    """``(id, ...)``: a metadata and a conversion row for each response record."""

    def work():
        return lambda batch: derived_rows(batch.column(0), batch.column(1).to_pylist(), id_col)

    kind = records.schema[id_col].dataType.simpleString()
    return map_batches(records, [id_col, record_col], work, f"`{id_col}` {kind}, {COLUMNS}")


def derive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE) -> DataFrame:
    """``derive(responses(pages))``, without the records' way to Spark and back."""

    def work():
        return lambda batch: derived_rows(batch.column(0), records_of(batch, date), id_col)

    kind = pages.schema[id_col].dataType.simpleString()
    return map_batches(placed(pages, id_col, url_col, html_col), [id_col, url_col, html_col, "__place"], work, f"`{id_col}` {kind}, {COLUMNS}")


def as_records(derivatives: DataFrame, id_col: str = "page_id") -> DataFrame:
    """``(id, record_id, record)``: derived rows as WARC records, ready to be written."""

    def work():
        def step(batch):
            rows = batch.to_pylist()
            return {id_col: batch.column(0), "record_id": [r["record_id"] for r in rows], "record": [record_of(r) for r in rows]}

        return step

    kind = derivatives.schema[id_col].dataType.simpleString()
    valid = derivatives.where(F.col("record_type") != "invalid")
    return map_batches(valid, [id_col, *NAMES], work, f"`{id_col}` {kind}, record_id string, record binary")
