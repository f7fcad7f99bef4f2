"""WARC files, and derivatives of their responses: linked metadata and plain-text conversion records.

For each response record the builder makes two records with ids of their own that name the response in WARC-Refers-To and keep
its target URI and date:
    metadata    application/warc-fields: the source's digests, status, headers, title, language and outlinks
    conversion  text/plain: the text of its HTML
Both carry the source's payload digest (WARC-Source-Payload-Digest) and their own block digest. Ids are name-based
UUIDs of kind, source and digest, so that a repeated run gives the same records. Files are gzipped by record; a task writes one
under a name of its own and renames it when it is whole.

Text of HTML: scripts, styles, templates, comments and the title are left out; block elements end a line; references are resolved; blanks
are collapsed and empty lines dropped. An unclosed comment or script reaches to the end. A page takes time as its length does, however broken it
is; a `<` behind the last `>` is a letter, and so is a quote that is closed there only.

Defined cases: a null or empty page is a response with an empty payload, and its conversion record is empty; a null url leaves
WARC-Target-URI and relative outlinks out; a null page_id leaves Page-Id out; repeated pages give records each, with equal ids; an empty table gives
no file and no records; other columns are left out, whatever their names; line breaks in header values become blanks. A page of any length is
one record, held whole by one task; pages are taken in hand AT_ONCE rows or BYTES_AT_ONCE at a time.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import io
import itertools
import re
import uuid
import zlib
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import BYTES_AT_ONCE, column, filesystem, fresh_dir, slices, table

RECORDS = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("block", pa.binary())])
RECORDS_SQL = "record_id string, type string, headers map<string,string>, block binary"
AT_ONCE = 500
LEVEL = 1
#: WARC-Date of pages that come without one.
DATE = "2024-01-01T00:00:00Z"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*of: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(map(str, of)))}>"


def encoded(headers: dict[str, str], block: bytes) -> bytes:
    """A record as it stands in a file, before compression. Content-Length is added."""
    lines = [f"{k}: {' '.join(str(v).split())}" for k, v in headers.items() if k != "Content-Length"]
    return "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def decoded(stream):
    """(headers, block) of each record of an uncompressed stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:40]!r}")
        headers: dict[str, str] = {}
        last = None
        while (line := stream.readline()).strip():
            if line[:1] in b" \t" and last:  # a folded line
                headers[last] += " " + line.decode("utf-8", "replace").strip()
                continue
            last, _, value = line.decode("utf-8", "replace").partition(":")
            headers[last] = value.strip()
        length = int(headers["Content-Length"])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError("the file ends inside a record")
        yield headers, block


def _batch(rows: list[tuple[dict[str, str], bytes]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([h["WARC-Record-ID"] for h, _ in rows], pa.string()), pa.array([h["WARC-Type"] for h, _ in rows], pa.string()), pa.array([list(h.items()) for h, _ in rows], RECORDS.field("headers").type), pa.array([b for _, b in rows], pa.binary())], schema=RECORDS)


def _batches(rows):
    """Rows (headers, block) as record batches of up to AT_ONCE rows; one is full once it holds BYTES_AT_ONCE."""
    part, size = [], 0
    for row in rows:
        part.append(row)
        size += len(row[1])
        if len(part) == AT_ONCE or size >= BYTES_AT_ONCE:
            yield _batch(part)
            part, size = [], 0
    if part:
        yield _batch(part)


def _responses(batches):
    for batch in batches:
        at = 0
        for bodies in slices(batch.column(2), AT_ONCE):
            pages, urls = (batch.column(c).slice(at, len(bodies)).to_pylist() for c in range(2))
            at += len(bodies)
            for page, url, body in zip(pages, urls, bodies.to_pylist(), strict=True):
                payload = (body or "").encode("utf-8", "surrogatepass")
                block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
                own = digest(payload)
                headers = {"WARC-Type": "response", "WARC-Record-ID": record_id("response", page, url, own), "WARC-Date": DATE}
                headers |= {"WARC-Target-URI": url} if url is not None else {}
                headers |= {"Page-Id": str(page)} if page is not None else {}
                yield headers | {"Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": own, "WARC-Block-Digest": digest(block)}, block


def _pages(pages: DataFrame, page_id: str, url: str, body: str) -> DataFrame:
    return pages.select(column(page_id).cast("long"), column(url).cast("string"), column(body).cast("string"))


def responses(pages: DataFrame, page_id: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """Response records (record_id, type, headers, block) of a table of pages."""
    return _pages(pages, page_id, url, body).mapInArrow(lambda batches: _batches(_responses(batches)), RECORDS_SQL)


def _written(rows, folder: str):
    """Writes rows (headers, block) to a file of this task; its line of the manifest, if there are any."""
    from pyspark import TaskContext

    fs, top = filesystem(folder)
    name, out, n = f"part-{TaskContext.get().partitionId():08d}.warc.gz", None, 0
    part = f"{top}/{name}.{uuid.uuid4().hex}.part"
    for headers, block in rows:
        if out is None:
            fs.create_dir(top, recursive=True)
            out = fs.open_output_stream(part, compression=None)
        out.write(gzip.compress(encoded(headers, block), LEVEL, mtime=0))
        n += 1
    if out is not None:
        out.close()
        fs.move(part, f"{top}/{name}")
        yield pa.record_batch({"path": pa.array([f"{folder}/{name}"]), "records": pa.array([n], pa.int64())})


def _rows(batches, headers: int, block: int):
    for batch in batches:
        at = 0
        for blocks in slices(batch.column(block), AT_ONCE):
            heads = batch.column(headers).slice(at, len(blocks)).to_pylist()
            at += len(blocks)
            yield from ((dict(h), b) for h, b in zip(heads, blocks.to_pylist(), strict=True))


MANIFEST = "path string, records long"


def write_responses(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """As write_warc of responses, with the records passing from one to the other inside the tasks."""
    return table(_pages(pages, page_id, url, body).mapInArrow(lambda batches: _written(_responses(batches), folder), MANIFEST), "manifest")


def write_warc(records: DataFrame, folder: str) -> DataFrame:
    """Writes records as they are dealt, a gzipped file a partition; gives the manifest: path, records."""
    return table(records.select("headers", "block").mapInArrow(lambda batches: _written(_rows(batches, 0, 1), folder), MANIFEST), "manifest")


def members(raw, most: int = 64 << 20):
    """The decompressed members of a gzip stream, one at a time; raises for one larger than most."""
    data = raw.read(1 << 20)
    while data:
        one, parts, size = zlib.decompressobj(31), [], 0
        while not one.eof:
            if not data and not (data := raw.read(1 << 20)):
                raise ValueError("the file ends inside a record")
            parts.append(one.decompress(data))
            data = one.unused_data
            if (size := size + len(parts[-1])) > most:
                raise OverflowError
        yield b"".join(parts)
        data = data or raw.read(1 << 20)


def records_of(open_file):
    """(headers, block) of a gzipped file. Files with one member for many records are read as a stream."""
    n = 0
    try:
        with open_file() as raw:
            for member in members(raw):
                for row in decoded(io.BytesIO(member)):
                    yield row
                    n += 1
    except OverflowError:
        with open_file() as raw, gzip.GzipFile(fileobj=raw) as stream:
            yield from itertools.islice(decoded(stream), n, None)


def _read(batches):
    for batch in batches:
        for path in batch.column(0).to_pylist():
            fs, at = filesystem(path)
            yield from records_of(lambda fs=fs, at=at: fs.open_input_stream(at, compression=None))


def _files(manifest: DataFrame) -> DataFrame:
    """The paths, a task for each."""
    return manifest.select("path").repartitionByRange(max(1, manifest.count()), "path")


def read_warc(manifest: DataFrame) -> DataFrame:
    """The records of the files of a manifest (path); a task per file."""
    return _files(manifest).mapInArrow(lambda batches: _batches(_read(batches)), RECORDS_SQL)


#: Elements whose content is no text, and those that end a line.
_SILENT = "script|style|noscript|template|title"
_LINES = frozenset("address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol option p pre section table td th tr ul body head html".split())
#: A quote opens a value after = only, of any length; one that is never closed is a letter like others. A tag without an end outside of quoted values is loose: it ends at the next >.
_OTHER = rf"<!--.*?(?:-->|(?P<cut>\Z))|<(?P<silent>{_SILENT})\b[^>]*+>(?P<inside>.*?)(?:</(?P=silent)\s*+>|(?P<open>\Z))|<[!?][^>]*+>"
_TAG = r"<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9]*+)"
_ATTRS = r"(?:(?P<attrs>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>][^\s>]*+)?)*+)>|(?P<loose>[^>]*+)>)"
_MARKUP, _NEXT = (re.compile(f"{_OTHER}|{_TAG}{attrs}", re.S | re.I) for attrs in (_ATTRS, ""))
_PLAIN, _BLANK, _BARE = re.compile(r"[^>=]*+"), re.compile(r"\s*+"), re.compile(r"[^\s>]*+")
_HREF = re.compile(r"""(?:^|\s)href\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)
_LANG = re.compile(r"""(?:^|\s)lang\s*+=\s*+["']?([A-Za-z-]++)""", re.I)
_ZEROS, _HUGE = re.compile(r"&#0++(?=[0-9])"), re.compile(r"&#[0-9]{8,}+;?")


def _title(m: re.Match) -> str | None:
    """What a title holds; an open one, all that follows."""
    if not m["silent"] or m["silent"].lower() != "title":
        return None
    return m["inside"] if m["open"] is None else m.string[m.start("inside") :]


class _Ends:
    """Where tags end in a page that has loose ones. An = that led to no end once isn't followed again, so all tags together take linear time."""

    def __init__(self, source: str, end: int):
        self.source, self.end, self.dead = source, end, set()
        self.last = {q: source.rfind(q, 0, end) for q in "\"'"}

    def after(self, at: int) -> int:
        """The place of the > that ends the attributes from here on; the next one, if none stands outside of quoted values."""
        source, end, seen, start = self.source, self.end, [], at
        while True:
            at = _PLAIN.match(source, at, end).end()
            if at < end and source[at] == ">":
                return at
            if at >= end or at in self.dead:
                self.dead.update(seen)
                return source.index(">", start)
            seen.append(at)
            at = _BLANK.match(source, at + 1, end).end()
            letter = source[at : at + 1]
            if letter in self.last:
                at = source.index(letter, at + 1, end) + 1 if at < self.last[letter] else at
            else:
                at = _BARE.match(source, at, end).end()


def _marks(source: str, end: int):
    """(start, end, name, whether it is an end tag, attributes, content of a title) of the markup before `end`, behind which no > stands; what reaches to the end of the page has no end."""
    at, m = 0, None
    for m in _MARKUP.finditer(source, 0, end):
        if m["loose"] is not None:
            at = m.start()
            break
        whole = m["cut"] is not None or m["open"] is not None
        yield m.start(), None if whole else m.end(), m["name"] or "", m["end"], m["attrs"], _title(m)
    else:
        return
    ends = _Ends(source, end)
    while m := _NEXT.search(source, at, end):
        at = ends.after(m.end()) + 1 if m["name"] else m.end()
        whole = m["cut"] is not None or m["open"] is not None
        yield m.start(), None if whole else at, m["name"] or "", m["end"], source[m.end() : at - 1] if m["name"] else None, _title(m)


def unescaped(text: str) -> str:
    """html.unescape for references of any length: numbers beyond all characters are the replacement character."""
    if "&#" in text:
        text = _HUGE.sub("�", _ZEROS.sub("&#", text))
    return html.unescape(text)


def extract(source: str) -> tuple[str, str, str, list[str]]:
    """(text, title, language, link targets as written) of an HTML source, in time that grows as its length does, whatever it holds."""
    out, title, language, links, at, end = [], "", "", [], 0, source.rfind(">") + 1
    for start, stop, name, closing, attrs, inside in _marks(source, end):
        out.append(source[at:start])
        at = len(source) if stop is None else stop
        name = name.lower()
        if name in _LINES:
            out.append("\n")
        if name == "a" and not closing and (href := _HREF.search(attrs)):
            links.append(unescaped(next(g for g in href.groups() if g is not None)).strip())
        elif name == "html" and not language and (lang := _LANG.search(attrs)):
            language = lang[1]
        elif inside is not None and not title:
            title = " ".join(unescaped(inside).split())
    rest = source[at:]
    if at <= end and (comment := source.find("<!--", end)) >= 0:  # never closed
        rest = source[at:comment]
    out.append(rest)
    text = unescaped("".join(out))
    lines = (" ".join(line.split()) for line in text.split("\n"))
    return "\n".join(filter(None, lines)), title, language, links


def resolved(base: str | None, links: list[str]) -> list[str]:
    """Absolute forms of links; those that have none are left out."""
    try:
        at = urlsplit(base or "")
        origin = f"{at.scheme}://{at.netloc}" if at.scheme and at.netloc else None
    except ValueError:
        base = origin = None
    out = []
    for link in links:
        if origin and link[:1] == "/" and link[1:2] not in ("", "/") and "/." not in link:
            out.append(origin + link)  # what urljoin gives, without its parsing
            continue
        try:
            joined = urljoin(base, link) if base else link
        except ValueError:
            continue
        if "://" in joined:
            out.append(joined)
    return out


def _payload(block: bytes) -> tuple[str, dict[str, str], bytes]:
    """Status line, headers and body of an HTTP response."""
    head, _, body = block.partition(b"\r\n\r\n")
    status, *lines = head.decode("latin-1").split("\r\n")
    return status, dict((k.strip(), v.strip()) for k, _, v in (line.partition(":") for line in lines)), body


def derivatives(headers: dict[str, str], block: bytes) -> list[tuple[dict[str, str], bytes]]:
    """The metadata and the conversion record of a response."""
    status, http, body = _payload(block)
    source, target = headers["WARC-Record-ID"], headers.get("WARC-Target-URI")
    payload = headers.get("WARC-Payload-Digest") or digest(body)
    kind = http.get("Content-Type", "")
    charset = (m[1] if (m := re.search(r"charset=[\"']?([\w-]+)", kind, re.I)) else "utf-8").lower()
    try:
        page = body.decode(charset, "replace")
    except LookupError:
        page = body.decode("utf-8", "replace")
    text, title, language, links = extract(page)
    fields = [("source-payload-digest", payload), ("source-block-digest", headers.get("WARC-Block-Digest", digest(block))), ("http-status", status), *((f"http-header-{k.lower()}", v) for k, v in http.items()), ("title", title), ("language", language), ("charset", charset)]
    fields += [("outlink", f"{link} L a/@href") for link in resolved(target, links)]
    about = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in fields if v).encode("utf-8", "replace")
    kept = {k: headers[k] for k in ("WARC-Target-URI", "WARC-Date", "WARC-IP-Address", "Page-Id") if k in headers}
    made = []
    for name, form, own in (("metadata", "application/warc-fields", about), ("conversion", "text/plain; charset=utf-8", text.encode("utf-8", "replace"))):
        made.append(({"WARC-Type": name, "WARC-Record-ID": record_id(name, source, payload), **kept, "WARC-Refers-To": source, "WARC-Source-Payload-Digest": payload, "Content-Type": form, "WARC-Block-Digest": digest(own), **({"WARC-Identified-Content-Language": language} if language else {})}, own))
    return made


def _derived(rows):
    for headers, block in rows:
        if headers.get("WARC-Type") == "response":
            yield from derivatives(headers, block)


def derive(records: DataFrame) -> DataFrame:
    """The metadata and conversion records of all response records."""
    return records.filter("type = 'response'").select("headers", "block").mapInArrow(lambda batches: _batches(_derived(_rows(batches, 0, 1))), RECORDS_SQL)


def derive_files(manifest: DataFrame, folder: str) -> DataFrame:
    """Reads files of responses and writes a file of derivatives for each, record by record inside a task; gives the manifest."""
    return table(_files(manifest).mapInArrow(lambda batches: _written(_derived(_read(batches)), folder), MANIFEST), "manifest")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages as responses, derives from the files, writes the derivatives and reads them back; a row per derived record."""
    source = write_responses(spark.read.parquet(f"{sf_dir}/pages.parquet"), fresh_dir(spark, "warc"))
    made = read_warc(derive_files(source, fresh_dir(spark, "warc-derived")))
    h = lambda name: F.col("headers")[name]
    return made.select(h("Page-Id").cast("long").alias("page_id"), F.col("type").alias("record_type"), "record_id", h("WARC-Refers-To").alias("refers_to"), h("WARC-Target-URI").alias("target_uri"), h("WARC-Date").alias("warc_date"), h("WARC-Source-Payload-Digest").alias("source_payload_digest"), h("WARC-Block-Digest").alias("block_digest"), F.octet_length("block").cast("long").alias("block_bytes"), F.crc32("block").alias("block_crc32"))
