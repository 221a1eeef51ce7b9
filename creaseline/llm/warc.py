"""WARC archives: writing pages with revisits, segments and chunked framing, and reading them back.

Writing: a page is a `response` record whose block is an HTTP message with the payload in chunked
transfer framing, or, if its payload stands in another record already, a `revisit` record with the
HTTP head alone. Of equal payloads of at least `REVISIT_BYTES` bytes, the record with the largest
page id is the response. A block longer than `SEGMENT_BYTES` is cut into a first record and
`continuation` records that name the first one's id, a segment number and, in the last, the total
length. Archives are written by Spark's text writer, whose line separator is the end of a record;
a task that fails is run again and leaves nothing behind. Files have at most `FILE_RECORDS` records.

Reading: a file is parsed record by record by its Content-Length, whatever the payloads contain.
Continuation records are grouped by origin, ordered by segment number and joined; numbers must be
complete and the total length must agree. Then the chunked framing is undone, and a revisit is
resolved to the response that it refers to.

Defined cases: null html is an empty payload; rows with equal ids and payloads are a response and
revisits to it; null ids come before all others; an empty table writes no record and gives an empty
table; a record that is incomplete or has a broken framing is kept, with `intact` false.
"""

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creaseline.sources.storage import written

REVISIT_BYTES = 1000
SEGMENT_BYTES = 64 << 10
CHUNK_BYTES = 16 << 10
FILE_RECORDS = 2000
CRLF = "\r\n"
END = CRLF + CRLF
DATE = "2024-01-01T00:00:00Z"
_HEAD = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Transfer-Encoding: chunked{END}"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PARSED = (
    "record_id string, record_type string, target_uri string, payload_digest string, refers_to string,"
    " origin_id string, segment int, total long, block binary, complete boolean"
)


def _binary(*parts) -> Column:
    return F.concat(*[p.cast("binary") if isinstance(p, Column) else F.lit(p).cast("binary") for p in parts])


def _line(name: str, value: Column) -> Column:
    """A header line; none if the value is null. Line breaks in a value become blanks."""
    clean = F.regexp_replace(value.cast("string"), r"[\r\n]+", " ")
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit(CRLF)), F.lit(""))


def _record_id(page: Column, tag: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(":"), tag.cast("string"), F.lit(">"))


def records(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row (`record`, binary) per WARC record, without its end."""
    rows = pages.select(
        F.col(page).alias("page"), F.col(url).alias("url"),
        F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"), F.monotonically_increasing_id().alias("tag"),
    ).withColumn("digest", F.sha1("payload"))
    long = rows.filter(F.octet_length("payload") >= REVISIT_BYTES)
    kept = long.groupBy("digest").agg(F.max(F.struct("page", "tag")).alias("kept"), F.count(F.lit(1)).alias("n"))
    kept = written(kept.filter("n > 1").drop("n"), "warc-kept")
    rows = rows.withColumn("same", F.when(F.octet_length("payload") >= REVISIT_BYTES, F.col("digest")).otherwise(F.col("tag").cast("string")))
    rows = rows.join(kept.withColumnRenamed("digest", "same"), "same", "left")
    first = F.col("kept").isNull() | (F.col("page").eqNullSafe(F.col("kept.page")) & (F.col("tag") == F.col("kept.tag")))
    rows = rows.withColumn("id", _record_id(F.col("page"), F.col("tag")))
    size = F.octet_length("payload")
    chunks = F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil(size / CHUNK_BYTES).cast("int") - 1, F.lit(0))),
        lambda i: F.substr(F.col("payload"), i * CHUNK_BYTES + 1, F.lit(CHUNK_BYTES)),
    )
    framed = F.transform(chunks, lambda c: F.when(F.octet_length(c) > 0, _binary(F.lower(F.hex(F.octet_length(c).cast("bigint"))), CRLF, c, CRLF)).otherwise(F.lit("").cast("binary")))
    rows = rows.withColumn("response", first).withColumn(
        "block", F.when(F.col("response"), F.concat(_binary(_HEAD), F.array_join(framed.cast("array<string>"), "").cast("binary"), _binary("0" + END)))
        .otherwise(_binary(_HEAD)),
    )
    last = F.greatest(F.ceil(F.octet_length("block") / SEGMENT_BYTES).cast("int") - 1, F.lit(0))
    cut = rows.select(
        "id", "url", "digest", "response", "kept", F.octet_length("block").alias("total"), last.alias("last"),
        F.posexplode(F.transform(F.sequence(F.lit(0), last), lambda i: F.substr(F.col("block"), i * SEGMENT_BYTES + 1, F.lit(SEGMENT_BYTES)))).alias("i", "part"),
    )
    more, whole = F.col("i") > 0, F.col("last") == 0
    kind = F.when(more, "continuation").when(F.col("response"), "response").otherwise("revisit")
    head = F.concat(
        F.lit("WARC/1.1" + CRLF),
        _line("WARC-Type", kind),
        _line("WARC-Record-ID", F.when(more, F.concat(F.expr("substr(id, 1, length(id) - 1)"), F.lit("/"), F.col("i") + 1, F.lit(">"))).otherwise(F.col("id"))),
        _line("WARC-Date", F.lit(DATE)),
        _line("WARC-Target-URI", F.when(~more, F.col("url"))),
        _line("WARC-Payload-Digest", F.when(~more, F.concat(F.lit("sha1:"), F.col("digest")))),
        _line("WARC-Profile", F.when(~F.col("response"), F.lit(_PROFILE))),
        _line("WARC-Refers-To", F.when(~F.col("response"), _record_id(F.col("kept.page"), F.col("kept.tag")))),
        _line("WARC-Segment-Number", F.when(~whole, F.col("i") + 1)),
        _line("WARC-Segment-Origin-ID", F.when(more, F.col("id"))),
        _line("WARC-Segment-Total-Length", F.when(more & (F.col("i") == F.col("last")), F.col("total"))),
        _line("Content-Type", F.when(~more, F.lit("application/http; msgtype=response"))),
        _line("Content-Length", F.octet_length("part")),
        F.lit(CRLF),
    )
    return cut.select(_binary(head, F.col("part")).alias("record"))


def write(pages: DataFrame, path: str, page: str = "page_id", url: str = "url", html: str = "html") -> None:
    lines = records(pages, page, url, html).select(F.col("record").cast("string").alias("value"))
    lines.write.option("lineSep", END).option("maxRecordsPerFile", FILE_RECORDS).text(path)


def parse(data: bytes) -> Iterator[tuple]:
    """The records of an archive in the order of `_PARSED`; a cut-off one is not complete."""
    at = 0
    while (at := data.find(b"WARC/1.", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        pairs = (line.split(b":", 1) for line in data[at:end].split(b"\r\n")[1:] if b":" in line)
        fields = {name.strip().lower(): value.strip().decode("utf-8", "replace") for name, value in pairs}
        size = int(fields.get(b"content-length") or 0)
        block = data[end + 4 : end + 4 + size]
        digest = fields.get(b"warc-payload-digest", "")
        number, total = fields.get(b"warc-segment-number"), fields.get(b"warc-segment-total-length")
        yield (
            fields.get(b"warc-record-id"), fields.get(b"warc-type"), fields.get(b"warc-target-uri"),
            digest.removeprefix("sha1:") or None, fields.get(b"warc-refers-to"), fields.get(b"warc-segment-origin-id"),
            int(number) if number else None, int(total) if total else None, block, len(block) == size,
        )
        at = end + 4 + size


def read(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives below `path`, segments apart."""
    files = spark.read.format("binaryFile").load(path).select("content")
    names = ["record_id", "record_type", "target_uri", "payload_digest", "refers_to", "origin_id", "segment", "total", "block", "complete"]

    def run(batches):
        kinds = [pa.string()] * 6 + [pa.int32(), pa.int64(), pa.binary(), pa.bool_()]
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for row in parse(content.as_py()):
                    rows.append(row)
                    size += len(row[8])
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return files.mapInArrow(run, _PARSED)


def reassembled(found: DataFrame) -> DataFrame:
    """One row per record, its segments joined in order; `complete` is false if any is missing."""
    alone = found.filter("segment IS NULL").select(
        "record_id", "record_type", "target_uri", "payload_digest", "refers_to", "block", "complete"
    )
    parts = found.filter("segment IS NOT NULL").withColumn("origin", F.coalesce("origin_id", "record_id"))
    # All segments of one page: bounded by the page.
    joined = parts.groupBy("origin").agg(
        F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts"),
        F.max("total").alias("total"), F.min("complete").alias("complete"),
        *[F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in ("record_type", "target_uri", "payload_digest", "refers_to")],
    ).withColumn("block", F.expr("cast(array_join(transform(parts, p -> cast(p.block AS STRING)), '') AS BINARY)"))
    numbered = F.expr("transform(parts, p -> p.segment) = sequence(1, size(parts))")
    agreeing = F.coalesce(F.octet_length("block") == F.col("total"), F.lit(False))
    return alone.unionByName(
        joined.select(
            F.col("origin").alias("record_id"), "record_type", "target_uri", "payload_digest", "refers_to", "block",
            (F.col("complete") & numbered & agreeing).alias("complete"),
        )
    )


def unchunked(message: bytes) -> tuple[bytes, bool]:
    """The payload of an HTTP message, and whether its framing is sound."""
    end = message.find(b"\r\n\r\n")
    head, body = message[:end].lower(), message[end + 4 :]
    if end < 0:
        return b"", False
    if b"transfer-encoding: chunked" not in head:
        return body, True
    parts, at = [], 0
    while (line := body.find(b"\r\n", at)) >= 0:
        try:
            size = int(body[at:line].split(b";")[0], 16)
        except ValueError:
            break
        if size == 0:
            return b"".join(parts), True
        parts.append(body[line + 2 : line + 2 + size])
        at = line + 2 + size + 2
        if len(parts[-1]) < size or body[at - 2 : at] != b"\r\n":
            break
    return b"".join(parts), False


def payloads(whole: DataFrame) -> DataFrame:
    """The records with their payload decoded, its size and SHA-1, and whether all of it is intact."""
    names = ["record_id", "record_type", "target_uri", "refers_to", "payload", "payload_bytes", "payload_digest", "intact"]

    def run(batches):
        for batch in batches:
            rows = batch.to_pydict()
            out, bodies, sizes, digests, intact = [], [], [], [], []
            for kind, declared, block, complete in zip(rows["record_type"], rows["payload_digest"], rows["block"], rows["complete"]):
                if kind == "revisit":
                    bodies.append(None), sizes.append(None), digests.append(declared), intact.append(complete)
                    continue
                body, sound = unchunked(block or b"")
                digest = hashlib.sha1(body).hexdigest()
                bodies.append(body), sizes.append(len(body)), digests.append(digest)
                intact.append(bool(complete and sound and declared in (None, digest)))
            out = [batch.column(n) for n in ("record_id", "record_type", "target_uri", "refers_to")]
            out += [pa.array(bodies, pa.binary()), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(intact, pa.bool_())]
            yield pa.RecordBatch.from_arrays(out, names)

    schema = "record_id string, record_type string, target_uri string, refers_to string, payload binary, payload_bytes long, payload_digest string, intact boolean"
    return whole.mapInArrow(run, schema)


def page_of(record_id: Column) -> Column:
    """The page id inside a record id, as text; null for a null id."""
    number = F.regexp_extract(record_id, r"^<urn:page:(.*):\d+>$", 1)
    return F.when(number != "", number)


def digests(read_back: DataFrame, id_type: str = "long") -> DataFrame:
    """Per page: page_id, payload_bytes, payload_digest, record_type, refers_to, intact; revisits
    take size and digest of the full payload from their response."""
    rows = written(read_back.select("record_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "intact"), "warc-read")
    own = rows.filter("record_type <> 'revisit'").withColumn("refers_to", F.lit(None).cast("string"))
    named = own.select(F.col("record_id").alias("refers_to"), F.col("payload_bytes").alias("full"), F.col("payload_digest").alias("digest"), F.col("intact").alias("sound"))
    again = rows.filter("record_type = 'revisit'").join(named, "refers_to", "left").select(
        "record_id", "record_type", "refers_to", F.col("full").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        F.coalesce(F.col("intact") & F.col("sound") & (F.col("payload_digest") == F.col("digest")), F.lit(False)).alias("intact"),
    )
    return own.unionByName(again).select(
        page_of(F.col("record_id")).cast(id_type).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        page_of(F.col("refers_to")).cast(id_type).alias("refers_to"), "intact",
    )
