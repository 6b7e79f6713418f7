"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

Writing: a page's record is a response, or, where a page with an equal payload (of LEAST_SHARED_BYTES
or more) and a larger id exists, a revisit that names it. Records are written by Spark's text sink
with the record separator as line end, so any store that Spark writes can hold them and lost tasks
are simply run again. Files are gzipped, one member each, without a warcinfo record, and hold about ARCHIVE_BYTES
of records: pages far above the mean size go into files of their own, counted by the largest of them.

Reading: a task takes one archive, inflates it in pieces of PIECE bytes and emits, for every place where the magic
stands, the offset and the offset of its successor as the header claims it. Magic also stands inside payloads, so
these are only candidates. Pointer jumping from the file's start doubles the known part of the chain each round
and keeps what it reaches; everything else is rejected. Payload digests are computed in a second run over
the pieces, along the first well-formed candidates that do not overlap, which holds all that the chain can reach.
A task holds the compressed archive, its candidates' heads and what lies between a magic and the next blank line;
payloads of any length pass through in pieces.

Defined cases: a null html is an empty payload; a null url is written as about:blank; a null page_id
takes part under the empty id (null when read) and is never referred to while another id has the payload; equal rows
with the largest id are all responses; line breaks in urls are percent-encoded; other columns are
ignored; an empty table gives empty archives and no record. A file that does not begin with a record gives none; what
follows a malformed record is not reached.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairngraph.llm.common import drop, map_arrow, shared_folder, written

LEAST_SHARED_BYTES = 1000
ARCHIVE_BYTES = 32 << 20
#: Pages of so many times the mean size go into files of their own.
FAR_ABOVE_MEAN = 16
#: Bytes of an archive that are inflated at a time.
PIECE = 1 << 20
DATE = "2020-01-01T00:00:00Z"
SEPARATOR = "\r\n\r\n"
#: The HTTP header that stands before each payload.
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MAGIC = re.compile(rb"WARC/1\.[01]\r?\n")


def _record_id(page: F.Column) -> F.Column:
    return F.concat(F.lit("<urn:sha1:"), F.sha1(F.concat(F.lit("page:"), page)), F.lit(">"))


def records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """The text of every page's record, without the separator that ends it."""
    rows = pages.select(
        F.coalesce(F.col(page_id).cast("string"), F.lit("")).alias("page"),
        F.col(page_id).cast("long").alias("id"),
        F.coalesce(F.col(url).cast("string"), F.lit("about:blank")).alias("url"),
        F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"),
    ).withColumns({"digest": F.sha1("html"), "bytes": F.octet_length("html")})
    # The roles need no payload; only pages that revisit another are kept.
    ids, ids_at = written(rows.where(F.col("bytes") >= LEAST_SHARED_BYTES).select("page", "id", "digest"), "digests")
    groups, groups_at = written(
        ids.groupBy("digest").agg(F.max("id").alias("of"), F.count(F.lit(1)).alias("n")).where("n > 1 AND of IS NOT NULL").drop("n"), "groups"
    )
    # Both are read from files: Spark broadcasts the smaller only if its size is below its threshold, and splits hot digests otherwise.
    roles, _ = written(ids.join(groups, "digest").where("id IS NULL OR id < of").select("page", "digest", "of").distinct(), "roles")
    drop(pages.sparkSession, ids_at, groups_at)
    told = rows.join(roles, ["page", "digest"], "left")
    revisit = F.col("of").isNotNull()
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    body = F.concat(F.lit(HTTP), F.when(revisit, F.lit("")).otherwise(F.col("html")))
    return told.select(
        F.concat(
            F.lit("WARC/1.1\r\n"),
            line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
            line("WARC-Record-ID", _record_id(F.col("page"))),
            line("WARC-Date", F.lit(DATE)),
            line("WARC-Target-URI", uri),
            line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            line("X-Payload-Length", F.col("bytes").cast("string")),
            line("X-Page-ID", F.col("page")),
            F.when(revisit, F.concat(line("WARC-Profile", F.lit(_PROFILE)), line("WARC-Refers-To", _record_id(F.col("of").cast("string"))), line("X-Refers-To-Page", F.col("of").cast("string")))).otherwise(
                F.lit("")
            ),
            line("Content-Type", F.lit("application/http; msgtype=response")),
            line("Content-Length", F.octet_length(body).cast("string")),
            F.lit("\r\n"),
            body,
        ).alias("value")
    )


def write(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> int:
    """Writes gzipped archives of about ARCHIVE_BYTES of records each into the folder; the number of records."""
    length = lambda c: F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0))
    whole = (length(html) + length(url) + 600).cast("long")
    size = pages.agg(F.count(F.lit(1)).alias("n"), F.sum(whole).alias("b"), F.max(whole).alias("most")).first()
    far = FAR_ABOVE_MEAN * (size.b // size.n) if size.n else 0
    # The value column's own length decides, so that revisits of long pages stay with the short records.
    rows = records(pages, page_id, url, html)
    short = F.octet_length("value") < far
    parts = [(rows.where(short), max(1, ARCHIVE_BYTES * size.n // size.b))] if size.n else [(rows, 1000)]
    if size.n and size.most >= far:
        parts.append((rows.where(~short), max(1, ARCHIVE_BYTES // size.most)))
    for part, each in parts:
        part.write.mode("append").option("lineSep", SEPARATOR).option("compression", "gzip").option("maxRecordsPerFile", each).text(path)
    return size.n


@dataclass(frozen=True)
class Candidate:
    at: int
    next: int | None  # None: no well-formed record stands here
    head: dict[str, str]
    block: tuple[int, int]


def inflated(raw: bytes, piece: int = PIECE) -> Iterator[bytes]:
    """The archive's bytes in pieces: gzip members, one or many, or plain."""
    if raw[:2] != b"\x1f\x8b":
        yield from (raw[i : i + piece] for i in range(0, len(raw), piece))
        return
    at = 0
    while raw[at : at + 2] == b"\x1f\x8b":
        member, fed = zlib.decompressobj(31), b""
        while not member.eof:
            if not fed:
                fed = raw[at : at + piece]
                at += len(fed)
            out = member.decompress(fed, piece)
            if out:
                yield out
            elif not fed:
                return  # the member is cut off
            fed = member.unconsumed_tail
        at -= len(member.unused_data)


#: The header lines that are kept.
_HEADS = frozenset((
    "warc-type", "warc-record-id", "warc-target-uri", "warc-payload-digest", "content-type", "content-length",
    "x-page-id", "x-refers-to-page", "x-payload-length",
))


class _Candidates:
    """The candidates of an archive that comes in pieces.

    For each line end, the magic whose header has not ended yet waits (`waiting`); a header is as long as it is. Where it
    has ended, the end of the record is awaited (`awaited`), while the bytes between are let go."""

    def __init__(self) -> None:
        self.held, self.base = b"", 0  # the bytes that may still be asked for, and where they begin
        self.searched = 0  # no magic begins before it but those found
        self.waiting: dict[bytes, list[tuple[int, int]]] = {b"\r\n": [], b"\n": []}  # (at, where the header's lines begin)
        self.blank: dict[bytes, int] = {b"\r\n": 0, b"\n": 0}  # the blank line is searched from here
        self.awaited: list[tuple[int, int, int, bytes, dict[str, str]]] = []  # heap of (end, at, start, line end, head)
        self.found: list[Candidate] = []

    def feed(self, piece: bytes, last: bool = False) -> None:
        self.held += piece
        stop = self.base + len(self.held)
        for m in _MAGIC.finditer(self.held, self.searched - self.base):
            nl = b"\r\n" if m[0].endswith(b"\r\n") else b"\n"
            if not self.waiting[nl]:
                self.blank[nl] = self.base + m.end() - len(nl)
            self.waiting[nl].append((self.base + m.start(), self.base + m.end()))
            self.searched = self.base + m.end()
        self.searched = max(self.searched, stop - 9, self.base)
        for nl in self.waiting:
            self._headers(nl, stop, last)
        while self.awaited and (self.awaited[0][0] + 4 <= stop or last):
            self._settle(*heapq.heappop(self.awaited))
        keep = min([self.searched, max(self.base, stop - 4), *(w[0][1] - len(nl) for nl, w in self.waiting.items() if w)])
        self.held, self.base = self.held[keep - self.base :], keep

    def _headers(self, nl: bytes, stop: int, last: bool) -> None:
        """Ends the headers for which a blank line has come: all magic in front of one shares it and the lines before."""
        waiting = self.waiting[nl]
        done = 0
        while done < len(waiting):
            blank = self.held.find(nl + nl, self.blank[nl] - self.base)
            if blank < 0:
                self.blank[nl] = max(self.blank[nl], stop - 2 * len(nl) + 1)
                break
            blank += self.base
            upto = done
            while upto < len(waiting) and waiting[upto][1] - len(nl) <= blank:
                upto += 1
            start, head, before = blank + 2 * len(nl), {}, blank
            begins = waiting[done][1]
            lines = self.held[begins - self.base : max(begins, blank) - self.base].split(nl)
            for at, first in reversed(waiting[done:upto]):  # the last line of a name counts, so the lines are read from the end
                while lines and before > first:
                    line = lines.pop()
                    before -= len(line) + len(nl)
                    name, colon, value = line.partition(b":")
                    if colon and len(name) < 64 and (key := name.strip().lower().decode("latin-1")) in _HEADS and key not in head:
                        head[key] = value.strip().decode("utf-8", "replace")
                length = head.get("content-length", "")
                if length.isascii() and length.isdigit() and len(length) < 16:
                    heapq.heappush(self.awaited, (start + int(length), at, start, nl, dict(head)))
                else:
                    self.found.append(Candidate(at, None, {}, (at, at)))
            done = upto
            if done < len(waiting):
                self.blank[nl] = waiting[done][1] - len(nl)
        if last:
            self.found += [Candidate(at, None, {}, (at, at)) for at, _ in waiting[done:]]
            done = len(waiting)
        del waiting[:done]

    def _settle(self, end: int, at: int, start: int, nl: bytes, head: dict[str, str]) -> None:
        i = end - self.base
        tail = 4 if self.held[i : i + 4] == b"\r\n\r\n" else 2 if self.held[i : i + 2] == b"\n\n" and nl == b"\n" else 0
        self.found.append(Candidate(at, end + tail, head, (start, end)) if tail else Candidate(at, None, {}, (start, end)))


def candidates(pieces: Iterable[bytes]) -> list[Candidate]:
    """Every place of the magic, with the successor that its header claims, in order."""
    by = _Candidates()
    for piece in pieces:
        by.feed(piece)
    by.feed(b"", True)
    return sorted(by.found, key=lambda c: c.at)


def digests(pieces: Iterable[bytes], chosen: Sequence[Candidate]) -> Iterator[tuple[str, int]]:
    """SHA-1 and length of the payload of each chosen candidate; they are in order and do not overlap."""
    pieces, piece, base = iter(pieces), b"", 0
    for c in chosen:
        at, end = c.block
        in_http = c.head.get("content-type", "").lower().startswith("application/http")
        digest, size, gap = hashlib.sha1(), 0, b""  # gap: the end of what may be the HTTP header
        while at < end:
            while base + len(piece) <= at:
                base += len(piece)
                piece = next(pieces)
            part = piece[at - base : end - base]
            at += len(part)
            if in_http:
                joined = gap + part
                cut = joined.find(b"\r\n\r\n")
                if cut < 0:
                    gap = joined[-3:]
                    continue
                part, in_http = joined[cut + 4 :], False
            digest.update(part)
            size += len(part)
        yield digest.hexdigest(), size


_FIELDS = ("file string, at bigint, next bigint, type string, record_id string, uri string, page_id bigint, refers_to bigint,"
           " stated_digest string, stated_bytes bigint, digest string, bytes bigint")  # fmt: skip


def _number(x: str | None) -> int | None:
    return int(x) if x and x.lstrip("-").isascii() and x.lstrip("-").isdigit() else None


def scanned(spark: SparkSession, path: str) -> DataFrame:
    """A row for every well-formed candidate of every archive below path; digest and bytes of the payload along the
    first candidates that do not overlap, null for others."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, raw = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                found = [c for c in candidates(inflated(raw)) if c.next is not None]
                chosen, free = [], 0
                for c in found:
                    if c.at >= free:
                        chosen.append(c)
                        free = c.next
                known = {c.at: d for c, d in zip(chosen, digests(inflated(raw), chosen), strict=True)}
                rows = []
                for c in found:
                    h = c.head
                    stated = h.get("warc-payload-digest", "")
                    rows.append((name, c.at, c.next, h.get("warc-type"), h.get("warc-record-id"), h.get("warc-target-uri"), _number(h.get("x-page-id")),
                                 _number(h.get("x-refers-to-page")), stated.removeprefix("sha1:") or None, _number(h.get("x-payload-length")), *known.get(c.at, (None, None))))
                cols = list(zip(*rows, strict=True)) or [()] * len(types)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    fields = [f.split(" ") for f in _FIELDS.split(", ")]
    names = [f[0] for f in fields]
    types = [pa.string() if f[1] == "string" else pa.int64() for f in fields]
    return map_arrow(files, run, _FIELDS)


def reachable(chain: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(file, at) of the records that the chain(file, at, next) reaches from at = 0, by pointer jumping: each round lets
    all that is known jump, and doubles the jumps. As a record has one successor, behind it, what is landed on was not known.

    Known places are jumps from nowhere (orig -1), so one join does both. The joins are asked to be merge joins: paths
    compress so well that a file's size says little of what a broadcast of it would take."""
    spark = chain.sparkSession
    places = chain.select("file", F.col("at").alias("next"))
    steps = chain.select("file", F.col("at").alias("orig"), "next").join(places.hint("merge"), ["file", "next"], "left_semi")
    jumps, *first = written(steps.select("file", "orig", F.col("next").alias("at")), "jumps")
    known = chain.where("at = 0").select("file", F.lit(-1).cast("long").alias("orig"), "at")
    for _ in range(max_rounds):
        further = jumps.select("file", F.col("orig").alias("at"), F.col("at").alias("to")).hint("merge")
        new, new_at = written(known.unionByName(jumps).join(further, ["file", "at"]).select("file", "orig", F.col("to").alias("at")), "jumps")
        landed = new.where("orig = -1")
        if landed.limit(1).count() == 0:
            drop(spark, new_at, *first)
            return known.select("file", "at")
        drop(spark, *first)
        known, jumps, first = known.unionByName(landed), new.where("orig >= 0"), []  # the places landed on stay
    raise RuntimeError("the chain did not end")


def _verified(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """All records that the boundary chain verifies, and their places."""
    found, _ = written(scanned(spark, path), "candidates")
    kept = reachable(found)
    intact = (F.col("type") == "revisit") | ((F.col("digest") == F.col("stated_digest")) & (F.col("bytes") == F.coalesce("stated_bytes", "bytes")))
    return found.join(kept.hint("merge"), ["file", "at"]).withColumn("intact", F.coalesce(intact, F.lit(False))), kept


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records that the boundary chain verifies: the columns of scanned() and intact (a response's payload has
    the digest and length that its header states)."""
    return _verified(spark, path)[0]


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the pages as archives into the shared folder and reads them back; fails unless every record is reached."""
    path = shared_folder(pages.sparkSession, "archives")
    n = write(pages, path)
    records, places = _verified(pages.sparkSession, path)
    if (reached := places.count()) != n:
        raise RuntimeError(f"{n} records were written, {reached} reached")
    return records
