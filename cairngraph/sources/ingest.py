"""Policy-gated sources: local corpora in bulk, feeds, saved WARC archives and API fixtures.

A TOML file names one source, its policy and its limits; a source whose policy does not allow it is
refused before anything is read. Plans decide file by file with a reason; what is accepted goes
through the same extractors as a repository and gets its provenance into the metadata. Nothing here
opens a connection: fetchers are callables that the caller passes in.
"""

from __future__ import annotations

import hashlib
import re
import tomllib
import urllib.request
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from cairngraph.functions import keys as K
from cairngraph.operators.base import OBSERVATIONS, observation, redact_url, secret_name
from cairngraph.sources import numbering, repository
from cairngraph.sources.numbering import bounds_of, range_in

# Policies, corpora, folders and routes.
ALLOWED = ("allowed", "allowed_with_limits")
CORPORA = ("generic_local_corpus", "email_export", "eml_export", "mbox_export", "document_corpus", "source_code_corpus", "saved_page_corpus", "static_artifact_corpus", "report_corpus", "warc_corpus", "feed_corpus", "mixed_corpus")
EXCLUDED = (".git", ".svn", ".hg", "node_modules", "vendor", ".venv", "venv", ".mypy_cache", ".pytest_cache", ".tox", ".gradle", "target", "build", "dist", ".next", ".nuxt", ".cache", ".Trash", "Mail", "Maildir",
            "Thunderbird", "Outlook", "Apple Mail", "Gmail", "Profiles")
ARCHIVES = ("zip", "tar", "gz", "tgz", "7z", "rar", "bz2", "xz")
ROUTES = {
    **dict.fromkeys(("md", "markdown"), "markdown"), **dict.fromkeys(("json", "jsonl", "jsonc", "toml", "yaml", "yml", "xml", "plist"), "config"),
    **dict.fromkeys(("txt", "csv", "tsv", "tex", "latex", "odt", "ods", "ott", "ots"), "document"), **dict.fromkeys(("html", "htm"), "html"),
    **dict.fromkeys(("js", "mjs", "cjs", "jsx", "ts", "mts", "cts", "tsx"), "javascript"), **dict.fromkeys(("rb", "rake", "gemspec"), "ruby"), **dict.fromkeys(("sh", "bash", "zsh"), "shell"),
    "eml": "eml", "mbox": "mbox", "css": "css", "py": "python", "nix": "nix",
}
SPECIAL = {"Gemfile": "ruby", "Rakefile": "ruby", "Vagrantfile": "ruby"}


class PolicyRefused(ValueError):
    """The source's configuration is wrong or does not allow it."""


@dataclass(frozen=True)
class Source:
    source_id: str
    source_type: str
    policy_status: str
    corpus_kind: str = "generic_local_corpus"
    display_name: str | None = None
    url: str | None = None
    max_files: int = 1000
    max_total_bytes: int = 100 << 20
    max_file_bytes: int = 10 << 20
    max_depth: int = 16
    include_hidden: bool = False
    extensions: tuple[str, ...] = ()
    excluded_directories: tuple[str, ...] = ()
    excluded_paths: tuple[str, ...] = ()
    retention: str = "local_user_controlled"
    sensitivity: str = "private"
    extra: Mapping[str, object] = field(default_factory=dict)


def read_source(text: str) -> Source:
    """A source's TOML, checked: known policy and corpus, positive limits, no secrets in it."""
    try:
        t = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise PolicyRefused(f"not TOML: {e}") from e
    s, limits, include, exclude = (t.get(n, {}) for n in ("source", "limits", "include", "exclude"))
    for n in ("source_id", "source_type", "policy_status"):
        if not isinstance(s.get(n), str) or not s[n].strip():
            raise PolicyRefused(f"source.{n} is required")
    if s["policy_status"] not in ALLOWED:
        raise PolicyRefused(f"policy {s['policy_status']} does not allow this source")
    if s.get("corpus_kind", CORPORA[0]) not in CORPORA:
        raise PolicyRefused("corpus_kind is not known")
    if limits.get("follow_symlinks"):
        raise PolicyRefused("symbolic links are never followed")
    if any(secret_name(n) for part in (s, limits) for n in part):
        raise PolicyRefused("a source holds no secrets")
    numbers = {n: limits[n] for n in ("max_files", "max_total_bytes", "max_file_bytes", "max_depth") if n in limits}
    if any(not isinstance(v, int) or isinstance(v, bool) or v < 1 for v in numbers.values()):
        raise PolicyRefused("limits must be positive integers")
    return Source(
        s["source_id"], s["source_type"], s["policy_status"], s.get("corpus_kind", CORPORA[0]), s.get("display_name"), s.get("url"), **numbers, include_hidden=bool(limits.get("include_hidden", False)),
        extensions=tuple(include.get("extensions", ())), excluded_directories=tuple(exclude.get("directories", ())), excluded_paths=tuple(exclude.get("paths", ())),
        retention=t.get("retention", {}).get("policy", "local_user_controlled"), sensitivity=t.get("redaction", {}).get("sensitivity", "private"),
    )


def route(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    table = lambda m: F.element_at(F.create_map(*(x for k, v in m.items() for x in (F.lit(k), F.lit(v)))), name if m is SPECIAL else suffix)
    return (
        F.when(table(SPECIAL).isNotNull(), table(SPECIAL)).when(F.regexp_like(F.lower(name), F.lit(r"\.warc(\.gz)?$")), F.lit("warc")).when(suffix.isin(*ARCHIVES), F.lit("archive")).otherwise(table(ROUTES))
    )


def judged(files: DataFrame, s: Source) -> DataFrame:
    """files(path, content) with route, bytes and reason (null: fits all limits that need no other file)."""
    path, parts = F.col("path"), F.split(F.col("path"), "/")
    dirs = F.slice(parts, 1, F.size(parts) - 1)
    names = F.array(*(F.lit(x) for x in (*EXCLUDED, *s.excluded_directories)))
    out_path = F.lit(False)
    for p in s.excluded_paths:
        out_path = out_path | (path == p) | path.startswith(p.rstrip("/") + "/")
    suffix = F.concat(F.lit("."), F.lower(F.regexp_extract(F.element_at(parts, -1), r"\.([^.]+)$", 1)))
    wanted = F.lit(True) if not s.extensions else suffix.isin(*(e.lower() for e in s.extensions)) | F.element_at(parts, -1).isin(*s.extensions)
    r = route(path)
    # The names of reasons.
    reason = (
        F.when(out_path, F.lit("excluded_path")).when(~F.lit(s.include_hidden) & F.exists(parts, lambda p: p.startswith(".")), F.lit("hidden_excluded")).when(F.arrays_overlap(dirs, names), F.lit("excluded_directory"))
        .when(F.size(parts) > s.max_depth, F.lit("max_depth_exceeded")).when(r.isNull() | ~wanted, F.lit("unsupported_extension")).when(r == "archive", F.lit("archive_deferred"))
        .when(r == "warc", F.lit("warc_deferred")).when(F.length("content") > s.max_file_bytes, F.lit("max_file_bytes_exceeded"))
    )
    return files.withColumns({"route": r, "bytes": F.length("content").cast("long"), "reason": reason})


#: Files that are folded on the driver at a time, and ranges that more are parted into.
PLAN_PAGE, PLAN_RANGES = 10_000, 64


@dataclass(frozen=True)
class Plan:
    run_id: str
    manifest_id: str
    included: DataFrame  # path, content, route, bytes, sha256
    skipped: DataFrame  # path, route, bytes, reason
    routes: dict[str, int]
    reasons: dict[str, int]
    total_bytes: int


class Budget:
    """Acceptance of files in the order of their paths while bytes and number last: one that is too large for what is left is passed
    over, and a later one may fit.

    Files are parted into ranges of paths, of which number, bytes and least size are told by size class (powers of two) in one
    aggregation. A range all of whose files fit is accepted as a whole, one without a file that could is passed over as a whole, and
    only a range in which the budget breaks is looked at: parted again, or folded if it has at most PLAN_PAGE files that may
    fit. So the driver holds the sums of PLAN_RANGES ranges a level and one page; what it accepts is intervals of paths and
    the files of the pages."""

    def __init__(self, max_bytes: int, max_files: int) -> None:
        self.bytes, self.files = max_bytes, max_files
        self.whole: list[tuple[str, str | None, int]] = []  # from, to (exclusive), files up to this size
        self.single: list[str] = []

    def fold(self, rows: Iterable[Row]) -> None:
        for r in rows:
            if self.files and r.bytes <= self.bytes:
                self.single.append(r.path)
                self.bytes -= r.bytes
                self.files -= 1

    def walk(self, rows: DataFrame, begin: str = "", end: str | None = None) -> None:
        """rows: path and bytes of the files from begin to end (exclusive)."""
        if not self.files:
            return
        may = rows.where(F.col("bytes") <= self.bytes)
        page = may.orderBy("path").limit(PLAN_PAGE + 1).collect()
        if len(page) <= PLAN_PAGE:
            return self.fold(page)
        bounds = bounds_of(may, "path", PLAN_RANGES)
        if not bounds:  # many files of one path: no range parts them
            return self.fold(may.toLocalIterator())
        # The class of a size: the number of its bits, so that class c has sizes below 2^c.
        bits = F.when(F.col("bytes") > 0, F.length(F.conv(F.col("bytes").cast("string"), 10, 2))).otherwise(0)
        sums = may.groupBy(range_in(bounds, "path").alias("range"), bits.alias("bits")).agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.min("bytes").alias("least"), F.max("bytes").alias("most"))
        of: dict[int, list[Row]] = {}
        for r in sums.collect():  # a row a range and size class
            of.setdefault(r.range, []).append(r)
        edges = [begin, *bounds]
        for k in sorted(of):
            first, last = edges[k], bounds[k] if k < len(bounds) else end
            fits = [r for r in of[k] if r.most <= self.bytes]
            unsure = [r for r in of[k] if r.least <= self.bytes < r.most]
            number, size = sum(r.n for r in fits), sum(r.bytes for r in fits)
            if not self.files or not (fits or unsure):
                continue
            if not unsure and number <= self.files and size <= self.bytes:
                self._accept(first, last, self.bytes)
                self.bytes -= size
                self.files -= number
            else:
                inside = (F.col("path") >= first) & (F.lit(True) if last is None else F.col("path") < last)
                self.walk(may.where(inside), first, last)

    def _accept(self, first: str, last: str | None, most: int) -> None:
        self.whole.append((first, last, most))

    def accepts(self) -> Column:
        """Whether a file lies in an interval that was accepted as a whole."""
        if not self.whole:
            return F.lit(False)
        known = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).cast("string").alias("b"), F.lit(m).cast("long").alias("m")) for a, b, m in self.whole))
        return F.exists(known, lambda x: (F.col("path") >= x["a"]) & (x["b"].isNull() | (F.col("path") < x["b"])) & (F.col("bytes") <= x["m"]))


def plan(files: DataFrame, s: Source) -> Plan:
    """Accepts files in the order of their paths while the budget lasts (see Budget). The run's id is a digest of all that was
    accepted, taken row by row in order. Why files are left out is told by their size and place."""
    seen = judged(files, s).withColumn("sha256", F.sha2("content", 256))
    budget = Budget(s.max_total_bytes, s.max_files)
    budget.walk(seen.where("reason IS NULL").select("path", "bytes"))
    single = files.sparkSession.createDataFrame([(p, True) for p in budget.single], "path string, single boolean")
    told = seen.join(single, "path", "left").withColumn("accepted", F.col("reason").isNull() & (budget.accepts() | F.coalesce("single", F.lit(False)))).drop("single")
    included = told.where("accepted").drop("accepted", "reason")
    digest = hashlib.sha256(b'{"inventory":[')
    last, total, routes = "", 0, Counter()
    for n, r in enumerate(included.select("path", "route", "bytes", "sha256").orderBy("path").toLocalIterator()):
        digest.update((("," if n else "") + K.canonical_json([r.path, r.route, r.bytes, r.sha256])).encode())
        last, total = r.path, total + r.bytes
        routes[r.route] += 1
    digest.update(f'],"source":{K.canonical_json({k: v for k, v in s.__dict__.items() if k != "extra"})}}}'.encode())
    run = "bulk-" + digest.hexdigest()[:24]
    # A file is passed over for the number of files if it came after the last one that was taken and would have fitted.
    full = F.lit(routes.total() >= s.max_files) & (F.col("path") > last) & (F.col("bytes") <= s.max_total_bytes - total)
    late = F.when(full, F.lit("max_files_exceeded")).otherwise(F.lit("max_total_bytes_exceeded"))
    left_out = told.where(~F.col("accepted")).withColumn("reason", F.coalesce("reason", late)).select("path", "route", "bytes", "reason")
    reasons = {r.reason: r.n for r in left_out.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).collect()}
    return Plan(run, hashlib.sha256(f"{s.source_id}:{run}".encode()).hexdigest()[:24], included, left_out, dict(routes), reasons, total)


def annotated(observations: DataFrame, **fields: Column) -> DataFrame:
    """Metadata with fields added (null ones are left out), overwriting those of the same name; canonical JSON."""
    from cairngraph.sources.observations import T

    @F.pandas_udf(T.StringType())
    def merged(old, new):  # type: ignore[no-untyped-def]
        import json

        import pandas as pd

        both = [json.loads(a or "{}") | {k: v for k, v in json.loads(b).items() if v is not None} for a, b in zip(old, new, strict=True)]
        return pd.Series([K.canonical_json(x) for x in both], dtype=object)

    return observations.withColumn("metadata", merged("metadata", F.to_json(F.struct(*(v.alias(k) for k, v in fields.items())))))


def bulk_observations(spark: SparkSession, root: str, s: Source, run_id: int = 1) -> tuple[Plan, DataFrame]:
    """The plan of a local corpus and its observations with their provenance."""
    p = plan(repository.scan(spark, root).select("path", "content"), s)
    files = repository.classify(p.included.select("path", "content", F.lit(False).alias("executable")))
    found = repository.observe(files, run_id)
    facts = p.included.select("path", F.col("sha256").alias("bulk_sha"), F.col("bytes").alias("bulk_bytes"), F.col("route").alias("bulk_route"))
    lit = F.lit
    out = annotated(
        found.join(facts, "path"), source_id=lit(s.source_id), source_type=lit(s.source_type), corpus_kind=lit(s.corpus_kind), bulk_run_id=lit(p.run_id), bulk_manifest_id=lit(p.manifest_id),
        bulk_relative_path=F.col("path"), bulk_file_sha256=F.col("bulk_sha"), bulk_file_byte_count=F.col("bulk_bytes"), bulk_extractor_route=F.col("bulk_route"), bulk_policy_status=lit(s.policy_status),
        bulk_retention_policy=lit(s.retention), bulk_sensitivity=lit(s.sensitivity),
    )
    return p, out.select(*found.columns)


def manifest(s: Source, p: Plan) -> dict:
    """What a plan's manifest file holds."""
    body = {
        "source_id": s.source_id, "source_type": s.source_type, "corpus_kind": s.corpus_kind, "policy_status": s.policy_status, "bulk_run_id": p.run_id, "bulk_manifest_id": p.manifest_id,
        "extractor_counts": p.routes, "diagnostic_counts": p.reasons, "total_bytes_included": p.total_bytes, "limit_hit": any(r.startswith("max_") for r in p.reasons),
        "limit_reason": ",".join(sorted(r for r in p.reasons if r.startswith("max_"))) or None,
    }
    return body | {"manifest_sha256": hashlib.sha256(K.canonical_json(body).encode()).hexdigest()}


def manifest_summary(manifests: DataFrame) -> DataFrame:
    """One row over manifests(value: JSON text): sources, runs, files by route, skipped by reason, bytes, limits hit."""
    m = manifests.select(F.from_json("value", "source_id string, bulk_run_id string, extractor_counts map<string,bigint>, diagnostic_counts map<string,bigint>, total_bytes_included bigint, limit_hit boolean").alias("m")).where("m.bulk_run_id IS NOT NULL").select("m.*")
    sums = lambda c: F.aggregate(F.map_values(c), F.lit(0).cast("long"), lambda a, x: a + x)
    return m.agg(F.count_distinct("source_id").alias("sources"), F.count_distinct("bulk_run_id").alias("runs"), F.sum(sums("extractor_counts")).alias("included_files"), F.sum(sums("diagnostic_counts")).alias("skipped_files"),
                 F.sum("total_bytes_included").alias("total_bytes_included"), F.count_if("limit_hit").alias("limit_hits"))


# --- WARC -------------------------------------------------------------------------------------------------


# Payload types that are handed to an extractor, by the suffix that chooses it.
PAYLOADS = {
    "text/html": "html", "application/xhtml+xml": "html", "text/css": "css", "application/javascript": "js", "text/javascript": "js", "application/json": "json", "text/plain": "txt",
    "text/csv": "csv", "text/markdown": "md", "application/xml": "xml", "text/xml": "xml", "application/rss+xml": "xml", "application/atom+xml": "xml",
}


def payload_route(content_type: str, block: bytes) -> tuple[str | None, bytes]:
    """(suffix, payload) of a record's block: an HTTP response tells the type of what follows its header."""
    kind = content_type.partition(";")[0].strip().lower()
    if kind == "application/http":
        head, gap, block = block.partition(b"\r\n\r\n")
        m = re.search(rb"(?im)^content-type:\s*([^;\r\n]+)", head)
        kind = m[1].decode("latin-1").strip().lower() if gap and m else ""
    return PAYLOADS.get(kind), block


def gunzipped(data: bytes) -> bytes:
    """All gzip members of an archive; what follows a broken one is left out."""
    out, rest = [], memoryview(data)
    while len(rest) and bytes(rest[:2]) == b"\x1f\x8b":
        d = zlib.decompressobj(31)
        try:
            out.append(d.decompress(rest))
        except zlib.error:
            break
        rest = rest[len(rest) - len(d.unused_data) :] if d.unused_data else rest[:0]
    return b"".join(out)


def warc_observations(path: str, data: bytes) -> Iterator[dict]:
    """Records of an archive, gzipped or plain, read until the first malformed one. Payloads are named and measured, and those
    whose type an extractor knows are given to it, as files below the archive's path."""
    if data[:2] == b"\x1f\x8b":
        data = gunzipped(data)
    doc, at, n, seen, bad = K.within("warc.document", path), 0, 0, Counter(), None
    records: list[dict] = []
    version = None
    while at < len(data):
        first = data.find(b"\n", at)
        head_line = data[at:first].strip() if first >= 0 else b""
        if head_line not in (b"WARC/1.0", b"WARC/1.1"):
            bad = "unsupported-version" if head_line.startswith(b"WARC/") else "malformed-record"
            break
        nl = b"\r\n" if data[first - 1 : first + 1] == b"\r\n" else b"\n"
        stop = data.find(nl + nl, at)
        heads = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in data[first + 1 : stop].decode("latin-1").split(nl.decode()))} if stop >= 0 else {}
        length = heads.get("content-length", "")
        start = stop + 2 * len(nl)
        if stop < 0 or not length.isdigit() or start + int(length) > len(data):
            bad = "malformed-content-length"
            break
        version = version or head_line.decode().removeprefix("WARC/")
        n += 1
        uri = heads.get("warc-target-uri")
        identity, origin, strength = (f"record-id:{heads['warc-record-id']}", "warc-record-id", "strong") if heads.get("warc-record-id") else (
            "hash:" + hashlib.sha256("|".join([heads.get("warc-date", ""), uri or "", heads.get("warc-type", "")]).encode()).hexdigest(), "date-target-type", "weak") if uri else (f"ordinal:{n}", "ordinal", "structural")
        seen[identity] += 1
        twice = seen[identity] > 1
        key = K.key("warc.record", doc, identity + (f":duplicate-{seen[identity]}" if twice else ""))
        common = {"record_type": heads.get("warc-type"), "record_ordinal": n, "target_uri_summary": redact_url(uri)[:160] if uri else None, "target_uri_redacted": redact_url(uri) != uri if uri else None}
        make = lambda kind, source, **kw: observation(f"warc.{kind}", path, source, "cairn-warc", "extracted", **kw)
        records.append(make("record", f"warc-record:{n}", target=key, source_key=doc, format="warc", warc_version=version, identity_source=origin, identity_strength=strength, duplicate_identity=True if twice else None,
                            warc_date=heads.get("warc-date"), content_type=heads.get("content-type"), payload_byte_length=int(length), **common))
        records.append(make("header", f"warc-header:{n}", header_names=sorted(h for h in heads if not secret_name(h)), record_key=key))
        if uri:
            target = K.key("external.url", redact_url(uri)) if uri.lower().startswith(("http://", "https://")) else K.unknown("external.url", "unsupported-scheme")
            records.append(make("reference", f"warc-reference:{n}", target=target, source_key=key, reference_kind="target-uri", not_fetched=True, target_kind=target.partition(":")[0], **common))
        block = data[start : start + int(length)]
        suffix, payload = payload_route(heads.get("content-type", ""), block)
        routed = f"{path}.records/{n}.{suffix}" if suffix else None
        records.append(make("payload", f"warc-payload:{n}", record_key=key, payload_byte_length=int(length), payload_sha256=hashlib.sha256(block).hexdigest(), extractor_route=suffix, routed_path=routed))
        if routed:
            records += repository.extracted_from(routed, payload)
        at = start + int(length)
        while data[at : at + 2] == b"\r\n" or data[at : at + 1] == b"\n":
            at += 2 if data[at : at + 2] == b"\r\n" else 1
    yield observation("warc.document", path, "warc-document", "cairn-warc", "extracted", target=doc, format="warc", warc_version=version, record_count=n, parsed_record_count=n, skipped_record_count=0)
    yield from records
    if bad:
        yield observation("warc.parse_error", path, "warc-parse-error", "cairn-warc", "unknown", error_kind=bad, recovered=False, byte_offset=at)


# --- saved pages and reports ------------------------------------------------------------------------------

# What a saved folder may be.
ARCHIVE_KINDS = ("saved-page", "report", "export")


def archive_manifest(spark: SparkSession, root: str, s: Source, kind: str = "saved-page") -> tuple[dict, Plan]:
    """A folder that was saved whole (a page with its assets, a report): its manifest and plan. The entry is the index page, or
    the first page there is."""
    if kind not in ARCHIVE_KINDS:
        raise PolicyRefused(f"archive kind must be one of {', '.join(ARCHIVE_KINDS)}")
    p = plan(repository.scan(spark, root).select("path", "content"), s)
    pages = p.included.where("route = 'html'").select("path")
    first = pages.orderBy(~F.col("path").rlike(r"(^|/)index\.html?$"), F.length("path"), "path").limit(1).collect()
    return manifest(s, p) | {"archive_kind": kind, "entry_path": first[0].path if first else None}, p


def archive_observations(spark: SparkSession, root: str, s: Source, kind: str = "saved-page", run_id: int = 1) -> tuple[dict, DataFrame]:
    """The manifest of a saved folder and its observations with their provenance."""
    m, p = archive_manifest(spark, root, s, kind)
    files = repository.classify(p.included.select("path", "content", F.lit(False).alias("executable")))
    found = repository.observe(files, run_id)
    facts = p.included.select("path", F.col("sha256").alias("sha"), "bytes")
    lit = F.lit
    out = annotated(
        found.join(facts, "path"), source_id_configured=lit(s.source_id), source_type=lit(s.source_type), source_display_name=lit(s.display_name), source_policy_status=lit(s.policy_status), source_run_id=lit(p.run_id),
        source_artifact_id=lit(p.manifest_id), source_artifact_path=F.col("path"), source_artifact_sha256=F.col("sha"), source_artifact_bytes=F.col("bytes"), archive_kind=lit(kind), archive_entry_path=lit(m["entry_path"]),
        acquisition_method=lit("local-import"), artifact_retention_policy=lit(s.retention),
    )
    return m, out.select(*found.columns)


# --- feeds ------------------------------------------------------------------------------------------------

Fetch = Callable[[str], tuple[bytes, int, str]]


def https_fetch(timeout: float = 20.0, most: int = 10 << 20) -> Fetch:
    """A transport for feeds: one GET over https, at most so many bytes, redirects refused unless they stay on https and host."""

    class Careful(urllib.request.HTTPRedirectHandler):
        def redirect_request(self, req, fp, code, msg, headers, newurl):  # type: ignore[no-untyped-def]
            old, new = urlsplit(req.full_url), urlsplit(newurl)
            if new.scheme != "https" or new.hostname != old.hostname:
                raise PolicyRefused("the feed redirects to another place")
            return super().redirect_request(req, fp, code, msg, headers, newurl)

    def fetch(url: str) -> tuple[bytes, int, str]:
        with urllib.request.build_opener(Careful).open(urllib.request.Request(url, headers={"User-Agent": "cairngraph"}), timeout=timeout) as answer:
            return answer.read(most + 1), answer.status, answer.headers.get_content_type()

    return fetch


def retained(spark: SparkSession, body: bytes, folder: str, s: Source) -> str:
    """Keeps an artifact under its digest, in any store that Spark writes; the path. Kept once, it is not written again."""
    path = f"{folder.rstrip('/')}/{s.source_id}/{hashlib.sha256(body).hexdigest()}.xml"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        out = fs.create(p, True)
        out.write(bytearray(body))
        out.close()
    return path


def ingest_feed(spark: SparkSession, s: Source, folder: str, acquired_at: str, fetch: Fetch | None = None, run_id: int = 1) -> DataFrame:
    """Fetches a feed, keeps what came under the folder, and gives its observations."""
    body, status, kind = (fetch or https_fetch())(s.url or "")
    path = retained(spark, body, folder, s)
    return feed_observations(spark, s, lambda url: (body, status, kind), acquired_at, f"feeds/{s.source_id}/{path.rpartition('/')[2]}", run_id)


def feed_observations(spark: SparkSession, s: Source, fetch: Fetch, acquired_at: str, artifact_path: str, run_id: int = 1, most: int = 10 << 20) -> DataFrame:
    """Fetches the source's one feed through the given callable (body, status, content type), and extracts it with provenance."""
    if not s.url or not s.url.startswith("https://"):
        raise PolicyRefused("a feed needs an https url")
    body, status, kind = fetch(s.url)
    if len(body) > most:
        raise PolicyRefused("the feed is too large")
    digest = hashlib.sha256(body).hexdigest()
    run = hashlib.sha256(f"{s.source_id}:{acquired_at}:{digest}".encode()).hexdigest()[:24]
    files = repository.classify(spark.createDataFrame([(artifact_path, bytearray(body), False)], "path string, content binary, executable boolean"))
    lit = F.lit
    return annotated(
        repository.observe(files, run_id), source_id_configured=lit(s.source_id), source_type=lit(s.source_type), source_policy_status=lit(s.policy_status), source_display_name=lit(s.display_name), source_run_id=lit(run),
        source_artifact_id=lit(digest[:24]), source_artifact_path=lit(artifact_path), source_artifact_sha256=lit(digest), source_artifact_bytes=lit(len(body)), source_acquired_at=lit(acquired_at), acquisition_method=lit("GET"),
        acquisition_http_status=lit(status), acquisition_content_type=lit(kind), acquisition_url_summary=lit(redact_url(s.url)), artifact_retention_policy=lit("local-artifact"),
    )


# --- APIs -------------------------------------------------------------------------------------------------


def redact_value(value: object, name: str | None = None) -> object:
    """The value with every member under a secret name replaced by its type."""
    if name and secret_name(name):
        kind = "null" if value is None else "boolean" if isinstance(value, bool) else "number" if isinstance(value, (int, float)) else "string" if isinstance(value, str) else "array" if isinstance(value, list) else "object"
        return {"redacted": True, "redaction_reason": "secret-prone-key", "literal_type": kind}
    if isinstance(value, Mapping):
        return {str(k): redact_value(v, str(k)) for k, v in value.items()}
    if isinstance(value, list):
        return [redact_value(v) for v in value]
    return redact_url(value) if isinstance(value, str) and "://" in value else value


def api_observations(spark: SparkSession, s: Source, responses: Mapping[str, object], run_id: int = 1) -> DataFrame:
    """Observations of API responses by name (a fixture, or what a caller's transport returned), redacted first."""
    kept = {n: K.canonical_json(redact_value(v)) for n, v in responses.items()}
    run = "api-" + hashlib.sha256(K.canonical_json([s.source_id, kept]).encode()).hexdigest()[:24]
    rows = [(f"api/{s.source_id}/{run}/{n}.json", bytearray(v.encode()), False) for n, v in sorted(kept.items())]
    files = repository.classify(spark.createDataFrame(rows, "path string, content binary, executable boolean"))
    return annotated(repository.observe(files, run_id), api_run_id=F.lit(run), source_id=F.lit(s.source_id), source_type=F.lit(s.source_type), api_policy_status=F.lit(s.policy_status))


def warc_import(spark: SparkSession, root: str, s: Source, run_id: int = 1) -> DataFrame:
    """Observations of all archives below root, plain or gzipped, one task a file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{warc,warc.gz}").load(root).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("path"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in OBSERVATIONS.split(",")]
        ints = {"schema_version", "start_line", "end_line"}
        for b in batches:
            rows = [o | {"metadata": K.canonical_json(o["metadata"]), "seq": i} for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for i, o in enumerate(warc_observations(p, c or b""))]
            yield pa.RecordBatch.from_arrays([*(pa.array([r[n] for r in rows], pa.int32() if n in ints else pa.string()) for n in names), pa.array([r["seq"] for r in rows], pa.int64())], [*names, "seq"])

    found = numbering.numbered_by(files.mapInArrow(run, f"{OBSERVATIONS}, seq bigint").withColumn("file", F.regexp_extract("path", r"^(.*?\.warc(?:\.gz)?)", 1)), "file", "seq", groups=files.select(F.col("path").alias("file"))).withColumn("run_id", F.lit(run_id).cast("long")).drop("seq", "file")
    return annotated(found, source_id=F.lit(s.source_id), source_type=F.lit(s.source_type), source_policy_status=F.lit(s.policy_status))
