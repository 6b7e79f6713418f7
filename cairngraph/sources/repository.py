"""Repositories as sources: files classified inside the JVM, extractors in one Arrow map.

A repository is read with the binaryFile source; ignored folders are dropped by path before content is
read. Language, role and hash are Column expressions. What extractors must know of other files (paths,
modules, anchors) comes from one join, whatever the repository's size: a first pass of the extractors notes what each
file asks for, the join with all that there is tells which of it exists, and the second pass is given that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairngraph.functions import keys as K
from cairngraph.operators import config, css, documents, feed, html, javascript, mail, markdown, nix, python_code, ruby, shell
from cairngraph.operators.base import OBSERVATIONS, VERSION, Context, extracted
from cairngraph.shared import shared_folder
from cairngraph.sources import numbering

# Folders, extensions and names that decide how a file is classified.
IGNORED = (".git", ".hg", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".venv", "__pycache__", "build", "dist", "htmlcov", "node_modules")
GENERATED = ("coverage", "generated", "reports")
LANGUAGES = {
    "applescript": "applescript", "awk": "awk", "bash": "shell", "sh": "shell", "zsh": "shell", "css": "css", "csv": "csv", "tsv": "tsv", "eml": "eml", "mbox": "mbox", "htm": "html", "html": "html",
    "js": "javascript", "cjs": "javascript", "mjs": "javascript", "jsx": "javascript", "ts": "javascript", "tsx": "javascript", "mts": "javascript", "cts": "javascript", "json": "json", "jsonc": "jsonc",
    "jsonl": "jsonl", "md": "markdown", "markdown": "markdown", "nix": "nix", "odt": "odf", "ods": "odf", "ott": "odf", "ots": "odf", "plist": "plist", "py": "python", "rb": "ruby", "rake": "ruby",
    "gemspec": "ruby", "sql": "sql", "tex": "latex", "latex": "latex", "txt": "text", "tf": "terraform", "tfvars": "terraform", "toml": "toml", "xml": "xml", "yaml": "yaml", "yml": "yaml",
}
RUBY_NAMES = ("Gemfile", "Rakefile", "Vagrantfile")
CONFIG_NAMES = (".gitignore", "flake.lock", "flake.nix", "pyproject.toml")
REQUIREMENTS = r"^(?:requirements(?:-[0-9A-Za-z_.-]+)?|dev-requirements|test-requirements)\.txt$"

_TEXT = {"shell": shell.extract, "python": python_code.extract, "markdown": markdown.extract, "html": html.extract, "css": css.extract, "nix": nix.extract, "ruby": ruby.extract, "javascript": javascript.extract,
         **dict.fromkeys(("json", "jsonc", "jsonl", "toml", "yaml", "plist", "terraform"), config.extract), **dict.fromkeys(("text", "csv", "tsv", "latex"), documents.extract)}
_BYTES = {"eml": mail.extract, "mbox": mail.extract, "odf": documents.odf}


@dataclass(frozen=True)
class Profile:
    """Overrides of a project: exact paths to roles, and folders whose files are generated, commands or scripts."""

    roles: dict[str, str] = field(default_factory=dict)
    languages: dict[str, str] = field(default_factory=dict)
    generated_dirs: tuple[str, ...] = ()
    command_dirs: tuple[str, ...] = ()
    script_dirs: tuple[str, ...] = ()


def _name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def language(path: Column, first_line: Column) -> Column:
    name = _name(path)
    by_suffix = F.element_at(F.create_map(*(x for k, v in LANGUAGES.items() for x in (F.lit(k), F.lit(v)))), F.element_at(F.split(name, r"\."), -1))
    bang = first_line.startswith("#!")
    return (
        F.when(F.regexp_like(name, F.lit(REQUIREMENTS)), F.lit("python"))
        .when(name.isin(*RUBY_NAMES), F.lit("ruby"))
        .when(F.contains(name, F.lit(".")) & by_suffix.isNotNull(), by_suffix)
        .when(bang & F.contains(first_line, F.lit("python")), F.lit("python"))
        .when(bang & F.contains(first_line, F.lit("sh")), F.lit("shell"))
        .when(bang & F.contains(first_line, F.lit("ruby")), F.lit("ruby"))
        .otherwise(F.lit("unknown"))
    )


def generated(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*(F.lit(g) for g in GENERATED)))


def role(path: Column, executable: Column, is_generated: Column) -> Column:
    name, parts = _name(path), F.split(path, "/")
    return (
        F.when(is_generated, F.lit("generated"))
        .when(F.arrays_overlap(parts, F.array(F.lit("test"), F.lit("tests"))) | F.contains(name, F.lit(".test.")), F.lit("test"))
        .when(path.startswith("docs/") | name.endswith(".md"), F.lit("documentation"))
        .when(name.isin(*CONFIG_NAMES) | F.regexp_like(name, F.lit(REQUIREMENTS)) | F.regexp_like(name, F.lit(r"\.(plist|tf|tfvars)$")) | path.startswith(".github/"), F.lit("config"))
        .when(executable | path.startswith("bin/"), F.lit("entrypoint"))
        .when(path.startswith("src/"), F.lit("source"))
        .otherwise(F.lit("unknown"))
    )


def classify(files: DataFrame, profile: Profile | None = None) -> DataFrame:
    """files(path, content, executable) with language, role, generated, content_hash and confidence."""
    p, path = profile or Profile(), F.col("path")
    head = F.split(F.substring("content", 1, 256).cast("string"), "\n")[0]
    under = lambda dirs: F.lit(False) if not dirs else F.greatest(F.lit(False), *(path.startswith(d.rstrip("/") + "/") for d in dirs))
    lookup = lambda m: F.element_at(F.create_map(*(x for k, v in m.items() for x in (F.lit(k), F.lit(v)))), path) if m else F.lit(None).cast("string")
    out = files.withColumn("generated", generated(path) | under(p.generated_dirs))
    own = F.coalesce(lookup(p.roles), F.when(under(p.generated_dirs), F.lit("generated")), F.when(under(p.command_dirs), F.lit("entrypoint")), F.when(under(p.script_dirs), F.lit("script")))
    return out.withColumns({
        "language": F.coalesce(lookup(p.languages), language(path, head)), "role": F.coalesce(own, role(path, F.col("executable"), F.col("generated"))), "content_hash": F.sha2("content", 256),
        "confidence": F.when(own.isNotNull() | lookup(p.languages).isNotNull(), F.lit("manual")).otherwise(F.lit("extracted")),
    })


def scan(spark: SparkSession, root: str) -> DataFrame:
    """path (inside root), content and executable of the files below root but for ignored folders."""
    top = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(top)
    inner = F.regexp_replace(F.col("path"), rf"^(?:[a-z0-9]+:)?/*{top.lstrip('/').replace('.', chr(92) + '.')}/", "")
    path = F.url_decode(F.replace(inner, F.lit("+"), F.lit("%2B")))
    return files.where(~F.regexp_like("path", F.lit(rf"/({'|'.join(i.replace('.', chr(92) + '.') for i in IGNORED)})/"))).select(path.alias("path"), "content", F.lit(False).alias("executable"))


def file_observations(classified: DataFrame) -> DataFrame:
    metadata = F.to_json(F.struct("content_hash", "executable", "generated", "language", "role"))
    return classified.select(
        F.lit("file").alias("kind"), F.col("path").alias("source_id"), "path", "confidence", F.lit("cairn-discovery").alias("extractor"), F.lit(VERSION).alias("extractor_version"), F.lit(1).alias("schema_version"),
        F.lit(None).cast("int").alias("start_line"), F.lit(None).cast("int").alias("end_line"), F.col("path").alias("name"), K.file_key_col("path").alias("target"), metadata.alias("metadata"), F.lit(-1).cast("long").alias("seq"),
    )


def _choose(path: str, content: bytes, context: Context) -> Iterator[dict]:
    """Observations of one file, by the extractor of its kind."""
    name = path.rpartition("/")[2]
    suffix = name.rpartition(".")[2].lower() if "." in name else ""
    kind = "python-requirements" if config.re.match(REQUIREMENTS, name) else "ruby" if name in RUBY_NAMES else LANGUAGES.get(suffix)
    if kind in _BYTES:
        yield from _BYTES[kind](path, content, context)
        return
    text = content.decode("utf-8", "replace")
    if kind is None and text.startswith("#!"):
        first = text.split("\n", 1)[0]
        kind = "python" if "python" in first else "shell" if "sh" in first else "ruby" if "ruby" in first else None
    if kind == "xml":
        yield from (feed.extract if config.re.search(r"<(rss|feed|rdf:RDF)\b", text[:2000]) else config.extract)(path, text, context)
    elif kind == "json" and "jsonfeed.org" in text[:2000]:
        yield from feed.extract(path, text, context)
    elif kind == "python-requirements":
        yield from config.extract(path, text, context)
    elif kind in _TEXT:
        yield from _TEXT[kind](path, text, context)


def extracted_from(path: str, content: bytes) -> list[dict]:
    """Observations of one file that no repository holds."""
    return list(_choose(path, content, Context()))


class _Asked:
    """Stands in for a set of names, or a map from paths to sets of anchors: holds nothing and notes what is asked for."""

    def __init__(self, what: str, names: set[tuple[str, str]], of: str = "") -> None:
        self.what, self.names, self.of = what, names, of

    def __contains__(self, name: str) -> bool:
        self.names.add((self.what, self.of + name))
        return False

    def get(self, path: str, default: object = None) -> _Asked:
        return _Asked(self.what, self.names, path + "#")


def _names(files: DataFrame, find: Callable[[str, bytes], Iterable[tuple[str, str]]]) -> DataFrame:
    """(path, what, name) of all that find yields of files(path, content)."""

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            rows = [(p, *n) for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for n in find(p, c or b"")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], ["path", "what", "name"])

    return files.mapInArrow(run, "path string, what string, name string")


def _there_is(path: str, page: bytes) -> Iterator[tuple[str, str]]:
    """A file's path, its module, and the anchors of a Markdown page."""
    yield "path", path
    if path.endswith(".py"):
        yield "module", python_code.module_of(path)[0]
    yield from (("anchor", f"{path}#{h['anchor']}") for h in markdown.headings(page.decode("utf-8", "replace")))


def _asks(path: str, content: bytes) -> set[tuple[str, str]]:
    names: set[tuple[str, str]] = set()
    for _ in _choose(path, content, Context(_Asked("path", names), _Asked("module", names), _Asked("anchor", names))):
        pass
    return names


def _with_known(classified: DataFrame) -> DataFrame:
    """path, content, and known: what exists of all that a file asks for, as array<struct<what, name>>."""
    page = F.when(F.col("language") == "markdown", F.col("content")).alias("content")
    there = _names(classified.select("path", page), _there_is).select("what", "name").distinct()
    found = _names(classified.select("path", "content"), _asks).join(there, ["what", "name"])
    known = found.groupBy("path").agg(F.collect_set(F.struct("what", "name")).alias("known"))
    return classified.select("path", "content").join(known, "path", "left")


def _context(known: list[dict[str, str]] | None) -> Context:
    of: dict[str, list[str]] = {"path": [], "module": [], "anchor": []}
    for k in known or ():
        of[k["what"]].append(k["name"])
    anchors: dict[str, set[str]] = {}
    for path, _, anchor in (n.rpartition("#") for n in of["anchor"]):
        anchors.setdefault(path, set()).add(anchor)
    return Context(frozenset(of["path"]), frozenset(of["module"]), {p: frozenset(a) for p, a in anchors.items()})


def discover(spark: SparkSession, root: str, profile: Profile | None = None, run_id: int = 1) -> DataFrame:
    """All observations of a repository, in the order of paths, then of the files' own facts."""
    return observe(classify(scan(spark, root), profile), run_id)


def observe(classified: DataFrame, run_id: int = 1, context: Context | None = None) -> DataFrame:
    """Observations of classified files, with ordinals by path and place in the file.

    What the extractors tell is written to the shared folder once: numbering looks at it twice, and would run them again each time.
    Without a context they run twice, as what exists of the names that a file asks for is known only when all have asked."""
    spark = classified.sparkSession
    if context is None:
        facts = extracted(_with_known(classified), lambda path, content, known: _choose(path, content, _context(known)), "known")
    else:
        facts = extracted(classified, lambda path, content: _choose(path, content, context))
    at = shared_folder(spark, "facts")
    facts.write.parquet(at)
    rows = file_observations(classified).unionByName(spark.read.schema(facts.schema).parquet(at))
    names = [f.split()[0] for f in OBSERVATIONS.split(",")]
    return numbering.numbered_by(rows, "path", "seq", groups=classified).select(F.lit(run_id).cast("long").alias("run_id"), "ordinal", *names)


def with_selector_matches(observations: DataFrame) -> DataFrame:
    """The observations and those of css.selector_matches, numbered after them."""
    found = css.selector_matches(observations)
    last = observations.agg(F.coalesce(F.max("ordinal"), F.lit(-1)).alias("last"), F.coalesce(F.max("run_id"), F.lit(1)).alias("run_id"))
    numbered = numbering.numbered_by(found, "path", "source_id", groups=observations.where("kind LIKE 'css.%'")).crossJoin(F.broadcast(last)).withColumn("ordinal", F.col("last") + 1 + F.col("ordinal"))  # one row of `last`
    return observations.unionByName(numbered.drop("last"))
