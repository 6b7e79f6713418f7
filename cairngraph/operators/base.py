"""What extractors share: an extractor is a plain function (path, content, context) that yields observation
objects; frames apply it to files through one Arrow map, so files spread over tasks and nothing is
shuffled. Extractors never run, import, fetch or open anything.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from cairngraph.functions import keys as K
from cairngraph.functions.columns import SECRET_MARKERS

VERSION = "1.0.0"
URL = re.compile(r"https?://[^\s<>\"')\]]+")


@dataclass(frozen=True)
class Context:
    """What an extractor may know of the other files: their paths, modules and anchors."""

    paths: frozenset[str] = frozenset()
    modules: frozenset[str] = frozenset()
    anchors: dict[str, frozenset[str]] = field(default_factory=dict)
    flake_ref: str = "."


Extractor = Callable[[str, str, Context], Iterator[dict]]


def observation(kind: str, path: str, source: str, extractor: str, /, confidence: str = "heuristic", line: int | None = None, end: int | None = None, name: str | None = None, target: str | None = None, **metadata: object) -> dict:
    return {
        "kind": kind, "source_id": f"{path}#{source}", "path": path, "confidence": confidence, "extractor": extractor, "extractor_version": VERSION, "schema_version": 1, "start_line": line,
        "end_line": line if end is None else end, "name": name, "target": target, "metadata": {k: v for k, v in metadata.items() if v is not None},
    }


def slug(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", "-", text.lower()).strip("-") or "x"


def secret_text(text: str) -> bool:
    low = text.lower()
    return any(m in low for m in SECRET_MARKERS)


def secret_name(name: str) -> bool:
    squashed = re.sub("[^a-z0-9]", "", name.lower())
    return any(m.replace("_", "") in squashed for m in SECRET_MARKERS) or bool(re.search(r"(access|private|signing|encryption|ssh|master|license)key$", squashed))


def summary(text: str, most: int = 160) -> str | None:
    short = " ".join(text.split())[:most]
    return short or None


def resolve(path: str, relative: str) -> str | None:
    """A path written in a file, as a path of the repository; None if it leaves it."""
    if not relative or relative.startswith(("/", "~")):
        return None
    whole = posixpath.normpath(posixpath.join(posixpath.dirname(path), relative))
    return None if whole.startswith("..") or whole == "." else whole


def reference_target(path: str, value: str, dynamic: str = "${") -> tuple[str, str, str]:
    """(key, kind, reason) of a value that refers to something."""
    v = value.strip()
    if not v:
        return K.unknown("reference", "missing-target"), "unknown", "missing-target"
    if re.match(r"(?i)(https?|mailto):", v):
        return K.key("external.url", redact_url(v)), "external.url", "url-literal"
    if re.match(r"(?i)javascript:", v):
        return K.dynamic("external.url", "javascript-url"), "dynamic", "javascript-url"
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", v):
        return K.unknown("external.url", "unsupported-scheme"), "unknown", "unsupported-scheme"
    if dynamic in v or "{{" in v or "$" in v:
        return K.dynamic("file", "dynamic-reference"), "dynamic", "dynamic-reference"
    if v.startswith("/"):
        return K.external("file", "absolute-config-reference"), "external", "absolute-path"
    inside = resolve(path, re.split("[?#]", v)[0])
    if inside is None:
        return K.unknown("file", "repo-escaping-reference"), "unknown", "repo-escaping-reference"
    return K.file_key(inside), "file", "relative-file-reference"


def redact_url(url: str) -> str:
    url = re.sub(r"(?i)^([a-z][a-z0-9+.-]*://)[^/@\s]*@", r"\1<redacted>@", url)
    return re.sub(r"(?i)([?&][^=&#]*(?:token|secret|passw|key|auth|signature)[^=&#]*=)[^&#]*", r"\1<redacted>", url)


OBSERVATIONS = (
    "kind string, source_id string, path string, confidence string, extractor string, extractor_version string, schema_version int, start_line int, end_line int, name string,"
    " target string, metadata string"
)
_INTS = {"schema_version", "start_line", "end_line"}
_NAMES = [f.split()[0] for f in OBSERVATIONS.split(",")]


#: Observations that a task holds before it hands them on, however many a file or a batch of files has.
AT_ONCE = 2000


def extracted(files: DataFrame, choose: Callable[..., Iterator[dict]], extra: str = "") -> DataFrame:
    """Observations of files(path, content): choose yields those of one file, given also the column `extra` if one is
    named. `seq` numbers them within the file."""
    columns = ["path", "content", *([extra] if extra else [])]

    def handed(rows: list[dict]) -> pa.RecordBatch:
        cols = [pa.array([r[n] for r in rows], pa.int32() if n in _INTS else pa.string()) for n in _NAMES]
        return pa.RecordBatch.from_arrays([*cols, pa.array([r["seq"] for r in rows], pa.int64())], [*_NAMES, "seq"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:
            for i in range(batch.num_rows):
                path, content, *more = (c[i].as_py() for c in batch.columns)
                for seq, o in enumerate(choose(path, content or b"", *more)):
                    rows.append(o | {"metadata": K.canonical_json(o["metadata"]), "seq": seq})
                    if len(rows) >= AT_ONCE:
                        yield handed(rows)
                        rows = []
        if rows:
            yield handed(rows)

    return files.select(*columns).mapInArrow(run, f"{OBSERVATIONS}, seq bigint")
