"""Observations to nodes, edges, evidence, links and diagnostics.

Interpreting a row needs only that row, so it is one Arrow map without a shuffle. Merging is keyed
aggregation: a node's first writer decides its name and metadata (min_by the order of writing), the
strongest confidence wins (max of a rank), file metadata and edge metadata collect the distinct values in
order of first sight. Repeated equal values are counted out by a partial aggregation before anything
is collected, so a hub that a third of all rows point at sends one row per distinct value and task.

Metadata of an edge is folded in the order of its rows. Values of a field that are lists are united, and a scalar that differs
from what there is nests it to the left: from the first difference on every row counts, also one that says the same again. As
long as no field differs so, folding the distinct metadata once, in order of first sight, is the same; edges where one does
(few: what such a fold returns grows with its rows) are folded again over all their rows in order.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairngraph.functions.keys import EMPTY_JSON_SHA256, KEY_VERSION, canonical_json, edge_key_col, kind_of_key
from cairngraph.plans.rules import FILE_CONFLICT_FIELDS, FILE_FIELDS, interpret
from cairngraph.schemas import CONFIDENCE

_ROW = (
    "ordinal bigint, nodes array<struct<key: string, display: string, metadata: string, link: string>>, edges array<struct<source: string, kind: string, target: string, metadata: string>>,"
    " diagnostics array<struct<severity: string, category: string, message: string, field: string, value: string, placeholder_key: string>>, evidence string"
)
#: Observations that a task interprets before it hands on what they mean.
AT_ONCE = 1000
_IN = ("ordinal", "kind", "source_id", "path", "confidence", "name", "target", "metadata")
_TEXT = pa.string()
_TYPES = (
    pa.int64(),
    pa.list_(pa.struct([(n, _TEXT) for n in ("key", "display", "metadata", "link")])),
    pa.list_(pa.struct([(n, _TEXT) for n in ("source", "kind", "target", "metadata")])),
    pa.list_(pa.struct([(n, _TEXT) for n in ("severity", "category", "message", "field", "value", "placeholder_key")])),
    _TEXT,
)


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame
    evidence: DataFrame
    node_evidence: DataFrame
    edge_evidence: DataFrame
    diagnostics: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {"canonical_nodes": self.nodes, "canonical_edges": self.edges, "canonical_evidence": self.evidence, "canonical_node_evidence": self.node_evidence,
                "canonical_edge_evidence": self.edge_evidence, "diagnostics": self.diagnostics}


def _interpreted(observations: DataFrame) -> DataFrame:
    """The meaning of every observation, beside its envelope."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, AT_ONCE) for b in batches for i in range(0, b.num_rows, AT_ONCE)):
            rows = []
            for o in batch.to_pylist():
                m = interpret(o)
                rows.append(
                    (
                        o["ordinal"],
                        [{"key": k, "display": d, "metadata": canonical_json(x), "link": link} for k, d, x, link in m.nodes],
                        [{"source": s, "kind": k, "target": t, "metadata": canonical_json(x)} for s, k, t, x in m.edges],
                        [dict(zip(("severity", "category", "message", "field", "value", "placeholder_key"), (*d[:4], None if d[4] is None else canonical_json(d[4]), d[5]), strict=True)) for d in m.diagnostics],
                        None if m.evidence is None else canonical_json(m.evidence),
                    )
                )
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [*batch.select(list(_REST)).columns, *(pa.array(c, t) for c, t in zip(cols[1:], _TYPES[1:], strict=True))], [*_REST, "nodes", "edges", "diagnostics", "evidence"]
            )

    src = observations.select(*_REST, "name", "target", "metadata")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.schema.fields if f.name in _REST)
    return src.mapInArrow(run, f"{schema}, {_ROW.partition(', ')[2]}")


_REST = ("ordinal", "kind", "source_id", "path", "confidence", "schema_version", "start_line", "end_line", "extractor", "extractor_version")


def rank(confidence: Column) -> Column:
    return F.array_position(F.array(*(F.lit(c) for c in CONFIDENCE)), confidence).cast("int") - 1


def of_rank(r: Column) -> Column:
    return F.get(F.array(*(F.lit(c) for c in CONFIDENCE)), r)


def evidence_key(ordinal: Column, path: Column, start: Column, end: Column, extractor: Column, source_id: Column) -> Column:
    line = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    return F.concat(F.lit("evidence:"), ordinal.cast("string"), F.lit(":"), path, F.lit(":"), line(start), F.lit("-"), line(end), F.lit(":"), extractor, F.lit(":"), source_id)


class _Field:
    """A field of an edge's metadata while rows are folded: a scalar, or a list whose first element may be the list before
    it, and so on; kept flat, as each level may come from one more row."""

    def __init__(self, value: object) -> None:
        self.scalar = not isinstance(value, list)
        self.inner: list = [value] if self.scalar else list(value)
        self.outer: list[list] = []  # of each list around the inner one, what stands behind the list that it holds

    def nested(self, levels: int) -> list:
        out = self.inner
        for level in self.outer[:levels]:
            out = [out, *level]
        return out

    def add(self, name: str, value: object) -> None:
        own = self.inner[0] if self.scalar else None
        if self.scalar and name == "privileged_observed" and isinstance(own, bool) and isinstance(value, bool):
            self.inner = [own or value]
        elif self.scalar:
            if own != value:
                self.scalar, self.inner = False, [own, value]
        elif isinstance(value, list):
            top = self.outer[-1] if self.outer else self.inner
            for x in value:
                if x not in top and not (self.outer and isinstance(x, list) and x == self.nested(len(self.outer) - 1)):
                    top.append(x)
        else:
            self.outer.append([value])

    def text(self) -> str:
        if self.scalar:
            return canonical_json(self.inner[0])
        return "[" * len(self.outer) + canonical_json(self.inner) + "".join("".join("," + canonical_json(x) for x in level) + "]" for level in self.outer)


def fold(metadata: Iterable[str]) -> str:
    """Merges edge metadata (canonical JSON objects) in order."""
    out: dict[str, _Field] = {}
    for m in map(json.loads, metadata):
        for k, v in m.items():
            if k in out:
                out[k].add(k, v)
            else:
                out[k] = _Field(v)
    return "{" + ",".join(f"{canonical_json(k)}:{out[k].text()}" for k in sorted(out)) + "}"


def is_calm(metadata: list[str]) -> bool:
    """Whether folding the distinct metadata once is folding all rows: no field has scalars that differ, or scalars and lists."""
    seen: dict[str, object] = {}
    for m in map(json.loads, metadata):
        for k, v in m.items():
            old = seen.setdefault(k, v)
            flags = k == "privileged_observed" and isinstance(old, bool) and isinstance(v, bool)
            if not flags and not (isinstance(old, list) and isinstance(v, list)) and (isinstance(old, list) or isinstance(v, list) or old != v):
                return False
    return True


@F.pandas_udf(T.StringType())
def _folded(lists: pd.Series) -> pd.Series:
    return lists.map(lambda x: x[0] if len(x) == 1 else fold(x))


@F.pandas_udf(T.StringType())
def _folded_if_calm(lists: pd.Series, rows: pd.Series) -> pd.Series:
    """Of distinct metadata in order of first sight and the number of rows; null if the rows themselves are needed."""
    return pd.Series([x[0] if len(x) == 1 else fold(x) if n == len(x) or is_calm(x) else None for x, n in zip(lists, rows, strict=True)], dtype=object)


def _file_fields(written: DataFrame) -> DataFrame:
    """(key, field, values in order of first sight as JSON texts with their ordinals) of `file` observations."""
    each = F.array(*(F.struct(F.lit(f).alias("field"), _raw(f).alias("value")) for f in FILE_FIELDS))
    rows = written.select("key", "ordinal", "source_id", "path", F.explode(each).alias("f")).where("f.value <> ''")
    seen = rows.groupBy("key", "f.field", "f.value").agg(F.min_by(F.struct("ordinal", "source_id", "path"), "ordinal").alias("at"))
    return seen.groupBy("key", "field").agg(F.array_sort(F.collect_list(F.struct(F.col("at.ordinal").alias("ordinal"), "value", F.col("at.source_id").alias("source_id"), F.col("at.path").alias("path")))).alias("values"))


def _raw(name: str) -> Column:
    """A field of canonical metadata as JSON text ('' if it is not there)."""
    return F.regexp_extract("metadata", rf'[{{,]"{name}":("(?:[^"\\]|\\.)*"|[^,}}\[{{]+)', 1)


def canonicalize(observations: DataFrame, keep: Callable[[DataFrame], DataFrame] | None = None) -> Graph:
    """observations: the envelope with unique ordinals, of one run. All tables of the graph derive from the interpreted
    rows; keep (which writes and rereads them) is for those who want more than one, as each would interpret anew."""
    rows = _interpreted(observations)
    rows = rows if keep is None else keep(rows)
    ev = rows.where("evidence IS NOT NULL").withColumn("evidence_key", evidence_key(*(F.col(c) for c in ("ordinal", "path", "start_line", "end_line", "extractor", "source_id"))))
    evidence = ev.select(
        F.lit(KEY_VERSION).alias("graph_key_version"), "evidence_key", "ordinal", F.col("schema_version").alias("raw_schema_version"), F.col("kind").alias("raw_kind"),
        F.col("source_id").alias("raw_source_id"), "path", "start_line", "end_line", "extractor", "extractor_version", "confidence", F.col("evidence").alias("metadata"),
    )
    written = ev.select("ordinal", "kind", "source_id", "path", "evidence_key", rank(F.col("confidence")).alias("rank"), F.posexplode("nodes").alias("sub", "n")).select("*", "n.*").drop("n")
    is_file_row = (F.col("kind") == "file") & F.col("key").startswith("file:")

    order = F.struct("ordinal", "sub")
    first = written.groupBy("key").agg(F.min_by(F.struct("display", "metadata"), order).alias("first"), F.max("rank").alias("rank"))
    fields = _file_fields(written.where(is_file_row))
    merged = fields.groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct("field", F.transform("values", lambda v: v["value"]).alias("values")))).alias("fields"),
        F.max((F.size("values") > 1) & F.col("field").isin(*FILE_CONFLICT_FIELDS)).alias("conflict"),
    )
    as_json = F.concat(
        F.lit("{"),
        F.array_join(
            F.transform("fields", lambda f: F.concat(F.lit('"'), f["field"], F.lit('":'), F.when(F.size(f["values"]) == 1, f["values"][0]).otherwise(F.concat(F.lit("["), F.array_join(f["values"], ","), F.lit("]"))))),
            ",",
        ),
        F.lit("}"),
    )
    nodes = first.join(merged.select("key", as_json.alias("file_metadata"), "conflict"), "key", "left").select(
        F.lit(KEY_VERSION).alias("graph_key_version"), F.col("key").alias("canonical_key"), kind_of_key(F.col("key")).alias("kind"), F.col("first.display").alias("display_name"),
        F.coalesce("file_metadata", "first.metadata").alias("metadata"), of_rank(F.col("rank")).alias("confidence"), F.coalesce("conflict", F.lit(False)).alias("conflict"),
    )

    drawn = ev.select("ordinal", "evidence_key", rank(F.col("confidence")).alias("rank"), F.posexplode("edges").alias("sub", "e")).select("ordinal", "sub", "evidence_key", "rank", "e.*")
    per_value = drawn.groupBy("source", "kind", "target", "metadata").agg(F.min(order).alias("at"), F.max("rank").alias("rank"), F.count(F.lit(1)).alias("n"))
    per_edge = per_value.groupBy("source", "kind", "target").agg(F.array_sort(F.collect_list(F.struct("at", "metadata"))).alias("seen"), F.max("rank").alias("rank"), F.sum("n").alias("n"))
    ends = ["source", "kind", "target"]
    once = per_edge.select(*ends, "rank", _folded_if_calm(F.transform("seen", lambda s: s["metadata"]), F.col("n")).alias("folded"))
    in_full = drawn.join(once.where("folded IS NULL").select(*ends), ends, "left_semi").groupBy(*ends).agg(F.array_sort(F.collect_list(F.struct(order.alias("at"), "metadata"))).alias("all"))
    per_edge = once.join(in_full.select(*ends, _folded(F.transform("all", lambda s: s["metadata"])).alias("in_full")), ends, "left")
    id_of = edge_key_col(F.col("source"), F.col("kind"), F.col("target")).alias("edge_key")
    edges = per_edge.select(
        F.lit(KEY_VERSION).alias("graph_key_version"), id_of, F.col("source").alias("source_key"), "kind", F.col("target").alias("target_key"),
        F.lit(EMPTY_JSON_SHA256).alias("identity_metadata_hash"), F.coalesce("folded", "in_full").alias("metadata"), of_rank(F.col("rank")).alias("confidence"), F.lit(False).alias("conflict"),
    )

    said = rows.select("ordinal", "source_id", "path", F.explode("diagnostics").alias("d")).select(
        "ordinal", "d.severity", "d.category", "d.message", F.col("source_id").alias("raw_source_id"), "path", "d.field", "d.value", "d.placeholder_key"
    )
    clashes = fields.where(F.col("field").isin(*FILE_CONFLICT_FIELDS)).select("field", F.posexplode("values").alias("i", "v")).where("i > 0").select(
        "v.ordinal", F.lit("warning").alias("severity"), F.lit("conflicting_evidence").alias("category"), F.concat(F.lit("file metadata has conflicting evidence for "), F.col("field")).alias("message"),
        F.col("v.source_id").alias("raw_source_id"), "v.path", F.concat(F.lit("metadata."), F.col("field")).alias("field"), F.col("v.value").alias("value"), F.lit(None).cast("string").alias("placeholder_key"),
    )
    return Graph(
        nodes,
        edges,
        evidence,
        written.select(F.col("key").alias("canonical_key"), "evidence_key", F.col("link").alias("link_kind")).distinct(),
        drawn.select(id_of, "evidence_key", F.lit("supports").alias("link_kind")).distinct(),
        said.unionByName(clashes),
    )


def severity_counts(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def is_loadable(graph: Graph) -> bool:
    """A graph with an error diagnostic must not be stored."""
    return graph.diagnostics.where("severity = 'error'").limit(1).count() == 0


def to_object(graph: Graph, raw_count: int) -> dict:
    """The whole graph as one ordered object; for fixtures and the command line, not for large graphs."""
    meta = lambda r, *names: {n: (json.loads(r[n]) if n == "metadata" else r[n]) for n in names}
    nodes = sorted((meta(r, "canonical_key", "confidence", "conflict", "display_name", "graph_key_version", "kind", "metadata") for r in graph.nodes.collect()), key=lambda r: r["canonical_key"])
    edges = sorted(
        (meta(r, "confidence", "conflict", "edge_key", "graph_key_version", "kind", "metadata", "source_key", "target_key") | {"identity_metadata": {}} for r in graph.edges.collect()),
        key=lambda r: (r["source_key"], r["kind"], r["target_key"]),
    )
    evidence = [
        meta(r, "confidence", "end_line", "evidence_key", "extractor", "extractor_version", "metadata", "path", "raw_kind", "raw_schema_version", "raw_source_id", "start_line")
        | {"raw_observation_ordinal": r["ordinal"]}
        for r in sorted(graph.evidence.collect(), key=lambda r: r["ordinal"])
    ]
    node_links = sorted((r.asDict() for r in graph.node_evidence.collect()), key=lambda r: (r["canonical_key"], r["evidence_key"], r["link_kind"]))
    edge_links = sorted((r.asDict() for r in graph.edge_evidence.collect()), key=lambda r: (r["edge_key"], r["evidence_key"], r["link_kind"]))
    found = [
        {"category": r.category, "field": r.field, "message": r.message, "path": r.path, "placeholder_key": r.placeholder_key, "raw_observation_ordinal": r.ordinal,
         "raw_source_id": r.raw_source_id, "severity": r.severity, "value": None if r.value is None else json.loads(r.value)}
        for r in sorted(graph.diagnostics.collect(), key=lambda r: (r.ordinal, r.severity, r.category, r.field or ""))
    ]
    count = lambda s: sum(d["severity"] == s for d in found)
    return {
        "diagnostics": found, "edge_evidence_links": edge_links, "edges": edges, "evidence": evidence, "graph_key_version": KEY_VERSION, "node_evidence_links": node_links, "nodes": nodes,
        "ok": count("error") == 0,
        "summary": {"diagnostics": len(found), "edge_evidence_links": len(edge_links), "edges": len(edges), "errors": count("error"), "evidence": len(evidence), "infos": count("info"),
                    "node_evidence_links": len(node_links), "nodes": len(nodes), "raw_observations": raw_count, "warnings": count("warning")},
    }
