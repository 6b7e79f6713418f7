"""Schema migrations of a store: ordered steps, a ledger with their checksums, and a back-fill by run.

Steps are JSON files. A folder's changelog.json lists the folders that it includes; their files are steps in the order of their
paths. A step creates tables, adds columns (with the SQL expression that fills them from what the table had before) or says which
values a column may take. The ledger, a file a step, holds names and checksums: a store is migrated step by step, each
once, and refused if a step that it has seen was altered, left out or put elsewhere.

Readers need no migration: while a store is behind, a column that its files lack is computed from the step's expression. The
back-fill writes it into the files, so that filters reach them again. It rewrites the runs that lack a value, all runs of a
table in one job into a folder beside it, and then puts each run's folder in its place; a step that died goes on with
the folders that are left. As any change of a schema it wants the store to itself.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairngraph.schemas import TABLES

if TYPE_CHECKING:
    from cairngraph.plans.store import Store

STEPS_FOLDER = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "migrations")
FIELDS = ("name", "creates", "adds", "allows")


class MigrationProblem(RuntimeError):
    """Steps that cannot be read, or that do not go with the ledger."""


@dataclass(frozen=True)
class Step:
    name: str
    creates: tuple[str, ...] = ()
    adds: Mapping[str, Mapping[str, str]] = field(default_factory=dict)  # table, column: expression
    allows: Mapping[str, Mapping[str, list[str]]] = field(default_factory=dict)  # table, column: values

    @property
    def checksum(self) -> str:
        said = {"name": self.name, "creates": list(self.creates), "adds": self.adds, "allows": self.allows}
        return hashlib.sha256(json.dumps(said, sort_keys=True).encode()).hexdigest()


def _json(path: str) -> dict:
    try:
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
    except OSError as e:
        raise MigrationProblem(f"{path} cannot be read") from e
    except ValueError as e:
        raise MigrationProblem(f"{path} is not JSON") from e
    if not isinstance(found, dict):
        raise MigrationProblem(f"{path} is no object")
    return found


def step_from(path: str) -> Step:
    said = _json(path)
    if not isinstance(said.get("name"), str) or not said["name"]:
        raise MigrationProblem(f"{path} names no step")
    if unknown := sorted(set(said) - set(FIELDS)):
        raise MigrationProblem(f"{path} says {', '.join(unknown)}")
    step = Step(said["name"], tuple(said.get("creates", ())), said.get("adds", {}), said.get("allows", {}))
    for table in (*step.creates, *step.adds, *step.allows):
        if table not in TABLES:
            raise MigrationProblem(f"{path}: there is no table {table}")
    for table, columns in step.adds.items():
        for c in columns:
            if c not in TABLES[table].names or c in ("root_path", "run_id"):
                raise MigrationProblem(f"{path}: {table} has no column {c} to add")
    return step


def discover(folder: str | None = None) -> tuple[Step, ...]:
    """The steps of a folder, in order."""
    folder = folder or STEPS_FOLDER
    includes = _json(os.path.join(folder, "changelog.json")).get("include", [])
    if not includes:
        raise MigrationProblem(f"the changelog of {folder} includes nothing")
    steps = []
    for name in includes:
        at = os.path.join(folder, name)
        if not os.path.isdir(at):
            raise MigrationProblem(f"{at} is missing")
        paths = sorted(os.path.join(d, x) for d, _, names in os.walk(at) for x in names if x.endswith(".json"))
        steps += [step_from(p) for p in paths]
    names = [s.name for s in steps]
    if not names:
        raise MigrationProblem(f"there are no steps in {folder}")
    if len(set(names)) < len(names):
        raise MigrationProblem("two steps have one name")
    return tuple(steps)


# --- the ledger -------------------------------------------------------------------------------------


def ledger(store: Store) -> list[tuple[str, str]]:
    """(name, checksum) of the steps that the store has seen, in order."""
    entries = sorted(n for n in store.names("_schema") if n.endswith(".json"))
    said = [json.loads(store.read_text(f"_schema/{n}")) for n in entries]
    return [(x["name"], x["checksum"]) for x in said]


def pending(store: Store, steps: tuple[Step, ...]) -> tuple[Step, ...]:
    """The steps that the store has yet to see; refused if those it has seen are others."""
    seen = ledger(store)
    if len(seen) > len(steps):
        raise MigrationProblem(f"the store knows {len(seen) - len(steps)} steps more")
    for (name, checksum), step in zip(seen, steps, strict=False):
        if name != step.name:
            raise MigrationProblem(f"the store's step {name} is {step.name} here")
        if checksum != step.checksum:
            raise MigrationProblem(f"step {name} was altered")
    return steps[len(seen) :]


def _record(store: Store, number: int, step: Step) -> None:
    store.write_text(f"_schema/{number:04d}.json", json.dumps({"name": step.name, "checksum": step.checksum}))


def settle(store: Store) -> None:
    """Before a load: a new store starts with every step seen, an old one must have been migrated."""
    steps = discover()
    left = pending(store, steps)
    if not left:
        return
    if len(left) == len(steps) and not any(store.tables_present().values()):
        for n, step in enumerate(steps, 1):
            _record(store, n, step)
        store.forget()
        return
    raise MigrationProblem(f"the store must be migrated first: {', '.join(s.name for s in left)}")


# --- reading and filling ----------------------------------------------------------------------------


def filled(rows: DataFrame, table: str, steps: tuple[Step, ...]) -> DataFrame:
    """rows (of the table's whole schema, null where a file lacks a column) with the columns that the steps add."""
    for step in steps:
        kinds = {f.name: f.dataType for f in TABLES[table].fields}
        added = {c: F.coalesce(F.col(c), F.expr(e).cast(kinds[c])) for c, e in step.adds.get(table, {}).items()}
        rows = rows.withColumns(added) if added else rows
    return rows


def _to_fill(store: Store, table: str, step: Step) -> DataFrame:
    """Rows of the runs that lack a value, with it. A join by shuffle would bring all rows of a run to one task: the runs, a row each,
    are broadcast, as their list is with the driver anyway."""
    rows = store.written_rows(table)
    lacking = F.lit(False)
    for c in step.adds[table]:
        lacking = lacking | F.col(c).isNull()
    runs = rows.where(lacking).select("root_path", "run_id").distinct()
    return filled(rows.join(F.broadcast(runs), ["root_path", "run_id"], "left_semi"), table, (step,)).select(*TABLES[table].names)


def _back_fill(store: Store, table: str, step: Step) -> None:
    staged = f"_schema/staged-{step.name}/{table}"
    if not store.has(f"{staged}/_SUCCESS"):
        new = _to_fill(store, table, step)
        if not new.limit(1).count():
            return
        new.write.mode("overwrite").partitionBy("root_path", "run_id").parquet(f"{store.base}/{staged}")
    for root in store.names(staged, "root_path="):
        for run in store.names(f"{staged}/{root}", "run_id="):
            store.replace(f"{staged}/{root}/{run}", f"{table}/{root}/{run}")


def _outside(store: Store, step: Step) -> None:
    for table, columns in step.allows.items():
        for c, values in columns.items():
            found = store.all_rows(table).where(~F.col(c).isin(*values)).select(c).limit(1).collect()
            if found:
                raise MigrationProblem(f"step {step.name}: {table}.{c} holds {found[0][0]!r}")


def apply(store: Store, folder: str | None = None) -> tuple[Step, ...]:
    """Brings a store up to the last step; the steps that were applied now."""
    steps = discover(folder)
    left = pending(store, steps)
    for n, step in enumerate(left, len(steps) - len(left) + 1):
        for table in step.adds:
            if store.has(table):
                _back_fill(store, table, step)
        _outside(store, step)
        _record(store, n, step)
        store.delete(f"_schema/staged-{step.name}")
        store.forget()
    return left
