"""Snapshots of a store: one row a natural key, so that reading what is current costs the snapshot and the runs since.

A snapshot names the runs that it holds, as ranges of ids: runs end in any order, and one that ends later than its successor
is in no snapshot that was made before. Its tables are written first and its manifest is renamed into place last; readers take
the highest that has a manifest, so one that died half-way is never seen. Rows keep the first and the last run that saw
their key and the order of writing within the last, which is all that merging them with later runs needs.

A pinned reader holds a snapshot and the runs that had ended: it answers alike while loads and compactions go on. Old
snapshots stay until they are expired.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

Ranges = tuple[tuple[int, int], ...]


def ranges(runs: Iterable[int]) -> Ranges:
    """Run ids as closed ranges."""
    out: list[tuple[int, int]] = []
    for r in sorted(set(runs)):
        if out and out[-1][1] == r - 1:
            out[-1] = out[-1][0], r
        else:
            out.append((r, r))
    return tuple(out)


def within(run: int, held: Ranges) -> bool:
    return any(a <= run <= b for a, b in held)


def condition(held: Ranges, column: str = "run_id") -> Column:
    c = F.lit(False)
    for a, b in held:
        c = c | F.col(column).between(a, b)
    return c


@dataclass(frozen=True)
class Snapshot:
    number: int
    runs: Ranges

    def text(self) -> str:
        return json.dumps({"number": self.number, "runs": self.runs})

    @staticmethod
    def of(text: str) -> Snapshot:
        said = json.loads(text)
        return Snapshot(said["number"], tuple((a, b) for a, b in said["runs"]))


@dataclass(frozen=True)
class Pin:
    """What a reader saw when it was pinned: the snapshot, and (root, run) of every run that had ended."""

    snapshot: Snapshot | None
    ended: tuple[tuple[str, int], ...]

    @property
    def runs(self) -> Ranges:
        return ranges(r for _, r in self.ended)
