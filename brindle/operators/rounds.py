"""A run continued: what it inherits from another, whether carried pseudobulks stand in for the old cells, and what is fitted again.

Decisions are made on manifests (small documents); cells and their partition meet by name in Spark.
"""

from __future__ import annotations

import os
from typing import Any, NamedTuple

from pyspark.sql import DataFrame

from brindle.operators.align import strict_join
from brindle.sources import manifest as M

#: Kinds that are trained on cells alone, and the ending of a carried table's name.
ON_CELLS, CARRIED = frozenset({"simba", "fne"}), ".pb_reference.parquet"


class Plan(NamedTuple):
    """``args``: the parent's, with what was asked for instead. ``inputs``: what is read, in order. ``carried``: the table that stands in for the old cells, or None. ``reason``: why none does."""

    args: dict[str, Any]
    inputs: list[str]
    carried: str | None
    reason: str | None


def inherited(parent: dict[str, Any], given: dict[str, Any], slots: tuple[str, ...] = ("data", "batch", "cell_to_pb")) -> dict[str, Any]:
    """Each slot as given, else as the parent's manifest records it (its inputs, batch files, partition); slots that neither has are left out."""
    recorded = {"data": parent.get("data", {}).get("files"), "batch": parent.get("data", {}).get("batch"), "cell_to_pb": parent.get("outputs", {}).get("cell_to_pb")}
    chosen = {s: given[s] if given.get(s) is not None else recorded.get(s) for s in slots}
    return {s: v for s, v in chosen.items() if v is not None}


def inherited_partition(cells: DataFrame, partition: DataFrame) -> DataFrame:
    """(name, level, pb) of a parent's partition for these cells (name), of which every one must be in it: a missing one fails at run time."""
    levels = sorted(r["level"] for r in partition.select("level").distinct().collect())
    out = None
    for level in levels:
        one = strict_join(cells.select("name"), partition.where(partition.level == level).select("name", "pb"), "name", "pb").selectExpr("name", f"{level} AS level", "pb")
        out = one if out is None else out.union(one)
    if out is None:
        raise ValueError("the partition has no level")
    return out


def carried_among(inputs: list[str]) -> str | None:
    """The carried table among a run's recorded inputs, by its name."""
    return next((p for p in inputs if p.endswith(CARRIED)), None)


def substitution(parent: dict[str, Any], new_batches: bool, exists: bool, wanted: bool | None = None) -> tuple[str | None, str | None]:
    """(carried table, None) or (None, the reason that there is none).

    ``new_batches``: whether the new data has batch labels; ``exists``: whether the recorded table is there; ``wanted``: asked for
    (an error if it can't be), refused, or left open. A lineage whose inputs hold a carried table already can't be fitted
    from cells again: that is an error, whatever was asked.
    """
    table = parent.get("outputs", {}).get("pb_reference")
    if wanted is False:
        reason = "it was refused"
    elif parent.get("kind") in ON_CELLS:
        reason = f"a {parent['kind']} run is trained on cells alone"
    elif parent.get("data", {}).get("multiome") or (parent.get("train_args") or {}).get("multiome"):
        reason = "modalities are aligned by union, which carried columns can't join"
    elif not new_batches:
        reason = "the new data has no batch labels, and carried pseudobulks are a batch of their own"
    elif not table:
        reason = "the parent carries no pseudobulks"
    elif not exists:
        reason = f"{table} can't be read"
    else:
        return table, None
    if old := carried_among(parent.get("data", {}).get("files", [])):
        raise ValueError(f"{old} stands for cells that can't be read again ({reason})")
    if wanted:
        raise ValueError(f"carried pseudobulks can't stand in: {reason}")
    return None, reason


def update_plan(manifest_path: str, out: str, new_inputs: list[str], changes: dict[str, Any] | None = None, new_batches: bool = False, wanted: bool | None = None) -> Plan:
    """How a parent's fit is done again on its recorded inputs and new ones.

    The parent's arguments are replayed, ``changes`` put over them (a name that the parent doesn't record is an error). Inputs that are
    recorded already are refused, so is writing over the parent. Where carried pseudobulks stand in, they are read in the old cells' place.
    """
    parent = M.load(manifest_path)
    if os.path.normpath(out) == os.path.normpath(parent.get("prefix", os.path.splitext(manifest_path)[0])):
        raise ValueError("an update isn't written over its parent")
    args = dict(parent.get("train_args") or {})
    if not args:
        raise ValueError("the parent records no arguments to replay")
    if unknown := sorted(set(changes or {}) - set(args)):
        raise ValueError(f"the parent records no {', '.join(unknown)}")
    old = list(parent.get("data", {}).get("files", []))
    known = {os.path.normpath(p) for p in old}
    if repeated := [p for p in new_inputs if os.path.normpath(p) in known]:
        raise ValueError(f"already recorded: {', '.join(repeated)}")
    table = parent.get("outputs", {}).get("pb_reference")
    exists = False
    if table:
        try:
            M.resolve(table, manifest_path)
            exists = True
        except FileNotFoundError:
            pass
    carried, reason = substitution(parent, new_batches, exists, wanted)
    inputs = [*([carried] if carried else old), *new_inputs]
    return Plan(args | (changes or {}), inputs, carried, reason)
