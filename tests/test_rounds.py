"""Ontologies, inherited inputs, and updates: what stands in for old cells and why not."""

from __future__ import annotations

import json

import pytest

from brindle.operators import rounds
from brindle.operators.graph import ancestors
from brindle.operators.shared import shared_folder
from brindle.sources import ontology

OBO = """format-version: 1.2
ontology: go

[Term]
id: GO:1
name: root process ! no comment here

[Term]
id: efo:EFO_0000002
name: second
def: "A \\"quoted\\" one." [ref:1]
is_a: GO:1 {source="x"} ! root process
relationship: part_of GO:4 ! whole
relationship: regulates GO:5

[Typedef]
id: part_of
name: part of


[Term]
id: GO:3
is_a: GO:1
is_a: GO:1
is_a: GO:3

[Term]
id: GO:4
name: whole

[Term]
id: GO:9
name: gone
is_obsolete: true
is_a: GO:1
"""


def test_ontology(spark, tmp_path):
    for name, text in (("a.obo", OBO), ("b.obo", OBO.replace("\n", "\r\n"))):
        (tmp_path / name).write_text(text, newline="")
        got = {r.term: (r.name, r.definition, r.obsolete) for r in ontology.terms(spark, str(tmp_path / name)).collect()}
        assert set(got) == {"GO:1", "EFO:0000002", "GO:3", "GO:4", "GO:9"}
        assert got["GO:1"] == ("root process", None, False) and got["GO:3"] == (None, None, False) and got["GO:9"][2]
        assert got["EFO:0000002"][1] == 'A \\"quoted\\" one.'
        edges = ontology.hierarchy(spark, str(tmp_path / name))
        assert {tuple(r) for r in edges.collect()} == {("EFO:0000002", "GO:1", "is_a"), ("EFO:0000002", "GO:4", "part_of"), ("GO:3", "GO:1", "is_a")}
    present = spark.createDataFrame([("EFO_0000002",), ("GO:4",)], "term string")
    assert [tuple(r) for r in ontology.term_edges(edges, present).collect()] == [("EFO:0000002", "GO:4", "part_of")]
    up = ancestors(edges.select("child", "parent"), shared_folder(spark))
    assert {r.ancestor for r in up.where("term = 'EFO:0000002'").collect()} >= {"GO:1", "GO:4"}
    known = spark.createDataFrame([("GO:4", None, "kept"), ("GO:1", "own", None), ("X:1", None, None)], "term string, name string, definition string")
    filled = {r.term: (r.name, r.definition) for r in ontology.filled_texts(known, ontology.terms(spark, str(tmp_path / "a.obo"))).collect()}
    assert filled == {"GO:4": ("whole", "kept"), "GO:1": ("own", None), "X:1": (None, None)}


def parent(tmp_path, **more):
    (tmp_path / "pb.pb_reference.parquet").mkdir(exist_ok=True)
    doc = {"version": 2, "kind": "topic", "prefix": "runs/m1", "data": {"files": ["a.parquet", "b.parquet"]}, "outputs": {"pb_reference": "pb.pb_reference.parquet", "cell_to_pb": "p.parquet"}, "train_args": {"k": 10, "epochs": 5}}
    for k, v in more.items():
        doc[k] = v
    path = tmp_path / "m1.json"
    path.write_text(json.dumps(doc))
    return str(path)


def test_an_update_replays_the_parent(tmp_path):
    p = parent(tmp_path)
    plan = rounds.update_plan(p, "runs/m2", ["c.parquet"], {"epochs": 7}, new_batches=True)
    assert plan == ({"k": 10, "epochs": 7}, ["pb.pb_reference.parquet", "c.parquet"], "pb.pb_reference.parquet", None)
    whole = rounds.update_plan(p, "runs/m2", ["c.parquet"], new_batches=False)
    assert whole.inputs == ["a.parquet", "b.parquet", "c.parquet"] and "batch labels" in whole.reason
    for bad in ({"out": "runs/m1"}, {"new_inputs": ["./a.parquet"]}, {"changes": {"depth": 3}}):
        with pytest.raises(ValueError):
            rounds.update_plan(**{"manifest_path": p, "out": "runs/m2", "new_inputs": ["c.parquet"]} | bad)
    with pytest.raises(ValueError):
        rounds.update_plan(parent(tmp_path, train_args={}), "runs/m2", [])


@pytest.mark.parametrize("change,words", [
    ({"kind": "simba"}, "cells alone"), ({"data": {"files": ["a"], "multiome": ["rna"]}}, "union"), ({"train_args": {"multiome": True}}, "union"), ({"outputs": {}}, "carries no"), ({"outputs": {"pb_reference": "moved.parquet"}}, "can't be read"),
])
def test_why_nothing_stands_in(tmp_path, change, words):
    p = parent(tmp_path, **change)
    assert words in rounds.update_plan(p, "runs/m2", ["c.parquet"], new_batches=True).reason
    with pytest.raises(ValueError, match="stand in"):
        rounds.update_plan(p, "runs/m2", ["c.parquet"], new_batches=True, wanted=True)


def test_a_lineage_that_substituted_once_keeps_to_it(tmp_path):
    p = parent(tmp_path, data={"files": ["old.pb_reference.parquet", "b.parquet"]})
    assert rounds.update_plan(p, "runs/m2", ["c.parquet"], new_batches=True).carried
    for options in ({"new_batches": True, "wanted": False}, {"new_batches": False}):
        with pytest.raises(ValueError, match="stands for cells"):
            rounds.update_plan(p, "runs/m2", ["c.parquet"], **options)


def test_inherited_inputs_and_partition(spark, tmp_path):
    doc = json.loads(open(parent(tmp_path)).read())
    assert rounds.inherited(doc, {"batch": "own.txt"}) == {"data": ["a.parquet", "b.parquet"], "batch": "own.txt", "cell_to_pb": "p.parquet"}
    part = spark.createDataFrame([("c1", 0, 5), ("c1", 1, 7), ("c2", 0, 5), ("c2", 1, 8), ("c3", 0, 6), ("c3", 1, 9)], "name string, level int, pb long")
    cells = spark.createDataFrame([("c2",), ("c1",)], "name string")
    assert {tuple(r) for r in rounds.inherited_partition(cells, part).collect()} == {("c1", 0, 5), ("c1", 1, 7), ("c2", 0, 5), ("c2", 1, 8)}
    with pytest.raises(Exception):  # noqa: B017
        rounds.inherited_partition(spark.createDataFrame([("c9",)], "name string"), part).collect()
