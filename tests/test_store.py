import json
from pathlib import Path

import pytest

from gridspark import cli
from gridspark.contracts import SCHEMA_VERSION
from gridspark.operators.confirm import apply_decisions
from gridspark.operators.coverage import holds
from gridspark.plans.pipeline import decompose
from gridspark.plugins import StageRegistry, registry
from gridspark.sinks.store import ARTIFACTS, ArtifactStore, merge_index, new_run_id, read_table, verify, write_tables
from gridspark.streaming.inbox import watch
from tests.workbooks import three_sheets


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    home = tmp_path_factory.mktemp("store")
    book = three_sheets(home / "book.xlsx")
    assert cli.main(["inspect", str(book), "--out", str(home / "out")], spark) == 0
    return home


def test_artifacts(stored):
    out = stored / "out"
    for name, kind in ARTIFACTS.items():
        found = json.loads((out / name).read_text())
        assert (found["schema_version"], found["artifact_type"]) == (SCHEMA_VERSION, kind)
        assert (out / name).read_text().endswith("}\n")
    manifest, inventory = (json.loads((out / n).read_text()) for n in ("workbook_manifest.json", "inventory.json"))
    assert [s["name"] for s in manifest["sheets"]] == ["Inputs", "Outputs", "HiddenData"]
    assert manifest["package_parts"][0]["name"] == "[Content_Types].xml"
    assert inventory["coverage"] == {"recognized_inventory_objects": 25, "unsupported_or_opaque_objects": 1, "discovered_workbook_objects": 26}
    inputs = inventory["sheets"][0]
    cells = {c["address"]: c for c in inputs["cells"]}
    assert list(cells) == ["A1", "B1", "A2", "B2", "C2", "D2", "E2", "A4", "A7", "B7", "A8", "B8"]
    assert (cells["B1"]["value"], cells["B2"]["value"], cells["A1"]["value"], cells["C2"]["value"]) == (0.05, 100, "Assumption rate", None)
    assert [r["kind"] for r in inputs["ranges"]] == ["merged_range", "table"]
    assert [r["kind"] for r in inputs["layout_objects"]] == ["row_layout", "column_layout", "freeze_panes", "data_validation", "conditional_formatting", "comment", "hyperlink"]
    assert inputs["layout_objects"][0]["metadata"] == {"hidden": True, "height": None}
    graph, items, asked = (json.loads((out / n).read_text()) for n in ("dependency_graph.json", "module_classification.json", "confirmation_template.json"))
    assert (len(graph["nodes"]), len(graph["edges"]), len(items["items"]), len(asked["questions"]), asked["decisions"]) == (7, 6, 26, 21, [])
    assert [n["id"] for n in graph["nodes"]][:3] == ["cell:Inputs!C2", "cell:Inputs!B1", "cell:Inputs!B2"]
    assert items["items"][0]["id"] == "cell:Inputs!A1" and items["items"][-1]["id"] == "unsupported:0:drawing"
    assert asked["questions"][0]["default"] == "presentation" and asked["questions"][0]["default"] in asked["questions"][0]["options"]


def test_second_run_index_and_reads(spark, stored):
    out = stored / "out"
    store = ArtifactStore(out)
    first = json.loads((out / "run_metadata.json").read_text())
    assert len(first["artifacts"]) == 7
    sha = first["workbook_sha256"]
    assert store.read_run(sha, first["run_id"]).run_id == first["run_id"]
    assert cli.main(["inspect", str(stored / "book.xlsx"), "-o", str(out)], spark) == 0
    index = json.loads((out / "workbooks" / sha / "artifact_index.json").read_text())
    second = json.loads((out / "run_metadata.json").read_text())["run_id"]
    assert [r["run_id"] for r in index["runs"]] == [first["run_id"], second] and index["latest_run_id"] == second
    assert index == json.loads((out / "artifact_index.json").read_text())
    assert {len(r["artifacts"]) for r in index["runs"]} == {6}
    for run in (first["run_id"], second):
        assert len(list((out / "workbooks" / sha / run).iterdir())) == 6
    records = spark.createDataFrame([(a["name"], a["path"], a["sha256"]) for a in first["artifacts"][:5]] + [("changed", first["artifacts"][0]["path"], "0")], "name string, path string, sha256 string")
    assert {r.name: r.ok for r in verify(spark, records, out).collect()} == {a["name"]: True for a in first["artifacts"][:5]} | {"changed": False}


def test_damage_is_found(spark, stored, tmp_path: Path):
    store = ArtifactStore(tmp_path / "out")
    done = decompose(spark, str(stored / "book.xlsx"))
    (record,) = store.write_runs(done, "run-1")
    with pytest.raises(FileExistsError):
        store.write_runs(done, "run-1")
    store.write_runs(done, "run-1", replace=True)
    with pytest.raises(ValueError, match="blank"):
        store.write_runs(done, "  ")
    target = Path(store.read_run(record.workbook_sha256, "run-1").artifacts[1].path)
    target.write_bytes(target.read_bytes().replace(b"Premium", b"Discount"))
    with pytest.raises(ValueError, match="checksum"):
        store.read_run(record.workbook_sha256, "run-1")
    other = tmp_path / "x.json"
    other.write_text('{"schema_version": "phase2"}')
    with pytest.raises(ValueError, match="schema_version"):
        store.read_json(other)


def test_artifacts_of_another_shape_are_refused(stored, tmp_path: Path):
    store = ArtifactStore(stored / "out")
    for name, kind in ARTIFACTS.items():
        assert store.read_json(stored / "out" / name, kind)["artifact_type"] == kind
    good = json.loads((stored / "out" / "dependency_graph.json").read_text())
    changes = {"nodes": {}, "edges": [good["edges"][0] | {"source": 5}], "unsupported_features": [{"feature_type": "x"}], "more": 1}
    for key, value in changes.items():
        path = tmp_path / f"{key}.json"
        path.write_text(json.dumps(good | {key: value}))
        with pytest.raises(ValueError, match="shape"):
            store.read_json(path, "formula_graph")


def test_cli_refuses_missing_files(capsys, spark):
    with pytest.raises(SystemExit):
        cli.main(["inspect", "/no/such/book.xlsx"], spark)
    with pytest.raises(SystemExit):
        cli.main(["--help"])
    assert "inspect" in capsys.readouterr().out


def test_tables_and_stream(spark, stored, tmp_path: Path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    three_sheets(inbox / "a.xlsx")
    for _ in range(2):
        watch(spark, str(inbox), str(tmp_path / "tables"), str(tmp_path / "check"), once=True).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "tables" / "items")).groupBy("run_id").count().collect() == [("batch-000000000", 26)]
    write_tables(decompose(spark, str(stored / "book.xlsx")), str(tmp_path / "more"), "r1")
    assert read_table(spark, str(tmp_path / "more"), "cells").count() == 15
    spark.range(1).withColumnRenamed("id", "sha256").write.parquet(str(tmp_path / "odd" / "coverage"))
    with pytest.raises(ValueError, match="recognized"):
        read_table(spark, str(tmp_path / "odd"), "coverage")


def test_stages_are_found_by_name_and_used(spark, stored, tmp_path: Path, capsys):
    own = StageRegistry()
    own.implements("questions", "none")(lambda items: items.limit(0))
    own.implements("questions", "all")(lambda items, sure=0.0: items)
    assert own.names("questions") == ["all", "none"] and own.names("graph") == []
    for stage, name, function in (("questions", "none", lambda items: items), ("graph", "two", lambda a, b: a), ("read", "short", lambda spark: None)):
        with pytest.raises(ValueError, match="stage"):
            own.implements(stage, name)(function)
    with pytest.raises(KeyError):
        own.get("graph", "missing")
    with pytest.raises(KeyError):
        own.get("paint", "any")
    registry.implements("questions", "first-only", replace=True)(lambda items: registry.get("questions")(items.where("id = 'cell:Inputs!A1'")))
    done = decompose(spark, str(stored / "book.xlsx"), {"questions": "first-only"})
    assert [r.id for r in done.questions.collect()] == ["confirm:cell:Inputs!A1"]
    assert cli.main(["inspect", str(stored / "book.xlsx"), "-o", str(tmp_path), "--use", "questions=first-only"], spark) == 0
    assert len(json.loads((tmp_path / "confirmation_template.json").read_text())["questions"]) == 1
    with pytest.raises(SystemExit):
        cli.main(["inspect", str(stored / "book.xlsx"), "--use", "questions=no-such"], spark)


def test_index_merge_decisions_coverage(spark):
    old = spark.createDataFrame([("w", "a", 1), ("w", "b", 2), ("x", "a", 9)], "sha256 string, run_id string, completed_at long")
    new = spark.createDataFrame([("w", "a", 3)], old.schema)
    assert sorted(map(tuple, merge_index(old, new).collect())) == [("w", "a", 3, True), ("w", "b", 2, False), ("x", "a", 9, True)]
    items = spark.createDataFrame([("w", "cell:S!A1", "input"), ("w", "cell:S!A2", "input")], "sha256 string, id string, category string")
    said = spark.createDataFrame([("w", "confirm:cell:S!A1", "other", 1), ("w", "confirm:cell:S!A1", "output", 2), ("w", "confirm:cell:S!A1", "nonsense", 3), ("w", "risk:cell:S!A2", "other", 1)], "sha256 string, question_id string, decision string, timestamp int")
    assert sorted(map(tuple, apply_decisions(items, said).collect())) == [("w", "cell:S!A1", "output"), ("w", "cell:S!A2", "input")]
    wrong = spark.createDataFrame([("w", 1, 2, 4)], "sha256 string, recognized long, opaque long, discovered long")
    with pytest.raises(Exception, match="coverage equation"):
        holds(wrong).collect()
    assert len(new_run_id()) == 24
