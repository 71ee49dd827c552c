"""The task-side sink: documents of any shape, staging, aborts, and concurrent writers of one index."""

import gzip
import hashlib
import json
import multiprocessing
import os
import random
import tracemalloc
from dataclasses import replace
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridspark.contracts import ARTIFACT_SHAPES
from gridspark.plans.pipeline import decompose
from gridspark.sinks.json_files import LAYOUTS, LINES, NESTED, STAGED, Document, JsonWriter, alike_sql, artifact_lines, indent_batches, json_sql, stage
from gridspark.sinks.store import INDEX, ArtifactStore, RunRecord
from gridspark.sources.artifacts import CORRUPT, cells_back, read_artifacts
from tests.workbooks import three_sheets


def shown(value, depth, head=False):
    text = json.dumps(value, indent=2, ensure_ascii=False)
    return "\n".join("  " * depth + line for line in (text[:-2] if head else text).split("\n")) if depth else text[:-2] if head else text


@pytest.mark.parametrize("seed", range(20))
@pytest.mark.parametrize("artifact", sorted(LAYOUTS))
def test_documents_are_what_json_writes(artifact, seed):
    rng = random.Random(seed)
    some = lambda: [{"v": rng.choice(["x", 'ü"\n', None, 1.5]), "w": {}} for _ in range(rng.choice([0, 0, 1, 3]))]
    head = {"schema_version": "v", "n": seed}
    want, rows = dict(head), [([0], shown(head, 0, True))]
    for k, name in enumerate(LAYOUTS[artifact][1], 1):
        if name not in NESTED:
            want[name] = some()
            rows += [([k, i], shown(x, 2)) for i, x in enumerate(want[name])]
            continue
        key, parts = NESTED[name]
        want[key] = []
        for i in range(rng.choice([0, 1, 3])):
            own = {"name": f"s{i}"}
            rows.append(([k, i, 0], shown(own, 2, True)))
            for p, part in enumerate(parts, 1):
                own[part] = some()
                rows += [([k, i, p, j], shown(x, 4)) for j, x in enumerate(own[part])]
            want[key].append(own)
    out = []
    document = Document(out.append, artifact)
    for place, text in sorted(rows):
        document.put(place, text)
    document.end()
    data = b"".join(out)
    assert data.decode() == json.dumps(want, indent=2, ensure_ascii=False) + "\n"
    assert (document.size, document.digest.hexdigest()) == (len(data), hashlib.sha256(data).hexdigest())


def test_a_failed_task_leaves_nothing(spark, tmp_path: Path):
    rows = [(f"{i:064x}", "dependency_graph.json", [0], '{\n  "a": 1') for i in range(50)]
    lines = spark.createDataFrame(rows, LINES)
    found = stage(lines, str(tmp_path / "good"))
    assert len(found) == 50 and all(os.path.exists(f["staged"]) for f in found)
    assert sorted(f["sha256"] for f in json.loads((tmp_path / "good" / STAGED).read_text())) == sorted(r[0] for r in rows)
    broken = lines.withColumn("text", F.when(F.col("sha256") == rows[30][0], F.raise_error(F.lit("planned")).cast("string")).otherwise(F.col("text")))
    with pytest.raises(Exception, match="planned"):
        stage(broken, str(tmp_path / "bad"))
    assert not (tmp_path / "bad").exists() or list((tmp_path / "bad").rglob("*.json")) == []
    wrong = spark.createDataFrame([*rows[:20], ("0" * 63 + "z", "dependency_graph.json", [9], "no such section")], LINES).coalesce(1)
    with pytest.raises(Exception, match="IndexError|index out of range"):
        stage(wrong, str(tmp_path / "worse"))
    assert not (tmp_path / "worse").exists() or list((tmp_path / "worse").rglob("*.json")) == []


def test_gzipped_files_hold_the_same_text(spark, tmp_path: Path):
    rows = [(f"{i:064x}", "inventory.json", place, f'{{"ü": {i}') for i in range(3) for place in ([0], [1, 0, 0], [1, 0, 1, 5, 1], [1, 0, 1, 5, 2], [1, 0, 3, 7], [1, 1, 0], [1, 2, 0], [1, 2, 2, 1], [2, 4], [2, 5])]
    lines = spark.createDataFrame(rows, LINES)
    plain, packed = (sorted(stage(lines, str(tmp_path / c), c), key=lambda f: f["sha256"]) for c in ("none", "gzip"))
    for a, b in zip(plain, packed, strict=True):
        text = Path(a["staged"]).read_bytes()
        assert gzip.decompress(Path(b["staged"]).read_bytes()) == text and b["staged"].endswith("/inventory.json.gz")
        assert (a["digest"], a["bytes"]) == (b["digest"], b["bytes"]) == (hashlib.sha256(text).hexdigest(), len(text))
        document = Document((out := []).append, "inventory.json")
        for _, _, place, row in (r for r in rows if r[0] == a["sha256"]):
            document.put(place, row)
        document.end()
        assert b"".join(out) == text


ODD_TEXTS = ["", "plain", 'say "hi"', "back\\slash", "\\u001f", "a\nb\tc\rd\be\ff", "\x00\x0b\x1f\x7f", "größer 😀\u2028", "\"\\\n", None]


@pytest.mark.parametrize("level", [0, 1, 4])
def test_sql_writes_what_json_writes(spark, level):
    rng = random.Random(level)
    some = lambda: None if rng.random() < 0.1 else {"t": rng.choice(ODD_TEXTS), "n": rng.choice([0, -5, 2**62, None]), "b": rng.choice([True, False, None]), "a": rng.choice([None, [], [rng.choice(ODD_TEXTS) for _ in range(3)]])}
    values = [{"t": t, "n": 1, "b": True, "a": [t]} for t in ODD_TEXTS] + [{**(some() or {"t": "", "n": 0, "b": None, "a": []}), "own": some(), "list": rng.choice([None, [], [some(), some()]])} for _ in range(60)]
    one = "t string, n bigint, b boolean, a array<string>"
    short = "struct<" + one.replace(" ", ":").replace(",:", ",") + ">"
    df = spark.createDataFrame([({"own": None, "list": None} | v,) for v in values], f"v struct<{short[7:-1]},own:{short},list:array<{short}>>")
    rows = df.selectExpr("v", f"{json_sql('v', df.schema['v'].dataType, level)} as text").collect()
    want = lambda v: ("\n" + "  " * level).join(json.dumps(v.asDict(True), indent=2, ensure_ascii=False).split("\n"))
    assert len(rows) == len(values) and [r.text for r in rows] == [want(r.v) for r in rows]


def test_numbers_are_left_as_they_stand_only_where_json_writes_them_so(spark):
    rng = random.Random(5)
    texts = ["0.1", "-0.0", "0.0", "0.00", "00.5", "1.50", ".5", "5.", "5", "1E5", "1.0E5", "0.0001", "0.00001", "0.00012", "0.30000000000000004", "123456789012345.5", "12345678901234.5", "+1.5", "NaN", "Infinity", "-12.25", "1.5\n", " 1.5"]
    texts += [f"{rng.uniform(-1, 1) * 10 ** rng.randint(-7, 16):.{rng.randint(0, 9)}f}" for _ in range(500)] + [repr(rng.uniform(-1, 1) * 10 ** rng.randint(-7, 20)) for _ in range(500)]
    got = spark.createDataFrame([(t,) for t in texts], "n string").selectExpr("n", f"{alike_sql('n')} as alike").collect()
    assert all(json.dumps(float(r.n)) == r.n for r in got if r.alike) and {r.n for r in got if r.alike} >= {"0.1", "-0.0", "0.0001", "0.00012", "-12.25", "12345678901234.5"}


def test_files_are_what_json_writes(spark, tmp_path: Path):
    done = decompose(spark, str(three_sheets(tmp_path / "book.xlsx")))
    n, values = F.pmod(F.col("row") * 31 + F.col("column"), F.lit(8)), ["1E5", "0.30000000000000004", "0.5", "1.50", "x", "0.00001", None, "123456789012345678901234"]
    odd = done.inventory.cells.withColumns({"value_type": F.lit("double"), "value": F.element_at(F.array(*map(F.lit, values)), (n + 1).cast("int")), "number_format": F.lit('"a"\\\x01')})
    items = done.items.withColumn("confidence", F.when(F.length("id") % 2 == 0, 0.1 + F.lit(0.2)).otherwise(F.lit(1e-7)))
    found = stage(artifact_lines(replace(done, inventory=replace(done.inventory, cells=odd), items=items)), str(tmp_path / "out"))
    texts = {f["name"]: Path(f["staged"]).read_text() for f in found}
    assert set(texts) == set(LAYOUTS) and all(text == json.dumps(json.loads(text), indent=2, ensure_ascii=False) + "\n" for text in texts.values())
    shown = {c["value"] for sheet in json.loads(texts["inventory.json"])["sheets"] for c in sheet["cells"]}
    assert shown <= {1e5, 0.1 + 0.2, 0.5, 1.5, None, 1e-05, float(values[-1])} and len(shown) > 3
    assert {i["confidence"] for i in json.loads(texts["module_classification.json"])["items"]} == {0.1 + 0.2, 1e-7}


def most_memory(work) -> float:
    """MB of Python objects that were held at once."""
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_few_rows_of_a_batch_are_python_objects_at_a_time(tmp_path: Path):
    n = 10_000
    same = {"sha256": pa.array(["0" * 64] * n), "artifact": pa.array(["dependency_graph.json"] * n), "place": pa.array([[1, i, 0, 0] for i in range(n)])}
    plain = [json.dumps({"id": i, "formula": "x" * 1000}) for i in range(n)]
    lines = pa.RecordBatch.from_pydict(same | {"text": pa.array(plain), "depth": pa.array([2] * n, pa.int32()), "head": pa.array([False] * n)})
    out: list[str] = []
    assert most_memory(lambda: [out.append(b.column(3)[-1].as_py()) for b in indent_batches(iter([lines]))]) < 3
    assert out[-1] == shown({"id": n - 1, "formula": "x" * 1000}, 2)
    ready = pa.RecordBatch.from_pydict(same | {"text": pa.array([shown(json.loads(t), 2) for t in plain])})
    done: list = []
    assert most_memory(lambda: done.append(JsonWriter(str(tmp_path)).write(iter([ready])))) < 3
    (file,) = done[0].files
    assert json.loads('{"head": 1' + Path(file["staged"]).read_text())["nodes"] == [json.loads(t) for t in plain]


def write_entries(out: str, writer: int) -> None:
    store = ArtifactStore(out)
    for k in range(5):
        record = RunRecord(f"run-{writer}-{k}", "book", "2024-01-01T00:00:00+00:00", f"2024-01-01T00:00:{k:02d}+00:00", [])
        store._index(record, store.run_dir("book", record.run_id))


def test_no_writer_of_an_index_is_lost(tmp_path: Path):
    context = multiprocessing.get_context("spawn")
    writers = [context.Process(target=write_entries, args=(str(tmp_path), w)) for w in range(4)]
    for w in writers:
        w.start()
    for w in writers:
        w.join(120)
    index = json.loads((tmp_path / "workbooks" / "book" / INDEX).read_text())
    assert sorted(r["run_id"] for r in index["runs"]) == sorted(f"run-{w}-{k}" for w in range(4) for k in range(5))
    assert index["latest_run_id"] == index["runs"][-1]["run_id"] == "run-3-4"


def test_a_store_by_uri_and_cells_back(spark, tmp_path: Path):
    done = decompose(spark, str(three_sheets(tmp_path / "book.xlsx")))
    store = ArtifactStore(f"file://{tmp_path}/out")
    (record,) = store.write_runs(done, "r/1")
    assert store.read_run(record.workbook_sha256, "r/1").artifacts[0].sha256 == record.artifacts[0].sha256
    assert [p for p in (tmp_path / "out").iterdir() if p.name.startswith(".staging")] == []
    paths = [a.path for a in record.artifacts if a.name == "inventory.json"]
    back = cells_back(read_artifacts(spark, paths, "workbook_inventory"))
    drop = lambda df: sorted(str(r) for r in df.drop("part", "path").select(*done.inventory.cells.columns).collect())
    assert drop(back) == drop(done.inventory.cells)
    with pytest.raises(FileExistsError):
        store.write_runs(done, "r/1")
    assert [p for p in (tmp_path / "out").iterdir() if p.name.startswith(".staging")] == []


def test_texts_of_other_shapes_are_told(spark, tmp_path: Path):
    good = {"schema_version": "phase1.v1", "artifact_type": "formula_graph", "nodes": [], "edges": [], "unsupported_features": []}
    assert set(good) == set(ARTIFACT_SHAPES["formula_graph"])
    for name, text in {"good": json.dumps(good), "cut": json.dumps(good)[:40], "other": json.dumps(good | {"artifact_type": "x"}), "list": "[1]", "typed": json.dumps(good | {"nodes": 5})}.items():
        (tmp_path / f"{name}.json").write_text(text)
    got = {os.path.basename(r.path): r[CORRUPT] for r in read_artifacts(spark, str(tmp_path), "formula_graph").collect()}
    assert got.pop("good.json") is None and set(got) == {"cut.json", "other.json", "list.json", "typed.json"} and all(got.values())
