"""The artifact store: JSON artifacts in folders by content hash and run, with checksums, an index and verified reads.

    <out>/workbooks/<sha256>/<run_id>/<artifact>.json      what a run wrote
    <out>/workbooks/<sha256>/index/<run_id>.json           the run's entry in the index
    <out>/workbooks/<sha256>/artifact_index.json           the workbook's runs
    <out>/<artifact>.json                                  the last run's copies

Tasks write the artifacts into a staging folder (json_files.py); a run is published by renaming. `out` is a local path or
a URI of any file system that pyarrow knows. Several writers may publish at once: each adds the entry of its own run and
then writes the index from all entries there are, until it holds them all, so no run is lost. Large corpora are better
kept as tables (`write_tables`), partitioned by workbook, without a file per workbook.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from dataclasses import asdict, dataclass
from datetime import UTC, datetime
from pathlib import Path
from urllib.parse import quote

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridspark.contracts import ANY, ARTIFACT_SHAPES, SCHEMA_VERSION, mismatch, schema_of
from gridspark.plans.pipeline import Decomposition
from gridspark.plugins import BUILT_IN, registry
from gridspark.sinks.json_files import LAYOUTS, artifact_lines, file_system, stage

#: File names and the artifact type that each must hold.
ARTIFACTS = {
    "workbook_manifest.json": "workbook_manifest",
    "inventory.json": "workbook_inventory",
    "dependency_graph.json": "formula_graph",
    "module_classification.json": "module_classification",
    "confirmation_template.json": "confirmation_template",
    "run_metadata.json": "run_metadata",
}
INDEX, METADATA = "artifact_index.json", "run_metadata.json"
@dataclass
class ArtifactRecord:
    name: str
    path: str
    sha256: str
    bytes: int
    schema_version: str = SCHEMA_VERSION


@dataclass
class RunRecord:
    run_id: str
    workbook_sha256: str
    started_at: str
    completed_at: str | None
    artifacts: list[ArtifactRecord]


def new_run_id(now: datetime | None = None) -> str:
    return f"{now or datetime.now(UTC):%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:8]}"


def sha256_of(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


@registry.implements("store", BUILT_IN, replace=True)
def store_runs(done: Decomposition, out: str | Path) -> list[RunRecord]:
    return ArtifactStore(out).write_runs(done)


class ArtifactStore:
    """Artifacts under `out`."""

    def __init__(self, out: str | Path) -> None:
        self.out = str(out) if re.match(r"[a-z][a-z0-9+.-]+:/", str(out)) else str(Path(out).expanduser().resolve())
        self.system, self.root = file_system(self.out)

    def workbook_dir(self, sha256: str) -> str:
        return f"{self.root}/workbooks/{sha256}"

    def run_dir(self, sha256: str, run_id: str) -> str:
        return f"{self.workbook_dir(sha256)}/{run_id}"

    def exists(self, path: str) -> bool:
        return self.system.get_file_info(path).type != fs.FileType.NotFound

    def read(self, path: str) -> bytes:
        with self.system.open_input_stream(path) as found:
            return found.read()

    def put(self, path: str, data: bytes) -> ArtifactRecord:
        """The file at once, as a whole."""
        folder, _, name = path.rpartition("/")
        self.system.create_dir(folder, recursive=True)
        new = f"{folder}/.{name}.{uuid.uuid4().hex[:8]}"
        with self.system.open_output_stream(new) as out:
            out.write(data)
        self.system.move(new, path)
        return ArtifactRecord(name, path, sha256_of(data), len(data))

    def write_runs(self, done: Decomposition, run_id: str | None = None, replace: bool = False) -> list[RunRecord]:
        """One run of every workbook. A run id that a workbook has already is refused unless `replace`; then nothing is
        published."""
        started = datetime.now(UTC)
        run_id = run_id if run_id is not None else new_run_id(started)
        if not run_id.strip():
            raise ValueError("run_id must not be blank")
        staging = f"{self.out}/.staging-{uuid.uuid4().hex}"
        try:
            staged = stage(artifact_lines(done), staging)
            runs: dict[str, dict[str, dict]] = {}
            for file in staged:
                runs.setdefault(file["sha256"], {})[file["name"]] = file
            for sha256 in runs:
                if self.exists(self.run_dir(sha256, run_id)) and not replace:
                    raise FileExistsError(f"run {run_id} of workbook {sha256} exists")
            return [self._publish(sha256, files, run_id, started) for sha256, files in sorted(runs.items())]
        finally:
            _, root = file_system(staging)
            if self.exists(root):
                self.system.delete_dir(root)

    def _publish(self, sha256: str, files: dict[str, dict], run_id: str, started: datetime) -> RunRecord:
        folder = self.run_dir(sha256, run_id)
        self.system.create_dir(folder, recursive=True)
        artifacts = []
        for name in LAYOUTS:
            self.system.move(files[name]["staged"], f"{folder}/{name}")
            artifacts.append(ArtifactRecord(name, f"{folder}/{name}", files[name]["digest"], files[name]["bytes"]))
        record = RunRecord(run_id, sha256, started.isoformat(), datetime.now(UTC).isoformat(), artifacts)
        record.artifacts.append(self.put(f"{folder}/{METADATA}", self._metadata(record)))
        record.artifacts.append(self._index(record, folder))
        record.artifacts[-2] = self.put(f"{folder}/{METADATA}", self._metadata(record))
        for artifact in record.artifacts[:-1]:
            self._copy(artifact.path, f"{self.root}/{artifact.name}")
        return record

    def _copy(self, path: str, to: str) -> None:
        new = f"{to}.{uuid.uuid4().hex[:8]}"
        self.system.copy_file(path, new)
        self.system.move(new, to)

    def _metadata(self, record: RunRecord) -> bytes:
        return (json.dumps({"schema_version": SCHEMA_VERSION, "artifact_type": "run_metadata", **asdict(record)}, indent=2) + "\n").encode()

    def _index(self, record: RunRecord, folder: str) -> ArtifactRecord:
        """The run's entry, and the index of all entries. What another writer adds meanwhile is seen afterwards, and the
        index is written again; whoever writes last has seen all."""
        home = self.workbook_dir(record.workbook_sha256)
        entry = {"run_id": record.run_id, "run_dir": folder, "started_at": record.started_at, "completed_at": record.completed_at, "artifacts": [asdict(a) for a in record.artifacts]}
        self.put(f"{home}/index/{quote(record.run_id, safe='')}.json", (json.dumps(entry) + "\n").encode())
        while True:
            listed = self._entries(home)
            runs = [json.loads(self.read(path)) for path in listed]
            runs.sort(key=lambda r: (r["completed_at"] or "", r["run_id"]))
            index = {"schema_version": SCHEMA_VERSION, "workbook_sha256": record.workbook_sha256, "latest_run_id": runs[-1]["run_id"], "runs": runs}
            data = (json.dumps(index, indent=2) + "\n").encode()
            self.put(f"{self.root}/{INDEX}", data)
            own = self.put(f"{home}/{INDEX}", data)
            if self._entries(home) == listed:
                return own

    def _entries(self, home: str) -> list[str]:
        found = self.system.get_file_info(fs.FileSelector(f"{home}/index"))
        return sorted(f.path for f in found if f.base_name.endswith(".json") and not f.base_name.startswith("."))

    def read_json(self, path: str | Path, artifact_type: str | None = None) -> dict:
        return self._checked(self.read(str(path)), str(path), SCHEMA_VERSION, artifact_type)

    def _checked(self, data: bytes, path: str, version: str, artifact_type: str | None) -> dict:
        found = json.loads(data)
        if found.get("schema_version", SCHEMA_VERSION if version != SCHEMA_VERSION else None) != version:
            raise ValueError(f"unsupported schema_version in {path}: {found.get('schema_version')!r}")
        if artifact_type and found.get("artifact_type") != artifact_type:
            raise ValueError(f"{path} holds {found.get('artifact_type')!r}, not {artifact_type!r}")
        if version == SCHEMA_VERSION and (wrong := mismatch(found, ARTIFACT_SHAPES.get(artifact_type or found.get("artifact_type"), ANY))):
            raise ValueError(f"{path} has not the shape of {artifact_type}: {wrong}")
        return found

    def read_artifact(self, record: ArtifactRecord) -> dict:
        if record.name not in ARTIFACTS:
            raise ValueError(f"unknown artifact: {record.name}")
        data = self.read(record.path)
        if sha256_of(data) != record.sha256:
            raise ValueError(f"checksum mismatch: {record.path}")
        return self._checked(data, record.path, record.schema_version, ARTIFACTS[record.name])

    def read_run(self, sha256: str, run_id: str) -> RunRecord:
        """The run's record after all its artifacts have been verified; index and metadata change later and are not."""
        found = self.read_json(f"{self.run_dir(sha256, run_id)}/{METADATA}", "run_metadata")
        artifacts = [ArtifactRecord(**a) for a in found["artifacts"]]
        for record in artifacts:
            if record.name not in (INDEX, METADATA):
                self.read_artifact(record)
        return RunRecord(found["run_id"], found["workbook_sha256"], found["started_at"], found["completed_at"], artifacts)


def verify(spark: SparkSession, records: DataFrame, out: str | Path) -> DataFrame:
    """(name, ok) for many artifacts at once: the files of the store under `out` are listed by Spark and hashed by tasks,
    and joined to their records. records: name, path, sha256."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(f"{out}/workbooks")
    files = found.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.sha2("content", 256).alias("found"))
    return checksums(records.join(files, "path", "left"))


def checksums(pairs: DataFrame) -> DataFrame:
    """(name, ok) of rows with name, sha256 and found."""
    return pairs.select("name", F.coalesce(F.col("sha256") == F.col("found"), F.lit(False)).alias("ok"))


def merge_index(runs: DataFrame, new: DataFrame) -> DataFrame:
    """(sha256, run_id, completed_at, is_latest): runs of the same id are replaced, the newest by completion is latest."""
    columns = ["sha256", "run_id", "completed_at"]
    kept = runs.select(columns).join(new.select("sha256", "run_id"), ["sha256", "run_id"], "left_anti")
    merged = kept.unionByName(new.select(columns))
    newest = Window.partitionBy("sha256").orderBy(F.col("completed_at").desc(), F.col("run_id").desc())
    return merged.withColumn("is_latest", F.row_number().over(newest) == 1)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A frame that write_tables has written, of all runs, by its contract: columns of other types are refused, and
    further columns (the run_id) come after."""
    found = spark.read.parquet(f"{folder.rstrip('/')}/{name}")
    kinds = dict(found.dtypes)
    wrong = [f.name for f in schema_of(name) if kinds.get(f.name) != f.dataType.simpleString()]
    if wrong:
        raise ValueError(f"table {name} under {folder} has not the contract's columns: {', '.join(wrong)}")
    return found


def frames_of(done: Decomposition) -> dict[str, DataFrame]:
    """All frames of a decomposition by the names of their contracts."""
    return {
        "manifest": done.inventory.manifest, "sheets": done.inventory.sheets, "parts": done.inventory.parts, "cells": done.inventory.cells, "ranges": done.inventory.ranges,
        "unsupported": done.inventory.unsupported.unionByName(done.graph.unsupported), "nodes": done.graph.nodes, "edges": done.graph.edges, "items": done.items, "questions": done.questions, "coverage": done.coverage,
    }


def write_tables(done: Decomposition, folder: str, run_id: str) -> None:
    """All frames as Parquet tables partitioned by run, for corpora of workbooks, on any file system."""
    for name, df in frames_of(done).items():
        df.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}/run_id={run_id}")
