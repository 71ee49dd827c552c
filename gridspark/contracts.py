"""The shapes of all frames, and the closed sets of values in them.

Every frame carries `sha256`, the workbook's content hash, as its key: many workbooks are decomposed in one job.
"""

from __future__ import annotations

import json

from pyspark.sql import types as T

# Written into artifacts and compared by their readers.
SCHEMA_VERSION = "phase1.v1"
WORKBOOK_TYPES = ("xlsx", "xlsm")
SEVERITIES = ("info", "warning", "error")
CELL_KINDS = ("value", "formula", "blank")
NODE_KINDS = ("cell", "range", "name", "external", "unsupported")
CATEGORIES = ("input", "data_table", "formula_block", "lookup_block", "output", "presentation", "external_dependency", "unsupported_opaque", "other")
HINTS = ("assumption", "rate_table", "cashflow", "projection", "output", "unknown")

LOC = "struct<workbook_path:string,sheet_name:string,sheet_index:long,address:string,object_type:string,object_id:string,ooxml_part:string>"

CELLS = (
    "sha256 string, sheet_name string, sheet_index long, row long, column long, address string, kind string, value string, value_type string, "
    f"data_type string, number_format string, formula string, style_id long, loc {LOC}"
)
RANGES = f"sha256 string, scope string, sheet_name string, sheet_index long, seq long, name string, address string, kind string, metadata map<string,string>, loc {LOC}"
UNSUPPORTED = f"sha256 string, origin string, seq array<long>, feature_type string, description string, severity string, opaque boolean, metadata map<string,string>, loc {LOC}"
#: Where in a workbook something was emitted: sheet, row, column, step. Arrays of longs compare like tuples.
SEQ = "array<long>"

#: Every frame of a decomposition and its shape.
FRAMES = {
    "manifest": "sha256 string, workbook_path string, other_paths array<string>, file_name string, file_size long, is_macro_enabled boolean, named_ranges_count long, calc_mode string",
    "sheets": "sha256 string, part string, path string, sheet_name string, sheet_index long, state string, max_row long, max_column long",
    "parts": f"sha256 string, name string, path string, part_seq long, size long, content_type string, relationship_type string, opaque boolean, loc {LOC}",
    "cells": CELLS,
    "ranges": RANGES,
    "unsupported": UNSUPPORTED,
    "nodes": f"sha256 string, id string, kind string, label string, first_seq {SEQ}, loc {LOC}",
    "edges": f"sha256 string, seq {SEQ}, source string, target string, relationship string, formula string, loc {LOC}",
    "items": f"sha256 string, seq {SEQ}, id string, category string, confidence double, reasons array<string>, source_artifact_refs array<string>, hints array<string>, loc {LOC}",
    "questions": f"sha256 string, seq {SEQ}, id string, prompt string, question_type string, options array<string>, default string, rationale string, loc {LOC}",
    "coverage": "sha256 string, recognized long, opaque long, discovered long",
}

# What the values of a JSON artifact are; every value may also be null.
TEXT, WHOLE, NUMBER, TRUTH, ANY = "text", "whole number", "number", "truth value", "anything"
_KINDS = {TEXT: (str,), WHOLE: (int,), NUMBER: (int, float), TRUTH: (bool,)}
_HEAD = {"schema_version": TEXT, "artifact_type": TEXT}
_PLACE = {"workbook_path": TEXT, "sheet_name": TEXT, "sheet_index": WHOLE, "address": TEXT, "object_type": TEXT, "object_id": TEXT, "ooxml_part": TEXT}
_SIZE = {"name": TEXT, "index": WHOLE, "max_row": WHOLE, "max_column": WHOLE, "state": TEXT}
_CELL = {"source_location": _PLACE, "address": TEXT, "row": WHOLE, "column": WHOLE, "kind": TEXT, "value": ANY, "data_type": TEXT, "number_format": TEXT, "formula": TEXT, "style_id": WHOLE}
_RANGE = {"source_location": _PLACE, "name": TEXT, "address": TEXT, "kind": TEXT, "metadata": ANY}
_PROBLEM = {"feature_type": TEXT, "description": TEXT, "source_location": _PLACE, "severity": TEXT, "opaque": TRUTH, "metadata": ANY}
_PART = {"name": TEXT, "content_type": TEXT, "relationship_type": TEXT, "size": WHOLE, "opaque": TRUTH, "source_location": _PLACE}
_NODE = {"id": TEXT, "kind": TEXT, "label": TEXT, "source_location": _PLACE, "metadata": ANY}
_EDGE = {"source": TEXT, "target": TEXT, "relationship": TEXT, "formula": TEXT, "source_location": _PLACE}
_ITEM = {"id": TEXT, "category": TEXT, "confidence": NUMBER, "reasons": [TEXT], "source_location": _PLACE, "source_artifact_refs": [TEXT], "actuarial_hints": [TEXT]}
_QUESTION = {"id": TEXT, "prompt": TEXT, "question_type": TEXT, "source_location": _PLACE, "options": [TEXT], "default": TEXT, "rationale": TEXT}
_COUNTS = {"recognized_inventory_objects": WHOLE, "unsupported_or_opaque_objects": WHOLE, "discovered_workbook_objects": WHOLE}
_RECORD = {"name": TEXT, "path": TEXT, "sha256": TEXT, "bytes": WHOLE, "schema_version": TEXT}
#: The shape of each artifact by its type: objects by key, lists by the shape of what they hold.
ARTIFACT_SHAPES: dict[str, dict] = {
    "workbook_manifest": _HEAD | {"workbook_path": TEXT, "file_name": TEXT, "file_size": WHOLE, "sha256": TEXT, "is_macro_enabled": TRUTH, "named_ranges_count": WHOLE, "calc_mode": TEXT, "sheets": [_SIZE], "package_parts": [_PART], "unsupported_features": [_PROBLEM]},
    "workbook_inventory": _HEAD | {"workbook_sha256": TEXT, "coverage": _COUNTS, "sheets": [_SIZE | {"source_location": _PLACE, "cells": [_CELL], "ranges": [_RANGE], "layout_objects": [_RANGE]}], "workbook_ranges": [_RANGE], "unsupported_features": [_PROBLEM]},
    "formula_graph": _HEAD | {"nodes": [_NODE], "edges": [_EDGE], "unsupported_features": [_PROBLEM]},
    "module_classification": _HEAD | {"items": [_ITEM], "unsupported_features": [_PROBLEM]},
    "confirmation_template": _HEAD | {"questions": [_QUESTION], "decisions": [ANY]},
    "run_metadata": _HEAD | {"run_id": TEXT, "workbook_sha256": TEXT, "started_at": TEXT, "completed_at": TEXT, "artifacts": [_RECORD]},
}


def mismatch(value: object, shape: object, at: str = "$") -> str | None:
    """Where and how a JSON value departs from a shape; None if it doesn't."""
    if shape == ANY or value is None:
        return None
    if isinstance(shape, dict):
        if not isinstance(value, dict):
            return f"{at} is no object"
        if set(value) != set(shape):
            return f"{at} has the keys {sorted(map(str, set(value) ^ set(shape)))} too many or too few"
        found = (mismatch(value[k], s, f"{at}.{k}") for k, s in shape.items())
    elif isinstance(shape, list):
        if not isinstance(value, list):
            return f"{at} is no list"
        found = (mismatch(v, shape[0], f"{at}[{i}]") for i, v in enumerate(value))
    else:
        right = isinstance(value, _KINDS[shape]) and (shape == TRUTH or not isinstance(value, bool))
        return None if right else f"{at} is no {shape}"
    return next(filter(None, found), None)


def schema_of(name: str) -> T.StructType:
    return T.StructType.fromDDL(FRAMES[name])


def schemas_json() -> str:
    """All contracts as one JSON text, with their version."""
    return json.dumps({"schema_version": SCHEMA_VERSION, "frames": {name: json.loads(schema_of(name).json()) for name in FRAMES}, "artifacts": ARTIFACT_SHAPES}, indent=2)
