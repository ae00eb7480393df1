"""Schemas of the relations."""

from __future__ import annotations

SCAN_KEY = "array<struct<d:int,n:string>>"
COUNTER = "map<string,int>"

#: Where a function is, and what it is called.
OCCURRENCE = {
    "path": "string",
    "lineno": "int",
    "end_lineno": "int",
    "col_offset": "int",
    "name": "string",
    "qualname": "string",
    "kind": "string",
    "param_count": "int",
    "is_method": "boolean",
}

#: What is measured on a function's tree.
FEATURES = {
    "node_types": COUNTER,
    "stmt_seq": "array<string>",
    "call_names": COUNTER,
    "literal_tokens": COUNTER,
    "external_names": COUNTER,
    "has_yield": "boolean",
    "has_await": "boolean",
    "control_count": "int",
    "returns": "int",
    "raises": "int",
    "literals": "int",
    "side_effect_calls": "array<string>",
    "is_wrapper": "boolean",
    "wrapper_target": "string",
    "fixed_args": "int",
    "passthrough_args": "int",
    "returns_lambda": "boolean",
    "curry_depth": "int",
    "stmt_count": "int",
}

#: The six similarity measures of a pair.
EVIDENCE = ("shape_similarity", "stmt_similarity", "call_similarity", "signature_similarity", "wrapper_score", "curry_score")


def ddl(fields: dict[str, str]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in fields.items())
