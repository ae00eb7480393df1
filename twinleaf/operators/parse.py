"""Source rows to function rows, in Arrow batches. Python trees never leave this operator."""

from __future__ import annotations

import ast
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..schema import FEATURES, OCCURRENCE, ddl
from ..session import ship
from ..sources.tables import scan_key
from . import syntax

PARSED = {"rel": "string"} | OCCURRENCE | FEATURES | {"canonical": "string", "error": "string", "fatal": "boolean", "source": "string"}


def functions_of(content: bytes | None, read_error: str | None, path: str, top_level_only: bool, features: bool, normal: tuple[bool, bool] | None, keep: frozenset[str], source: bool) -> Iterator[dict]:
    """A row for each visible function, or one with the error."""
    if read_error is not None or content is None:
        yield {"error": read_error or "TypeError: no source"}
        return
    try:
        text = content.decode("utf-8").replace("\r\n", "\n").replace("\r", "\n")
        module = ast.parse(text, filename=path)
    except Exception as error:  # whatever a file does to the parser is that file's error
        yield {"error": f"{type(error).__name__}: {error}"}
        return
    lines = text.split("\n") if source else []
    for fn, above, in_class in syntax.visible_functions(module, top_level_only):
        row = syntax.occurrence(fn, above, in_class)
        try:
            if features:
                row |= syntax.measure(fn)
            if normal is not None:
                row["canonical"] = syntax.canonical(fn, *normal, keep)
        except Exception as error:  # unlike a file that does not parse, this ends the query
            yield {"error": f"{type(error).__name__}: {error}", "fatal": True}
            return
        if source:
            row["source"] = "\n".join(lines[fn.lineno - 1 : fn.end_lineno])
        yield row


def _parse(batches: Iterator[pa.RecordBatch], schema: pa.Schema, options: dict) -> Iterator[pa.RecordBatch]:
    counters = {n for n, kind in PARSED.items() if kind.startswith("map")}
    for batch in batches:
        columns = {n: [] for n in schema.names}
        for rel, path, content, read_error in zip(*(batch.column(c).to_pylist() for c in ("rel", "path", "content", "read_error")), strict=True):
            for row in functions_of(content, read_error, path, **options):
                row["rel"], row["path"] = rel, path
                for n, column in columns.items():
                    v = row.get(n)
                    column.append(list(v.items()) if n in counters and v is not None else v)
        if columns["rel"]:
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def parse(sources: DataFrame, top_level_only: bool = False, features: bool = True, normal: tuple[bool, bool] | None = None, keep: frozenset[str] = frozenset(), source: bool = False) -> DataFrame:
    """Function and error rows of a source relation.

    normal: (local names, constants) to normalise away in `canonical`, which is null without it; keep: parts of syntax.KEEPABLE
    that it does not leave out. Features and source text are computed only if asked for.
    """
    if unknown := sorted(set(keep) - syntax.KEEPABLE):
        raise ValueError(f"unknown parts to keep: {', '.join(unknown)}")
    ship(sources.sparkSession)
    schema = StructType.fromDDL(ddl(PARSED))
    options = {"top_level_only": top_level_only, "features": features, "normal": normal, "keep": frozenset(keep), "source": source}
    rows = sources.select("rel", "path", "content", "read_error").mapInArrow(partial(_parse, schema=to_arrow_schema(schema), options=options), schema)
    return rows.withColumn("scan_key", scan_key(F.col("rel")))
