"""Function rows of a stream of sources. Parsing is stateless, so the batch operator applies as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.parse import parse
from ..sources.tables import from_table


def function_stream(sources: DataFrame, path: str = "path", src: str = "src", **options) -> DataFrame:
    """Function and error rows of a streaming table of paths and sources."""
    return parse(from_table(sources, path, src), **options)
