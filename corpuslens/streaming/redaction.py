"""ST3: redaction of a log stream; stateless, the same expression as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpuslens import functions as fn


def redacted_stream(lines: DataFrame, column: str = "value") -> DataFrame:
    return lines.withColumn(column, fn.redact_secrets(F.col(column)))
