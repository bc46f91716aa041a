"""Errors by kind."""

from __future__ import annotations

from pyspark.errors import AnalysisException, ParseException, PySparkException


class EngineError(Exception):
    """An error with its kind: io, format, plan, execution or unsupported."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


def _condition(error: PySparkException) -> str:
    return (error.getCondition() or "") if hasattr(error, "getCondition") else ""


def classify(error: BaseException) -> EngineError:
    """The engine's error for one of Spark's."""
    if isinstance(error, EngineError):
        return error
    text = str(error)
    name = _condition(error) if isinstance(error, PySparkException) else ""
    if name.startswith("PATH_NOT_FOUND") or "FileNotFoundException" in text:
        kind = "io"
    elif name.startswith(("CANNOT_READ_FILE_FOOTER", "FAILED_READ_FILE", "UNABLE_TO_INFER_SCHEMA")) or "is not a Parquet file" in text or "footer" in text:
        kind = "format"
    elif isinstance(error, (AnalysisException, ParseException)):
        kind = "plan"
    else:
        kind = "execution"
    return EngineError(kind, text)
