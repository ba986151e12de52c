"""Checks that reject a file before or after its processing.

Each gate gives verdict rows; ``require`` turns them into an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# --- fixed values -----------------------------------------------------------
MAX_MEMBERS = 10_000
MAX_UNCOMPRESSED_BYTES = 250 * 1024 * 1024
MAX_UPLOAD_BYTES = 25 * 1024 * 1024
MAX_REQUEST_BYTES = 26 * 1024 * 1024
UPLOAD_ERROR = "File exceeds the 25 MiB upload limit"
REQUIRED_PARTS = {
    "xlsx": ["[Content_Types].xml", "xl/workbook.xml", "xl/_rels/workbook.xml.rels"],
    "docx": ["[Content_Types].xml", "word/document.xml"],
}
# members, encrypted, size, required parts: in the order of the checks
PACKAGE_ERRORS = {
    "xlsx": [
        "Workbook contains too many package members",
        "Password-protected XLSX packages are not supported",
        "Workbook expands beyond the safe processing limit",
        "Input is not a valid XLSX workbook package",
    ],
    "docx": [
        "Document contains too many package members",
        "Password-protected DOCX packages are not supported",
        "Document expands beyond the safe processing limit",
        "Input is not a valid DOCX document",
    ],
}
# ----------------------------------------------------------------------------


class GateError(RuntimeError):
    """A gate rejected the input."""


def package_gate(
    parts: DataFrame,
    kind: str = "xlsx",
    max_members: int = MAX_MEMBERS,
    max_bytes: int = MAX_UNCOMPRESSED_BYTES,
    required: list[str] | None = None,
) -> DataFrame:
    """Per file: members, total size and ``error`` (NULL when it passes).

    ``parts``: file_path, part, flag_bits, file_size. Only counters are
    aggregated, so one huge package does not gather its member names.
    """
    required = REQUIRED_PARTS[kind] if required is None else required
    too_many, locked, too_large, incomplete = PACKAGE_ERRORS[kind]
    found = [
        F.max((F.col("part") == name).cast("int")).alias(f"_has{i}") for i, name in enumerate(required)
    ]
    counted = parts.groupBy("file_path").agg(
        F.count(F.lit(1)).alias("members"),
        F.max(F.col("flag_bits").bitwiseAND(F.lit(1))).alias("encrypted"),
        F.sum("file_size").alias("total_size"),
        *found,
    )
    complete = F.lit(True)
    for i in range(len(required)):
        complete = complete & (F.col(f"_has{i}") == 1)
    return counted.select(
        "file_path",
        "members",
        "total_size",
        F.when(F.col("members") > max_members, too_many)
        .when(F.col("encrypted") == 1, locked)
        .when(F.col("total_size") > max_bytes, too_large)
        .when(~complete, incomplete)
        .alias("error"),
    )


def missing_parts(parts: DataFrame, required: DataFrame) -> DataFrame:
    """Required (file_path, part) pairs that are absent."""
    return required.join(parts.select("file_path", "part"), ["file_path", "part"], "left_anti")


def upload_gate(files: DataFrame, limit: int = MAX_UPLOAD_BYTES) -> DataFrame:
    """``error`` for files (path, length) above the upload limit; reads no content."""
    return files.withColumn("error", F.when(F.col("length") > limit, UPLOAD_ERROR))


def request_gate(requests: DataFrame, limit: int = MAX_REQUEST_BYTES) -> DataFrame:
    """HTTP status for declared request sizes (``length``): 413 above the limit."""
    return requests.withColumn("status", F.when(F.col("length") > limit, 413).otherwise(200))


def require(verdicts: DataFrame) -> None:
    """Raise for the first rejected file, if any."""
    first = verdicts.where(F.col("error").isNotNull()).select("error").head()
    if first is not None:
        raise GateError(first["error"])


def require_changes(total: int, mode: str, what: str = "workbook") -> None:
    """A run that changed nothing is an error."""
    if total:
        return
    if mode == "replace":
        raise GateError(f"No replacement values were found in the {what}")
    raise GateError(f"No values were found to {mode}")
