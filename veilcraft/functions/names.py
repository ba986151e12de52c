"""Output names, format dispatch and public error messages."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from veilcraft.functions.text import basename, casefold, part_suffix

# --- fixed values -----------------------------------------------------------
MAX_STEM_CHARS = 120
SUFFIXES_BY_MODE = {
    "encrypt": [".xlsx"],
    "decrypt": [".xlsx"],
    "replace": [".xlsx", ".docx", ".pdf"],
}
# Tests in their order: (fragments of the lower-cased message, public message).
PUBLIC_MESSAGES = [
    (["already contains an encrypted value"],
     "This workbook already contains encrypted values and cannot be encrypted again."),
    (["key is wrong", "ciphertext was modified"],
     "The workbook could not be decrypted. The key may be different or the encrypted data was changed."),
    (["select at least one column"], "Select at least one field to encrypt."),
    (["selected columns"], "The selected fields could not be read. Upload the file again and retry."),
    (["at least one replacement"],
     "Add at least one find and replace rule before using Replace only."),
    (["no replacement values were found"],
     "No replacement values were found in the selected file."),
    (["no configured values", "no values were found"],
     "No values were found in the selected fields to encrypt."),
    (["replacement"],
     "Check the find and replace rules. Each rule needs a sensitive value and a safe label."),
    (["docx"], "The selected file is not a supported or readable .docx document."),
    (["pdf"], "The selected file is not a supported or readable PDF document."),
    (["document"], "The selected document could not be processed safely. No output was created."),
    (["too many package members", "safe processing limit"],
     "This workbook is too large or complex to process safely."),
    (["password-protected"], "Password-protected Excel workbooks are not supported."),
    (["xlsx", "workbook", "zip"],
     "The selected file is not a supported or readable .xlsx workbook."),
]
DEFAULT_MESSAGE = "The file could not be processed safely. No output was created."
NOTHING_TO_DECRYPT = "No encrypted values were found in this workbook."
PDF_LIBRARY_MISSING = (
    "PDF replacement requires the local PyMuPDF package. Install requirements and retry."
)
# ----------------------------------------------------------------------------


def output_name(original: Column, mode: Column) -> Column:
    """Name of the result file for an uploaded name."""
    supplied = basename(F.replace(F.coalesce(F.nullif(original, F.lit("")), F.lit("workbook.xlsx")), F.lit("\\"), F.lit("/")))
    own = part_suffix(supplied)
    suffix = F.when(own.isin(SUFFIXES_BY_MODE["replace"]), own).otherwise(".xlsx")
    raw_stem = F.regexp_replace(supplied, r"(?s)(?<=.)\.[^.]+\z", "")
    edges = F.lit(" .")
    safe = F.left(F.btrim(F.regexp_replace(raw_stem, "[^A-Za-z0-9 ._-]+", "_"), edges), F.lit(MAX_STEM_CHARS))
    default = F.when(mode == "replace", "document").otherwise("workbook")
    stem = F.coalesce(F.nullif(safe, F.lit("")), default)
    plain = F.btrim(F.regexp_replace(stem, r"(?i)\.encrypted", ""), edges)
    restored = F.coalesce(F.nullif(plain, F.lit("")), F.lit("workbook"))
    return (
        F.when(mode == "encrypt", F.concat(stem, F.lit(".encrypted.xlsx")))
        .when(mode == "replace", F.concat(stem, F.lit(".replaced"), suffix))
        .otherwise(F.concat(restored, F.lit("_restored.xlsx")))
    )


def is_supported(path: Column, mode: Column) -> Column:
    """Whether a mode accepts the file, by its extension."""
    suffix = part_suffix(path)
    verdict = F.lit(False)
    for name, suffixes in SUFFIXES_BY_MODE.items():
        verdict = F.when(mode == name, suffix.isin(suffixes)).otherwise(verdict)
    return F.coalesce(verdict, F.lit(False))


def public_message(message: Column, mode: Column) -> Column:
    """The message shown for an internal error. The order of the tests decides."""
    lowered = casefold(message)
    chain = F
    for fragments, shown in PUBLIC_MESSAGES:
        found = lowered.contains(fragments[0])
        for fragment in fragments[1:]:
            found = found | lowered.contains(fragment)
        if "no values were found" in fragments:
            answer = F.when(mode == "decrypt", NOTHING_TO_DECRYPT).otherwise(shown)
        elif fragments == ["replacement"]:
            answer = F.when(lowered.contains("pymupdf"), PDF_LIBRARY_MISSING).otherwise(shown)
        else:
            answer = F.lit(shown)
        chain = chain.when(found, answer)
    return chain.otherwise(DEFAULT_MESSAGE)
