"""Format of a file by its extension, confirmed by its bytes."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions and the format each stands for.
FORMATS = {
    ".txt": "text", ".md": "text", ".pdf": "pdf", ".docx": "docx", ".xlsx": "xlsx",
    ".csv": "csv", ".pptx": "pptx", ".png": "image", ".jpg": "image", ".jpeg": "image",
}
#: The first bytes of binary formats, and the part that an office file must have.
MAGIC = {".pdf": b"%PDF-", ".png": b"\x89PNG\r\n\x1a\n", ".jpg": b"\xff\xd8\xff", ".jpeg": b"\xff\xd8\xff"}
PARTS = {".docx": "word/document.xml", ".xlsx": "xl/workbook.xml", ".pptx": "ppt/presentation.xml"}


def extension(filename: Column) -> Column:
    """Lower-cased, from the last dot; empty without one."""
    return F.regexp_extract(F.lower(F.coalesce(filename, F.lit(""))), r"(\.[^.]*)$", 1)


def format_of(filename: Column) -> Column:
    """The format that the extension stands for; null if it is not supported."""
    return F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv])[extension(filename)]


def starts_with(content: Column, magic: bytes) -> Column:
    return F.substring(content, 1, len(magic)) == F.lit(magic)


def is_utf8(content: Column) -> Column:
    return F.is_valid_utf8(content.cast("string"))


def _zip_parts(content: pd.Series) -> pd.Series:
    """Those of PARTS that a zip file's directory lists; none for anything else."""

    def of(raw):
        try:
            names = set(zipfile.ZipFile(io.BytesIO(raw)).namelist())
        except (zipfile.BadZipFile, ValueError, OSError):
            return []
        return [p for p in PARTS.values() if p in names]

    return content.map(lambda raw: of(bytes(raw)) if raw is not None else [])


def zip_parts(content: Column) -> Column:
    return F.pandas_udf(_zip_parts, "array<string>")(content)


def detected(filename: Column, content: Column) -> Column:
    """Struct of format and error; one of them is null."""
    ext, quoted = extension(filename), F.concat(F.lit("'"), F.coalesce(filename, F.lit("")), F.lit("'"))
    listed = ", ".join(sorted(FORMATS))
    bad = F.when(format_of(filename).isNull(), F.concat(quoted, F.lit(f" is of no known type; known are {listed}.")))
    for e, magic in MAGIC.items():
        bad = bad.when((ext == e) & ~starts_with(content, magic), F.concat(quoted, F.lit(f" is named {e}, but its first bytes are not those of such a file.")))
    for e, part in PARTS.items():
        bad = bad.when((ext == e) & ~F.array_contains(zip_parts(content), part), F.concat(quoted, F.lit(f" is named {e}, but lacks the main part of such a file.")))
    bad = bad.when(ext.isin(".txt", ".md", ".csv") & ~is_utf8(content), F.concat(quoted, F.lit(" holds bytes that are no UTF-8.")))
    return F.struct(F.when(bad.isNull(), format_of(filename)).alias("format"), bad.alias("error"))
