"""Functions on paths and file content."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

ARCHIVE_ROOT = "Project_CodeNet/data"  # fixed value: the archive's own root
LANGUAGE_DIR = "C++"


def archive_path(problem: Column, submission: Column, root: str = ARCHIVE_ROOT) -> Column:
    """root/problem/C++/submission.cpp; null if a part is null."""
    return F.concat(F.lit(f"{root}/"), problem.cast("string"), F.lit(f"/{LANGUAGE_DIR}/"), submission.cast("string"), F.lit(".cpp"))


def strip_prefix(path: Column, prefix: str) -> Column:
    return F.when(path.startswith(prefix), F.substring(path, F.lit(len(prefix) + 1), F.char_length(path))).otherwise(path)


def forward_slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def normalized(content: Column) -> Column:
    """Bytes without one leading byte order mark, with line feeds only and no white space at line ends.

    Bytes pass as ISO-8859-1 characters, which keeps all 256 values apart.
    """
    text = F.decode(content.cast("binary"), "ISO-8859-1")
    text = F.regexp_replace(text, r"\Aï»¿", "")
    text = F.regexp_replace(text, r"\r\n?", "\n")
    text = F.regexp_replace(text, r"[ \t\x0B\f]+(?=\n|\z)", "")
    return F.encode(text, "ISO-8859-1")


def content_hash(content: Column) -> Column:
    return F.sha2(normalized(content), 256)


def has_high_byte(content: Column) -> Column:
    return F.decode(content.cast("binary"), "ISO-8859-1").rlike("[\\x80-\\xff]")


def is_utf8(content: Column) -> Column:
    return F.is_valid_utf8(content.cast("binary").cast("string"))


@F.pandas_udf(BooleanType())
def is_shift_jis(content: pd.Series) -> pd.Series:
    """Whether bytes decode as Shift-JIS, which Spark has no decoder for; null stays null."""

    def decodes(raw: bytes | None) -> bool | None:
        if raw is None:
            return None
        try:
            bytes(raw).decode("shift_jis")
        except UnicodeDecodeError:
            return False
        return True

    return content.map(decodes).astype(object)


def encoding_of(content: Column) -> Column:
    return F.when(is_utf8(content), "utf-8").when(is_shift_jis(content.cast("binary")), "shift_jis").otherwise("neither")
