"""From a folder of files to a search report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chatprep.operators.search import cap_found, cap_with_rest, grep, grep_report, list_files, search_files
from chatprep.sources.corpus import RANGE_BYTES, text_parts
from chatprep.sources.walk import walk


def search_folder(
    spark: SparkSession,
    path: str,
    pattern: str,
    case_sensitive: bool = False,
    include: str = "*",
    report: bool = False,
    line_chars: int | None = None,
    range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """Lines of the files below a folder that hold a regex: path, line number, and the line.

    All files are searched, of any name and any size: large ones by ranges of
    ``range_bytes`` bytes, each with the lines that begin in it. Lines are whole unless
    ``line_chars`` cuts them. A report has the first 50, cut as reports cut them, and how
    many more there are. Bytes that are not UTF-8 are left out.
    """
    files = text_parts(spark, path, range_bytes)
    if report:
        return grep_report(files, pattern, case_sensitive, include)
    return grep(files, pattern, case_sensitive, include, line_chars)


def listing(
    spark: SparkSession, path: str, recursive: bool = False, pattern: str = "*", report: bool = False
) -> DataFrame:
    """A folder's entries; a report has the first 100 and how many more."""
    entries = list_files(walk(spark, path), recursive, pattern)
    return cap_with_rest(entries, ["path"]) if report else entries


def found(spark: SparkSession, path: str, pattern: str, report: bool = False) -> DataFrame:
    """Files and folders that fit a glob; a report has the first 50 and how many more."""
    entries = search_files(walk(spark, path), pattern)
    return cap_found(entries) if report else entries
