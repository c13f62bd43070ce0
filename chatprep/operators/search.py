"""Listing, finding and searching files held as rows of ``path, length, text``."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatprep.functions.text import base_name, name_glob, one_line_break, parent_path, path_glob
from chatprep.rules import (
    FORBIDDEN_FRAGMENTS,
    FOUND_FILES,
    GREP_LINE_CHARS,
    GREP_MATCHES,
    LISTED_FILES,
    PYTHON_SPACE,
)


def _chosen(files: DataFrame, pattern: str) -> DataFrame:
    """Files that a walk reaches and whose name fits.

    A walk does not enter folders whose name holds a forbidden fragment.
    """
    fragments = "|".join(re.escape(f) for f in FORBIDDEN_FRAGMENTS if "/" not in f)
    walked = files.where(~F.rlike("path", F.lit(f"(?:{fragments})[^/]*/")))
    return walked if pattern == "*" else walked.where(_name_fits(pattern))


def _files(entries: DataFrame) -> DataFrame:
    """The files of a walk; all rows of a table of files alone."""
    return entries.where("kind = 'file'") if "kind" in entries.columns else entries


def _name_fits(pattern: str) -> Column:
    return F.rlike(base_name(F.col("path")), F.lit(name_glob(pattern)))


def list_folders(files: DataFrame) -> DataFrame:
    """Every folder: those of a walk, empty ones too; of a table of files, those that hold one, at any depth."""
    if "kind" in files.columns:
        return files.where("kind = 'folder'").select("path")
    names = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(names)), lambda n: F.array_join(F.slice(names, 1, n), "/"))
    return (
        files.where(F.contains("path", F.lit("/")))
        .select(parent_path(F.col("path")).alias("path"))
        .distinct()
        .select(F.explode(above).alias("path"))
        .distinct()
    )


def list_files(files: DataFrame, recursive: bool = False, pattern: str = "*") -> DataFrame:
    """Entries of a listing: path, kind, length and a line to show.

    ``files`` is a table of files, or what a walk found, see ``sources.walk``. Recursive: all files whose name fits, but not below folders that the policy
    forbids. Else files and folders directly inside whose name fits.
    """
    if recursive:
        return _file_entries(_chosen(_files(files), pattern))
    direct = ~F.contains("path", F.lit("/")) & _name_fits(pattern)
    return _file_entries(_files(files).where(direct)).unionByName(_folder_entries(list_folders(files).where(direct)))


def search_files(files: DataFrame, pattern: str) -> DataFrame:
    """Files and folders whose relative path fits a glob; ``**`` spans folders."""
    fits = F.rlike("path", F.lit(path_glob(pattern)))
    return _file_entries(_files(files).where(fits)).unionByName(_folder_entries(list_folders(files).where(fits)))


def _file_entries(files: DataFrame) -> DataFrame:
    size = F.concat(F.lit(" ("), F.format_number("length", 0), F.lit(" bytes)"))
    return files.select("path", F.lit("file").alias("kind"), "length", F.concat("path", size).alias("entry"))


def _folder_entries(folders: DataFrame) -> DataFrame:
    return folders.select(
        "path",
        F.lit("folder").alias("kind"),
        F.lit(None).cast("long").alias("length"),
        F.concat("path", F.lit("/")).alias("entry"),
    )


def cap_with_rest(df: DataFrame, order: list[str], n: int = LISTED_FILES) -> DataFrame:
    """The first ``n`` rows in order, each with the number of rows left out.

    For reports; a listing is capped at 100 entries and a search at 50.
    """
    total = df.agg(F.count("*").alias("total")).scalar()
    return df.orderBy(*order).limit(n).withColumn("n_more", F.greatest(total - n, F.lit(0)))


def cap_found(found: DataFrame) -> DataFrame:
    """The report of a file search: the first 50 entries by path."""
    return cap_with_rest(found, ["path"], FOUND_FILES)


def java_regex(df: DataFrame, pattern: str, case_sensitive: bool) -> str:
    """The pattern with Python's reading of case, letters, line ends and group names.

    A pattern that does not compile is reported here, before any data is read.
    """
    full = ("(?dU)" if case_sensitive else "(?diuU)") + re.sub(
        r"\\.|\(\?P<|\(\?P=(\w+)\)", _java_token, pattern, flags=re.DOTALL
    )
    try:
        df.sparkSession._jvm.java.util.regex.Pattern.compile(full)
    except Exception as error:
        raise ValueError(f"Invalid regex pattern: {pattern}") from error
    return full


def _java_token(found: re.Match) -> str:
    """Escapes and group names as Java writes them."""
    if found[1]:
        return f"\\k<{found[1]}>"
    return {"(?P<": "(?<", "\\Z": "\\z"}.get(found[0], found[0])


def grep(
    files: DataFrame,
    pattern: str,
    case_sensitive: bool = False,
    include: str = "*",
    line_chars: int | None = GREP_LINE_CHARS,
) -> DataFrame:
    """All lines of all files that hold a regex: path, line number from 1, and the line.

    A line is cut to ``line_chars`` characters, 150 as in a report; None keeps it whole.
    Texts may be pieces of files with ``lines_before`` them, see ``sources.corpus.text_parts``.
    """
    regex = java_regex(files, pattern, case_sensitive)
    chosen = searched_files(files, include)
    pieces = "lines_before" in files.columns
    before = [F.col("lines_before")] if pieces else []
    lines = chosen.select("path", *before, F.split(one_line_break(F.col("text")), "\n").alias("lines"))
    lines = lines.select("path", *before, F.size("lines").alias("n"), F.posexplode("lines").alias("at", "line"))
    ended = F.col("at") < F.col("n") - 1
    searched = F.when(ended, F.concat("line", F.lit("\n"))).otherwise(F.col("line"))
    shown = F.rtrim(F.col("line"), F.lit(PYTHON_SPACE))
    if line_chars is not None:
        shown = F.substring(shown, 1, line_chars)
    # What follows the last line break is a line only if it is not empty.
    return lines.where((ended | (F.col("line") != "")) & F.rlike(searched, F.lit(regex))).select(
        "path", (sum(before, F.col("at")) + 1).alias("line_num"), shown.alias("line")
    )


def grep_report(files: DataFrame, pattern: str, case_sensitive: bool = False, include: str = "*") -> DataFrame:
    """What a report shows of a search of all files: the first 50 matches, and how many more."""
    return cap_with_rest(grep(files, pattern, case_sensitive, include), ["path", "line_num"], GREP_MATCHES)


def searched_files(files: DataFrame, include: str = "*") -> DataFrame:
    """Files that a search opens: the name fits and no folder on the way is forbidden."""
    return _chosen(files, include)


def grep_by_file(matches: DataFrame) -> DataFrame:
    """Matches by file."""
    return matches.groupBy("path").agg(F.count("*").alias("n_matches"))


def grep_summary(files: DataFrame, matches: DataFrame, include: str = "*") -> DataFrame:
    """Matches, files with matches, and files searched."""
    searched = searched_files(files, include).agg(F.count("*").alias("n")).scalar()
    return grep_by_file(matches).agg(
        F.coalesce(F.sum("n_matches"), F.lit(0)).alias("n_matches"),
        F.count("*").alias("n_files_matched"),
    ).withColumn("n_files_searched", searched)
