"""Column functions over text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatprep.rules import PYTHON_SPACE, REASONING


def clean_text(col: Column) -> Column:
    """Text without white space at both ends, by Python's notion of white space."""
    return F.btrim(col.cast("string"), F.lit(PYTHON_SPACE))


def strip_reasoning(col: Column) -> Column:
    """Text without ``<think>`` blocks and the white space after each."""
    return clean_text(F.regexp_replace(col, REASONING, ""))


def preview(col: Column, n: int, ellipsis: bool = False) -> Column:
    """The first ``n`` characters, with dots where more follow."""
    head = F.substring(col, 1, n)
    if not ellipsis:
        return head
    return F.when(F.char_length(col) > n, F.concat(head, F.lit("..."))).otherwise(head)


def token_count(col: Column) -> Column:
    """Number of runs without white space.

    A stand-in for a model's tokenizer: use ``operators.pack.count_tokens`` with a
    tokenizer where the exact number matters.
    """
    return F.regexp_count(col, F.lit(r"\S+")).cast("long")


def tokens_of(col: Column) -> Column:
    """The runs without white space that ``token_count`` counts."""
    return F.regexp_extract_all(col, F.lit(r"\S+"), F.lit(0))


def one_line_break(col: Column) -> Column:
    """Text whose line breaks are all ``\\n``."""
    return F.when(F.contains(col, F.lit("\r")), F.regexp_replace(col, "\r\n?", "\n")).otherwise(col)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_path(path: Column) -> Column:
    """Everything before the last slash, empty for a name alone."""
    return F.regexp_extract(path, "(?s)^(.*)/[^/]*$", 1)


def _glob_body(pattern: str, any_char: str) -> str:
    out, at = [], 0
    while at < len(pattern):
        char = pattern[at]
        at += 1
        end = pattern.find("]", at + 1 + pattern.startswith("!", at)) if char == "[" else -1
        if char == "*":
            out.append(any_char + "*")
        elif char == "?":
            out.append(any_char)
        elif end > 0:
            negated = pattern[at] == "!"
            members = pattern[at + negated : end]
            for special in ("\\", "[", "&", "^"):
                members = members.replace(special, "\\" + special)
            out.append(f"[{'^' if negated else ''}{members}]")
            at = end + 1
        else:
            out.append(char if char.isalnum() or char in "_/ " else "\\" + char)
    return "".join(out)


def name_glob(pattern: str) -> str:
    """Java regex for a shell glob over one name: ``*``, ``?``, ``[abc]``, ``[!abc]``."""
    return "(?s)^" + _glob_body(pattern, ".") + "\\z"


def path_glob(pattern: str) -> str:
    """Java regex for a glob over a relative path; ``**`` stands for any folders."""
    segments = [s for s in pattern.split("/") if s not in ("", ".")]
    out = []
    for number, segment in enumerate(segments, 1):
        last = number == len(segments)
        if segment == "**":
            out.append(".*" if last else "(?:[^/]+/)*")
        else:
            out.append(_glob_body(segment, "[^/]") + ("" if last else "/"))
    return "(?s)^" + "".join(out) + "\\z"
