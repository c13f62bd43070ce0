"""Column functions over tool calls written as JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatprep.rules import CALL_TEXT, PYTHON_SPACE

TRAILING_COMMA = r"(?U),\s*([}\]])"
CALL_SCHEMA = "call STRUCT<name: STRING, arguments: STRING>, end STRING"
END_MARK = "end of call"
#: What a scan tells apart: signs, each with the plain text before it, and strings without signs.
BRACE_ATOM = r'[^{}"\\\n]*+(?:"[^{}"\\\n]*+"|[{}"\\\n]|\z)'
QUOTE_ATOM = r'["\\\n]|[^"\\\n]+'
_PAIRS = "array<struct<start:int,stop:int>>"
SCAN = f"at int; mode int; opened array<int>; pairs {_PAIRS}; opened_before array<int>; pairs_before {_PAIRS}"
#: Python's white space, as members of a class in a pattern.
_SPACES = "".join(f"\\x{{{ord(c):x}}}" for c in PYTHON_SPACE)


def candidates(text: Column) -> Column:
    """Texts that may be calls: fenced or bare braces, trailing commas removed.

    As the shortest match ends at the first closing brace, an unfenced object that
    holds another one is cut short; ``balanced_candidates`` finds it whole.
    """
    found = F.regexp_extract_all(text, F.lit(CALL_TEXT), F.lit(0))
    return F.transform(
        found,
        lambda c: F.regexp_replace(F.regexp_extract(c, r"(?s)\{.*\}", 0), TRAILING_COMMA, "$1"),
    )


def balanced_candidates(text: Column) -> Column:
    """Texts that may be calls: each outermost pair of braces.

    Quoted strings are skipped inside braces, and trailing commas are removed outside
    strings only. One fold over the text's braces, quotes, backslashes and line ends
    matches each brace with its partner. A string ends on its line: a quote without a
    partner there opens none. So, from a quote on, braces count as if it opened none, and
    at its partner the fold goes back to what was known at the quote.
    """
    # Texts without a brace hold no call and are not read.
    body = F.substr(text, F.instr(text, "{"))
    pairs = F.aggregate(_atoms(body, BRACE_ATOM), _cast(SCAN), _matched, lambda state: state["pairs"])
    found = F.transform(
        pairs, lambda p: without_trailing_commas(F.substr(body, p["start"] + 1, p["stop"] - p["start"]))
    )
    return F.when(F.contains(text, F.lit("{")), found).when(text.isNotNull(), F.array().cast("array<string>"))


def _atoms(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _cast(kind: str) -> Column:
    """The empty state of a fold: zeros, empty texts and empty arrays."""
    fields = [field.split(" ") for field in kind.split("; ")]
    empty = {"int": F.lit(0), "string": F.lit("")}
    return F.struct(*[empty.get(of, F.array()).cast(of).alias(name) for name, of in fields])


def _matched(state: Column, atom: Column) -> Column:
    """One step of the fold: open braces and closed outermost pairs, and both as they were before a string.

    ``mode`` says whether the next character stands outside strings (0), in one (1), or
    after a backslash in one (2). An atom is a run of plain text and the sign that ends
    it, or a whole string without signs, which counts by its two quotes.
    """
    opened, pairs = state["opened"], state["pairs"]
    sign = F.right(atom, F.lit(1))
    quote = sign == '"'
    string = quote & F.rlike(atom, F.lit('"[^"]*"\\z'))
    # What follows a backslash is the run, if there is one.
    mode = F.when((state["mode"] == 2) & ~F.rlike(atom, F.lit(r'\A[{}"\\\n]')), 1).otherwise(state["mode"])
    inside = F.size(opened) > 0
    start = F.get(opened, F.size(opened) - 1)
    end = state["at"] + F.length(atom)
    closes = (sign == "}") & inside
    pair = F.array(F.struct(start.alias("start"), end.alias("stop")))
    next_opened = (
        F.when(sign == "{", F.concat(opened, F.array(end - 1)))
        .when(closes, F.slice(opened, F.lit(1), F.size(opened) - 1))
        .otherwise(opened)
    )
    next_pairs = F.when(closes, F.concat(F.filter(pairs, lambda p: p["start"] < start), pair)).otherwise(pairs)
    begins = (mode == 0) & quote & ~string & inside
    ends = ((mode == 1) & quote) | ((mode == 2) & string)
    next_mode = (
        F.when(mode == 0, F.when(begins, 1).otherwise(0))
        .when(sign == "\n", 0)
        .when(mode == 2, F.when(string, 0).otherwise(1))
        .when(quote, F.when(string, 1).otherwise(0))
        .when(sign == "\\", 2)
        .otherwise(1)
    )
    return F.struct(
        end.alias("at"),
        next_mode.alias("mode"),
        F.when(ends, state["opened_before"]).otherwise(next_opened).alias("opened"),
        F.when(ends, state["pairs_before"]).otherwise(next_pairs).alias("pairs"),
        F.when(begins, opened).otherwise(state["opened_before"]).alias("opened_before"),
        F.when(begins, pairs).otherwise(state["pairs_before"]).alias("pairs_before"),
    )


def _string_mode(mode: Column, atom: Column) -> Column:
    """Whether the next character stands outside strings (0), in one (1), or after a backslash in one (2)."""
    return (
        F.when(mode == 0, F.when(atom == '"', 1).otherwise(0))
        .when(atom == "\n", 0)
        .when(mode == 2, 1)
        .when(atom == '"', 0)
        .when(atom == "\\", 2)
        .otherwise(1)
    )


def without_trailing_commas(value: Column) -> Column:
    """JSON text without commas before a closing bracket, but for those in strings."""
    comma = f",[{_SPACES}]*([}}\\]])"

    def clean(plain: Column) -> Column:
        return F.regexp_replace(plain, comma, "$1")

    def step(state: Column, atom: Column) -> Column:
        mode, plain, quoted = state["mode"], state["plain"], state["quoted"]
        outside = (mode == 0) & (atom != '"')
        failed = (mode > 0) & (atom == "\n")
        ends = (mode == 1) & (atom == '"')
        return F.struct(
            _string_mode(mode, atom).alias("mode"),
            F.when(ends, F.concat(state["done"], clean(plain), quoted, atom)).otherwise(state["done"]).alias("done"),
            F.when(outside, F.concat(plain, atom))
            .when(failed, F.concat(plain, quoted, atom))
            .when(ends, F.lit(""))
            .otherwise(plain)
            .alias("plain"),
            F.when(outside | failed | ends, F.lit("")).otherwise(F.concat(quoted, atom)).alias("quoted"),
        )

    folded = F.aggregate(
        _atoms(value, QUOTE_ATOM),
        _cast("mode int; done string; plain string; quoted string"),
        step,
        lambda state: F.concat(state["done"], clean(F.concat(state["plain"], state["quoted"]))),
    )
    # Hardly any text has such a comma.
    return F.when(F.rlike(value, F.lit(comma)), folded).otherwise(value)


def parsed(candidate: Column) -> Column:
    """The candidate read as a call: ``call.name``, ``call.arguments`` as JSON text, ``end``.

    One reading per candidate, as part of an object whose ``end`` comes out only if
    the candidate's text is read to its end; see ``is_call``. As in Python, the last
    of repeated keys counts and ``NaN`` is a value.
    """
    return F.from_json(_whole(candidate), CALL_SCHEMA, {"allowSingleQuotes": "false"})


def _whole(candidate: Column) -> Column:
    return F.concat(F.lit('{"call":'), candidate, F.lit(f',"end":"{END_MARK}"}}'))


def is_call(value: Column, candidate: Column) -> Column:
    """Whether a candidate, and what it was parsed to, is one JSON object.

    A candidate that holds several values would bring keys of its own into the object
    around it; so the keys there must be the two that were put in.
    """
    keys = F.json_object_keys(_whole(candidate)) == F.array(F.lit("call"), F.lit("end"))
    return F.coalesce((value["end"] == END_MARK) & keys, F.lit(False))


def canonical_json(text: Column) -> Column:
    """JSON text with sorted keys and no blanks; null where it is not JSON."""
    return F.try_parse_json(text).cast("string")


def args_hash(text: Column) -> Column:
    """First 16 hex digits of SHA-256 over the canonical JSON text."""
    return F.substring(F.sha2(canonical_json(text), 256), 1, 16)


def argument_map(arguments: Column) -> Column:
    """Arguments by name, as text; nested values stay JSON text."""
    return F.from_json(arguments, "map<string,string>")
