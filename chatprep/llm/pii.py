"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, digits, plus signs before a
digit, schemes and identifier cues. Small deterministic parsers then expand each anchor
to the boundaries of an email address, a network address, a card, phone or account
number, and validate it. Text without anchors is never looked at again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatprep.llm.common import span_list

#: Kinds, in the order that breaks ties; the first four are the base kinds.
KINDS = ["email", "ip", "card", "phone", "address", "account"]
BASE_KINDS = KINDS[:4]

#: Fixed value: words that announce an identifier, in lower case.
CUES = ["iban", "account", "acct", "ssn", "social security", "passport"]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*\Z")
_LOGIN = re.compile(r"[^\s/?#@]+@[^\s/?#@]+")
_AFTER_CUE = re.compile(r"(?: ?(?:no|nr|number|num)\b)?[.:# \t=]{0,4}", re.IGNORECASE)
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Z0-9])")
_SSN = re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9])")
_ACCOUNT = re.compile(r"[0-9](?:[ -]?[0-9]){5,16}(?![0-9])")
_PASSPORT = re.compile(r"[A-Z]{0,2}[0-9]{6,9}(?![0-9A-Za-z])")


@lru_cache(1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    found.add_word("@", ("at", 1))
    for digit in "0123456789":
        found.add_word(digit, ("digit", 1))
        found.add_word("+" + digit, ("plus", 2))
    found.add_word("://", ("scheme", 3))
    for cue in CUES:
        for form in {cue, cue.upper(), cue.capitalize(), cue.title()}:
            found.add_word(form, (cue, len(form)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    """Whether the check digit at the end fits."""
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) << (place & 1)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def iban_fits(text: str) -> bool:
    """Whether the remainder by 97 is one, letters counting from ten."""
    plain = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _account(text: str, cue: str, at: int) -> tuple[int, int] | None:
    at = _AFTER_CUE.match(text, at).end()
    if cue == "iban":
        # A shorter reading may be the valid one: what follows can look like more of it.
        found = _IBAN.match(text, at)
        while found and not iban_fits(found[0]):
            cut = found[0].rfind(" ")
            found = _IBAN.fullmatch(text, at, at + cut) if cut > 0 else None
    else:
        kind = {"ssn": _SSN, "social security": _SSN, "passport": _PASSPORT}.get(cue, _ACCOUNT)
        found = kind.match(text, at)
    return found.span() if found else None


def personal_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all findings, in code points; spans of one kind never overlap.

    Within a kind the leftmost comes first and its text is used up, also where it then
    fails validation.
    """
    spans: list[tuple[str, int, int]] = []
    email_end = ip_end = card_end = phone_end = run_end = address_end = account_end = 0
    for last, (anchor, size) in _automaton().iter(text):
        at = last + 1 - size
        if anchor == "digit":
            # Numbers are read once for each run of digits.
            if at < run_end:
                continue
            run_end = at + 1
            while run_end < len(text) and "0" <= text[run_end] <= "9":
                run_end += 1
            if at >= ip_end and (found := _IP.match(text, at)):
                ip_end = found.end()
                # A part may begin with any number of zeros, more than a number is read from.
                parts = [part.lstrip("0") for part in found[0].split(".")]
                if all(len(part) <= 3 and int(part or 0) <= 255 for part in parts):
                    spans.append(("ip", at, ip_end))
            if at >= card_end and (found := _CARD.match(text, at)):
                card_end = found.end()
                digits = _digits(found[0])
                if 12 <= len(digits) <= 19 and luhn(digits):
                    spans.append(("card", at, card_end))
        elif anchor == "at":
            start = at
            while start > email_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (found := _DOMAIN.match(text, at + 1)):
                email_end = found.end()
                spans.append(("email", start, email_end))
        elif anchor == "plus":
            if at >= phone_end and (found := _PHONE.match(text, at)):
                phone_end = found.end()
                if 9 <= len(_digits(found[0])) <= 15:
                    spans.append(("phone", at, phone_end))
        elif anchor == "scheme":
            # Only an address that names who logs in is personal.
            if found := _LOGIN.match(text, at + 3):
                scheme = _SCHEME.search(text, max(address_end, at - 32), at)
                if scheme:
                    address_end = found.end()
                    spans.append(("address", scheme.start(), address_end))
        elif at >= account_end and not (at and text[at - 1].isalnum()):
            if found := _account(text, anchor, at + size):
                account_end = found[1]
                spans.append(("account", *found))
    order = {kind: k for k, kind in enumerate(KINDS)}
    return sorted(spans, key=lambda s: (s[1], order[s[0]], s[2]))


SPANS = "array<struct<kind:string,start:long,end:long>>"
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each run of overlapping spans replaced by the name of its first kind."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out.append(text[at:start])
            out.append(f"<{kind.upper()}>")
        at = max(at, end)
    out.append(text[at:])
    return "".join(out)


def find_personal(df: DataFrame, text_col: str) -> DataFrame:
    """All columns of the input, in place, with ``_pii``: a struct of ``spans`` and ``masked``.

    ``spans`` are (kind, start, end) by start and kind, in code points. ``masked`` is
    the text without them, equal to the text where there are none. Null has no spans
    and stays null. Repeated rows are read one by one; an empty table gives an empty
    result. Whole texts are read, whatever their length, one Arrow batch at a time.
    """
    columns = df.columns
    text_at = columns.index(text_col)
    schema = ", ".join(
        [f"c{k} {field.dataType.simpleString()}" for k, field in enumerate(df.schema)]
        + [f"spans {SPANS}", "masked string"]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            found = [personal_spans(text) if text else [] for text in texts]
            clean = [masked(text, spans) if spans else text for text, spans in zip(texts, found, strict=True)]
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in each] for each in found]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(spans, _ARROW_SPANS), pa.array(clean, pa.string())],
                [*(f"c{k}" for k in range(len(columns))), "spans", "masked"],
            )

    # Column names may repeat or clash; inside, columns go by their place.
    out = df.toDF(*[f"c{k}" for k in range(len(columns))]).mapInArrow(run, schema)
    return out.select(
        *[F.col(f"c{k}").alias(name) for k, name in enumerate(columns)],
        F.struct("spans", "masked").alias("_pii"),
    )


def n_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def spans_digest(spans: Column, base_kinds: list[str], kinds: list[str]) -> list[Column]:
    """Counts of the base kinds, the hash over the base spans, and all spans as one text."""
    base = F.filter(spans, lambda s: s["kind"].isin(base_kinds))
    return [
        *[n_of(spans, kind).alias(f"n_{kind}") for kind in base_kinds],
        F.sha2(span_list(base, kinds), 256).alias("base_sha256"),
        span_list(spans, kinds).alias("spans"),
    ]
