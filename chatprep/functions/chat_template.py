"""Chat templates of tokenizer files as column expressions.

A template is read once, on the driver, and becomes one expression over the messages
array: a loop over messages is a ``transform``, a condition a ``when``, so rows are
rendered by Spark without Python. The part of the template language that chat templates
use is read; anything else is an error that names it.

White space is handled as tokenizers set it up: a line break after a block tag goes, so do
blanks before one at the start of a line, and a minus sign strips its side.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


class TemplateError(ValueError):
    """What a template holds that can't be rendered."""


@dataclass(frozen=True)
class Value:
    """An expression and what it is: text, bool, int, none, messages, message or loop."""

    kind: str
    column: Column | None = None
    #: Fields of messages or of a loop, or which constant it is.
    known: object = None


_TAG = re.compile(r"\{%-?.*?-?%\}|\{\{-?.*?-?\}\}|\{#.*?#\}", re.DOTALL)
_TOKEN = re.compile(
    r"""\s*(?:(?P<text>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|<=|>=|[-+~%|.,()\[\]:<>=]))""",
    re.DOTALL,
)
_CONSTANTS = {"true": True, "True": True, "false": False, "False": False}


def _pieces(template: str) -> list[tuple[str, str]]:
    """(kind, text) of a template's parts: text, out or block, with white space as it is left."""
    pieces: list[tuple[str, str]] = []
    at, strip_next, block_before = 0, False, False
    for tag in [*_TAG.finditer(template), None]:
        text = template[at : tag.start()] if tag else template[at:]
        if strip_next:
            text = text.lstrip()
        elif block_before and text.startswith("\n"):
            text = text[1:]
        if tag:
            kind = {"{%": "block", "{{": "out", "{#": "note"}[tag[0][:2]]
            inside = tag[0][2:-2]
            if inside.startswith("-"):
                text = text.rstrip()
            elif kind != "out":
                # Blanks alone on the line before the tag.
                text = re.sub(r"(^|\n)[ \t]*\Z", r"\1", text) if at == 0 or "\n" in text else text
            if text:
                pieces.append(("text", text))
            strip_next, block_before = inside.endswith("-") and kind != "note", kind != "out"
            if kind != "note":
                pieces.append((kind, inside.strip("-").strip()))
            at = tag.end()
        elif text:
            pieces.append(("text", text))
    return pieces


class _Expression:
    """Reads one expression in an environment of names."""

    def __init__(self, source: str, names: dict[str, Value]) -> None:
        self.source, self.names, self.at = source, names, 0
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while source[at:].strip():
            found = _TOKEN.match(source, at)
            if not found:
                raise TemplateError(f"not a part of an expression: {source[at:].strip()[:40]!r}")
            self.tokens.append((found.lastgroup, found[found.lastgroup]))
            at = found.end()

    def whole(self) -> Value:
        value = self._either()
        if self.at < len(self.tokens):
            raise TemplateError(f"can't read {self.tokens[self.at][1]!r} in {self.source!r}")
        return value

    def _next(self, *wanted: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][1] in wanted and self.tokens[self.at][0] != "text":
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def _need(self, sign: str) -> None:
        if not self._next(sign):
            raise TemplateError(f"{sign!r} is missing in {self.source!r}")

    def _either(self) -> Value:
        left = self._both()
        while self._next("or"):
            left = Value("bool", truth(left) | truth(self._both()))
        return left

    def _both(self) -> Value:
        left = self._negated()
        while self._next("and"):
            left = Value("bool", truth(left) & truth(self._negated()))
        return left

    def _negated(self) -> Value:
        return Value("bool", ~truth(self._negated())) if self._next("not") else self._compared()

    def _compared(self) -> Value:
        left = self._joined()
        while sign := self._next("==", "!=", "<", ">", "<=", ">=", "is", "in", "not"):
            if sign == "is":
                left = self._tested(left)
                continue
            if sign == "not":
                self._need("in")
            right = self._joined()
            if sign in ("in", "not"):
                if left.kind != "text" or right.kind != "text":
                    raise TemplateError(f"'in' is read between texts only: {self.source!r}")
                found = F.contains(right.column, left.column)
                left = Value("bool", ~found if sign == "not" else found)
                continue
            if left.kind != right.kind:
                # Python finds nothing equal across types.
                if sign not in ("==", "!="):
                    raise TemplateError(f"{left.kind} and {right.kind} have no order: {self.source!r}")
                left = Value("bool", F.lit(sign == "!="))
                continue
            a, b = left.column, right.column
            by_sign = {"==": a.eqNullSafe(b), "!=": ~a.eqNullSafe(b), "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}
            left = Value("bool", by_sign[sign])
        return left

    def _tested(self, value: Value) -> Value:
        negated = bool(self._next("not"))
        test = self._next("defined", "none", "string")
        if not test:
            raise TemplateError(f"a test that is not known in {self.source!r}")
        if test == "defined":
            holds = F.lit(value.kind != "undefined")
        elif test == "none":
            holds = F.lit(True) if value.kind == "none" else F.lit(False) if value.column is None else value.column.isNull()
        else:
            holds = value.column.isNotNull() if value.kind == "text" else F.lit(False)
        return Value("bool", ~holds if negated else holds)

    def _joined(self) -> Value:
        left = self._filtered()
        while sign := self._next("+", "~", "%", "-"):
            right = self._filtered()
            if sign == "~" or (sign == "+" and left.kind == right.kind == "text"):
                left = Value("text", F.concat(shown(left), shown(right)))
            elif left.kind == right.kind == "int":
                a, b = left.column, right.column
                left = Value("int", {"+": a + b, "-": a - b, "%": F.pmod(a, b)}[sign])
            else:
                raise TemplateError(f"{left.kind} {sign} {right.kind} in {self.source!r}")
        return left

    def _filtered(self) -> Value:
        value = self._postfix()
        while self._next("|"):
            name = self._name()
            value = self._applied(value, name)
        return value

    def _applied(self, value: Value, name: str) -> Value:
        if name == "length" and value.kind == "messages":
            return Value("int", F.size(value.column))
        if name == "length" and value.kind == "text":
            return Value("int", F.char_length(value.column))
        texts: dict[str, Callable[[Column], Column]] = {
            "trim": _trimmed, "strip": _trimmed, "upper": F.upper, "lower": F.lower,
            "title": F.initcap, "capitalize": lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2)))),
        }
        if name not in texts or value.kind != "text":
            raise TemplateError(f"filter {name!r} over {value.kind} in {self.source!r}")
        return Value("text", texts[name](value.column))

    def _name(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "name":
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise TemplateError(f"a name is missing in {self.source!r}")

    def _postfix(self) -> Value:
        value = self._primary()
        while sign := self._next("[", "."):
            if sign == ".":
                name = self._name()
                if self._next("("):
                    self._need(")")
                    value = self._applied(value, name)
                else:
                    value = self._field(value, name)
                continue
            if self.tokens[self.at][0] == "text":
                value = self._field(value, ast.literal_eval(self.tokens[self.at][1]))
                self.at += 1
            else:
                value = self._item(value)
            self._need("]")
        return value

    def _field(self, value: Value, name: str) -> Value:
        if value.kind == "message":
            if name not in value.known:
                return Value("undefined")
            return Value("text", value.column[name])
        if value.kind == "loop" and name in value.known:
            return value.known[name]
        raise TemplateError(f"no {name!r} of {value.kind} in {self.source!r}")

    def _item(self, value: Value) -> Value:
        if value.kind != "messages":
            raise TemplateError(f"{value.kind} has no items in {self.source!r}")
        start = self._whole_number()
        if self._next(":"):
            first = start or 0
            if first < 0 or not (self.at < len(self.tokens) and self.tokens[self.at][1] == "]"):
                raise TemplateError(f"only a slice that leaves out the first ones is read: {self.source!r}")
            rest = F.greatest(F.size(value.column) - first, F.lit(0))
            return replace(value, column=F.slice(value.column, F.lit(first + 1), rest))
        if start is None:
            raise TemplateError(f"an item's number is missing in {self.source!r}")
        place = F.lit(start + 1 if start >= 0 else start)
        return Value("message", F.try_element_at(value.column, place), value.known)

    def _whole_number(self) -> int | None:
        sign = -1 if self._next("-") else 1
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "int":
            self.at += 1
            return sign * int(self.tokens[self.at - 1][1])
        return None

    def _primary(self) -> Value:
        if self._next("("):
            value = self._either()
            self._need(")")
            return value
        if self.at >= len(self.tokens):
            raise TemplateError(f"an expression ends early: {self.source!r}")
        kind, token = self.tokens[self.at]
        self.at += 1
        if kind == "text":
            return Value("text", F.lit(ast.literal_eval(token.replace("\n", "\\n"))))
        if kind == "int":
            return Value("int", F.lit(int(token)))
        if kind != "name":
            raise TemplateError(f"can't read {token!r} in {self.source!r}")
        if token in _CONSTANTS:
            return Value("bool", F.lit(_CONSTANTS[token]), _CONSTANTS[token])
        if token in ("none", "None"):
            return Value("none", F.lit(None).cast("string"))
        if token == "raise_exception" and self._next("("):
            reason = self._either()
            self._need(")")
            return Value("text", F.raise_error(shown(reason)).cast("string"))
        if self.at < len(self.tokens) and self.tokens[self.at] == ("sign", "("):
            raise TemplateError(f"function {token!r} in {self.source!r}")
        return self.names.get(token, Value("undefined"))


def _trimmed(text: Column) -> Column:
    from chatprep.functions.text import clean_text

    return clean_text(text)


def truth(value: Value) -> Column:
    """Whether a value counts as true."""
    if value.kind in ("undefined", "none"):
        return F.lit(False)
    if value.kind == "loop":
        return F.lit(True)
    holds = {
        "bool": lambda c: c,
        "text": lambda c: c != "",
        "int": lambda c: c != 0,
        "messages": lambda c: F.size(c) > 0,
        "message": lambda c: c.isNotNull(),
    }[value.kind](value.column)
    return F.coalesce(holds, F.lit(False))


def shown(value: Value) -> Column:
    """A value as text; what is not defined is empty, a null is ``None``."""
    if value.kind == "undefined":
        return F.lit("")
    if value.kind == "bool":
        return F.when(value.column, "True").otherwise("False")
    if value.kind in ("text", "int", "none"):
        return F.coalesce(value.column.cast("string"), F.lit("None"))
    raise TemplateError(f"{value.kind} can't be shown")


class _Compiler:
    def __init__(self, template: str) -> None:
        self.pieces, self.at = _pieces(template), 0

    def whole(self, names: dict[str, Value]) -> Column:
        text = self._body(names, ())
        if self.at < len(self.pieces):
            raise TemplateError(f"a block that was not opened: {self.pieces[self.at][1]!r}")
        return text

    def _body(self, names: dict[str, Value], until: tuple[str, ...]) -> Column:
        """Text up to a block that ends this one, which is not passed; ``names`` is changed by ``set``."""
        parts = [F.lit("")]
        while self.at < len(self.pieces):
            kind, text = self.pieces[self.at]
            if kind == "block" and text.split(maxsplit=1)[:1] and text.split(maxsplit=1)[0] in until:
                break
            if kind == "block" and re.match(r"(end\w+|else|elif)\b", text):
                break
            self.at += 1
            if kind == "text":
                parts.append(F.lit(text))
            elif kind == "out":
                parts.append(shown(_Expression(text, names).whole()))
            else:
                parts.append(self._block(text, names))
        return F.concat(*parts)

    def _block(self, text: str, names: dict[str, Value]) -> Column:
        if found := re.fullmatch(r"for\s+(\w+)\s+in\s+(.+)", text, re.DOTALL):
            return self._loop(found[1], found[2], names)
        if found := re.fullmatch(r"if\b(.+)", text, re.DOTALL):
            return self._condition(found[1], names)
        if found := re.fullmatch(r"set\s+(\w+)\s*=(.+)", text, re.DOTALL):
            names[found[1]] = _Expression(found[2], names).whole()
            return F.lit("")
        raise TemplateError(f"block {text[:60]!r}")

    def _close(self, *names: str) -> str:
        if self.at < len(self.pieces) and self.pieces[self.at][1].split(maxsplit=1)[0] in names:
            self.at += 1
            return self.pieces[self.at - 1][1]
        raise TemplateError(f"{' or '.join(names)} is missing")

    def _loop(self, name: str, over: str, names: dict[str, Value]) -> Column:
        messages = _Expression(over, names).whole()
        if messages.kind != "messages" or "loop" in names:
            raise TemplateError(f"a loop over {over!r}: only one over messages is read, and none inside it")
        start, size = self.at, F.size(messages.column)

        def once(message: Column, k: Column) -> Column:
            # The body is read for the plan as often as the expression is made.
            self.at = start
            loop = {
                "first": Value("bool", k == 0),
                "last": Value("bool", k == size - 1),
                "index": Value("int", k + 1),
                "index0": Value("int", k),
                "length": Value("int", size),
            }
            own = names | {name: Value("message", message, messages.known), "loop": Value("loop", None, loop)}
            return self._body(own, ("endfor",))

        text = F.array_join(F.transform(messages.column, once), "")
        self._close("endfor")
        return F.coalesce(text, F.lit(""))

    def _condition(self, test: str, names: dict[str, Value]) -> Column:
        branches: list[tuple[Column, Column, dict[str, Value]]] = []
        while True:
            holds = truth(_Expression(test, names).whole())
            own = dict(names)
            branches.append((holds, self._body(own, ("elif", "else", "endif")), own))
            closed = self._close("elif", "else", "endif")
            if closed.startswith("elif"):
                test = closed[4:]
                continue
            last = dict(names)
            other = F.lit("")
            if closed == "else":
                other = self._body(last, ("endif",))
                self._close("endif")
            break
        text = other
        for holds, own_text, _ in reversed(branches):
            text = F.when(holds, own_text).otherwise(text)
        # What a branch has set holds behind it where the branch was taken.
        for name in {n for *_, own in branches for n in own} | set(last):
            value = last.get(name, Value("undefined"))
            for holds, _, own in reversed(branches):
                mine = own.get(name, Value("undefined"))
                if mine is not value:
                    value = _chosen(holds, mine, value)
            names[name] = value
        return text


def _chosen(holds: Column, value: Value, other: Value) -> Value:
    if value.kind == other.kind and value.column is not None:
        return replace(value, column=F.when(holds, value.column).otherwise(other.column))
    kinds = {value.kind, other.kind}
    if kinds <= {"text", "undefined", "none"}:
        texts = [F.lit("") if v.kind == "undefined" else v.column for v in (value, other)]
        return Value("text", F.when(holds, texts[0]).otherwise(texts[1]))
    if kinds <= {"bool", "undefined", "none"}:
        flags = [truth(v) for v in (value, other)]
        return Value("bool", F.when(holds, flags[0]).otherwise(flags[1]))
    if kinds == {"text", "bool"} and all(v.kind == "text" or v.known is False for v in (value, other)):
        # No text at all, which templates write as false and only ask for its truth.
        texts = [v.column if v.kind == "text" else F.lit("") for v in (value, other)]
        return Value("text", F.when(holds, texts[0]).otherwise(texts[1]))
    raise TemplateError(f"a name is set to {value.kind} or {other.kind}")


def render_template(
    messages: Column,
    template: str,
    add_generation_prompt: bool | Column = False,
    fields: tuple[str, ...] = ("role", "content"),
    **texts: str,
) -> Column:
    """Messages as the model text that a tokenizer's chat template makes of them.

    ``messages`` is an array of structs with ``fields``; ``texts`` are names the template
    uses, such as ``bos_token``. Read are loops over messages (all, or without the first
    ones) with ``loop.first``, ``last``, ``index``, ``index0``; ``if``, ``elif``, ``else``; ``set``; outputs;
    comparisons, ``and``, ``or``, ``not``, ``in`` on texts, ``is defined``, ``is none``, ``is string``;
    ``+``, ``~``, ``-``, ``%``; ``trim``, ``upper``, ``lower``, ``title``, ``capitalize``, ``length``;
    ``raise_exception``. Another construct is a ``TemplateError`` before any row is read. A null
    array has no text; a name that is not given, or a field that messages don't have, is
    undefined. A template that asks for a conversation's first or last message needs
    whole conversations, not parts of them.
    """
    prompt = add_generation_prompt if isinstance(add_generation_prompt, Column) else F.lit(bool(add_generation_prompt))
    names = {name: Value("text", F.lit(text)) for name, text in texts.items()}
    names["messages"] = Value("messages", messages, fields)
    names["add_generation_prompt"] = Value("bool", prompt)
    return F.when(messages.isNotNull(), _Compiler(template).whole(names))
