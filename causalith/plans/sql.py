"""Operators in SQL text: each call becomes a view of its result, and Spark runs the rest.

    SELECT estimate FROM do_ate('customers', treatment := 'discount', outcome := 'revenue', covariates := ['age'])

Arguments are literals: strings, numbers, booleans, lists, structs; ``:=`` and ``=>`` both name them. ``CALL f(...)`` means
``SELECT * FROM f(...)``. Calls inside a relation text are replaced first, when that text is a query.
"""

from __future__ import annotations

import re
import uuid

from ..errors import CausalError

_TOKEN = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|--[^\n]*|/\*.*?\*/|:=|=>|[A-Za-z_]\w*|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|\s+|.", re.S)


def _tokens(text: str) -> list[str]:
    return _TOKEN.findall(text)


class _Reader:
    def __init__(self, tokens: list[str], at: int):
        self.t = [(i, x) for i, x in enumerate(tokens) if not x.isspace() and not x.startswith(("--", "/*"))]
        self.k = next(k for k, (i, _) in enumerate(self.t) if i >= at)

    def peek(self, ahead: int = 0) -> str:
        return self.t[self.k + ahead][1] if self.k + ahead < len(self.t) else ""

    def take(self, want: str | None = None) -> str:
        x = self.peek()
        if want is not None and x != want:
            raise CausalError(f'expected "{want}" but found "{x}"')
        self.k += 1
        return x

    def value(self):
        x = self.take()
        low = x.lower()
        if x.startswith("'"):
            return x[1:-1].replace("''", "'")
        if x in "+-" and self.peek()[:1].isdigit():
            n = self.value()
            return -n if x == "-" else n
        if x[:1].isdigit():
            return float(x) if re.search(r"[.eE]", x) else int(x)
        if low in ("true", "false", "null"):
            return {"true": True, "false": False, "null": None}[low]
        if x == "[" or (low == "array" and self.peek() in "(["):
            close = "]" if x == "[" else {"(": ")", "[": "]"}[self.take()]
            return self._until(close)
        if x == "{":
            out = {}
            while self.peek() != "}":
                key = self.take().strip("'\"")
                self.take(":")
                out[key] = self.value()
                if self.peek() == ",":
                    self.take()
            self.take("}")
            return out
        if low in ("named_struct", "map") and self.peek() == "(":
            self.take("(")
            flat = self._until(")")
            return dict(zip(flat[::2], flat[1::2], strict=True))
        raise CausalError(f'an argument must be a literal, not "{x}"')

    def _until(self, close: str) -> list:
        out = []
        while self.peek() != close:
            out.append(self.value())
            if self.peek() == ",":
                self.take()
        self.take(close)
        return out

    def arguments(self) -> tuple[list, dict]:
        self.take("(")
        given, named = [], {}
        while self.peek() != ")":
            if self.peek(1) in (":=", "=>"):
                name = self.take().lower()
                self.take()
                named[name] = self.value()
            else:
                given.append(self.value())
            if self.peek() == ",":
                self.take()
        self.take(")")
        return given, named


def rewrite(engine, text: str) -> str:
    """The text with every operator call replaced by a temporary view of its result."""
    from ..engine import OPERATORS

    tokens = _tokens(text)
    out, at = [], 0
    while at < len(tokens):
        name = tokens[at].lower()
        nxt = next((x for x in tokens[at + 1 :] if not x.isspace()), "")
        if name in OPERATORS and nxt == "(":
            reader = _Reader(tokens, at + 1)
            given, named = reader.arguments()
            if given and isinstance(given[0], str) and re.search(r"\bdo_\w+\s*\(", given[0]):
                given[0] = rewrite(engine, given[0])
            view = f"causalith_{uuid.uuid4().hex}"
            OPERATORS[name](engine, *given, **named).createOrReplaceTempView(view)
            if "".join(out).rstrip().lower().endswith("call"):
                joined = "".join(out).rstrip()
                out = [joined[: -len("call")], "select * from "]
            out.append(view)
            at = reader.t[reader.k - 1][0] + 1
            continue
        out.append(tokens[at])
        at += 1
    return "".join(out)


def run(engine, text: str):
    if re.search(r"\bdo_dseparated\s*\(", text):
        from ..operators.graph import register_dseparated

        register_dseparated(engine)
    return engine.spark.sql(rewrite(engine, text))
