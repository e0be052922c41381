"""What the parsers share: tokens as one string of kind characters, expressions by
precedence climbing, statements by recursive descent with panic-mode recovery.

A file becomes a string with one character per token, its *shape*. Whether a
statement is valid depends on its shape alone, so a shape that was parsed once
is remembered per grammar context and skipped at the next sight. Only shapes are
remembered, the memory is bounded, and dropping it changes no result.
"""

from __future__ import annotations

import re

MEMO = 200_000
#: Tokens of the longest shape that is remembered.
LONGEST = 300


class Bad(Exception):
    def __init__(self, at: int, why: str):
        super().__init__(why)
        self.at, self.why = at, why


class Lexer(dict):
    """Maps token text to kind characters; comments map to nothing."""

    def __init__(self, pattern: str, keywords: str, operators: str, number: str, ident: str = r"[^\W\d]\w*", newline: bool = False):
        super().__init__()
        ops = operators.split()
        self.names: dict[str, str] = {}
        self.code: dict[str, str] = {}
        for name in ["ID", "NUM", "STR", "CHR", "BAD", "NL", "PP", "EOF", *keywords.split(), *(o for o in ops if len(o) > 1)]:
            c = chr(0xE000 + len(self.names))
            self.names[c], self.code[name] = name, c
        for o in ops:
            if len(o) == 1:
                self.names[o], self.code[o] = o, o
        longest = sorted((o for o in ops if len(o) > 1), key=len, reverse=True)
        self.pattern = re.compile(r"[ \t\r\f\v%s﻿]*(%s|%s|%s|.)" % ("" if newline else r"\n", pattern, ident, "|".join(map(re.escape, longest))), re.S)
        self.number, self.ident = re.compile(number), re.compile(ident)
        self.keywords, self.newline = set(keywords.split()), newline

    def __missing__(self, token: str) -> str:
        kind = self.kind(token)
        if len(self) > MEMO:
            self.clear()
        self[token] = kind
        return kind

    def kind(self, t: str) -> str:
        c, head = self.code, t[0]
        if t in c and (t in self.keywords or not self.ident.match(t)):
            return c[t]
        if t.isspace():
            return c["NL"] if self.newline and "\n" in t else ""
        if t.startswith(("//", "/*")):
            return (c["NL"] if self.newline and "\n" in t else "") if t[1] == "/" or len(t) > 3 and t.endswith("*/") else c["BAD"]
        if head.isdigit() or head == "." and len(t) > 1:
            return c["NUM"] if self.number.fullmatch(t) else c["BAD"]
        if len(t) > 1 and head in "\"'`":
            return c["CHR" if head == "'" else "STR"]
        if self.ident.fullmatch(t):
            return c["ID"]
        return c["BAD"]

    def shape(self, text: str) -> str:
        return "".join(map(self.__getitem__, self.pattern.findall(text)))

    def offsets(self, text: str) -> list[int]:
        """Where each character of the shape stands in the text (slow; for reports)."""
        return [m.start(1) for m in self.pattern.finditer(text) for _ in self[m.group(1)]]


class Parser:
    """Recursive descent over a shape. Subclasses give LEX, PREC and the grammar."""

    LEX: Lexer
    PREC: dict[str, int] = {}
    ASSIGN: frozenset[str] = frozenset()
    SYNC = frozenset((";", "{", "}", "EOF"))

    def __init_subclass__(cls):
        cls.done: dict[object, set[str]] = {}
        cls.heads: dict[object, dict[str, str]] = {}
        c = cls.LEX.code
        cls.ends = re.compile("[;{}%s]" % c["EOF"])
        cls.brackets = re.compile("[%s%s]" % (c["("], c[")"]))
        cls.plain_items = re.compile("(?:-?[%s%s],)+" % (c["NUM"], c["STR"]))

    def __init__(self, shape: str):
        c = self.LEX.code["EOF"]
        self.k = shape + c * 3
        names = self.LEX.names
        self.t = [names[x] for x in self.k]
        self.p, self.ctx = 0, ""
        self.pairs: dict[int, int] | None = None
        self.errors: list[tuple[int, str]] = []

    # tokens
    def eat(self, what: str) -> bool:
        if self.t[self.p] == what:
            self.p += 1
            return True
        return False

    def need(self, what: str) -> None:
        if self.t[self.p] != what:
            self.fail(f"expected '{what}'")
        self.p += 1

    def fail(self, why: str):
        now = self.t[self.p]
        if now == "EOF":
            raise Bad(self.p, f"{why}, file ends")
        if now == "BAD":
            raise Bad(self.p, "unterminated text or unknown character")
        raise Bad(self.p, f"{why}, found '{now}'")

    def closing(self, at: int) -> int:
        """Where the bracket '(' at a position is closed; -1 if it isn't. Near ones are looked for, far ones noted in one pass."""
        t, p, depth = self.t, at, 1
        while depth and p < at + 64:
            p += 1
            if t[p] == "EOF":
                return -1
            depth += (t[p] == "(") - (t[p] == ")")
        if not depth:
            return p
        if self.pairs is None:
            self.pairs, stack = {}, []
            for m in self.brackets.finditer(self.k):
                if m.group() == "(":
                    stack.append(m.start())
                elif stack:
                    self.pairs[stack.pop()] = m.start()
        return self.pairs.get(at, -1)

    def attempt(self, f) -> bool:
        """Runs ``f``; on a failure goes back and says no."""
        at = self.p
        try:
            f()
            return True
        except Bad:
            self.p = at
            return False

    # expressions: 'l' can be assigned to, 'r' can't
    def binary(self, least: int = 1) -> str:
        kind = self.unary()
        prec, t = self.PREC, self.t
        while (own := prec.get(t[self.p], 0)) >= least:
            self.p += 1
            self.binary(own + 1)
            kind = "r"
        return kind

    def assignment(self) -> str:
        kind = self.binary()
        if self.t[self.p] == "?":
            self.p += 1
            self.expression()
            self.need(":")
            self.assignment()
            return "r"
        if self.t[self.p] in self.ASSIGN:
            if kind != "l":
                self.fail("assignment to something that can't be assigned")
            self.p += 1
            self.assignment()
            return "r"
        return kind

    def expression(self) -> str:
        kind = self.assignment()
        while self.eat(","):
            self.assignment()
            kind = "r"
        return kind

    def arguments(self) -> None:
        """After '(': up to and with ')'."""
        if not self.eat(")"):
            self.argument()
            while self.eat(","):
                self.argument()
            self.need(")")

    def argument(self) -> None:
        self.assignment()

    def skip_plain(self) -> None:
        if m := self.plain_items.match(self.k, self.p):
            self.p = m.end()

    # statements
    def remembered(self) -> bool:
        """Passes a statement, or the head of one and then its body, whose shape is known."""
        i, k = self.p, self.k
        j = self.ends.search(k, i, i + LONGEST)
        if j is None:
            return False
        j = j.start()
        key = k[i:j + 1]
        if k[j] == ";" and self.t[j + 1] != "else" and key in self.done.setdefault(self.ctx, set()):
            self.p = j + 1
            return True
        if self.t[i] == "for" and (j := k.find("{", i, i + LONGEST)) > 0:
            key = k[i:j + 1]
        kind = self.heads.setdefault(self.ctx, {}).get(key)
        if kind:
            self.p = j
            self.body(kind)
            return True
        return False

    def note(self, i: int) -> None:
        """The statement from i up to here was valid; kept if it has no braces."""
        if self.p - i >= LONGEST:
            return
        key = self.k[i:self.p]
        if key[-1:] == ";" and "{" not in key and "}" not in key and key.find(";") == len(key) - 1:
            known = self.done.setdefault(self.ctx, set())
            if len(known) > MEMO:
                known.clear()
            known.add(key)

    def head(self, i: int, kind: str) -> None:
        """At '{': the tokens from i up to here lead in a body of this kind."""
        if self.p - i >= LONGEST:
            return
        key = self.k[i:self.p + 1]
        if key.find("{") == len(key) - 1 and "}" not in key:
            known = self.heads.setdefault(self.ctx, {})
            if len(known) > MEMO:
                known.clear()
            known[key] = kind

    def body(self, kind: str) -> None:
        raise NotImplementedError

    def statement(self) -> None:
        raise NotImplementedError

    def guarded(self, what=None) -> None:
        """One statement; an error is kept and parsing goes on behind it."""
        i = self.p
        ctx = self.ctx
        try:
            if what is None:
                if self.remembered():
                    return
                known = len(self.errors)
                self.statement()
                if len(self.errors) == known:
                    self.note(i)
            else:
                what()
        except Bad as e:
            self.errors.append((e.at, e.why))
            self.ctx = ctx
            self.p = max(e.at, i)
            while self.t[self.p] not in self.SYNC:
                self.p += 1
            if self.t[self.p] in (";", "{") or self.p == i and self.t[i] != "EOF":
                self.p += 1

    def block(self) -> None:
        self.need("{")
        while self.t[self.p] not in ("}", "EOF"):
            self.guarded()
        self.need("}")

    def inside(self, ctx: str, f) -> None:
        kept, self.ctx = self.ctx, ctx
        f()
        self.ctx = kept

    def file(self) -> None:
        raise NotImplementedError

    def run(self) -> list[tuple[int, str]]:
        try:
            self.file()
        except Bad as e:
            self.errors.append((e.at, e.why))
        return sorted(self.errors)
