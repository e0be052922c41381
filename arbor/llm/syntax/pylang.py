"""Python 3, one logical line at a time: a line's shape decides what it is, indentation how lines nest."""

from __future__ import annotations

import re

from .base import MEMO, Bad, Lexer, Parser

_WORDS = frozenset("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())
_PREFIX = r"(?:[rR][bBfFtT]?|[bBfFtT][rR]?|[uU])?"
#: Where a string with fields starts, and what is read of it up to a brace, its end or an error.
_FPREFIX = r"(?:[rR]?[fFtT]|[fFtT][rR])"
_FSTART = _FPREFIX + r"(?:\"\"\"|'''|\"|')"
_FIELDS = re.compile("(" + _FPREFIX + r")(\"\"\"|'''|\"|')")
_PART = {
    "'": re.compile(r"(?:[^'\\\n{}]|\\(?:N\{[^{}'\n]*\}|[^{}])|\\(?=[{}]))*"), '"': re.compile(r'(?:[^"\\\n{}]|\\(?:N\{[^{}"\n]*\}|[^{}])|\\(?=[{}]))*'),
    "'''": re.compile(r"(?:[^'\\{}]|'(?!'')|\\(?:N\{[^{}]*\}|[^{}])|\\(?=[{}]))*"), '"""': re.compile(r'(?:[^"\\{}]|"(?!"")|\\(?:N\{[^{}]*\}|[^{}])|\\(?=[{}]))*'),
}
#: To the end of a string that can't be read.
_TO_END = {q: re.compile(r"(?:[^%s\\\n]|\\[\s\S])*%s" % (q, q) if len(q) == 1 else r"[\s\S]*?" + q) for q in _PART}
_CLAUSES = {"else": ("if", "elif", "for", "while", "try", "except"), "elif": ("if", "elif"), "except": ("try", "except"), "finally": ("try", "except", "else")}


class PyLexer(Lexer):
    def kind(self, t: str) -> str:
        c, head = self.code, t[0]
        if head == "#" or head == "\\" and len(t) > 1:
            return ""
        if head == "\n":
            return c["NL"]
        if t[-1] in "\"'" and (head in "\"'" or self.string.match(t)):
            body = t.lstrip("rRbBfFuUtT")
            closed = len(body) >= 6 and body[:3] == body[-3:] in ('"""', "'''") or body[:3] not in ('"""', "'''") and len(body) > 1
            return c["STR"] if closed or body in ('""', "''") else c["BAD"]
        if head in "\"'":
            return c["BAD"]
        return super().kind(t)

    def pieces(self, text: str) -> list[tuple[str, int, str]]:
        """(token, place, kinds) of each token. A string with fields is one token, its kinds hold those of its fields."""
        out, at = [], 0
        while m := self.pattern.match(text, at):
            token, start, at = m.group(1), m.start(1), m.end()
            if _FIELDS.fullmatch(token):
                at, kinds = self.fields(text, start)
                token = text[start:at]
            else:
                kinds = self[token]
            out.append((token, start, kinds))
        return out

    def fields(self, text: str, start: int) -> tuple[int, str]:
        """The end and the kinds of the string with fields at ``start``."""
        head = _FIELDS.match(text, start)
        quote = head.group(2)
        end, kinds = self.literal(text, head.end(), quote, False)
        if end >= 0 and text.startswith(quote, end):
            return end + len(quote), self.code["STR"] + kinds
        return (m.end() if (m := _TO_END[quote].match(text, head.end())) else head.end()), self.code["BAD"]

    def literal(self, text: str, at: int, quote: str, spec: bool) -> tuple[int, str]:
        """Up to the closing quote, or to the '}' behind a format: where that stands, -1 for an error, and the fields' kinds."""
        kinds = ""
        while True:
            at = _PART[quote].match(text, at).end()
            x = text[at:at + 1]
            if not spec and text[at:at + 2] in ("{{", "}}"):
                at += 2
            elif x == "{":
                at, own = self.field(text, at + 1, quote)
                if at < 0:
                    return -1, ""
                kinds += own
            elif x == "}" and not spec or x in ("", "\\") or x == "\n" and len(quote) == 1:
                return -1, ""
            else:
                return at, kinds

    def field(self, text: str, at: int, quote: str) -> tuple[int, str]:
        """The place behind the field that starts at ``at``, -1 for an error, and its kinds."""
        kinds, opened, c = self.code["f{"], [], self.code
        while m := self.pattern.match(text, at):
            token, start, at = m.group(1), m.start(1), m.end()
            if _FIELDS.fullmatch(token):
                at, own = self.fields(text, start)
                kinds += own
                continue
            if not opened and token in ("}", ":", "!", ":="):
                break
            if not opened and token == "=" and re.compile(r"\s*[}:!]").match(text, at):
                continue
            if token in ("(", "[", "{"):
                opened.append(token)
            elif token in (")", "]", "}") and (not opened or opened.pop() + token not in ("()", "[]", "{}")):
                return -1, ""
            if token != "\n":
                kinds += self[token]
        else:
            return -1, ""
        kinds += c["f}"]
        if token == "!":
            name = re.compile(r"\s*[rsa]\s*(?=[:}])").match(text, at)
            if not name:
                return -1, ""
            token, at = text[name.end()], name.end() + 1
        if token in (":", ":="):
            end, own = self.literal(text, at - (token == ":="), quote, True)
            if end < 0 or text[end] != "}":
                return -1, ""
            return end + 1, kinds + own
        return at, kinds

    def shape(self, text: str) -> str:
        return "".join(kinds for _, _, kinds in self.pieces(text)) if _FIELDS.search(text) else super().shape(text)

    def offsets(self, text: str) -> list[int]:
        return [at for _, at, kinds in self.pieces(text) for _ in kinds]


class LineParser(Parser):
    """The grammar of one logical line."""

    LEX = PyLexer(
        r"\#[^\n]*|\\\r?\n|\n|" + _FSTART + "|" + _PREFIX + r"(?:\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"\"\"|'''(?:[^'\\]|\\[\s\S]|'(?!''))*'''|\"\"\"|'''|\"(?:[^\"\\\n]|\\(?:\r\n|[\s\S]))*\"|'(?:[^'\\\n]|\\(?:\r\n|[\s\S]))*')|0[xXbBoO]\w*|\.?\d(?:[eE][+-](?=\d)|\w|\.(?!\.))*",
        "f{ f} match case type " + " ".join(sorted(_WORDS)),
        "{ } ( ) [ ] ; , . ... : := = == != < > <= >= + - * / // % ** & | ^ ~ << >> @ -> += -= *= /= //= %= **= &= |= ^= <<= >>= @= !",
        r"(?:0[xX](?:_?[\da-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:(?:0(?:_?0)*|[1-9](?:_?\d)*)|(?:\d(?:_?\d)*)?\.\d(?:_?\d)*(?:[eE][+-]?\d+)?|\d(?:_?\d)*\.(?:[eE][+-]?\d+)?|\d(?:_?\d)*[eE][+-]?\d(?:_?\d)*|\d(?:_?\d)*(?=[jJ]))[jJ]?)",
        newline=True,
    )
    LEX.string = re.compile(_PREFIX + "[\"']")
    PREC = {"or": 1, "and": 2, "|": 5, "^": 6, "&": 7, "<<": 8, ">>": 8, "+": 9, "-": 9, "*": 10, "/": 10, "//": 10, "%": 10, "@": 10}
    ASSIGN = frozenset("+= -= *= /= //= %= **= &= |= ^= <<= >>= @=".split())
    in_case = False
    COMPARE = frozenset(("<", ">", "==", ">=", "<=", "!=", "in", "is"))

    def __init__(self, shape: str):
        super().__init__(shape)
        self.soft, self.t = self.t, ["ID" if x in ("match", "case", "type") else x for x in self.t]

    # expressions: 'l' can be assigned to, 'n' is a bare name, 't' a tuple or list of targets, 'r' nothing
    def binary(self, least: int = 1) -> str:
        t = self.t
        if least <= 3 and t[self.p] == "not":
            self.p += 1
            self.binary(3)
            kind = "r"
        else:
            kind = self.unary()
        while True:
            x = t[self.p]
            if least <= 4 and (x in self.COMPARE or x == "not" and t[self.p + 1] == "in"):
                self.p += 1 + (x == "not" or x == "is" and t[self.p + 1] == "not")
                self.binary(5)
            elif (own := self.PREC.get(x, 0)) >= least:
                self.p += 1
                self.binary(own + 1)
            else:
                return kind
            kind = "r"

    def unary(self) -> str:
        x = self.t[self.p]
        if x in ("+", "-", "~"):
            self.p += 1
            self.unary()
            return "r"
        if x == "await":
            self.p += 1
        kind = self.postfix(self.atom())
        if self.eat("**"):
            self.unary()
            return "r"
        return "r" if x == "await" else kind

    def atom(self) -> str:
        t, x = self.t, self.t[self.p]
        if x == "ID":
            self.p += 1
            return "n"
        if x in ("NUM", "...", "None", "True", "False"):
            self.p += 1
            return "r"
        if x == "STR":
            while self.eat("STR"):
                while self.eat("f{"):
                    self.value()
                    self.need("f}")
            return "r"
        if x == "(":
            self.p += 1
            if self.eat(")"):
                return "t"
            if t[self.p] == "yield":
                self.yield_()
                self.need(")")
                return "r"
            kind = self.items(")")
            self.need(")")
            return kind
        if x == "[":
            self.p += 1
            m = self.plain_items.match(self.k, self.p)
            if m:
                self.p = m.end()
            if self.eat("]"):
                return "r" if m else "t"
            kind = self.items("]")
            self.need("]")
            return "r" if m else "t" if kind in "nlt" else kind
        if x == "{":
            self.p += 1
            self.braces()
            return "r"
        self.fail("expected an expression")

    def named(self) -> str:
        """An expression that may bind a name, or a starred one."""
        if self.eat("*"):
            return self.binary(5)
        kind = self.test()
        if self.t[self.p] == ":=":
            if kind != "n":
                self.fail("':=' needs a name")
            self.p += 1
            self.test()
            return "r"
        return kind

    def test(self) -> str:
        if self.t[self.p] == "lambda":
            self.p += 1
            self.parameters(":", False)
            self.need(":")
            self.test()
            return "r"
        kind = self.binary()
        if self.in_case and self.eat("as"):
            self.need("ID")
        elif self.eat("if"):
            self.binary()
            self.need("else")
            self.test()
            return "r"
        return kind

    assignment = test

    def comprehension(self) -> bool:
        found = False
        while self.t[self.p] == "for" or self.t[self.p] == "async" and self.t[self.p + 1] == "for":
            found = True
            self.eat("async")
            self.p += 1
            self.targets()
            self.need("in")
            self.binary()
            if self.eat("if"):  # a condition or the middle of 'a if b else c'
                self.binary_or_named()
                if self.eat("else"):
                    self.test()
            while self.eat("if"):
                self.binary_or_named()
        return found

    def binary_or_named(self) -> None:
        if self.binary() == "n" and self.eat(":="):
            self.binary()

    def items(self, close: str) -> str:
        """Inside brackets: one expression, several, or a comprehension."""
        starred = self.t[self.p] == "*"
        kind = self.named()
        if self.comprehension():
            return "r"
        many = starred
        ok = kind in "nlt"
        while self.eat(","):
            many = True
            if m := self.plain_items.match(self.k, self.p):
                self.p, ok = m.end(), False
            if self.t[self.p] == close:
                break
            ok = self.named() in "nlt" and ok
        if starred and not many:
            self.fail("a star needs a list")
        return ("t" if ok else "r") if many else ("l" if kind == "n" else kind)

    def braces(self) -> None:
        first, mapping = True, False
        while not self.eat("}"):
            if self.eat("**"):
                self.binary(5)
                mapping = True
            else:
                self.named()
                if first or mapping:
                    if self.eat(":"):
                        self.test()
                        mapping = True
                    elif mapping:
                        self.fail("expected ':'")
                if self.comprehension():
                    if not first:
                        self.fail("expected '}'")
                    self.need("}")
                    return
            first = False
            if not self.eat(","):
                self.need("}")
                return

    def postfix(self, kind: str) -> str:
        while True:
            x = self.t[self.p]
            if x == ".":
                self.p += 1
                self.need("ID")
                kind = "l"
            elif x == "(":
                self.p += 1
                self.arguments()
                kind = "r"
            elif x == "[":
                self.p += 1
                self.subscript()
                kind = "l"
            else:
                return kind

    def arguments(self) -> None:
        keyword = False
        while not self.eat(")"):
            if self.eat("**"):
                self.test()
                keyword = True
            elif self.eat("*"):
                self.test()
            elif self.t[self.p] == "ID" and self.t[self.p + 1] == "=":
                self.p += 2
                self.test()
                keyword = True
            else:
                self.named()
                if not self.comprehension() and keyword:
                    self.fail("a plain argument behind a keyword")
            if not self.eat(","):
                self.need(")")
                return

    def subscript(self) -> None:
        while True:
            if self.t[self.p] not in (":", "]"):
                self.named()
            while self.eat(":"):
                if self.t[self.p] not in (":", "]", ","):
                    self.test()
            if not self.eat(",") or self.t[self.p] == "]":
                break
        self.need("]")
        if self.t[self.p - 2] == "[":
            self.p -= 1
            self.fail("expected an expression")

    def targets(self) -> None:
        """What 'for' and 'del' bind: assignable things, with commas."""
        while True:
            self.eat("*")
            if self.postfix(self.atom()) not in "nlt":
                self.fail("can't be assigned")
            if not self.eat(",") or self.t[self.p] in ("in", "EOF", ";", "="):
                return

    def star_list(self) -> str:
        """Expressions with commas, each of which may be starred."""
        starred = self.t[self.p] == "*"
        kind = self.named_star()
        many = False
        ok = kind in "nlt"
        while self.eat(","):
            many = True
            if self.t[self.p] in ("EOF", ";", "=", ":", ")", "]", "f}"):
                break
            ok = self.named_star() in "nlt" and ok
        if starred and not many and self.t[self.p] != "=":
            self.fail("a star needs a list")
        return ("t" if ok else "r") if many else kind

    def named_star(self) -> str:
        if self.eat("*"):
            return self.binary(5)
        return self.test()

    def parameters(self, close: str, annotated: bool) -> None:
        star = default = False
        while self.t[self.p] != close:
            if self.eat("/"):
                pass
            elif self.eat("**"):
                self.need("ID")
                if annotated and self.eat(":"):
                    self.test()
                self.eat(",")
                return
            elif self.eat("*"):
                if star:
                    self.fail("a second '*'")
                star = True
                if self.eat("ID"):
                    if annotated and self.eat(":"):
                        self.eat("*")
                        self.test()
                elif self.t[self.p] != ",":
                    self.fail("expected a name")
            else:
                self.need("ID")
                if annotated and self.eat(":"):
                    self.test()
                if self.eat("="):
                    self.test()
                    default = True
                elif default and not star:
                    self.fail("a parameter without default behind one with")
            if not self.eat(","):
                return

    def yield_(self) -> None:
        self.p += 1
        if self.eat("from"):
            self.test()
        elif self.t[self.p] not in (")", "EOF", ";", "]", "}", "f}"):
            self.star_list()

    # simple statements
    def small(self) -> None:
        t, x = self.t, self.t[self.p]
        if x in ("pass", "break", "continue"):
            self.p += 1
        elif x == "return":
            self.p += 1
            if t[self.p] not in ("EOF", ";"):
                self.star_list()
        elif x == "raise":
            self.p += 1
            if t[self.p] not in ("EOF", ";"):
                self.test()
                if self.eat("from"):
                    self.test()
        elif x in ("global", "nonlocal"):
            self.p += 1
            self.need("ID")
            while self.eat(","):
                self.need("ID")
        elif x == "del":
            self.p += 1
            self.targets()
        elif x == "assert":
            self.p += 1
            self.test()
            if self.eat(","):
                self.test()
        elif x == "import":
            self.p += 1
            while True:
                self.dotted()
                if self.eat("as"):
                    self.need("ID")
                if not self.eat(","):
                    break
        elif x == "from":
            self.from_()
        elif self.soft[self.p] == "type" and t[self.p + 1] == "ID" and self.attempt(self.type_alias):
            pass
        else:
            self.expression_statement()

    def dotted(self) -> None:
        self.need("ID")
        while self.eat("."):
            self.need("ID")

    def from_(self) -> None:
        self.p += 1
        dots = False
        while self.t[self.p] in (".", "..."):
            self.p += 1
            dots = True
        if not dots or self.t[self.p] == "ID":
            self.dotted()
        self.need("import")
        if self.eat("*"):
            return
        bracket = self.eat("(")
        while True:
            self.need("ID")
            if self.eat("as"):
                self.need("ID")
            if not self.eat(",") or bracket and self.t[self.p] == ")":
                break
        if bracket:
            self.need(")")

    def type_alias(self) -> None:
        self.p += 2
        if self.t[self.p] == "[":
            self.type_parameters()
        self.need("=")
        self.test()

    def type_parameters(self) -> None:
        self.need("[")
        while not self.eat("]"):
            if not self.eat("*"):
                self.eat("**")
            self.need("ID")
            if self.eat(":"):
                self.test()
            if self.eat("="):
                self.test()
            if not self.eat(","):
                self.need("]")
                return

    def expression_statement(self) -> None:
        t = self.t
        if t[self.p] == "yield":
            self.yield_()
            return
        kind = self.star_list()
        if t[self.p] == ":" and kind in "nl":
            self.p += 1
            self.test()
            if self.eat("="):
                self.value()
            return
        if t[self.p] in self.ASSIGN:
            if kind not in "nl":
                self.fail("can't be assigned")
            self.p += 1
            self.value()
            return
        while t[self.p] == "=":
            if kind not in "nlt":
                self.fail("can't be assigned")
            self.p += 1
            kind = self.value()

    def value(self) -> str:
        if self.t[self.p] == "yield":
            self.yield_()
            return "r"
        return self.star_list()

    def line(self) -> str:
        """What the line is: 'simple', or the word that opens a block, with '+' if its body stands on the same line."""
        t, x = self.t, self.t[self.p]
        word = x
        if x == "@":
            self.p += 1
            self.named()
            self.finish()
            return "@"
        if x == "async":
            self.p += 1
            if t[self.p] not in ("def", "for", "with"):
                self.fail("expected 'def'")
            x = word = t[self.p]
        if x in ("if", "elif", "while"):
            self.p += 1
            self.named()
        elif x in ("else", "try", "finally"):
            self.p += 1
        elif x == "for":
            self.p += 1
            self.targets()
            self.need("in")
            self.star_list()
        elif x == "def":
            self.p += 1
            self.need("ID")
            if t[self.p] == "[":
                self.type_parameters()
            self.need("(")
            self.parameters(")", True)
            self.need(")")
            if self.eat("->"):
                self.test()
        elif x == "class":
            self.p += 1
            self.need("ID")
            if t[self.p] == "[":
                self.type_parameters()
            if self.eat("("):
                self.arguments()
        elif x == "with":
            self.p += 1
            if not self.attempt(self.with_brackets):
                self.with_items(":")
        elif x == "except":
            self.p += 1
            self.eat("*")
            if t[self.p] != ":":
                self.test()
                while self.eat(","):
                    self.test()
                if self.eat("as"):
                    self.need("ID")
        elif self.soft[self.p] == "match" and t[self.p + 1] not in ("=", ".", ",", ":", "EOF", ";") and self.attempt(self.match_):
            word = "match"
        elif self.soft[self.p] == "case" and t[self.p + 1] not in ("=", ".", ",", "EOF", ";") and self.attempt(self.case_):
            word = "case"
        else:
            self.simple()
            return "simple"
        self.need(":")
        if t[self.p] == "EOF":
            return word
        self.simple()
        return word + "+"

    def match_(self) -> None:
        self.p += 1
        self.star_list()
        if self.t[self.p] != ":" or self.t[self.p + 1] != "EOF":
            self.fail("expected ':'")

    def case_(self) -> None:
        self.p += 1
        self.in_case = True
        try:
            self.patterns()
        finally:
            self.in_case = False
        if self.eat("if"):
            self.named()
        if self.t[self.p] != ":":
            self.fail("expected ':'")

    def patterns(self) -> None:
        while True:
            self.eat("*")
            self.pattern()
            if not self.eat(",") or self.t[self.p] in (":", "if"):
                return

    def pattern(self) -> None:
        self.binary(5)
        if self.eat("as"):
            self.need("ID")

    def with_brackets(self) -> None:
        self.need("(")
        self.with_items(")")
        self.need(")")
        if self.t[self.p] != ":":
            self.fail("expected ':'")

    def with_items(self, close: str) -> None:
        while True:
            self.test()
            if self.eat("as"):
                self.eat("*")
                if self.postfix(self.atom()) not in "nlt":
                    self.fail("can't be assigned")
            if not self.eat(",") or self.t[self.p] == close:
                return

    def simple(self) -> None:
        while True:
            self.small()
            if not self.eat(";") or self.t[self.p] == "EOF":
                break
        self.finish()

    def finish(self) -> None:
        if self.t[self.p] != "EOF":
            self.fail("expected the end of the line")


_LEX = LineParser.LEX
_NL = _LEX.code["NL"]
#: shape of a logical line -> what it is, or a (position, reason) pair
_LINES: dict[str, object] = {}


def _line(shape: str):
    """What a logical line is: a word, or (position, reason)."""
    found = _LINES.get(shape)
    if found is None:
        try:
            found = LineParser(shape).line()
        except Bad as e:
            found = (e.at, e.why)
        if len(_LINES) > MEMO:
            _LINES.clear()
        _LINES[shape] = found
    return found


class PyParser:
    """Blocks by indentation; ``run`` gives (token position, reason) pairs."""

    LEX = _LEX
    indent = re.compile(r"[ \t\f]*")

    def __init__(self, shape: str, widths: list[tuple[int, int]]):
        """widths: for each physical line the indentation in columns, with tabs as 8 and as 1."""
        self.lines, self.widths = shape.split(_NL), widths

    @staticmethod
    def split(text: str) -> tuple[str, list[tuple[int, int]]]:
        """The shape, and the indentation of each line that starts outside of a string."""
        pieces = _LEX.pieces(text) if _FIELDS.search(text) else None
        tokens = [t for t, _, _ in pieces] if pieces else _LEX.pattern.findall(text)
        shape = "".join([kinds for _, _, kinds in pieces] if pieces else map(_LEX.__getitem__, tokens))
        starts, at = [], 0
        if any("\n" in t for t in tokens if len(t) > 1):
            starts = [0] + ([at + 1 for t, at, _ in pieces if t == "\n"] if pieces else [m.end() for m in _LEX.pattern.finditer(text) if m.group(1) == "\n"])
            heads = [PyParser.indent.match(text, s).group() for s in starts]
        else:
            heads = [x[: len(x) - len(x.lstrip(" \t\f"))] for x in text.split("\n")]
        return shape, [(len(h.expandtabs(8)), len(h.expandtabs(1))) if h else (0, 0) for h in heads]

    def run(self) -> list[tuple[int, str]]:
        errors: list[tuple[int, str]] = []
        stack = [(0, 0)]
        opened = [""]  # per indentation, the last block word there
        due = ""  # the word whose block must start with the next line
        at, n, lines = 0, 0, self.lines
        decorated = False
        while n < len(lines):
            shape, first, start = lines[n], n, at
            at += len(shape) + 1
            n += 1
            if not shape:
                continue
            if (depth := shape.count("(") + shape.count("[") + shape.count("{") - shape.count(")") - shape.count("]") - shape.count("}")) > 0:
                parts = [shape]
                while depth > 0 and n < len(lines):
                    x = lines[n]
                    parts.append(x)
                    depth += x.count("(") + x.count("[") + x.count("{") - x.count(")") - x.count("]") - x.count("}")
                    at += len(x) + 1
                    n += 1
                shape = "".join(parts)
            width = self.widths[first] if first < len(self.widths) else (0, 0)
            if due:
                if width[0] > stack[-1][0] and width[1] > stack[-1][1]:
                    stack.append(width)
                    opened.append("")
                else:
                    errors.append((start, f"expected an indented block after '{due}'"))
                due = ""
            elif width != stack[-1]:
                if width[0] > stack[-1][0]:
                    errors.append((start, "unexpected indent"))
                    stack.append(width)
                    opened.append("")
                else:
                    while width[0] < stack[-1][0]:
                        stack.pop()
                        if opened.pop() == "try":
                            errors.append((start, "expected 'except' or 'finally'"))
                    if width != stack[-1]:
                        errors.append((start, "unindent does not match any outer level"))
                        stack.append(width)
                        opened.append("")
            what = _line(shape)
            if type(what) is tuple:
                errors.append((start + what[0], what[1]))
                word = "simple"
                if shape[-1:] == ":":
                    due = "statement"
            else:
                word = what.rstrip("+")
                if word == what and what not in ("simple", "@"):
                    due = word
            if word in _CLAUSES and opened[-1] not in _CLAUSES[word]:
                errors.append((start, f"'{word}' without its partner"))
            elif opened[-1] == "try" and word not in ("except", "finally"):
                errors.append((start, "expected 'except' or 'finally'"))
            if decorated and word not in ("def", "class", "@"):
                errors.append((start, "a decorator without a definition"))
            decorated = word == "@"
            opened[-1] = word if word in ("if", "elif", "for", "while", "try", "except", "else") else ""
        if due:
            errors.append((at, f"expected an indented block after '{due}', file ends"))
        elif decorated:
            errors.append((at, "a decorator without a definition, file ends"))
        if "try" in opened:
            errors.append((at, "expected 'except' or 'finally', file ends"))
        return sorted(errors)
