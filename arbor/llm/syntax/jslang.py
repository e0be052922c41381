"""JavaScript, read as a script: modern syntax, automatic semicolons, no import or export."""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate

from .base import LONGEST, Lexer, Parser

_NO_REGEX_AFTER = frozenset(("ID", "NUM", "STR", "CHR", "TPL", "}`", ")", "]", "}", "this", "super", "null", "true", "false", "++", "--"))
_WORDS = frozenset("var let const function class if else for while do switch case default break continue return throw try catch finally new delete typeof void in instanceof this super null true false import export extends debugger with enum yield await async static get set of".split())
#: Words that are names unless the grammar wants them.
_SOFT = frozenset("let yield await async static get set of".split())
#: A template without holes, or up to its first one; what stands behind a hole.
_TEMPLATE = r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(?:`|\$\{)"
_BEHIND_HOLE = re.compile(r"\}(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(`|\$\{)")
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[A-Za-z]*")


class JsLexer(Lexer):
    def kind(self, t: str) -> str:
        if t[:2] == "#!":
            return ""
        if t[0] == "`" and len(t) > 1:
            return self.code["TPL" if t[-1] == "`" else "`${"]
        return super().kind(t)

    def shape(self, text: str) -> str:
        tokens = self.pattern.findall(text)
        if "/" in tokens or "/=" in tokens or "${" in text:
            return "".join(k for k, _ in self.slow(text))
        return super().shape(text)

    def slow(self, text: str):
        """(kind, offset) token by token: '/' starts a regular expression where an operand is due, and the '}' of a
        template's hole goes on with the template."""
        at, last = 0, ""
        holes: list[int] = []  # per open hole, the braces open in it
        while m := self.pattern.match(text, at):
            token, start = m.group(1), m.start(1)
            if token in ("/", "/=") and last not in _NO_REGEX_AFTER and (r := _REGEX.match(text, start)):
                at, kind = r.end(), self.code["STR"]
            elif token == "}" and holes and not holes[-1]:
                if r := _BEHIND_HOLE.match(text, start):
                    at, kind = r.end(), self.code["}`" if r.group(1) == "`" else "}${"]
                else:
                    at, kind = m.end(), self.code["BAD"]
                if kind != self.code["}${"]:
                    holes.pop()
            else:
                at, kind = m.end(), self[token]
                if kind == self.code["`${"]:
                    holes.append(0)
                elif holes and token in ("{", "}"):
                    holes[-1] += 1 if token == "{" else -1
            for k in kind:
                yield k, start
                if self.names[k] != "NL":
                    last = self.names[k]

    def offsets(self, text: str) -> list[int]:
        return [at for _, at in self.slow(text)]


class JsParser(Parser):
    LEX = JsLexer(
        r"//[^\n]*|/\*[\s\S]*?\*/|/\*|\n|\?(?=\.\d)|\A\#![^\n]*|\"(?:[^\"\\\n]|\\(?:\r\n|[\s\S]))*\"|'(?:[^'\\\n]|\\(?:\r\n|[\s\S]))*'|" + _TEMPLATE + r"|0[xXbBoO][\w]*|\.?\d(?:[eE][+-]|\w|\.(?!\.))*",
        "TPL `${ }${ }` " + " ".join(sorted(_WORDS)),
        "{ } ( ) [ ] ; , . ... ?. ? : => = == === != !== < > <= >= + - * / % ** & | ^ ~ ! && || ?? << >> >>> ++ -- += -= *= /= %= **= &= |= ^= <<= >>= >>>= &&= ||= ??= @",
        r"(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|\d[\d_]*)n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?",
        ident=r"\#?(?:[^\W\d]|\$|\\u[\da-fA-F]{4})(?:[\w$‌‍]|\\u[\da-fA-F]{4})*",
        newline=True,
    )
    PREC = {"??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12}
    ASSIGN = frozenset("= += -= *= /= %= **= &= |= ^= <<= >>= >>>= &&= ||= ??=".split())

    def __init__(self, shape: str):
        nl = self.LEX.code["NL"]
        super().__init__(shape.replace(nl, ""))
        self.raw, self.breaks, self.no_in = shape, None, False

    def line_break(self, start: int | None = None, end: int = 0) -> bool:
        """Whether a line ends before the next token; with ``start``, between the tokens from there up to ``end``."""
        if self.breaks is None:
            self.breaks = list(accumulate(map(len, self.raw.split(self.LEX.code["NL"]))))[:-1]
        at = bisect_right(self.breaks, self.p - 1 if start is None else start)
        return at < len(self.breaks) and self.breaks[at] <= (self.p if start is None else end)

    # line ends are no part of a shape, so what has some inside is never remembered or passed by memory
    def remembered(self) -> bool:
        end = self.ends.search(self.k, self.p, self.p + LONGEST)
        if end is None:
            return False
        end = end.start()
        if self.k[self.p] == self.LEX.code["for"]:
            end = max(end, self.k.find("{", self.p, self.p + LONGEST))
        return not self.line_break(self.p, end) and super().remembered()

    def note(self, i: int) -> None:
        if not self.line_break(i, self.p - 1):
            super().note(i)

    def head(self, i: int, kind: str) -> None:
        if not self.line_break(i, self.p):
            super().head(i, kind)

    def semicolon(self) -> None:
        if self.eat(";") or self.t[self.p] in ("}", "EOF"):
            return
        if not self.line_break():
            self.fail("expected ';'")

    def name(self) -> bool:
        return self.t[self.p] == "ID" or self.t[self.p] in _SOFT

    def need_name(self) -> None:
        if not self.name():
            self.fail("expected a name")
        self.p += 1

    def need_property(self) -> None:
        if self.t[self.p] != "ID" and self.t[self.p] not in _WORDS:
            self.fail("expected a name")
        self.p += 1

    # expressions
    def binary(self, least: int = 1) -> str:
        kind = self.unary()
        t = self.t
        while (own := self.PREC.get(t[self.p], 0)) >= least:
            if t[self.p] == "in" and self.no_in:
                break
            self.p += 1
            self.binary(own if own == 12 else own + 1)
            kind = "r"
        return kind

    def assignment(self) -> str:
        t, x = self.t, self.t[self.p]
        if x == "yield" and "g" in self.ctx:
            self.p += 1
            if not self.line_break():
                if self.eat("*") or t[self.p] not in (")", "]", "}", ",", ";", ":", "EOF", "in"):
                    self.assignment()
            return "r"
        if self.is_arrow():
            self.arrow()
            return "r"
        at = self.p
        kind = super().assignment()
        if kind == "p":  # an object or array that isn't a value because of '= default' in it
            self.p = at
            self.fail("expected an expression")
        return kind

    def is_arrow(self) -> bool:
        t, p = self.t, self.p
        if t[p] == "async" and (t[p + 1] == "(" or t[p + 1] == "ID" and t[p + 2] == "=>"):
            p += 1
        if t[p] == "ID" or t[p] in _SOFT:
            return t[p + 1] == "=>"
        if t[p] != "(":
            return False
        p = self.closing(p)
        return p >= 0 and t[p + 1] == "=>"

    def arrow(self) -> None:
        ctx = "f"
        if self.t[self.p] == "async" and self.t[self.p + 1] != "=>":
            self.p += 1
            ctx += "a"
        if self.t[self.p] == "(":
            self.parameters()
        else:
            self.p += 1
        self.need("=>")
        if self.t[self.p] == "{":
            self.function_body(ctx)
        else:
            self.inside(ctx, self.assignment)

    def function_body(self, ctx: str) -> None:
        kept, self.no_in = self.no_in, False
        self.inside(ctx, self.block)
        self.no_in = kept

    def parameters(self) -> None:
        self.need("(")
        while not self.eat(")"):
            if self.eat("..."):
                self.target()
                self.need(")")
                return
            self.target()
            if self.eat("="):
                self.assignment()
            if not self.eat(","):
                self.need(")")
                return

    def target(self) -> None:
        """A name or a pattern that is declared."""
        if self.eat("["):
            while not self.eat("]"):
                if self.eat(","):
                    continue
                self.eat("...")
                self.target()
                if self.eat("="):
                    self.assignment()
                if not self.eat(","):
                    self.need("]")
                    return
        elif self.eat("{"):
            while not self.eat("}"):
                if self.eat("..."):
                    self.target()
                elif self.name() and self.t[self.p + 1] in (",", "}", "="):
                    self.p += 1
                else:
                    self.key()
                    self.need(":")
                    self.target()
                if self.eat("="):
                    self.assignment()
                if not self.eat(","):
                    self.need("}")
                    return
        else:
            self.need_name()

    def unary(self) -> str:
        x = self.t[self.p]
        if x in ("++", "--"):
            self.p += 1
            if self.unary() != "l":
                self.fail("expected something that can be assigned")
            return "r"
        if x in ("+", "-", "~", "!", "typeof", "void", "delete"):
            self.p += 1
            self.unary()
            if self.t[self.p] == "**":
                self.fail("a sign before '**'")
            return "r"
        if x == "await" and ("a" in self.ctx) and self.t[self.p + 1] not in (")", ",", ";", "=", "."):
            self.p += 1
            self.unary()
            return "r"
        kind = self.postfix(self.primary())
        if self.t[self.p] in ("++", "--") and not self.line_break():
            if kind != "l":
                self.fail("expected something that can be assigned")
            self.p += 1
            return "r"
        return kind

    def primary(self) -> str:
        t, x = self.t, self.t[self.p]
        if x in ("NUM", "STR", "CHR", "TPL", "this", "null", "true", "false"):
            self.p += 1
            return "r"
        if x == "`${":
            self.template()
            return "r"
        if x == "async" and t[self.p + 1] == "function":
            self.p += 1
            self.function(False, "a")
            return "r"
        if x == "ID" or x in _SOFT:
            self.p += 1
            return "l"
        if x == "(":
            self.p += 1
            kept, self.no_in = self.no_in, False
            kind = self.expression()
            self.no_in = kept
            self.need(")")
            return kind
        if x == "[":
            return self.array()
        if x == "{":
            return self.object()
        if x == "function":
            self.function(False)
            return "r"
        if x == "class":
            self.class_(False)
            return "r"
        if x == "new":
            self.p += 1
            if self.eat("."):
                self.need("ID")
                return "r"
            if t[self.p] == "new":
                self.primary()
            else:
                self.postfix(self.primary(), calls=False)
            if self.eat("("):
                self.arguments()
            return "r"
        if x == "super":
            self.p += 1
            if t[self.p] not in ("(", ".", "["):
                self.fail("expected '('")
            return "r"
        if x == "import":
            self.p += 1
            if t[self.p] != "(":
                self.fail("import is for modules")
            return "r"
        self.fail("expected an expression")

    def template(self) -> None:
        """A template with holes, each an expression."""
        kept, self.no_in = self.no_in, False
        self.p += 1
        self.expression()
        while self.eat("}${"):
            self.expression()
        self.need("}`")
        self.no_in = kept

    def array(self) -> str:
        self.p += 1
        while not self.eat("]"):
            self.skip_plain()
            if self.t[self.p] == "]":
                continue
            if self.eat(","):
                continue
            self.eat("...")
            self.assignment()
            if not self.eat(","):
                self.need("]")
                break
        return "l"

    def key(self) -> None:
        x = self.t[self.p]
        if x == "[":
            self.p += 1
            self.assignment()
            self.need("]")
        elif x in ("STR", "CHR", "NUM"):
            self.p += 1
        else:
            self.need_property()

    def object(self) -> str:
        self.p += 1
        t = self.t
        while not self.eat("}"):
            if self.eat("..."):
                self.assignment()
            elif self.name() and t[self.p + 1] in (",", "}"):
                self.p += 1
            elif self.name() and t[self.p + 1] == "=":  # only valid as a pattern
                self.p += 2
                self.assignment()
            else:
                self.method_or(lambda: (self.need(":"), self.assignment()))
            if not self.eat(","):
                self.need("}")
                break
        return "l"

    def method_or(self, otherwise) -> None:
        """A member: modifiers, key, then a method or what ``otherwise`` reads."""
        t, ctx = self.t, "fm"
        ends = ("(", ":", ",", "}", "=", ";")
        if t[self.p] == "async" and t[self.p + 1] not in ends:
            self.p += 1
            ctx += "a"
        if self.eat("*"):
            ctx += "g"
        elif t[self.p] in ("get", "set") and t[self.p + 1] not in ends:
            self.p += 1
        self.key()
        if t[self.p] == "(":
            self.parameters()
            self.function_body(ctx)
        else:
            otherwise()

    def function(self, named: bool, ctx: str = "") -> None:
        start = self.p
        self.need("function")
        if self.eat("*"):
            ctx += "g"
        if named or self.name():
            self.need_name()
        self.parameters()
        if named and not ctx and self.t[self.p] == "{":
            self.head(start, "function")
        self.function_body("f" + ctx)

    def class_(self, named: bool) -> None:
        self.need("class")
        if named or self.name() and self.t[self.p] != "extends":
            self.need_name()
        if self.eat("extends"):
            self.postfix(self.primary())
        self.need("{")
        self.inside("c", self.members)

    def members(self) -> None:
        while self.t[self.p] not in ("}", "EOF"):
            self.guarded(self.member)
        self.need("}")

    def member(self) -> None:
        t, i = self.t, self.p
        if self.eat(";") or self.remembered():
            return
        if t[self.p] == "static" and t[self.p + 1] not in ("(", "=", ";", "}"):
            self.p += 1
            if t[self.p] == "{":
                self.function_body("f")
                return
        plain = t[self.p] == "ID" and t[self.p + 1] == "(" and self.p == i
        if plain:
            self.p += 1
            self.parameters()
            if t[self.p] == "{":
                self.head(i, "method")
            self.function_body("fm")
        else:
            self.method_or(self.field)

    def field(self) -> None:
        if self.eat("="):
            self.inside("fm", self.assignment)
        self.semicolon()

    def postfix(self, kind: str, calls: bool = True) -> str:
        while True:
            x = self.t[self.p]
            if x == ".":
                self.p += 1
                self.need_property()
                kind = "l"
            elif x == "[":
                self.p += 1
                kept, self.no_in = self.no_in, False
                self.expression()
                self.no_in = kept
                self.need("]")
                kind = "l"
            elif x == "(" and calls:
                self.p += 1
                self.arguments()
                kind = "r"
            elif x == "?." and calls:
                self.p += 1
                if self.eat("("):
                    self.arguments()
                elif self.eat("["):
                    self.expression()
                    self.need("]")
                else:
                    self.need_property()
                kind = "r"
            elif x == "TPL":
                self.p += 1
                kind = "r"
            elif x == "`${":
                self.template()
                kind = "r"
            else:
                return kind

    def arguments(self) -> None:
        kept, self.no_in = self.no_in, False
        while not self.eat(")"):
            self.eat("...")
            self.assignment()
            if not self.eat(","):
                self.need(")")
                break
        self.no_in = kept

    # statements
    def body(self, kind: str) -> None:
        if kind == "if":
            self.branch(self.ctx)
            if self.eat("else"):
                self.branch(self.ctx)
        elif kind == "function":
            self.function_body("f")
        elif kind == "method":
            self.function_body("fm")
        elif kind == "loop":
            self.branch(self.ctx if "l" in self.ctx else self.ctx + "l")

    def branch(self, ctx: str) -> None:
        self.inside(ctx, self.block if self.t[self.p] == "{" else self.guarded)

    def lead(self, i: int, kind: str) -> None:
        if self.t[self.p] == "{":
            self.head(i, kind)
        self.body(kind)

    def variables(self, const: bool, in_for: bool = False) -> int:
        count = 0
        while True:
            pattern = self.t[self.p] in ("[", "{")
            self.target()
            count += 1
            if self.eat("="):
                self.assignment()
            elif (const or pattern) and not (in_for and self.t[self.p] in ("in", "of")):
                self.fail("expected '='")
            if not self.eat(","):
                return count

    def is_let(self) -> bool:
        return self.t[self.p] == "let" and (self.t[self.p + 1] in ("ID", "[", "{") or self.t[self.p + 1] in _SOFT)

    def statement(self) -> None:
        i, t, x = self.p, self.t, self.t[self.p]
        if x == "{":
            self.block()
        elif x == ";":
            self.p += 1
        elif x in ("var", "const") or self.is_let():
            self.p += 1
            self.variables(x == "const")
            self.semicolon()
        elif x == "function":
            self.function(True)
        elif x == "async" and t[i + 1] == "function":
            self.p += 1
            self.function(True, "a")
        elif x == "class":
            self.class_(True)
        elif x in ("if", "while", "with"):
            self.p += 1
            self.need("(")
            self.expression()
            self.need(")")
            if x == "with":
                self.branch(self.ctx)
            else:
                self.lead(i, "if" if x == "if" else "loop")
        elif x == "for":
            self.for_(i)
        elif x == "do":
            self.p += 1
            self.body("loop")
            self.need("while")
            self.need("(")
            self.expression()
            self.need(")")
            self.eat(";")
        elif x == "switch":
            self.p += 1
            self.need("(")
            self.expression()
            self.need(")")
            self.inside(self.ctx + "s", self.cases)
        elif x in ("break", "continue"):
            self.p += 1
            label = t[self.p] == "ID" and not self.line_break()
            if not label and "l" not in self.ctx and not (x == "break" and "s" in self.ctx):
                self.fail(f"'{x}' outside of a loop")
            self.p += label
            self.semicolon()
        elif x == "return":
            if "f" not in self.ctx:
                self.fail("'return' outside of a function")
            self.p += 1
            if t[self.p] not in (";", "}", "EOF") and not self.line_break():
                self.expression()
            self.semicolon()
        elif x == "throw":
            self.p += 1
            if self.line_break():
                self.fail("expected an expression")
            self.expression()
            self.semicolon()
        elif x == "try":
            self.p += 1
            self.block()
            caught = self.eat("catch")
            if caught:
                if self.eat("("):
                    self.target()
                    self.need(")")
                self.block()
            if self.eat("finally"):
                self.block()
            elif not caught:
                self.fail("expected 'catch' or 'finally'")
        elif x == "debugger":
            self.p += 1
            self.semicolon()
        elif x == "import" and t[i + 1] != "(" or x == "export":
            self.fail(f"'{x}' is for modules")
        elif (x == "ID" or x in _SOFT) and t[i + 1] == ":":
            self.p += 2
            self.guarded()
        else:
            self.expression()
            self.semicolon()

    def for_(self, i: int) -> None:
        t = self.t
        self.p += 1
        if self.eat("await") and "a" not in self.ctx:
            self.fail("'await' outside of an async function")
        self.need("(")
        kept, self.no_in = self.no_in, True
        each = False
        if t[self.p] == ";":
            pass
        elif t[self.p] in ("var", "const") or self.is_let():
            const = t[self.p] == "const"
            self.p += 1
            each = self.variables(const, True) == 1 and t[self.p] in ("in", "of")
        else:
            each = self.expression() == "l" and t[self.p] in ("in", "of")
        self.no_in = kept
        if each:
            self.p += 1
            self.expression()
        else:
            self.need(";")
            if t[self.p] != ";":
                self.expression()
            self.need(";")
            if t[self.p] != ")":
                self.expression()
        self.need(")")
        self.lead(i, "loop")

    def cases(self) -> None:
        self.need("{")
        while self.t[self.p] not in ("}", "EOF"):
            if self.eat("default"):
                self.need(":")
            elif self.eat("case"):
                self.expression()
                self.need(":")
            else:
                self.guarded()
        self.need("}")

    def file(self) -> None:
        while self.t[self.p] != "EOF":
            if self.t[self.p] == "}":
                self.errors.append((self.p, "a '}' without its partner"))
                self.p += 1
            else:
                self.guarded()
