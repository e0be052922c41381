"""Go: one package clause, imports, declarations; semicolons at line ends are put in by the lexer."""

from __future__ import annotations

import re

from .base import Lexer, Parser

_WORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
_ENDS_LINE = ("ID", "NUM", "STR", "CHR", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}")


class GoLexer(Lexer):
    def shape(self, text: str) -> str:
        return self.lines.sub(";", super().shape(text) + self.code["NL"]).replace(self.code["NL"], "")

    def offsets(self, text: str) -> list[int]:
        """Positions of what shape() keeps; a semicolon put in stands at its line end."""
        at, out, last = super().offsets(text), [], ""
        for k, x in zip(Lexer.shape(self, text) + self.code["NL"], [*at, len(text)]):
            name = self.names[k]
            if name != "NL" or last in _ENDS_LINE:
                out.append(x)
            last = name
        return out


class GoParser(Parser):
    LEX = GoLexer(
        r"//[^\n]*|/\*[\s\S]*?\*/|/\*|\n|\"(?:[^\"\\\n]|\\.)*\"|`[^`]*`|'(?:[^'\\\n]|\\.[0-9a-fA-F]*)'|0[xX][\w.]*(?:(?<=[pP])[+-]\w+)?|\.?\d(?:[eE][+-]|\w|\.(?!\.))*",
        " ".join(sorted(_WORDS)),
        "{ } ( ) [ ] ; , . ... : := = == != < > <= >= + - * / % & | ^ ! && || << >> &^ <- ++ -- += -= *= /= %= &= |= ^= <<= >>= &^= ~",
        r"(?:0[xX][\da-fA-F_]*\.?[\da-fA-F_]*(?:[pP][+-]?\d+)?|0[bB][01_]+|0[oO]?[0-7_]+|\d[\d_]*\.?[\d_]*(?:[eE][+-]?\d+)?|\.\d[\d_]*(?:[eE][+-]?\d+)?)i?",
        newline=True,
    )
    LEX.lines = re.compile("(?<=[%s])%s+" % ("".join(map(re.escape, map(LEX.code.get, _ENDS_LINE))), LEX.code["NL"]))
    PREC = {"||": 1, "&&": 2, "==": 3, "!=": 3, "<": 3, "<=": 3, ">": 3, ">=": 3, "+": 4, "-": 4, "|": 4, "^": 4, "*": 5, "/": 5, "%": 5, "<<": 5, ">>": 5, "&": 5, "&^": 5}
    ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>= &^=".split())

    def __init__(self, shape: str):
        super().__init__(shape)
        self.literals = True  # whether '{' behind a type name starts a literal

    def free(self, f, literals: bool = True) -> None:
        kept, self.literals = self.literals, literals
        f()
        self.literals = kept

    # types
    def type(self) -> None:
        t, x = self.t, self.t[self.p]
        if x == "ID":
            self.p += 1
            if t[self.p] == "." and t[self.p + 1] == "ID":
                self.p += 2
            if t[self.p] == "[" and t[self.p + 1] != "]":
                self.attempt(self.type_arguments)
        elif x == "*":
            self.p += 1
            self.type()
        elif x == "(":
            self.p += 1
            self.type()
            self.need(")")
        elif x == "[":
            self.p += 1
            if not self.eat("]"):
                if not self.eat("..."):
                    self.free(self.binary)
                self.need("]")
            self.type()
        elif x == "map":
            self.p += 1
            self.need("[")
            self.type()
            self.need("]")
            self.type()
        elif x == "chan":
            self.p += 1
            self.eat("<-")
            self.type()
        elif x == "<-":
            self.p += 1
            self.need("chan")
            self.type()
        elif x == "func":
            self.p += 1
            self.signature()
        elif x == "struct":
            self.struct()
        elif x == "interface":
            self.interface()
        else:
            self.fail("expected a type")

    def type_arguments(self) -> None:
        self.need("[")
        self.type()
        while self.eat(","):
            if self.t[self.p] == "]":
                break
            self.type()
        self.need("]")

    def struct(self) -> None:
        self.p += 1
        self.need("{")
        while not self.eat("}"):
            if self.t[self.p] == "*" or self.t[self.p] == "ID" and self.t[self.p + 1] in (".", ";", "STR", "}") or self.t[self.p] == "ID" and self.t[self.p + 1] == "[" and self.attempt(self.embedded):
                if self.t[self.p - 1] != "]":
                    self.eat("*")
                    self.type()
            else:
                self.need("ID")
                while self.eat(","):
                    self.need("ID")
                self.type()
            self.eat("STR")
            if not self.eat(";"):
                self.need("}")
                return

    def embedded(self) -> None:
        self.type()
        if self.t[self.p] not in (";", "}", "STR"):
            self.fail("expected ';'")

    def interface(self) -> None:
        self.p += 1
        self.need("{")
        while not self.eat("}"):
            if self.t[self.p] == "ID" and self.t[self.p + 1] == "(":
                self.p += 1
                self.signature()
            else:
                self.union()
            if not self.eat(";"):
                self.need("}")
                return

    def union(self) -> None:
        while True:
            self.eat("~")
            self.type()
            if not self.eat("|"):
                return

    def signature(self) -> None:
        self.parameters()
        x = self.t[self.p]
        if x == "(":
            self.parameters()
        elif x in ("ID", "*", "[", "map", "chan", "func", "struct", "interface", "<-"):
            self.type()

    def parameters(self) -> None:
        self.need("(")
        while not self.eat(")"):
            if self.t[self.p] == "ID" and self.t[self.p + 1] not in (",", ")", "."):
                if not self.attempt(self.named):
                    self.type()
            else:
                self.eat("...")
                self.type()
            if not self.eat(","):
                self.need(")")
                return

    def named(self) -> None:
        self.need("ID")
        self.eat("...")
        self.type()
        if self.t[self.p] not in (",", ")"):
            self.fail("expected ')'")

    # expressions
    def assignment(self) -> str:
        return self.binary()

    def unary(self) -> str:
        x = self.t[self.p]
        if x in ("+", "-", "!", "^", "&", "<-"):
            if x == "<-" and self.t[self.p + 1] == "chan" and self.attempt(self.type):
                return self.postfix("r")
            self.p += 1
            self.unary()
            return "r"
        if x == "*":
            self.p += 1
            self.unary()
            return "l"
        return self.postfix(self.primary())

    def primary(self) -> str:
        t, x = self.t, self.t[self.p]
        if x in ("NUM", "STR", "CHR"):
            self.p += 1
            return "r"
        if x == "ID":
            self.p += 1
            if t[self.p] == "{" and self.literals:
                self.literal()
                return "r"
            return "l"
        if x == "(":
            self.p += 1
            at = self.p
            if not self.attempt(lambda: (self.free(self.expression), self.need(")"))):
                self.p = at
                self.type()
                self.need(")")
            return "l"
        if x == "func":
            self.p += 1
            self.signature()
            if t[self.p] == "{":
                self.free(lambda: self.inside("f", self.block))
            return "r"
        if x in ("[", "map", "struct", "chan", "interface"):
            self.type()
            if t[self.p] == "{":
                self.literal()
            elif t[self.p] not in ("(", ")", ","):
                self.fail("expected '{'")
            return "r"
        self.fail("expected an expression")

    def literal(self) -> None:
        self.free(self.literal_body)

    def literal_body(self) -> None:
        self.need("{")
        while not self.eat("}"):
            self.skip_plain()
            if self.t[self.p] == "}":
                continue
            self.element()
            if self.eat(":"):
                self.element()
            if not self.eat(","):
                self.need("}")
                return

    def element(self) -> None:
        if self.t[self.p] == "{":
            self.literal_body()
        else:
            self.binary()

    def postfix(self, kind: str) -> str:
        t = self.t
        while True:
            x = t[self.p]
            if x == ".":
                self.p += 1
                if self.eat("("):
                    if not self.eat("type"):
                        self.type()
                    self.need(")")
                    kind = "r"
                else:
                    self.need("ID")
                    kind = "l"
                    if t[self.p] == "{" and self.literals and t[self.p - 3] == "ID":
                        self.literal()
                        kind = "r"
            elif x == "(":
                self.p += 1
                self.free(self.arguments)
                kind = "r"
            elif x == "[":
                self.p += 1
                self.free(self.index)
                kind = "l"
                if t[self.p] == "{" and self.literals:
                    self.literal()
                    kind = "r"
            else:
                return kind

    def index(self) -> None:
        colons = 0
        while not self.eat("]"):
            if self.eat(":"):
                colons += 1
                continue
            if self.t[self.p] in ("[", "map", "chan", "func", "struct", "interface", "*") and self.attempt(self.type):
                pass
            else:
                self.binary()
            if colons == 0 and self.eat(","):
                continue
            if self.t[self.p] not in (":", "]"):
                self.fail("expected ']'")

    def arguments(self) -> None:
        while not self.eat(")"):
            if self.t[self.p] in ("[", "map", "chan", "struct", "interface", "*", "func") and self.attempt(self.type_argument):
                pass
            else:
                self.binary()
            self.eat("...")
            if not self.eat(","):
                self.need(")")
                return

    def type_argument(self) -> None:
        self.type()
        if self.t[self.p] not in (",", ")"):
            self.fail("expected ')'")

    # statements
    def block(self) -> None:
        self.need("{")
        kept, self.literals = self.literals, True
        while self.t[self.p] not in ("}", "EOF"):
            self.guarded()
        self.literals = kept
        self.need("}")

    def end(self) -> None:
        if self.t[self.p] != "}" and not self.eat(";"):
            self.fail("expected ';'")

    def body(self, kind: str) -> None:
        if kind == "if":
            self.block()
            if self.eat("else"):
                if self.t[self.p] == "if":
                    self.statement()
                    return
                self.block()
        elif kind == "loop":
            self.inside(self.ctx if "l" in self.ctx else self.ctx + "l", self.block)
        elif kind == "func":
            self.inside("f", self.block)
        self.end()

    def simple(self, in_for: bool = False) -> str:
        """A simple statement; 'range' if it is a range clause."""
        t = self.t
        if in_for and t[self.p] == "range":
            self.p += 1
            self.expression()
            return "range"
        kind = self.binary()
        many = False
        while self.eat(","):
            many = True
            if self.binary() != "l":
                kind = "r"
        x = t[self.p]
        if x == ":=" or x in self.ASSIGN:
            if kind != "l" or many and x not in (":=", "="):
                self.fail("assignment to something that can't be assigned")
            self.p += 1
            if in_for and self.eat("range"):
                self.expression()
                return "range"
            self.binary()
            while self.eat(","):
                self.binary()
        elif many:
            self.fail("expected '='")
        elif x in ("++", "--"):
            self.p += 1
        elif x == "<-":
            self.p += 1
            self.binary()
        return kind

    def header(self) -> None:
        """[simple ;] condition of an 'if'."""
        if self.t[self.p] == "{":
            self.fail("expected a condition")
        if self.t[self.p] != ";":
            self.simple()
        if self.eat(";"):
            self.simple()

    def switch_header(self) -> None:
        if self.t[self.p] not in ("{", ";"):
            self.simple()
        if self.eat(";") and self.t[self.p] != "{":
            self.simple()

    def for_header(self) -> None:
        if self.t[self.p] == "{":
            return
        if self.t[self.p] != ";" and self.simple(True) == "range":
            return
        if self.t[self.p] == "{":
            return
        self.need(";")
        if self.t[self.p] != ";":
            self.binary()
        self.need(";")
        if self.t[self.p] != "{":
            self.simple()

    def statement(self) -> None:
        i, t, x = self.p, self.t, self.t[self.p]
        if x == "{":
            self.block()
            self.end()
        elif x == ";":
            self.p += 1
        elif x in ("if", "for"):
            self.p += 1
            self.free(self.header if x == "if" else self.for_header, False)
            if t[self.p] != "{":
                self.fail("expected '{'")
            kind = "if" if x == "if" else "loop"
            self.head(i, kind)
            self.body(kind)
        elif x in ("switch", "select"):
            self.p += 1
            if x == "switch":
                self.free(self.switch_header, False)
            self.inside(self.ctx + "s", self.cases)
            self.end()
        elif x in ("break", "continue", "goto", "fallthrough"):
            self.p += 1
            label = x != "fallthrough" and self.eat("ID")
            if x == "goto" and not label:
                self.fail("expected a label")
            if not label and "l" not in self.ctx and not (x in ("break", "fallthrough") and "s" in self.ctx):
                self.fail(f"'{x}' outside of a loop")
            self.end()
        elif x == "return":
            self.p += 1
            if t[self.p] not in (";", "}"):
                self.expression()
            self.end()
        elif x in ("go", "defer"):
            self.p += 1
            self.binary()
            if t[self.p - 1] != ")":
                self.fail("expected a call")
            self.end()
        elif x in ("var", "const", "type"):
            self.declaration()
            self.end()
        elif x == "ID" and t[i + 1] == ":":
            self.p += 2
            if t[self.p] not in ("}",):
                self.guarded()
        else:
            self.simple()
            self.end()

    def cases(self) -> None:
        self.need("{")
        while self.t[self.p] not in ("}", "EOF"):
            if self.eat("default"):
                self.need(":")
            elif self.eat("case"):
                if not self.attempt(lambda: (self.simple(), self.need(":"))):
                    while True:
                        if not self.attempt(self.case_type):
                            self.binary()
                        if not self.eat(","):
                            break
                    self.need(":")
            else:
                self.guarded()
        self.need("}")

    def case_type(self) -> None:
        self.type()
        if self.t[self.p] not in (",", ":"):
            self.fail("expected ':'")

    # declarations
    def group(self, spec) -> None:
        if self.eat("("):
            while not self.eat(")"):
                spec()
                if not self.eat(";"):
                    self.need(")")
                    return
        else:
            spec()

    def declaration(self) -> None:
        x = self.t[self.p]
        self.p += 1
        self.group({"var": self.var_spec, "const": self.const_spec, "type": self.type_spec}[x])

    def names(self) -> None:
        self.need("ID")
        while self.eat(","):
            self.need("ID")

    def var_spec(self) -> None:
        self.names()
        if self.t[self.p] != "=":
            self.type()
        if self.eat("="):
            self.expression()

    def const_spec(self) -> None:
        self.names()
        if self.t[self.p] not in ("=", ";", ")"):
            self.type()
        if self.eat("="):
            self.expression()

    def type_spec(self) -> None:
        self.need("ID")
        if self.t[self.p] == "[" and self.t[self.p + 1] == "ID" and self.t[self.p + 2] not in ("]",):
            self.attempt(self.type_parameters)
        self.eat("=")
        self.type()

    def type_parameters(self) -> None:
        self.need("[")
        while not self.eat("]"):
            self.names()
            self.union()
            if not self.eat(","):
                self.need("]")
                return

    def outer(self) -> None:
        t, i, x = self.t, self.p, self.t[self.p]
        if self.eat(";") or self.remembered():
            return
        if x == "func":
            self.p += 1
            if t[self.p] == "(":
                self.parameters()
            self.need("ID")
            if t[self.p] == "[":
                self.type_parameters()
            self.signature()
            if t[self.p] == "{":
                self.head(i, "func")
                self.inside("f", self.block)
            self.end()
        elif x in ("var", "const", "type"):
            self.declaration()
            self.end()
            self.note(i)
        elif x == "import":
            self.fail("imports come before declarations")
        else:
            self.fail("expected a declaration")

    def import_(self) -> None:
        if not self.eat("."):
            self.eat("ID")
        self.need("STR")

    def file(self) -> None:
        while self.eat(";"):
            pass
        self.guarded(self.clause)
        while self.t[self.p] in ("import", ";"):
            if not self.eat(";"):
                self.guarded(self.imports)
        while self.t[self.p] != "EOF":
            self.guarded(self.outer)

    def clause(self) -> None:
        self.need("package")
        self.need("ID")
        self.end()

    def imports(self) -> None:
        self.p += 1
        self.group(self.import_)
        self.end()
