"""Java: compilation units up to records, switch expressions and text blocks."""

from __future__ import annotations

from .base import Lexer, Parser

_PRIMITIVE = frozenset("boolean byte char short int long float double".split())
_MODIFIERS = frozenset("public protected private static abstract final native synchronized transient volatile strictfp default".split())
_KINDS = frozenset(("class", "interface", "enum"))


class JavaParser(Parser):
    LEX = Lexer(
        r'''//[^\n]*|/\*[\s\S]*?\*/|/\*|"""[ \t]*\r?\n(?:[^\\"]|\\[\s\S]|"(?!""))*"""|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.[0-9a-fA-F]*)'|0[xX][\w.]*(?:(?<=[pP])[+-]\w+)?|\.?\d(?:[eE][+-]|\w|\.(?!\.))*''',
        " ".join(sorted(_PRIMITIVE | _MODIFIERS | _KINDS)) + " void package import if else while for do switch case break continue return try catch finally throw throws new this super extends implements instanceof assert null true false const goto _",
        "{ } ( ) [ ] ; , . ... @ :: = > < ! ~ ? : -> == <= >= != && || ++ -- + - * / & | ^ % << += -= *= /= &= |= ^= %= <<=",
        r"(?:0[xX][\da-fA-F_]*\.?[\da-fA-F_]*(?:[pP][+-]?\d+)?|0[bB][01_]+|\d[\d_]*\.?[\d_]*(?:[eE][+-]?\d+)?|\.\d[\d_]*(?:[eE][+-]?\d+)?)[lLfFdD]?",
        ident=r"[^\W\d][\w$]*|\$[\w$]*",
    )
    PREC = {"||": 1, "&&": 2, "|": 3, "^": 4, "&": 5, "==": 6, "!=": 6, "<": 7, ">": 7, "<=": 7, ">=": 7, "instanceof": 7, "<<": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10}
    ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<=".split())

    # types
    def annotations(self) -> None:
        while self.t[self.p] == "@" and self.t[self.p + 1] != "interface":
            self.p += 1
            self.name()
            if self.eat("("):
                if not self.eat(")"):
                    while True:
                        if self.t[self.p] == "ID" and self.t[self.p + 1] == "=":
                            self.p += 2
                        self.element()
                        if not self.eat(","):
                            break
                    self.need(")")

    def element(self) -> None:
        if self.t[self.p] == "@":
            self.annotations()
        elif self.eat("{"):
            while not self.eat("}"):
                self.element()
                if not self.eat(","):
                    self.need("}")
                    return
        else:
            self.assignment()

    def name(self) -> None:
        self.need("ID")
        while self.t[self.p] == "." and self.t[self.p + 1] == "ID":
            self.p += 2

    def type(self, dims: bool = True) -> None:
        self.annotations()
        if self.t[self.p] in _PRIMITIVE:
            self.p += 1
        else:
            while True:
                self.need("ID")
                if self.t[self.p] == "<":
                    self.type_arguments()
                if self.t[self.p] == "." and self.t[self.p + 1] in ("ID", "@"):
                    self.p += 1
                    self.annotations()
                    continue
                break
        if dims:
            self.dims()

    def dims(self) -> None:
        self.annotations()
        while self.t[self.p] == "[" and self.t[self.p + 1] == "]":
            self.p += 2
            self.annotations()

    def type_arguments(self) -> None:
        self.need("<")
        if self.eat(">"):
            return
        while True:
            self.annotations()
            if self.eat("?"):
                if self.eat("extends") or self.eat("super"):
                    self.type()
            else:
                self.type()
            if not self.eat(","):
                break
        self.need(">")

    def type_parameters(self) -> None:
        if self.eat("<"):
            while True:
                self.annotations()
                self.need("ID")
                if self.eat("extends"):
                    self.type()
                    while self.eat("&"):
                        self.type()
                if not self.eat(","):
                    break
            self.need(">")

    # expressions
    def binary(self, least: int = 1) -> str:
        kind = self.unary()
        t = self.t
        while (own := self.PREC.get(t[self.p], 0)) >= least:
            x = t[self.p]
            if x == ">" and t[self.p + 1] in (">", ">="):  # shifts are lexed bracket by bracket
                q = self.p + 1
                while t[q] == ">":
                    q += 1
                if t[q] == ">=":
                    if kind != "l":
                        self.fail("assignment to something that can't be assigned")
                    self.p = q + 1
                    self.assignment()
                    return "r"
                if 8 < least:
                    return kind
                self.p = q
                self.binary(9)
            else:
                self.p += 1
                if x == "instanceof":
                    self.eat("final")
                    self.pattern()
                else:
                    self.binary(own + 1)
            kind = "r"
        return kind

    def pattern(self) -> None:
        self.type()
        if self.eat("("):
            if not self.eat(")"):
                self.pattern()
                while self.eat(","):
                    self.pattern()
                self.need(")")
            self.eat("ID")
        elif self.t[self.p] in ("ID", "_"):
            self.p += 1

    def assignment(self) -> str:
        if self.is_lambda():
            self.lambda_()
            return "r"
        return super().assignment()

    def is_lambda(self) -> bool:
        t, p = self.t, self.p
        if t[p] in ("ID", "_"):
            return t[p + 1] == "->"
        if t[p] != "(":
            return False
        p = self.closing(p)
        return p >= 0 and t[p + 1] == "->"

    def lambda_(self) -> None:
        if not self.eat("("):
            self.p += 1
        elif not self.eat(")"):
            if self.t[self.p + 1] in (",", ")"):
                while True:
                    if not self.eat("_"):
                        self.need("ID")
                    if not self.eat(","):
                        break
            else:
                self.formals()
            self.need(")")
        self.need("->")
        if self.t[self.p] == "{":
            self.inside("f", self.block)
        else:
            self.assignment()

    def unary(self) -> str:
        x = self.t[self.p]
        if x in ("+", "-", "!", "~", "++", "--"):
            self.p += 1
            self.unary()
            return "r"
        if x == "(" and self.cast():
            return "r"
        kind = self.postfix(self.primary())
        while self.t[self.p] in ("++", "--"):
            if kind != "l":
                self.fail("expected something that can be assigned")
            self.p += 1
            kind = "r"
        return kind

    def cast(self) -> bool:
        t, start = self.t, self.p
        primitive = t[start + 1] in _PRIMITIVE
        if not primitive and t[start + 1] not in ("ID", "@"):
            return False

        def head():
            self.p += 1
            self.type()
            while self.eat("&"):
                self.type()
            self.need(")")

        if not self.attempt(head):
            return False
        x = t[self.p]
        plain = primitive and t[self.p - 2] in _PRIMITIVE
        if plain and x not in (".", "::") or x in ("ID", "NUM", "STR", "CHR", "(", "!", "~", "this", "super", "new", "null", "true", "false", "switch", "void") or x in _PRIMITIVE:
            if self.is_lambda():
                self.lambda_()
            else:
                self.unary()
            return True
        self.p = start
        return False

    def primary(self) -> str:
        t, x = self.t, self.t[self.p]
        if x in ("NUM", "STR", "CHR", "null", "true", "false"):
            self.p += 1
            return "r"
        if x == "ID":
            if t[self.p + 1] in ("<", "[", ".") and self.attempt(self.reference):
                return "r"
            self.p += 1
            if t[self.p] == "(":
                self.p += 1
                self.arguments()
                return "r"
            return "l"
        if x == "(":
            self.p += 1
            kind = self.assignment()
            self.need(")")
            return kind
        if x in ("this", "super"):
            self.p += 1
            if self.eat("("):
                self.arguments()
            return "r"
        if x == "new":
            self.creation()
            return "r"
        if x == "switch":
            self.switch()
            return "r"
        if x in _PRIMITIVE or x == "void":
            self.p += 1
            self.dims()
            if self.t[self.p] == "::":
                return "r"
            self.need(".")
            self.need("class")
            return "r"
        self.fail("expected an expression")

    def reference(self) -> None:
        """A type before '::', or an array type before '.class'."""
        self.type()
        if self.t[self.p] == "::":
            return
        if self.t[self.p - 1] != "]":
            self.fail("expected '::'")
        self.need(".")
        self.need("class")

    def creation(self) -> None:
        self.p += 1
        self.annotations()
        if self.t[self.p] == "<":
            self.type_arguments()
        self.type(dims=False)
        if self.eat("("):
            self.arguments()
            if self.t[self.p] == "{":
                self.inside("", self.class_body)
            return
        if self.t[self.p] != "[":
            self.fail("expected '(' or '['")
        sized = False
        while self.eat("["):
            if not self.eat("]"):
                self.assignment()
                self.need("]")
                sized = True
        if self.t[self.p] == "{" and not sized:
            self.array()
        elif not sized:
            self.fail("expected a size")

    def array(self) -> None:
        self.need("{")
        while not self.eat("}"):
            self.skip_plain()
            if self.t[self.p] == "}":
                continue
            self.initializer()
            if not self.eat(","):
                self.need("}")
                return

    def initializer(self) -> None:
        if self.t[self.p] == "{":
            self.array()
        else:
            self.assignment()

    def postfix(self, kind: str) -> str:
        while True:
            x = self.t[self.p]
            if x == ".":
                self.p += 1
                if self.t[self.p] == "<":
                    self.type_arguments()
                x = self.t[self.p]
                if x == "new":
                    self.creation()
                    kind = "r"
                elif x in ("this", "class"):
                    self.p += 1
                    kind = "r"
                elif x == "super":
                    self.p += 1
                    if self.eat("("):
                        self.arguments()
                    kind = "r"
                else:
                    self.need("ID")
                    kind = "l"
                    if self.eat("("):
                        self.arguments()
                        kind = "r"
            elif x == "[":
                self.p += 1
                self.assignment()
                self.need("]")
                kind = "l"
            elif x == "::":
                self.p += 1
                if self.t[self.p] == "<":
                    self.type_arguments()
                if not self.eat("new"):
                    self.need("ID")
                kind = "r"
            else:
                return kind

    def expression(self) -> str:
        return self.assignment()

    # statements
    def switch(self) -> None:
        self.p += 1
        self.need("(")
        self.expression()
        self.need(")")
        self.inside(self.ctx + "s", self.cases)

    def cases(self) -> None:
        self.need("{")
        while self.t[self.p] not in ("}", "EOF"):
            if self.t[self.p] == "case" or self.t[self.p] == "default" and self.t[self.p + 1] in (":", "->"):
                if self.eat("default"):
                    pass
                else:
                    self.p += 1
                    while True:
                        if not self.eat("default") and not self.attempt(self.case_pattern):
                            self.binary()
                            if self.eat("?"):
                                self.binary()
                                self.need(":")
                                self.binary()
                        if not self.eat(","):
                            break
                    if self.t[self.p] == "ID" and self.t[self.p + 1] not in (":", "->"):  # a guard
                        self.p += 1
                        self.binary()
                if self.eat("->"):
                    if self.t[self.p] == "{":
                        self.block()
                    elif self.t[self.p] == "throw":
                        self.guarded()
                    else:
                        self.expression()
                        self.need(";")
                else:
                    self.need(":")
            else:
                self.guarded()
        self.need("}")

    def case_pattern(self) -> None:
        self.eat("final")
        self.type()
        if self.t[self.p] == "(":
            self.p -= 1
            self.pattern()
        elif self.t[self.p] == "ID" and self.t[self.p + 1] in (":", "->", ",", "ID"):
            self.p += 1
        else:
            self.fail("expected a pattern")

    def body(self, kind: str) -> None:
        if kind == "if":
            self.branch(self.ctx)
            if self.eat("else"):
                self.branch(self.ctx)
        elif kind == "method":
            self.inside("f", self.block)
        elif kind == "class":
            self.inside("", self.class_body)
        elif kind == "loop":
            self.branch(self.ctx if "l" in self.ctx else self.ctx + "l")

    def branch(self, ctx: str) -> None:
        self.inside(ctx, self.block if self.t[self.p] == "{" else self.guarded)

    def lead(self, i: int, kind: str) -> None:
        if self.t[self.p] == "{":
            self.head(i, kind)
        self.body(kind)

    def local(self) -> bool:
        """Tries 'type name' at the start of a statement."""
        def head():
            while self.t[self.p] in ("final", "@"):
                if not self.eat("final"):
                    self.annotations()
            self.type()
            if not self.eat("_"):
                self.need("ID")
            if self.t[self.p] not in ("=", ";", ",", "[", ":"):
                self.fail("expected ';'")

        return (self.t[self.p] in _PRIMITIVE or self.t[self.p] in ("ID", "final", "@")) and self.attempt(head)

    def variables(self) -> None:
        """After the first name."""
        while True:
            self.dims()
            if self.eat("="):
                self.initializer()
            if not self.eat(","):
                return
            self.need("ID")

    def statement(self) -> None:
        i, t, x = self.p, self.t, self.t[self.p]
        if x == "{":
            self.block()
        elif x == ";":
            self.p += 1
        elif x == "if" or x == "while":
            self.p += 1
            self.need("(")
            self.expression()
            self.need(")")
            self.lead(i, "if" if x == "if" else "loop")
        elif x == "for":
            self.p += 1
            self.need("(")
            each = False
            if not self.eat(";"):
                if self.local():
                    if self.eat(":"):
                        self.expression()
                        each = True
                    else:
                        self.variables()
                else:
                    self.expression()
                    while self.eat(","):
                        self.expression()
                if not each:
                    self.need(";")
            if not each:
                if not self.eat(";"):
                    self.expression()
                    self.need(";")
                if t[self.p] != ")":
                    self.expression()
                    while self.eat(","):
                        self.expression()
            self.need(")")
            self.lead(i, "loop")
        elif x == "do":
            self.p += 1
            self.body("loop")
            self.need("while")
            self.need("(")
            self.expression()
            self.need(")")
            self.need(";")
        elif x == "switch":
            self.switch()
            if t[self.p] in (".",):
                self.postfix("r")
                self.need(";")
        elif x in ("break", "continue"):
            if "l" not in self.ctx and not (x == "break" and ("s" in self.ctx or t[i + 1] == "ID")):
                self.fail(f"'{x}' outside of a loop")
            self.p += 1
            self.eat("ID")
            self.need(";")
        elif x == "return":
            self.p += 1
            if not self.eat(";"):
                self.expression()
                self.need(";")
        elif x == "throw":
            self.p += 1
            self.expression()
            self.need(";")
        elif x == "assert":
            self.p += 1
            self.expression()
            if self.eat(":"):
                self.expression()
            self.need(";")
        elif x == "synchronized" and t[i + 1] == "(":
            self.p += 2
            self.expression()
            self.need(")")
            self.block()
        elif x == "try":
            self.try_()
        elif x == "ID" and t[i + 1] == ":":
            self.p += 2
            self.guarded()
        elif x == "ID" and "s" in self.ctx and t[i + 1] in ("NUM", "STR", "CHR", "new", "this", "true", "false", "null", "!", "switch"):  # yield
            self.p += 1
            self.expression()
            self.need(";")
        elif x in _KINDS or x in ("abstract", "static", "strictfp") or x == "final" and t[i + 1] in ("class", "abstract"):
            while t[self.p] in _MODIFIERS:
                self.p += 1
            self.type_declaration()
        elif x == "ID" and t[i + 1] == "ID" and t[i + 2] in ("(", "<") and self.attempt(self.record):
            pass
        elif self.local():
            self.variables()
            self.need(";")
        else:
            if self.expression() == "l" or t[i] in ("NUM", "STR", "CHR") and self.p == i + 1:
                self.fail("not a statement")
            self.need(";")

    def try_(self) -> None:
        self.p += 1
        resources = self.eat("(")
        if resources:
            while True:
                if self.local():
                    self.variables()
                else:
                    self.expression()
                if not self.eat(";") or self.t[self.p] == ")":
                    break
            self.need(")")
        self.block()
        handled = resources
        while self.eat("catch"):
            self.need("(")
            while self.t[self.p] in ("final", "@"):
                if not self.eat("final"):
                    self.annotations()
            self.type()
            while self.eat("|"):
                self.type()
            if not self.eat("_"):
                self.need("ID")
            self.need(")")
            self.block()
            handled = True
        if self.eat("finally"):
            self.block()
        elif not handled:
            self.fail("expected 'catch' or 'finally'")

    # declarations
    def formals(self) -> None:
        while True:
            while self.t[self.p] in ("final", "@"):
                if not self.eat("final"):
                    self.annotations()
            self.type()
            self.annotations()
            self.eat("...")
            if self.eat("this"):
                pass
            elif not self.eat("_"):
                self.need("ID")
                if self.eat("."):
                    self.need("this")
            self.dims()
            if not self.eat(","):
                return

    def type_list(self) -> None:
        self.type()
        while self.eat(","):
            self.type()

    def type_declaration(self) -> None:
        x = self.t[self.p]
        if x == "@":
            self.p += 1
            self.need("interface")
            self.need("ID")
            self.inside("", self.class_body)
        elif x in ("class", "interface"):
            self.p += 1
            self.need("ID")
            self.type_parameters()
            if self.eat("extends"):
                self.type_list()
            if self.eat("implements"):
                self.type_list()
            if self.t[self.p] == "ID" and self.t[self.p + 1] == "ID":  # permits
                self.p += 1
                self.type_list()
            self.inside("", self.class_body)
        elif x == "enum":
            self.p += 1
            self.need("ID")
            if self.eat("implements"):
                self.type_list()
            self.inside("", self.enum_body)
        else:
            self.record()

    def record(self) -> None:
        self.need("ID")
        self.need("ID")
        self.type_parameters()
        self.need("(")
        if not self.eat(")"):
            self.formals()
            self.need(")")
        if self.eat("implements"):
            self.type_list()
        self.inside("", self.class_body)

    def enum_body(self) -> None:
        self.need("{")
        while self.t[self.p] in ("ID", "@"):
            self.annotations()
            self.need("ID")
            if self.eat("("):
                self.arguments()
            if self.t[self.p] == "{":
                self.class_body()
            if not self.eat(","):
                break
        if self.eat(";"):
            while self.t[self.p] not in ("}", "EOF"):
                self.guarded(self.member)
        self.need("}")

    def class_body(self) -> None:
        self.need("{")
        while self.t[self.p] not in ("}", "EOF"):
            self.guarded(self.member)
        self.need("}")

    def modifiers(self) -> None:
        while True:
            x = self.t[self.p]
            if x == "@" and self.t[self.p + 1] != "interface":
                self.annotations()
            elif x in _MODIFIERS:
                self.p += 1
            elif x == "ID" and (self.t[self.p + 1] in _KINDS or self.t[self.p + 1] in ("public", "abstract", "static")):  # sealed
                self.p += 1
            elif x == "ID" and self.t[self.p + 1] == "-" and self.t[self.p + 2] == "ID" and self.t[self.p + 3] in _KINDS:  # non-sealed
                self.p += 3
            else:
                return

    def member(self) -> None:
        i, t = self.p, self.t
        if self.eat(";") or self.remembered():
            return
        self.modifiers()
        x = t[self.p]
        if x == "{":
            self.inside("f", self.block)
            return
        if x in _KINDS or x == "@":
            self.type_declaration()
            return
        if x == "ID" and t[self.p + 1] == "ID" and t[self.p + 2] in ("(", "<") and self.attempt(self.record_head):
            self.record()
            return
        if x == "<":
            self.type_parameters()
            self.annotations()
        if t[self.p] == "ID" and t[self.p + 1] == "{":  # compact constructor
            self.p += 1
            self.inside("f", self.block)
            return
        if t[self.p] == "ID" and t[self.p + 1] == "(":
            self.p += 1
        elif t[self.p] == "void":
            self.p += 1
            self.need("ID")
        else:
            self.type()
            self.need("ID")
        if self.eat("("):
            if not self.eat(")"):
                self.formals()
                self.need(")")
            self.dims()
            if self.eat("throws"):
                self.type_list()
            if t[self.p] == "{":
                self.head(i, "method")
                self.inside("f", self.block)
                return
            if self.eat("default"):
                self.element()
            self.need(";")
        else:
            self.variables()
            self.need(";")
            self.note(i)

    def record_head(self) -> None:
        """Looks ahead only: a record has a body right behind its components."""
        at = self.p
        self.p += 2
        self.type_parameters()
        self.need("(")
        if not self.eat(")"):
            self.formals()
            self.need(")")
        if self.t[self.p] not in ("{", "implements") or self.t[at - 1] in ("void",):
            self.fail("expected a body")
        if self.t[self.p] == "{" and self.t[at + 2] == "(" and not self.is_record(at):
            self.fail("expected a record")
        self.p = at

    def is_record(self, at: int) -> bool:
        """A method 'Type name(...) {' has the same shape; its body decides: components of a record make members."""
        depth, q, t = 0, at, self.t
        while t[q] != "{":
            q += 1
        return t[q + 1] == "}" or t[q + 1] in ("public", "private", "static", "@")

    def file(self) -> None:
        t = self.t
        if t[self.p] == "@" or t[self.p] == "package":
            at = self.p
            self.annotations()
            if t[self.p] == "package":
                self.guarded(self.package)
            else:
                self.p = at
        while t[self.p] in ("import", ";"):
            self.guarded(self.import_)
        while t[self.p] != "EOF":
            self.guarded(self.outer)

    def package(self) -> None:
        self.p += 1
        self.name()
        self.need(";")

    def import_(self) -> None:
        if self.eat(";"):
            return
        self.p += 1
        self.eat("static")
        self.name()
        if self.eat("."):
            self.need("*")
        self.need(";")

    def outer(self) -> None:
        if self.eat(";"):
            return
        self.modifiers()
        if self.t[self.p] in _KINDS or self.t[self.p] == "@" or self.t[self.p] == "ID" and self.t[self.p + 1] == "ID" and self.t[self.p + 2] in ("(", "<"):
            self.type_declaration()
        else:
            self.fail("expected a class")
