"""C: declarations, statements and expressions after preprocessing lines are set aside."""

from __future__ import annotations

import re

from .base import Lexer, Parser

#: Names that are often macros: capitals, or two underscores in front.
_MACRO = re.compile(r"_*[A-Z][A-Z0-9_]+|__\w+")
_DIRECTIVE = re.compile(r"#\s*(include|define|undef|ifdef|ifndef|if|elifdef|elifndef|elif|else|endif|error|warning|pragma|line|ident|import|\d|$)", re.M)

#: Conditions that never hold in C; those of C++; those that hold in C only.
_NEVER = re.compile(r"#\s*(?:el)?if\s+\(?\s*0\s*\)?\s*(?:$|/[/*])")
_CPP = re.compile(r"#\s*(?:(?:el)?ifdef\s+|(?:el)?if\s+\(?\s*(?:defined\b[\s(]*)?)__cplusplus\b")
_NOT_CPP = re.compile(r"#\s*(?:ifndef\s+|if\s+!\s*defined\b[\s(]*)__cplusplus\b")


class CLexer(Lexer):
    def kind(self, t: str) -> str:
        if t[0] == "#":
            m = _DIRECTIVE.match(t)
            if not m:
                return self.code["BAD"]
            word = m.group(1)
            if word.startswith("if"):
                return self.code["#if0" if _NEVER.match(t) else "#ifc++" if _CPP.match(t) else "#ifc" if _NOT_CPP.match(t) else "#if"]
            if word.startswith("elif"):
                return self.code["#elif0" if _NEVER.match(t) else "#elifc++" if _CPP.match(t) else "#elif"]
            return self.code["#else"] if word == "else" else self.code["#endif"] if word == "endif" else ""
        if len(t) > 2 and t[0] in "LuU" and t[-1] in "\"'":
            return self.code["STR" if t[-1] == '"' else "CHR"]
        k = super().kind(t)
        return self.code["MACRO"] if k == self.code["ID"] and _MACRO.fullmatch(t) else k


_TYPES = frozenset("void char short int long float double signed unsigned _Bool _Complex bool wchar_t __int128".split())
_QUALIFIERS = frozenset("const volatile restrict static extern register auto inline typedef _Noreturn _Thread_local _Atomic __inline __inline__ __extension__ __restrict constexpr thread_local".split())
_TAGS = frozenset(("struct", "union", "enum"))
_STARTS = _TYPES | _QUALIFIERS | _TAGS | {"_Alignas", "typeof", "__attribute__", "__declspec", "_Static_assert", "static_assert"}


_BEHIND = frozenset((";", ",", "{", "=", "__attribute__", "ID"))
_NAMES = frozenset(("ID", "*"))


class CParser(Parser):
    LEX = CLexer(
        r"""//(?:[^\n\\]|\\[\s\S])*|/\*[\s\S]*?\*/|/\*|\#(?:[^\n\\/]|\\\r?\n|\\.|/(?![*/])|/\*[\s\S]*?\*/)*|(?:u8|[LuU])?"(?:[^"\\\n]|\\[\s\S])*"|[LuU]?'(?:[^'\\\n]|\\.)+'|0[xX][\w.']*(?:(?<=[pP])[+-]\w+)?|\.?\d(?:[eE][+-]|[\w.]|'(?=\w))*""",
        " ".join(sorted(_STARTS)) + " MACRO if else while for do switch case default break continue return goto sizeof _Alignof asm __asm__ _Generic #if #if0 #ifc++ #ifc #elif #elif0 #elifc++ #else #endif /*",
        "{ } ( ) [ ] ; , . -> ... = == != < > <= >= + - * / % & | ^ ~ ! && || << >> ++ -- += -= *= /= %= &= |= ^= <<= >>= ? :",
        r"(?:0[xX][\da-fA-F']*\.?[\da-fA-F']*(?:[pP][+-]?\d+)?|0[bB][01']+|[\d']+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)[uUlLfFzZ]*",
        ident=r"[^\W\d][\w$]*",
    )
    PREC = {"||": 1, "&&": 2, "|": 3, "^": 4, "&": 5, "==": 6, "!=": 6, "<": 7, ">": 7, "<=": 7, ">=": 7, "<<": 8, ">>": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10}
    ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>=".split())

    def __init__(self, shape: str):
        super().__init__(shape)
        self.macro, self.t = self.t, ["ID" if x == "MACRO" else "BAD" if x == "/*" else x for x in self.t]

    def skip_macro(self, follow: frozenset[str]) -> bool:
        """Passes a macro, with its arguments, if one of ``follow`` comes behind it."""
        if self.macro[self.p] != "MACRO":
            return False
        at = self.p
        self.p += 1
        if self.t[self.p] == "(":
            self.balanced()
        if self.t[self.p] in follow:
            return True
        self.p = at
        return False

    @classmethod
    def check(cls, shape: str) -> list[tuple[int, str]]:
        """The errors of a file, with places in ``shape``. Branches are read in passes, the n-th takes the n-th branch of
        each #if, or the first where it has fewer. Of the passes behind the first, errors in or right behind such a branch
        count. C++ is read as tokens and brackets; of what '#if 0' takes out, compilers read comments alone."""
        names = cls.LEX.names
        if not any(names[x][0] == "#" for x in set(shape)):
            return cls(shape).run()
        errors: list[tuple[int, str]] = []
        #: per branch: its '#if', its number there (-1 is never compiled, -2 is C++), the branch around it
        branches: list[tuple[int, int, int]] = [(-1, 0, -1)]
        inside: list[int] = []
        opened: list[list] = []  # place, branches to compile so far, whether '#else' came, whether in C only, branch around
        now = 0
        for n, x in enumerate(shape):
            name = names[x]
            if name[0] != "#":
                inside.append(now)
                continue
            inside.append(-1)
            if name.startswith("#if"):
                opened.append([n, 0, False, name == "#ifc", now])
            elif not opened:
                errors.append((n, f"'{name.rstrip('0c+')}' without its partner"))
                continue
            top = opened[-1]
            if name == "#endif":
                now = opened.pop()[4]
                continue
            if name.startswith("#el"):
                if top[2]:
                    errors.append((n, f"'{name.rstrip('0c+')}' behind '#else'"))
                top[2] = name == "#else"
            kind = -1 if name.endswith("0") else -2 if name.endswith("c++") or top[3] and name.startswith("#el") else top[1]
            top[1] += kind >= 0
            branches.append((top[0], kind, top[4]))
            now = len(branches) - 1
        errors += [(top[0], "unterminated #if") for top in opened]
        count: dict[int, int] = {}
        for group, kind, _ in branches:
            count[group] = max(count.get(group, 0), kind + 1)
        for turn in range(max(count.values())):
            taken, other = [], []
            for group, kind, around in branches:
                chosen = kind >= 0 and kind == (turn if turn < count[group] else 0)
                taken.append(chosen and (around < 0 or taken[around]))
                other.append(taken[-1] and (kind > 0 or around >= 0 and other[around]))
            kept = [n for n, b in enumerate(inside) if b >= 0 and taken[b]]
            for p, why in cls("".join(shape[n] for n in kept)).run():
                near = [inside[n] for n in kept[max(p - 1, 0):p + 1]]
                if not turn or any(other[b] for b in near):
                    errors.append((kept[p] if p < len(kept) else len(shape), why))
        errors += cls.set_aside(shape, inside, branches)
        return sorted({at: (at, why) for at, why in reversed(errors)}.values())

    @classmethod
    def set_aside(cls, shape: str, inside: list[int], branches: list[tuple[int, int, int]]) -> list[tuple[int, str]]:
        """Errors of the branches that aren't compiled as C."""
        names, errors, kinds = cls.LEX.names, [], []
        for _, kind, around in branches:
            above = kinds[around] if around >= 0 else 0
            kinds.append(above if above == -1 or above and kind >= 0 else kind if kind < 0 else 0)
        stacks: dict[int, list[str]] = {}
        for n, b in enumerate(inside):
            if b < 0 or not kinds[b]:
                continue
            name = names[shape[n]]
            if name in ("<<", "==", ">>") and n + 3 < len(shape) and {shape[n + 1], shape[n + 2]} == {shape[n]} and names[shape[n + 3]] == name[0] and (not n or shape[n - 1] != shape[n]):
                errors.append((n, "a conflict marker"))
            elif name == "/*" or kinds[b] == -2 and name == "BAD":
                errors.append((n, "unterminated text or unknown character"))
            elif kinds[b] == -2 and name in "([{":
                stacks.setdefault(b, []).append(name)
            elif kinds[b] == -2 and name in ")]}" and stacks.get(b) and stacks[b].pop() + name not in ("()", "[]", "{}"):
                errors.append((n, f"found '{name}'"))
        return errors

    def unary(self) -> str:
        t, x = self.t, self.t[self.p]
        if x in ("+", "-", "~", "!", "&", "++", "--", "&&"):
            self.p += 1
            self.unary()
            return "r"
        if x == "*":
            self.p += 1
            self.unary()
            return "l"
        if x in ("sizeof", "_Alignof"):
            self.p += 1
            if t[self.p] == "(" and self.starts_type(self.p + 1):
                self.p += 1
                self.type_name()
                self.need(")")
                if t[self.p] == "{":
                    self.initializer()
            else:
                self.unary()
            return "r"
        if x == "(" and self.is_cast():
            self.p += 1
            self.type_name()
            self.need(")")
            if t[self.p] == "{":
                self.initializer()
                return self.postfix("l")
            self.unary()
            return "r"
        return self.postfix(self.primary())

    def starts_type(self, at: int) -> bool:
        return self.t[at] in _STARTS

    def is_cast(self) -> bool:
        t, q = self.t, self.p + 1
        if t[q] in _STARTS:
            return True
        if t[q] != "ID":
            return False
        q += 1
        stars = q
        while t[q] == "*":
            q += 1
        return t[q] == ")" and (t[q + 1] in ("ID", "NUM", "STR", "CHR", "sizeof", "~", "!") or q > stars and t[q + 1] in ("(", "&", "{") or t[q + 1] == "{")

    def type_name(self) -> None:
        self.specifiers()
        self.declarator(abstract=True)

    def primary(self) -> str:
        x = self.t[self.p]
        if x in ("ID", "NUM", "CHR"):
            self.p += 1
            return "l" if x == "ID" else "r"
        if x == "STR":
            while self.t[self.p] == "STR" or self.t[self.p] == "ID" and self.t[self.p - 1] == "STR" and self.t[self.p + 1] == "STR":
                self.p += 1
            return "r"
        if x == "(":
            self.p += 1
            if self.t[self.p] == "{":
                self.block()
            else:
                self.expression()
            self.need(")")
            return "l"
        if x == "_Generic":
            self.p += 1
            self.balanced()
            return "r"
        self.fail("expected an expression")

    def balanced(self) -> None:
        self.need("(")
        depth = 1
        while depth:
            x = self.t[self.p]
            if x in ("EOF", "BAD"):
                self.fail("expected ')'")
            depth += (x == "(") - (x == ")")
            self.p += 1

    def postfix(self, kind: str) -> str:
        while True:
            x = self.t[self.p]
            if x == "(":
                self.p += 1
                self.arguments()
                kind = "r"
            elif x == "[":
                self.p += 1
                self.expression()
                self.need("]")
                kind = "l"
            elif x in (".", "->"):
                self.p += 1
                self.need("ID")
                kind = "l"
            elif x in ("++", "--"):
                if kind != "l":
                    self.fail("expected something that can be assigned")
                self.p += 1
                kind = "r"
            else:
                return kind

    def argument(self) -> None:
        if self.starts_type(self.p):
            self.type_name()
        else:
            self.assignment()

    # declarations
    def after_declarator(self) -> None:
        self.attributes()
        while self.t[self.p - 1] in (")", "]", "ID") and self.skip_macro(_BEHIND):
            self.attributes()

    def attributes(self) -> None:
        while self.t[self.p] in ("__attribute__", "__declspec", "_Alignas", "asm", "__asm__"):
            self.p += 1
            self.balanced()

    def specifiers(self) -> bool:
        """Whether there were any."""
        t, base, any_ = self.t, False, False
        while True:
            x = t[self.p]
            if x in _QUALIFIERS:
                self.p += 1
            elif x in _TYPES:
                self.p += 1
                base = True
            elif x in _TAGS:
                self.tag()
                base = True
            elif x in ("__attribute__", "__declspec", "_Alignas"):
                self.attributes()
            elif x == "typeof":
                self.p += 1
                self.balanced()
                base = True
            elif x == "ID" and (base and self.skip_macro(_NAMES) or not any_ and self.skip_macro(_STARTS)):
                pass
            elif x == "ID" and not base and t[self.p + 1] == "(" and self.skip_macro(_NAMES):
                base = True
            elif x == "ID" and not base:
                # a name is the type, unless what follows shows that it is what is declared
                if any_ and t[self.p + 1] in ("=", ";", ",", "[", ")", ":") or any_ and t[self.p + 1] == "(" and not self.names_type():
                    return any_
                self.p += 1
                base = True
            else:
                return any_
            any_ = True

    def names_type(self) -> bool:
        return self.t[self.p + 2] == "*" or self.t[self.p + 2] == "ID" and self.t[self.p + 3] == ")" and self.t[self.p + 4] == "("

    def tag(self) -> None:
        what = self.t[self.p]
        self.p += 1
        self.attributes()
        named = self.eat("ID")
        if self.t[self.p] != "{":
            if not named:
                self.fail("expected a name")
            return
        self.p += 1
        if what == "enum":
            while not self.eat("}"):
                self.need("ID")
                self.attributes()
                if self.eat("="):
                    self.assignment()
                if not self.eat(","):
                    self.need("}")
                    break
        else:
            while not self.eat("}"):
                if self.t[self.p] == "EOF":
                    self.need("}")
                if self.eat(";"):
                    continue
                if self.t[self.p] in ("_Static_assert", "static_assert"):
                    self.p += 1
                    self.balanced()
                    self.need(";")
                    continue
                if not self.specifiers():
                    self.fail("expected a member")
                if not self.eat(";"):
                    while True:
                        if self.t[self.p] != ":":
                            self.declarator()
                        if self.eat(":"):
                            self.assignment()
                        self.attributes()
                        if not self.eat(","):
                            break
                    self.need(";")
        self.attributes()

    def declarator(self, abstract: bool = False) -> bool:
        """Whether the last suffix was a parameter list."""
        t, function = self.t, False
        self.attributes()
        while t[self.p] == "*" or t[self.p] in _QUALIFIERS and t[self.p - 1] in ("*", *_QUALIFIERS):
            self.p += 1
            self.attributes()
        if t[self.p] == "ID":
            self.p += 1
        elif t[self.p] == "(" and not (abstract and (t[self.p + 1] == ")" or t[self.p + 1] in _STARTS)):
            self.p += 1
            self.declarator(abstract)
            self.need(")")
        elif not abstract:
            self.fail("expected a name")
        while True:
            if self.eat("["):
                while t[self.p] in _QUALIFIERS:
                    self.p += 1
                if t[self.p] == "*" and t[self.p + 1] == "]":
                    self.p += 1
                if not self.eat("]"):
                    self.assignment()
                    self.need("]")
                function = False
            elif self.eat("("):
                self.parameters()
                function = True
            else:
                self.after_declarator()
                return function

    def parameters(self) -> None:
        if self.eat(")"):
            return
        while True:
            if self.eat("..."):
                break
            if not self.specifiers():
                self.fail("expected a parameter")
            self.declarator(abstract=True)
            if not self.eat(","):
                break
        self.need(")")

    def initializer(self) -> None:
        if not self.eat("{"):
            self.assignment()
            return
        while not self.eat("}"):
            self.skip_plain()
            if self.t[self.p] == "}":
                continue
            while self.t[self.p] in (".", "["):
                if self.eat("."):
                    self.need("ID")
                else:
                    self.p += 1
                    self.assignment()
                    if self.eat("..."):
                        self.assignment()
                    self.need("]")
                if self.t[self.p] not in (".", "["):
                    self.need("=")
            self.initializer()
            if not self.eat(","):
                self.need("}")
                return

    def declaration(self, start: int, outer: bool) -> None:
        if self.t[self.p] in ("_Static_assert", "static_assert"):
            self.p += 1
            self.balanced()
            self.need(";")
            return
        self.specifiers()
        if self.eat(";"):
            return
        first = True
        while True:
            function = self.declarator()
            if first and function and outer:
                while self.t[self.p] not in ("{", ";", ",", "=", "EOF") and self.t[self.p] in (*_STARTS, "ID"):  # old-style parameters
                    self.specifiers()
                    self.declarator()
                    while self.eat(","):
                        self.declarator()
                    self.need(";")
                if self.t[self.p] == "{":
                    self.head(start, "function")
                    self.inside("f", self.block)
                    return
            if self.eat("="):
                self.initializer()
            first = False
            if not self.eat(","):
                break
        self.need(";")

    def is_declaration(self) -> bool:
        t, p = self.t, self.p
        if t[p] in _STARTS:
            return True
        if t[p] != "ID":
            return False
        if t[p + 1] == "ID":
            return True
        q = p + 1
        while t[q] == "*" or t[q] in ("const", "restrict", "volatile"):
            q += 1
        return q > p + 1 and t[q] == "ID" and t[q + 1] in ("=", ";", ",", "[") or t[p + 1] in _QUALIFIERS

    def body(self, kind: str) -> None:
        if kind == "function":
            self.inside("f", self.block)
        elif kind == "if":
            self.loop_body(self.ctx)
            if self.eat("else"):
                self.guarded()
        elif kind == "do":
            self.loop_body(self.ctx + "l")
            self.need("while")
            self.need("(")
            self.expression()
            self.need(")")
            self.need(";")
        else:
            self.loop_body(self.ctx + kind[0] if kind[0] not in self.ctx else self.ctx)

    def loop_body(self, ctx: str) -> None:
        if self.t[self.p] == "{":
            self.inside(ctx, self.block)
        else:
            self.inside(ctx, self.guarded)

    def lead(self, i: int, kind: str) -> None:
        if self.t[self.p] == "{":
            self.head(i, kind)
        self.body(kind)

    def statement(self) -> None:
        i, x = self.p, self.t[self.p]
        if x == "{":
            self.block()
        elif x == ";":
            self.p += 1
        elif x in ("if", "while", "switch"):
            self.p += 1
            self.need("(")
            self.expression()
            self.need(")")
            self.lead(i, {"if": "if", "while": "loop", "switch": "switch"}[x])
        elif x == "for":
            self.p += 1
            self.need("(")
            if not self.eat(";"):
                if self.is_declaration():
                    self.declaration(self.p, False)
                else:
                    self.expression()
                    self.need(";")
            if not self.eat(";"):
                self.expression()
                self.need(";")
            if not self.eat(")"):
                self.expression()
                self.need(")")
            self.lead(i, "loop")
        elif x == "do":
            self.p += 1
            self.body("do")
        elif x in ("break", "continue"):
            if "l" not in self.ctx and not (x == "break" and "s" in self.ctx):
                self.fail(f"'{x}' outside of a loop")
            self.p += 1
            self.need(";")
        elif x == "return":
            self.p += 1
            if not self.eat(";"):
                if self.t[self.p] == "{":
                    self.fail("expected an expression")
                self.expression()
                self.need(";")
        elif x == "goto":
            self.p += 1
            if not self.eat("ID"):
                self.need("*")
                self.expression()
            self.need(";")
        elif x == "case":
            self.p += 1
            self.binary()
            if self.eat("..."):
                self.binary()
            self.need(":")
        elif x == "default":
            self.p += 1
            self.need(":")
        elif x == "ID" and self.t[self.p + 1] == ":":
            self.p += 2
        elif x in ("asm", "__asm__"):
            self.p += 1
            while self.t[self.p] in _QUALIFIERS or self.t[self.p] == "goto":
                self.p += 1
            self.balanced()
            self.need(";")
        elif self.is_declaration():
            self.declaration(i, False)
        else:
            self.expression()
            self.need(";")

    def external(self) -> None:
        i, t = self.p, self.t
        if self.eat(";"):
            return
        if self.k[i] and self.remembered():
            return
        if t[i] == "extern" and t[i + 1] == "STR":
            self.p += 2
            if self.eat("{"):
                while t[self.p] not in ("}", "EOF"):
                    self.guarded(self.external)
                self.need("}")
                return
        elif t[i] in ("asm", "__asm__"):
            self.p += 1
            self.balanced()
            self.need(";")
            return
        if t[self.p] == "ID" and t[self.p + 1] == "(" and not (self.macro[self.p] == "MACRO" and self.wraps_type()):  # a macro call or a function without a type
            self.p += 1
            if self.declarator_tail():
                self.inside("f", self.block)
            else:
                self.need(";")
            return
        if t[self.p] not in _STARTS and t[self.p] != "ID":
            self.fail("expected a declaration")
        self.declaration(i, True)
        self.note(i)

    def wraps_type(self) -> bool:
        """Whether a macro with arguments stands for a type, as in EXPORT(int) name(...)."""
        at = self.p
        found = self.skip_macro(_NAMES | _STARTS)
        self.p = at
        return found

    def declarator_tail(self) -> bool:
        self.balanced()
        self.attributes()
        return self.t[self.p] == "{"

    def file(self) -> None:
        while self.t[self.p] != "EOF":
            self.guarded(self.external)
