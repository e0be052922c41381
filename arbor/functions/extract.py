"""Definitions and calls of one file. Pure Python; run inside of workers.

Python is read with the standard parser; where that finds an error, statement by statement,
so that an error costs no more than its own statement. Brace languages are read from a flat copy of the
text in which comments and literals are blanked: definitions are heads followed by a body,
bodies end at the matching brace. A file that isn't UTF-8 text yields nothing.
"""

from __future__ import annotations

import ast
import bisect
import keyword
import re
from functools import partial
from typing import NamedTuple

from .languages import LANGUAGES


class Definition(NamedTuple):
    name: str
    type: str
    start: int
    end: int
    parent: str | None


class Call(NamedTuple):
    caller: str
    callee: str
    line: int


def language_of(path: str) -> str | None:
    stem, dot, ext = path.rsplit("/", 1)[-1].rpartition(".")
    return LANGUAGES.get(ext.lower()) if dot and stem else None


def _dotted(node: ast.expr) -> str | None:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        return ".".join([node.id, *reversed(parts)])
    return parts[0] if parts else None


#: Nodes that hold no call.
_LEAVES = frozenset((ast.Name, ast.Constant, ast.Load, ast.Store, ast.Del, ast.alias, *ast.operator.__subclasses__(), *ast.unaryop.__subclasses__(), *ast.cmpop.__subclasses__(), *ast.boolop.__subclasses__(), type(None), str, int))


def _walk(tree: ast.AST, inside: str | None, caller: str | None, shift: int, found: list[Definition], calls: list[Call]) -> None:
    """Adds what a tree within a class and a function has; ``shift`` is added to its lines."""
    stack: list[tuple[ast.AST, str | None, str | None]] = [(tree, inside, caller)]
    while stack:
        node, inside, caller = stack.pop()
        children = []
        for field in node._fields:
            value = getattr(node, field, None)
            if value.__class__ is list:
                children += value
            else:
                children.append(value)
        for child in children:
            if child.__class__ in _LEAVES or not isinstance(child, ast.AST):
                continue
            cls, by = inside, caller
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                found.append(Definition(child.name, "method" if inside else "function", child.lineno + shift, child.end_lineno + shift, inside))
                by = child.name
            elif isinstance(child, ast.ClassDef):
                found.append(Definition(child.name, "class", child.lineno + shift, child.end_lineno + shift, None))
                cls = child.name
            elif isinstance(child, ast.Call) and caller and (name := _dotted(child.func)):
                calls.append(Call(caller, name, child.lineno + shift))
            stack.append((child, cls, by))


_UNREAD = (SyntaxError, ValueError, RecursionError, MemoryError)


def _python(text: str) -> tuple[list[Definition], list[Call]]:
    found: list[Definition] = []
    calls: list[Call] = []
    try:
        tree = ast.parse(text)
    except _UNREAD:
        _Statements(text, found, calls).read()
    else:
        _walk(tree, None, None, 0, found, calls)
    return found, calls


_PY_QUIET = re.compile(r"""\#[^\n]*|\"\"\"(?:[^"\\]|\\[\s\S]|"(?!""))*\"\"\"|\'\'\'(?:[^'\\]|\\[\s\S]|'(?!''))*\'\'\'|"(?:[^"\\\n]|\\[\s\S])*"|'(?:[^'\\\n]|\\[\s\S])*'""")
#: Words that start a statement and no line within brackets.
_PY_STARTS = re.compile(r"\s*(?:(?:async\s+)?def|class|import|return|raise|while|try|with|del|global|assert|pass|break|continue|except|finally|elif)\b(?!\s*=)")
_PY_CLAUSE = re.compile(r"\s*(?:else|elif|except|finally)\b")
_PY_HEAD = re.compile(r"\s*(?:(?:async\s+)?def\s+(?P<f>[^\W\d]\w*)\s*(?:\[[^\]]*\]\s*)?\(|class\s+(?P<c>[^\W\d]\w*)\s*(?:[\[(:]|$))")
_PY_CALL = re.compile(r"(\.\s*)?(?<!\w)([^\W\d]\w*(?:\s*\.\s*[^\W\d]\w*)*)\s*\(")


class _Statements:
    """Python text with errors. A statement that the standard parser reads is read by it; of one that it doesn't, the
    head is read by its words and each statement of the body alone; a line that can't be read still has its calls."""

    def __init__(self, text: str, found: list[Definition], calls: list[Call]):
        self.text, self.found, self.calls = text.split("\n"), found, calls
        self.flat = _PY_QUIET.sub(_blank, text).split("\n")
        #: First and last physical line, and indentation, of each logical line.
        self.lines: list[tuple[int, int, int]] = []
        depth, goes_on = 0, False
        for n, (raw, flat) in enumerate(zip(self.text, self.flat)):
            if depth and flat.strip() and (_PY_STARTS.match(flat) or self._width(flat) < self.lines[-1][2] and flat.lstrip()[0] not in ")]}"):
                depth = 0
            if depth > 0 or goes_on:
                self.lines[-1] = self.lines[-1][0], n, self.lines[-1][2]
            elif raw.strip() and (flat.strip() or self._text_starts(raw, n)):
                depth = 0
                self.lines.append((n, n, self._width(raw)))
            else:
                if self.lines and raw.strip() and not raw.lstrip().startswith("#"):  # the rest of a text of several lines
                    self.lines[-1] = self.lines[-1][0], n, self.lines[-1][2]
                continue
            depth = max(0, depth + sum(map(flat.count, "([{")) - sum(map(flat.count, ")]}")))
            if self.lines[-1][0] == n and _PY_HEAD.match(flat) and flat.rstrip().endswith(":"):
                depth = 0  # a head whose bracket isn't closed
            goes_on = flat.endswith("\\")

    @staticmethod
    def _width(line: str) -> int:
        return len(line[: len(line) - len(line.lstrip())].expandtabs(8))

    def _text_starts(self, raw: str, n: int) -> bool:
        """Whether a line that is blank without texts is a statement of its own: a text that starts on it."""
        return re.match(r"\s*[rRbBuUfF]{0,2}[\"']", raw) is not None and raw != self.flat[n] and not self._inside_text(n)

    def _inside_text(self, n: int) -> bool:
        if not hasattr(self, "within"):
            self.within, at = set(), 0
            for m in _PY_QUIET.finditer("\n".join(self.text)):
                if "\n" in m.group():
                    first = m.string.count("\n", 0, m.start())
                    self.within.update(range(first + 1, first + 1 + m.group().count("\n")))
        return n in self.within

    def read(self) -> None:
        todo: list[tuple[int, int, str | None, str | None]] = [(0, len(self.lines), None, None)]
        while todo:
            a, b, inside, caller = todo.pop()
            while a < b:
                width, end = self.lines[a][2], a + 1
                while end < b and self.lines[end][2] > width:
                    end += 1
                whole = end
                while whole < b and self.lines[whole][2] == width and (_PY_CLAUSE.match(self.flat[self.lines[whole][0]]) or self.flat[self.lines[whole - 1][0]].lstrip().startswith("@") and self.lines[whole - 1][2] == width):
                    whole += 1
                    while whole < b and self.lines[whole][2] > width:
                        whole += 1
                if self._parsed(a, whole, inside, caller):
                    a = whole
                    continue
                cls, by = self._head(a, end, inside, caller)
                if end > a + 1:
                    todo.append((a + 1, end, cls, by))
                a = end

    def _parsed(self, a: int, b: int, inside: str | None, caller: str | None) -> bool:
        first, last = self.lines[a][0], self.lines[b - 1][1]
        try:
            tree = ast.parse("if 1:\n" * (self.lines[a][2] > 0) + "\n".join(self.text[first:last + 1]) + "\n")
        except _UNREAD:
            return False
        _walk(tree, inside, caller, first - (self.lines[a][2] > 0), self.found, self.calls)
        return True

    def _head(self, a: int, end: int, inside: str | None, caller: str | None) -> tuple[str | None, str | None]:
        """Reads one logical line by its words; the class and function that hold its body."""
        first, last, _ = self.lines[a]
        flat = "\n".join(self.flat[first:last + 1])
        head = _PY_HEAD.match(flat)
        named = -1
        if head and (end > a + 1 or self._closed(flat, head.end() - 1)):
            named = head.end() - 1
            if name := head.group("f"):
                self.found.append(Definition(name, "method" if inside else "function", first + 1, self.lines[end - 1][1] + 1, inside))
            else:
                self.found.append(Definition(head.group("c"), "class", first + 1, self.lines[end - 1][1] + 1, None))
        by = head.group("f") if named >= 0 and head.group("f") else caller
        for m in _PY_CALL.finditer(flat):
            name = re.sub(r"\s+", "", m.group(2))
            # what stands behind the head of a function on its own line is its body
            holder = by if named >= 0 and m.start(2) > named else caller
            if m.end() - 1 != named and holder and not keyword.iskeyword(name):
                self.calls.append(Call(holder, name.rsplit(".", 1)[-1] if m.group(1) else name, first + 1 + flat.count("\n", 0, m.start(2))))
        return (head.group("c") or inside, by) if named >= 0 else (inside, caller)

    @staticmethod
    def _closed(flat: str, at: int) -> bool:
        """Whether the bracket of a head is closed, and a colon follows."""
        depth = 0
        for m in re.finditer(r"[()\[\]{}:]", flat[at:]):
            x = m.group()
            if x == ":" and not depth:
                return True
            depth += (x in "([{") - (x in ")]}")
        return False


_QUIET = {
    "c": re.compile(r"""//[^\n]*|/\*(?:[\s\S]*?\*/|[\s\S]*)|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|^[ \t]*\#(?:[^\n\\]|\\[\s\S])*""", re.M),
    "java": re.compile(r'''//[^\n]*|/\*(?:[\s\S]*?\*/|[\s\S]*)|"""[\s\S]*?"""|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*\''''),
    "go": re.compile(r"""//[^\n]*|/\*(?:[\s\S]*?\*/|[\s\S]*)|"(?:[^"\\\n]|\\.)*"|`[^`]*`|'(?:[^'\\\n]|\\.)*'"""),
    "javascript": re.compile(r"""//[^\n]*|/\*(?:[\s\S]*?\*/|[\s\S]*)|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\[\s\S])*`|(?<=[=(,:;!&|?{}\n])[ \t]*/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"""),
}
_NOT_NAMES = {
    "c": frozenset("if for while switch return else do sizeof case goto".split()),
    "java": frozenset("if for while switch catch return else do try synchronized new throw case super this assert instanceof".split()),
    "javascript": frozenset("if for while switch catch return else do try function new throw case typeof await yield delete void in of with super this".split()),
    "go": frozenset("if for switch return else func go defer select range case".split()),
}
#: A dotted name is taken as a whole, with the bracket behind it or not, so that no part of it is read again.
_CALL = re.compile(r"(?<![\w$.])(new\s+)?([A-Za-z_$][\w$]*+(?:\s*+(?:\.|->)\s*+[A-Za-z_$][\w$]*+)*+)(\s*+\()?")
_BRACKET = re.compile(r"[{}();]")


def _blank(m: re.Match) -> str:
    return re.sub(r"[^\n]", " ", m.group())


class _Head(NamedTuple):
    start: int       # of its first word
    named: int       # of its name
    opened: int      # of its body's brace
    kind: str
    name: str
    receiver: str | None = None


_WORD_BACK = re.compile(r"\s*([\w$]*[A-Za-z_$#])")
_RUN_BACK = {"c": re.compile(r"[\w\s*]*"), "java": re.compile(r"[\w<>\[\],.?\s]*")}
_JS_MODIFIER = re.compile(r"(?:(?<![\w$])(?:static|async|get|set)\s|\*)\s*\Z")
_JS_FUNCTION = re.compile(r"(?<![\w$])function\s*\*?\s*\Z")
_TYPE = {
    "c": (("struct", re.compile(r"\bstruct\s+(?P<n>[A-Za-z_]\w*)\s*\Z")),),
    "java": (("class", re.compile(r"\bclass\s+(?P<n>\w+)[^()]*\Z")),),
    "javascript": (("class", re.compile(r"\bclass\s+(?P<n>[\w$]+)[^()]*\Z")),),
    "go": (("struct", re.compile(r"(?:\btype\s+|(?:^|\n)[ \t]*)(?P<n>[A-Za-z_]\w*)(?:\[[^\]\n]*\])?[ \t]+struct[ \t]*\Z")), ("interface", re.compile(r"(?:\btype\s+|(?:^|\n)[ \t]*)(?P<n>[A-Za-z_]\w*)(?:\[[^\]\n]*\])?[ \t]+interface[ \t]*\Z"))),
}
_JAVA_THROWS = re.compile(r"\)\s*throws\s+[\w.,\s]+\Z")
_GO_FUNC = re.compile(r"\bfunc\s*(?P<r>\([^()]*\))?\s*(?P<n>[A-Za-z_]\w*)\s*(?:\[[^\]\n]*\])?\s*(?=\()")
_GO_RESULT = re.compile(r"[^\n{}();]+|\(|\{")


class _Text:
    """A blanked text of a brace language and its brackets. Every look backwards from a body stops at the
    bracket or semicolon before its head, so reading all heads takes time in proportion to the text."""

    def __init__(self, lang: str, text: str):
        self.lang, self.flat = lang, _QUIET[lang].sub(_blank, text)
        self.lines = [0] + [m.end() for m in re.finditer("\n", self.flat)]
        #: The closing bracket of each opening one and the other way round; depth of braces before each brace.
        self.match: dict[int, int] = {}
        self.pairs: dict[int, int] | None = None
        self.marks, self.depths, self.bodies = [], [], []
        stacks: dict[str, list[int]] = {"{": [], "(": []}
        depth = 0
        for m in _BRACKET.finditer(self.flat):
            at, ch = m.start(), m.group()
            self.marks.append(at)
            self.depths.append(depth)
            if ch in "{(":
                stacks[ch].append(at)
            elif ch in "})" and (stack := stacks["{" if ch == "}" else "("]):
                self.match[at] = opened = stack.pop()
                self.match[opened] = at
            if ch == "{":
                self.bodies.append(at)
                stacks["("].clear()  # no argument list goes over a brace, but for literals within it, which are no heads
            depth += (ch == "{") - (ch == "}")

    def line(self, at: int) -> int:
        return bisect.bisect_right(self.lines, at)

    def depth(self, at: int) -> int:
        """Open braces before a position."""
        k = bisect.bisect_left(self.marks, at)
        if k < len(self.marks):
            return self.depths[k]
        return self.depths[-1] + {"{": 1, "}": -1}.get(self.flat[self.marks[-1]], 0) if self.marks else 0

    def _from(self, at: int) -> int:
        """Behind the bracket or semicolon before a position."""
        k = bisect.bisect_left(self.marks, at)
        return self.marks[k - 1] + 1 if k else 0

    def heads(self) -> list[_Head]:
        out = self._go_functions() if self.lang == "go" else []
        for opened in self.bodies:
            if opened not in self.match:
                continue
            begin = self._from(opened)
            before = self.flat[begin:opened]
            for kind, pattern in _TYPE[self.lang]:
                if m := pattern.search(before):
                    out.append(_Head(begin + m.start(), begin + m.start("n"), opened, kind, m.group("n")))
            if self.lang != "go" and (head := self._function(begin, before, opened)):
                out.append(head)
        return sorted(out, key=lambda h: (h.start, -self.match[h.opened]))

    def _function(self, begin: int, before: str, opened: int) -> _Head | None:
        if self.lang == "java" and begin and self.flat[begin - 1] == ")" and (not before.strip() or _JAVA_THROWS.match(")" + before)):
            closed = begin - 1
        elif begin and self.flat[begin - 1] == ")" and not before.strip():
            closed = begin - 1
        else:
            return None
        if closed not in self.match:
            return None
        args = self.match[closed]
        lead = self.flat[self._from(args):args]
        back = _WORD_BACK.match(lead[::-1])
        if self.lang == "javascript":
            return self._js_function(lead, back, args, opened)
        if not back:
            return None
        name, named = back.group(1)[::-1], args - back.end()
        if name in _NOT_NAMES[self.lang]:
            return None
        run = _RUN_BACK[self.lang].match(lead[:len(lead) - back.end()][::-1]).group()[::-1]
        words = run.lstrip(" \t\n*" if self.lang == "c" else None)
        start = named - len(words)
        if self.lang == "c":
            ahead = self.flat[start - 1 - (len(run) - len(words)):start - (len(run) - len(words))]
            ok = re.match(r"[A-Za-z_]\w*[\s*]", words) and ahead not in tuple(".>=(,")
            return _Head(start, named, opened, "function", name) if ok else None
        if any(w in _NOT_NAMES["java"] for w in words.split()) or words and not words[-1].isspace():
            return None
        return _Head(start, named, opened, "member", name)

    def _js_function(self, lead: str, back: re.Match | None, args: int, opened: int) -> _Head | None:
        name = back.group(1)[::-1] if back else ""
        begin = args - len(lead)
        rest = lead[:len(lead) - back.end()] if back else lead
        if name == "function" or (m := _JS_FUNCTION.search(rest[-200:])):
            start = args - back.end() if name == "function" else begin + len(rest) - len(rest[-200:]) + m.start()
            return _Head(start, args if name == "function" else args - back.end(), opened, "function", "" if name == "function" else name)
        if not name or name in _NOT_NAMES["javascript"] or not re.match(r"[A-Za-z_$#]", name):
            return None
        named = args - back.end()
        while m := _JS_MODIFIER.search(rest[-200:]):
            rest = rest[:len(rest) - (len(rest[-200:]) - m.start())]
        start = begin + len(rest)
        ok = not rest.strip(" \t") and (begin == 0 or self.flat[begin - 1] in "{};") or rest.rstrip(" \t").endswith("\n")
        return _Head(start, named, opened, "member", name) if ok else None

    def _go_functions(self) -> list[_Head]:
        out = []
        for m in _GO_FUNC.finditer(self.flat):
            at = self._pair(m.end())
            while at is not None and (r := _GO_RESULT.match(self.flat, at)):
                if r.group() == "(":
                    at = self._pair(at)
                elif r.group() != "{":
                    at = r.end()
                elif re.search(r"\b(?:interface|struct)\s*\Z", self.flat[max(0, at - 60):at]):
                    at = self._pair(at)
                else:
                    if at in self.match:
                        out.append(_Head(m.start(), m.start("n"), at, "function", m.group("n"), m.group("r")))
                    break
        return out

    def _pair(self, at: int) -> int | None:
        """Behind the bracket that closes the one at a position, whatever the kinds of those between."""
        if self.pairs is None:
            self.pairs, stack = {}, []
            for k in self.marks:
                if self.flat[k] in "({":
                    stack.append(k)
                elif self.flat[k] in ")}" and stack:
                    self.pairs[stack.pop()] = k + 1
        return self.pairs.get(at)


def _innermost(stack: list, at: int):
    """Drops what ends before a position from a stack of (opened, closed, ...) and returns the last that holds it."""
    while stack and stack[-1][1] < at:
        stack.pop()
    return next((x for x in reversed(stack) if x[0] < at), None)


def _braces(lang: str, text: str) -> tuple[list[Definition], list[Call]]:
    source = _Text(lang, text)
    heads = source.heads()
    found, functions, seen, classes = [], [], set(), []
    for h in heads:
        closed = source.match[h.opened]
        around = _innermost(classes, h.start)
        type_, parent = h.kind, None
        if h.kind == "class":
            classes.append((h.opened, closed, h.name))
        elif h.kind == "member":
            if not around or lang == "javascript" and not any(c[0] < h.start and source.depth(h.start) - source.depth(c[0]) == 1 for c in reversed(classes)):
                continue
            type_, parent = "constructor" if lang == "java" and h.name == around[2] else "method", around[2]
        elif h.kind == "function":
            if lang == "javascript" and around:
                type_, parent = "method", around[2]
            elif lang == "go" and h.receiver:
                type_, parent = "method", re.sub(r"[\[\]].*$", "", (h.receiver.strip("() ").split() or [""])[-1].lstrip("*"))
            elif lang == "c" and source.depth(h.start) > 0:
                continue
        name, is_type = h.name or f"anonymous_{source.line(h.start)}", type_ in ("class", "struct", "interface")
        if (h.opened, is_type) in seen:
            continue
        seen.add((h.opened, is_type))
        found.append(Definition(name, type_, source.line(h.start), source.line(closed), parent))
        if not is_type:
            functions.append((h.opened, closed, name))
    functions.sort(key=lambda f: f[0])
    calls, named, holders, k = [], {h.named for h in heads}, [], 0
    for m in _CALL.finditer(source.flat):
        while k < len(functions) and functions[k][0] < m.start():
            _innermost(holders, functions[k][0])
            holders.append(functions[k])
            k += 1
        if not m.group(3) or m.group(1):
            continue
        callee = re.sub(r"\s+", "", m.group(2)).replace("->", ".")
        if callee in _NOT_NAMES[lang] or m.start(2) in named:
            continue
        if holder := _innermost(holders, m.start()):
            calls.append(Call(holder[2], callee, source.line(m.start(2))))
    return found, calls


#: The parser of each language: text in, definitions and calls out. Others may be added.
PARSERS = {"python": _python, **{lang: partial(_braces, lang) for lang in ("c", "java", "javascript", "go")}}
_PROBES = {"python": "def f(x):\n    return x\n", "c": "int f(int x) {\n  return x;\n}\n", "java": "class f {\n}\n", "javascript": "function f(x) {\n  return x;\n}\n", "go": "func f(x int) int {\n\treturn x\n}\n"}


def probed(lang: str) -> bool:
    """Whether the language has a parser that finds the one definition of a small text."""
    try:
        return [d.name for d in PARSERS[lang](_PROBES[lang])[0]] == ["f"]
    except Exception:  # whatever a missing or broken parser raises
        return False


def extract(path: str, content: bytes | None) -> tuple[list[Definition], list[Call]]:
    """What a file defines and calls, in order; nothing for unknown languages and other than UTF-8 text."""
    lang = language_of(path)
    if lang not in PARSERS or content is None:
        return [], []
    try:
        text = content.decode("utf-8-sig").replace("\r\n", "\n").replace("\r", "\n")
        found, calls = PARSERS[lang](text)
    except (UnicodeDecodeError, SyntaxError, ValueError, RecursionError):
        return [], []
    last = {(d.name, d.type, d.start): d for d in found}
    return sorted(last.values(), key=lambda d: (d.start, d.name)), sorted(calls, key=lambda c: c.line)
