"""One file in, its syntax errors out."""

from __future__ import annotations

import bisect
import sys

from .clang import CParser
from .golang import GoParser
from .javalang import JavaParser
from .jslang import JsParser
from .pylang import PyParser

# The language of each extension.
EXTENSIONS = {"py": "python", "js": "javascript", "ts": "javascript", "jsx": "javascript", "tsx": "javascript", "java": "java", "c": "c", "h": "c", "go": "go"}
_BRACES = {"javascript": JsParser, "java": JavaParser, "go": GoParser}
#: Python frames that a parse may nest; calls between Python functions take no C stack. Nesting beyond it (some
#: 100,000 brackets within each other) is reported as an error of its own kind.
DEPTH = 1_000_000


def language(path: str | None) -> str | None:
    name = (path or "").replace("\\", "/").rsplit("/", 1)[-1]
    stem, dot, ext = name.rpartition(".")
    return EXTENSIONS.get(ext.lower()) if dot and stem else None


def decode(content: bytes) -> str:
    """UTF-8, else UTF-16 by its mark, else Latin-1; without a byte-order mark."""
    if content[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return content.decode("utf-16", "replace").lstrip("﻿")
    try:
        return content.decode("utf-8-sig")
    except UnicodeDecodeError:
        return content.decode("latin-1")


def syntax_errors(lang: str, text: str, positions: bool = True) -> list[tuple[int, str]]:
    """(line, reason) of every error, in order; with ``positions`` off, lines are 0 and cheap."""
    if sys.getrecursionlimit() < DEPTH:
        sys.setrecursionlimit(DEPTH)
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    try:
        if lang == "python":
            lexer = PyParser.LEX
            found = PyParser(*PyParser.split(text)).run()
        elif lang == "c":
            lexer = CParser.LEX
            found = CParser.check(lexer.shape(text))
        else:
            lexer = _BRACES[lang].LEX
            found = _BRACES[lang](lexer.shape(text)).run()
    except RecursionError:
        return [(0, "nested too deeply")]
    if not found or not positions:
        return [(0, why) for _, why in found]
    at = lexer.offsets(text)
    if lang == "javascript":  # positions don't count line ends
        raw = lexer.shape(text)
        at = [x for x, k in zip(at, raw) if lexer.names[k] != "NL"]
    starts = [0] + [n + 1 for n, ch in enumerate(text) if ch == "\n"]
    return [(bisect.bisect_right(starts, at[p]) if p < len(at) else len(starts), why) for p, why in found]
