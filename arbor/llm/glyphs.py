"""One consistent spelling for text that looks the same on screen.

Pure Python, no Spark, but for ``look_alikes``, which asks the session. ``Glyphs.canonical(text)`` works in four steps:

1. characters nobody sees are removed, every single blank becomes U+0020, and
   full-width, ligature, joined and styled forms become their plain letters; hyphens become '-', and the
   modifier apostrophe the closing quote. Dashes of other lengths, and straight and curly quotes, differ on
   screen and stay apart, as do circled letters and digits;
2. each letter gets the set of scripts it could be read in: a letter without
   look-alike only its own, a look-alike also those of its twins;
3. the sets are intersected over a token. One script left: the token is spelled
   in it. Several left (the whole token is a look-alike) or none (a mixed token):
   the script that most letters *without* look-alike of the text belong to decides.
   Those letters are the same in every visual copy of a text, so all copies get
   one spelling;
4. the result is composed (NFC).

Letter case, accents, digits, line breaks and the number of blanks are kept.

Look-alikes are the letters of one case that have one prototype in the Unicode confusables (about
900 letters of many scripts), as the ICU library that Spark brings holds them; the rows of LOOKALIKES take precedence.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np

# Letters that are drawn alike, as (Latin, Cyrillic, Greek); '' where a script has none.
LOOKALIKES = (
    ("A", "А", "Α"), ("B", "В", "Β"), ("C", "С", "Ϲ"), ("E", "Е", "Ε"), ("H", "Н", "Η"),
    ("I", "І", "Ι"), ("J", "Ј", "Ϳ"), ("K", "К", "Κ"), ("M", "М", "Μ"), ("N", "", "Ν"),
    ("O", "О", "Ο"), ("P", "Р", "Ρ"), ("S", "Ѕ", ""), ("T", "Т", "Τ"), ("X", "Х", "Χ"),
    ("Y", "У", "Υ"), ("Z", "", "Ζ"), ("Q", "Ԛ", ""), ("W", "Ԝ", ""), ("G", "Ԍ", ""), ("V", "Ѵ", ""),
    ("a", "а", "α"), ("c", "с", "ϲ"), ("d", "ԁ", ""), ("e", "е", ""), ("h", "һ", ""),
    ("i", "і", "ι"), ("j", "ј", "ϳ"), ("l", "ӏ", ""), ("o", "о", "ο"), ("p", "р", "ρ"),
    ("q", "ԛ", ""), ("s", "ѕ", ""), ("u", "", "υ"), ("v", "ѵ", "ν"), ("w", "ԝ", ""),
    ("x", "х", ""), ("y", "у", ""), ("k", "", "κ"),
)
#: Code points whose letters are compared: no ideographs, syllables of Hangul or private use.
_LETTERS = ((0x41, 0x3400), (0xA000, 0xAC00), (0xFB00, 0x10000), (0x10000, 0x12000), (0x16000, 0x17000), (0x1D000, 0x1F000))


def _own_case(ch: str, prototype: str) -> str:
    """'u' or 'l'; letters without case go with their prototype."""
    like = ch if ch.isupper() or ch.islower() else prototype
    return "u" if like.isupper() else "l"


def classes_of(codes: list[int], prototypes: list[str]) -> tuple[tuple[str, ...], ...]:
    """Classes of look-alikes from the prototype of every code point, below LOOKALIKES."""
    fixed = {c for row in LOOKALIKES for c in row if c}
    group: dict[tuple[str, str], list[str]] = defaultdict(list)
    for code, prototype in zip(codes, prototypes):
        ch = chr(code)
        if len(prototype) == 1 and prototype.isalpha() and ch not in fixed and unicodedata.normalize("NFKD", ch) == ch:
            group[prototype, _own_case(ch, prototype)].append(ch)
    rows = []
    for row in LOOKALIKES:
        latin = row[0]
        rows.append((*(c for c in row if c), *group.pop((latin, _own_case(latin, latin)), ())))
        if latin == "I":  # its prototype is 'l'
            rows[-1] += tuple(group.pop(("l", "u"), ()))
    return tuple(rows) + tuple(tuple(x) for x in group.values() if len(x) > 1)


def look_alikes(spark) -> tuple[tuple[str, ...], ...]:
    """The classes of look-alikes of the session's ICU library; those of LOOKALIKES where it has none."""
    codes = [c for a, b in _LETTERS for c in range(a, b) if chr(c).isalpha()]
    try:
        checker = spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker
        found = getattr(checker, "Builder")().setChecks(checker.CONFUSABLE).build().getSkeleton("\n".join(map(chr, codes))).split("\n")
    except TypeError:  # no such class
        found = []
    return classes_of(codes, found) if len(found) == len(codes) else tuple(tuple(c for c in row if c) for row in LOOKALIKES)


def _plain(ch: str) -> str | None:
    """What a single character is replaced with before scripts are looked at; None: itself."""
    kind = unicodedata.category(ch)
    if kind == "Cf" or ch in "\u034f\u115f\u1160\u17b4\u17b5\u3164" or 0xFE00 <= ord(ch) <= 0xFE0F or 0xE0100 <= ord(ch) <= 0xE01EF:
        return ""
    if kind == "Zs" or ch == "\t":
        return " " if ch != " " else None
    if ch in "\u2010\u2011\ufe63":
        return "-"
    if ch == "\u02bc":
        return "\u2019"
    tag, _, parts = unicodedata.decomposition(ch).partition(" ")
    if tag in ("<wide>", "<narrow>", "<font>", "<square>") or ch == "…":
        return unicodedata.normalize("NFKC", ch)
    if tag == "<compat>" and kind[0] == "L" and len(parts.split()) > 1:  # ligatures and digraphs
        return unicodedata.normalize("NFKC", ch)
    return None


#: Code points that can have a plain form: no ideographs, syllables or private use.
_RANGES = ((0x09, 0x3400), (0xA000, 0xAC00), (0xFB00, 0x10000), (0x1D400, 0x1D800), (0xE0000, 0xE01F0))


def _table() -> dict[int, str]:
    codes = (c for a, b in _RANGES for c in range(a, b))
    return {c: plain for c in codes if (plain := _plain(chr(c))) is not None}


_PLAIN = _table()
_TOKEN = re.compile("[^\\W\\d_][\\w\\u0300-\\u036f]*")
_MARKED = re.compile("([^\\W\\d_])([\u0300-\u036f])")
#: Kinds of characters; those of a text are found in one pass over its code points.
SPECIAL, MARK, FOREIGN, NOT_PLAIN_CYRILLIC, PLAIN_CYRILLIC = 1, 2, 4, 8, 16
_END = 0xE01F0
#: Letters of choice of the scripts that have many others.
_USUAL = {"LATIN": ("A", "\u00ff"), "CYRILLIC": ("А", "я"), "GREEK": ("\u0391", "\u03c9")}


@lru_cache(maxsize=100_000)
def _script(ch: str) -> str:
    """The script of a letter, by the first word of its name; '' for other characters."""
    return unicodedata.name(ch, "").split(" ")[0].partition("-")[0] if ch.isalpha() else ""


def unseen_removed(text: str) -> str:
    """Step 1 alone."""
    if text.isascii():
        return text.replace("\u0130", "I\u0307") if "\t" in text else text
    return text.translate(_PLAIN)


def _first_made(letters, marks: str) -> str | None:
    """The first letter that makes one character with the marks, with them."""
    return next((made for x in letters if len(made := unicodedata.normalize("NFC", x + marks)) == 1), None)


class Glyphs:
    """Spellings by given classes of look-alikes."""

    def __init__(self, classes: tuple[tuple[str, ...], ...]):
        self.classes = classes
        #: The class of each look-alike, as {script: letter}; of several of a script, the one with the smallest code.
        self.twins: dict[str, dict[str, str]] = {}
        scripts = set()
        for row in classes:
            by_script: dict[str, str] = {}
            for ch in sorted(row):
                by_script.setdefault(_script(ch), ch)
            scripts.update(by_script)
            for ch in row:
                self.twins[ch] = by_script
        self.order = ["LATIN", "CYRILLIC", "GREEK", *sorted(scripts - {"LATIN", "CYRILLIC", "GREEK", ""})]
        self.bit = {s: 1 << n for n, s in enumerate(self.order)}
        self.every = (1 << len(self.order)) - 1
        self.kinds_of = self._kinds_table()
        self.joined_by = self._joined_letters()
        self.folded = self._skeleton_table()
        self.readings, self.spell = lru_cache(maxsize=8192)(self._readings), lru_cache(maxsize=50_000)(self._spell)
        self.with_mark, self.lowers = lru_cache(maxsize=4096)(self._with_mark), lru_cache(maxsize=4096)(self._lowers)
        self.same_word = lru_cache(maxsize=50_000)(self._same_word)

    def __reduce__(self):
        return of, (self.classes,)

    def _kinds_table(self) -> np.ndarray:
        table = np.zeros(_END, np.uint8)
        for a, b in zip((0x3400, 0xAC00, 0x12000), (0xA000, 0xD7A4, _END)):
            table[a:b] = FOREIGN | NOT_PLAIN_CYRILLIC
        for ch in (chr(c) for a, b in _LETTERS for c in range(a, b) if chr(c).isalpha()):
            base = unicodedata.normalize("NFD", ch)[0]
            usual = "А" <= ch <= "я"
            if _script(base) == "LATIN":
                kind = NOT_PLAIN_CYRILLIC
            else:
                kind = FOREIGN | (0 if usual and base in self.twins else PLAIN_CYRILLIC if usual else NOT_PLAIN_CYRILLIC)
            if base in self.twins and self.twins[base].get("LATIN") != base and not usual:
                kind |= FOREIGN | NOT_PLAIN_CYRILLIC
            table[ord(ch)] = kind
        table[list(_PLAIN)] = SPECIAL
        table[0x300:0x370] |= MARK
        return table

    def kinds(self, text: str) -> int:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return int(np.bitwise_or.reduce(self.kinds_of[np.minimum(codes, _END - 1)])) if len(codes) else 0

    def _dominant(self, decomposed: str) -> int:
        """The script of most letters that have no look-alike elsewhere; Latin if there is none."""
        votes = Counter()
        for ch, n in Counter(decomposed).items():
            if ch not in self.twins and (s := self.bit.get(_script(ch))):
                votes[s] += n
        return max(votes, key=lambda s: (votes[s], -s)) if votes else 1

    def _readings(self, ch: str, mark: str) -> int:
        """The scripts a letter (with the mark that follows it, or '') can be spelled in.
        Equal for all look-alikes. A twin outside the usual Latin, Cyrillic or Greek letters, or one
        that doesn't compose with the mark while another does, is no spelling of choice."""
        row = self.twins.get(ch)
        if row is None:
            return self.bit.get(_script(ch), 0)
        spelled = [(s, x) for s, x in row.items() if s in self.bit]
        usual = [(s, x) for s, x in spelled if s not in _USUAL or _USUAL[s][0] <= x <= _USUAL[s][1]] or spelled
        if mark:
            usual = [(s, x) for s, x in usual if len(unicodedata.normalize("NFC", x + mark)) == 1] or usual
        return sum(self.bit[s] for s, _ in usual)

    def token_scripts(self, token: str) -> tuple[int, bool]:
        """(intersection of the letters' script sets, whether the token mixes scripts as written)."""
        common, written = self.every, 0
        for ch, after in zip(token, token[1:] + " "):
            if own := self.bit.get(_script(ch)):
                written |= own
                common &= self.readings(ch, after if "\u0300" <= after <= "\u036f" else "")
        return common, written & (written - 1) != 0

    def _spell(self, token: str, dominant: int) -> str:
        common, _ = self.token_scripts(token)
        want = common if common and not common & (common - 1) else dominant if common & dominant or not common else common & -common
        script = self.order[want.bit_length() - 1]
        out = []
        for ch in token:
            row = self.twins.get(ch)
            out.append(ch if row is None else row.get(script) or min(row.items(), key=lambda x: self.bit.get(x[0], 1 << 99))[1])
        return "".join(out)

    def canonical(self, text: str) -> str:
        """The one form under which visual copies of ``text`` are equal."""
        if text.isascii():
            return unseen_removed(text)
        kinds = self.kinds(text)
        if kinds & SPECIAL:
            text = unseen_removed(text)
            kinds = self.kinds(text)
        if not kinds & FOREIGN or kinds & PLAIN_CYRILLIC and not kinds & (NOT_PLAIN_CYRILLIC | MARK):
            return unicodedata.normalize("NFC", text)
        apart = unicodedata.normalize("NFD", text)
        dominant = self._dominant(apart)
        return unicodedata.normalize("NFC", _TOKEN.sub(lambda m: self.spell(m.group(), dominant), apart))

    def _joined_letters(self) -> dict[str, tuple[str, ...]]:
        """Small letters joined by looks or case, in any number of steps; Latin ones first."""
        group: dict[str, set[str]] = {}
        for row in self.classes:
            whole = set().union(*(group.get(x, {x}) for x in {c.lower() for c in row} if len(x) == 1))
            for x in whole:
                group[x] = whole
        return {x: tuple(sorted(whole)) for x, whole in group.items()}

    def _with_mark(self, ch: str, mark: str) -> str:
        near = list(self.twins.get(ch, {}).values())
        far = [x.upper() if ch.isupper() else x for x in self.joined_by.get(ch.lower(), ())]
        return _first_made([*near, *far], mark) or ch + mark

    def joined(self, text: str) -> str:
        """Step 1 and NFC, where a letter that makes no character with its mark takes a look-alike that does. A word's
        end never depends on the look-alikes chosen; 'İ' stays apart, as in small letters."""
        if text.isascii():
            return unseen_removed(text)
        kinds = self.kinds(text)
        text = unicodedata.normalize("NFC", unseen_removed(text) if kinds & SPECIAL else text)
        if kinds & (MARK | SPECIAL):
            text = _MARKED.sub(lambda m: self.with_mark(*m.groups()), text)
        return text.replace("\u0130", "I\u0307")

    def _skeleton_table(self) -> dict[int, str]:
        out = {ord("ς"): "σ"}
        codes = {*range(0x61, 0x7B), *range(0xC0, 0x530), *range(0x1E00, 0x2000), *map(ord, self.joined_by)}
        for code in codes:
            ch = chr(code)
            apart = unicodedata.normalize("NFD", ch)
            if apart[0] in self.joined_by and ch == ch.lower() and (made := _first_made(self.joined_by[apart[0]], apart[1:])) and made != ch:
                out[code] = made
        if made := out.get(ord("σ")):
            out[ord("ς")] = made
        return out

    def skeleton(self, word: str) -> str:
        """One form for all spellings of a word of ``joined`` that look alike or differ in case, whatever text it is in."""
        return word.lower().translate(self.folded)

    def _lowers(self, ch: str) -> frozenset[str]:
        """The small letters that a letter can stand for."""
        return frozenset(x.casefold() for x in self.twins.get(ch, {"": ch}).values())

    def _same_word(self, a: str, b: str) -> bool:
        """Whether words of one skeleton look alike but for case. Letters of one script must be the same letter or look alike."""
        if a.lower() == b.lower():
            return True
        a, b = unicodedata.normalize("NFD", a), unicodedata.normalize("NFD", b)
        return len(a) == len(b) and all(x.casefold() == y.casefold() or self.twins.get(x, x) is self.twins.get(y, y) or _script(x) != _script(y) and self.lowers(x) & self.lowers(y) for x, y in zip(a, b))

    def findings(self, text: str) -> tuple[int, int, int]:
        """(special characters, mixed-script tokens, whole-script look-alike tokens against the text's script)."""
        special = sum(map(text.count, {c for c in set(text) if ord(c) in _PLAIN}))
        if text.isascii() or not self.kinds(text) & FOREIGN:
            return special, 0, 0
        apart = unicodedata.normalize("NFD", unseen_removed(text))
        dominant, mixed, whole = self._dominant(apart), 0, 0
        for token in _TOKEN.findall(apart):
            common, is_mixed = self.token_scripts(token)
            mixed += is_mixed
            whole += not is_mixed and bool(common & dominant) and not all(self.bit.get(_script(c), 0) in (0, dominant) for c in token)
        return special, mixed, whole


_KNOWN: dict[tuple[tuple[str, ...], ...], Glyphs] = {}


def of(classes: tuple[tuple[str, ...], ...]) -> Glyphs:
    """One object per process for each set of classes."""
    if classes not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[classes] = Glyphs(classes)
    return _KNOWN[classes]
