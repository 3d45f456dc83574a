"""Lines that define a name, told by the language of a file: which words introduce a name, and how a function begins.

Each language is described by *introductions* (words behind which the defined name stands) and *heads* (a function that
no word introduces: types, or the class that it belongs to, before the name, and an argument list behind it). Patterns
are made from the description for the one name that is looked for. They never go back over what they have read
(possessive), so a long line costs one reading.
"""

from __future__ import annotations

import operator
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions per language, and words that begin statements which define nothing.
LANGUAGES = {
    "go": "go", "c": "c cc cpp cxx h hh hpp hxx inl ipp m mm", "py": "py pyi", "js": "js jsx ts tsx mjs cjs mts cts", "rs": "rs",
    "java": "java cs kt kts scala swift"
}
CONTROL = "return if else while for switch case do new delete throw goto sizeof await yield not and or in assert print co_return co_await using friend".split()

#: Optional text in brackets: arguments of a receiver, parameters of a template or of a type.
RECEIVER, PARAMETERS = r"(?:\([^)]*+\)\s*+)?", r"(?:<[^>]*+>\s*+)?"


@dataclass(frozen=True)
class Introduction:
    """Words that introduce a name. ``first``: they begin the line, behind any of ``modifiers``; else they stand anywhere.

    ``between`` may stand before the name, ``behind`` must follow it. ``body``: a line that only declares is none.
    """

    words: str
    first: bool = True
    modifiers: str = ""
    before: str = ""
    between: str = ""
    behind: str = r"\b"
    body: bool = False

    def pattern(self, name: str) -> str:
        start = r"^\s*+" + self.before if self.first else r"\b"
        options = "".join(rf"(?:{m}\s++)?" for m in self.modifiers.split())
        words = "|".join(w.replace("+", r"\s++") if w.isascii() and w.replace("+", "").isalpha() else w for w in self.words.split())
        return rf"{start}{options}(?:{words})\s++{self.between}{name}{self.behind}"


@dataclass(frozen=True)
class Head:
    """A function without an introducing word: at least one type, made of ``letters``, or its class with ``::``, before the name."""

    letters: str
    pointers: str = ""
    member: bool = False
    body: bool = True

    def pattern(self, name: str) -> str:
        owner = r"(?:\w++::)" if self.member else ""
        here = (rf"{owner}++~?" if owner else "") + rf"{name}\s*+\("
        types = rf"(?:(?!{here})[{self.letters}]++[\s{self.pointers}]++)"
        return (r"^" if self.member else r"^\s*+") + types + ("*+" if self.member else "++") + here


@dataclass(frozen=True)
class Method:
    """A method of a class body: modifiers, the name, arguments, perhaps a type, and the brace that opens its body."""

    modifiers: str
    body: bool = False

    def pattern(self, name: str) -> str:
        words = self.modifiers.split()
        return rf"^\s*+(?:(?:{'|'.join(words)})\s++){{0,{len(words)}}}{name}\s*+{PARAMETERS}\([^;]*\)\s*+(?::[^={{;]*+)?\{{\s*+$"


@dataclass(frozen=True)
class Assigned:
    """A name at the very beginning of a line that a value is assigned to, perhaps with a type."""

    body: bool = False

    def pattern(self, name: str) -> str:
        return rf"^{name}\s*+(?::[^=]*+)?=(?!=)."


C_TYPE = r"\w:<>,~"
DESCRIPTIONS = {
    "go": [Introduction("func", between=RECEIVER), Introduction("type var const")],
    "c": [
        Introduction("class struct union enum+class "
            "enum", modifiers="typedef", before=rf"(?:template\s*+{PARAMETERS})?", between=r"(?:(?!{name}\b)\w++\s++)?", body=True),
        Introduction(r"#\s*+define"), Head(C_TYPE + "*&", member=True), Head(C_TYPE, pointers="*&"),
    ],
    "py": [Introduction("def", modifiers="async"), Introduction("class"), Assigned()],
    "js": [
        Introduction("function", first=False, between=r"(?:\*\s*+)?"), Introduction(r"function\*", first=False), Introduction("class", modifiers="export default abstract"), Introduction("const let var", modifiers="export", behind=r"\s*+[=:]"),
        Introduction("interface type enum namespace", modifiers="export declare"),
        Method("public private protected static async readonly override get set")
    ],
    "rs": [Introduction("fn struct enum trait type union mod const static", first=False), Introduction("macro[_]rules!", first=False)],
    "java": [Introduction("class interface enum record struct "
        "object", first=False), Introduction("fun", first=False, between=PARAMETERS + r"(?:\w++\.)*+"), Head(r"\w<>\[\],?@.")],
    "": [Introduction("fn func function def fun sub proc class struct interface enum trait type module", first=False)],
}


def patterns(language: str, name: str) -> list[tuple[str, bool]]:
    """The expressions for one name, and whether each needs more than a declaration."""
    quoted = re.escape(name)
    return [(shape.pattern(quoted).replace("{name}", quoted), shape.body) for shape in DESCRIPTIONS[language]]


def definition_line(line: Column, name: str) -> Column:
    """Whether a line defines a name, by the language of the entry's extension (``ext_l``).

    Comments and control statements define nothing; neither does, in languages that declare beforehand, a line that
    ends in a semicolon and opens no body.
    """
    declares = F.rtrim(line, F.lit(" \t\r")).endswith(";") & ~line.contains("{")
    out = None
    for language, exts in [*LANGUAGES.items(), ("", "")]:
        hit = reduce(operator.or_, [line.rlike(p) & ~declares if body else line.rlike(p) for p, body in patterns(language, name)])
        if language != "c":
            hit = hit & ~line.rlike(r"^\s*#")
        out = (
            F.when(F.col("ext_l").isin(exts.split()), hit)
            if out is None
            else out.when(F.col("ext_l").isin(exts.split()), hit)
            if exts
            else out.otherwise(hit)
        )
    return line.contains(name) & ~line.rlike(rf"^\s*(//|/?\*|({'|'.join(CONTROL)})\b)") & out
