"""Shell patterns as regular expressions, and brace alternatives."""

from __future__ import annotations

import re

SEPARATORS = "\\/"


def braces(pattern: str) -> list[str]:
    """All expansions of ``{a,b}``, nested; a group without a comma or without its end is literal."""
    depth, start = 0, -1
    for i, c in enumerate(pattern):
        if c == "{":
            if depth == 0:
                start = i
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                parts = _split(pattern[start + 1 : i])
                if len(parts) > 1:
                    rest = braces(pattern[i + 1 :])
                    return [pattern[:start] + x + r for p in parts for x in braces(p) for r in rest]
    return [pattern]


def _split(inner: str) -> list[str]:
    out, depth, last = [], 0, 0
    for i, c in enumerate(inner):
        depth += (c == "{") - (c == "}")
        if c == "," and depth == 0:
            out.append(inner[last:i])
            last = i + 1
    return [*out, inner[last:]]


def _segment(pattern: str, any_char: str) -> str:
    """One segment without ``**``: ``*``, ``?``, ``[a-z]``, ``[^a]`` and ``\\`` before a special character."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append(f"{any_char}*")
        elif c == "?":
            out.append(any_char)
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            inside = pattern[i + 1 : end]
            negated = inside[:1] in ("^", "!")
            body = inside[negated:].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append(f"[{'^' if negated else ''}{body}]")
            i = end
        elif c == "\\" and i + 1 < len(pattern) and pattern[i + 1] in "*?[]\\{}":
            out.append(re.escape(pattern[i + 1]))
            i += 1
        else:
            out.append(re.escape(c))
        i += 1
    return "".join(out)


def name_regex(pattern: str) -> str:
    """A pattern for a whole file name; ``*`` and ``?`` don't cross separators."""
    return f"^(?:{_segment(pattern, '[^\\\\/]')})$"


def path_regex(pattern: str) -> str:
    """A pattern for a path with ``/``: ``**`` is any number of whole segments, a relative pattern matches at any depth."""
    pattern = pattern.replace("\\", "/")
    absolute = pattern.startswith("/") or re.match(r"^[A-Za-z]:", pattern) is not None
    out = ["^" if absolute else "^(?:.*/)?"]
    parts = pattern.split("/")
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if part == "**":
            out.append(".*" if last else "(?:[^/]+/)*")
        else:
            out.append(_segment(part, "[^/]") + ("" if last else "/"))
    return "".join(out) + "$"


def is_glob(text: str) -> bool:
    return any(c in text for c in "*?[") or len(braces(text)) > 1


def is_path_glob(text: str) -> bool:
    return "**" in text or any(c in text for c in SEPARATORS)


def plain_extensions(pattern: str) -> list[str] | None:
    """``*.c`` or ``*.{c,h}``: the extensions, if the pattern asks for nothing else."""
    found = [re.fullmatch(r"\*\.([^.*?\[\]{}\\/]+)", p) for p in braces(pattern)]
    return [m.group(1) for m in found] if all(found) else None
