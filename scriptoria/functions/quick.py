"""The same test by a pattern that Java's engine fails sooner.

A pattern that opens with "start, or no word character" tries a class of all letters at each place of a text. Here the first
character that may follow is tried before that, and the bounds are looked at, not taken along. That is the same for a
yes or no; what a match takes along differs, so patterns that extract or replace stay as they are.
"""

from __future__ import annotations

from functools import lru_cache

_WORD = r"[\p{L}\p{N}_]"
_OPEN, _CLOSE = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"
#: The letter beyond the first plane is of the class anyway; it makes the engine look back by whole characters.
BEHIND, _AHEAD = "(?<![\\p{L}\\p{N}_\U00010000])", rf"(?!{_WORD})"
_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _unit(p: str) -> str:
    """The first element of a pattern, without its quantifier."""
    if p[0] == "\\":
        return p[:2] if p[1] not in "pPxu" else ""
    if p[0] not in "([":
        return p[0] if p[0] not in ".^$|)*+?{" else ""
    depth, inside, i = 0, False, 0
    while i < len(p):
        c = p[i]
        if c == "\\":
            i += 1
        elif inside:
            inside = c != "]"
        elif c == "[":
            inside = True
        elif c in "()":
            depth += 1 if c == "(" else -1
        if depth == 0 and not inside:
            return p[: i + 1]
        i += 1
    return ""


def _branches(p: str) -> list[str]:
    """The alternatives of a pattern."""
    out, at, i = [], 0, 0
    while i < len(p):
        if p[i] == "|":
            out.append(p[at:i])
            at = i = i + 1
        elif p[i] == "\\":
            i += 2
        else:
            i += len(_unit(p[i:]) or p[i])
    return [*out, p[at:]]


def _firsts(p: str) -> str | None:
    """What stands in a class of the characters a match can begin with; None if that is not plain."""
    unit = _unit(p) if p else ""
    if not unit or p[len(unit) : len(unit) + 1] in ("*", "?", "{"):
        return None
    if unit.startswith("(?:"):
        found = [_firsts(b) for b in _branches(unit[3:-1])]
        return None if None in found else "".join(dict.fromkeys("".join(found))) if all(len(f) == 1 for f in found) else "".join(found)
    if unit[0] == "[":
        return None if unit[1] == "^" or "\\p" in unit or "[" in unit[1:] else unit[1:-1]
    return None if unit[0] == "(" or unit in ("\\d", "\\w", "\\s", "\\b") else unit if unit[0] == "\\" or unit.isalnum() else "\\" + unit


def _by_letter(p: str) -> str:
    """A group of alternatives by their first letter."""
    if not (p.startswith("(?:") and _unit(p) == p):
        return p
    groups: dict[str, list[str]] = {}
    for b in _branches(p[3:-1]):
        plain = b[:1].lower() in _LETTERS and b[:1] != "" and b[1:2] not in ("*", "+", "?", "{")
        groups.setdefault(b[0] if plain else f"={b}", []).append(b)
    return "(?:" + "|".join(b[0] if len(b) == 1 else f"{first}(?:{'|'.join(x[1:] for x in b)})" for first, b in groups.items()) + ")"


@lru_cache(maxsize=None)
def quick(pattern: str) -> str:
    """A pattern that is found in the same texts."""
    flags = "(?i)" if pattern.startswith("(?i)") else ""
    out = []
    for branch in _branches(pattern[len(flags) :]):
        if branch.startswith(_OPEN):
            rest, end = branch[len(_OPEN) :], ""
            if rest.endswith(_CLOSE):
                rest, end = rest[: -len(_CLOSE)], _AHEAD
            firsts = _firsts(rest)
            branch = (f"(?=[{firsts}])" if firsts else "") + BEHIND + _by_letter(rest) + end
        out.append(branch)
    return flags + "|".join(out)
