"""Text scalars: words, sentences, lines, slugs, dates, printable share.

Every function takes SQL text for its argument and a dialect, and gives SQL text. Patterns keep to what Java and RE2
read alike: word characters are spelled out, a word's bounds are classes, not \\b.
"""

from __future__ import annotations

import unicodedata

from .dialect import SPARK, Dialect

W = r"[\p{L}\p{N}_]"
NOT_W = r"[^\p{L}\p{N}_]"
SPACE = r"[ \t\n\r\f]"
WORD = W + "+"


def bounded(alternatives: str, flags: str = "(?i)") -> str:
    """A pattern for one of the alternatives as whole words."""
    return f"{flags}(?:^|{NOT_W})(?:{alternatives})(?:$|{NOT_W})"


def words(x: str, d: Dialect = SPARK) -> str:
    return d.count(x, WORD)


def tokens(x: str, d: Dialect = SPARK) -> str:
    """Runs of other than white space."""
    return d.count(x, r"[^ \t\n\r\f]+")


def squeezed(x: str, d: Dialect = SPARK) -> str:
    """Runs of white space as one space, none at the ends."""
    return f"trim({d.sub(x, SPACE + '+', ' ')})"


def stripped(x: str, d: Dialect = SPARK) -> str:
    return d.sub(x, rf"^{SPACE}+|{SPACE}+$", "")


def lines(x: str, d: Dialect = SPARK) -> str:
    """The stripped lines that are not blank."""
    return d.keep(d.each(d.split(x, "chr(10)"), "l", stripped("l", d)), "l", "l <> ''")


def sentences(x: str, d: Dialect = SPARK) -> str:
    """Split at white space between a sentence end and a capital letter or digit."""
    mark = "chr(31)"
    if d.spark:
        cut = f"regexp_replace({x}, {d.text(rf'([.!?]){SPACE}+(?=[A-Z0-9])')}, concat('$1', {mark}))"
    else:
        cut = f"regexp_replace({x}, {d.text(rf'([.!?]){SPACE}+([A-Z0-9])')}, concat('\\1', {mark}, '\\2'), 'g')"
    return d.keep(d.each(d.split(cut, mark), "s", stripped("s", d)), "s", "s <> ''")


def is_upper(x: str) -> str:
    """Some letter has case, and none is lower case."""
    return f"({x} = upper({x}) and {x} <> lower({x}))"


def _folds() -> tuple[str, str, list[tuple[str, str]]]:
    """From the rule that a slug keeps the ASCII part of the compatibility decomposition: (characters, their letters, characters of several letters)."""
    one, several = {}, []
    for block in (range(0xA0, 0x250), range(0x1E00, 0x1F00), range(0x2000, 0x2190), range(0x2460, 0x24EB), range(0xFB00, 0xFB07), range(0xFF01, 0xFF5F)):
        for char in map(chr, block):
            plain = unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode()
            plain = "".join(c if c.isalnum() or c in "-_" else " " for c in plain)  # a slug has no other signs
            if len(plain) == 1:
                one[char] = plain
            elif plain:
                several.append((char, plain))
    return "".join(one), "".join(one.values()), several


FOLD_FROM, FOLD_TO, FOLD_LONG = _folds()


def folded(x: str, d: Dialect = SPARK) -> str:
    """Letters without their accents, ligatures and numbers in a circle or raised as plain ones; what is then not ASCII goes."""
    wide = r"[^\x00-\x7F]"
    longer = x
    if d.spark:  # one expression that loops over the pairs; a call in a call for each is too large a method to be compiled
        pairs = ", ".join(f"struct({d.text(char)} as c, {d.text(plain)} as p)" for char, plain in FOLD_LONG)
        longer = f"aggregate(array({pairs}), {x}, (t, f) -> replace(t, f.c, f.p))"
    else:
        for char, plain in FOLD_LONG:
            longer = f"replace({longer}, {d.text(char)}, {d.text(plain)})"
    # the long ones are tried only where there is one
    some = f"case when {d.has(x, '[' + ''.join(c for c, _ in FOLD_LONG) + ']')} then {longer} else {x} end"
    return f"case when {d.has(x, wide)} then {d.sub(f'translate({some}, {d.text(FOLD_FROM)}, {d.text(FOLD_TO)})', wide, '')} else {x} end"


def slug(x: str, most: int, d: Dialect = SPARK) -> str:
    """Folded to ASCII, lower case, words joined by single hyphens, cut to ``most`` characters; 'unknown' if empty."""
    if d.spark:  # the same in one pass: what is neither letter nor digit ends up as a hyphen, and runs of those as one
        plain = d.sub(f"lower({folded(x, d)})", "[^a-z0-9]+", "-")
        cut = f"trim(trailing '-' from substr(trim(both '-' from {plain}), 1, {most}))"
        return f"coalesce(nullif({cut}, ''), 'unknown')"
    plain = d.sub(d.sub(d.sub(f"lower({folded(x, d)})", r"[^a-z0-9_ \t\n\r\f-]", " "), r"[ \t\n\r\f_]+", "-"), "-+", "-")
    whole = d.sub(plain, "^-|-$", "")
    cut = d.sub(f"substr({whole}, 1, {most})", "-$", "")
    return f"coalesce(nullif({cut}, ''), 'unknown')"


#: A day of 2000 to 2099, with separators or compact.
DATE_PARTED = r"(?:^|[^0-9])(20[0-9]{2})[-_/](0[1-9]|1[0-2])[-_/](0[1-9]|[12][0-9]|3[01])(?:$|[^0-9])"
DATE_COMPACT = r"(?:^|[^0-9])(20[0-9]{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01]))(?:$|[^0-9])"


def found_date(x: str, d: Dialect = SPARK) -> str:
    """The first such day as yyyymmdd, null if there is none; one with separators wins."""
    parted = "concat(" + ", ".join(d.group(x, DATE_PARTED, i) for i in (1, 2, 3)) + ")"
    return f"coalesce(nullif({parted}, ''), nullif({d.group(x, DATE_COMPACT, 1)}, ''))"


def unprintable(x: str, d: Dialect = SPARK) -> str:
    """How many characters are control, format, unassigned or separators other than space, line feed, return and tab."""
    return f"({d.count(x, r'[\p{C}\p{Z}]')} - {d.count(x, r'[ \n\r\t]')})"


def title_case(x: str, d: Dialect = SPARK) -> str:
    """Of lower-case ASCII: a capital after every character that is no letter."""
    return d.join(d.each(d.groups(x, "([a-z]+|[^a-z]+)", 1), "p", "concat(upper(substr(p, 1, 1)), substr(p, 2))"), "''")
