"""Which lines, terms, sentences and chunks count as what, and how candidates score.

Scores are integer thousandths, so thresholds compare exactly. All word lists, patterns and weights below are fixed
values: results depend on each of them.
"""

from __future__ import annotations

from .dialect import SPARK, Dialect
from .quick import BEHIND
from .text import NOT_W, W, bounded, is_upper, squeezed, stripped, tokens, words

HEADING = r"^(?:#{1,6}[ \t]+.+|[0-9]+(?:\.[0-9]+){0,4}[ \t]+.+|[A-Z][A-Z0-9 \t/&,-]{4,})$"
PROCEDURE_WORDS = bounded("procedure|process|installation|method|steps|instructions|checklist")
NO_PROCEDURE_WORDS = bounded("general notes?|title block|legend|schedule|index|inspection list|inspection notes?")
ADMIN_HEADING = bounded(
    "title page|tower profile|detail[ \\t]+[a-z0-9-]+|sheet[ \\t]+[a-z0-9.-]+|vw[ \\t]+[a-z0-9.-]+|revision|legend|general notes?|cover sheet|"
    "site address|site number|job number|project number|prepared for|prepared by|description|legal"
)
#: A sign is no part of a word, so one must follow it.
ADMIN_NUMBER = rf"(?i)(?:^|{NOT_W})project[ \t]*#{W}"
IMPERATIVE = rf"(?i)^(?:install|remove|verify|check|tighten|inspect|connect|disconnect|measure|set|ensure|confirm|apply|attach|bond|ground)(?:$|{NOT_W})"
DEFINES = bounded("means|refers to|is defined as|defined as")
UNITS = "v|a|w|hz|mm|cm|m|ft|in|lb|psi|n|nm"
VALUE = rf"(?i)(?:^|{NOT_W})[0-9]+(?:\.[0-9]+)?[ \t]?(?:(?:{UNITS})(?:$|{NOT_W})|%{W})"
COLON_VALUE = rf"(?i):[ \t]*[0-9]+(?:\.[0-9]+)?[ \t]?(?:(?:{UNITS})(?:$|{NOT_W})|%{W})"
IDENTIFIER = rf"(?:^|{NOT_W})(?:ANSI|TIA|OSHA|BICSI|IEEE|NEC|NFPA|ISO|IEC|PN|P/N|Part|Model|SKU)(?:$|[^a-z])"
NOISE_WORD = bounded("ii|iii|iv|v|text|page")
SPACED_LETTERS = rf"(?:^|{NOT_W})(?:[A-Za-z](?:$|[ \t]+|{NOT_W}[ \t]*)){{4}}"
NOTE_STYLE = bounded("contractor shall|coordinate with|field conditions|diagrammatic only|unless otherwise noted|verify in field|do not scale|all work shall|typical unless noted otherwise")
ADMIN_WORDS = bounded(
    "revision|rev|rev[.]?[ \\t]*(?:no|#)|sheet|sheet[ \\t]*(?:no|number|title)|issued[ \\t]*for|drawn[ \\t]*by|checked[ \\t]*by|approved[ \\t]*by|"
    "engineer'?s?[ \\t]*seal|licensed[ \\t]+professional[ \\t]+engineer|all[ \\t]+rights[ \\t]+reserved|copyright|phone|fax|email|project[ \\t]*no|"
    "job[ \\t]*no|drawing[ \\t]*no|issue[ \\t]*date|plot[ \\t]*date|permit|state[ \\t]+of|consulting[ \\t]+engineers|seal|project[ \\t]+name|"
    "prepared[ \\t]+for|prepared[ \\t]+by|site[ \\t]+address|project[ \\t]+address|vicinity[ \\t]+map|issue|site[ \\t]+number|job[ \\t]+number|description|legal"
)
ADMIN_OPEN = rf"(?i)(?:^|{NOT_W})(?:www[.]|https?://|project[ \t]*#){W}"
CONTACT = rf"(?i)(?:^|{NOT_W})(?:tel|phone|fax)(?:$|{NOT_W})|(?:^|{NOT_W})(?:www[.]|https?://){W}|{W}@{W}"
DRAWING_WORDS = bounded("sheet|rev|issue|drawing")
NUMBER_WORD = bounded("[0-9]+", "")
PATH_LIKE = r"(?i)(?:[a-z]:\\|\\[\w .-]+\\[\w .\\/:-]+|/[\w.-]+/[\w./-]+|www\.|https?://|\.\\[\w .\\/:-]+\.(?:png|jpg|jpeg|pdf|dwg|dxf|tif|tiff))"
#: Of PATH_LIKE and the patterns of addresses each match holds one of these.
PATH_MARKS, SLASHES = ("/", "\\", "w.", "W."), ("/", "\\")
MIXED_METADATA = bounded("sheet|rev|issue|date|drawn by|checked by|approved by|project no|drawing no")
MODAL = bounded("shall|must|required|prohibited|should")
STRICT_MODAL = bounded("shall|must|required|prohibited")
TOPIC_CUE = bounded("shall|must|required|should|warning|caution|definition|scope|procedure|installation")
YEAR = bounded("20[0-9]{2}", "")
FACT_SIGNAL = rf"(?i)(?:^|{NOT_W})(?:[a-z]{{2,}}[a-z0-9/.-]*|20[0-9]{{2}}|[0-9]+(?:\.[0-9]+)?[ \t]?(?:{UNITS}))(?:$|{NOT_W})"
STANDARD_WORD = bounded("ansi|tia|osha|bicsi|ieee|iso|iec")
GENERIC_NOTES = ("note", "notes", "all construction", "general notes", "necessary", "shall", "qty", "size", "detail", "title page", "tower profile", "description", "legal", "site", "number", "job number", "site number", "isolated", "lat")
GENERIC_TERM = r"(?i)^(?:description|legal|option[ \t]+[0-9]+|lat|long|lon|site|number|job number|site number)$"
STOP_WORDS = ("this", "that", "with", "from", "have", "shall", "must", "required", "using", "into", "for", "when", "where", "procedure", "process", "instructions")
TOPIC_STOP_WORDS = STOP_WORDS + ("title", "page", "detail", "sheet", "tower", "profile", "project", "prepared", "issued", "address", "revision", "general", "notes", "copyright", "site", "number", "job", "description", "legal", "option", "lat")
TOPIC_WORD = r"[A-Za-z][A-Za-z0-9/-]{3,}"
TERM = "[A-Z][A-Za-z0-9 /()_-]{1,60}"
TERM_ANY_CASE = "[A-Za-z][A-Za-z0-9 /()_-]{1,60}"
#: Tried in this order; the first that fits decides.
TERM_LINES = (
    rf"^({TERM})[ \t]*:[ \t]+(.+)$",
    rf"^({TERM})[ \t]+-[ \t]+(.+)$",
    rf"(?i)^({TERM_ANY_CASE})[ \t]+means[ \t]+(.+)$",
    rf"(?i)^({TERM_ANY_CASE})[ \t]+refers to[ \t]+(.+)$",
    rf"(?i)^({TERM_ANY_CASE})[ \t]+is defined as[ \t]+(.+)$",
)
LAST_WORD = r"(?i)(?:^| )(?:as|the|a|an|of|to|mi|po)$"
ACRONYM_LINE = r"^([A-Z0-9/-]{2,12})[ \t]*[-:][ \t]*([A-Z][A-Za-z0-9 ,()/_-]{4,120})$"
STEP_LINE = r"^[0-9]+[.)][ \t]+.+$"
STEP_NUMBER = r"^[0-9]+[.)][ \t]*"


def _in(x: str, values: tuple[str, ...], d: Dialect) -> str:
    return f"{x} in ({', '.join(d.text(v) for v in values)})"


def _occurrences(x: str, char: str) -> str:
    return f"(length({x}) - length(replace({x}, '{char}', '')))"


def points(*rules: tuple[int | str, str]) -> str:
    """The sum of the points whose rule holds."""
    return "cast(" + " + ".join(f"case when {rule} then {p} else 0 end" for p, rule in rules) + " as bigint)"


def spaced_letters(x: str, d: Dialect = SPARK) -> str:
    """Four single letters in a row; a letter with another behind it is passed over at once."""
    return d.has(x, SPACED_LETTERS.replace(f"(?:^|{NOT_W})", f"(?=[A-Za-z](?!{W})){BEHIND}", 1) if d.spark else SPACED_LETTERS)


def admin_line(x: str, d: Dialect = SPARK) -> str:
    s = x  # the patterns allow for runs of blanks
    return (
        f"({d.has(s, ADMIN_WORDS)} or {d.has(s, ADMIN_OPEN)} or ({is_upper(s)} and {d.has(s, CONTACT)}) or ({d.has(s, DRAWING_WORDS)} and {d.has(s, NUMBER_WORD)})"
        f" or ({_occurrences(s, ':')} >= 2 and {words(s, d)} <= 14) or {d.has_text(s, d.text('|'))})"
    )


def admin_hits(line_array: str, d: Dialect = SPARK) -> str:
    return d.size(d.keep(line_array, "l", admin_line("l", d)))


def admin_at_least(text: str, line_array: str, percent: int, d: Dialect = SPARK) -> str:
    """The share of admin lines, and a fifth more if there is a contact, reaches ``percent``."""
    share = f"100 * {admin_hits(line_array, d)}"
    return f"({d.size(line_array)} > 0 and {share} + case when {d.has(text, CONTACT)} then 20 else 0 end * {d.size(line_array)} >= {percent} * {d.size(line_array)})"


def promotion_text(line_array: str, d: Dialect = SPARK, admin: str | None = None) -> str:
    """``admin``: whether line ``i`` is an admin line, where that is known."""
    kept = d.keep(line_array, "l" if admin is None else "(l, i)", f"not {d.has('l', HEADING)} and not {admin or admin_line('l', d)}")
    return f"trim({d.sub(d.join(kept, d.text(' ')), r'[ \t]+([,.;:])', chr(92) + '1')})"


def bare(x: str, d: Dialect = SPARK) -> str:
    """Squeezed, without punctuation at the ends."""
    return d.sub(squeezed(x, d), "^[ :;,.-]+|[ :;,.-]+$", "")


def admin_heading(s: str, d: Dialect = SPARK) -> str:
    """Of a bare text."""
    return f"({d.has(s, ADMIN_HEADING)} or {d.has(s, ADMIN_NUMBER)} or {d.has(s, r'^[A-Z]{1,2}[0-9][A-Z0-9.-]{0,6}$')})"


def fragment(s: str, n: str, d: Dialect = SPARK) -> str:
    """Of a squeezed text of ``n`` words."""
    closed = d.has(s, "[.:;]$")
    return (
        f"(length({s}) < 12 or ({n} <= 4 and {d.has(s, NOISE_WORD)}) or (not {closed} and ({n} < 8 or ({tokens(s, d)} = 3 and {is_upper(f'substr({s}, 1, 1)')}))) or {n} <= 2)"
    )


def clean_term(s: str, d: Dialect = SPARK) -> str:
    """Of a bare text."""
    return (
        f"({s} <> '' and length({s}) <= 60 and not ({is_upper(s)} and {tokens(s, d)} > 2) and not {_in(f'lower({s})', GENERIC_NOTES, d)} and not {d.has(s, GENERIC_TERM)}"
        f" and not {d.has(s, LAST_WORD)} and not {spaced_letters(s, d)})"
    )


def definition_body(s: str, n: str, d: Dialect = SPARK) -> str:
    """Of a squeezed text of ``n`` words."""
    return f"({n} >= 3 and not {d.has(s, NOTE_STYLE)} and not {d.has(s, '^[A-Z0-9 /._-]{2,40}$')} and not {d.has(s, r'^[0-9]+(?:\.[0-9]+)?(?:,[ \t]*[0-9]+(?:\.[0-9]+)?)*$')})"


# the texts scored below are single lines, so their share of admin lines is all or nothing


def glossary_score(term: str, bare_term: str, body: str, n: str, d: Dialect = SPARK) -> str:
    """``body`` is squeezed and has ``n`` words."""
    return points(
        (250, f"{tokens(term, d)} between 2 and 8"),
        (100, f"{is_upper(f'substr({term}, 1, 1)')} and not {is_upper(term)}"),
        (200, d.has(body, DEFINES)),
        (250, f"{n} between 4 and 40"),
        (100, d.has(body, "[.;]$")),
        (400, f"{n} between 2 and 12 and {d.has(term, '^[A-Z0-9/-]{2,12}$')}"),
        (-800, admin_line(f"concat({term}, ' ', {body})", d)),
        (-400, f"({spaced_letters(term, d)} or {spaced_letters(body, d)})"),
        (-350, fragment(body, n, d)),
        (-450, f"not {clean_term(bare_term, d)}"),
        (-550, f"not {definition_body(body, n, d)}"),
        (-150, f"length({body}) > 320"),
    )


def fact_score(x: str, n: str, d: Dialect = SPARK) -> str:
    """Of a squeezed text of ``n`` words."""
    signs = f"{_occurrences(x, ',')} + {_occurrences(x, '|')} + {_occurrences(x, ':')} >= 3"
    mixed = (signs, d.has(x, MIXED_METADATA)) if d.spark else (d.has(x, MIXED_METADATA), signs)  # the signs are counted sooner
    return points(
        (-750, admin_line(x, d)),
        (-500, d.has_marked(x, PATH_MARKS, PATH_LIKE)),
        (-600, " and ".join(mixed)),
        (-350, d.has(x, NOTE_STYLE)),
        (350, d.has(x, VALUE)),
        (200, d.has(x, COLON_VALUE)),
        (150, d.has(x, YEAR)),
        (300, d.has(x, MODAL)),
        (200, d.has(x, IDENTIFIER)),
        (100, d.has_text(x, d.text(":"))),
        (200, f"{n} between 3 and 35"),
        (100, f"{n} between 3 and 12"),
        (-300, fragment(x, n, d)),
        (-350, spaced_letters(x, d)),
    )


def fact_sentence(x: str, d: Dialect = SPARK) -> str:
    s = d.sub(squeezed(x, d), r"[ \t]+([,.;:])", r"\1")
    return f"case when {s} <> '' and not {d.has(s, '[.:;]$')} then concat({s}, '.') else {s} end"


def atomic_fact(x: str, d: Dialect = SPARK) -> str:
    return (
        f"(length({x}) <= 220 and not {d.has_text(x, d.text('|'))} and not ({_occurrences(x, ',')} >= 4 and {d.has_text(x, d.text(':'))})"
        f" and not {d.has_marked(x, PATH_MARKS, r'https?://|www\.|[A-Za-z]:\\')} and not {d.has_marked(x, SLASHES, r'\.\\|\\\\|//|/' + W + '+/')} and not {d.has(x, r'[\x00-\x08\x0B\x0C\x0E-\x1F]')}"
        f" and not {d.has(x, bounded('site number|job number|description|legal'))} and not {d.has(x, bounded('contractor shall coordinate|drawings are diagrammatic only|verify field conditions|unless otherwise noted'))})"
    )


def fact_category(x: str, d: Dialect = SPARK) -> str:
    return f"case when {d.has(x, '(?i)shall|must|required|prohibited')} then 'requirements' when {d.has(x, YEAR)} then 'dates' when {d.has(x, STANDARD_WORD)} then 'standards' when {d.has(x, VALUE)} then 'values' else 'facts' end"


def usable_steps(line_array: str, d: Dialect = SPARK) -> str:
    """The numbered lines without their numbers, those with enough words, each closed by a full stop or semicolon."""
    bare = d.each(d.keep(line_array, "l", d.has("l", STEP_LINE)), "l", stripped(d.sub("l", STEP_NUMBER, ""), d))
    closed = d.has("l", "[.;]$")
    kept = d.keep(bare, "l", f"{tokens('l', d)} >= 3 or ({tokens('l', d)} = 2 and {closed})")
    return d.each(kept, "l", f"case when {closed} then l else concat(l, '.') end")


def imperatives(steps: str, d: Dialect = SPARK) -> str:
    return d.size(d.keep(steps, "l", d.has("l", IMPERATIVE)))


def procedure_score(title: str, heading: str, steps: str, joined: str, hits: str, d: Dialect = SPARK) -> str:
    """``joined``: the steps in one line; ``hits``: how many open with an imperative."""
    named = d.has(title, PROCEDURE_WORDS)
    weak = d.size(d.keep(steps, "l", f"{fragment('l', words('l', d), d)} and not {d.has('l', IMPERATIVE)}"))
    return points(
        (250, f"({named} or {d.has(heading, PROCEDURE_WORDS)})"),
        (-350, f"({d.has(title, NO_PROCEDURE_WORDS)} or {d.has(heading, NO_PROCEDURE_WORDS)})"),
        (300, f"{d.size(steps)} >= 2"),
        (f"least({hits} * 120, 300)", "true"),
        (-400, f"{hits} = 0 and not {named}"),
        (-300, f"{weak} > 0"),
        (-700, admin_line(joined, d)),
        (-350, spaced_letters(joined, d)),
    )


def long_words(x: str, d: Dialect = SPARK) -> str:
    """Words of four characters or more."""
    return d.groups(f"concat(' ', {x})", rf"[^A-Za-z0-9_]({TOPIC_WORD})", 1)


def topic_word(t: str, d: Dialect = SPARK) -> str:
    """A word that may name a topic."""
    return f"(not {_in(f'lower({t})', TOPIC_STOP_WORDS, d)} and not {d.has(t, '^[A-Z0-9.-]{1,4}$')} and not {admin_heading(t, d)})"


def topic_words(x: str, d: Dialect = SPARK) -> str:
    """Those words in lower case."""
    return d.each(d.keep(long_words(x, d), "t", topic_word("t", d)), "t", "lower(t)")


def topic_score(x: str, n: str, heading: str, title: str, signal: str, d: Dialect = SPARK) -> str:
    """Of a squeezed text of ``n`` words; ``signal``: it has two topic words or more."""
    return points(
        (-900, admin_line(x, d)),
        (250, f"{heading} <> '' and {heading} <> {title}"),
        (250, f"{n} between 20 and 180"),
        (150, f"{n} between 6 and 19"),
        (200, d.has(x, TOPIC_CUE)),
        (150, d.has(x, IDENTIFIER)),
        (150, d.has(x, DEFINES)),
        (150, signal),
        (-200, d.has(x, NOTE_STYLE)),
        (-300, fragment(x, n, d)),
        (-250, spaced_letters(x, d)),
    )
