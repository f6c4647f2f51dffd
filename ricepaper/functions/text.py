"""Text functions as Column expressions; all of them stay in the JVM.

Null in, null out, unless a function says otherwise. Regular expressions name their character
classes, as engines disagree on what ``\\s`` and ``\\b`` cover.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space in the sense of Unicode strings, as the inside of a character class.
WS = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: What counts as part of a word, as the inside of a character class.
WORDCH = r"\p{L}\p{N}_"

# Course code forms.
CODE = r"[A-Z]{2,5}\d{2,4}[A-Z]{0,3}"
CODE_PREFIX = r"[A-Z]{2,}\d{2,}"
# Roman numerals and their numbers.
ROMAN = {"i": "1", "ii": "2", "iii": "3", "iv": "4", "v": "5", "vi": "6", "vii": "7", "viii": "8", "ix": "9", "x": "10"}
# The keyword tokenizer's characters.
KEYWORD_CHARS = r"A-Za-z\x{c0}-\x{1ef4}\x{e0}-\x{1ef5}0-9_\x{2019}\-"
# An e-mail address, or at least seven digits with at most one separator before each. The first
# seven are counted and the rest is taken run by run, so that long runs of digits need no deep stack.
PII = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}|(?:\+?[0-9]{1,3})?(?:[\s\-.]?[0-9]){7}[0-9]*(?:[\s\-.][0-9]+)*"


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, f"^[{WS}]+|[{WS}]+$", "")


def collapse(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return strip(F.regexp_replace(c, f"[{WS}]+", " "))


def normalize_text(c: Column) -> Column:
    """No-break spaces and runs of blanks as one space, no blanks before line ends, no blank lines."""
    c = F.regexp_replace(c, r"\x{a0}", " ")
    c = F.regexp_replace(c, r"[ \t]+", " ")
    return strip(F.regexp_replace(c, f"[{WS}]+\n", "\n"))


@lru_cache(maxsize=1)
def accent_table() -> tuple[str, str]:
    """Composed letters and their bases, from the canonical decompositions of the letters below U+2000."""
    seen, base = [], []
    for code in range(0xC0, 0x2000):
        ch = chr(code)
        if not unicodedata.category(ch).startswith("L"):
            continue
        bare = "".join(x for x in unicodedata.normalize("NFD", ch) if unicodedata.category(x) != "Mn")
        if bare != ch and len(bare) == 1:
            seen.append(ch)
            base.append(bare)
    return "".join(seen), "".join(base)


def strip_accents(c: Column) -> Column:
    """Letters without their accents; a letter with no decomposition, such as the crossed d, stays."""
    seen, base = accent_table()
    return F.regexp_replace(F.translate(c, seen, base), r"[\x{300}-\x{36f}]", "")


def roman_to_arabic(c: Column) -> Column:
    """Whole-word Roman numerals I to X as numbers, in any case."""
    for roman, number in ROMAN.items():
        c = F.regexp_replace(c, f"(?i)(?<![{WORDCH}]){roman}(?![{WORDCH}])", number)
    return c


def name_key_joined(c: Column) -> Column:
    """Comparison key of a name: no accents, hyphens as blanks, code parts joined, numerals as numbers."""
    c = F.regexp_replace(strip_accents(F.lower(strip(c))), "[-_]", " ")
    c = F.regexp_replace(c, r"([a-z]{2,4})[ ]*-?[ ]*(\d{2,3})", "$1$2")
    return collapse(roman_to_arabic(c))


def name_key_ascii(c: Column) -> Column:
    """Comparison key of a name in which everything but ASCII letters, digits and dots is a blank."""
    c = F.regexp_replace(roman_to_arabic(F.lower(collapse(strip_accents(c)))), "[_-]", " ")
    return collapse(F.regexp_replace(c, f"[^a-z0-9.{WS}]", " "))


def tokens(c: Column, lower: bool = True) -> Column:
    """White-space tokens; an empty list for an empty text."""
    c = F.lower(c) if lower else c
    return F.filter(F.split(c, f"[{WS}]+"), lambda x: x != "")


def keyword_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(f"([{KEYWORD_CHARS}]+)"), F.lit(1))


def guess_title(c: Column) -> Column:
    """The first line, stripped, at most 120 characters."""
    return F.substring(strip(F.substring_index(c, "\n", 1)), 1, 120)


def questions_for(title: Column, keywords: Column, most: int = 2) -> Column:
    """Up to ``most`` questions a chunk may answer, from its title and keywords."""
    by_title = F.when(title != "", F.concat(F.lit("What does the section \""), title, F.lit("\" say?")))
    by_words = F.when(F.size(keywords) > 0, F.concat(F.lit("Where are "), F.array_join(F.slice(keywords, 1, 3), ", "), F.lit(" explained?")))
    return F.slice(F.filter(F.array(by_title, by_words, F.lit("Which rules apply here?")), lambda x: x.isNotNull()), 1, most)


def codes(c: Column) -> Column:
    """Course codes of a text in upper case, each once, in order; whole words only."""
    found = F.regexp_extract_all(c, F.lit(f"(?i)(?<![{WORDCH}])({CODE})(?![{WORDCH}])"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.upper(x)))


def code_prefixes(c: Column) -> Column:
    """Letters and digits of codes in upper case, each once, cut before a suffix."""
    return F.array_distinct(F.regexp_extract_all(F.upper(c), F.lit(f"({CODE_PREFIX})"), F.lit(1)))


def spaced_code(c: Column) -> Column:
    """``AB 123 CD`` for a code of at least six characters; null for anything else."""
    part = lambda k: F.regexp_extract(c, r"^([A-Z]{2,4})(\d{2,3})([A-Z]{0,3})$", k)
    made = F.rtrim(F.concat_ws(" ", part(1), part(2), part(3)))
    return F.when((F.length(c) >= 6) & (part(1) != ""), made)


def mention_tokens_joined(c: Column) -> Column:
    """Candidate mentions in a text already keyed by :func:`name_key_joined`.

    Codes, numbered names and bare numbers; if there is none and the text has at most six words,
    the text itself.
    """
    patterns = [r"([a-z]{2,4}\d{2,3}[a-z]{0,3})", r"([a-z]+ \d{1,2})(?!\d)", r"(?<![a-z0-9])(\d{1,2})(?![a-z0-9])"]
    found = F.array_distinct(F.concat(*[F.regexp_extract_all(c, F.lit(p), F.lit(1)) for p in patterns]))
    return F.when((F.size(found) == 0) & (F.size(tokens(c)) <= 6) & (c != ""), F.array(c)).otherwise(found)


def mention_tokens_ascii(c: Column) -> Column:
    """Code-like mentions in a text keyed by :func:`name_key_ascii`."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?<![a-z0-9])([a-z]{2,4} ?\d{2,3}[a-z]{0,3})(?![a-z0-9])"), F.lit(1)))


def strip_think(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""))


def estimate_tokens(c: Column) -> Column:
    """A quarter of the characters, at least 1; 0 for null and empty texts."""
    n = F.length(F.coalesce(c, F.lit("")))
    return F.when(n == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(n / 4).cast("int")))


# The markers that end the system part of a prompt, in the order they are tried.
MARKERS = ("KG_FINDINGS", "PREREQ_EDGES", "EVIDENCE", "QUESTION")


def split_prompt(c: Column, markers: tuple[str, ...] = MARKERS) -> Column:
    """``(system, user)`` of a prompt that starts with ``SYSTEM:``: cut at the first marker, in list order, that it has."""
    at = F.coalesce(*[F.nullif(F.instr(c, m), F.lit(0)) for m in markers])
    has = c.startswith("SYSTEM:") & at.isNotNull()
    system = F.when(has, strip(F.regexp_replace(F.substring(c, F.lit(1), at - 1), "^SYSTEM:", ""))).otherwise(F.lit(""))
    return F.struct(system.alias("system"), F.when(has, strip(F.substring(c, at, F.length(c)))).otherwise(c).alias("user"))


def between(c: Column, begin: str, end: str) -> Column:
    """What stands between two markers; the whole text if either is missing."""
    start = F.instr(c, begin)
    rest = F.substring(c, start + len(begin), F.length(c))
    stop = F.instr(rest, end)
    return F.when((start > 0) & (stop > 0), strip(F.substring(rest, F.lit(1), stop - 1))).otherwise(c)


def cut(c: Column, most: int, suffix: str = "") -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit(suffix))).otherwise(c)


def display_name(code: Column, name: Column) -> Column:
    """``CODE (Name)``: the English name, else the Vietnamese, else any; the code alone without one."""
    shown = F.coalesce(F.nullif(name["en"], F.lit("")), F.nullif(name["vi"], F.lit("")), F.filter(F.map_values(name), lambda x: x.isNotNull() & (x != ""))[0])
    return F.when(shown.isNull(), code).otherwise(F.concat(code, F.lit(" ("), shown, F.lit(")")))


def visible_html(c: Column) -> Column:
    """Text nodes of an HTML page, one a line, common entities decoded."""
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", "\n")
    c = F.regexp_replace(c, r"<[^>]*>", "\n")
    for seen, true in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(seen), F.lit(true))
    return c


def visible_markdown(c: Column) -> Column:
    """Markdown without its marks of emphasis, headings, links, code and quotes."""
    c = F.regexp_replace(c, r"(?m)^#{1,6}[ \t]+", "")
    c = F.regexp_replace(c, r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    c = F.regexp_replace(c, r"(?m)^>[ \t]?", "")
    c = F.regexp_replace(c, r"(?m)^[ \t]*[-*+][ \t]+", "")
    return F.regexp_replace(c, r"[*`]{1,3}", "")


def redact(c: Column) -> Column:
    """E-mail addresses and phone-like numbers as ``[REDACTED]``."""
    return F.regexp_replace(c, PII, "[REDACTED]")
