"""Text predicates and rewrites with Unicode semantics.

Java's ``\\w``, ``\\s`` and ``trim`` are ASCII-only; the patterns here say ``(?U)`` or name the classes.  Full matches are
anchored with ``\\A`` and ``\\z`` because ``$`` also matches before a last newline.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HANGUL = "[가-힣]"
CJK = "[가-힣一-鿿]"
LETTERS = "[\\p{L}\\p{Nl}\\p{No}]"


def lit_or_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def has(c: Column | str, pattern: str) -> Column:
    return lit_or_col(c).rlike(pattern)


def full(c: Column | str, pattern: str) -> Column:
    return lit_or_col(c).rlike(f"\\A(?:{pattern})\\z")


def strip(c: Column | str) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(lit_or_col(c), "(?U)\\A\\s+|\\s+\\z", "")


def squash(c: Column | str) -> Column:
    """Stripped, and every run of white space as one blank."""
    return F.trim(F.regexp_replace(lit_or_col(c), "(?U)\\s+", " "))


def unspaced(c: Column | str) -> Column:
    return F.regexp_replace(lit_or_col(c), "(?U)\\s+", "")


def is_blank(c: Column | str) -> Column:
    return ~F.coalesce(lit_or_col(c).rlike("(?U)\\S"), F.lit(False))


def count(c: Column | str, pattern: str) -> Column:
    return F.regexp_count(lit_or_col(c), F.lit(pattern))


def is_upper(c: Column | str) -> Column:
    c = lit_or_col(c)
    return (c == F.upper(c)) & (c != F.lower(c))


def is_lower(c: Column | str) -> Column:
    c = lit_or_col(c)
    return (c == F.lower(c)) & (c != F.upper(c))


def doubled(c: Column | str) -> Column:
    """A string of at least six characters that is one half twice."""
    c = lit_or_col(c)
    half = F.length(c).cast("int").__floordiv__(2) if hasattr(Column, "__floordiv__") else F.floor(F.length(c) / 2).cast("int")
    return (F.length(c) >= 6) & (F.length(c) % 2 == 0) & (c.substr(F.lit(1), half) == c.substr(half + 1, half))


def detect_lang(c: Column | str) -> Column:
    """``ko`` where Hangul letters are as many as Latin ones or more, else ``en``; NULL and empty are ``en``."""
    c = lit_or_col(c)
    return F.when(c.isNull() | (c == ""), "en").when(count(c, HANGUL) >= count(c, "[a-zA-Z]"), "ko").otherwise("en")


def has_latin_word(c: Column | str) -> Column:
    return lit_or_col(c).rlike("[A-Za-z]{2,}")


def label_lang(c: Column | str) -> Column:
    return F.when(F.coalesce(lit_or_col(c), F.lit("")).rlike(HANGUL), "ko").otherwise("en")


def percent_encode(c: Column | str) -> Column:
    """Everything but letters, digits and ``_.-~`` as %XX."""
    out = F.url_encode(lit_or_col(c))
    for old, new in (("+", "%20"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def doc_uri(namespace: str, doc_id: Column | str) -> Column:
    return F.concat(F.lit(namespace + "doc/"), percent_encode(lit_or_col(doc_id).cast("string")))


def greedy_units(units: list[str]) -> str:
    """A pattern for a string that is used up by taking the longest unit again and again, without going back."""
    import re

    return "\\A(?>" + "|".join(re.escape(u) for u in sorted(units, key=lambda u: (-len(u), u))) + ")*+\\z"


def nominalise(stem: Column | str) -> Column:
    """Noun form of a Korean verb stem: an open last syllable takes ㅁ below, any other the syllable 음."""
    stem = lit_or_col(stem)
    last = F.right(stem, F.lit(1))
    code = F.ascii(last)
    opened = (code >= 0xAC00) & (code <= 0xD7A3) & ((code - 0xAC00) % 28 == 0)
    closed = F.decode(F.unhex(F.hex(code + 16)), "UTF-16BE")
    return F.when(stem == "", stem).when(opened, F.concat(stem.substr(F.lit(1), F.length(stem) - 1), closed)).otherwise(F.concat(stem, F.lit("음")))


def clean_name(c: Column | str) -> Column:
    """Name without role prefixes (where it has a colon), tags and punctuation; NULL is empty."""
    raw = F.coalesce(lit_or_col(c), F.lit(""))
    name = F.when(F.contains(raw, F.lit(":")), F.regexp_replace(raw, "(?:class|domain|range|type):", "")).otherwise(raw)
    return strip(F.regexp_replace(F.regexp_replace(name, "<[^>]*>", ""), "[\\[\\](){}<>:/,\"'\\\\]", ""))


def local_name(c: Column | str) -> Column:
    """Letters and digits (Latin, Hangul) of a name, or ``Unknown``."""
    return F.coalesce(F.nullif(F.regexp_replace(lit_or_col(c), "[^0-9A-Za-z가-힣]", ""), F.lit("")), F.lit("Unknown"))


def surface_key(c: Column | str) -> Column:
    """Dictionary key of a label: no separators, no homonym number at the end."""
    return F.regexp_replace(F.regexp_replace(strip(F.coalesce(lit_or_col(c), F.lit(""))), "(?U)[\\s()（）•·/_\\\\-]+", ""), "(?U)\\d+\\z", "")
