"""Text functions as columns. The character classes are spelled out, as engines differ on the short forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space as Python strips it.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Anything but letters, numbers and underscore, in any script.
NON_WORD = r"[^\p{L}\p{N}_]+"
#: Words of a question that make up its similarity key.
KEY_WORDS = 6


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def normalized_space(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def normalized(text: Column) -> Column:
    """Lower-cased words joined by single spaces; null is empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), NON_WORD, " "))


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), NON_WORD), lambda t: t != "")


def similarity_key(question: Column) -> Column:
    """The first six words in code-point order: equal for questions that differ only in their order or marks."""
    words = F.filter(F.split(normalized(question), " "), lambda w: w != "")
    return F.array_join(F.array_sort(F.slice(words, 1, KEY_WORDS)), " ")


def title(text: Column) -> Column:
    """Upper case after anything that isn't a letter, lower case elsewhere."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 2_147_483_647)))), "")


def preview(text: Column, size: int = 100) -> Column:
    """The first characters on one line, with dots."""
    return F.concat(F.replace(F.left(text, F.lit(size)), F.lit("\n"), F.lit(" ")), F.lit("..."))


def url_part(url: Column, part: str) -> Column:
    """``origin``, ``authority`` or ``path`` of an absolute URL; empty if it has none."""
    pattern = {"origin": r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", "authority": r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", "path": r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"}[part]
    return F.regexp_extract(url, pattern, 1)
