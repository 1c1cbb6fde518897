"""Text helpers as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, for expressions that use it often."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_key(c: str | Column) -> Column:
    """Lower-case trimmed text, the identity of a term."""
    return strip(F.lower(col(c)))


def like(c: str | Column, pattern: str, escape: bool = False) -> Column:
    """LIKE that ignores ASCII case; a backslash escapes only when asked to."""
    if not escape:
        pattern = pattern.replace("\\", "\\\\")
    return F.ilike(col(c), F.lit(pattern))


def glob_pattern(glob: str) -> str:
    """Anchored regular expression of a GLOB with ``*``, ``?`` and ``[...]``."""
    out, i = [], 0
    while i < len(glob):
        ch = glob[i]
        end = glob.find("]", i + 2) if ch == "[" else -1
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif end > 0:
            body = glob[i + 1 : end].replace("\\", "\\\\")
            out.append("[" + body + "]")
            i = end
        else:
            out.append(re.escape(ch))
        i += 1
    return "(?s)^" + "".join(out) + "$"


# Accented letters and their plain forms.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinoooooouuuuyy"


def strip_accents(c: str | Column) -> Column:
    return F.translate(col(c), ACCENTED, PLAIN)


def slugify(c: str | Column) -> Column:
    """Lower-case, accents off, runs of other characters to one hyphen."""
    plain = strip_accents(F.lower(col(c)))
    return F.regexp_replace(F.regexp_replace(plain, r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def parent_slug(c: str | Column) -> Column:
    return F.split_part(col(c), F.lit("."), F.lit(1))


def head(c: str | Column, most: int | None) -> Column:
    """The first ``most`` characters, or all of them for None."""
    return col(c) if most is None else F.left(col(c), F.lit(most))


def first_of(c: str | Column, most: int | None) -> Column:
    """The first ``most`` elements of an array, or all of them for None."""
    return col(c) if most is None else F.slice(col(c), 1, most)


def sha_key(*parts: str | Column) -> Column:
    """SHA-256 of the parts joined by a bar."""
    return F.sha2(F.concat_ws("|", *[col(p) for p in parts]), 256)


def words(c: str | Column) -> Column:
    """Whitespace-separated words; none for blank text."""
    return F.filter(F.split(F.trim(col(c)), r"\s+"), lambda w: w != "")


# Characters that a trim removes at both ends.
BLANKS = " \t\n\r\f\u000b\u00a0\ufeff\u2028\u2029"


def strip(c: str | Column) -> Column:
    """Without blanks and line breaks at either end."""
    return F.btrim(col(c), F.lit(BLANKS))
