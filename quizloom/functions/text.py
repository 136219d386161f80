"""Text functions as Spark columns, and the same definitions as SQL text for DuckDB.

Compatibility forms are mapped with translate and replace inside the JVM: full-width
forms, ligatures, superscripts, special spaces, and combining accents over Latin vowels.
A null text counts as empty where a function says "or empty".
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

FULL = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
HALF = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
SPACES = "\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
RAISED = "⁰¹²³⁴⁵⁶⁷⁸⁹₀₁₂₃₄₅₆₇₈₉ªºµ"
RAISED_AS = "01234567890123456789aoμ"
COMPAT, COMPAT_AS = FULL + SPACES + RAISED, HALF + " " * len(SPACES) + RAISED_AS
LONGER = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "…": "...", "½": "1⁄2", "¼": "1⁄4", "¾": "3⁄4", "№": "No", "™": "TM"}
ACCENTED = "àáâãäåèéêëìíîïòóôõöùúûüçñýÿ"
BARE = "aaaaaaeeeeiiiiooooouuuucnyy"
_GRAVE, _ACUTE, _HAT, _TILDE, _DOTS = "\u0300", "\u0301", "\u0302", "\u0303", "\u0308"
COMPOSED = {
    base + mark: whole
    for mark, bases, wholes in (
        (_GRAVE, "aeiouAEIOU", "àèìòùÀÈÌÒÙ"), (_ACUTE, "aeiouAEIOU", "áéíóúÁÉÍÓÚ"), (_HAT, "aeiouAEIOU", "âêîôûÂÊÎÔÛ"),
        (_TILDE, "anoANO", "ãñõÃÑÕ"), (_DOTS, "aeiouAEIOU", "äëïöüÄËÏÖÜ"),
    )
    for base, whole in zip(bases, wholes)
}
#: Runs of white space but single blanks, which stay as they are.
_SPACE = r"\s\x1c-\x1f\x85\u2028\u2029"
WHITE = f" [{_SPACE}]+|[{_SPACE}&&[^ ]][{_SPACE}]*"


#: A character that some mapping of this module may change; texts without one skip all of them.
MAY_CHANGE = r"[^\x00-\x7f\u00c0-\u00ff\u00ab\u00b0\u00b7\u00bb\u2010-\u2025]"


#: What is replaced one after the other, as JSON: a constant array keeps the expression small, where nested calls would make it too large to compile.
_PUT = json.dumps([{"a": a, "b": b} for a, b in [*LONGER.items(), *COMPOSED.items()]])


def _compat(c: Column) -> Column:
    """NFKC for the forms this module lists."""
    pairs = F.from_json(F.lit(_PUT), "array<struct<a:string,b:string>>")
    mapped = F.aggregate(pairs, F.translate(c, COMPAT, COMPAT_AS), lambda text, x: F.replace(text, x["a"], x["b"]))
    return F.when(c.rlike(MAY_CHANGE), mapped).otherwise(c)


def clean_text(c: Column) -> Column:
    """Compatibility forms mapped, U+FFFD dropped, white space collapsed, none before ,.;:!? - null counts as empty."""
    c = _compat(F.coalesce(c, F.lit("")))
    c = F.regexp_replace(F.replace(c, F.lit("\ufffd"), F.lit("")), WHITE, " ")
    return F.trim(F.regexp_replace(c, r" +([,.;:!?])", "$1"))


def without_accents(c: Column) -> Column:
    return F.regexp_replace(F.translate(F.lower(c), ACCENTED, BARE), "[\\u0300-\\u036f]+", "")


def canonical_text(c: Column) -> Column:
    """Clean text in lower case without accents; runs of other than a-z, 0-9 become one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(without_accents(clean_text(c)), "[^a-z0-9 ]+", " "), " {2,}", " "))


def canonical_option(c: Column) -> Column:
    """Like canonical_text, but punctuation stays, so that URLs stay apart."""
    return canonical_clean(clean_text(c))


def canonical_clean(clean: Column) -> Column:
    """canonical_option of a text that is clean already."""
    return F.trim(without_accents(clean))


def without_numbers(canonical: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(canonical, r"\b\d+\b", " "), " {2,}", " "))


def slugify(c: Column) -> Column:
    """Lower case, letters and digits of any script joined by dashes."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")


def ascii_slug(c: Column) -> Column:
    """Without accents, a-z and 0-9 joined by dashes; "tag" if nothing is left."""
    slug = F.regexp_replace(F.regexp_replace(without_accents(_compat(F.coalesce(c, F.lit("")))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(slug == "", F.lit("tag")).otherwise(slug)


# The same definitions for DuckDB.


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_clean(c: str) -> str:
    c = f"translate(coalesce({c}, ''), {_q(COMPAT)}, {_q(COMPAT_AS)})"
    for form, plain in LONGER.items():
        c = f"replace({c}, {_q(form)}, {_q(plain)})"
    c = f"replace(nfc_normalize({c}), '�', '')"
    c = f"regexp_replace({c}, '[\\s\\x0B\\x1c-\\x1f\\x{{85}}\\x{{2028}}\\x{{2029}}]+', ' ', 'g')"
    return f"trim(regexp_replace({c}, ' +([,.;:!?])', '\\1', 'g'))"


def sql_bare(c: str) -> str:
    return f"regexp_replace(strip_accents(lower({c})), '[\\x{{0300}}-\\x{{036f}}]', '', 'g')"


def sql_canonical(c: str) -> str:
    return f"trim(regexp_replace({sql_bare(sql_clean(c))}, '[^a-z0-9]+', ' ', 'g'))"


def sql_option(c: str) -> str:
    return f"trim(regexp_replace({sql_bare(sql_clean(c))}, '\\s+', ' ', 'g'))"


def sql_without_numbers(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace({c}, '\\b\\d+\\b', ' ', 'g'), ' +', ' ', 'g'))"
