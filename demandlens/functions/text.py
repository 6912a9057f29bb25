"""Text, number and label expressions shared by the operators."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace stripped at both ends. Spark's trim() removes spaces only; the
# cleaning contract strips tabs and newlines as well.
_EDGE_SPACE = r"^\s+|\s+$"
_SPACES = " \t\n\x0b\f\r"

# A word character for boundary tests: any Unicode letter or digit, or '_'.
# Written as an explicit class so Java regex and RE2 agree (their \b differ).
WORD_CHAR = r"[\p{L}\p{N}_]"
NON_WORD = r"[^\p{L}\p{N}_]"

# Experience level codes and their labels, and the sort order
# of the cleaned level names.
LEVEL_CODES = {"EN": "Entry-Level", "MI": "Mid-Level", "SE": "Senior", "EX": "Executive"}
LEVEL_ORDER = {"entry": 1, "entry-level": 1, "mid": 2, "mid-level": 2, "senior": 3}

NOT_SPECIFIED = "Not Specified"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_text(c: Column | str) -> Column:
    """Strip leading/trailing whitespace (tab and newline included); null kept. In
    ASCII, trimming these characters gives what the expression does, for less."""
    text = _col(c)
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.btrim(text, F.lit(_SPACES))).otherwise(F.regexp_replace(text, _EDGE_SPACE, ""))


def normalize_text(c: Column | str) -> Column:
    """Strip + lower-case, null preserving (cleaning step C1)."""
    return F.lower(strip_text(c))


def coerce_int(c: Column | str) -> Column:
    """Numeric coercion to bigint; unparsable or fractional values become null.

    ``'2020'`` and ``'2020.0'`` give 2020; ``'1.5'`` and ``'abc'`` give null.
    """
    d = F.expr(f"try_cast({_sql(c)} AS DOUBLE)") if isinstance(c, str) else c.try_cast("double")
    return F.when(d == F.floor(d), d.cast("bigint"))


def digit_year(c: Column | str) -> Column:
    """An all-digit string becomes an int year, anything else null."""
    s = strip_text(_col(c).cast("string"))
    return F.when(s.rlike(r"^[0-9]+$"), s.try_cast("int"))


def level_label(c: Column | str, mapping: Mapping[str, str] = LEVEL_CODES) -> Column:
    """Map level codes to labels; unmapped values are kept as they are."""
    pairs = []
    for code, label in mapping.items():
        pairs += [F.lit(code), F.lit(label)]
    return F.coalesce(F.element_at(F.create_map(*pairs), _col(c)), _col(c))


def level_sort_key(c: Column | str, order: Mapping[str, int] = LEVEL_ORDER) -> Column:
    """Sort key of a level's name or label: entry 1, mid 2, senior 3, other 99."""
    expr = None
    low = F.lower(_col(c))
    for name, rank in order.items():
        cond = low == F.lit(name)
        expr = F.when(cond, rank) if expr is None else expr.when(cond, rank)
    return expr.otherwise(99)


def escape_regex(term: str) -> str:
    """Escape regex metacharacters so a term matches literally (Java and RE2)."""
    return re.sub(r"([.^$*+?()\[\]{}|\\])", r"\\\1", term)


def word_pattern(terms: Iterable[str], word: bool = True) -> str:
    """Case-insensitive alternation; with ``word`` each term must stand alone."""
    body = "|".join(escape_regex(t) for t in terms)
    if not word:
        return f"(?i)({body})"
    return f"(?i)(^|{NON_WORD})({body})({NON_WORD}|$)"


def keyword_flag(c: Column | str, terms: Iterable[str], word: bool = False) -> Column:
    """True when the text holds any term; substring match by default; null -> false."""
    return F.coalesce(_col(c).rlike(word_pattern(terms, word)), F.lit(False))


def _sql(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


def year_from_decimal(c: Column | str) -> Column:
    """C20: an integer year from a decimal value (2021.0 -> 2021); text that is
    not a number gives null."""
    return F.floor(_col(c).cast("string").try_cast("double")).cast("int")


# Letters that case-insensitive matching takes for another one although their
# lower case differs, and that other one: dotless i, long s, final and symbol forms.
_FOLD = {"ı": "i", "ſ": "s", "ς": "σ", "µ": "μ", "ϐ": "β", "ϑ": "θ", "ϕ": "φ", "ϖ": "π", "ϰ": "κ", "ϱ": "ρ", "ϵ": "ε", "ẛ": "ṡ"}


def fold(text: Column) -> Column:
    """Text in which two strings are equal where case-insensitive matching takes
    them for equal. The dotted capital I comes first: lower() gives it a mark.
    The few texts that hold such letters are told by a search, which costs less
    than replacing letters."""
    special = F.translate(F.lower(F.translate(text, "İ", "i")), "".join(_FOLD), "".join(_FOLD.values()))
    return F.when(text.rlike(f"[İΣ{''.join(_FOLD)}ϴẞΩ]"), special).otherwise(F.lower(text))


def folded(phrase: str) -> str:
    """``fold`` of a phrase."""
    return phrase.replace("İ", "i").lower().translate({ord(a): b for a, b in _FOLD.items()})
