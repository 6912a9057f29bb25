"""Column-level helpers: every function returns a ``pyspark.sql.Column``
built from built-in expressions, so it stays inside whole-stage codegen."""

from demandlens.functions.text import (
    coerce_int,
    digit_year,
    keyword_flag,
    level_label,
    level_sort_key,
    normalize_text,
    strip_text,
    word_pattern,
)

__all__ = [
    "coerce_int",
    "digit_year",
    "keyword_flag",
    "level_label",
    "level_sort_key",
    "normalize_text",
    "strip_text",
    "word_pattern",
]
