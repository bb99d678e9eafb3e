"""Column functions: mapping, casting, cleaning. All plain expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that stand for a missing value, and words that mean true.
NULL_WORDS = ["null", "none", "n/a", "na", ""]
TRUE_WORDS = ["true", "1", "yes", "on"]


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    """Drop every kind of white space at both ends (``F.trim`` drops blanks only)."""
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def to_float(c: str | Column) -> Column:
    """Double, or null when the text is no number; NaN and infinities are no numbers."""
    x = col(c).try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), None).otherwise(x)


def to_int(c: str | Column) -> Column:
    """Whole part, cut towards zero."""
    return to_float(c).try_cast("bigint")


def to_str(c: str | Column) -> Column:
    return col(c).cast("string")


def to_bool(c: str | Column, text: bool = False) -> Column:
    """Text is true for the true words; numbers are true unless zero."""
    return F.lower(col(c)).isin(TRUE_WORDS) if text else col(c) != 0


def calculate_sum(*cols: str) -> Column:
    total = F.lit(0.0)
    for c in cols:
        total = total + F.coalesce(to_float(c), F.lit(0.0))
    return total


def calculate_concat(cols: list[str], sep: str = " ") -> Column:
    return F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])


def calculate_multiply(a: str, b: str) -> Column:
    return to_float(a) * to_float(b)


def square(c: str | Column) -> Column:
    return col(c) * col(c)


def categorize(c: str | Column, low: float = 100, mid: float = 250) -> Column:
    return F.when(col(c) < low, "low").when(col(c) < mid, "medium").when(col(c).isNotNull(), "high")


def is_filled(c: str | Column) -> Column:
    """Neither null nor the empty text."""
    x = col(c)
    return x.isNotNull() & (x.cast("string") != "")


def row_completeness(cols: list[str]) -> Column:
    filled = sum((F.when(is_filled(c), 1).otherwise(0) for c in cols), F.lit(0))
    return filled / F.lit(len(cols))


def sanitize_sql(c: str | Column) -> Column:
    """Drop NUL and double each quote, double quote and backslash."""
    out = F.replace(col(c), F.lit("\x00"), F.lit(""))
    for mark in ("'", '"', "\\"):
        out = F.replace(out, F.lit(mark), F.lit(mark * 2))
    return out


def sanitize_deep(c: str | Column, kind: T.DataType) -> Column:
    """``sanitize_sql`` on every text of a value of type ``kind``, at any depth."""
    x = col(c)
    if isinstance(kind, T.StringType):
        return sanitize_sql(x)
    if isinstance(kind, T.ArrayType):
        return F.transform(x, lambda e: sanitize_deep(e, kind.elementType))
    if isinstance(kind, T.StructType):
        fields = [sanitize_deep(x.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]
        return F.when(x.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.MapType):
        return F.map_from_entries(F.transform(F.map_entries(x), lambda e: F.struct(
            sanitize_deep(e["key"], kind.keyType), sanitize_deep(e["value"], kind.valueType))))
    return x


def sanitize_sql_array(c: str | Column) -> Column:
    return F.transform(col(c), sanitize_sql)


# HTML escapes, and the characters kept after escaping.
HTML_ESCAPES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")]
HTML_DROP = r"[^\w\s\-.,@#$%^&*()+=\[\]{}|;:!?]"


def sanitize_html(c: str | Column) -> Column:
    out = col(c)
    for mark, escape in HTML_ESCAPES:
        out = F.replace(out, F.lit(mark), F.lit(escape))
    return F.regexp_replace(out, "(?U)" + HTML_DROP, "")


def distinct_words(c: str | Column) -> Column:
    """Repeated words dropped, first places kept."""
    return F.array_join(F.array_distinct(F.split(strip(c), r"\s+")), " ")


def title_case(c: str | Column) -> Column:
    """A capital after every non-letter, small letters elsewhere."""
    runs = F.regexp_extract_all(col(c), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    cased = F.transform(
        runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 2_000_000_000)))
    )
    return F.array_join(cased, "")


def standardize_case(c: str | Column, case: str = "lower") -> Column:
    return {"upper": F.upper, "lower": F.lower, "title": title_case}[case](col(c))


def remove_special_chars(c: str | Column, pattern: str = r"[^a-zA-Z0-9\s]") -> Column:
    return F.regexp_replace(col(c), pattern, "")


def fill_nulls(c: str | Column, value, words: list[str] = NULL_WORDS) -> Column:
    x = col(c)
    return F.when(x.isNull() | F.lower(x.cast("string")).isin(words), F.lit(value)).otherwise(x)


def starts_matching(c: str | Column, pattern: str) -> Column:
    """The pattern matches at the start of the text."""
    return col(c).cast("string").rlike(f"^(?:{pattern})")


def validate_format(c: str | Column, pattern: str, default=None) -> Column:
    x = col(c)
    return F.when(x.isNull(), x).when(starts_matching(x, pattern), x).otherwise(F.lit(default))


TRANSFORMS = {
    "uppercase": lambda c, p: F.upper(c),
    "lowercase": lambda c, p: F.lower(c),
    "trim": lambda c, p: strip(c),
    "date_format": lambda c, p: F.date_format(c, p.get("format", "yyyy-MM-dd")),
    "numeric": lambda c, p: to_float(c),
    "int": lambda c, p: to_int(c),
    "float": lambda c, p: to_float(c),
    "str": lambda c, p: to_str(c),
    "bool": lambda c, p: to_bool(c, p.get("text", False)),
    "regex_replace": lambda c, p: F.regexp_replace(c, p["pattern"], p.get("replacement", "")),
    "square": lambda c, p: square(c),
    "categorize": lambda c, p: categorize(c),
}


def apply_transform(c: Column, name: str | None, params: dict | None = None) -> Column:
    """A named transform; an unknown name leaves the value as it is."""
    made = TRANSFORMS.get(name)
    return made(c, params or {}) if made else c
