"""Text expressions: each is a Column built from Spark's own functions, unless it says otherwise."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The character classes of the corpus rules.
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
SPACE = r"(?U)[\s\x1c-\x1f]"
LETTERS = "A-Za-z0-9ĄąĆćĘęŁłŃńÓóŚśŹźŻż"
KEPT = r"?.,:;'!\"\-"
WORD = r"[\p{L}\p{N}_]+"
SEPARATOR = "\x1f"
#: Fixed value: Latin characters that are their own NFKC form; longer texts of these alone need no normalising.
NFKC_STABLE = r"^[\x00-\x9F¡-§©«-®°±¶·»¿-ıĴ-ľŁ-ňŊ-ž]*$"


def nfkc_of(form: str):
    @F.pandas_udf("string")
    def normalise(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize(form, t))

    return normalise


def normalise_form(df: DataFrame, columns: list[str], form: str) -> DataFrame:
    """Replaces text columns by their Unicode normal form.

    Spark has no such function, so Python is called; texts that a pattern shows to be unchanged are sent as nulls, which cost next to nothing.
    """
    if form not in ("NFC", "NFKC", "NFD", "NFKD"):
        raise ValueError(f"no Unicode normal form {form!r}")
    stable = NFKC_STABLE if form in ("NFC", "NFKC") else r"^[\x00-\x7F]*$"
    udf = nfkc_of(form)
    return df.withColumns({c: F.coalesce(udf(F.when(~F.col(c).rlike(stable), F.col(c))), F.col(c)) for c in columns})


def remove_control(c: Column) -> Column:
    return F.regexp_replace(c, CONTROL, "")


def collapse_space(c: Column) -> Column:
    return F.regexp_replace(c, SPACE + "+", " ")


def strip_space(c: Column) -> Column:
    """Strips Unicode white space from both ends."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def normalise(c: Column, control: bool = True, collapse: bool = True, strip: bool = True) -> Column:
    """Control characters go before white space is collapsed, and ends are stripped last; the normal form is a matter of ``normalise_form``."""
    if control:
        c = remove_control(c)
    if collapse:
        c = collapse_space(c)
        return F.trim(c) if strip else c
    return strip_space(c) if strip else c


def single_spaced(c: Column) -> Column:
    return F.trim(collapse_space(c))


def drop_bracketed(c: Column) -> Column:
    return F.regexp_replace(c, r"\[[^\]]*\]", " ")


def fold_dashes(c: Column) -> Column:
    return F.translate(c, "–—−", "---")


def drop_leading_ellipses(c: Column) -> Column:
    """Ellipses that follow no letter or digit; the look back comes last, so it is made at ellipses alone."""
    return F.regexp_replace(c, rf"\.{{3}}(?<![{LETTERS}]\.{{3}})", " ")


def drop_inner_ellipses(c: Column) -> Column:
    """Ellipses that do not end the text."""
    return F.regexp_replace(c, r"(?U)\.{3}(?![\s\x1c-\x1f]*\z)", " ")


def keep_allowed(c: Column) -> Column:
    return F.regexp_replace(c, rf"[^ {LETTERS}{KEPT}]", " ")


def drop_dash_marker(c: Column) -> Column:
    return F.regexp_replace(c, r"^ *-+ *", "")


def blank_dashes_before_text(c: Column) -> Column:
    """Every dash before the first letter or digit becomes a space."""
    return F.regexp_replace(c, rf"\G([^{LETTERS}\-]*)-", "$1 ")


def sanitise(c: Column) -> Column:
    """The audit's sanitiser: dashes folded, stray ellipses and foreign characters dropped, dash markers removed, white space collapsed (spaces: no other is left by then)."""
    for step in (fold_dashes, drop_leading_ellipses, drop_inner_ellipses, keep_allowed, drop_dash_marker, blank_dashes_before_text):
        c = step(c)
    return F.trim(F.regexp_replace(c, " {2,}", " "))


def word_count(c: Column) -> Column:
    """Words between Unicode white space; an empty text has none."""
    return F.size(F.regexp_extract_all(c, F.lit(r"(?U)[^\s\x1c-\x1f]+"), F.lit(0)))


def word_count_single_spaced(c: Column) -> Column:
    """The same for texts whose white space is collapsed and stripped, without a pattern."""
    return F.when(c == "", 0).otherwise(F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit(""))) + 1)


def words(c: Column) -> Column:
    """Word tokens, lower-cased after extraction."""
    return F.transform(F.regexp_extract_all(c, F.lit(WORD), F.lit(0)), F.lower)


def pair_key(source: Column, target: Column) -> Column:
    return F.concat(source, F.lit(SEPARATOR), target)


def prompt_line(row_id: Column, source: Column, target: Column) -> Column:
    return F.concat(F.lit("id:"), row_id.cast("string"), F.lit(" pl:"), source, F.lit(" en:"), target)


def one_line(c: Column) -> Column:
    return F.replace(c, F.lit("\n"), F.lit(" "))


def utc_stamp() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
