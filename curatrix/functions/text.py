"""Text columns. Java's patterns know ASCII white space only: (?U) and the separators 1C-1F make them agree with Python's."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

URL = r"(https?://\S+|www\.\S+)"
_SPACE = r"(?U)[\s\x1c-\x1f]+"
_INVISIBLE = "[​-‍⁠﻿]"


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Unicode compatibility normal form: Spark has no function for it."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, _SPACE, " "))


def clean_text(text: Column, normalize: bool = True, lowercase: bool = True, strip_urls: bool = False, ignore_case: bool = False) -> Column:
    """Normal form (of texts beyond ASCII), invisible characters out, URLs out, lower case, single spaces; null is ''."""
    out = F.coalesce(text, F.lit(""))
    if normalize:
        out = F.when(out.rlike(r"[^\x00-\x7F]"), nfkc(out)).otherwise(out)
    out = F.regexp_replace(out, _INVISIBLE, "")
    if strip_urls:
        out = F.regexp_replace(out, ("(?iU)" if ignore_case else "(?U)") + URL, " ")
    if lowercase:
        out = F.lower(out)
    return collapse_space(out)


def coalesce_text(text: str = "text", raw_text: str = "raw_text") -> Column:
    """The first of the two that is not empty, else ''."""
    return F.coalesce(F.nullif(F.col(text), F.lit("")), F.nullif(F.col(raw_text), F.lit("")), F.lit(""))


def has_url(text: Column) -> Column:
    return F.coalesce(text.rlike("(?iU)" + URL), F.lit(False))


def author_handle(*names: str) -> Column:
    """The first of the columns that is not blank, in lower case."""
    return F.lower(F.coalesce(*[F.nullif(F.trim(F.col(n)), F.lit("")) for n in names]))


def parse_time(text: Column) -> Column:
    """ISO 8601 to a UTC timestamp; null if it can't be read."""
    return F.try_to_timestamp(text)


def text_gate(text: Column, least: int = 20, most: int = 800) -> Column:
    """The text in single spaces, at most so many characters; null if it has too few."""
    one = collapse_space(F.coalesce(text, F.lit("")))
    return F.when(F.length(one) >= least, F.substring(one, 1, most))


def preview_text(text: Column, most: int = 100) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)
