"""Query terms, index tokens and the keyword score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: terms of a query.
TERM = "[a-zA-Z0-9][a-zA-Z0-9_.:-]*"
#: Tokens of the index, over lower-cased text.
TOKEN = "[a-z0-9]+"


def query_terms(query: Column) -> Column:
    """Lower-cased terms of two or more characters, in order, repeats kept; empty for null."""
    terms = F.transform(F.regexp_extract_all(query, F.lit(TERM), F.lit(0)), F.lower)
    return F.coalesce(F.filter(terms, lambda t: F.length(t) >= 2), F.array().cast("array<string>"))


def index_tokens(text: Column) -> Column:
    """Lower-cased runs of a-z and 0-9; empty for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def keyword_fraction(text: Column, terms: Column) -> Column:
    """Share of the terms that stand in the text as whole words, to 4 places."""
    low = F.lower(text)
    held = F.filter(terms, lambda t: F.regexp_like(low, F.concat(F.lit(r"\b"), F.replace(t, F.lit("."), F.lit(r"\.")), F.lit(r"\b"))))
    return F.round(F.size(held) / F.size(terms), 4)


def needs_keywords(query: Column) -> Column:
    """Whether a query holds an identifier (12 or more of a-z, 0-9, _ and -, with a digit), for which hybrid search suits better."""
    return F.exists(query_terms(query), lambda t: t.rlike("^[a-z0-9][a-z0-9_-]{11,}$") & t.rlike("[0-9]"))
