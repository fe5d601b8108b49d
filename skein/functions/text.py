"""Text expressions: tokens, words, sentences and set overlaps, all as JVM columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "[a-z0-9]+"
STOPWORDS = ("a", "an", "the", "and", "are", "is", "by", "for", "in", "of", "to", "does", "how", "what", "where", "which", "who")


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(c: Column | str) -> Column:
    """Runs of a-z and 0-9 in the lower-cased text; none of a null text."""
    return F.coalesce(F.regexp_extract_all(F.lower(_c(c)), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def token_set(c: Column | str) -> Column:
    return F.array_distinct(tokens(c))


def content_tokens(c: Column | str, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Distinct tokens without stopwords, in order of appearance."""
    return F.array_except(tokens(c), F.array(*map(F.lit, stopwords)))


def words(c: Column | str) -> Column:
    """Pieces between white space."""
    return F.filter(F.split(F.coalesce(_c(c), F.lit("")), r"\s+"), lambda x: x != "")


def word_count(c: Column | str) -> Column:
    return F.size(words(c))


def bigrams(t: Column, glue: str) -> Column:
    """Adjacent pairs of an array of tokens, joined by glue."""
    n = F.greatest(F.size(t) - 1, F.lit(0))
    return F.zip_with(F.slice(t, 1, n), F.slice(t, 2, n), lambda a, b: F.concat(a, F.lit(glue), b))


def features(c: Column | str, glue: str = "__") -> Column:
    """Tokens, then their bigrams."""
    t = tokens(c)
    return F.concat(t, bigrams(t, glue))


def clean_space(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(_c(c), F.lit("")), r"\s+", " "))


def sentences(c: Column | str) -> Column:
    """White space collapsed, split behind . ! or ? and a space."""
    return F.filter(F.split(clean_space(c), r"(?<=[!?.])\s+"), lambda x: x != "")


def paragraphs(c: Column | str) -> Column:
    """Split at blank lines, white space collapsed."""
    return F.filter(F.transform(F.split(F.coalesce(_c(c), F.lit("")), r"\n\s*\n"), clean_space), lambda x: x != "")


def support_token(t: Column) -> Column:
    """A token without its last s, if it is longer than three characters."""
    return F.when((F.length(t) > 3) & F.endswith(t, F.lit("s")), F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t)


def overlap(query: Column, document: Column) -> Column:
    """Share of the distinct tokens of query that document has; 0 if query has none."""
    q = F.array_distinct(query)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(q, document)).cast("double"), F.size(q).cast("double")), F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two arrays as sets; 1 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double")), F.lit(1.0))


def normalize_answer(c: Column | str) -> Column:
    return F.lower(clean_space(c))


REFUSALS = ("i do not know", "i don t know", "cannot determine", "can not determine", "insufficient context", "not enough information")


def is_refusal(c: Column | str, markers: tuple[str, ...] = REFUSALS) -> Column:
    """Whether an answer, lower-cased and without apostrophes, has one of the markers."""
    t = clean_space(F.regexp_replace(F.lower(_c(c)), "['’]", " "))
    out = F.lit(False)
    for m in markers:
        out = out | F.contains(t, F.lit(m))
    return out


def canonical_url(c: Column | str) -> Column:
    """Lower-case URL without scheme, www., query, fragment and last slash."""
    return F.regexp_replace(F.regexp_replace(F.lower(_c(c)), r"^https?://(www\.)?|[?#].*$", ""), "/+$", "")


def strip_html(c: Column | str) -> Column:
    """Text of a page: scripts, styles, comments and tags go, white space collapses."""
    t = F.regexp_replace(_c(c), r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ")
    return clean_space(F.regexp_replace(t, r"(?s)<[^>]*>", " "))
