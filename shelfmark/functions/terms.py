"""Text analysis: lower-cased runs of letters and digits, without English stop words."""

from __future__ import annotations

from unicodedata import category

from pyspark.sql import Column
from pyspark.sql import functions as F

# The public default English stop set of the classic analyzer.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in",
    "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the",
    "their", "then", "there", "these", "they", "this", "to", "was", "will", "with",
)

WORD_BREAK = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """All lower-cased words in order; may hold one empty string at either end."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), WORD_BREAK)


def is_term(word: Column) -> Column:
    """True for words that are indexed."""
    return (word != "") & ~word.isin(*STOP_WORDS)


def terms(text: Column) -> Column:
    """Indexed terms in order, repeats kept."""
    return F.filter(words(text), is_term)


def is_word(token: str) -> bool:
    """True when a token could be (part of) a term: letters and digits only."""
    return token != "" and all(category(c)[0] in "LN" for c in token)


def is_wildcard(token: str) -> bool:
    """True for tokens of letters, digits and at least one ``*`` (any run) or ``?`` (any one)."""
    rest = token.replace("*", "").replace("?", "")
    return rest != token and (rest == "" or is_word(rest))


def wildcard_regex(token: Column) -> Column:
    """The expression that a term must hold for a token of letters, digits, ``*`` and ``?``."""
    return F.replace(F.replace(token, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit("."))


def any_term_contains(text: Column, token: str) -> Column:
    """True when one indexed term contains ``token``, in which ``*`` and ``?`` are wildcards.

    A token with other characters never matches. A token that no stop word contains
    matches exactly when the lower-cased text contains it, so the text is not
    split; otherwise the same test goes first and spares most rows the split.
    """
    if is_wildcard(token):
        wanted = wildcard_regex(F.lit(token))
        return F.coalesce(F.exists(terms(text), lambda t: F.rlike(t, wanted)), F.lit(False))
    if not is_word(token):
        return F.lit(False)
    plain = F.lower(text).contains(token)
    if any(token in word for word in STOP_WORDS):
        plain = plain & F.exists(terms(text), lambda t: t.contains(token))
    return F.coalesce(plain, F.lit(False))


def _whole_word(token: str) -> str:
    # The token comes first: most positions then fail on one character, before the
    # character classes on either side are looked at.
    return rf"{token}(?<![\p{{L}}\p{{N}}]{token})(?![\p{{L}}\p{{N}}])"


def _can_be_term(token: str) -> bool:
    return is_word(token) and token not in STOP_WORDS


def has_term(text: Column, token: str) -> Column:
    """True when ``token`` is one of the indexed terms: a whole word of the lower-cased text."""
    if not _can_be_term(token):
        return F.lit(False)
    low = F.lower(text)
    found = low.contains(token) & low.rlike(_whole_word(token))
    return F.coalesce(found, F.lit(False))


def term_count(text: Column, token: str) -> Column:
    """How often ``token`` occurs among the indexed terms."""
    if not _can_be_term(token):
        return F.lit(0)
    return F.coalesce(F.regexp_count(F.lower(text), F.lit(_whole_word(token))), F.lit(0))
