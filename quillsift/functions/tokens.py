"""Word and sentence splitting as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from quillsift.functions.cleaning import WHITESPACE, only_where, strip_blank

_WORD = r"[\p{L}\p{M}\p{N}_]+"
# Numbers with inner separators, possessives, words with inner hyphen/dot/apostrophe, ellipsis,
# dash, single marks.
TOKEN_PATTERN = (
    rf"\p{{N}}+(?:[.,:]\p{{N}}+)+|'s|{_WORD}(?:[-.']{_WORD})*|\.\.\.|--|[.,!?;:'-]"
)
# Two or more letters, numbers or underscores: the terms of the TF-IDF vocabulary.
TERM_PATTERN = r"[\p{L}\p{N}_]{2,}"
_BREAK = "\u0001"


def split_whitespace(text: Column) -> Column:
    """Pieces between whitespace; an empty array for a blank text."""
    return F.regexp_extract_all(text, F.lit(rf"[^{WHITESPACE}]+"), F.lit(0))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(rf"[^{WHITESPACE}]+")), F.lit(0))


def tokenize_words(text: Column) -> Column:
    """Word and punctuation tokens of a cleaned text."""
    text = only_where(lambda t: t.contains("cannot"), lambda t: F.regexp_replace(t, r"\bcannot\b", "can not"), text)
    text = only_where(lambda t: t.contains("'s"), lambda t: F.regexp_replace(t, r"'s\b", " 's"), text)
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))


def drop_stop_words(tokens: Column, stop_words: Sequence[str]) -> Column:
    """Tokens whose lower case is not in ``stop_words`` (a short literal list)."""
    words = [word.lower() for word in stop_words]
    return F.filter(tokens, lambda token: ~F.lower(token).isin(words))


def tokenize_sentences(text: Column, abbreviations: Sequence[str] = ()) -> Column:
    """Sentences end at ``. ! ?`` followed by whitespace.

    A full stop after one of ``abbreviations`` (given without it) does not end a sentence.
    """
    if abbreviations:
        names = "|".join(abbreviations)
        guard = rf"(?<!(?<![\p{{L}}\p{{N}}_])(?:{names})\.)"
    else:
        guard = ""
    marked = F.regexp_replace(text, rf"([.!?]+){guard}[{WHITESPACE}]+", f"$1{_BREAK}")
    return F.filter(F.split(marked, _BREAK), lambda sentence: sentence != "")


def split_sentences_fallback(text: Column) -> Column:
    """Pieces between runs of ``. ! ?``, trimmed, blanks dropped."""
    pieces = F.transform(F.split(text, "[.!?]+"), strip_blank)
    return F.filter(pieces, lambda piece: piece != "")


def bare_words(text: Column) -> Column:
    """Whitespace-separated words of a cleaned text with punctuation taken out."""
    return F.regexp_extract_all(
        F.regexp_replace(text, "[.,!?;:'-]+", ""), F.lit(rf"[^{WHITESPACE}]+"), F.lit(0)
    )


def ngrams(tokens: Column, n: int, separator: str = _BREAK) -> Column:
    """Neighbouring tokens joined by a separator; empty when there are too few.

    Strings rather than structs, because ``array_distinct`` on strings is many times faster.
    ``tokens`` is used several times: pass a column, not an expression.
    """
    size = F.size(tokens)
    joined = tokens
    for width in range(2, n + 1):
        count = F.greatest(size - F.lit(width - 1), F.lit(0))
        joined = F.zip_with(
            F.slice(joined, F.lit(1), count),
            F.slice(tokens, F.lit(width), count),
            lambda left, right: F.concat(left, F.lit(separator), right),
        )
    return joined


def term_words(text: Column) -> Column:
    """Words of two or more characters, the single-word terms of TF-IDF."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM_PATTERN), F.lit(0))
