"""Text cleaning and normalising as Column expressions.

Everything but Unicode normalisation is a built-in expression, so it runs in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

# The characters that count as whitespace for Python's ``str`` and ``re``, as a regex
# class body and as the characters themselves for trimming. Java's ``\s`` knows only the ASCII
# ones. Single characters plus one category are much faster to match than a list of ranges.
WHITESPACE = r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\p{Z}"
WHITESPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)

# Contractions and what they expand to, applied one after the other.
CONTRACTIONS = {
    "won't": "will not",
    "can't": "cannot",
    "n't": " not",
    "'re": " are",
    "'ve": " have",
    "'ll": " will",
    "'d": " would",
    "'m": " am",
}


def only_where(found: Callable[[Column], Column], change: Callable[[Column], Column], text: Column) -> Column:
    """``change`` of the texts in which it can find something, as a plain search says; the others stay as they are.

    As the element of an array, the text is computed once for both.
    """
    return F.get(F.transform(F.array(text), lambda t: F.when(found(t), change(t)).otherwise(t)), F.lit(0))


def strip_blank(text: Column) -> Column:
    """Trim Unicode whitespace at both ends."""
    return F.btrim(text, F.lit(WHITESPACE_CHARS))


def strip_urls(text: Column) -> Column:
    """Remove everything from ``http`` or ``www`` up to the next whitespace."""
    return only_where(lambda t: t.contains("http") | t.contains("www"),
                      lambda t: F.regexp_replace(t, rf"(?:http|www)[^{WHITESPACE}]+", ""), text)


def strip_emails(text: Column) -> Column:
    """Remove whitespace-free runs with an ``@`` that has characters on both sides.

    The look-behind lets a match start only where a run starts. It finds the same matches as
    an unanchored pattern and keeps the work on a long run of junk linear in its length.
    """
    return only_where(lambda t: t.contains("@"),
                      lambda t: F.regexp_replace(t, rf"(?<![^{WHITESPACE}])[^{WHITESPACE}]+@[^{WHITESPACE}]+", ""), text)


def strip_symbols(text: Column) -> Column:
    """Blank out whatever is not a letter, number, underscore, whitespace or ``.,!?;:'-``."""
    return F.regexp_replace(text, rf"[^\p{{L}}\p{{N}}_{WHITESPACE}.,!?;:'-]", " ")


def collapse_spaces(text: Column) -> Column:
    """One space for each run of whitespace, none at the ends."""
    # A single blank stays where it is.
    return F.trim(F.regexp_replace(text, rf"(?! [^{WHITESPACE}])[{WHITESPACE}]+", " "))


def clean_text(text: Column) -> Column:
    """The four cleaning steps in order; a null text gives an empty one."""
    return collapse_spaces(strip_symbols(strip_emails(strip_urls(F.coalesce(text, F.lit(""))))))


# Texts that are Python strings at a time.
NFKD_ROWS = 64


@F.arrow_udf(StringType())
def _nfkd_batch(texts: pa.Array) -> pa.Array:
    """A batch can hold whole documents by the thousand, so it is taken apart some rows at a time."""
    if texts.null_count == len(texts):
        return texts.cast(pa.string())
    slices = (texts.slice(at, NFKD_ROWS) for at in range(0, len(texts), NFKD_ROWS))
    return pa.concat_arrays([
        pa.array([text and unicodedata.normalize("NFKD", text) for text in part.to_pylist()], pa.string()) for part in slices])


def nfkd(text: Column) -> Column:
    """Unicode NFKD. Pure ASCII rows are left alone, and ICU, which Spark comes with, does most others where they lie.

    The form of an assigned character never changes, so ICU's tables and Python's agree on all that Java knows. Only texts with
    newer characters go to Python; the other rows cross as nulls.
    """
    foreign = text.rlike(r"[^\x00-\x7f]")
    by_icu = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), text, F.lit(True))
    return F.coalesce(_nfkd_batch(F.when(foreign & text.rlike(r"\p{Cn}"), text)), F.when(foreign, by_icu).otherwise(text))


def expand_contractions(text: Column) -> Column:
    def expanded(text: Column) -> Column:
        for short, full in CONTRACTIONS.items():
            text = F.replace(text, F.lit(short), F.lit(full))
        return text

    return only_where(lambda t: t.contains("'"), expanded, text)


def normalize_text(text: Column, lowercase: bool = True, unicode_form: bool = True) -> Column:
    """NFKD, lower case, contractions; a null text gives an empty one."""
    text = F.coalesce(text, F.lit(""))
    if unicode_form:
        text = nfkd(text)
    if lowercase:
        text = F.lower(text)
    return expand_contractions(text)
