"""Text expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The cleaning patterns and the token rule.
TAG = r"<[^>]+>"
NOT_KEPT = r"[^a-z0-9]+"
SPACES = r"\s+"
MIN_TERM_LENGTH = 2


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_text(c: Column | str) -> Column:
    """Lower-case, drop tags, keep ASCII letters and digits, collapse blanks; null gives ''.

    Removing a character and collapsing white space are one step here: any run
    of other characters, white space included, becomes a single blank.
    """
    text = F.lower(F.coalesce(_col(c).cast("string"), F.lit("")))
    for pattern in (TAG, NOT_KEPT):
        text = F.regexp_replace(text, pattern, " ")
    return F.trim(text)


def keeps_any(c: Column | str) -> Column:
    """Whether ``clean_text`` leaves anything, without cleaning."""
    text = F.lower(F.coalesce(_col(c).cast("string"), F.lit("")))
    return F.regexp_replace(text, TAG, " ").rlike("[a-z0-9]")


def collapse_whitespace(c: Column | str) -> Column:
    """Every run of (Unicode) white space becomes one blank; the ends are stripped."""
    return F.trim(F.regexp_replace(_col(c), r"(?U)\s+", " "))


def tokenize(c: Column | str, min_tokens: int = 1, max_tokens: int = 0) -> Column:
    """Split at white space, keep the first ``max_tokens`` (0 = all), [] below ``min_tokens``."""
    tokens = F.filter(F.split(F.coalesce(_col(c), F.lit("")), SPACES), lambda t: t != "")
    if max_tokens > 0:
        tokens = F.slice(tokens, 1, max_tokens)
    if min_tokens > 1:
        # A one-element array binds the tokens, so that the text is split once.
        long = F.filter(F.array(tokens), lambda t: F.size(t) >= min_tokens)
        return F.coalesce(F.get(long, F.lit(0)), F.array().cast("array<string>"))
    return tokens


def word_ngrams(tokens: Column | str, low: int = 1, high: int = 2) -> Column:
    """Word n-grams of ``low`` to ``high`` tokens, n-grams joined by a blank.

    Zipping the tokens with their own tail pairs neighbours; what runs over the
    end is null and filtered. A one-element ``transform`` binds the tokens, so
    that the expression producing them is evaluated once.
    """
    whole = 1 << 30

    def grams(toks: Column, n: int) -> Column:
        out = toks
        for shift in range(1, n):
            out = F.zip_with(
                out, F.slice(toks, shift + 1, whole), lambda a, b: F.concat(a, F.lit(" "), b)
            )
        return out

    joined = F.flatten(
        F.transform(
            F.array(_col(tokens)),
            lambda t: F.concat(*[grams(t, n) for n in range(low, high + 1)]),
        )
    )
    return F.filter(joined, lambda g: g.isNotNull()) if high > 1 else joined


def terms(c: Column | str, low: int = 1, high: int = 2, stop_words: tuple[str, ...] = ()) -> Column:
    """Vocabulary terms of a cleaned text: tokens of two or more characters, then n-grams."""
    kept = lambda t: F.length(t) >= MIN_TERM_LENGTH
    words = F.filter(F.split(F.coalesce(_col(c), F.lit("")), SPACES), kept)
    if stop_words:
        words = remove_stop_words(words, stop_words)
    return word_ngrams(words, low, high)


def remove_stop_words(tokens: Column | str, stop_words: tuple[str, ...]) -> Column:
    """Drop listed words, keeping order and repeats of the others."""
    return F.filter(_col(tokens), lambda t: ~t.isin(list(stop_words)))


def preview(c: Column | str, length: int = 180) -> Column:
    """First ``length`` characters, for display next to whole-text results."""
    return F.substring(_col(c), 1, length)


def category_from_path(c: Column | str) -> Column:
    """File name without its ending: ``…/Electronics.jsonl.gz`` gives ``Electronics``."""
    return F.regexp_extract(_col(c), r"([^/\\]+?)(?:\.[A-Za-z0-9]+)+$", 1)


@F.pandas_udf(T.StringType())
def strip_accents(text: pd.Series) -> pd.Series:
    """Decompose and drop combining marks (Spark has no such function)."""
    def plain(s: str | None) -> str | None:
        if s is None or s.isascii():
            return s
        return "".join(ch for ch in unicodedata.normalize("NFKD", s) if not unicodedata.combining(ch))

    return text.map(plain, na_action="ignore")
