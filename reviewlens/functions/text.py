"""Predicates and tokenisers over review text."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewlens import fixed_values as fixed

CJK = "\\u4e00-\\u9fff"
_WORD = f"[\\p{{L}}\\p{{N}}&&[^{CJK}]]+"
#: A CJK run or a word of another script.
PIECE = f"[{CJK}]+|{_WORD}"

Tokenizer = Callable[[Column], Column]


def any_of(words: Iterable[str]) -> str:
    """A pattern that finds any of the words anywhere in a text."""
    return "|".join(re.escape(w) for w in words)


def contains_any(column: Column, pattern: str) -> Column:
    return column.rlike(pattern)


def length_between(column: Column, limits: tuple[int, int]) -> Column:
    return F.char_length(column).between(*limits)


def newlines_marked(content: Column) -> Column:
    return F.replace(content, F.lit("\n"), F.lit(fixed.NEWLINE_MARK))


def has_url(content: Column) -> Column:
    return content.rlike(fixed.URL_PATTERN)


def has_letters_beyond_ascii(content: Column) -> Column:
    """False for a text made only of ASCII letters, digits, punctuation and blanks."""
    return content.rlike("[^A-Za-z0-9\\p{P}\\p{S}\\s]")


def is_cjk(word: Column) -> Column:
    return word.rlike(f"^[{CJK}]+$")


def stripped(line: Column) -> Column:
    """Without white space at either end, the ideographic blank included."""
    return F.regexp_replace(line, "^[\\s\\u3000]+|[\\s\\u3000]+$", "")


def tokens_precise(content: Column) -> Column:
    """Words of spaced scripts; CJK runs cut into pieces of two characters."""
    return F.regexp_extract_all(content, F.lit(f"[{CJK}]{{1,2}}|{_WORD}"), F.lit(0))


def tokens_full(content: Column) -> Column:
    """Words of spaced scripts; every pair of neighbours in a CJK run."""
    return _tokens(content, single=False)


def tokens_search(content: Column) -> Column:
    """As the full mode, with the single characters of each CJK run as well; repeated ones count."""
    return _tokens(content, single=True)


def _tokens(content: Column, single: bool) -> Column:
    def cut(run: Column) -> Column:
        n = F.char_length(run)
        pairs = F.transform(
            F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(run, i, 2)
        )
        if single:
            singles = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(run, i, 1))
            pairs = F.when(n > 1, F.concat(singles, pairs)).otherwise(singles)
        return F.when(run.rlike(f"^[{CJK}]"), pairs).otherwise(F.array(run))

    runs = F.regexp_extract_all(content, F.lit(PIECE), F.lit(0))
    return F.flatten(F.transform(runs, cut))


def repeat_ratio(tokens: Column) -> Column:
    """1 - distinct / all tokens; a slash inside a token separates tokens too."""
    parts = F.split(F.array_join(tokens, "/"), "/")
    return 1 - F.size(F.array_distinct(parts)) / F.size(parts)
