"""Labels and recodes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trapline import constants as K
from trapline.functions.missing import contains_text, number_text, text_or_na

# Where a new word starts: at any run of separators, between lower and upper case, before the last
# capital of a run of capitals that a lower-case letter follows, and on either side of digits.
_SEPARATORS = r"[^\p{L}\p{N}]+"
_WORD_GAP = (
    _SEPARATORS + r"|(?<=\p{Ll})(?=\p{Lu})"
    r"|(?<=\p{Lu})(?=\p{Lu}\p{Ll})"
    r"|(?<=\p{L})(?=\p{N})"
    r"|(?<=\p{N})(?=\p{L})"
)


def sentence_case(column: Column) -> Column:
    """Words separated by single spaces, all lower case but for the first letter."""
    # Most names are lower case without digits, where only separators end a word.
    spaced = F.when(
        column.rlike(r"[\p{Lu}\p{N}]"), F.regexp_replace(column, _WORD_GAP, " ")
    ).otherwise(F.regexp_replace(column, _SEPARATORS, " "))
    words = F.lower(F.trim(spaced))
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 2**31 - 1))


def effort_label(column: Column) -> Column:
    """Trapping effort as text; zero means it was not reported."""
    return F.when(column == 0, F.lit(K.NOT_REPORTED)).otherwise(number_text(column))


def speciation_label(column: Column) -> Column:
    """Method of species identification, with the combined method spelt out."""
    both = column == F.lit(K.BOTH_METHODS_RAW)
    return F.when(both, F.lit(K.BOTH_METHODS_LABEL)).otherwise(sentence_case(column))


def assay_status(column: Column) -> Column:
    """What the number of an assay row counts: animals assayed, animals positive, or other."""
    return (
        F.when(contains_text(column, K.TESTED), F.lit(K.STATUS_ASSAYED))
        .when(contains_text(column, K.POSITIVE), F.lit(K.STATUS_POSITIVE))
        .otherwise(F.lit(K.STATUS_OTHER))
    )


def popup_label(*parts: str | Column) -> Column:
    """Text parts and values joined without a separator; plain strings are taken literally."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else text_or_na(p) for p in parts])
