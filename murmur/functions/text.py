"""Text, tag and symbol expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from murmur.settings import CASHTAG_PATTERN, WHALE_SIGNAL

# Unicode separators and the control characters that count as white space.
_BLANKS = r"[\s\x1c-\x1f\x85\p{Z}]+"
_INK = r"[^\s\x1c-\x1f\x85\p{Z}]"


def normalize_text(col: Column) -> Column:
    """NULL becomes '', runs of white space become one space, ends are trimmed."""
    text = F.coalesce(col.cast("string"), F.lit(""))
    return F.trim(F.regexp_replace(text, _BLANKS, " "))


def first_text(*cols: Column) -> Column:
    """The first column that is not blank, normalised; NULL if all are blank.

    Choosing first and normalising after means one pass over one text.
    """
    candidates = [c.cast("string") for c in cols]
    chosen = F.coalesce(*[F.when(c.rlike(_INK), c) for c in candidates])
    return F.trim(F.regexp_replace(chosen, _BLANKS, " "))


def no_strings() -> Column:
    return F.array().cast("array<string>")


def extract_cashtags(text: Column) -> Column:
    """Symbols written as ``$SYMBOL``: upper case, distinct, in order of first use."""
    found = F.regexp_extract_all(text, F.lit(CASHTAG_PATTERN), F.lit(1))
    return F.coalesce(F.array_distinct(F.transform(found, F.upper)), no_strings())


def _clean_tags(tags: Column) -> Column:
    cleaned = F.transform(tags, lambda t: F.upper(F.btrim(normalize_text(t), F.lit("#$"))))
    return F.filter(cleaned, lambda t: t != "")


def ensure_list(tags: Column) -> Column:
    """An array column as clean upper-case tags; NULL becomes an empty array."""
    return F.when(F.size(tags) > 0, _clean_tags(tags)).otherwise(no_strings())


def ensure_list_from_json(tags: Column) -> Column:
    """As ``ensure_list`` for text that holds either a JSON array or one scalar."""
    trimmed = F.trim(tags)
    as_array = F.when(trimmed.startswith("["), F.from_json(trimmed, "array<string>"))
    return ensure_list(F.coalesce(as_array, F.when(tags.isNotNull(), F.array(tags))))


def target_symbols(target: Column) -> Column:
    """A normalised target coin as a list of at most one symbol; the sentinel gives none."""
    symbol = F.upper(F.btrim(target, F.lit("#$")))
    usable = (symbol != "") & (F.upper(target) != WHALE_SIGNAL)
    return F.when(usable, F.array(symbol)).otherwise(no_strings())


def normalize_target(target: Column) -> Column:
    return target_symbols(normalize_text(target))


def first_non_empty(*lists: Column) -> Column:
    """The first array with an element, else an empty array."""
    chosen = F.when(F.size(lists[0]) > 0, lists[0])
    for candidate in lists[1:]:
        chosen = chosen.when(F.size(candidate) > 0, candidate)
    return chosen.otherwise(no_strings())


def normalize_coin(coin: Column) -> Column:
    """Upper case without dollar signs."""
    return F.replace(F.upper(coin), F.lit("$"), F.lit(""))


def preview(text: Column, width: int) -> Column:
    """One line of at most ``width`` characters."""
    return F.substring(F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(" ")), 1, width)
