"""Text preparation as column expressions; null in gives null out unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def base_name(path: Column) -> Column:
    """File name up to its first dot."""
    return F.substring_index(F.substring_index(path, "/", -1), ".", 1)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def windows_name(path: Column) -> Column:
    return F.substring_index(path, "\\", -1)


def clean_text(text: Column) -> Column:
    """Lower case without accents or other non-ASCII characters, white space as single blanks."""
    plain = F.translate(F.regexp_replace(text, "[\\r\\n]", " "), ACCENTED, PLAIN)
    ascii_only = F.regexp_replace(F.lower(plain), "[^\\x00-\\x7F]", "")
    return F.trim(F.regexp_replace(ascii_only, "[ \\t\\x0B\\f]+", " "))


def context_clean(text: Column) -> Column:
    """Line ends and tabs to blanks, then each pair of blanks to one (once), then stripped."""
    flat = F.replace(F.replace(text, F.lit("\n"), F.lit(" ")), F.lit("\t"), F.lit(" "))
    return F.trim(F.replace(flat, F.lit("  "), F.lit(" ")))


def squeeze(text: Column) -> Column:
    """ASCII letters and digits only."""
    return F.regexp_replace(text, "[^a-zA-Z0-9]", "")


def split_list(text: Column, pattern: str = "[>|,]") -> Column:
    """Items between ``>``, ``|`` and ``,``, stripped; empty items stay."""
    return F.transform(F.split(text, pattern, -1), lambda x: F.trim(x))


def split_authors(text: Column) -> Column:
    return split_list(text, ",")


def tokens(text: Column) -> Column:
    """Words between runs of (Unicode) white space; never an empty word."""
    return F.filter(F.split(text, "(?U)\\s+"), lambda t: t != "")


def epoch_seconds(date: Column) -> Column:
    return F.unix_timestamp(date.cast("timestamp"))


def parse_date(text: Column) -> Column:
    """ISO dates, else day-first dates, else null."""
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(text, F.lit("dd/MM/yyyy"))).cast("date")


def links(html: Column) -> Column:
    """Targets of ``href`` attributes in page order, repeats kept."""
    return F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))


def entities(text: Column) -> Column:
    """Offline stand-in for a named-entity model: capitalised runs, acronyms and numbers, once each."""
    found = F.regexp_extract_all(F.regexp_replace(text, "\n", " "), F.lit("([A-Z][a-z]+(?: [A-Z][a-z]+)+|[A-Z]{2,}|[0-9]+(?:\\.[0-9]+)?)"), F.lit(1))
    return F.array_distinct(found)


def min_max(value: Column, low: Column, high: Column) -> Column:
    """Scale to 0..1; a constant column gives null."""
    return F.try_divide(value - low, high - low)
