"""Column expressions over column names: normalisers, tokenisers, legacy renames."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The abbreviation dictionary of the legacy rename.
ABBREVIATIONS = {
    "address": "addr",
    "customer": "cust",
    "created": "crtd",
    "amount": "amt",
    "status": "stat",
    "email": "eml",
}

DEFAULT_TABLE_CODE = "CUST"


def normalized(name: Column) -> Column:
    """Lower case without underscores; prefixes stay."""
    return F.replace(F.lower(name), F.lit("_"), F.lit(""))


def trigrams(name: Column) -> Column:
    """Distinct character trigrams of the lower-case name, none below three characters."""
    low = F.lower(name)
    # sequence(1, 0) would count down, so short names are guarded first.
    return F.when(
        F.length(low) >= 3,
        F.array_distinct(
            F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substr(low, i, F.lit(3)))
        ),
    ).otherwise(F.array().cast("array<string>"))


def word_tokens(name: Column) -> Column:
    """Distinct lower-case word tokens: split at case changes, digits and punctuation."""
    spaced = F.regexp_replace(name, r"(\p{Ll})(\p{Lu})", "$1_$2")
    spaced = F.regexp_replace(spaced, r"(\p{L})(\p{N})", "$1_$2")
    spaced = F.regexp_replace(spaced, r"(\p{N})(\p{L})", "$1_$2")
    parts = F.split(F.lower(spaced), r"[^\p{L}\p{N}]+")
    return F.array_sort(F.array_distinct(F.filter(parts, lambda t: t != "")))


def abbreviate(name: Column, dictionary: dict[str, str] | None = None) -> Column:
    """Replace whole ``_`` tokens by the dictionary (case-sensitive), then upper-case."""
    entries = dictionary or ABBREVIATIONS
    lookup = F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])
    short = F.transform(F.split(name, "_"), lambda t: F.coalesce(F.try_element_at(lookup, t), t))
    return F.upper(F.array_join(short, "_"))


def strip_vowels(name: Column) -> Column:
    return F.upper(F.regexp_replace(name, "(?i)[aeiou]", ""))


def table_prefix(name: Column, code: Column | str = DEFAULT_TABLE_CODE) -> Column:
    prefix = F.lit(code) if isinstance(code, str) else code
    return F.upper(F.concat_ws("_", prefix, name))


def case_flip(name: Column) -> Column:
    return F.upper(name)
