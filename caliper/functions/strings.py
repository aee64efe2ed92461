"""String expressions on names, paths and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_token(s: Column, sep: str = " ") -> Column:
    return F.substring_index(s, sep, 1)


def last_segment(s: Column, sep: str = "/") -> Column:
    return F.element_at(F.split(s, sep), -1)


def strip_prefix(s: Column, prefix: str) -> Column:
    return F.when(F.startswith(s, F.lit(prefix)), F.substr(s, F.lit(len(prefix) + 1))).otherwise(s)


def strip_suffix(s: Column, suffix: str) -> Column:
    return F.when(F.endswith(s, F.lit(suffix)), F.left(s, F.char_length(s) - len(suffix))).otherwise(s)


def extract_int(s: Column, pattern: str) -> Column:
    """The first group of pattern as a long; NULL without a match."""
    return F.nullif(F.regexp_extract(s, pattern, 1), F.lit("")).try_cast("bigint")


def replace_first(s: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(s, f"(?s)^(.*?)(?:{pattern})", f"$1{by}")


def starred(s: Column, members: list[str]) -> Column:
    """'* ' before the labels that are members."""
    return F.when(s.isin(*members), F.concat(F.lit("* "), s)).otherwise(s)


def clean_file_name(s: Column) -> Column:
    """Without ' (N)' before the ending, .jpg as .png."""
    return F.regexp_replace(F.regexp_replace(s, r" \(\d+\)(?=\.)", ""), r"\.jpg$", ".png")


def safe_file_name(s: Column) -> Column:
    """Letters, digits, '.', '_' and '-' of any script; '_' for the rest."""
    return F.regexp_replace(s, r"[^\p{L}\p{N}._-]", "_")


def trailing_int(stem: Column) -> Column:
    """The number after the last '_'; NULL if it is none."""
    return F.substring_index(stem, "_", -1).try_cast("bigint")


def directory(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def snake_structure(s: Column) -> Column:
    """'ElytraLength' as 'elytra_length'."""
    return F.replace(F.lower(s), F.lit("elytra"), F.lit("elytra_"))


def joined_ints(xs: Column) -> Column:
    return F.array_join(F.transform(xs, lambda x: x.cast("string")), ",")


def first_int(s: Column) -> Column:
    return F.split_part(s, F.lit(","), F.lit(1)).try_cast("bigint")


def quoted_struct(s: Column, schema: str) -> Column:
    """A dict written with doubled or single quotes as a struct; NULL if it does not parse."""
    return F.from_json(F.replace(F.replace(s, F.lit('""'), F.lit('"')), F.lit("'"), F.lit('"')), schema)


def int_tuple(s: Column) -> Column:
    """'(480, 640)' as an array of longs."""
    return F.transform(F.split(F.regexp_replace(s, r"[()\s]", ""), ","), lambda x: x.try_cast("bigint"))
