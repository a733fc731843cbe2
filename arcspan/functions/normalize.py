"""Normalisation of field values."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    """The last segment of a path with either separator; null stays null."""
    return F.element_at(F.split(F.translate(path, "\\", "/"), "/"), -1)


def to_int(value: Column) -> Column:
    """A decimal or 0x number as long, else null."""
    s = F.trim(value)
    hexed = F.conv(F.when(F.lower(s).rlike("^0x[0-9a-f]+$"), F.substring(s, 3, 64)), 16, 10).try_cast("long")
    return F.when(F.lower(s).startswith("0x"), hexed).otherwise(F.when(s.rlike("^[+-]?[0-9]+$"), s.try_cast("long")))


def clip01(value: Column) -> Column:
    """A score held within 0 and 1; null and NaN give 0."""
    return F.coalesce(F.when(F.isnan(value), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))), F.lit(0.0))


def finite(value: Column) -> Column:
    """Infinite, missing and undefined numbers as 0."""
    return F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), 0.0).otherwise(value)


def clean_name(name: str) -> str:
    """A column name in lower case, with underscores for white space and nothing but word characters."""
    return re.sub(r"[^0-9A-Za-z_]", "", re.sub(r"\s+", "_", name.strip())).lower()


def entropy(text: Column) -> Column:
    """Entropy in bits of a text's characters; 0 for null and empty texts.

    One pass over the sorted characters: the lengths of their runs are their counts.
    """
    chars = F.array_sort(F.filter(F.split(text, ""), lambda c: c != ""))
    weigh = lambda n: n * F.log2(n)
    state = lambda last, run, total: F.struct(last.alias("last"), run.alias("run"), total.alias("total"))
    step = lambda s, c: F.when(c == s["last"], state(c, s["run"] + 1.0, s["total"])).otherwise(state(c, F.lit(1.0), s["total"] + weigh(s["run"])))
    n = F.size(chars)
    sums = F.aggregate(chars, state(F.lit(""), F.lit(1.0), F.lit(0.0)), step, lambda s: s["total"] + weigh(s["run"]))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.log2(n) - sums / n))


def coalesce_alias(record: Column, names: list[str]) -> Column:
    """The first alias that a record (a map) holds.

    A plain key counts even if its value is null. A dotted key stands for a nested value (readers
    flatten records so) or a plain key of that name; where its value is null the search goes on.
    """
    out = F.lit(None).cast("string")
    for name in reversed(names):
        there = record[name].isNotNull() if "." in name else F.map_contains_key(record, F.lit(name))
        out = F.when(there, record[name]).otherwise(out)
    return out


def parse_time(text: Column) -> Column:
    """An ISO time as a timestamp: with `Z`, an offset or neither (then UTC by the session); else null."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(text), "[zZ]$", "+00:00"))


def age_days(text: Column, now: Column) -> Column:
    """Whole days (rounded down) from a time given as text until `now`; null if it cannot be read."""
    seconds = F.unix_micros(now) - F.unix_micros(parse_time(text))
    return F.floor(seconds / 86_400_000_000).cast("int")


def nested(text: Column, path: str) -> Column:
    """The value at a dotted path of JSON text as a string; null where the path leads nowhere."""
    return F.try_variant_get(F.try_parse_json(text), "$." + path, "string")
