"""Scalar expressions over labels, paths and sets; all of them Catalyst expressions but `sequence_ratio`."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What reads as a decimal floating-point number (no hexadecimal, no suffixes).
NUMBER = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?|nan)\s*$"

# Strings that label abstraction takes out, those replaced by a space first, then those deleted.
SPACED = ("[f] GLOB IN", "[f] IN ARG", ",", "(", ")", "[", "]", "{", "}")
DELETED = ('"', "=")
DROPPED_WORDS = ("align", "subgraphs")
DROPPED_MARKS = ("!", "#", "...", "~", "$")


def is_number(c: Column) -> Column:
    return c.rlike(NUMBER)


def words(c: Column) -> Column:
    """Non-empty pieces between white space."""
    return F.filter(F.split(c, r"\s+"), lambda x: x != "")


def abstract_label(label: Column, globals_: Column | None = None) -> Column:
    """An instruction's label without its local names, numbers and punctuation.

    Kept are struct types, string constants as `@.str`, and other words; names of `globals_` (an array, without `@`) go.
    """
    text = label
    for s in SPACED:
        text = F.replace(text, F.lit(s), F.lit(" "))
    for s in DELETED:
        text = F.replace(text, F.lit(s), F.lit(""))
    text = F.replace(text, F.lit(" metadata "), F.lit(" "))

    def keep(w: Column) -> Column:
        plain = ~w.isin(*DROPPED_WORDS) & ~is_number(w) & ~w.startswith("0x")
        for mark in DROPPED_MARKS:
            plain = plain & ~w.contains(mark)
        kept = F.when(w.contains("%"), w.contains("%struct.")).when(w.contains("@.str."), True).otherwise(plain)
        if globals_ is None:
            return kept
        return kept & ~(w.startswith("@") & F.coalesce(F.array_contains(globals_, F.substring(w, 2, 1 << 30)), F.lit(False)))

    shorten = lambda w: F.when(~w.contains("%") & w.contains("@.str."), "@.str").otherwise(w)
    return F.array_join(F.transform(F.filter(words(text), keep), shorten), " ")


def line_of_url(url: Column) -> Column:
    """The line of a position `…:line:column`."""
    return F.try_element_at(F.split(url, ":"), F.lit(-2)).cast("int")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def join_path(directory: Column, name: Column) -> Column:
    """An absolute name stands alone; else it is put behind the directory."""
    return F.when(name.startswith("/"), name).otherwise(F.concat(F.regexp_replace(directory, "/+$", ""), F.lit("/"), name))


def ngrams(items: Column, n: int) -> Column:
    """Runs of n items; none if there are fewer."""
    return F.when(F.size(items) >= n, F.transform(F.sequence(F.lit(1), F.size(items) - (n - 1)), lambda i: F.slice(items, i, n))).otherwise(F.slice(F.array(items), 1, 0))


def contains_all(whole: Column, part: Column) -> Column:
    return F.size(F.array_except(part, whole)) == 0


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matching characters over all characters, by longest matching blocks."""
    from difflib import SequenceMatcher

    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")
