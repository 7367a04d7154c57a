"""Column functions over texts and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once a row, though ``use`` refers to it inside lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def tokens(column: Column) -> Column:
    """Distinct lower-case letter-or-digit runs."""
    return F.array_distinct(F.array_remove(F.split(F.lower(column), "[^a-z0-9]+"), ""))


def trigrams(text: Column) -> Column:
    """Distinct runs of three characters. Characters are split off first, so that a long text costs no search for each place."""
    runs = lambda x: F.transform(F.sequence(F.lit(1), F.size(x) - 2), lambda k: F.concat(F.element_at(x, k), F.element_at(x, k + 1), F.element_at(x, k + 2)))
    return F.array_distinct(let(F.split(text, ""), runs))


def normalised(name: Column) -> Column:
    """Lower-case letters and digits alone."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def name_tokens(name: Column) -> Column:
    """Lower-case words of a name, a file ending left off. Words end at anything but an ASCII letter or digit, before a capital that follows a small letter
    or digit, and before the last capital of a run of capitals that small letters follow; words of one character are dropped."""
    ends = "|".join(("[^A-Za-z0-9]+", "(?<=[a-z0-9])(?=[A-Z])", "(?<=[A-Z])(?=[A-Z][a-z0-9])"))
    return F.filter(F.transform(F.split(F.regexp_replace(name, "[.][^.]*$", ""), ends), F.lower), lambda t: F.length(t) > 1)


def name_variants(name: Column) -> Column:
    """The ways to write a name: as it is in lower case, its words joined by each of a few signs, and joined with capitals. Names of one character have none."""
    words = name_tokens(name)
    capitals = F.array_join(F.transform(words, F.initcap), "")
    written = [F.array_join(words, sign) for sign in ("_", "-", " ", "")] + [capitals, F.when(F.size(words) > 1, F.concat(F.lower(F.substring(capitals, 1, 1)), F.substring(capitals, 2, 1 << 20)))]
    ways = F.when(F.size(words) > 0, F.array_compact(F.array(*written))).otherwise(F.array().cast("array<string>"))
    return F.when(F.length(name) > 1, F.array_union(F.array(F.lower(name)), ways)).otherwise(F.array().cast("array<string>"))
