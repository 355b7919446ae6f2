"""Column expressions over paths and texts; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as R


def java(pattern: str) -> str:
    """The pattern with ASCII word boundaries and an end that is the very end, as the rules mean them."""
    edge = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
    return pattern.replace(r"\b", edge)


def units(text: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def file_order(path: str = "path") -> Column:
    """Files go by their path, as words are sorted: without regard to case first."""
    return F.collate(F.col(path), "UNICODE")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """From the last dot of the path on, lower-cased; empty without a dot."""
    return F.lower(F.regexp_extract(path, r"(\.[^.]*)\z", 1))


def is_test(path: Column) -> Column:
    return F.lower(path).rlike(R.TEST_PATH.replace("$", r"\z"))


def is_lock(path: Column) -> Column:
    return F.lower(base_name(path)).isin(*R.LOCKS)


def is_binary(ext: Column) -> Column:
    return ext.isin(*R.BINARY)


def is_ignored(path: Column) -> Column:
    """By the default rules: a parent directory, the base name, or its suffix. See operators/ignore.py for a tree's own rules."""
    parts = F.split(F.lower(path), "/")
    parents = F.slice(parts, F.lit(1), F.size(parts) - 1)
    base = F.element_at(parts, -1)
    suffix = F.lit(False)
    for s in R.IGNORED_SUFFIXES:
        suffix = suffix | F.endswith(base, F.lit(s))
    return F.arrays_overlap(parents, F.array(*map(F.lit, R.IGNORED_DIRS))) | base.isin(*R.IGNORED_FILES) | suffix


def module_of(path: Column) -> Column:
    """The first folder, or the first two below one that holds many; no list of all folders is made."""
    first, two = F.substring_index(path, "/", 1), F.substring_index(path, "/", 2)
    wide = first.isin("src", "lib", "app", "packages", "server", "client")
    return F.when(first == path, "(root)").when(wide & (two != path), two).otherwise(first)


def entropy(value: Column) -> Column:
    """Shannon entropy of the characters over the length in UTF-16 units."""
    chars = F.split(value, "")
    n = units(value).cast("double")
    share = lambda c: (F.size(F.filter(chars, lambda x: x == c)) / n).cast("double")
    return F.when(n > 0, F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))).otherwise(0.0)


def line_count(text: Column) -> Column:
    return F.when(F.length(text) == 0, 0).otherwise(F.size(F.split(text, "\n"))).cast("long")


def squeezed(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, r"\s+", " "))


def is_comment(line: Column) -> Column:
    left = F.regexp_replace(line, r"^\s+", "")
    return left.rlike(r"^(//|/\*|\*|#)") & ~left.rlike("^#!") & (F.length(left) > 2)


def grade(score: Column) -> Column:
    out = None
    for least, name in R.GRADES:
        out = F.when(score >= least, name) if out is None else out.when(score >= least, name)
    return out.otherwise("F")


def penalty(severity: Column) -> Column:
    out = None
    for name, points in R.PENALTY.items():
        out = F.when(severity == name, points) if out is None else out.when(severity == name, points)
    return out


def diagnosis(score: Column) -> Column:
    """What an overall score means, in words."""
    return F.when(score >= 85, "healthy").when(score >= 70, "manageable").when(score >= 50, "needs attention").otherwise("critical")


def band(value: Column, scale: str) -> Column:
    """The colour of a grade ("badge", "card") or of a score ("donut", "bar") on one of the fixed scales."""
    steps, rest = R.BANDS[scale]
    test = (lambda least: value == least) if isinstance(steps[0][0], str) else (lambda least: value >= least)
    out = None
    for least, colour in steps:
        out = F.when(test(least), colour) if out is None else out.when(test(least), colour)
    return out.otherwise(rest)


def cycle_colour(in_cycle: Column, part: str) -> Column:
    """The colour of a graph's "edge", or of the "fill", "stroke" or "label" of a node."""
    looped, plain = R.CYCLE_COLOURS[part]
    return F.when(in_cycle, looped).otherwise(plain)


def shortened(text: Column, most: int) -> Column:
    """At most so many characters, the last an ellipsis where some were cut."""
    return F.when(F.char_length(text) > most, F.concat(F.left(text, F.lit(most - 1)), F.lit("…"))).otherwise(text)


def thousands(n: Column) -> Column:
    """1234 as 1.2k: the double n / 1000 to one digit as it stands in binary, ties to even. Spark's format_string rounds its decimal text instead."""
    x = n / 1000
    whole = F.floor(x)
    # the fraction in units of 2**-52, which a double above 1 is a multiple of; all whole numbers from here on
    tenths = ((x - whole) * F.lit(float(1 << 52))).cast("long") * 10
    digit, rest = F.shiftright(tenths, 52), tenths.bitwiseAND(F.lit((1 << 52) - 1))
    up = (rest > 1 << 51) | ((rest == 1 << 51) & (digit % 2 == 1))
    tenth = digit + F.when(up, 1).otherwise(0)
    short = F.concat((whole + F.when(tenth == 10, 1).otherwise(0)).cast("string"), F.lit("."), (tenth % 10).cast("string"), F.lit("k"))
    return F.when(n >= 1000, short).otherwise(n.cast("string"))


def xml(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def plural(n: Column, one: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many))


def severity_rank(severity: Column) -> Column:
    out = None
    for i, name in enumerate(R.PENALTY):
        out = F.when(severity == name, i) if out is None else out.when(severity == name, i)
    return out


def one_step_down(severity: Column) -> Column:
    return F.when(severity == "critical", "major").when(severity == "major", "minor").otherwise("info")
