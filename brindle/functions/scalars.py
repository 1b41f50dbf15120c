"""Scalar functions as Column expressions: arrays, rounding, literal strings, random numbers from keys, counts in logarithms."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def max_index(a: Column) -> Column:
    """Position (from 0) of the largest element, the first of equals; -1 for an empty array."""
    return F.when(F.size(a) > 0, F.array_position(a, F.array_max(a)).cast("int") - 1).otherwise(F.lit(-1))


def min_index(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.array_position(a, F.array_min(a)).cast("int") - 1).otherwise(F.lit(-1))


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def normalized(a: Column) -> Column:
    """Elements by their sum; null where that is 0."""
    return F.when(array_sum(a) != 0, F.transform(a, lambda x: x / array_sum(a)))


def logs_to_probabilities(a: Column) -> Column:
    """exp of each element by the sum of all, shifted by the largest."""
    shifted = F.transform(a, lambda x: F.exp(x - F.array_max(a)))
    return F.transform(shifted, lambda x: x / array_sum(shifted))


def sorted_index(a: Column) -> Column:
    """Positions (from 0) in the order of the elements, equal ones as they stand; NaN counts as largest."""
    pairs = F.transform(a, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    return F.transform(F.array_sort(pairs), lambda p: p["i"])


def kth_of_array(a: Column, k: int) -> Column:
    return F.try_element_at(F.array_sort(a), F.lit(k))


def round_away(x: Column) -> Column:
    """To the nearest whole number, halves away from zero."""
    return (F.signum(x) * F.floor(F.abs(x) + 0.5)).cast("long")


def round_to(x: Column, digits: int) -> Column:
    """Halves away from zero at a number of digits."""
    scale = float(10**digits)
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale


def round_by_chance(x: Column, key: Column, seed: int = 1) -> Column:
    """Up with the probability of the fraction, by a hash of the key."""
    from ..operators.rows import uniform

    low = F.floor(x)
    return (low + (uniform(key, seed) < x - low).cast("int")).cast("long")


def without(text: Column, part: str) -> Column:
    """The text without any occurrence of a literal part."""
    return F.replace(text, F.lit(part), F.lit(""))


def replaced(text: Column, part: str, by: str) -> Column:
    return F.replace(text, F.lit(part), F.lit(by))


def padded(text: Column, width: int, left: bool = False) -> Column:
    """Blanks up to a width; longer texts stay whole."""
    gap = F.repeat(F.lit(" "), F.greatest(F.lit(width) - F.length(text), F.lit(0)))
    return F.concat(gap, text) if left else F.concat(text, gap)


def escaped(text: Column) -> Column:
    """Backslash, quotes, percent sign and line ends with a backslash before them."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for raw, made in (("'", "\\'"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r"), ('"', '\\"'), ("%", "\\%")):
        out = F.replace(out, F.lit(raw), F.lit(made))
    return out


def quoted(text: Column) -> Column:
    """In single quotes with escapes where the text is empty or has blanks, commas, braces, quotes, %, ? or line ends."""
    return F.when(text.rlike(r"[\s,{}'\"%\\]") | (text == "") | (text == "?"), F.concat(F.lit("'"), escaped(text), F.lit("'"))).otherwise(text)


def exponential(key: Column, seed: int = 1) -> Column:
    """A draw of mean one from a hash of the key."""
    from ..operators.rows import uniform

    return -F.log(F.greatest(1 - uniform(key, seed), F.lit(1e-12)))


def erlang(key: Column, shape: int, seed: int = 1) -> Column:
    """The sum of ``shape`` exponential draws."""
    return sum((exponential(F.concat_ws("/", key.cast("string"), F.lit(str(i))), seed) for i in range(shape)), F.lit(0.0))


def gamma(key: Column, shape: float, seed: int = 1, tries: int = 16) -> Column:
    """A draw from a gamma distribution by squeezed normals: the first of ``tries`` hashed proposals that is accepted (all
    are refused once in 10 ** 20 rows)."""
    from ..operators.rows import uniform

    boost = shape < 1
    a = shape + 1 if boost else shape
    d, c = a - 1 / 3, 1 / math.sqrt(9 * (a - 1 / 3))
    u = lambda name: uniform(F.concat_ws("/", key.cast("string"), F.lit(name)), seed)
    options = []
    for i in range(tries):
        z = F.sqrt(-2 * F.log(F.greatest(u(f"a{i}"), F.lit(1e-9)))) * F.cos(2 * math.pi * u(f"b{i}"))
        v = F.pow(1 + c * z, F.lit(3.0))
        good = (v > 0) & (F.log(F.greatest(u(f"c{i}"), F.lit(1e-300))) < z * z / 2 + d - d * v + d * F.log(F.greatest(v, F.lit(1e-300))))
        options.append(F.when(good, d * v))
    draw = F.coalesce(*options, F.lit(d))
    return draw * F.pow(F.greatest(u("boost"), F.lit(1e-12)), F.lit(1 / shape)) if boost else draw


def ln_factorial_upto(n: Column, most: int = 1 << 20) -> Column:
    """ln n! by Stirling's series, exact to about 1e-10 from 0 on."""
    x = n.cast("double") + 8.0
    series = (x + 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3.0))) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    for i in range(1, 9):
        series = series - F.log(n.cast("double") + i)
    return series


def log2_binomial(n: Column, k: Column) -> Column:
    return (ln_factorial_upto(n) - ln_factorial_upto(k) - ln_factorial_upto(n - k)) / math.log(2)


def log2_multinomial(parts: Column) -> Column:
    total = F.aggregate(parts, F.lit(0).cast("long"), lambda s, x: s + x)
    return (ln_factorial_upto(total) - F.aggregate(F.transform(parts, lambda x: ln_factorial_upto(x)), F.lit(0.0), lambda s, x: s + x)) / math.log(2)


def log2_hypergeometric(rows: Column, columns: Column, cells: Column) -> Column:
    """Log of the probability of a table of counts given its margins."""
    sums = lambda a: F.aggregate(F.transform(a, lambda x: ln_factorial_upto(x)), F.lit(0.0), lambda s, x: s + x)
    total = F.aggregate(rows, F.lit(0).cast("long"), lambda s, x: s + x)
    return (sums(rows) + sums(columns) - ln_factorial_upto(total) - sums(cells)) / math.log(2)
