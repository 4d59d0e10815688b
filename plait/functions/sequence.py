"""Column functions over sequences, scores and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The largest value that saturating arithmetic gives.
SATURATED = 2**63 - 1


def encode_bases(seq: Column | str) -> Column:
    """A, C, G, T, N of either case as digits 0 to 4. Other letters are an error."""
    seq = F.col(seq) if isinstance(seq, str) else seq
    up = F.upper(seq)
    return F.when(up.rlike("[^ACGTN]"), F.raise_error(F.lit("a sequence holds a letter outside ACGTN"))).otherwise(F.translate(up, "ACGTN", "01234"))


def decode_bases(digits: Column | str) -> Column:
    """Digits 0 to 4 as A, C, G, T, N."""
    return F.translate(digits, "01234", "ACGTN")


def letters_to_bases(text: Column | str) -> Column:
    """A deterministic sequence over acgt from prose: Latin letters, each by its place modulo four."""
    return F.translate(F.regexp_replace(F.lower(text), "[^a-z]", ""), "abcdefghijklmnopqrstuvwxyz", ("acgt" * 7)[:26])


def kmers(seq: Column | str, k: int) -> Column:
    """All substrings of length k in order, by overlapping matches in one pass; an empty array if there
    are none."""
    seq = F.col(seq) if isinstance(seq, str) else seq
    return F.regexp_extract_all(seq, F.lit(f"(?=(.{{{k}}}))"), F.lit(1))


def saturating_add(a: Column, b: Column) -> Column:
    """a + b for non-negative longs, the largest long on overflow."""
    return F.coalesce(F.try_add(a, b), F.lit(SATURATED))


def saturating_multiply(a: Column, b: Column) -> Column:
    """a * b for non-negative longs, the largest long on overflow."""
    return F.coalesce(F.try_multiply(a, b), F.lit(SATURATED))


def add_log(a: Column, b: Column) -> Column:
    """log(exp(a) + exp(b)) without overflow."""
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def hoelder_mean(x: Column, p: float) -> Column:
    """Aggregate: the generalised mean of positive values; p = 0 is the geometric, infinite p the extreme."""
    if p == 0:
        return F.exp(F.avg(F.log(x)))
    if p == float("inf"):
        return F.max(x)
    if p == float("-inf"):
        return F.min(x)
    return F.pow(F.avg(F.pow(x, F.lit(p))), F.lit(1.0 / p))


def integer_median(x: Column) -> Column:
    """Aggregate: the median of integers, of even counts the two middle ones' mean rounded towards zero."""
    sorted_ = F.array_sort(F.collect_list(x))
    n = F.size(sorted_)
    middle = F.element_at(sorted_, (F.ceil(n / 2)).cast("int")) + F.element_at(sorted_, (F.floor(n / 2) + 1).cast("int"))
    return F.when(n > 0, (middle / 2).cast("long"))


#: Score functions of anchors, by name.
INVERSE_COUNT, LENGTH_SCALE, CONCAVE, CONCAVE_DIFFERENCE = range(4)


def anchor_weight(function: int, length: Column, count1: Column, count2: Column, full_length: Column | None = None, power: float = 0.5, intercept: float = 2250.0, decay: float = 2.0) -> Column:
    """Weight of a match of ``length`` that occurs count1 and count2 times, as part of a match of
    ``full_length``: long and rare matches weigh most; in the concave functions the weight of a length
    beyond the intercept falls again."""
    full_length = length if full_length is None else full_length
    length = length.cast("double")
    count = (count1 * count2).cast("double")
    part = length / full_length
    falling = F.pow(length / intercept, F.lit(float(decay))) * intercept
    if function == INVERSE_COUNT:
        return part / F.pow(count, F.lit(power))
    if function == LENGTH_SCALE:
        return part * length / F.pow(count, F.lit(power))
    if function == CONCAVE:
        return part * (length / F.pow(count, F.lit(power)) - falling)
    if function == CONCAVE_DIFFERENCE:
        return part * (length - count * falling)
    raise ValueError(f"no score function {function}")


def gap_score(gap: Column, opens: list[float], extends: list[float], scale: float = 1.0) -> Column:
    """Piecewise-affine score of a gap, zero without one: the best piece of minus open plus extend by length."""
    size = F.abs(gap)
    pieces = [-(F.lit(float(o)) + F.lit(float(e)) * size) * F.lit(float(scale)) for o, e in zip(opens, extends)]
    best = pieces[0] if len(pieces) == 1 else F.greatest(*pieces)
    return F.when(size == 0, F.lit(0.0)).otherwise(best)


def parse_bool(text: Column) -> Column:
    """The twelve spellings of a truth value; others are an error."""
    # fixed values: accepted spellings
    true, false = ["1", "t", "T", "true", "TRUE", "True"], ["0", "f", "F", "false", "FALSE", "False"]
    return F.when(text.isin(true), True).when(text.isin(false), False).otherwise(F.raise_error(F.concat(F.lit("not a truth value: "), text)))


def subpath(name: Column) -> tuple[Column, Column, Column]:
    """(path, begin, end) of ``path:begin-end``, split at the last colon; nulls if the name has no range."""
    pattern = r"^(.*):([0-9]+)-([0-9]+)$"
    ranged = name.rlike(pattern)
    part = lambda i: F.when(ranged, F.regexp_extract(name, pattern, i))
    return part(1), part(2).cast("long"), part(3).cast("long")


# --- text and numbers ------------------------------------------------------------------------------

# fixed values: the spellings of truth values
TRUE_WORDS, FALSE_WORDS = ("true", "True", "TRUE", "t", "T", "1"), ("false", "False", "FALSE", "f", "F", "0")


def tokenize(text: Column | str, separator: str) -> Column:
    """Parts between separators; an empty part at the end is left out."""
    parts = F.split(F.col(text) if isinstance(text, str) else text, f"\\Q{separator}\\E", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def join(parts: Column | str, separator: str) -> Column:
    return F.array_join(parts, separator)


def parse_int(text: Column | str) -> Column:
    """A whole number; other text is an error."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(text.rlike("^[+-]?[0-9]+$"), text.cast("long")).otherwise(F.raise_error(F.concat(F.lit("not a whole number: "), text)).cast("long"))


def parse_double(text: Column | str) -> Column:
    """A number; other text is an error."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(text.rlike("^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$"), text.cast("double")).otherwise(F.raise_error(F.concat(F.lit("not a number: "), text)).cast("double"))


def parse_truth(text: Column | str) -> Column:
    """A truth value in one of its twelve spellings; other text is an error."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(text.isin(*TRUE_WORDS), True).when(text.isin(*FALSE_WORDS), False).otherwise(F.raise_error(F.concat(F.lit("not a truth value: "), text)).cast("boolean"))


def to_hex(number: Column | str) -> Column:
    return F.lower(F.hex(number))


def names_digest(names: Column | str) -> Column:
    """A name for a set of names, in 16 hexadecimal digits: it does not depend on their order."""
    names = F.col(names) if isinstance(names, str) else names
    return F.substring(F.sha2(F.array_join(F.array_sort(names), "\u0000"), 256), 1, 16)


# --- arrays ----------------------------------------------------------------------------------------


def number_range(n: Column) -> Column:
    """0 to n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).otherwise(F.array().cast("array<long>"))


def inverted(permutation: Column) -> Column:
    """Where each of 0 to n - 1 stands."""
    return F.transform(number_range(F.size(permutation)), lambda i: (F.array_position(permutation, i) - 1).cast("long"))


def reordered(items: Column, order: Column) -> Column:
    """Items moved to the places that ``order`` gives them."""
    return F.transform(inverted(order), lambda i: F.get(items, i.cast("int")))


def without_indices(items: Column, gone: Column) -> Column:
    """Items whose places are not in ``gone``."""
    return F.filter(items, lambda x, i: ~F.array_contains(gone, i.cast("long")))


def high_bit(number: Column) -> Column:
    """The place of the highest bit that is set, from 0; null for zero."""
    return F.when(number > 0, F.length(F.bin(number)) - 1)


def range_minimum(items: Column, begin: Column, end: Column) -> Column:
    """The place of the least of items[begin:end], the first of equal ones."""
    part = F.slice(items, begin + 1, end - begin)
    return begin + F.array_position(part, F.array_min(part)) - 1


def range_distinct(items: Column, begin: Column, end: Column) -> Column:
    """How many different items stand in items[begin:end]."""
    return F.size(F.array_distinct(F.slice(items, begin + 1, end - begin)))
