"""Column functions: binning, casting, parsing and token lists.  All are built-in expressions; none is a UDF."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bands ------------------------------------------------------------------------------------------------------------


def band(col: Column | str, breaks: Sequence[float], labels: Sequence[str], right_closed: bool = True) -> Column:
    """The label of the interval that holds a value; the first and last interval are open-ended, null stays null."""
    if len(labels) != len(breaks) + 1:
        raise ValueError("one label more than breaks is needed")
    value = F.col(col) if isinstance(col, str) else col
    out = None
    for limit, label in zip(breaks, labels):
        below = value <= limit if right_closed else value < limit
        out = F.when(below, label) if out is None else out.when(below, label)
    last = F.lit(labels[-1])
    return F.when(value.isNotNull(), out.otherwise(last) if out is not None else last)


def band_rank(col: Column | str, labels: Sequence[str]) -> Column:
    """Place of a label in its order, from 0; null for anything else."""
    value = F.col(col) if isinstance(col, str) else col
    out = F.lit(None).cast("int")
    for k, label in reversed(list(enumerate(labels))):
        out = F.when(value == label, F.lit(k)).otherwise(out)
    return out


def numeric_bins(col: Column | str, width: float, low: float, high: float) -> Column:
    """Upper edge of the right-closed bin of the given width; values beyond the ends fall in the end bins."""
    value = F.col(col) if isinstance(col, str) else col
    inner = F.least(F.greatest(value.cast("double"), F.lit(float(low + width))), F.lit(float(high)))
    return F.when(value.isNotNull(), F.ceil((inner - low) / width) * float(width) + float(low))


def threshold_group(col: Column | str, limits: Sequence[float], names: Sequence[str]) -> Column:
    """Named groups that are closed on the left."""
    return band(col, limits, names, right_closed=False)


# Numbers ----------------------------------------------------------------------------------------------------------


def lenient(col: Column, kind: str) -> Column:
    """A cast that gives null for what does not fit; signs are accepted."""
    return F.trim(col.cast("string")).try_cast(kind)


def safe_positive_int(col: Column) -> Column:
    number = lenient(col, "int")
    return F.when(number > 0, number)


def floor_mean(a: Column, b: Column) -> Column:
    """Mean rounded down, where both are set and not zero."""
    return F.when((a != 0) & (b != 0), F.floor((a + b) / 2).cast("int"))


def diff(a: Column, b: Column, kind: str = "double") -> Column:
    return (a.cast("double") - b.cast("double")).try_cast(kind)


def clip(col: Column, low: float, high: float) -> Column:
    return F.when(col.isNotNull(), F.least(F.greatest(col, F.lit(low)), F.lit(high)))


def clip_scale(col: Column, cap: float) -> Column:
    return clip(col, 0, cap) / cap


def map_values(col: Column, mapping: Mapping[object, object], default: object = None) -> Column:
    out = None
    for key, value in mapping.items():
        out = F.when(col == F.lit(key), F.lit(value)) if out is None else out.when(col == F.lit(key), F.lit(value))
    return out.otherwise(F.lit(default)) if out is not None else F.lit(default)


# Text -------------------------------------------------------------------------------------------------------------


def code_prefix(col: Column, n: int) -> Column:
    return F.substring(col, 1, n)


def is_blank(col: Column) -> Column:
    return col.isNull() | (F.length(col) == 0)


#: A ``[Key "Value"]`` line.
HEADER_LINE = r'(?m)^\[(\w+) "([^"\n]*)"\]'


def header_lists(text: Column) -> tuple[Column, Column]:
    """Keys and values of the header lines, which end at the first blank line, in two matches of the header block."""
    block = F.substring_index(text, "\n\n", 1)
    return tuple(F.regexp_extract_all(block, F.lit(HEADER_LINE), F.lit(group)) for group in (1, 2))


def header_value(keys: Column, values: Column, key: str) -> Column:
    """The value of the first line of a key; null if there is none."""
    return F.get(values, F.array_position(keys, key).cast("int") - 1)


def header(text: Column, key: str) -> Column:
    """Value of a ``[Key "Value"]`` line; null if the line is absent."""
    return header_value(*header_lists(text), key)


def movetext(text: Column) -> Column:
    """What follows the first blank line; null if there is none."""
    return F.try_element_at(F.split(text, "\n\n", 2), F.lit(2))


def entity_id_from_url(url: Column) -> Column:
    return F.coalesce(F.substring_index(url, "/", -1), F.lit(""))


def coalesce_headers(*cols: Column) -> Column:
    return F.coalesce(*cols, F.lit(""))


def time_control(col: Column) -> tuple[Column, Column]:
    """Base and increment of ``b``, ``b+i``: both null unless both parts are whole numbers; further parts are ignored."""
    parts = F.split(F.trim(col), r"\+")
    base = parts[0].try_cast("int")
    step = F.when(F.size(parts) > 1, F.try_element_at(parts, F.lit(2)).try_cast("int")).otherwise(F.lit(0))
    good = base.isNotNull() & step.isNotNull() & ~F.coalesce(col, F.lit("-")).isin("", "-")
    return F.when(good, base), F.when(good, step)


#: Seconds (base + 40 increments) below which a class applies, and the classes.
DURATION_LIMITS = (30, 180, 480, 1500)
DURATION_CLASSES = ("UltraBullet", "Bullet", "Blitz", "Rapid", "Classical")


def classify_duration(base: Column, increment: Column, limits=DURATION_LIMITS, labels=DURATION_CLASSES, unknown: str = "Unknown") -> Column:
    estimate = base + 40 * F.coalesce(increment, F.lit(0))
    return F.coalesce(threshold_group(estimate, limits, labels), F.lit(unknown))


# Token lists ------------------------------------------------------------------------------------------------------


#: How a game may end, as the last token of move text.
RESULTS = ("1-0", "0-1", "1/2-1/2", "*")


def tokenize_moves(col: Column) -> Column:
    """Tokens of numbered move text: words, less a move number in front, that are neither empty nor a result; null for null."""
    words = F.split(F.regexp_replace(col, r"(?<!\S)\d+\.+", ""), r"\s+")
    return F.filter(words, lambda w: (w != "") & ~w.isin(*RESULTS))


def first_token(tokens: Column) -> Column:
    return F.when(tokens.isNotNull(), F.coalesce(F.try_element_at(tokens, F.lit(1)), F.lit("")))


def prefix(tokens: Column, n: int) -> Column:
    return F.array_join(F.slice(tokens, 1, n), " ")


def ngrams_of(tokens: Column, n: int) -> Column:
    """Sliding n-grams, joined by blanks; none for shorter lists."""
    grams = F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)), lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.when(F.size(tokens) >= n, grams).otherwise(F.array().cast("array<string>"))


def token_flag(tokens: Column, pattern: str, n: int) -> Column:
    """Whether one of the first n tokens matches the whole pattern."""
    return F.exists(F.slice(tokens, 1, n), lambda t: t.rlike(f"^(?:{pattern})$"))


def token_count_matching(tokens: Column, pattern: str, n: int) -> Column:
    return F.size(F.filter(F.slice(tokens, 1, n), lambda t: t.rlike(pattern)))


def token_ratio_matching(tokens: Column, pattern: str, n: int) -> Column:
    whole = F.size(F.slice(tokens, 1, n))
    return F.when(whole > 0, token_count_matching(tokens, pattern, n) / whole).otherwise(F.lit(0.0))


def token_lengths(tokens: Column, n: int) -> Column:
    """Lengths of the first n tokens, filled up with zeros."""
    lengths = F.transform(F.slice(tokens, 1, n), lambda t: F.length(t))
    return F.slice(F.concat(lengths, F.array_repeat(F.lit(0), n)), 1, n)


def seq_entropy(tokens: Column, n: int) -> Column:
    """Entropy in bits of the tokens among the first n of a list; 0 for none."""
    own = F.slice(tokens, 1, n)
    size = F.size(own).cast("double")
    share = lambda t: F.size(F.filter(own, lambda u: u == t)) / size
    parts = F.transform(F.array_distinct(own), lambda t: -share(t) * F.log2(share(t)))
    return F.when(F.size(own) > 0, F.aggregate(parts, F.lit(0.0), lambda a, b: a + b)).otherwise(F.lit(0.0))
