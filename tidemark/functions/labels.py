"""Labels, risk, identifiers, dates in names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The weights, the thresholds and the patterns of names below are those that labels and files have.
RISK_WEIGHTS = (0.0, 0.1, 0.4, 0.6, 1.0)


def volume_class(v: Column) -> Column:
    return F.when(v < 10, 0).when(v < 50, 1).when(v < 200, 2).otherwise(3)


def risk_index(volume: Column, height: Column) -> Column:
    factor = F.least(F.greatest(1 + 0.05 * (height - 15), F.lit(0.5)), F.lit(2.0))
    return 1 / (1 + F.exp(-0.5 * (F.log1p(volume) * factor - 4)))


def collapse_labels(volume: Column, horizons: int = 4) -> Column:
    return F.array_repeat(F.when(volume >= 10, 1).otherwise(0), horizons)


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    raised = F.transform(logits, lambda x: F.exp(x - top))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return F.transform(raised, lambda x: x / total(raised))


def risk_score(logits: Column, weights=RISK_WEIGHTS) -> Column:
    weighted = F.zip_with(softmax(logits), F.array(*map(F.lit, weights)), lambda p, w: p * w)
    return F.aggregate(weighted, F.lit(0.0), lambda s, x: s + x)


def mop_number(name: Column) -> Column:
    """The first run of digits anywhere; null without one."""
    return F.nullif(F.regexp_extract(name, "([0-9]+)", 1), F.lit("")).try_cast("int")


def mop_after_prefix(name: Column) -> Column:
    """Digits after ``MOP``, or leading digits."""
    after = F.regexp_extract(name, r"(?i)MOP\s*([0-9]+)", 1)
    lead = F.regexp_extract(name, r"^([0-9]+)", 1)
    return F.coalesce(F.nullif(after, F.lit("")), F.nullif(lead, F.lit(""))).try_cast("int")


def mop_with_tenth(name: Column) -> Column:
    """``MOP 600_03`` is 600.3."""
    base = mop_after_prefix(name).cast("double")
    sub = F.nullif(F.regexp_extract(name, r"_([0-9]+)", 1), F.lit("")).try_cast("double")
    return base + F.coalesce(sub, F.lit(0.0)) / 10.0


def transect_name(mop: Column) -> Column:
    """The inverse, with a three-digit tenth; a tenth that rounds up moves to the next number."""
    base = F.floor(mop).cast("int")
    tenth = F.bround((mop - base) * 10, 0).cast("int")
    whole = F.when(tenth >= 10, base + 1).otherwise(base)
    return F.when(tenth % 10 == 0, F.format_string("MOP %d", whole)).otherwise(F.format_string("MOP %d_%03d", whole, tenth))


def transect_index(alongshore_m: Column, first: Column, n: Column) -> Column:
    """Index of the transect at a distance along the shore, ten metres apart, kept within the beach."""
    return (first + F.least(F.greatest(F.bround(alongshore_m / 10, 0).cast("int"), F.lit(0)), n - 1)).cast("int")


def name_date(name: Column) -> Column:
    """A date in a file name: eight leading digits, else ISO, else any eight digits; one that doesn't exist falls through."""
    day = lambda pattern, form: F.try_to_timestamp(F.nullif(F.regexp_extract(name, pattern, 1), F.lit("")), F.lit(form)).cast("date")
    return F.coalesce(day(r"^([0-9]{8})", "yyyyMMdd"), day(r"([0-9]{4}-[0-9]{2}-[0-9]{2})", "yyyy-MM-dd"), day(r"([0-9]{8})", "yyyyMMdd"))


def mapped_path(path: Column, prefixes: dict[str, str]) -> Column:
    """A path with its longest known prefix replaced."""
    chain = None
    for old in sorted(prefixes, key=len, reverse=True):
        new = F.concat(F.lit(prefixes[old]), F.substr(path, F.lit(len(old) + 1)))
        chain = F.when(path.startswith(old), new) if chain is None else chain.when(path.startswith(old), new)
    return path if chain is None else chain.otherwise(path)


def ordinal(date: Column) -> Column:
    """Days since 0001-01-01, which is day 1."""
    return F.datediff(date, F.lit("0001-01-01").cast("date")) + 1


def colour(r: Column, g: Column, b: Column) -> Column:
    """``rgb(r,g,b)`` from channels in 0..1; a missing channel is 128."""
    byte = lambda c: F.least(F.greatest(F.coalesce((c * 255).cast("int"), F.lit(128)), F.lit(0)), F.lit(255))
    return F.format_string("rgb(%d,%d,%d)", byte(r), byte(g), byte(b))


def mop_base(name: Column) -> Column:
    """Digits of the part before ``_``, without the prefix: ``MOP 520_001`` is 520."""
    base = F.split_part(F.regexp_replace(name, "MOP |mop ", ""), F.lit("_"), F.lit(1))
    return F.nullif(F.regexp_replace(base, "[^0-9]", ""), F.lit("")).try_cast("int")


def survey_date(name: Column) -> Column:
    """The date of a name that starts with eight digits and ``_``; else null."""
    return F.try_to_timestamp(F.nullif(F.regexp_extract(name, "^([0-9]{8})_", 1), F.lit("")), F.lit("yyyyMMdd")).cast("date")


def mop_alongshore(alongshore_m: Column, first_mop: Column) -> Column:
    """A hundred metres along the shore are one number."""
    return first_mop + alongshore_m / 100.0
