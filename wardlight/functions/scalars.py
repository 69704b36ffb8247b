"""Column expressions shared by every operator. All of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardlight.functions import fixed

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
# A date, or a date with a time behind it; nothing else may follow.
ISO_DATE = r"^\s*\d{4}-\d{1,2}-\d{1,2}([T ]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?\s*$"


def nz(condition: Column) -> Column:
    """0/1 flag; an unknown condition counts as false, never as null."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def number(value: Column) -> Column:
    """NaN as null: a score that is not a number compares with nothing."""
    return F.when(~F.isnan(value.cast("double")), value)


def lookup(key: Column, mapping: Mapping[str, object]) -> Column:
    """Value of a small literal map, null for a key it does not hold."""
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def lenient_double(text: Column) -> Column:
    """Number in a text, null if it is not one.

    The guard keeps out what a bare cast would let through (``428d``, ``nan``).
    """
    return F.when(text.rlike(NUMBER), text).try_cast("double")


def lenient_date(text: Column, fmt: str | None = None) -> Column:
    """Date in a text, null if it cannot be read. ISO dates unless ``fmt`` is given."""
    if fmt:
        return F.to_date(F.try_to_timestamp(text, F.lit(fmt)))
    return F.when(text.rlike(ISO_DATE), F.trim(text)).try_cast("date")


def round_half_even(value: Column, places: int) -> Column:
    """Half-even rounding the way array libraries do it: scale, round, scale back."""
    factor = F.lit(10.0**places)
    return F.rint(value * factor) / factor


def percent_text(p: Column) -> Column:
    """``0.1234`` -> ``12.3%``, null without a number. Rounded half-even first: the formatter rounds ties up."""
    known = number(p)
    return F.when(known.isNotNull(), F.format_string("%.1f%%", F.bround(known * 100, 1)))


# -- encounters ---------------------------------------------------------------

def readmission_label(readmitted: Column, mode: str = "any") -> Column:
    """1 unless the value is ``NO`` (``any``), or only for ``<30`` (``lt30``)."""
    if mode == "any":
        return (~readmitted.eqNullSafe(F.lit("NO"))).cast("int")
    if mode == "lt30":
        return nz(readmitted == "<30")
    raise ValueError(f"unknown label mode {mode!r}")


def age_midpoint(bracket: Column) -> Column:
    return lookup(bracket, fixed.AGE_MIDPOINTS)


def elderly_flag(age: Column) -> Column:
    return nz(age >= fixed.ELDERLY_AGE)


def age_band(age: Column) -> Column:
    """Right-closed bands: 65 belongs to ``50-65`` although it is elderly."""
    band = F.when(age <= 0, None)
    for name, top in fixed.AGE_BANDS:
        band = band.when(age <= top, name)
    return band


def ordinal(value: Column, levels: Mapping[str, int]) -> Column:
    return F.coalesce(lookup(value, levels), F.lit(0))


def diagnosis_category(code: Column) -> Column:
    number = lenient_double(code)
    category = F.when(code.isNull(), "Unknown").when(
        code.startswith("V") | code.startswith("E"), "External"
    ).when(number.isNull(), "Unknown")
    for name, low, high, extra in fixed.DIAGNOSIS_RANGES:
        inside = number.between(low, high)
        category = category.when(inside if extra is None else inside | (number == extra), name)
    return category.otherwise("Other")


# -- dates --------------------------------------------------------------------

def weekend_flag(date: Column) -> Column:
    return nz(F.weekday(date).isin(5, 6))


def age_in_years(birth: Column, on: Column) -> Column:
    """Years at one decimal, over the mean length of a year."""
    return round_half_even(F.datediff(on, birth) / F.lit(365.25), 1)


def whole_age(birth: Column, on: Column) -> Column:
    """Whole years of 365 days; 0 without a birth date."""
    return F.coalesce(F.floor(F.datediff(on, birth) / F.lit(365.0)), F.lit(0)).cast("int")


# -- scores -------------------------------------------------------------------

def risk_band(p: Column) -> Column:
    """Left-closed bands: 0.6 is High, 0.3 is Medium; what is no number is Low."""
    p = number(p)
    return F.when(p >= fixed.HIGH_CUT, "High").when(p >= fixed.MEDIUM_CUT, "Medium").otherwise("Low")


def risk_band_cut(p: Column) -> Column:
    """Right-closed bands over (0, 1]: 0.6 is Medium, 0.3 is Low, 0 has no band."""
    p = number(p)
    return (
        F.when((p <= 0) | (p > 1), None)
        .when(p <= fixed.MEDIUM_CUT, "Low")
        .when(p <= fixed.HIGH_CUT, "Medium")
        .when(p <= 1, "High")
    )


def decision(p: Column, threshold: float = fixed.DECISION_THRESHOLD) -> Column:
    return nz(number(p) >= threshold)


def recommendations(band: Column) -> Column:
    """Advice of a band; an unknown band gets an empty list."""
    advice = None
    for name, texts in fixed.RECOMMENDATIONS.items():
        items = F.array(*[F.lit(t) for t in texts])
        advice = F.when(band == name, items) if advice is None else advice.when(band == name, items)
    return advice.otherwise(F.array().cast("array<string>"))


# -- FHIR ---------------------------------------------------------------------

def full_name(name: Column) -> Column:
    """Given names and family name of the first entry of a FHIR name list."""
    first = F.get(name, 0)
    return F.trim(F.concat_ws(" ", first["given"], F.coalesce(first["family"], F.lit(""))))


def contains_any(text: Column, fragments: Sequence[str]) -> Column:
    found = F.lit(False)
    for fragment in fragments:
        found = found | text.contains(fragment)
    return found


def encounter_class(code: Column, fragments=fixed.CLASS_FRAGMENTS) -> Column:
    """Class of an encounter by fragments of its code, first match wins."""
    lowered = F.lower(code)
    matched = None
    for name, parts in fragments:
        hit = contains_any(lowered, parts)
        matched = F.when(hit, name) if matched is None else matched.when(hit, name)
    return matched


# -- one-hot ------------------------------------------------------------------

def one_hot(column: str, levels: Sequence[str]) -> list[Column]:
    """Flags for all levels but the first; null and unseen values give zeros."""
    return [nz(F.col(column) == level).alias(f"{column}_{level}") for level in levels[1:]]
