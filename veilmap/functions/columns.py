"""Scalar building blocks. Everything here is a Column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed_values import EARTH_RADIUS_KM


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rounded(c: str | Column, digits: int = 6) -> Column:
    """Rounded double without negative zero, for stable result tables."""
    return F.round(col(c).cast("double"), digits) + F.lit(0.0)


def clamp01(c: str | Column) -> Column:
    """Null stays null, NaN counts as 0."""
    x = col(c).cast("double")
    # least() and greatest() skip nulls, so null is kept apart.
    return F.when(x.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.nanvl(x, F.lit(0.0)))))


def rating(c: str | Column) -> Column:
    """Half-even rounding to 1..5; text is accepted, unreadable text is null."""
    number = col(c).try_cast("double")
    return F.when(number.isNotNull(), F.least(F.lit(5.0), F.greatest(F.lit(1.0), F.bround(number)))).cast("int")


def readable_rating(c: str | Column, alpha: str | Column) -> Column:
    """Whether both parts of a rating can be read; never null."""
    return rating(c).isNotNull() & col(alpha).try_cast("double").isNotNull()


def weight_bits(c: str | Column, alpha: str | Column) -> Column:
    """Weight of evidence log2 W = alpha * (c - 3)."""
    return clamp01(col(alpha).try_cast("double")) * (rating(c) - F.lit(3))


def support_weight(c: str | Column, alpha: str | Column) -> Column:
    """W = 2 ^ (alpha * (c - 3))."""
    return F.exp(weight_bits(c, alpha) * F.log(F.lit(2.0)))


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = (col(c).cast("double") for c in (lat1, lon1, lat2, lon2))
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    # least() skips nulls, so a missing coordinate is kept apart: its distance is null.
    return F.when(a.isNotNull(), F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), a))))


def country_of_label(label: str | Column) -> Column:
    return F.trim(F.element_at(F.split(col(label), ","), -1))


def place_of_label(label: str | Column) -> Column:
    return F.split(col(label), ",").getItem(0)


def slug(text: str | Column) -> Column:
    return F.regexp_replace(F.lower(col(text)), "[^a-z0-9]+", "")


def coordinate_key(degrees: str | Column) -> Column:
    """Integer key at five decimals; never join on formatted floats."""
    return F.round(col(degrees).cast("double") * 100000).cast("bigint")


def tidy_name(name: str | Column) -> Column:
    return F.trim(F.regexp_replace(col(name), r"\s+", " "))


def mask_of(indices: str | Column) -> Column:
    """Array of cue indices -> bit mask (bit k = cue k is in the set)."""
    return F.aggregate(
        col(indices),
        F.lit(0).cast("bigint"),
        lambda acc, k: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), k.cast("int"))),
    )


def has_bit(mask: str | Column, k: str | Column) -> Column:
    return F.call_function("getbit", col(mask).cast("bigint"), col(k).cast("int")) == 1


def full_mask(m: str | Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), col(m).cast("int")) - 1


def mask_indices(mask: str | Column, m: str | Column) -> Column:
    """Sorted cue indices of a mask, for ordering subsets of one size."""
    positions = F.sequence(F.lit(0), col(m).cast("int") - 1)
    return F.filter(positions, lambda k: F.call_function("getbit", col(mask), k) == 1)


def p_yes(logprob_yes: str | Column, logprob_no: str | Column) -> Column:
    """Two-way normalised yes probability, with one-sided and empty cases."""
    yes, no = col(logprob_yes), col(logprob_no)
    e_yes, e_no = F.exp(F.least(F.lit(0.0), yes)), F.exp(F.least(F.lit(0.0), no))
    return (
        F.when(yes.isNull() & no.isNull(), F.lit(0.5))
        .when(yes.isNull(), F.lit(1.0) - e_no)
        .when(no.isNull(), e_yes)
        .otherwise(F.exp(yes) / (F.exp(yes) + F.exp(no)))
    )
