"""Scalar functions of the audit as column expressions."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Frequency bins as (name, above, up to); the counts between them belong to no bin.
STRATA = (("very_cold", -1, 19), ("cold", 20, 99), ("warm", 100, 499), ("hot", 500, 10_000_000))
#: The same bins without gaps.
CLOSED_STRATA = (("very_cold", -1, 19), ("cold", 19, 99), ("warm", 99, 499), ("hot", 499, 10_000_000))


def filled(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def first_filled(names: list[str]) -> Column:
    """The first column that is neither null nor blank; the last one as it is."""
    *most, last = (F.col(n).cast("string") for n in names)
    return F.coalesce(*map(filled, most), last)


def stable_id_md5(c: Column) -> Column:
    """60 bits of an MD5: the id that SQL engines share."""
    return F.conv(F.substring(F.md5(c), 1, 15), 16, 10).cast("long")


@F.pandas_udf(LongType())  # a type object needs no session when a worker imports this
def _blake2b_63(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    mask = (1 << 63) - 1
    for s in parts:
        codes, distinct = pd.factorize(s)  # a batch hashes each text once
        ids = pd.array([int.from_bytes(blake2b(x.encode(), digest_size=8).digest(), "big") & mask for x in distinct] + [None], "Int64")
        yield pd.Series(ids.take(codes))


def stable_id(c: Column) -> Column:
    """63 bits of a BLAKE2b digest of the text; null stays null."""
    return _blake2b_63(c)


def needed_id(c: Column) -> Column:
    """The trimmed text of an id; null or blank fails the query."""
    return F.when(F.trim(c) != "", F.trim(c)).otherwise(F.raise_error(F.lit("an id is missing")).cast("string"))


def parse_timestamp(c: Column) -> Column:
    """Numbers are truncated, their unit kept; dates are read as UTC and give epoch seconds; anything else fails."""
    number = c.try_cast("double")
    when = F.unix_timestamp(F.try_to_timestamp(F.trim(c)))
    return F.when(number.isNotNull(), number.cast("long")).otherwise(F.coalesce(when, F.raise_error(F.concat(F.lit("not a timestamp: "), F.coalesce(c, F.lit("null")))).cast("long")))


def millis_to_seconds(c: Column) -> Column:
    return F.floor(c.try_cast("double") / 1000)


def try_correct(c: Column) -> Column:
    """true/false in any case or a number that is 0 or 1, else null."""
    low, number = F.lower(F.trim(c)), F.trim(c).try_cast("double")
    return F.when(low == "true", F.lit(1)).when(low == "false", F.lit(0)).when(number == 1, F.lit(1)).when(number == 0, F.lit(0)).cast("long")


def parse_correct(c: Column) -> Column:
    return F.coalesce(try_correct(c), F.raise_error(F.concat(F.lit("not a binary outcome: "), F.coalesce(c, F.lit("null")))).cast("long"))


def split_list(c: Column) -> Column:
    """Comma-separated parts, trimmed; null gives none."""
    return F.coalesce(F.transform(F.split(c, ","), lambda x: F.trim(x)), F.array().cast("array<string>"))


def clip(c: Column, low: float = 1e-4) -> Column:
    return F.greatest(F.least(c, F.lit(1 - low)), F.lit(low))


def sigmoid(z: Column) -> Column:
    return clip(1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(50.0)), F.lit(-50.0)))), 1e-9)


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is not positive."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def f1(p: Column, r: Column) -> Column:
    return ratio(2.0 * p * r, p + r)


def stratum(n: Column, bins=STRATA) -> Column:
    out = F.lit("out_of_range")
    for name, above, up_to in reversed(bins):
        out = F.when((n > above) & (n <= up_to), F.lit(name)).otherwise(out)
    return out


def hash_below(p: Column | float, *parts: Column) -> Column:
    """Whether the seeded draw of the parts is below p: 32 bits of an MD5 against p * 2 ** 32."""
    draw = F.conv(F.substring(F.md5(F.concat(*parts)), 1, 8), 16, 10).cast("long")
    return draw < F.floor((p if isinstance(p, Column) else F.lit(p)) * F.lit(4294967296.0))
