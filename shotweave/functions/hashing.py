"""Repeatable randomness: a hash every SQL engine with MD5 can reproduce."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Number of distinct hash values (eight hex digits).
HASH_RANGE = 2**32


def as_column(part) -> Column:
    """A Column stays itself, any other value becomes a literal."""
    return part if isinstance(part, Column) else F.lit(part)


def portable_hash(*parts) -> Column:
    """First 32 bits of the MD5 of the parts joined by ``:``, as BIGINT."""
    text = F.concat_ws(":", *[as_column(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def uniform(*parts) -> Column:
    """A DOUBLE in [0, 1) made from :func:`portable_hash`."""
    return portable_hash(*parts) / F.lit(float(HASH_RANGE))


def draw(n, *parts) -> Column:
    """An integer in ``[0, n)``; NULL when ``n`` is not positive."""
    n = as_column(n)
    return F.when(n > 0, F.pmod(portable_hash(*parts), n))
