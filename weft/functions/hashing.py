"""Deterministic keys from SHA-256, the same in any engine that has the hash."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def prefix32(*parts: Column | str, sep: str = "|") -> Column:
    """The first 32 bits of the SHA-256 of the parts joined by `sep`, as a long."""
    return F.conv(F.substring(F.sha2(F.concat_ws(sep, *parts), 256), 1, 8), 16, 10).cast("long")


def bucket(n: int, *parts: Column | str) -> Column:
    """A bucket 0..n-1, for splits and draws."""
    return prefix32(*parts) % n


def safe_identifier(*parts: Column | str) -> Column:
    """Parts joined by '_', other than word characters replaced, with a hash suffix that keeps it unique."""
    whole = F.concat_ws("|", *parts)
    return F.concat(F.regexp_replace(F.concat_ws("_", *parts), "[^A-Za-z0-9_]+", "_"), F.lit("_"), F.substring(F.sha2(whole, 256), 1, 10))


def jitter(width: float, *parts: Column | str) -> Column:
    """A number in [-width, width] fixed by the parts."""
    return (prefix32(*parts) / F.lit(4294967295.0) * 2 - 1) * width
