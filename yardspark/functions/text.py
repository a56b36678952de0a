"""Text helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nz(x: Column | str) -> Column:
    """The text without white space at both ends, null where nothing is left: blank equals missing."""
    return F.nullif(F.regexp_replace(F.col(x) if isinstance(x, str) else x, r"^\s+|\s+$", ""), F.lit(""))


def parse_stamp(x: Column | str) -> Column:
    """An ISO time with or without Z or offset as UTC, null where it cannot be read."""
    return F.try_to_timestamp(F.col(x) if isinstance(x, str) else x)


def known_spot(name: str = "spot_name", comment: str | None = None) -> Column:
    """A spot's name (else the comment), null where blank or `unknown` in any case."""
    value = nz(name) if comment is None else F.coalesce(nz(name), nz(comment))
    return F.when(F.lower(value) != "unknown", value)
