"""Object names and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trajlake.functions.clock import _c


def objid_from_number(col) -> Column:
    """1 to ``obj001``; longer numbers keep all their digits."""
    return F.format_string("obj%03d", _c(col))


def objid_number(col) -> Column:
    """Trailing digits without leading zeros, as text; the name itself where there are none."""
    digits = F.regexp_extract(_c(col), r"(\d+)$", 1)
    plain = F.regexp_replace(digits, r"^0+(?=\d)", "")
    return F.when(digits == "", _c(col)).otherwise(plain)


def label_id(col) -> Column:
    """The last three characters as a number, or null unless all three are digits."""
    return F.regexp_extract(_c(col), r"(\d{3})$", 1).try_cast("int")
