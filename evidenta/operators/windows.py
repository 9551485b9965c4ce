"""Choice of the current and the previous window of a table of periods."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class WindowPair:
    """Inclusive bounds of the two windows in period ordinals; None where there is no earlier period."""

    current: tuple[int, int]
    previous: tuple[int, int] | None

    def now(self, ordinal: Column) -> Column:
        return ordinal.between(*self.current)

    def before(self, ordinal: Column) -> Column:
        return F.lit(False) if self.previous is None else ordinal.between(*self.previous)


def window_pair(df: DataFrame, ordinal: str = "month_no", year: int = 12) -> WindowPair | None:
    """The last ``year`` periods against the ``year`` before if all are there, else the last two present periods.

    The ordinals of periods that are present are as many as the calendar has, so the driver reads them.
    """
    present = sorted(r[0] for r in df.select(ordinal).where(F.col(ordinal).isNotNull()).distinct().collect())
    if not present:
        return None
    last = present[-1]
    if len([p for p in present if p > last - 2 * year]) == 2 * year:
        return WindowPair((last - year + 1, last), (last - 2 * year + 1, last - year))
    return WindowPair((last, last), (present[-2], present[-2]) if len(present) > 1 else None)
