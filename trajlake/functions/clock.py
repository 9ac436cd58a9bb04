"""Timestamps, chunk numbers, progress and playback arithmetic as column expressions.

Timestamps are TIMESTAMP_NTZ. Arithmetic runs on whole microseconds since 1970, taken from the
timestamp's own fields, so the session's zone and its summer time do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000

# Playback speed limits and the smallest step worth showing, in seconds.
SPEED_DEAD_ZONE = 0.001
SPEED_LIMIT = 10.0
MIN_TICK_SECONDS = 0.1


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def parse_ts(col) -> Column:
    """Text to timestamp: ISO with blank or ``T``, optional fraction and zone mark; else null."""
    text = F.trim(_c(col))
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text.try_cast("timestamp_ntz"))


def format_ts(col) -> Column:
    """``yyyy-MM-dd HH:mm:ss.SSS``, cutting anything below the millisecond."""
    text = _c(col).cast("timestamp_ntz").cast("string")
    return F.concat(F.substring(text, 1, 19), F.lit("."), F.rpad(F.substring(text, 21, 3), 3, "0"))


def instant(t) -> Column:
    """A date and time without zone as a literal; a datetime literal would mean an instant of the session's zone."""
    return F.lit(str(t)).cast("timestamp_ntz")


def _origin() -> Column:
    return instant("1970-01-01 00:00:00")


def micros(col) -> Column:
    """Microseconds since 1970, exact from 1700 to 2250. The difference of zone-free timestamps knows no zone.

    Every form here names its argument once, since expressions nest.
    """
    since = (_c(col).cast("timestamp_ntz") - _origin()).cast("interval second")
    return F.rint(since.cast("decimal(18,6)").cast("double") * F.lit(float(MICROS))).cast("bigint")


def from_micros(col) -> Column:
    """The zone-free timestamp that many microseconds after 1970."""
    return _origin() + F.expr("INTERVAL '0.000001' SECOND") * _c(col).cast("bigint")


def cut_ms(m: Column) -> Column:
    """The timestamp at ``m`` microseconds, without what is below the millisecond."""
    return _origin() + F.expr("INTERVAL '0.001' SECOND") * F.floor(m / F.lit(1000.0))


def trunc_ms(col) -> Column:
    return cut_ms(micros(col))


def floor_div(num, den: int) -> Column:
    """Floor of an integer division, exact for 64-bit values of either sign."""
    num, den = _c(num), F.lit(den).cast("bigint")
    return F.call_function("div", num - F.pmod(num, den), den)


def epoch_ms(col) -> Column:
    """Milliseconds since 1970, rounded half to even."""
    m = micros(col)
    whole, rest = floor_div(m, 1000), F.pmod(m, F.lit(1000))
    up = (rest > 500) | ((rest == 500) & (F.pmod(whole, F.lit(2)) == 1))
    return whole + up.cast("bigint")


def chunk_index(col, base, chunk_seconds: int) -> Column:
    """Chunk number counted from ``base``, the first instant of the data."""
    return floor_div(micros(col) - micros(base), chunk_seconds * MICROS)


def chunk_key(start, fmt: str) -> Column:
    return F.format_string(f"chunk_%013d.{fmt}", epoch_ms(start))


def progress(t, start, end) -> Column:
    """Share of the range that lies before ``t``, within 0 to 1; 0 for an empty range."""
    span = micros(end) - micros(start)
    share = (micros(t) - micros(start)) / span
    return F.when(span > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), share))).otherwise(F.lit(0.0))


def seek_progress(p, start, end) -> Column:
    """Instant at progress ``p``, to the microsecond."""
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), _c(p)))
    span = micros(end) - micros(start)
    return from_micros(micros(start) + F.rint(span * share).cast("bigint"))


def seek_clamp(t, start, end) -> Column:
    return F.greatest(_c(start), F.least(_c(t), _c(end)))


def playback_speed(col) -> Column:
    """Near-zero speeds count as 1; negative speeds play backward; limited to ten-fold."""
    s = _c(col).cast("double")
    s = F.when(F.abs(s) < SPEED_DEAD_ZONE, F.lit(1.0)).otherwise(s)
    return F.greatest(F.lit(-SPEED_LIMIT), F.least(F.lit(SPEED_LIMIT), s))


def duration_seconds(col) -> Column:
    """``60``, ``30s``, ``1min`` or ``2h`` in seconds; null where the text is none of these."""
    text = F.lower(F.trim(_c(col)))
    number = F.regexp_extract(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?)\s*(min|h|s|)$", 1)
    unit = F.regexp_extract(text, r"(min|h|s)$", 1)
    factor = F.when(unit == "min", 60.0).when(unit == "h", 3600.0).otherwise(1.0)
    return F.nullif(number, F.lit("")).try_cast("double") * factor


def video_time(t, start, factor: float) -> Column:
    """Seconds into a video that shows the data ``factor`` times as fast."""
    return (micros(t) - micros(start)) / F.lit(MICROS * 1.0) / F.lit(float(factor))


def data_time(video_seconds, start, factor: float) -> Column:
    """Data instant shown at a second of such a video."""
    return from_micros(micros(start) + F.rint(_c(video_seconds) * F.lit(float(factor) * MICROS)).cast("bigint"))


def clock_text(col) -> Column:
    return F.substring(_c(col).cast("timestamp_ntz").cast("string"), 12, 8)


def clock_to_timestamp_text(clock, base_date) -> Column:
    """Video clock ``HH:MM:SS`` on a base date as timestamp text."""
    return F.concat(_c(base_date), F.lit(" "), _c(clock), F.lit(".000"))
