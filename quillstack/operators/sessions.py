"""Sessions of users: expiry, inactivity, debounce and bands. Times are in milliseconds unless a column is a timestamp."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import unused

#: Inactivity after which a session ends, lead of a refresh and least wait for it, in milliseconds.
TIMEOUT, REFRESH, LEAST = 8 * 3600 * 1000, 3600 * 1000, 60 * 1000


def token_expired(exp_s: Column, now_s: Column, buffer_s: int = 0) -> Column:
    return exp_s <= now_s + buffer_s


def token_left(exp_s: Column, now_s: Column) -> Column:
    return (exp_s - now_s) * 1000


def refresh_in(left_ms: Column) -> Column:
    return F.greatest(left_ms - REFRESH, F.lit(LEAST))


def until_expiry(idle_ms: Column, timeout: int = TIMEOUT) -> Column:
    return F.greatest(F.lit(0), timeout - idle_ms)


def about_to_expire(idle_ms: Column) -> Column:
    return until_expiry(idle_ms) <= 5 * 60 * 1000


def warning(left_ms: Column) -> Column:
    """final up to a minute, warning up to five, else null."""
    return F.when(left_ms <= 60_000, "final").when(left_ms <= 300_000, "warning")


def status(left_ms: Column) -> Column:
    """Shown text in the last ten minutes; hidden before and once expired."""
    minutes = F.ceil(left_ms / 60_000).cast("string")
    return F.when(left_ms <= 0, "hidden").when(left_ms <= 300_000, F.concat(F.lit("Expiring Soon "), minutes)).when(left_ms <= 600_000, F.concat(F.lit("Active "), minutes)).otherwise("hidden")


def sessions(events: DataFrame, user: str = "user_id", ts: str = "ts", gap_hours: int = 8) -> DataFrame:
    """One row per session of a user; a gap of ``gap_hours`` or more ends it. Uses session windows: partial sessions merge before the shuffle."""
    # Session windows that touch are merged, so the window is a microsecond shorter than the gap.
    window = F.session_window(F.col(ts), f"{gap_hours * 3600 - 1} seconds 999999 microseconds")
    found = events.groupBy(user, window.alias("w")).agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("n_events"))
    return found.select(user, "started", "ended", "n_events")


def debounce(events: DataFrame, *keep: str, user: str = "user_id", ts: str = "ts", wait_ms: int = 1000, tie: str = "event_id", bypass: Column | None = None) -> DataFrame:
    """Events after which the user is quiet for ``wait_ms``, and the last.

    Events where ``bypass`` holds (a page shown again) count at once and neither end nor prolong the wait of the others.
    """
    at_once = F.lit(False) if bypass is None else F.coalesce(bypass, F.lit(False))
    w = Window.partitionBy(user, at_once).orderBy(ts, tie)
    millis = lambda c: F.unix_millis(c.cast("timestamp"))
    nxt = F.lead(millis(F.col(ts))).over(w)
    n = unused(events, "next")
    return events.withColumn(n, nxt).filter(at_once | F.col(n).isNull() | (F.col(n) - millis(F.col(ts)) >= wait_ms)).select(*keep)
