"""Civil time: calendar periods as half-open UTC intervals.

Boundaries are made on the driver from one source of zone data.  A boundary that
a clock change skips is the first valid instant after the gap; one that occurs
twice is the earlier instant.
"""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

from ..plans.errors import refuse
from ..plans.values import least_precision, print_instant

DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
GRAINS = ("day", "fiscalDay", "week", "month")
_OFFSET = re.compile(r"([+-])(\d{2}):(\d{2})")


@dataclass(frozen=True)
class Calendar:
    timezone: str = "UTC"
    week_start: str = "monday"
    fiscal_start: str = "00:00:00"
    database: str = "fixed-offset"

    def zone(self) -> dt.tzinfo:
        if self.timezone == "UTC":
            return dt.UTC
        if m := _OFFSET.fullmatch(self.timezone):
            span = dt.timedelta(hours=int(m[2]), minutes=int(m[3]))
            return dt.timezone(span if m[1] == "+" else -span)
        try:
            return ZoneInfo(self.timezone)
        except (ZoneInfoNotFoundError, ValueError):
            raise refuse("CALENDAR_UNAVAILABLE") from None

    @property
    def fiscal(self) -> dt.time:
        return dt.time.fromisoformat(self.fiscal_start)


def resolve(local: dt.datetime, zone: dt.tzinfo) -> dt.datetime:
    """The UTC instant of a local time, under the gap and repeat rules."""
    early, late = local.replace(tzinfo=zone, fold=0), local.replace(tzinfo=zone, fold=1)
    before, after = early.utcoffset(), late.utcoffset()
    if before == after or before > after:  # plain, or repeated: the earlier instant
        return early.astimezone(dt.UTC)
    # skipped: the instant of the change, which lies where the later offset begins
    low, high = (local - after).replace(tzinfo=dt.UTC), (local - before).replace(tzinfo=dt.UTC)
    while high - low > dt.timedelta(microseconds=1):
        middle = low + (high - low) / 2
        if middle.astimezone(zone).utcoffset() == before:
            low = middle
        else:
            high = middle
    return high


def _day_of(grain: str, calendar: Calendar) -> dt.time:
    return dt.time(0) if grain == "day" else calendar.fiscal


def key_date(local: dt.datetime, grain: str, calendar: Calendar) -> dt.date:
    """The first date of the period that holds a local time."""
    start = _day_of(grain, calendar)
    day = (local - dt.timedelta(hours=start.hour, minutes=start.minute, seconds=start.second)).date()
    if grain == "week":
        return day - dt.timedelta(days=(day.weekday() - DAYS.index(calendar.week_start)) % 7)
    return day.replace(day=1) if grain == "month" else day


def following(key: dt.date, grain: str, step: int = 1) -> dt.date:
    if grain == "month":
        month = key.year * 12 + key.month - 1 + step
        return dt.date(month // 12, month % 12 + 1, 1)
    return key + dt.timedelta(days=step * (7 if grain == "week" else 1))


def label(key: dt.date, grain: str) -> str:
    if grain == "month":
        return f"{key.year:04d}-{key.month:02d}"
    if grain != "week":
        return key.isoformat()
    # the week belongs to the year that holds at least four of its days
    year = (key + dt.timedelta(days=3)).year
    first = key
    while (first - dt.timedelta(days=7) + dt.timedelta(days=3)).year == year:
        first -= dt.timedelta(days=7)
    return f"{year:04d}-W{(key - first).days // 7 + 1:02d}"


def boundary(key: dt.date, grain: str, calendar: Calendar) -> dt.datetime:
    return resolve(dt.datetime.combine(key, _day_of(grain, calendar)), calendar.zone())


def period(at: dt.datetime, grain: str, calendar: Calendar) -> tuple[dt.date, dt.datetime, dt.datetime]:
    """(key, start, end) of the period that holds an instant."""
    key = key_date(at.astimezone(calendar.zone()).replace(tzinfo=None), grain, calendar)
    start, end = boundary(key, grain, calendar), boundary(following(key, grain), grain, calendar)
    while at < start:
        key = following(key, grain, -1)
        start, end = boundary(key, grain, calendar), start
    while at >= end:
        key = following(key, grain)
        start, end = end, boundary(following(key, grain), grain, calendar)
    return key, start, end


def table(low: dt.datetime, high: dt.datetime, grain: str, calendar: Calendar) -> list[tuple[dt.datetime, dt.datetime, str]]:
    """(start, end, label) of all periods that meet [low, high]."""
    key, start, end = period(low, grain, calendar)
    out = []
    while True:
        if start < end:
            out.append((start, end, label(key, grain)))
        if end > high:
            return out
        key = following(key, grain)
        start, end = end, boundary(following(key, grain), grain, calendar)


def minus(anchor: dt.datetime, amount: int, unit: str, calendar: Calendar) -> dt.datetime:
    """Civil subtraction: local time is kept, a missing day of the month becomes its last."""
    zone = calendar.zone()
    local = anchor.astimezone(zone).replace(tzinfo=None)
    try:
        if unit == "month":
            month = local.year * 12 + local.month - 1 - amount
            year, month = month // 12, month % 12 + 1
            last = (dt.date(year + month // 12, month % 12 + 1, 1) - dt.timedelta(days=1)).day
            local = local.replace(year=year, month=month, day=min(local.day, last))
        else:
            local -= dt.timedelta(days=amount * (7 if unit == "week" else 1))
    except (ValueError, OverflowError):
        return dt.datetime(1, 1, 1, tzinfo=dt.UTC)
    return resolve(local, zone)


def relative(op: str, amount: int | None, unit: str, anchor: dt.datetime, calendar: Calendar) -> tuple[dt.datetime, dt.datetime, bool]:
    """(low, high, whether high belongs) of a relative window."""
    if op == "inLast":
        return minus(anchor, amount or 1, unit, calendar), anchor, True
    key, start, end = period(anchor, unit, calendar)
    if op == "inPrevious":
        return boundary(following(key, unit, -1), unit, calendar), start, False
    return start, end, False


def wire_period(start: dt.datetime, end: dt.datetime, text: str, grain: str, timezone: str) -> dict:
    show = lambda x: print_instant(x, least_precision(x))
    return {"start": show(start), "endExclusive": show(end), "timezone": timezone, "grain": grain, "label": text}
