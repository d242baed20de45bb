"""Dates of recurring calendar events (FREQ, INTERVAL, COUNT, UNTIL, BYDAY, BYMONTHDAY, BYMONTH, BYSETPOS)."""

from __future__ import annotations

import calendar
import re
from collections.abc import Iterator
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

WEEKDAYS = ["MO", "TU", "WE", "TH", "FR", "SA", "SU"]


def moment(value: str) -> datetime:
    """`20240131`, `20240131T090000` or the same with Z, without its zone."""
    v = value.strip().rstrip("Z")
    return datetime.strptime(v, "%Y%m%dT%H%M%S" if "T" in v else "%Y%m%d")


def in_utc(at: datetime, zone: str | None) -> datetime:
    """A local time of a named zone as UTC; unknown zones and times without one stay."""
    try:
        return at.replace(tzinfo=ZoneInfo(zone)).astimezone(ZoneInfo("UTC")).replace(tzinfo=None) if zone else at
    except (ZoneInfoNotFoundError, ValueError):
        return at


def _days(first: datetime, size: int, by_day: list, by_month_day: list, default: int | None) -> list[int]:
    """Days (from 0) of a stretch of `size` days that begins at `first` which the rule's parts name."""
    if by_month_day:
        named = {d - 1 if d > 0 else size + d for d in by_month_day}
    elif by_day:
        named = set(range(size))
    else:
        named = {default - 1} if default else set()
    if by_day:
        days: set = set()
        for nth, weekday in by_day:
            same = [k for k in range(size) if (first.weekday() + k) % 7 == weekday]
            days |= set(same) if not nth else {same[nth - 1 if nth > 0 else nth]} if abs(nth) <= len(same) else set()
        named &= days
    return sorted(d for d in named if 0 <= d < size)


def occurrences(start: datetime, rule: str | None, last: datetime) -> Iterator[datetime]:
    """The dates of an event up to `last`. Days that a month lacks are left out and don't count."""
    if not rule:
        yield start
        return
    r = dict(x.upper().split("=", 1) for x in rule.split(";") if "=" in x)
    freq, every, most = r.get("FREQ"), max(1, int(r.get("INTERVAL", 1))), int(r.get("COUNT", 1 << 60))
    if "UNTIL" in r:
        until = moment(r["UNTIL"])
        last = min(last, until if "T" in r["UNTIL"] else until + timedelta(days=1, microseconds=-1))
    numbers = lambda key: [int(x) for x in r.get(key, "").split(",") if x]
    by_day = [(int(m[1] or 0), WEEKDAYS.index(m[2])) for x in r.get("BYDAY", "").split(",") if (m := re.fullmatch(r"([+-]?\d+)?(MO|TU|WE|TH|FR|SA|SU)", x))]
    month_days, months, places = numbers("BYMONTHDAY"), numbers("BYMONTH"), numbers("BYSETPOS")
    midnight, clock = start.replace(hour=0, minute=0, second=0), start - start.replace(hour=0, minute=0, second=0)

    def month(year: int, m: int, default: int | None) -> list[datetime]:
        first = datetime(year, m, 1)
        return [first + timedelta(days=d) for d in _days(first, calendar.monthrange(year, m)[1], by_day, month_days, default)]

    def period(k: int) -> tuple[datetime, list[datetime]]:
        """First day and dates of the k-th period of the rule."""
        if freq == "DAILY":
            day = midnight + timedelta(days=every * k)
            in_month = not month_days or day.day in month_days or day.day - calendar.monthrange(day.year, day.month)[1] - 1 in month_days
            return day, [day] if in_month and (not by_day or day.weekday() in [w for _, w in by_day]) else []
        if freq == "WEEKLY":
            week = midnight - timedelta(days=midnight.weekday()) + timedelta(weeks=every * k)
            return week, [week + timedelta(days=d) for d in sorted({w for _, w in by_day} or {start.weekday()})]
        if freq == "MONTHLY":
            n = start.month - 1 + every * k
            return datetime(start.year + n // 12, n % 12 + 1, 1), month(start.year + n // 12, n % 12 + 1, start.day)
        year = start.year + every * k
        first = datetime(year, 1, 1)
        if by_day and not months and not month_days:
            return first, [first + timedelta(days=d) for d in _days(first, 365 + calendar.isleap(year), by_day, [], None)]
        return first, [d for m in sorted(months or (range(1, 13) if month_days else [start.month])) for d in month(year, m, start.day)]

    if freq not in ("DAILY", "WEEKLY", "MONTHLY", "YEARLY"):
        yield start
        return
    seen = k = 0
    while seen < most:
        first, days = period(k)
        k += 1
        if first > last or first.year >= 9990:
            return
        if months:
            days = [d for d in days if d.month in months]
        if places:
            days = [days[p - 1 if p > 0 else p] for p in sorted(places, key=lambda p: p % (len(days) + 1)) if p and abs(p) <= len(days)]
        for at in (d + clock for d in days):
            if at < start:
                continue
            if at > last or seen >= most:
                return
            seen += 1
            yield at
