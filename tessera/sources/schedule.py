"""Times of polling: ISO-8601 durations and cron expressions of six fields."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

_DURATION = re.compile(r"^P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?$")
# Names of months and days in cron expressions.
_MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
_DAYS = ("SUN", "MON", "TUE", "WED", "THU", "FRI", "SAT")
#: Years after which a time that never comes is given up.
_HORIZON = 5


def seconds_of(duration: str) -> float:
    """Seconds of an ISO-8601 duration of days, hours, minutes and seconds."""
    m = _DURATION.match(duration.strip().upper())
    if not m or not any(m.groups()):
        raise ValueError(f"not a duration: {duration!r}")
    days, hours, minutes, seconds = (float(x or 0) for x in m.groups())
    return ((days * 24 + hours) * 60 + minutes) * 60 + seconds


def trigger_interval(text: str) -> str:
    """An interval as Spark's triggers take it; ISO-8601 durations are turned into milliseconds."""
    return f"{round(seconds_of(text) * 1000)} milliseconds" if text.strip().upper().startswith("P") else text


def _field(text: str, low: int, high: int, names: tuple[str, ...] = (), first: int = 0) -> frozenset[int]:
    """The values that one field allows: *, ?, numbers, names, ranges, lists and steps."""

    def number(x: str) -> int:
        n = names.index(x) + first if x in names else int(x)
        if not low <= n <= high:
            raise ValueError(f"{n} isn't between {low} and {high}")
        return n

    found: set[int] = set()
    for part in text.upper().split(","):
        span, _, step = part.partition("/")
        if span in ("*", "?"):
            start, end = low, high
        else:
            a, dash, b = span.partition("-")
            start = number(a)
            end = number(b) if dash else high if step else start
        found.update(range(start, end + 1, int(step or 1)))
    return frozenset(found)


class Cron:
    """Second, minute, hour, day of month, month and day of week (0 and 7 are Sunday)."""

    def __init__(self, expression: str):
        parts = expression.split()
        if len(parts) != 6:
            raise ValueError(f"a cron expression has six fields: {expression!r}")
        self.second, self.minute, self.hour = _field(parts[0], 0, 59), _field(parts[1], 0, 59), _field(parts[2], 0, 23)
        self.day, self.month = _field(parts[3], 1, 31), _field(parts[4], 1, 12, _MONTHS, 1)
        self.weekday = frozenset(d % 7 for d in _field(parts[5], 0, 7, _DAYS))

    def after(self, now: datetime) -> datetime:
        """The first time after ``now``."""
        t, limit = now.replace(microsecond=0) + timedelta(seconds=1), now.year + _HORIZON
        while t.year <= limit:
            if t.month not in self.month or t.day not in self.day or t.isoweekday() % 7 not in self.weekday:
                t = t.replace(hour=0, minute=0, second=0) + timedelta(days=1)
            elif t.hour not in self.hour:
                t = t.replace(minute=0, second=0) + timedelta(hours=1)
            elif t.minute not in self.minute:
                t = t.replace(second=0) + timedelta(minutes=1)
            elif t.second not in self.second:
                t += timedelta(seconds=1)
            else:
                return t
        raise ValueError("the cron expression names no time to come")
