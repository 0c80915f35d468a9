"""Times of a request as epoch seconds: ``now``, ``-1d``, ``noon_today``, ``20240131``, epochs."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta

from seriesloom.functions.parser import ParseError, seconds

#: Times of day by name.
NAMED_TIMES = {"midnight": (0, 0), "noon": (12, 0), "teatime": (16, 0)}
_DAYS = {"today": 0, "yesterday": -1, "tomorrow": 1}
_TIME = re.compile(r"(\d{1,2}):(\d{2})(am|pm)?\Z|(\d{1,2})(am|pm)\Z")


def _time(text: str) -> tuple[int, int]:
    if text in NAMED_TIMES:
        return NAMED_TIMES[text]
    found = _TIME.match(text)
    if not found:
        raise ParseError(f"bad time {text!r}")
    hour, minute = int(found[1] or found[4]), int(found[2] or 0)
    half = found[3] or found[5]
    hour = hour % 12 + 12 * (half == "pm") if half else hour
    if hour > 23 or minute > 59:
        raise ParseError(f"bad time {text!r}")
    return hour, minute


def _day(text: str, now: datetime) -> datetime:
    start = now.replace(hour=0, minute=0, second=0, microsecond=0)
    if text in _DAYS:
        return start + timedelta(days=_DAYS[text])
    for shape in ("%Y%m%d", "%m/%d/%y", "%m/%d/%Y"):
        try:
            return datetime.strptime(text, shape).replace(tzinfo=now.tzinfo)
        except ValueError:
            continue
    raise ParseError(f"bad date {text!r}")


def epoch(text: str, now: datetime | None = None, default: int | None = None) -> int:
    """The moment that ``text`` names, seen from ``now`` (UTC)."""
    now = now or datetime.now(UTC)
    text = text.strip().lower()
    if not text:
        if default is None:
            raise ParseError("empty time")
        return default
    if text == "now":
        return int(now.timestamp())
    if text[0] == "-":
        return int(now.timestamp()) + seconds(text, -1)
    if text.isdigit() and len(text) > 8:
        return int(text)
    text = text.replace(",", "").replace("_", " ")
    first, _, second = text.partition(" ")
    if second:
        day, time = _day(second, now), _time(first)
    elif first in NAMED_TIMES or _TIME.match(first):
        day, time = _day("today", now), _time(first)
    else:
        day, time = _day(first, now), (0, 0)
    return int(day.replace(hour=time[0], minute=time[1]).timestamp())
