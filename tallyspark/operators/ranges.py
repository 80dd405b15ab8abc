"""Time ranges of queries, with an explicit now."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

MINUTE, HOUR, DAY = 60_000, 3_600_000, 86_400_000
CHINA_MS = 8 * HOUR
LENGTHS = {"24h": DAY, "7d": 7 * DAY, "30d": 30 * DAY}


@dataclass(frozen=True)
class TimeRange:
    from_ms: int
    to_ms: int
    label: str
    interval: int  # minutes

    @property
    def minutes(self) -> tuple[int, int]:
        """First and last minute, both inclusive."""
        return self.from_ms // MINUTE, self.to_ms // MINUTE


def _ms(value: int | str) -> int:
    text = str(value)
    try:
        return int(text)
    except ValueError:
        at = datetime.fromisoformat(text.replace("Z", "+00:00"))
        if at.tzinfo is None:
            raise ValueError("times need a zone") from None
        return int(at.astimezone(timezone.utc).timestamp() * 1000)


def interval_minutes(length_ms: int) -> int:
    for most, minutes in ((48 * HOUR, 60), (10 * DAY, 360), (45 * DAY, 1440)):
        if length_ms <= most:
            return minutes
    return 10080


def time_range(now_ms: int, label: str = "24h", start: int | str | None = None, end: int | str | None = None) -> TimeRange:
    label = label.strip() or "24h"
    if label in LENGTHS:
        a, b = now_ms - LENGTHS[label], now_ms
    elif label == "all":
        a, b = 0, now_ms
    elif label == "custom":
        a, b = _ms(start), _ms(end)
    else:
        raise ValueError("range must be 24h, 7d, 30d, all or custom")
    if a >= b:
        raise ValueError("from must be before to")
    return TimeRange(a, b, label, interval_minutes(b - a))


def health_range(now_ms: int) -> TimeRange:
    """Five calendar days at UTC+8 up to today's end, in quarters of an hour."""
    today = (now_ms + CHINA_MS) // DAY * DAY - CHINA_MS
    return TimeRange(today - 4 * DAY, today + DAY - 1, "5d", 15)
