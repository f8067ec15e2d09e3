"""Reading one written date and time, in any of the forms feeds and ingest hosts use, as one UTC instant.

The grammar is a date (one of five shapes), an optional time and an optional zone. A value must match it
from end to end; anything left over makes the value unreadable rather than half read.
"""

from __future__ import annotations

import re
from datetime import UTC, date, datetime, timedelta
from functools import lru_cache
from zoneinfo import ZoneInfo

# Month names and their abbreviations in the four languages of the sources.
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6,
    "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12,
    "januar": 1, "jänner": 1, "februar": 2, "märz": 3, "mai": 5, "juni": 6, "juli": 7, "oktober": 10, "dezember": 12,
    "jän": 1, "mär": 3, "mrz": 3, "okt": 10, "dez": 12,
    "janvier": 1, "février": 2, "mars": 3, "avril": 4, "juin": 6, "juillet": 7, "août": 8, "septembre": 9, "octobre": 10, "novembre": 11, "décembre": 12,
    "janv": 1, "févr": 2, "fév": 2, "avr": 4, "juil": 7, "déc": 12,
    "enero": 1, "febrero": 2, "marzo": 3, "abril": 4, "mayo": 5, "junio": 6, "julio": 7, "agosto": 8, "septiembre": 9, "setiembre": 9, "octubre": 10, "noviembre": 11, "diciembre": 12,
    "ene": 1, "abr": 4, "ago": 8, "dic": 12,
}
# Zone letters, as minutes east of Greenwich.
OFFSETS = {
    "z": 0, "ut": 0, "utc": 0, "gmt": 0, "wet": 0,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420,
    "akst": -540, "akdt": -480, "hst": -600, "ast": -240, "adt": -180, "nst": -210, "ndt": -150,
    "bst": 60, "west": 60, "cet": 60, "mez": 60, "cest": 120, "mesz": 120, "eet": 120, "eest": 180, "msk": 180,
    "ist": 330, "pkt": 300, "sgt": 480, "hkt": 480, "awst": 480, "jst": 540, "kst": 540,
    "acst": 570, "acdt": 630, "aest": 600, "aedt": 660, "nzst": 720, "nzdt": 780, "brt": -180, "art": -180, "sast": 120,
}
# Letters that name a region, not an offset.
REGIONS = {"et": "America/New_York", "ct": "America/Chicago", "mt": "America/Denver", "pt": "America/Los_Angeles"}

CANONICAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z\z"

_WEEKDAY = re.compile(r"^([^\W\d_]{2,12})\.?,?\s+(?=\w)")
_DATE = [
    ("ymd", re.compile(r"(\d{4})([-/.])(\d{1,2})\2(\d{1,2})")),
    ("basic", re.compile(r"(\d{4})(\d{2})(\d{2})(?=[Tt\s]|$)")),
    ("num", re.compile(r"(\d{1,2})([/.\-])(\d{1,2})\2(\d{4}|\d{2})(?!\d)")),
    ("dmy", re.compile(r"(\d{1,2})(?:\.|er|º|st|nd|rd|th)?[\s\-]+(?:de\s+|of\s+)?([^\W\d_]{3,12})\.?,?[\s\-]+(?:de(?:l)?\s+)?(\d{4}|\d{2})(?!\d)")),
    ("mdy", re.compile(r"([^\W\d_]{3,12})\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})(?!\d)")),
]
_TIME = re.compile(
    r"(?:[Tt]|\s*,?\s*(?:at|à|um|a\s+las?|kl\.?)?\s*)(?<!\d)(\d{1,2})(?:\s*[:hH]\s*(\d{2})|(\d{2})(?=\d{2}))"
    r"(?::?(\d{2})(?:[.,](\d+))?)?\s*([AaPp]\.?\s?[Mm](?![^\W_])\.?)?(?:\s*Uhr\b)?"
)
_YEAR_LAST = re.compile(r"^([^\W\d_]{3}) (\d{1,2}) (\d{1,2}:\d{2}:\d{2}) (?:([A-Z]{2,5}) )?(\d{4})$")
_TIME_FIRST = re.compile(r"^(\d{1,2}:\d{2}(?::\d{2})?(?:\s?[AaPp]\.?[Mm]\.?)?(?:\s[A-Z]{2,4})?)(?: Uhr)?,? (?:on |am |le |el )?(?=\d{1,2}[ .]|[^\W\d_]{3,12}\.? \d)(.+)$")
_NAME_AFTER = re.compile(r"(?<=[+\-−]\d{4}) \([^()]*\)$")
_OFFSET = re.compile(r"(?:utc|gmt)?\s*([+\-−])(\d{1,2})(?::?(\d{2}))?$", re.I)
_EPOCH = re.compile(r"^(\d{10})(?:\.\d+)?$|^(\d{13})(?:\.\d+)?$")
_ZERO = datetime(1970, 1, 1, tzinfo=UTC)


@lru_cache(maxsize=1024)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except (KeyError, ValueError, OSError):
        return None


def _offset_or_zone(text: str, default: str):
    """Minutes east, a ZoneInfo, or None where the letters name nothing."""
    text = _NAME_AFTER.sub("", text.strip())
    if text[:1] in "[(" and text[-1:] in "])":
        text = text[1:-1].strip()
    if not text:
        return _zone(default) or 0
    low = text.lower().rstrip(".")
    if low in OFFSETS:
        return OFFSETS[low]
    if low in REGIONS:
        return _zone(REGIONS[low])
    if m := _OFFSET.match(text):
        minutes = int(m[2]) * 60 + int(m[3] or 0)
        return None if minutes > 18 * 60 else (minutes if m[1] == "+" else -minutes)
    return _zone(text) if "/" in text else None


def _date_of(kind: str, m: re.Match, order: str) -> tuple[int, int, int] | None:
    if kind == "ymd":
        return int(m[1]), int(m[3]), int(m[4])
    if kind == "basic":
        return int(m[1]), int(m[2]), int(m[3])
    if kind == "num":
        year = int(m[4]) + (2000 if len(m[4]) == 2 else 0)
        first, second = int(m[1]), int(m[3])
        month_first = m[2] == "/" and order == "mdy"
        return (year, first, second) if month_first else (year, second, first)
    month = MONTHS.get((m[2] if kind == "dmy" else m[1]).lower())
    if month is None:
        return None
    if kind == "dmy":
        return int(m[3]) + (2000 if len(m[3]) == 2 else 0), month, int(m[1])
    return int(m[3]), month, int(m[2])


def parse_instant(raw: str | None, zone: str | None = "UTC", order: str | None = "dmy") -> int | None:
    """Whole seconds since 1970 that ``raw`` denotes, or None if it names no date and time of its own.

    ``zone`` applies where the value has no zone; ``order`` (``dmy``/``mdy``) to numbers parted by slashes.
    A local time that occurs twice is its first pass, a skipped one moves forward by the gap, a date alone
    is its start. Fractions are dropped. Null, blank and unreadable values give None.
    """
    if raw is None:
        return None
    text = " ".join(raw.replace(" ", " ").replace(" ", " ").replace("﻿", "").split())
    if not text:
        return None
    if m := _EPOCH.match(text):
        return int(m[1]) if m[1] else int(m[2]) // 1000
    if (m := _WEEKDAY.match(text)) and m[1].lower() not in MONTHS:
        text = text[m.end() :]
    text = _YEAR_LAST.sub(r"\1 \2 \5 \3 \4", text)
    text = _TIME_FIRST.sub(r"\2 \1", text)
    for kind, pattern in _DATE:
        m = pattern.match(text)
        day = _date_of(kind, m, order or "dmy") if m else None
        if day:
            break
    else:
        return None
    rest = text[m.end() :]
    hour = minute = second = 0
    if t := _TIME.match(rest):
        hour, minute, second = int(t[1]), int(t[2] or t[3]), int(t[4] or 0)
        if t[6]:
            if not 1 <= hour <= 12:
                return None
            hour = hour % 12 + (12 if t[6][0] in "pP" else 0)
        rest = rest[t.end() :]
    if hour > 24 or minute > 59 or second > 60 or (hour == 24 and (minute or second)):
        return None
    where = _offset_or_zone(rest, zone or "UTC")
    if where is None:
        return None
    try:
        midnight = datetime.combine(date(*day), datetime.min.time())
    except ValueError:
        return None
    local = midnight + timedelta(hours=hour, minutes=minute, seconds=second)
    if isinstance(where, int):
        return int((local.replace(tzinfo=UTC) - _ZERO).total_seconds()) - where * 60
    # fold=0 reads a doubled time as its first pass and a skipped one with the offset before the gap.
    return int((local.replace(tzinfo=where, fold=0) - _ZERO).total_seconds())
