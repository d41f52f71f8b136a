"""Driver-side values: how operands are read and how plain values are written."""

from __future__ import annotations

import calendar
import math
import re
from datetime import datetime, timedelta, timezone
from typing import Any

#: White space as text trimming sees it.
JS_SPACE = "\t\n\x0b\x0c\r                  　﻿"

TRUE_WORDS = ("true", "t", "yes", "y", "1")
FALSE_WORDS = ("false", "f", "no", "n", "0")

_DECIMAL = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?")
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def js_number(value: Any) -> float | None:
    """A finite number, or one read from text: decimal, 0x, 0o or 0b; blank text is 0. None: not a number."""
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, (int, float)):
        return float(value) if math.isfinite(value) else None
    text = str(value).strip(JS_SPACE)
    if not text:
        return 0.0
    if _DECIMAL.fullmatch(text):
        number = float(text)
        return number if math.isfinite(number) else None
    if re.fullmatch(r"0[xX][0-9a-fA-F]+|0[oO][0-7]+|0[bB][01]+", text):
        return float(int(text, 0))
    return None


def js_boolean(value: Any) -> bool | None:
    """A truth value, 1 or 0, or one of the words, in any case. None: neither."""
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return {1: True, 0: False}.get(value)
    if isinstance(value, str):
        word = value.strip(JS_SPACE).lower()
        return True if word in TRUE_WORDS else False if word in FALSE_WORDS else None
    return None


_ISO = re.compile(r"([+-]\d{6}|\d{4})(?:-(\d\d)(?:-(\d\d))?)?(?:[T ](\d\d):(\d\d)(?::(\d\d)(?:\.(\d{1,9}))?)?\s?(Z|[+-]\d\d:?\d\d)?)?")
_TEXTS = ("%b %d %Y %H:%M:%S", "%b %d %Y %H:%M", "%b %d %Y", "%b %d, %Y %H:%M:%S", "%b %d, %Y", "%B %d %Y", "%B %d, %Y", "%B %d, %Y %H:%M:%S", "%m/%d/%Y %H:%M:%S", "%m/%d/%Y %H:%M", "%m/%d/%Y", "%Y/%m/%d", "%Y/%m/%d %H:%M:%S", "%d-%b-%Y", "%d-%b-%Y %H:%M:%S", "%d %b %Y", "%d %b %Y %H:%M:%S", "%a, %d %b %Y %H:%M:%S GMT")


def parse_date(text: str) -> int | None:
    """Epoch milliseconds of ISO text or of one of a fixed list of formats; without a zone it is UTC."""
    text = text.strip(JS_SPACE)
    if m := _ISO.fullmatch(text):
        year, month, day, hour, minute, second, fraction, zone = m.groups()
        try:
            moment = datetime(int(year), int(month or 1), int(day or 1), int(hour or 0), int(minute or 0), int(second or 0), tzinfo=timezone.utc)
        except ValueError:
            return None
        ms = (moment - EPOCH) // timedelta(milliseconds=1) + int(((fraction or "") + "000")[:3])
        if zone and zone != "Z":
            away = int(zone[1:3]) * 60 + int(zone[-2:])
            ms -= (away if zone[0] == "+" else -away) * 60_000
        return ms
    for form in _TEXTS:
        try:
            return (datetime.strptime(text, form).replace(tzinfo=timezone.utc) - EPOCH) // timedelta(milliseconds=1)
        except ValueError:
            continue
    return None


def js_date(value: Any) -> int | None:
    """Epoch milliseconds: of a datetime, of a number as it is, or of text."""
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, datetime):
        return ((value if value.tzinfo else value.replace(tzinfo=timezone.utc)) - EPOCH) // timedelta(milliseconds=1)
    if isinstance(value, (int, float)):
        return int(value) if math.isfinite(value) else None
    return parse_date(str(value))


def parse_partial_datetime(text: str, is_end: bool = False) -> int | str:
    """A year, month, day, hour or minute as epoch milliseconds: where the period begins, or its last minute.

    Parts after the minute are not looked at. ``''``: blank or not a date.
    """
    text = text.strip()
    if not text:
        return ""
    parts = [*re.split(r"[-T:]", text), "", "", "", ""]
    year, month = parts[0] or str(datetime.now(timezone.utc).year), parts[1] or ("12" if is_end else "01")
    try:
        last = calendar.monthrange(int(year), int(month))[1]
        moment = datetime(int(year), int(month), int(parts[2] or (last if is_end else 1)), int(parts[3] or (23 if is_end else 0)), int(parts[4] or (59 if is_end else 0)), tzinfo=timezone.utc)
    except (ValueError, calendar.IllegalMonthError):
        return ""
    if len(year) != 4 or any(len(p) > 2 for p in parts[1:5]):
        return ""
    return (moment - EPOCH) // timedelta(milliseconds=1)


def js_text(value: Any) -> str:
    """A value as text: whole numbers without a point, truth values in lower case, nothing for null."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return number_text(value)
    if isinstance(value, datetime):
        return iso_text(js_date(value))
    return str(value)


def number_text(x: float) -> str:
    if x != x:
        return "NaN"
    if math.isinf(x):
        return "Infinity" if x > 0 else "-Infinity"
    if x == 0:
        return "0"
    mantissa, _, exponent = f"{x!r}".partition("e")
    if not exponent and 1e-6 <= abs(x) < 1e21:
        return mantissa.removesuffix(".0")
    sign, digits, e = _shortest(x)
    if 0 <= e < 21:
        whole = digits.ljust(e + 1, "0")
        return sign + whole[: e + 1] + ("." + whole[e + 1 :] if len(whole) > e + 1 else "")
    if -7 < e < 0:
        return f"{sign}0.{'0' * (-e - 1)}{digits}"
    return f"{sign}{digits[0]}{'.' + digits[1:] if len(digits) > 1 else ''}e{'+' if e > 0 else '-'}{abs(e)}"


def _shortest(x: float) -> tuple[str, str, int]:
    """Sign, significant digits, and the exponent of the first."""
    from decimal import Decimal

    sign, digits, exponent = Decimal(repr(x)).normalize().as_tuple()
    return "-" if sign else "", "".join(map(str, digits)), len(digits) - 1 + exponent


def iso_text(ms: int) -> str:
    moment = EPOCH + timedelta(milliseconds=ms)
    return moment.strftime("%Y-%m-%dT%H:%M:%S") + (f".{ms % 1000:03d}" if ms % 1000 else "") + "Z"


def format_bytes(n: float) -> str:
    """B, KB, MB or GB; one decimal from KB on."""
    if not math.isfinite(n) or n <= 0:
        return "0 B"
    k = min(int(math.log(n, 1024)), 3)
    return f"{n / 1024**k:.{1 if k else 0}f} {('B', 'KB', 'MB', 'GB')[k]}"
