"""Kinds and literals: parsing, range checks and canonical forms."""

from __future__ import annotations

import datetime as dt
import decimal
import re
import unicodedata
from decimal import Decimal
from typing import Any

from .errors import Refusal, refuse

#: Enough for any sum of 38-digit values; nothing is ever rounded in it unless asked for.
EXACT = decimal.Context(prec=400, rounding=decimal.ROUND_HALF_EVEN, Emin=-9999, Emax=9999)
INTEGER_LIMIT = 2**53 - 1
_DECIMAL = re.compile(r"[+-]?(0|[0-9]+)(\.[0-9]+)?([eE][+-]?[0-9]+)?")
_INSTANT = re.compile(r"(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})(?:\.(\d{3}|\d{6}))?Z")
_DATE = re.compile(r"\d{4}-\d{2}-\d{2}")
DIGITS = {"second": 0, "millisecond": 3, "microsecond": 6}
PRECISIONS = {0: "second", 3: "millisecond", 6: "microsecond"}
EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.UTC)

# The alphabetic codes of ISO 4217:2015.
CURRENCIES = frozenset(
    "AED AFN ALL AMD ANG AOA ARS AUD AWG AZN BAM BBD BDT BGN BHD BIF BMD BND BOB BOV BRL BSD BTN BWP BYR BZD CAD CDF CHE CHF CHW CLF CLP CNY COP COU CRC CUC CUP CVE CZK DJF DKK DOP DZD EGP ERN ETB EUR FJD FKP GBP GEL GHS GIP GMD GNF GTQ GYD HKD HNL HRK HTG HUF IDR ILS INR IQD IRR ISK JMD JOD JPY KES KGS KHR KMF KPW KRW KWD KYD KZT LAK LBP LKR LRD LSL LYD MAD MDL MGA MKD MMK MNT MOP MRO MUR MVR MWK MXN MXV MYR MZN NAD NGN NIO NOK NPR NZD OMR PAB PEN PGK PHP PKR PLN PYG QAR RON RSD RUB RWF SAR SBD SCR SDG SEK SGD SHP SLL SOS SRD SSP STD SVC SYP SZL THB TJS TMT TND TOP TRY TTD TWD TZS UAH UGX USD USN UYI UYU UZS VEF VND VUV WST XAF XAG XAU XBA XBB XBC XBD XCD XDR XOF XPD XPF XPT XSU XTS XUA XXX YER ZAR ZMW ZWL".split()
)


def parse_decimal(text: Any, path: str, precision: int | None = None, scale: int | None = None) -> Decimal:
    """An exact decimal; precision and scale are checked, never rounded to."""
    if not isinstance(text, str) or not _DECIMAL.fullmatch(text):
        raise refuse("SCHEMA_TYPE_MISMATCH", path, ["Use a JSON string."])
    mantissa, _, exponent = text.lower().partition("e")
    digits = mantissa.lstrip("+-").replace(".", "")
    shift = int(exponent or 0) - len(mantissa.partition(".")[2])
    whole = digits.lstrip("0")
    if not whole:
        return Decimal(0)
    body = whole.rstrip("0")
    places = -(shift + len(whole) - len(body))
    # bounds are checked before anything is expanded
    if max(0, places) > (38 if scale is None else scale):
        raise refuse("NUMERIC_SCALE_MISMATCH", path, [f"Use a decimal with at most {38 if scale is None else scale} fractional digits."])
    coefficient = len(body) + (max(0, -places) if scale is None else scale - places)
    if coefficient > (precision or 38):
        raise refuse("NUMERIC_OVERFLOW", path)
    return EXACT.create_decimal(text.lower())


def print_decimal(value: Decimal, scale: int | None = None) -> str:
    """Canonical text: exactly `scale` fractional digits, or as few as the value has."""
    if scale is not None:
        return f"{value.quantize(Decimal(1).scaleb(-scale), context=EXACT):f}" if value else f"{Decimal(0).scaleb(-scale):f}"
    text = f"{value:f}"
    if "." in text:
        text = text.rstrip("0").rstrip(".")
    return "0" if text in ("-0", "") else text


ROUNDING = ("halfEven", "down", "up")


def divide(numerator: Decimal, denominator: Decimal, scale: int, rounding: str = "halfEven") -> Decimal:
    """Rounded once: half to even, or towards (down) or away from (up) zero."""
    if rounding not in ROUNDING:
        raise ValueError(rounding)
    n, d = EXACT.multiply(numerator, Decimal(10) ** scale).as_integer_ratio(), denominator.as_integer_ratio()
    top, bottom = n[0] * d[1], n[1] * d[0]
    if bottom < 0:
        top, bottom = -top, -bottom
    q, r = divmod(abs(top), bottom)
    if (rounding == "up" and r) or (rounding == "halfEven" and (2 * r > bottom or (2 * r == bottom and q % 2))):
        q += 1
    return Decimal(-q if top < 0 else q).scaleb(-scale, context=EXACT)


def parse_instant(text: Any, path: str, precision: str | None = None) -> dt.datetime:
    """A UTC instant; with a precision, of exactly that one."""
    m = _INSTANT.fullmatch(text) if isinstance(text, str) else None
    if not m:
        raise refuse("SCHEMA_TYPE_MISMATCH", path, ["Use a JSON string."])
    try:
        value = dt.datetime.fromisoformat(m[1]).replace(microsecond=int((m[2] or "0").ljust(6, "0")), tzinfo=dt.UTC)
    except ValueError:
        raise refuse("SCHEMA_INVALID_VALUE", path, ["Use a valid UTC instant."]) from None
    if precision is not None and len(m[2] or "") != DIGITS[precision]:
        raise refuse("INSTANT_PRECISION_MISMATCH", path, [f"Use {precision} precision."])
    return value


def print_instant(value: dt.datetime, precision: str = "second") -> str:
    digits = DIGITS[precision]
    value = value.astimezone(dt.UTC)
    return value.strftime("%Y-%m-%dT%H:%M:%S").rjust(19, "0") + (f".{value.microsecond:06d}"[: digits + 1] if digits else "") + "Z"


def least_precision(value: dt.datetime) -> str:
    return "second" if not value.microsecond else "millisecond" if value.microsecond % 1000 == 0 else "microsecond"


def parse_date(text: Any, path: str) -> dt.date:
    if not isinstance(text, str) or not _DATE.fullmatch(text):
        raise refuse("SCHEMA_TYPE_MISMATCH", path, ["Use a JSON string."])
    try:
        return dt.date.fromisoformat(text)
    except ValueError:
        raise refuse("SCHEMA_INVALID_VALUE", path, ["Use a valid Gregorian date."]) from None


def scalar_text(value: Any, path: str) -> str:
    if not isinstance(value, str):
        raise refuse("SCHEMA_TYPE_MISMATCH", path, ["Use a JSON string."])
    if any(0xD800 <= ord(c) <= 0xDFFF for c in value):
        raise refuse("SCHEMA_INVALID_VALUE", path, ["Use Unicode scalar values."])
    return value


def literal(field: Any, value: Any, path: str) -> tuple[Any, Any]:
    """(typed value, canonical wire value) of a literal for a field; null is let through for nullable fields."""
    kind = field.kind
    if value is None:
        if not field.nullable and kind != "null":
            raise refuse("SCHEMA_TYPE_MISMATCH", path, [f"Use a JSON {_json_type(kind)}."])
        return None, None
    if kind == "boolean":
        if not isinstance(value, bool):
            raise refuse("SCHEMA_TYPE_MISMATCH", path, ["Use a JSON boolean."])
        return value, value
    if kind == "integer":
        if isinstance(value, bool) or not isinstance(value, int):
            raise refuse("SCHEMA_TYPE_MISMATCH", path, ["Use a JSON integer."])
        if abs(value) > INTEGER_LIMIT:
            raise refuse("NUMERIC_OVERFLOW", path)
        return value, value
    if kind == "decimal":
        number = parse_decimal(value, path, field.precision, field.scale)
        return number, print_decimal(number, field.scale)
    if kind == "money":
        return _money(field, value, path)
    if kind == "date":
        day = parse_date(value, path)
        return day, value
    if kind == "instant":
        at = parse_instant(value, path, field.instant_precision)
        return at, value
    if kind == "null":
        raise refuse("SCHEMA_TYPE_MISMATCH", path, ["Use JSON null."])
    text = scalar_text(value, path)
    if kind == "id":
        if not text or len(text.encode()) > 256:
            raise refuse("SCHEMA_INVALID_VALUE", path, ["Use a non-empty id of at most 256 UTF-8 bytes."])
        return text, text
    if kind == "enum":
        if text not in field.codes:
            raise refuse("ENUM_VALUE_INVALID", path, sorted(field.codes))
        return text, text
    text = unicodedata.normalize("NFC", text)
    return text, text


def _money(field: Any, value: Any, path: str) -> tuple[Any, Any]:
    if not isinstance(value, dict) or set(value) != {"amount", "currency"}:
        raise refuse("SCHEMA_TYPE_MISMATCH", path, ["Use one closed Money object."])
    currency = value["currency"]
    if not isinstance(currency, str):
        raise refuse("SCHEMA_TYPE_MISMATCH", f"{path}/currency", ["Use a JSON string."])
    legal = field.currencies or CURRENCIES
    if currency not in legal:
        raise refuse("ENUM_VALUE_INVALID", f"{path}/currency", sorted(legal) if field.currencies else [])
    amount = parse_decimal(value["amount"], f"{path}/amount", field.precision, field.scale)
    return (currency, amount), {"amount": print_decimal(amount, field.scale), "currency": currency}


def _json_type(kind: str) -> str:
    return {"boolean": "boolean", "integer": "integer", "money": "object"}.get(kind, "string")


def ordered(kind: str) -> bool:
    """Whether lt, lte, gt and gte are defined."""
    return kind not in ("boolean", "null")


def is_refusal(exc: BaseException) -> bool:
    return isinstance(exc, Refusal)
