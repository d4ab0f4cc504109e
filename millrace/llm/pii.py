"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Numbers and dates that pass their format's validation are permuted within the
format by a keyed Feistel network: payment cards stay valid under their check
digit, social security numbers keep to issued ranges, account numbers keep their
check digits, dates are calendar dates, addresses are addresses.  The permutation
depends on the value and the key alone, so equal values stay linked across
documents, and different ones of a format stay different; dates written day first
and month first share one, so that two of these may meet.  E-mail addresses and secrets, which
have no numeric format, get keyed names of the same kind.

Numbers that fail validation are left alone.  Account numbers have their country's
length, whatever follows; what fails as one is searched for all other kinds.

Defined results: null stays null; texts without personal data stay as they are,
byte for byte; repeated rows give equal rows; all other columns pass through; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import scratch

#: For tests only: whoever knows the key can undo the permutation.  Set your own in KEY_SETTING, or pass it.
KEY = "millrace-default-key"
KEY_SETTING = "spark.millrace.pii.key"
ROUNDS = 8

# What may stand between two words of a number in tables and noisy texts.
_GAP = r"(?:[ .\-]|[*&%$#!@|]{0,4} (?:\| )?)"
_SEPARATE = r"(?![\p{L}\p{N}_])"
_MARK, _ESCAPED, _ACCOUNT, _FAILED = "\u0001\u0002", "\u0001\u0003", "\u0001\u0004", "\u0001\u0005"
#: Lengths of account numbers by country, as registered or in use.
_IBAN_LENGTHS = {
    15: "NO",
    16: "BE",
    18: "DK FI FK FO GL NL SD",
    19: "MK SI",
    20: "AT BA EE KZ LT LU MN XK",
    21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY MZ PT ST",
    26: "DZ IR IS TR",
    27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG",
    29: "BR EG PS QA UA",
    30: "JO KW MU YE",
    31: "MT SC",
    32: "LC",
    33: "RU",
}


def _iban_body(size: int) -> str:
    groups, rest = divmod(size - 4, 4)
    return rf"(?: ?[A-Z0-9]{{4}}){{{groups}}}" + (rf" ?[A-Z0-9]{{{rest}}}" if rest else "")


_IBAN_START = rf"(?<![\p{{L}}\p{{N}}_])(?<!{_FAILED})"
_IBAN = "|".join(rf"(?:{codes.replace(' ', '|')})\d{{2}}{_iban_body(size)}{_SEPARATE}" for size, codes in _IBAN_LENGTHS.items())
KINDS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@(?:[\p{L}\p{N}\-]+\.)+\p{L}{2,}",
    "iban": _IBAN_START + rf"(?=[A-Z]{{2}}\d{{2}})(?:{_IBAN}|[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?{_SEPARATE})",
    "secret": r"(?<![\p{L}\p{N}_])(?:(?=[0-9]*[A-Fa-f])(?=[A-Fa-f]*[0-9])[0-9A-Fa-f]{32,64}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,255}|sk-[A-Za-z0-9\-]{20,200})" + _SEPARATE,
    "ip": r"(?<![\p{L}\p{N}_.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?[\p{L}\p{N}_])",
    "date": r"(?<![\p{L}\p{N}_/.\-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\p{N}_/\-])",
    "ssn": r"(?<![\p{L}\p{N}_\-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}_\-])",
    "card": r"(?<![\p{L}\p{N}_\-])(?:\d{13,19}|\d{4}(?<gap>[ \-])\d{4}\k<gap>\d{4}\k<gap>\d{1,7}|\d{4}[ \-]\d{6}[ \-]\d{5})" + _SEPARATE,
    "phone": r"(?<![\p{L}\p{N}_+])(?:\+\d{1,3}" + _GAP + r"?)?(?:\(\d{3}\)" + _GAP + r"?|\d{3}" + _GAP + r")\d{3}" + _GAP + r"\d{4}" + _SEPARATE + r"|(?<![\p{L}\p{N}_+])\+\d{8,15}" + _SEPARATE,
}


def _round(key: Column, tweak: Column, i: Column, value: Column) -> Column:
    """60 pseudo-random bits."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", key, tweak, i, value), 256), 1, 15), 16, 10).cast("long")


def feistel(a: Column, b: Column, mod_a: Column, mod_b: Column, key: Column, tweak: Column) -> Column:
    """A keyed permutation of pairs (a below mod_a, b below mod_b): struct<a, b>.  Moduli up to 10**18."""

    def step(acc: Column, i: Column) -> Column:
        low = F.when(i % 2 == 0, mod_a).otherwise(mod_b)
        return F.struct(acc["b"].alias("a"), ((acc["a"] + _round(key, tweak, i, acc["b"]) % low) % low).alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), step)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def permuted_digits(digits: Column, key: Column, tweak: Column) -> Column:
    """A string of 2 to 36 digits permuted among the strings of its length."""
    size = F.length(digits)
    left = F.floor(size / 2).cast("int")
    power = lambda n: F.pow(F.lit(10.0), n).cast("long")
    moved = feistel(F.substring(digits, F.lit(1), left).cast("long"), F.substring(digits, left + 1, size - left).cast("long"), power(left), power(size - left), key, F.concat(tweak, size))
    return _let(moved, lambda p: F.concat(F.lpad(p["a"].cast("string"), left, "0"), F.lpad(p["b"].cast("string"), size - left, "0")))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, r"\D", "")


def _refilled(x: Column, digits: Column) -> Column:
    """x with its digits replaced in order."""
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("k"))
    put = lambda acc, c: F.when(c.rlike("[0-9]"), F.struct(F.concat(acc["s"], F.substring(digits, acc["k"], F.lit(1))).alias("s"), (acc["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(acc["s"], c).alias("s"), acc["k"].alias("k")))
    return F.aggregate(F.split(x, ""), start, put)["s"]


def luhn(digits: Column) -> Column:
    """Sum of the check; a valid number's is a multiple of ten."""
    size = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return acc + F.when((size - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), size), F.lit(0), add)


def _card(x: Column, key: Column) -> Column:
    def moved(d: Column) -> Column:
        size = F.length(d)
        body = F.concat(F.substring(d, 1, 1), permuted_digits(F.substring(d, F.lit(2), size - 2), key, F.lit("card")))
        return _let(body, lambda b: _refilled(x, F.concat(b, ((10 - luhn(F.concat(b, F.lit("0"))) % 10) % 10).cast("string"))))

    return _let(_digits(x), lambda d: F.when((luhn(d) % 10 == 0) & ~d.rlike(r"^(\d)\1*$"), moved(d)).otherwise(x))


def _ssn(x: Column, key: Column) -> Column:
    area, group, serial = (F.substring(x, a, n).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    number = (area - 1 - F.when(area > 666, 1).otherwise(0)) * 99 + group - 1

    def printed(p: Column) -> Column:
        index = F.floor(p["a"] / 99).cast("int")
        return F.format_string("%03d-%02d-%04d", index + 1 + F.when(index >= 665, 1).otherwise(0), (p["a"] % 99 + 1).cast("int"), (p["b"] + 1).cast("int"))

    return F.when(valid, _let(feistel(number, serial - 1, F.lit(898 * 99).cast("long"), F.lit(9999).cast("long"), key, F.lit("ssn")), printed)).otherwise(x)


def _ip(x: Column, key: Column) -> Column:
    part = F.split(x, r"\.")
    n = [F.get(part, F.lit(i)).cast("long") for i in range(4)]
    size = F.lit(65536).cast("long")
    shown = lambda p: F.concat_ws(".", *(v.cast("long").cast("string") for v in (F.floor(p["a"] / 256), p["a"] % 256, F.floor(p["b"] / 256), p["b"] % 256)))
    return _let(feistel(n[0] * 256 + n[1], n[2] * 256 + n[3], size, size, key, F.lit("ip")), shown)


def _phone(x: Column, key: Column) -> Column:
    def moved(d: Column) -> Column:
        size = F.length(d)
        own = F.least(F.lit(10), size - 1)
        return _refilled(x, F.concat(F.substring(d, F.lit(1), size - own), permuted_digits(F.substring(d, size - own + 1, own), key, F.lit("phone"))))

    return _let(_digits(x), moved)


#: Days from 1800-01-01 to 2199-12-31, in a grid of 383 x 382.
_FIRST, _DAYS, _WIDE, _HIGH = "1800-01-01", 146097, 383, 382


def _date(x: Column, key: Column) -> Column:
    def moved(pattern: str) -> Column:
        day = F.try_to_timestamp(x, F.lit(pattern)).cast("date")
        number = F.datediff(day, F.lit(_FIRST).cast("date"))

        def once(n: Column) -> Column:
            p = feistel(F.floor(n / _HIGH), n % _HIGH, F.lit(_WIDE).cast("long"), F.lit(_HIGH).cast("long"), key, F.lit("date"))
            return _let(p, lambda q: (q["a"] * _HIGH + q["b"]).cast("long"))

        def walk(n: Column) -> Column:  # the grid's few cells beyond the last day are walked through
            return F.aggregate(F.sequence(F.lit(1), F.lit(8)), once(n), lambda acc, _: F.when(acc < _DAYS, acc).otherwise(once(acc)))

        def found(n: Column) -> Column:
            return F.when(n.between(0, _DAYS - 1), F.date_format(F.date_add(F.lit(_FIRST).cast("date"), walk(n).cast("int")), pattern))

        return _let(number.cast("long"), found)

    return F.coalesce(F.when(x.contains("-"), moved("yyyy-MM-dd")).when(x.contains("."), moved("dd.MM.yyyy")).otherwise(F.coalesce(moved("MM/dd/yyyy"), moved("dd/MM/yyyy"))), x)


def _mod97(x: Column) -> Column:
    """Remainder of letters and digits read as A = 10 ... Z = 35."""
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(x, ""), F.lit(0), lambda acc, c: _let(value(c), lambda v: (acc * F.when(v > 9, 100).otherwise(10) + v) % 97))


def _iban_valid(plain: Column) -> Column:
    size = F.length(_digits(F.substring(plain, F.lit(5), F.length(plain) - 4)))
    return (_mod97(F.concat(F.substring(plain, F.lit(5), F.length(plain) - 4), F.substring(plain, 1, 4))) == 1) & size.between(4, 30)


def _iban(x: Column, key: Column) -> Column:
    def moved(plain: Column) -> Column:
        country, own = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain) - 4)
        number = _digits(own)
        fresh = _refilled(own, permuted_digits(number, key, F.lit("iban")))

        def whole(f: Column) -> Column:
            check = F.lpad((98 - _mod97(F.concat(f, country, F.lit("00")))).cast("string"), 2, "0")
            return _refilled(x, _digits(F.concat(check, f)))

        return F.when(_iban_valid(plain), _let(fresh, whole)).otherwise(x)

    return _let(F.replace(x, F.lit(" "), F.lit("")), moved)


def _email(x: Column, key: Column) -> Column:
    name = lambda part, size: F.substring(F.sha2(F.concat_ws("|", key, F.lit("email"), F.lower(part)), 256), 1, size)
    return F.concat(F.lit("u"), name(F.substring_index(x, "@", 1), 12), F.lit("@d"), name(F.substring_index(x, "@", -1), 8), F.lit(".example"))


def _secret(x: Column, key: Column) -> Column:
    head = F.regexp_extract(x, r"^(AKIA|gh[pousr]_|sk-)", 1)
    plain = F.concat(F.sha2(F.concat_ws("|", key, F.lit("secret"), F.lower(x)), 256), F.sha2(F.concat_ws("|", key, F.lit("secret2"), F.lower(x)), 256), F.sha2(F.concat_ws("|", key, F.lit("secret3"), F.lower(x)), 256), F.sha2(F.concat_ws("|", key, F.lit("secret4"), F.lower(x)), 256))
    body = F.substring(plain, F.lit(1), F.length(x) - F.length(head))
    return F.concat(head, F.when(x == F.upper(x), F.upper(body)).otherwise(body))


_MOVES = {"email": _email, "iban": _iban, "secret": _secret, "ip": _ip, "date": _date, "ssn": _ssn, "card": _card, "phone": _phone}


#: What any candidate holds; texts without it needn't be searched further.
_ANY = r"[0-9@]|AKIA|gh[pousr]_|sk-"


_CUT = f"{_ACCOUNT}(?<account>[^\u0001]*+){_ACCOUNT}|(?<other>" + "|".join(f"(?:{p})" for p in KINDS.values()) + ")"


def _cut(text: Column) -> Column:
    return F.split(F.regexp_replace(text, _CUT, f"{_MARK}${{account}}${{other}}{_MARK}"), _MARK, -1)


def _accounts(text: Column) -> Column:
    """The text with valid account numbers between marks, and a mark before each candidate that fails, from where the search has gone on."""
    is_iban = lambda x: x.rlike(f"^(?:{KINDS['iban']})$") & ~x.rlike(f"^(?:{KINDS['email']})$")

    def judged(x: Column) -> Column:
        good = _iban_valid(F.replace(x, F.lit(" "), F.lit("")))
        return F.when(is_iban(x), F.when(good, F.concat(F.lit(_ACCOUNT), x, F.lit(_ACCOUNT))).otherwise(F.concat(F.lit(_FAILED), x))).otherwise(x)

    def step(acc: Column, _: Column) -> Column:
        def put(cut: Column) -> Column:
            return _let(F.array_join(F.transform(cut, lambda x, i: F.when(i % 2 == 1, judged(x)).otherwise(x)), ""), lambda t: F.struct(t.alias("s"), (t != acc["s"]).alias("more")))

        return F.when(acc["more"], _let(_cut(acc["s"]), put)).otherwise(acc)

    # every round but the last fails one candidate at least
    rounds = F.regexp_count(text, F.lit(_IBAN_START + r"[A-Z]{2}\d{2}(?= ?[A-Z0-9])"))
    return F.when(rounds > 0, F.aggregate(F.sequence(F.lit(1), rounds), F.struct(text.alias("s"), F.lit(True).alias("more")), step)["s"]).otherwise(text)


def parts(text: Column) -> Column:
    """The text cut at everything that looks personal: odd places hold the candidates."""
    escaped = F.replace(text, F.lit("\u0001"), F.lit(_ESCAPED))
    return F.when(text.rlike(_ANY), _let(_accounts(escaped), _cut)).when(text.isNotNull(), F.array(text))


def kind_of(x: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(KINDS.items()):
        out = F.when(x.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(out)
    return out


def pseudonym(x: Column, key: Column) -> Column:
    """A candidate's pseudonym; the candidate itself if it fails validation."""

    def chosen(kind: Column) -> Column:
        out = x
        for name, move in _MOVES.items():
            out = F.when(kind == name, move(x, key)).otherwise(out)
        return out

    return _let(kind_of(x), chosen)


def pseudonymise(docs: DataFrame, text_col: str = "text", key: str | None = None, count_col: str | None = None) -> DataFrame:
    """All columns, the text with pseudonyms; with count_col, also how many values were replaced.

    The key is the argument, else the session's KEY_SETTING, else the tests' key.
    """
    k = F.lit(key or docs.sparkSession.conf.get(KEY_SETTING, None) or KEY)
    cut, new = scratch.fresh(docs, "pii_parts"), scratch.fresh(docs, "pii_new")
    own = [c for c in docs.columns]
    with_parts = docs.withColumn(cut, parts(F.col(f"`{text_col}`")))
    moved = with_parts.withColumn(new, F.transform(cut, lambda x, i: F.when(i % 2 == 1, pseudonym(x, k)).otherwise(x)))
    text = F.replace(F.replace(F.array_join(new, ""), F.lit(_FAILED), F.lit("")), F.lit(_ESCAPED), F.lit("\u0001"))
    out = [F.when(F.size(cut) > 1, text).otherwise(F.col(f"`{c}`")).alias(c) if c == text_col else F.col(f"`{c}`") for c in own]
    if count_col:
        changed = F.aggregate(F.arrays_zip(F.col(cut).alias("a"), F.col(new).alias("b")), F.lit(0).cast("long"), lambda acc, z: acc + F.when(z["a"] != z["b"], 1).otherwise(0))
        out.append(F.coalesce(changed, F.lit(0).cast("long")).alias(count_col))
    return moved.select(*out)
