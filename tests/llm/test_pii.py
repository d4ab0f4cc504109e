import datetime as dt
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.llm import pii as op

from .common import documents, empty, odd, row


def luhn(x):
    d = [int(c) for c in re.sub(r"\D", "", x)][::-1]
    return sum(sum(divmod(2 * v, 10)) if i % 2 else v for i, v in enumerate(d)) % 10 == 0


def run(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r.text, r.n) for r in op.pseudonymise(df, count_col="n").orderBy("doc_id").collect()]


def test_formats_stay_valid(spark):
    card, ssn, ip, iso, us, iban, phone = (
        x[0] for x in run(spark, ["4111 1111 1111 1111", "123-45-6789", "10.0.0.1", "2024-02-29", "12/31/1999", "GB29 NWBK 6016 1331 9268 19", "+1 (706) 555-3138"])
    )
    assert re.fullmatch(r"4\d{3}( \d{4}){3}", card) and luhn(card) and card != "4111 1111 1111 1111"
    assert re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", ssn) and ssn != "123-45-6789"
    assert all(0 <= int(p) <= 255 for p in ip.split(".")) and ip != "10.0.0.1"
    assert re.fullmatch(r"\d{4}-\d\d-\d\d", iso) and re.fullmatch(r"\d\d/\d\d/\d{4}", us)
    plain = iban.replace(" ", "")
    number = int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4]))
    assert plain.startswith("GB") and number % 97 == 1 and plain[4:8] == "NWBK" and re.fullmatch(r"GB\d\d NWBK \d{4} \d{4} \d{4} \d\d", iban)
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", phone)


IBANS = ["ES91 2100 0418 4502 0005 1332", "BE68539007547034", "PL61 1090 1014 0000 0712 1981 2874", "GB29 NWBK 6016 1331 9268 19"]


def test_account_numbers_before_other_words(spark):
    texts = [f"{a} {after}" for a in IBANS for after in ("EUR", "PAID", "2024", "GB29 NWBK 6016 1331 9268 19", "EUR 4111 1111 1111 1111")]
    for text, (out, n) in zip(texts, run(spark, texts), strict=True):
        own = next(a for a in IBANS if text.startswith(a))
        rest = text[len(own) :]
        assert n == (1 if len(rest) <= 5 else 2) and not any(x in out for x in [*IBANS, "4111 1111 1111 1111"])
        moved = out[: len(own)].replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in moved[4:] + moved[:4])) % 97 == 1
        assert len(rest) > 5 or out.endswith(rest)


def test_failed_account_numbers_are_searched(spark):
    texts = ["\x01 AB12 4111 1111 1111 1111", "AB12 3456 7890 GB29 NWBK 6016 1331 9268 19 \x01", "AB12" + "CDEF0123" * 4, "AB12 3456 7890 1111 2222 3333 4111 1111 1111 1111"]
    out = run(spark, texts)
    assert [n for _, n in out[:3]] == [1, 1, 1]
    assert out[0][0].startswith("\x01 AB12 4") and "4111 1111" not in out[0][0]
    assert out[1][0].startswith("AB12 3456 7890 GB") and "6016" not in out[1][0] and out[1][0].endswith(" \x01")
    assert out[2][0] != texts[2] and not any(c in "\x02\x03\x04\x05" for t, _ in out for c in t)


def test_equal_values_stay_linked_and_others_apart(spark):
    cards = []
    for k in range(200):
        body = f"4{k:014d}"
        cards.append(body + str(next(c for c in range(10) if luhn(body + str(c)))))
    out = [t for t, _ in run(spark, [f"a {c} b" for c in cards] + [f"{cards[0]}, {cards[0]}"])]
    assert len(set(out[:200])) == 200
    moved = out[0].split()[1]
    assert out[200] == f"{moved}, {moved}"


def test_a_permutation(spark):
    df = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    got = {r.p for r in df.select(op.permuted_digits(F.col("d"), F.lit("k"), F.lit("t")).alias("p")).collect()}
    assert len(got) == 1000 and all(re.fullmatch(r"\d{3}", x) for x in got)
    grid = spark.range(7 * 5).select(op.feistel(F.floor(F.col("id") / 5), F.col("id") % 5, F.lit(7).cast("long"), F.lit(5).cast("long"), F.lit("k"), F.lit("t")).alias("p"))
    assert {(r.p.a, r.p.b) for r in grid.collect()} == {(a, b) for a in range(7) for b in range(5)}


@pytest.mark.parametrize(
    "text",
    ["4111111111111112 is no card", "000-12-3456 and 900-11-2222", "300.1.1.1", "2023-02-29", "DE00370400440532013000", "version 4.0, 1999, 12345678", "", "no numbers at all", "a@b", "keitstlichschenverpf", "one two" * 50],
)
def test_clean_texts_stay(spark, text):
    assert run(spark, [text]) == [(text, 0)]


def test_own_documents(spark):
    docs = documents(spark)
    out = {r.doc_id: r for r in op.pseudonymise(docs, count_col="n").collect()}
    personal = (r"\S+@mail\d\.example\.com", r"\(\d{3}\)\S* [|] ?555-\d{4}|\(\d{3}\) 555-\d{4}", r"\b\d{1,3}(?:\.\d{1,3}){3}\b", r"\b[0-9A-Fa-f]{40}\b")
    found = 0
    for r in docs.collect():
        values = [m for p in personal for m in re.findall(p, r.text)] + [m for m in re.findall(r"\b\d{16}\b", r.text) if luhn(m)]
        found += bool(values)
        assert all(v not in out[r.doc_id].text for v in values)
        if not out[r.doc_id].n:
            assert out[r.doc_id].text == r.text
    assert found


def test_odd_rows_and_columns(spark):
    docs = odd(spark, [row(20, "mail x.y@z.example.org now \x01\x02 10.1.2.3 \x01")])
    out = op.pseudonymise(docs)
    assert out.columns == docs.columns and out.schema == docs.schema
    was, now = (sorted(((r.doc_id, r.text) for r in d.collect() if r.doc_id != 20), key=str) for d in (docs, out))
    assert was == now
    text = next(r.text for r in out.collect() if r.doc_id == 20)
    assert "z.example.org" not in text and "10.1.2.3" not in text and text.endswith(" \x01") and " now \x01\x02 " in text
    assert op.pseudonymise(empty(spark), count_col="n").count() == 0


def test_no_python_in_the_plan(spark):
    plan = op.pseudonymise(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def plain_feistel(a, b, mod_a, mod_b, tweak):
    for i in range(op.ROUNDS):
        low = mod_b if i % 2 else mod_a
        mixed = int(hashlib.sha256(f"{op.KEY}|{tweak}|{i}|{b}".encode()).hexdigest()[:15], 16)
        a, b = b, (a + mixed % low) % low
    return a, b


def plain_digits(d, tweak):
    left = len(d) // 2
    a, b = plain_feistel(int(d[:left]), int(d[left:]), 10**left, 10 ** (len(d) - left), f"{tweak}{len(d)}")
    return f"{a:0{left}d}{b:0{len(d) - left}d}"


def plain_name(size, *parts):
    return hashlib.sha256("|".join([op.KEY, *parts]).encode()).hexdigest()[:size]


def plain_card(x):
    body = x[0] + plain_digits(x[1:-1], "card")
    return body + next(str(c) for c in range(10) if luhn(body + str(c)))


def plain_ssn(x):
    area, group, serial = map(int, x.split("-"))
    a, b = plain_feistel((area - 1 - (area > 666)) * 99 + group - 1, serial - 1, 898 * 99, 9999, "ssn")
    areas = [n for n in range(1, 900) if n != 666]
    return f"{areas[a // 99]:03d}-{a % 99 + 1:02d}-{b + 1:04d}"


def plain_ip(x):
    n = [int(p) for p in x.split(".")]
    return ".".join(str(p) for half in plain_feistel(n[0] * 256 + n[1], n[2] * 256 + n[3], 65536, 65536, "ip") for p in divmod(half, 256))


def plain_date(x, form):
    first, days = dt.date(1800, 1, 1), (dt.date(2200, 1, 1) - dt.date(1800, 1, 1)).days
    n = (dt.datetime.strptime(x, form).date() - first).days
    while True:
        a, b = plain_feistel(n // 382, n % 382, 383, 382, "date")
        n = a * 382 + b
        if n < days:
            return (first + dt.timedelta(n)).strftime(form)


def plain_iban(x):
    own = plain_digits(x[4:], "iban")
    return f"DE{98 - int(own + '131400') % 97:02d}{own}"


def plain_phone(x):
    moved = iter(plain_digits(re.sub(r"\D", "", x)[-10:], "phone"))
    return x[:3] + re.sub(r"\d", lambda _: next(moved), x[3:])


def plain_email(x):
    name, _, host = x.lower().partition("@")
    return f"u{plain_name(12, 'email', name)}@d{plain_name(8, 'email', host)}.example"


def test_against_a_plain_version(spark):
    pick = random.Random(3)
    number = lambda n: "".join(str(pick.randrange(10)) for _ in range(n))
    day = lambda: dt.date(1900, 1, 1) + dt.timedelta(pick.randrange(60_000))
    pairs = []
    for _ in range(25):
        card = "4" + number(14)
        card += next(str(c) for c in range(10) if luhn(card + str(c)))
        pairs.append((card, plain_card(card)))
        ssn = f"{pick.choice([1, 123, 665, 667, 899]):03d}-{pick.randrange(1, 100):02d}-{pick.randrange(1, 10_000):04d}"
        pairs.append((ssn, plain_ssn(ssn)))
        ip = ".".join(str(pick.randrange(256)) for _ in range(4))
        pairs.append((ip, plain_ip(ip)))
        for form in ("%Y-%m-%d", "%d.%m.%Y", "%m/%d/%Y"):
            x = day().strftime(form)
            pairs.append((x, plain_date(x, form)))
        own = number(18)
        iban = f"DE{98 - int(own + '131400') % 97:02d}{own}"
        pairs.append((iban, plain_iban(iban)))
        phone = f"+1 ({pick.randrange(200, 999)}) {number(3)}-{number(4)}"
        pairs.append((phone, plain_phone(phone)))
        email = f"Name{number(3)}@host{number(2)}.example.org"
        pairs.append((email, plain_email(email)))
        secret = "".join(pick.choice("0123456789abcdef") for _ in range(38)) + "a1"
        pairs.append((secret, plain_name(40, "secret", secret)))
    got = run(spark, [f"so {x}, they said" for x, _ in pairs])
    for (x, want), (text, n) in zip(pairs, got, strict=True):
        assert (text, n) == (f"so {want}, they said", int(x != want)), x
