import datetime as dt

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import civil
from millrace.functions.civil import Calendar
from millrace.operators.aggregate import bucket_key

UTC = dt.UTC
NEW_YORK = Calendar("America/New_York")


def at(*x):
    return dt.datetime(*x, tzinfo=UTC)


def test_days_of_23_and_25_hours():
    assert civil.period(at(2024, 3, 10, 12), "day", NEW_YORK)[1:] == (at(2024, 3, 10, 5), at(2024, 3, 11, 4))
    assert civil.period(at(2024, 11, 3, 12), "day", NEW_YORK)[1:] == (at(2024, 11, 3, 4), at(2024, 11, 4, 5))


def test_skipped_and_repeated_boundaries():
    assert civil.boundary(dt.date(2024, 3, 10), "fiscalDay", Calendar("America/New_York", fiscal_start="02:30:00")) == at(2024, 3, 10, 7)
    assert civil.boundary(dt.date(2024, 11, 3), "fiscalDay", Calendar("America/New_York", fiscal_start="01:30:00")) == at(2024, 11, 3, 5, 30)


def test_week_labels():
    assert civil.label(dt.date(2024, 12, 30), "week") == "2025-W01"
    assert civil.label(dt.date(2020, 12, 28), "week") == "2020-W53"
    for day in range(0, 4000, 7):
        monday = dt.date(2015, 1, 5) + dt.timedelta(days=day)
        y, w, _ = monday.isocalendar()
        assert civil.label(monday, "week") == f"{y:04d}-W{w:02d}"


def test_relative_windows():
    assert civil.minus(at(2024, 3, 31, 10), 1, "month", Calendar()) == at(2024, 2, 29, 10)
    assert civil.relative("inCurrent", None, "week", at(2024, 1, 18), Calendar(week_start="sunday"))[:2] == (at(2024, 1, 14), at(2024, 1, 21))
    assert civil.relative("inPrevious", None, "month", at(2024, 3, 5), Calendar())[:2] == (at(2024, 2, 1), at(2024, 3, 1))
    low, high, closed = civil.relative("inLast", 1, "day", at(2024, 3, 11, 3, 30), NEW_YORK)
    assert (low, high, closed) == (at(2024, 3, 10, 4, 30), at(2024, 3, 11, 3, 30), True)


@given(st.datetimes(dt.datetime(1995, 1, 1), dt.datetime(2035, 1, 1)), st.sampled_from(civil.GRAINS), st.sampled_from(civil.DAYS), st.sampled_from(["00:00:00", "01:30:00", "02:30:00", "23:15:30"]), st.sampled_from(["UTC", "America/New_York", "+05:30", "Australia/Lord_Howe", "Pacific/Apia"]))
def test_every_instant_lies_in_its_period(when, grain, week, fiscal, zone):
    calendar = Calendar(zone, week, fiscal)
    when = when.replace(tzinfo=UTC)
    key, start, end = civil.period(when, grain, calendar)
    assert start <= when < end
    assert civil.period(end, grain, calendar)[1] == end or civil.period(end, grain, calendar)[1] <= end


@pytest.mark.parametrize("fiscal", ["00:00:00", "01:30:00", "02:30:00"])
def test_native_keys_agree(spark, fiscal):
    times = [at(2024, 3, 9) + dt.timedelta(minutes=15 * k) for k in range(260)] + [at(2024, 11, 2) + dt.timedelta(minutes=15 * k) for k in range(260)]
    df = spark.createDataFrame([(t,) for t in times], "t timestamp")
    for grain in civil.GRAINS:
        calendar = Calendar("America/New_York", "wednesday", fiscal)
        got = df.select("t", bucket_key(F.col("t"), grain, calendar).alias("k")).collect()
        assert [r.k for r in got] == [civil.period(r.t.replace(tzinfo=UTC), grain, calendar)[0] for r in got]
