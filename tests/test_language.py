"""Parser, intervals, dates, numbers, globs."""

from datetime import UTC, datetime

import pytest
from hypothesis import given
from hypothesis import strategies as st

from seriesloom.functions.dates import epoch
from seriesloom.functions.parser import ParseError, number_text, parse, seconds
from seriesloom.sources.store import glob_regex, literal_prefix

NOW = datetime(1994, 8, 16, 15, 30, tzinfo=UTC)


def test_calls_and_arguments():
    e = parse("alias(sumSeries(scale(a.*.b,10)),'x y')")
    assert (e.target, e.args[1].text, e.raw) == ("alias", "x y", "sumSeries(scale(a.*.b,10)),'x y'")
    assert e.args[0].args[0].args[0].target == "a.*.b"


def test_pipes_become_first_arguments():
    e = parse("a.b | scale(2) | alias('c')")
    assert str(e) == "alias(scale(a.b,2),'c')"


def test_named_arguments():
    e = parse("summarize(a, '1h', func='max', alignToFrom=true)")
    assert e.named["func"].text == "max" and e.boolean(3, name="alignToFrom")


@pytest.mark.parametrize("text", ["", "f(", "f(a", "f(a,)", "a)", "f(a b", "'x", "a.{b", "f(a)|b"])
def test_bad_targets(text):
    with pytest.raises(ParseError):
        parse(text)


def test_names_with_braces_and_numbers():
    assert parse("a.{b,c}.1d*").target == "a.{b,c}.1d*"
    assert parse("-1.5e3").value == -1500


@pytest.mark.parametrize(("text", "sign", "want"), [("1h", 1, 3600), ("1h", -1, -3600), ("+2d", -1, 172800), ("1h30min", 1, 5400), ("1mon", 1, 2592000), ("-1y", 1, -31536000)])
def test_intervals(text, sign, want):
    assert seconds(text, sign) == want


@pytest.mark.parametrize("text", ["", "1", "h", "1xx", "1h-"])
def test_bad_intervals(text):
    with pytest.raises(ParseError):
        seconds(text, 1)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("now", "1994-08-16 15:30"), ("midnight", "1994-08-16 00:00"), ("noon yesterday", "1994-08-15 12:00"), ("teatime_tomorrow", "1994-08-17 16:00"),
        ("-1d", "1994-08-15 15:30"), ("19940812", "1994-08-12 00:00"), ("06/12/94", "1994-06-12 00:00"), ("3:05pm today", "1994-08-16 15:05"), ("today", "1994-08-16 00:00"),
    ],
)
def test_dates(text, want):
    assert epoch(text, NOW) == int(datetime.strptime(want, "%Y-%m-%d %H:%M").replace(tzinfo=UTC).timestamp())


def test_bad_date():
    with pytest.raises(ParseError):
        epoch("+5m", NOW)


def test_number_text():
    assert [number_text(x) for x in (2.5, 10, 1000000, 0.00001, -3, 123456, 1.5e-7)] == ["2.5", "10", "1e+06", "1e-05", "-3", "123456", "1.5e-07"]


@given(st.floats(allow_nan=False, allow_infinity=False).filter(lambda x: x != 0))
def test_number_text_round_trip(x):
    assert float(number_text(x)) == x


def test_globs():
    import re

    assert re.match(glob_regex("a.*.{b,c}?"), "a.xx.cd") and not re.match(glob_regex("a.*"), "a.b.c")
    assert literal_prefix("a.b*.c") == "a.b"
