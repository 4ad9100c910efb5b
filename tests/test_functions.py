import unicodedata
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridlore.functions import text as tx
from gridlore.functions import time as tm
from tests.plain_places import fold_text

ALPHABET = "abcçdefgğhıijklmnoöprsştuüvyzABCÇDEFGĞHIİJKLMNOÖPRSŞTUÜVYZ âîû'-.0159ß"


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, key",
    [("Gönyeli", "gonyeli"), ("Gonyeli", "gonyeli"), ("GONYELI", "gonyeli"), ("İskele", "iskele"), ("ISKELE", "iskele"), ("Küçük  Kaymaklı!", "kucuk kaymakli"), ("", ""), ("g" + chr(0x306) + "ul", "gul"), ("Straße", "stra e")],
)
def test_fold_key(spark, text, key):
    assert one(spark, tx.fold_key(F.lit(text))) == key
    assert fold_text(text) == key


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(ALPHABET, max_size=20), min_size=1, max_size=40))
def test_fold_key_equals_plain_form(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.fold_key(F.col("t")).alias("k")).collect()
    for r in rows:
        low = r["t"].translate({0x130: "i", 0x49: "i", 0x131: "i"}).lower()
        plain = "".join(c for c in unicodedata.normalize("NFD", low) if not unicodedata.combining(c))
        assert r["k"] == " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in plain).split())
        assert r["k"] == fold_text(r["t"])


def test_turkish_case(spark):
    assert one(spark, tx.lower_tr(F.lit("İSKELE IŞIK"))) == "iskele ışık"
    assert one(spark, tx.upper_tr(F.lit("iskele ışık"))) == "İSKELE IŞIK"
    assert one(spark, tx.lower_tr(F.lit(None).cast("string"))) is None


def test_apostrophe_ends_at_ascii_edges(spark):
    assert one(spark, tx.strip_apostrophe_suffix(F.lit("Lefke'de kesinti"))) == "Lefke kesinti"
    assert one(spark, tx.strip_apostrophe_suffix(F.lit("Boğaz'nı"))) == "Boğazı"


def test_space_is_as_browsers_read_it(spark):
    assert one(spark, tx.collapse_space(F.lit(" a" + chr(0xA0) + chr(0x3000) + "\n b "))) == "a b"


def test_html(spark):
    html = "<div>A &amp; B<br>C</div><script>x()</script><p>&#199;&#x131; &ndash; &NBSP;d</p>"
    assert one(spark, tx.html_to_text(F.lit(html))) == "A & B\nC\nÇı – d"


def test_similarity(spark):
    assert one(spark, tx.similarity(F.lit("gonyeli"), F.lit("gonyelu"))) == pytest.approx(6 / 7)
    assert one(spark, tx.similarity(F.lit("a"), F.lit(""))) == 0
    assert one(spark, tx.similarity(F.lit(""), F.lit(""))) == 1


def test_escapes(spark):
    assert one(spark, tx.ics_escape(F.lit("a;b,c\\d\r\ne"))) == "a\\;b\\,c\\\\d\\ne"
    assert one(spark, tx.xml_escape(F.lit('<a b="&">'))) == "&lt;a b=&quot;&amp;&quot;&gt;"


def test_about_outages(spark):
    yes = ["Elektrik kesintisi olacak", "ELEKTRİK KESİNTİSİ", "arıza giderildi, elektrik verildi", "Enerji kesilecek"]
    no = ["kesintisiz enerji", "kesinlikle elektrik", "futbol", "kesinti"]
    assert [one(spark, tx.about(F.lit(t))) for t in yes] == [True] * 4
    assert [one(spark, tx.about(F.lit(t))) for t in no] == [False] * 4


def test_site_url(spark):
    assert one(spark, tx.site_url(F.lit("site.example/"), "https://d.example")) == "https://site.example"
    assert one(spark, tx.site_url(F.lit("not a url"), "https://d.example")) == "https://d.example"


def wall(text):
    return F.lit(text).cast("timestamp")


@pytest.mark.parametrize(
    "local, back",
    [
        ("2027-03-28 03:00:00", "2027-03-28 04:00:00"), ("2027-03-28 03:30:00", "2027-03-28 04:30:00"), ("2027-03-28 03:59:00", "2027-03-28 04:59:00"),
        ("2027-03-28 02:30:00", "2027-03-28 02:30:00"), ("2027-03-28 04:30:00", "2027-03-28 04:30:00"), ("2026-10-25 03:30:00", "2026-10-25 03:30:00"),
    ],
)
def test_wall_clock_and_back(spark, local, back):
    assert str(one(spark, tm.local(tm.to_utc(wall(local))))) == back


def test_repeated_hour_means_the_second(spark):
    assert one(spark, tm.to_utc(wall("2026-10-25 03:30:00"))) == datetime(2026, 10, 25, 1, 30)


def test_status_is_half_open(spark):
    at = lambda now: one(spark, tm.status(wall("2024-01-01 10:00:00"), wall("2024-01-01 12:00:00"), wall(now)))
    assert [at("2024-01-01 09:59:59"), at("2024-01-01 10:00:00"), at("2024-01-01 12:00:00")] == ["upcoming", "active", "past"]
    open_ = lambda now: one(spark, tm.status(wall("2024-01-01 10:00:00"), F.lit(None).cast("timestamp"), wall(now)))
    assert [open_("2024-01-04 09:59:59"), open_("2024-01-04 10:00:00")] == ["active", "past"]


@pytest.mark.parametrize("minutes, text", [(0, "0 min"), (59, "59 min"), (60, "1 h"), (61, "1 h 1 min"), (1440, "1 d"), (1505, "1 d 1 h"), (-5, "0 min"), (0.5, "1 min")])
def test_duration(spark, minutes, text):
    assert one(spark, tm.duration_text(F.lit(float(minutes)))) == text


def test_time_range(spark):
    start = wall("2026-08-29 09:29:00")
    assert one(spark, tm.time_range(start, wall("2026-08-29 13:45:00"), "tr", "?")) == "12:29 – 16:45"
    assert one(spark, tm.time_range(start, wall("2026-09-01 05:45:00"), "tr", "?")) == "12:29 – 1 Eyl 08:45"
    assert one(spark, tm.time_range(start, F.lit(None).cast("timestamp"), "tr", "?")) == "12:29 – ?"


def test_dates_and_clocks(spark):
    assert [one(spark, tm.valid_date(F.lit(d))) for d in ("2026-02-28", "2026-02-31", "2026-2-1", "x")] == [True, False, False, False]
    assert [one(spark, tm.valid_clock(F.lit(c))) for c in ("9:05", "23:59", "24:00", "12:60", "x")] == [True, True, False, False, False]
    assert one(spark, tm.valid_clock(F.lit(None).cast("string"))) is False


def test_schedule(spark):
    def schedule(**entry):
        entry = {"kind": "planned", "date": "2026-08-26", "weekday": None, "start": "09:00", "end": "13:00", "ongoing": False} | entry
        e = F.struct(*[F.lit(v).cast("boolean" if k == "ongoing" else "string").alias(k) for k, v in entry.items()])
        return one(spark, tm.schedule(e, wall("2026-08-26 05:00:00")))

    s = schedule()
    assert (s["starts_at"], s["ends_at"], s["inferred"]) == (datetime(2026, 8, 26, 6), datetime(2026, 8, 26, 10), False)
    assert schedule(end="01:00")["ends_at"] == datetime(2026, 8, 26, 22)  # before the start: the next day
    assert schedule(weekday="friday")["starts_at"] == datetime(2026, 8, 28, 6)
    assert schedule(weekday="wednesday")["starts_at"] == datetime(2026, 8, 26, 6)
    assert schedule(start=None) is None
    inferred = schedule(start=None, kind="fault", ongoing=True)
    assert (inferred["starts_at"], inferred["ends_at"], inferred["inferred"]) == (datetime(2026, 8, 26, 5), None, True)
    assert schedule(end=None)["ends_at"] is None


def test_restored_at(spark):
    at = lambda clock: one(spark, tm.restored_at(F.lit(clock).cast("string"), wall("2026-08-26 05:00:00")))
    assert at("07:30") == datetime(2026, 8, 26, 4, 30)
    assert at("23:00") == datetime(2026, 8, 25, 20)
    assert at("12:00") == datetime(2026, 8, 26, 5)  # neither day's noon is within twelve hours before
    assert at(None) == datetime(2026, 8, 26, 5)
