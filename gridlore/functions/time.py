"""Instants (UTC) and wall clocks of the island as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridlore.constants import NO_END_ASSUMED_OVER, RESTORATION_LOOKBACK, ZONE

# Month and weekday names by language.
MONTHS = {
    "tr": "Ocak Şubat Mart Nisan Mayıs Haziran Temmuz Ağustos Eylül Ekim Kasım Aralık".split(),
    "en": "January February March April May June July August September October November December".split(),
}
WEEKDAYS = {
    "tr": "Pazartesi Salı Çarşamba Perşembe Cuma Cumartesi Pazar".split(),
    "en": "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split(),
}
_DAY_CODES = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def minutes(n) -> Column:
    return F.make_dt_interval(mins=F.lit(n) if isinstance(n, int) else n)


def local(instant: Column) -> Column:
    return F.from_utc_timestamp(instant, ZONE)


def once(value: Column, then) -> Column:
    """``then`` of a value that is computed once, however often ``then`` mentions it."""
    return F.transform(F.array(value), then)[0]


def to_utc(wall: Column) -> Column:
    """The instant of a wall clock: skipped hours move on, of repeated ones the second is meant."""
    return once(wall, _to_utc)


def _to_utc(wall: Column) -> Column:
    first = F.to_utc_timestamp(wall, ZONE)
    second = first + minutes(60)
    return F.when(local(second) == wall, second).otherwise(first)


def month_key(instant: Column) -> Column:
    return F.date_format(local(instant), "yyyy-MM")


def read_end(starts_at: Column, ends_at: Column) -> Column:
    """The end to read a record by: never stored."""
    return F.coalesce(ends_at, starts_at + minutes(NO_END_ASSUMED_OVER))


def status(starts_at: Column, ends_at: Column, now: Column) -> Column:
    return (
        F.when((starts_at <= now) & (read_end(starts_at, ends_at) > now), "active").when(starts_at > now, "upcoming").otherwise("past")
    )


def island_hour(instant: Column) -> Column:
    return F.hour(local(instant))


def day_difference(a: Column, b: Column) -> Column:
    return F.datediff(F.to_date(local(a)), F.to_date(local(b)))


def duration_text(minutes_: Column, day: str = "d", hour: str = "h", minute: str = "min") -> Column:
    """At most two units, none of them a trailing zero."""
    total = F.greatest(F.floor(minutes_ + 0.5), F.lit(0)).cast("long")
    d, h, m = F.floor(total / 1440), F.floor(total % 1440 / 60), total % 60
    two = lambda a, u, b, v: F.when(b > 0, F.concat_ws(" ", a.cast("string"), F.lit(u), b.cast("string"), F.lit(v))).otherwise(
        F.concat_ws(" ", a.cast("string"), F.lit(u))
    )
    return F.when(d > 0, two(d, day, h, hour)).when(h > 0, two(h, hour, m, minute)).otherwise(F.concat_ws(" ", m.cast("string"), F.lit(minute)))


def month_name(instant: Column, language: str) -> Column:
    return F.element_at(F.array(*map(F.lit, MONTHS[language])), F.month(local(instant)))


def weekday_name(instant: Column, language: str) -> Column:
    return F.element_at(F.array(*map(F.lit, WEEKDAYS[language])), F.weekday(local(instant)) + 1)


def clock(instant: Column) -> Column:
    return F.date_format(local(instant), "HH:mm")


def short_stamp(instant: Column, language: str) -> Column:
    day = F.dayofmonth(local(instant)).cast("string")
    return F.concat_ws(" ", day, F.substring(month_name(instant, language), 1, 3), clock(instant))


def long_date(instant: Column, language: str) -> Column:
    at = local(instant)
    return F.concat_ws(" ", F.dayofmonth(at).cast("string"), month_name(instant, language), F.year(at).cast("string"))


def time_range(starts_at: Column, ends_at: Column, language: str, unknown: str) -> Column:
    end = F.when(day_difference(ends_at, starts_at) == 0, clock(ends_at)).otherwise(short_stamp(ends_at, language))
    return F.concat(clock(starts_at), F.lit(" – "), F.when(ends_at.isNull(), F.lit(unknown)).otherwise(end))


def day_label(instant: Column, now: Column, language: str) -> Column:
    relative = {"tr": ("Bugün", "Yarın", "Dün"), "en": ("Today", "Tomorrow", "Yesterday")}[language]
    date = F.concat_ws(" ", F.dayofmonth(local(instant)).cast("string"), month_name(instant, language))
    away = day_difference(instant, now)
    name = F.when(away == 0, relative[0]).when(away == 1, relative[1]).when(away == -1, relative[2]).otherwise(weekday_name(instant, language))
    return F.concat_ws(", ", date, name)


def iso_utc(instant: Column, millis: bool = False) -> Column:
    return F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'" if millis else "yyyy-MM-dd'T'HH:mm:ss'Z'")


def ics_stamp(instant: Column) -> Column:
    return F.date_format(instant, "yyyyMMdd'T'HHmmss'Z'")


def valid_clock(text: Column) -> Column:
    return F.coalesce(text.rlike("^([01]?[0-9]|2[0-3]):[0-5][0-9]$"), F.lit(False))


def valid_date(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False)) & F.try_to_date(text, "yyyy-MM-dd").isNotNull()


def instant_of(date: Column, time: Column) -> Column:
    """The instant of a local date and clock, null where either is unusable."""
    wall = F.try_to_timestamp(F.concat_ws(" ", date, F.lpad(time, 5, "0")), F.lit("yyyy-MM-dd HH:mm"))
    return F.when(valid_date(date) & valid_clock(time), to_utc(wall))


def weekday_of(date: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, _DAY_CODES)), F.weekday(date) + 1)


def schedule_date(date: Column, weekday: Column, published_at: Column) -> Column:
    """The stated date; where the stated weekday disagrees, the first such day from publication on."""
    stated = F.try_to_date(date, "yyyy-MM-dd")
    onward = F.coalesce(*[F.when(weekday == d, F.next_day(F.date_sub(F.to_date(local(published_at)), 1), d[:3])) for d in _DAY_CODES])
    return F.date_format(F.when(weekday.isNotNull() & (weekday_of(stated) != weekday), onward).otherwise(stated), "yyyy-MM-dd")


def schedule(entry: Column, published_at: Column) -> Column:
    """(starts_at, ends_at, inferred) of an extracted entry; null where it has no usable time."""
    date = schedule_date(entry["date"], entry["weekday"], published_at)
    both = once(date, lambda d: F.struct(instant_of(d, entry["start"]).alias("s"), instant_of(d, entry["end"]).alias("e")))
    after = lambda s, e: F.when(e <= s, e + minutes(1440)).otherwise(e)
    whole = lambda b: F.struct(b["s"].alias("starts_at"), after(b["s"], b["e"]).alias("ends_at"), F.lit(False).alias("inferred"))
    stated = once(both, lambda b: F.when(b["s"].isNotNull(), whole(b)))
    ongoing = F.struct(published_at.alias("starts_at"), F.lit(None).cast("timestamp").alias("ends_at"), F.lit(True).alias("inferred"))
    none_stated = F.when(entry["ongoing"] & (entry["kind"] == "fault"), ongoing)
    return F.when(entry["start"].isNull(), none_stated).otherwise(stated)


def restored_at(restored: Column, published_at: Column) -> Column:
    """The stated clock of the publication's day or the day before, if at most 12 hours back."""
    day = F.to_date(local(published_at))
    back = [instant_of(F.date_format(F.date_sub(day, k), "yyyy-MM-dd"), restored) for k in (0, 1)]
    fits = lambda at: once(at, lambda t: F.when((t <= published_at) & (published_at <= t + minutes(RESTORATION_LOOKBACK)), t))
    return F.coalesce(*map(fits, back), published_at)
