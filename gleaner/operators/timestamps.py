"""Normalise written dates and instants to one unambiguous form.

Parsing stays in JVM expressions.  A wall-clock time without zone is placed by
an as-of join of the local time to exploded zone-offset intervals: an interval
holds the local seconds during which one offset was in force, so two matching
intervals mean an ambiguous time (clock set back), none a nonexistent one
(clock set forward), and exactly one gives the offset.

Defined results
---------------
* null, empty, blank or undated text: null (no reading);
* a day that does not exist, hour > 23, minute or second > 59: null;
* a zoneless time where the zone is null, unknown or empty: null;
* ``d/m/y`` without a date order: read only if one order is valid or both agree;
* digits finer than microseconds are cut, missing parts are zero;
* very long texts cannot match (the patterns are anchored) and give null.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Month names of the five languages, accents folded away.
MONTHS = {
    1: "january jan januar janner januari januarius enero ene janvier janv",
    2: "february feb febr februar februar februarius febrero fevrier fevr fev",
    3: "march mar marz marcius marc marzo mars",
    4: "april apr aprilis abril abr avril avr",
    5: "may majus maj mai mayo",
    6: "june jun junius juni junio juin",
    7: "july jul julius juli julio juillet juil",
    8: "august aug augusztus agosto ago aout",
    9: "september sep sept szeptember szept septiembre setiembre septembre",
    10: "october oct oktober okt octubre octobre",
    11: "november nov noviembre novembre",
    12: "december dec dezember dez diciembre dic decembre",
}
# Words that stand before a date.
LABELS = (
    "last updated|last modified|updated|modified|date|published|posted|created|released|datum|kelt|"
    "kozzeteve|frissitve|modositva|aktualisiert|stand|veroffentlicht|actualizado|fecha|publicado|"
    "mis a jour|publie|modifie|paru"
)
WEEKDAYS = (
    "mon(?:day)?|tue(?:s|sday)?|wed(?:nesday)?|thu(?:r|rs|rsday)?|fri(?:day)?|sat(?:urday)?|sun(?:day)?|"
    "montag|dienstag|mittwoch|donnerstag|freitag|samstag|sonntag|lundi|mardi|mercredi|jeudi|vendredi|samedi|dimanche|"
    "lunes|martes|miercoles|jueves|viernes|sabado|domingo"
)
# Zone abbreviations with one meaning here, in minutes east of UTC.
ZONES = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "west": 60, "cet": 60, "cest": 120, "mez": 60, "mesz": 120,
    "eet": 120, "eest": 180, "msk": 180, "jst": 540, "kst": 540,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420,
}
ACCENTED = "áàâäãåéèêëíìîïóòôöõőúùûüűñçýÿ０１２３４５６７８９"
PLAIN = "aaaaaaeeeeiiiioooooouuuuuncyy0123456789"

#: Years for which zone intervals are made; a local time outside has no interval.
YEARS = (1900, 2200)
_DAY_US = 86_400_000_000
_EPOCH = datetime(1970, 1, 1)


def _zone_rows(name: str) -> Iterator[tuple[str, int, int, int, int]]:
    """(zone, year, first local second, end local second, offset) of one zone, an interval once per year it touches."""
    from zoneinfo import ZoneInfo

    try:
        tz = ZoneInfo(name)
    except Exception:  # unknown or malformed names have no intervals
        return

    def offset(at: int) -> int:
        return int((datetime.fromtimestamp(0, timezone.utc) + timedelta(seconds=at)).astimezone(tz).utcoffset().total_seconds())

    week = 7 * 86_400
    begin = int((datetime(YEARS[0] - 1, 12, 1) - _EPOCH).total_seconds())
    end = int((datetime(YEARS[1] + 1, 1, 31) - _EPOCH).total_seconds())
    spans, at, now = [], begin, offset(begin)
    start = begin
    while at < end:
        then = offset(at + week)
        if then != now:
            lo, hi = at, at + week
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if offset(mid) == now else (lo, mid)
            spans.append((start, hi, now))
            start, now = hi, offset(hi)
            at = hi  # several changes may fall into one week
            continue
        at += week
    spans.append((start, end, now))
    for lo, hi, off in spans:
        first, last = lo + off, hi + off
        for year in range((_EPOCH + timedelta(seconds=first)).year, (_EPOCH + timedelta(seconds=last - 1)).year + 1):
            yield name, year, first, last, off


def zone_intervals(zones: DataFrame, zone_col: str = "zone") -> DataFrame:
    """Exploded offset intervals of the distinct zones in ``zones``, packed per (zone, year).

    The size is bounded by the IANA database: under 600 zone names, 300 years,
    about four intervals a year; unknown names yield no rows.
    """

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [r for name in pdf["zone"] for r in _zone_rows(name)]
            yield pd.DataFrame(rows, columns=["zone", "year", "lo", "hi", "off"])

    names = zones.select(F.col(zone_col).alias("zone")).where("zone is not null").distinct()
    rows = names.mapInPandas(make, "zone string, year int, lo long, hi long, off int")
    return rows.groupBy("zone", "year").agg(F.collect_set(F.struct("lo", "hi", "off")).alias("spans"))


def _int(c: Column) -> Column:
    return F.when(c.rlike(r"^\d{1,9}$"), c.cast("int"))


def _clean(c: Column) -> Column:
    c = F.regexp_replace(c, "[​‌‍‎‏⁠﻿]", "")
    c = F.regexp_replace(c, r"[\s   -   　]+", " ")
    c = F.translate(F.lower(F.trim(c)), ACCENTED, PLAIN)
    c = F.regexp_replace(c, rf"^(?:{LABELS})(?: (?:on|le|el|am|at|vom))?(?: ?: ?| )", "")
    return F.regexp_replace(c, rf"^(?:{WEEKDAYS})\.?,? (?=\d)", "")


# Each date form is rewritten by one replacement to "year-month-day-kind".
_FORMS = [
    (r"^(\d{4})([-/.])(\d{1,2})\2(\d{1,2})\.?$", "$1-$3-$4-y"),
    (r"^(\d{4})\. (\d{1,2})\. (\d{1,2})\.?$", "$1-$2-$3-y"),
    (r"^(\d{1,2})\. ?(\d{1,2})\. ?(\d{4}|\d{2})\.?$", "$3-$2-$1-y"),
    (r"^(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})$", "$3-$2-$1-s"),
    (r"^(\d{1,2})-(\d{1,2})-(\d{4})$", "$3-$2-$1-d"),
    (r"^(\d{1,2})(?:st|nd|rd|th|er|\.)?[ -](?:de |of )?([a-z]{3,10})\.?,?[ -](?:de |del )?(\d{4}|\d{2})$", "$3-$2-$1-m"),
    (r"^([a-z]{3,10})\.? (\d{1,2})(?:st|nd|rd|th)?,? (\d{4})$", "$3-$1-$2-m"),
    (r"^(\d{4})\.? ([a-z]{3,10})\.? (\d{1,2})\.?$", "$1-$2-$3-m"),
]
_ZONE = "|".join(sorted(ZONES, key=len, reverse=True))
_TIME = (
    r"^(.+?)(?:t|,? (?:at |a |um )?)(\d{1,2})[:h](\d{2})(?::(\d{2})(?:[.,](\d+))?)? ?(am|pm|a\.m\.|p\.m\.|uhr)?"
    rf" ?((?:utc|gmt)?[+-]\d{{2}}:?(?:\d{{2}})?|{_ZONE})?$"
)
_COMPACT = rf"^(\d{{4}})(\d{{2}})(\d{{2}})t(\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,](\d+))?)? ?([+-]\d{{2}}:?(?:\d{{2}})?|{_ZONE})?$"


def with_norm(df: DataFrame, text: str, zone: str, order: str, intervals: DataFrame, out: str = "norm", coarse: bool = False) -> DataFrame:
    """``df`` with ``out``: the one reading of ``text`` in normal form, or null.

    ``zone`` and ``order`` name columns with the row's IANA zone and its order
    of slash dates (``dmy``, ``mdy``); both may be null.  ``coarse`` also reads
    ``yyyy-MM`` and ``yyyy``.  ``intervals`` comes from :func:`zone_intervals`
    (its size is bounded there, so it is broadcast).  All other columns pass
    through; working columns carry a ``__`` prefix and are dropped.
    """
    months = F.create_map(*[F.lit(x) for m, names in MONTHS.items() for n in dict.fromkeys(names.split()) for x in (n, m)])
    offsets = F.create_map(*[F.lit(x) for pair in ZONES.items() for x in pair])
    d = df.withColumn("__s", _clean(F.col(text)))
    # time | date part; a compact ISO value is spread to the same shape first
    d = d.withColumn("__s", F.regexp_replace("__s", _COMPACT, "$1-$2-$3t$4:$5:$6.$7$8"))
    d = d.withColumn("__s", F.regexp_replace("__s", r":\.(?=[+\-z]|$)|\.(?=[+\-z])", ""))
    d = d.withColumn("__t", F.when(F.col("__s").rlike(r"\d[:h]\d\d"), F.split(F.regexp_replace("__s", _TIME, "$1|$2|$3|$4|$5|$6|$7"), r"\|")))
    timed = F.size("__t") == 7
    part = lambda i: F.get("__t", F.lit(i - 1))
    d = d.withColumn("__d", F.when(timed, F.regexp_replace(part(1), "[, ]+$", "")).when(F.col("__t").isNull(), F.col("__s")))
    form = F.lit(None).cast("string")
    for pattern, to in reversed(_FORMS):
        form = F.when(F.col("__d").rlike(pattern), F.regexp_replace("__d", pattern, to)).otherwise(form)
    d = d.withColumn("__f", F.split(form, "-"))
    f = lambda i: F.get("__f", F.lit(i - 1))
    year = F.when(F.length(f(1)) == 2, F.concat(F.lit("20"), f(1))).otherwise(f(1))
    mon = F.coalesce(_int(f(2)), months[f(2)])
    ymd = lambda m, day: F.concat_ws("-", year, F.lpad(m.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
    d = d.withColumns({"__y": year, "__m": mon, "__a": _int(f(3)), "__k": f(4)})
    year = F.col("__y")
    date = lambda m, day: F.when(F.col(m).isNotNull() & F.col(day).isNotNull() & (year != "0000"), F.expr("try_cast(__v as date)"))
    d = d.withColumn("__v", ymd(F.col("__m"), F.col("__a"))).withColumn("__dmy", date("__m", "__a"))
    d = d.withColumn("__v", F.when(F.col("__k").isin("s", "d"), ymd(F.col("__a"), F.col("__m")))).withColumn("__mdy", date("__m", "__a"))
    either = F.when(F.col("__mdy").isNull() | (F.col("__dmy") == F.col("__mdy")), F.col("__dmy")).when(F.col("__dmy").isNull(), F.col("__mdy"))
    day = (
        F.when((F.col("__k") == "s") & (F.col(order) == "dmy"), F.col("__dmy"))
        .when((F.col("__k") == "s") & (F.col(order) == "mdy"), F.col("__mdy"))
        .when(F.col("__k").isin("s", "d"), either)
        .otherwise(F.col("__dmy"))
    )
    half = F.substring(part(6), 1, 1)
    hour, minute, second = _int(part(2)), _int(part(3)), F.coalesce(_int(part(4)), F.lit(0))
    hour = F.when(~half.isin("a", "p"), hour).when(hour.between(0, 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
    micros = F.rpad(F.substring(part(5), 1, 6), 6, "0").cast("int")
    z = F.regexp_replace(part(7), "^(?:utc|gmt)(?=[+-])", "")
    sign = F.when(F.substring(z, 1, 1) == "-", -1).otherwise(1)
    zh, zm = _int(F.substring(z, 2, 2)), F.coalesce(_int(F.substring(F.regexp_replace(z, ":", ""), 4, 2)), F.lit(0))
    given = F.when(z.rlike("^[+-]"), F.when((zh <= 18) & (zm <= 59), sign * (zh * 60 + zm))).otherwise(offsets[z])
    d = d.withColumn("__day", day).withColumn("__hour", hour)
    hour = F.col("__hour")
    good = hour.between(0, 23) & minute.between(0, 59) & second.between(0, 59)
    d = d.withColumn("__sec", F.when(timed & good, F.unix_date("__day").cast("long") * 86400 + hour * 3600 + minute * 60 + second))
    d = d.withColumn("__zoned", F.when(timed, part(7) != "")).withColumn("__off", F.when(part(7) != "", given.cast("long") * 60))
    d = d.withColumn("__us", F.when(timed, F.coalesce(micros, F.lit(0))))
    d = d.withColumn("__zone", F.when(~F.col("__zoned") & F.col("__sec").isNotNull(), F.col(zone))).withColumn("__year", F.when(F.col("__zone").isNotNull(), F.year("__day")))
    spans = intervals.select(F.col("zone").alias("__zone"), F.col("year").alias("__year"), F.col("spans").alias("__spans"))
    d = d.join(F.broadcast(spans), ["__zone", "__year"], "left")
    hits = F.filter("__spans", lambda x: (x["lo"] <= F.col("__sec")) & (F.col("__sec") < x["hi"]))
    d = d.withColumn("__hits", F.when(F.col("__spans").isNotNull(), hits))
    offset = F.when(F.col("__zoned"), F.col("__off")).when(F.size("__hits") == 1, F.element_at("__hits", 1)["off"].cast("long"))
    number = F.col("__s").rlike(r"^(?:\d{10}|\d{13})$")
    at = F.when(number, F.rpad(F.when(number, F.col("__s")), 16, "0").cast("long")).otherwise((F.col("__sec") - offset) * 1_000_000 + F.col("__us"))
    d = d.withColumn("__at", at)
    rest = F.pmod("__at", F.lit(_DAY_US))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    days = F.date_from_unix_date(((F.col("__at") - rest) / _DAY_US).cast("int"))
    secs = F.floor(rest / 1_000_000)
    instant = F.concat(
        days.cast("string"), F.lit("T"), two(F.floor(secs / 3600)), F.lit(":"), two(F.floor(secs / 60) % 60), F.lit(":"), two(secs % 60),
        F.lit("."), F.lpad((rest % 1_000_000).cast("string"), 6, "0"), F.lit("Z"),
    )
    norm = F.when(F.col("__at").isNotNull(), instant).when(F.col("__t").isNull() & ~number, F.col("__day").cast("string"))
    if coarse:
        norm = F.coalesce(norm, F.when(F.col("__s").rlike(r"^(?!0000)\d{4}(?:-(?:0[1-9]|1[0-2]))?$"), F.col("__s")))
    d = d.withColumn("__norm", norm)
    return d.select(*[F.col(f"`{c}`") for c in df.columns if c != out], F.col("__norm").alias(out))


def site_clock(patterns: DataFrame) -> DataFrame:
    """(site, zone, date_order) of each domain; one row a domain, the latest kept if it is repeated."""
    memory = F.col("memory_snapshot")
    rows = patterns.where("domain is not null").groupBy("domain").agg(F.max_by("memory_snapshot", F.coalesce("updated_at", F.lit(0).cast("timestamp"))).alias("memory_snapshot"))
    return rows.select(F.col("domain").alias("__site"), memory["time_zone"].alias("__tz"), memory["date_order"].alias("__order"))


def read_stamps(df: DataFrame, text: str, patterns: DataFrame, out: str = "norm", coarse: bool = False) -> DataFrame:
    """``df`` (with a ``site`` column) and ``out``, read by the clock of each row's site.

    The join to the sites keeps every row, also those of unknown or null sites.
    """
    sites = site_clock(patterns)
    d = df.join(sites, F.col("site") == F.col("__site"), "left").drop("__site")
    return with_norm(d, text, "__tz", "__order", zone_intervals(sites, "__tz"), out, coarse).drop("__tz", "__order")


def found_stamps(candidates: DataFrame, sitemap: DataFrame, patterns: DataFrame) -> DataFrame:
    """Rows (kind, id, norm) of every value that has exactly one reading; repeated rows are given once."""
    one = read_stamps(candidates.select(F.col("cand_id").alias("id"), "site", "dated"), "dated", patterns)
    two = read_stamps(sitemap.select(F.col("entry_id").alias("id"), "site", "lastmod"), "lastmod", patterns, coarse=True)
    both = one.select(F.lit("candidate").alias("kind"), "id", "norm").unionByName(two.select(F.lit("sitemap").alias("kind"), "id", "norm"))
    return both.where("norm is not null").distinct()
