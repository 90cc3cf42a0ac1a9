"""NMEA and time-stamp functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sentences(buffer: Column, head: str = "GPGGA") -> Column:
    """All complete sentences of a text buffer (D1): from $HEAD to the checksum."""
    return F.regexp_extract_all(buffer, F.lit(rf"(\${head},[^$\r\n]*\*[0-9A-Fa-f]{{2}})"), F.lit(1))


def checksum(sentence: Column) -> Column:
    """XOR of the characters between $ and *."""
    body = F.regexp_extract(sentence, r"\$([^*]*)\*", 1)
    codes = F.transform(F.split(body, ""), F.ascii)
    return F.aggregate(codes, F.lit(0), lambda a, c: a.bitwiseXOR(c))


def valid(sentence: Column) -> Column:
    told = F.conv(F.regexp_extract(sentence, r"\*([0-9A-Fa-f]{2})", 1), 16, 10).cast("int")
    return F.coalesce(checksum(sentence) == told, F.lit(False))


def degrees(field: Column, side: Column) -> Column:
    """ddmm.mmmm and a hemisphere letter to signed degrees (D3)."""
    v = field.try_cast("double")
    deg = F.floor(v / 100)
    return (deg + (v - deg * 100) / 60) * F.when(side.isin("S", "W"), -1.0).otherwise(1.0)


def gga(sentence: Column) -> list[Column]:
    """Fields of a GGA sentence; the time of day is whole, and minutes-and-seconds is kept beside it (Q14)."""
    f = F.split(F.regexp_extract(sentence, r"\$([^*]*)\*", 1), ",")
    at = lambda i: F.get(f, F.lit(i))
    hms = at(1)
    number = lambda c: c.try_cast("double")
    minutes = number(F.substring(hms, 3, 2)) * 60 + number(F.substring(hms, 5, 12))
    return [
        at(0).alias("head"), (number(F.substring(hms, 1, 2)) * 3600 + minutes).alias("time_of_day"), minutes.alias("time_of_hour"),
        degrees(at(2), at(3)).alias("latitude"), degrees(at(4), at(5)).alias("longitude"), number(at(6)).cast("int").alias("quality"),
        number(at(7)).cast("int").alias("satellites"), number(at(8)).alias("hdop"), number(at(9)).alias("altitude"),
    ]


def ins(sentence: Column) -> list[Column]:
    """Fields of an inertial or heading sentence by position after the `;` (D5); what is not a number is null."""
    f = F.split(F.regexp_extract(sentence, r";([^*\r\n]*)", 1), ",")
    names = ["latitude", "longitude", "elevation", "separation", "north", "east", "up", "roll", "pitch", "yaw"]
    numbers = [F.get(f, F.lit(i + 2)).try_cast("double").alias(n) for i, n in enumerate(names)]
    return [F.get(f, F.lit(0)).alias("ins_status"), F.get(f, F.lit(1)).alias("pos_status"), *numbers]


def stamp_seconds(stamp: Column) -> Column:
    """A 16-digit microsecond string as a timestamp."""
    return F.timestamp_micros(stamp.cast("long"))


def stamp_text(micros: Column) -> Column:
    """Microseconds as a 16-digit string."""
    return F.lpad(micros.cast("long").cast("string"), 16, "0")


def calendar_seconds(text: Column, pattern: str = "yyyy-MM-dd HH:mm:ss.SSSSSS") -> Column:
    """Calendar text to epoch seconds in the session's zone."""
    return F.unix_micros(F.to_timestamp(text, pattern)) / 1e6


def device_seconds(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column, nano: Column) -> Column:
    """A device's UTC fields to epoch seconds, in whatever zone the session is (D9); null for a date that isn't one."""
    at = F.try_make_timestamp_ltz(year, month, day, hour, minute, second, F.lit("UTC"))
    return F.unix_micros(at) / 1e6 + nano * 1e-9


def aligned_clock(t: Column, gnss: Column, imu: Column, before: float = 0.008) -> Column:
    """t - gnss + imu, or t less a fixed delay before the first match."""
    return F.coalesce(t - gnss + imu, t - before)
