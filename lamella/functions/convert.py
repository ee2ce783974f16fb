"""Conversions between logical values and what Parquet stores for them. Native expressions; null stays null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_64 = "18446744073709551616"


def _floor_div(x: Column, n: int) -> Column:
    """Whole quotient rounded down; exact over all 64 bits, unlike a quotient of doubles."""
    return F.floor((x - F.pmod(x, F.lit(n).cast("long"))).cast("decimal(20,0)") / F.lit(n)).cast("long")


def local_micros(ts: Column) -> Column:
    """Microseconds of a wall clock time since 1970-01-01 00:00, whatever the session's time zone."""
    day = F.unix_date(ts.cast("date")).cast("long") * F.lit(86_400_000_000)
    clock = (F.hour(ts) * 3600 + F.minute(ts) * 60).cast("long") * F.lit(1_000_000)
    return day + clock + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def to_epoch(micros: Column, unit: str) -> Column:
    """Microseconds as a count of unit, rounded down also before 1970; nanoseconds fail beyond 64 bits."""
    if unit == "micros":
        return micros
    if unit == "millis":
        return _floor_div(micros, 1000)
    if unit == "nanos":
        return micros * F.lit(1000).cast("long")
    raise ValueError(f"no unit {unit!r}")


def instant_to_epoch(ts: Column, unit: str) -> Column:
    return to_epoch(F.unix_micros(ts), unit)


def local_to_epoch(ts: Column, unit: str) -> Column:
    return to_epoch(local_micros(ts), unit)


def _micros_of(n: Column, unit: str) -> Column:
    if unit == "millis":
        return n * F.lit(1000).cast("long")
    if unit == "micros":
        return n
    if unit == "nanos":  # towards zero
        return F.when(n < 0, -_floor_div(-n, 1000)).otherwise(_floor_div(n, 1000))
    raise ValueError(f"no unit {unit!r}")


def epoch_to_instant(n: Column, unit: str) -> Column:
    """A timestamp of a count of unit; nanoseconds lose what is below a microsecond, towards zero."""
    return F.timestamp_micros(_micros_of(n, unit))


def epoch_to_local(n: Column, unit: str) -> Column:
    """A wall clock time of a count of unit; no time zone takes part."""
    return F.timestamp_add("MICROSECOND", _micros_of(n, unit), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def date_to_days(d: Column) -> Column:
    return F.unix_date(d)


def days_to_date(n: Column) -> Column:
    return F.date_from_unix_date(n)


def time_of_day(micros: Column, unit: str) -> Column:
    """Microseconds since midnight as a count of unit; fails outside a day."""
    inside = (micros >= 0) & (micros < 86_400_000_000)
    return F.when(micros.isNull(), None).when(inside, to_epoch(micros, unit)).otherwise(F.raise_error(F.lit("a time of day lies outside the day")).cast("long"))


def exact_decimal(x: Column, precision: int, scale: int) -> Column:
    """x as a decimal; fails where digits would be lost rather than round."""
    target = f"decimal({precision},{scale})"
    cast = x.try_cast(target)
    return F.when(x.isNull(), F.lit(None).cast(target)).when(cast.isNotNull() & (cast == x), cast).otherwise(F.raise_error(F.concat(x.cast("string"), F.lit(f" is no {target}"))).cast(target))


def is_exact_decimal(x: Column, precision: int, scale: int) -> Column:
    cast = x.try_cast(f"decimal({precision},{scale})")
    return F.coalesce(cast == x, F.lit(False))


def decimal_to_bytes(x: Column, scale: int, length: int = 16) -> Column:
    """Big-endian two's complement of the unscaled number, in length bytes (16 at most)."""
    whole = F.replace(x.cast(f"decimal(38,{scale})").cast("string"), F.lit("."), F.lit("")).cast("decimal(38,0)")
    high = F.floor(whole / F.lit(TWO_64).cast("decimal(20,0)")).cast("decimal(38,0)")
    # the quotient of decimals is rounded: put right what it got wrong by one
    high = F.when(high * F.lit(TWO_64).cast("decimal(20,0)") > whole, high - 1).otherwise(high)
    low = (whole - high * F.lit(TWO_64).cast("decimal(20,0)")).cast("decimal(20,0)")
    signed = F.when(low >= F.lit("9223372036854775808").cast("decimal(20,0)"), low - F.lit(TWO_64).cast("decimal(20,0)")).otherwise(low)
    digits = F.concat(F.lpad(F.hex(high.cast("long")), 16, "0"), F.lpad(F.hex(signed.cast("long")), 16, "0"))
    return F.unhex(F.substring(digits, 33 - 2 * length, 2 * length))


def bytes_to_decimal(b: Column, precision: int, scale: int) -> Column:
    """The number whose unscaled value the bytes are, big-endian in two's complement; 16 bytes at most."""
    digits = F.hex(b)
    filled = F.when(F.substring(digits, 1, 1).isin(*"89ABCDEF"), F.lpad(digits, 32, "F")).otherwise(F.lpad(digits, 32, "0"))
    high = F.conv(F.substring(filled, 1, 16), 16, -10).cast("decimal(20,0)")
    low = F.conv(F.substring(filled, 17, 16), 16, 10).cast("decimal(20,0)")
    whole = (high * F.lit(TWO_64).cast("decimal(20,0)")).cast("decimal(38,0)") + low
    digits = F.lpad(F.abs(whole).cast("string"), 39, "0")
    sign = F.when(whole < 0, "-").otherwise("")
    return F.concat(sign, F.substring(digits, 1, 39 - scale), F.lit("."), F.substring(digits, 40 - scale, scale)).cast(f"decimal({precision},{scale})")


def unsigned_32(x: Column) -> Column:
    """The number that the bits of a signed 32-bit integer mean without a sign."""
    return x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))


def unsigned_64(x: Column) -> Column:
    return F.when(x < 0, x.cast("decimal(20,0)") + F.lit(TWO_64).cast("decimal(20,0)")).otherwise(x.cast("decimal(20,0)")).cast("decimal(20,0)")


def utf8_to_text(b: Column) -> Column:
    """Text of UTF-8 bytes; fails on other bytes."""
    return F.validate_utf8(b.cast("string"))


def text_to_utf8(s: Column) -> Column:
    return F.encode(s, "UTF-8")


def bytes_to_uuid(b: Column) -> Column:
    """The usual form of 16 bytes, the first byte first; fails for other lengths."""
    form = F.regexp_replace(F.lower(F.hex(b)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.when(b.isNull(), None).when(F.octet_length(b) == 16, form).otherwise(F.raise_error(F.lit("a uuid has 16 bytes")).cast("string"))


def uuid_to_bytes(s: Column) -> Column:
    return F.unhex(F.replace(s, F.lit("-"), F.lit("")))


def _byte(b: Column, i: int) -> Column:
    return F.conv(F.hex(F.substring(b, i, 1)), 16, 10).cast("int")


def float16_to_float(b: Column) -> Column:
    """Of two bytes, the low one first."""
    bits = _byte(b, 2) * 256 + _byte(b, 1)
    sign = F.when(F.shiftright(bits, 15) == 1, -1.0).otherwise(1.0)
    exponent, fraction = F.shiftright(bits, 10).bitwiseAND(31), bits.bitwiseAND(1023)
    value = F.when(exponent == 0, fraction * F.lit(2.0**-24)).when(exponent < 31, (1 + fraction / 1024) * F.pow(F.lit(2.0), exponent - 15)).when(fraction == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return (sign * value).cast("float")


def _little(x: Column, n: int) -> Column:
    """The low n bytes of a whole number as hexadecimal digits, low bytes first."""
    return F.concat(*(F.lpad(F.hex(F.shiftright(x, 8 * k).bitwiseAND(F.lit(255))), 2, "0") for k in range(n)))


def interval_bytes(months: Column, days: Column, millis: Column) -> Column:
    """Twelve bytes, low bytes first; fails where a part has no place in 32 bits without a sign."""
    fits = F.lit(True)
    for x in (months, days, millis):
        fits = fits & (x >= 0) & (x < 1 << 32)
    packed = F.unhex(F.concat(*(_little(x.cast("long"), 4) for x in (months, days, millis))))
    return F.when(fits, packed).when(fits.isNotNull(), F.raise_error(F.lit("a part of an interval has no place in 32 bits")).cast("binary"))


def interval_parts(b: Column) -> Column:
    """months, days and milliseconds of twelve bytes, low bytes first."""
    part = lambda at: sum(_byte(b, at + k).cast("long") * (1 << 8 * k) for k in range(4))
    return F.when(b.isNotNull(), F.struct(part(1).alias("months"), part(5).alias("days"), part(9).alias("millis")))


def wide_interval(months: Column, days: Column, millis: Column) -> Column:
    """Parts of up to 63 bits as two intervals: low holds the low 32 bits of each part and high, which is null
    if they suffice, how often each holds 2^32. low alone is the interval wherever the format has it.
    """
    parts = [x.cast("long") for x in (months, days, millis)]
    low = interval_bytes(*(F.when(x < 0, x).otherwise(x.bitwiseAND(F.lit(0xFFFFFFFF))) for x in parts))
    beyond = [F.shiftright(x, 32) for x in parts]
    return F.struct(low.alias("low"), F.when(F.greatest(*beyond) > 0, interval_bytes(*beyond)).alias("high"))


def wide_interval_parts(x: Column) -> Column:
    """months, days and milliseconds of what wide_interval made."""
    low, high = interval_parts(x["low"]), interval_parts(x["high"])
    part = lambda name: (low[name] + F.coalesce(high[name], F.lit(0)) * (1 << 32)).alias(name)
    return F.when(x["low"].isNotNull(), F.struct(part("months"), part("days"), part("millis")))
