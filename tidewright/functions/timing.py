"""Column expressions for counters that wrap, time stamps and names of broadcasts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def signed_mod(value: Column, modulus: float) -> Column:
    """``value`` modulo ``modulus`` in [-modulus / 2, modulus / 2)."""
    half = modulus / 2 if isinstance(modulus, float) else modulus // 2
    return F.pmod(value + F.lit(half), F.lit(modulus)) - F.lit(half)


def counter_delta(later: Column, earlier: Column, bits: int = 32) -> Column:
    """Signed difference of two counters of so many bits that wrap."""
    return signed_mod(later.cast("long") - earlier.cast("long"), 1 << bits)


def sequence_distance(start: Column, end: Column, bits: int = 16) -> Column:
    """Steps from one wrapping sequence number to another; a step back is negative."""
    return counter_delta(end, start, bits)


def _whole(a: Column, n: Column) -> Column:
    """The floor of a / n in whole numbers; the quotient of what ``n`` divides is exact in doubles too."""
    return ((a - F.pmod(a, n)) / n).cast("long")


def unwrapped_near(counter: Column, anchor: Column, anchor_ns: Column, hint_ns: Column, rate: int, bits: int = 32) -> Column:
    """Nanoseconds of a wrapping sample counter, in the turn that lies nearest to the hint; whole numbers throughout."""
    nano, per_second = F.lit(1_000_000_000).cast("long"), F.lit(rate).cast("long")
    delta = counter_delta(counter, anchor, bits)
    apart = hint_ns.cast("long") - anchor_ns.cast("long")
    turns = F.round((apart / 1e9 * rate - delta) / (1 << bits)).cast("long")
    samples = delta + turns * F.lit(1 << bits)
    rest = F.pmod(samples, per_second)
    return anchor_ns.cast("long") + _whole(samples, per_second) * nano + _whole(rest * nano, per_second)


def parsed(text: Column) -> Column:
    """An ISO time stamp with Z, an offset or neither (then in the session's zone) as a timestamp; null where it is none."""
    return F.try_to_timestamp(text)


def minutes_since_2000(at: Column, wrap: int = 1 << 26) -> Column:
    """Whole minutes since 2000-01-01, modulo ``wrap``."""
    return F.pmod(F.floor((F.unix_timestamp(at) - 946_684_800) / 60), F.lit(wrap))


def minute_seconds(minute: Column, leap_minutes: list[str]) -> Column:
    """61 for minutes that end in a leap second, else 60."""
    return F.when(F.date_format(minute, "yyyy-MM-dd HH:mm").isin(*leap_minutes), 61).otherwise(60)


def leap_candidate(day: Column) -> Column:
    """Whether leap seconds can fall on the day: the last of June and of December."""
    return ((F.month(day) == 6) & (F.dayofmonth(day) == 30)) | ((F.month(day) == 12) & (F.dayofmonth(day) == 31))


def frequency_khz(frequency: Column) -> Column:
    """Whole kHz of a frequency in MHz (below 100) or kHz."""
    return F.rint(F.when(frequency < 100, frequency * 1000).otherwise(frequency)).cast("int")


def broadcast_key(station: Column, frequency_mhz: Column) -> Column:
    """STATION_f, the frequency with two decimals; the station alone where that is 0 or less."""
    return F.when(frequency_mhz <= 0, station).otherwise(F.concat_ws("_", station, F.format_string("%.2f", frequency_mhz)))


def channel_mhz(channel: Column) -> Column:
    """The number before "MHz" in a channel's name, or else the first number; a first number of 1000 or more is in kHz. Null without one."""
    name = F.replace(channel, F.lit("_"), F.lit(" "))
    mhz = F.regexp_extract(name, r"(?i)(\d+(?:\.\d+)?)\s*mhz", 1).try_cast("double")
    number = F.regexp_extract(name, r"(\d+(?:\.\d+)?)", 1).try_cast("double")
    return F.coalesce(mhz, F.when(number >= 1000, number / 1000).otherwise(number))


def unit_microseconds(text: Column) -> Column:
    """A number with ns, us, ms or s, and nothing else, as microseconds; null, not 0, where it is none."""
    pattern = r"^\s*([+-]?\d+\.?\d*(?:[eE][+-]?\d+)?)\s*(ns|us|ms|s)\s*$"
    value, unit = F.regexp_extract(text, pattern, 1).try_cast("double"), F.regexp_extract(text, pattern, 2)
    return value * F.when(unit == "ns", 0.001).when(unit == "us", 1.0).when(unit == "ms", 1e3).when(unit == "s", 1e6)
