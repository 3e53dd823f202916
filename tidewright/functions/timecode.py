"""One-minute frames of a phase-modulated time code as column expressions: 60 characters of 0 and 1, in the order sent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the code: the sync word, the bits of the minute counter that each parity bit sums, and the codes of daylight saving (0 off, 2 starts today, 3 on, 1 ends today) with the leap second (0 none, 2 negative, 3 positive).
SYNC = "0011101101000"
PARITY_TAPS = (
    (23, 21, 20, 17, 16, 15, 14, 13, 9, 8, 6, 5, 4, 2, 0),
    (24, 22, 21, 18, 17, 16, 15, 14, 10, 9, 7, 6, 5, 3, 1),
    (25, 23, 22, 19, 18, 17, 16, 15, 11, 10, 8, 7, 6, 4, 2),
    (24, 21, 19, 18, 15, 14, 13, 12, 11, 7, 6, 4, 3, 2, 0),
    (25, 22, 20, 19, 16, 15, 14, 13, 12, 8, 7, 5, 4, 3, 1),
)
SAVING = {
    "01000": (0, 0), "10110": (2, 0), "00011": (3, 0), "10101": (1, 0), "00100": (0, 2), "10001": (2, 2),
    "01110": (3, 2), "01100": (1, 2), "11001": (0, 3), "11010": (2, 3), "11111": (3, 3), "11100": (1, 3),
}
#: Seconds of 2000-01-01 since 1970: the counter's minute 0.
EPOCH_S = 946_684_800
MINUTES = 1 << 26


def parity(word: Column) -> Column:
    """The five parity bits of a 26-bit word as a number, the last one highest."""
    bits = [F.shiftleft((F.bit_count(word.bitwiseAND(F.lit(sum(1 << t for t in taps)).cast("long"))) % 2).cast("long"), i) for i, taps in enumerate(PARITY_TAPS)]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]).bitwiseOR(bits[3]).bitwiseOR(bits[4])


def corrected(word: Column, received: Column) -> tuple[Column, Column]:
    """The word with its one wrong bit mended, and how many errors were found (0 or 1).

    The parity bits that fail name the bit, as every one of the 31 has a pattern of its
    own; so two errors always look like one elsewhere.
    """
    flips = [0] * 32
    for i in range(26):
        flips[sum(1 << p for p, taps in enumerate(PARITY_TAPS) if i in taps)] = 1 << i
    syndrome = parity(word).bitwiseXOR(received)
    flip = F.element_at(F.array(*[F.lit(x).cast("long") for x in flips]), (syndrome + 1).cast("int"))
    return word.bitwiseXOR(flip), F.when(syndrome == 0, 0).otherwise(1)


def _let(value: Column, told: Callable[[Column], Column]) -> Column:
    """``told`` of a value that is worked out once, however often it is named there."""
    return F.transform(F.array(value), told)[0]


def _bits(number: Column, end: int, n: int) -> Column:
    """``n`` bits of a number, as many as ``end`` after them."""
    return F.shiftright(number, end).bitwiseAND(F.lit((1 << n) - 1).cast("long"))


def _joined(*parts: tuple[Column, int]) -> Column:
    """Numbers of no bits in common, each moved up, as one."""
    total = F.lit(0).cast("long")
    for number, up in parts:
        total = total.bitwiseOR(F.shiftleft(number, up))
    return total


def time_frame(bits: Column) -> Column:
    """What a frame says: minute (its start), saving, leap, next_code, notice, sync_errors, parity_errors, lsb_differs; null for what is no frame.

    saving and leap are null for a code that there is not. A second copy of the
    counter's lowest bit tells some of the double errors that the parity cannot.
    """
    codes: list[tuple[int | None, int | None]] = [(None, None)] * 32
    for c, v in SAVING.items():
        codes[int(c, 2)] = v

    def read(frame: Column) -> Column:
        """Of the frame as a number of 60 bits."""
        part = lambda start, n: _bits(frame, 60 - start - n, n)
        sent = F.struct(_joined((part(18, 1), 25), (part(20, 9), 16), (part(30, 9), 7), (part(40, 7), 0)).alias("word"), part(13, 5).alias("parity"))
        mended = lambda s: F.struct(*(c.alias(n) for c, n in zip(corrected(s["word"], s["parity"]), ("word", "errors"))))
        code = (_joined((part(47, 2), 3), (part(50, 3), 0)) + 1).cast("int")
        table = lambda at: F.element_at(F.array(*[F.lit(v[at]).cast("int") for v in codes]), code)
        told = lambda m: F.struct(
            F.timestamp_seconds(m["word"] * 60 + EPOCH_S).alias("minute"), table(0).alias("saving"), table(1).alias("leap"), part(53, 6).cast("int").alias("next_code"), part(49, 1).cast("int").alias("notice"),
            F.bit_count(part(0, 13).bitwiseXOR(F.lit(int(SYNC, 2)).cast("long"))).cast("int").alias("sync_errors"), m["errors"].alias("parity_errors"), (m["word"] % 2 != part(19, 1)).alias("lsb_differs"),
        )
        return _let(sent, lambda s: _let(mended(s), told))

    number = lambda b: F.conv(F.substring(b, 1, 60), 2, 10).cast("long")
    return _let(bits, lambda b: F.when(b.rlike("^[01]{60}$"), _let(number(b), read)))


def encoded_frame(seconds: Column, saving: Column | None = None, leap: Column | None = None, next_code: Column | None = None, notice: Column | None = None) -> Column:
    """The frame of the minute that a time in seconds since 1970 is in; null before 2000 and for saving and leap that have no code."""
    zero = F.lit(0)
    saving, leap, next_code, notice = (zero if c is None else c for c in (saving, leap, next_code, notice))
    minute = F.floor((seconds - EPOCH_S) / 60)
    word = F.pmod(minute, F.lit(MINUTES))
    counter = _joined((F.lit(int(SYNC, 2)).cast("long"), 34), (parity(word), 29), (_bits(word, 25, 1), 28), (_bits(word, 0, 1), 27), (_bits(word, 16, 9), 18), (_bits(word, 7, 9), 8), (_bits(word, 0, 7), 0))
    code = F.coalesce(*[F.when((saving == s) & (leap == x), c) for c, (s, x) in SAVING.items()])
    frame = F.concat(
        F.lpad(F.bin(counter), 47, "0"), F.substring(code, 1, 2), notice.cast("string"), F.substring(code, 3, 3),
        F.lpad(F.conv(next_code.cast("string"), 10, 2), 6, "0"), F.lit("0"),
    )
    return F.when(minute >= 0, frame)
