"""Numbers and times in binary columns, as SQL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Microseconds from 1601-01-01 to 1970-01-01, and the last microsecond of the year 9999.
EPOCH, LAST = 11_644_473_600_000_000, 253_402_300_799_999_999


def unsigned(blob: Column, offset: int, size: int) -> Column:
    """A little-endian unsigned number at a byte offset, as decimal(20,0); null beyond the end."""
    part = F.substring(blob, offset + 1, size)
    swapped = F.concat(*[F.substring(F.hex(part), 2 * k + 1, 2) for k in reversed(range(size))])
    return F.when(F.length(part) == size, F.conv(swapped, 16, 10).cast("decimal(20,0)"))


def filetime(ticks: Column) -> Column:
    """Time of a count of 100 ns since 1601, whole microseconds; null for none, less, or a year over 9999."""
    micros = F.floor(ticks.cast("decimal(20,0)") / 10).cast("decimal(20,0)")
    inside = (ticks > 0) & (micros - EPOCH <= LAST)
    return F.when(inside, F.timestamp_micros(F.when(inside, micros - EPOCH).cast("long")))


def iso(ts: Column) -> Column:
    """ISO 8601 with microseconds and offset."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")


def hex_first_int(text: Column) -> Column:
    """A number written in hexadecimal digits, with or without 0x, that has 64 bits at most; null for others. Decimal digits are hexadecimal ones, so no text is read as a decimal number."""
    clean = F.regexp_replace(F.trim(text), "^0[xX]", "")
    return F.when(clean.rlike("^[0-9A-Fa-f]{1,16}$"), F.conv(clean, 16, 10).cast("decimal(20,0)")).otherwise(F.expr("cast(null as decimal(20,0))"))


def little_endian(blob: Column) -> Column:
    """A binary value of one to eight bytes as an unsigned little-endian number; null for others."""
    swapped = F.reverse(F.transform(F.sequence(F.lit(0), F.length(blob) - 1), lambda k: F.substring(F.hex(blob), 2 * k + 1, F.lit(2))))
    return F.when(F.length(blob).between(1, 8), F.conv(F.array_join(swapped, ""), 16, 10).cast("decimal(20,0)"))


def utf16_text(blob: Column) -> Column:
    """UTF-16 text, little-endian, without zeros at its end; null for an empty one, hexadecimal digits where it is no such text (odd length, or half of a surrogate pair alone)."""
    digits = F.lower(F.hex(blob))
    # Of each unit h, l or x: the first or second half of a pair, or another.
    high = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(blob) / 2 - 1).cast("int")), lambda k: F.substring(digits, 4 * k + 3, F.lit(2)))
    kinds = F.array_join(F.transform(high, lambda x: F.when(x.between("d8", "db"), "h").when(x.between("dc", "df"), "l").otherwise("x")), "")
    good = (F.length(blob) % 2 == 0) & ~F.replace(kinds, F.lit("hl"), F.lit("")).rlike("[hl]")
    text = F.regexp_replace(F.decode(F.when(good, blob), "UTF-16LE"), "\\x00+$", "")
    return F.when(good, F.nullif(text, F.lit(""))).otherwise(digits)


def epoch_seconds(ticks: Column) -> Column:
    """Seconds since 1970 of a count of 100 ns since 1601, to whole microseconds; null for none."""
    return F.unix_micros(filetime(ticks)) / F.lit(1e6)


def lenient_time(text: Column) -> Column:
    """An ISO 8601 time, of UTC where it names no zone; null where it is none."""
    clean = F.trim(text)
    return F.when(clean.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.try_to_timestamp(clean))


def container(head: Column) -> Column:
    """Kind of a prefetch file by its first bytes."""
    at = lambda k, x: F.hex(F.substring(head, k, 4)) == x
    return F.when(at(1, "4D414D04"), "MAM").when(at(1, "4D414D03"), "MAM").when(at(1, "53434341") | at(5, "53434341"), "SCCA").otherwise("UNKNOWN")


def zero_filled(content: Column) -> Column:
    return F.hex(content).rlike("^0*$")


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC of a string column. The key shows in the plan: for tests and public keys only; see canonical.hmac_udf."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner = F.lit(bytes(b ^ 0x36 for b in block))
    outer = F.lit(bytes(b ^ 0x5C for b in block))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "utf-8")), 256))), 256)
