"""Column functions over bytes: numbers, padded strings, sizes for people."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import rtrim_all


def slice_bytes(data: Column, at: int | Column, n: int | Column) -> Column:
    """``n`` bytes from place ``at`` (from 0); fewer where the data end."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.substr(data, (at + 1).cast("int"), (F.lit(n) if isinstance(n, int) else n).cast("int"))


def unsigned_le(data: Column, at: int, n: int) -> Column:
    """Little-endian unsigned number of ``n`` bytes (up to 7); null where the data end before it does."""
    pairs = F.hex(slice_bytes(data, at, n))
    backward = F.concat(*(F.substring(pairs, 2 * i + 1, 2) for i in reversed(range(n))))
    return F.when(F.length(data) >= at + n, F.conv(backward, 16, 10).cast("bigint"))


def unsigned_be(data: Column, at: int, n: int) -> Column:
    return F.when(F.length(data) >= at + n, F.conv(F.hex(slice_bytes(data, at, n)), 16, 10).cast("bigint"))


def _latin(data: Column) -> Column:
    return F.decode(data, "ISO-8859-1")


def read_ascii(data: Column) -> Column:
    """Printable ASCII before the first zero byte; other bytes are left out."""
    return F.regexp_replace(F.substring_index(_latin(data), "\0", 1), r"[^\x20-\x7E]", "")


def read_ascii_fixed(data: Column) -> Column:
    """The whole field with every other byte as a space, trimmed."""
    return F.trim(F.regexp_replace(_latin(data), r"[^\x20-\x7E]", " "))


def read_padded(data: Column) -> Column:
    """UTF-8 without trailing white space; empty if it is not UTF-8."""
    return rtrim_all(F.coalesce(F.try_validate_utf8(data.cast("string")), F.lit("")))


def format_bytes(n: Column) -> Column:
    """Exact size: whole MB or KB, else bytes."""
    mb, kb = F.lit(1 << 20), F.lit(1 << 10)
    whole = lambda unit: (n >= unit) & (F.pmod(n, unit) == 0)
    return (
        F.when(whole(mb), F.format_string("%d MB", (n / mb).cast("bigint")))
        .when(whole(kb), F.format_string("%d KB", (n / kb).cast("bigint")))
        .otherwise(F.format_string("%d bytes", n.cast("bigint")))
    )


def format_bytes_approx(n: Column) -> Column:
    """Size to one decimal, exact ties to even."""
    out = F.format_string("%d B", n.cast("bigint"))
    for power, unit in ((10, "KB"), (20, "MB"), (30, "GB")):
        out = F.when(n >= (1 << power), F.format_string(f"%.1f {unit}", F.bround(n / F.lit(float(1 << power)), 1))).otherwise(out)
    return out
