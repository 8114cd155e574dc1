"""Errors as data: a struct ``(kind, message)`` beside the value it replaces."""

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("Io", "InvalidFormat", "CorruptedHeader", "TooSmall", "UnsupportedVariant", "ChecksumMismatch", "ChannelDisconnected", "Other")
TYPE = "struct<kind:string,message:string>"


def error(kind: str, message: Column | str) -> Column:
    """An error struct; null if the message is null."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind of error: {kind}")
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(text.isNotNull(), F.struct(F.lit(kind).alias("kind"), text.alias("message")))


def no_error() -> Column:
    return F.lit(None).cast(TYPE)


def invalid_format(message: Column | str) -> Column:
    return error("InvalidFormat", message)


def corrupted_header(message: Column | str) -> Column:
    return error("CorruptedHeader", message)


def unsupported(message: Column | str) -> Column:
    return error("UnsupportedVariant", message)


def other(message: Column | str) -> Column:
    return error("Other", message)


def too_small(expected: int, actual: Column) -> Column:
    return error("TooSmall", F.format_string(f"expected at least {expected} bytes, got %d", actual))


def display(err: Column) -> Column:
    """One line for people."""
    before = F.create_map(
        *(F.lit(x) for pair in {"Io": "I/O error: ", "InvalidFormat": "Invalid format: ", "CorruptedHeader": "Corrupted header: ", "TooSmall": "Data too small: ", "UnsupportedVariant": "Unsupported variant: ", "ChecksumMismatch": "Checksum mismatch: ", "ChannelDisconnected": "Progress channel disconnected", "Other": ""}.items() for x in pair)
    )
    return F.when(err.isNotNull(), F.concat(before[err["kind"]], F.coalesce(err["message"], F.lit(""))))


def fail_fast(value: Column, err: Column) -> Column:
    """The value, or an exception that stops the job if there is an error."""
    return F.when(err.isNull(), value).otherwise(F.raise_error(display(err)))
