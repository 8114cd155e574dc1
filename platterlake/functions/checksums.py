"""Digests of whole values, and descriptors of expected checksums."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Which digests each mode has; CRC-32 always.
MODES = {"Crc32": (), "Crc32Sha1": ("sha1",), "All": ("sha1", "md5")}
ALGORITHMS = {"Crc16": "CRC-16", "Crc32": "CRC-32", "Md5": "MD5", "Sha1": "SHA-1", "Sha256": "SHA-256", "Additive": "Additive"}


def has_sha1(mode: str) -> bool:
    return "sha1" in MODES[mode]


def has_md5(mode: str) -> bool:
    return "md5" in MODES[mode]


def crc32_hex(data: Column) -> Column:
    return F.lpad(F.lower(F.hex(F.crc32(data))), 8, "0")


def file_hashes(data: Column, mode: str = "All", declared_size: Column | None = None) -> Column:
    """Struct of the digests in lower-case hex (null where the mode leaves one out), size and warnings.

    With ``declared_size`` the struct also has the size that was expected, beside that of the bytes.
    """
    none = F.lit(None).cast("string")
    return F.struct(
        crc32_hex(data).alias("crc32"),
        (F.sha1(data) if has_sha1(mode) else none).alias("sha1"),
        (F.md5(data) if has_md5(mode) else none).alias("md5"),
        F.length(data).cast("bigint").alias("data_size"),
        F.array().cast("array<string>").alias("warnings"),
        *([] if declared_size is None else [declared_size.cast("bigint").alias("declared_size")]),
    )


def algorithm_name(algorithm: Column) -> Column:
    """Display name; a platform's own algorithm is its own name."""
    known = F.create_map(*(F.lit(x) for pair in ALGORITHMS.items() for x in pair))
    return F.coalesce(known[algorithm], algorithm)


def expected_checksum(algorithm: Column, value: Column, description: Column | None = None) -> Column:
    return F.struct(algorithm.alias("algorithm"), value.alias("value"), (F.lit(None).cast("string") if description is None else description).alias("description"))


def hex_value(expected: Column) -> Column:
    return F.lower(F.hex(expected["value"]))


def verify(expected: Column, data: Column) -> Column:
    """Error struct if the data do not have the expected checksum; null if they do or the algorithm is only a label."""
    from ..errors import error

    actual = (
        F.when(expected["algorithm"] == "Crc32", crc32_hex(data))
        .when(expected["algorithm"] == "Md5", F.md5(data))
        .when(expected["algorithm"] == "Sha1", F.sha1(data))
        .when(expected["algorithm"] == "Sha256", F.sha2(data, 256))
    )
    return F.when(actual != hex_value(expected), error("ChecksumMismatch", F.concat(F.lit("expected "), hex_value(expected), F.lit(", got "), actual)))
