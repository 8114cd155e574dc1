"""Column functions over ``MM:SS:FF`` time codes (75 frames a second) and track modes."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import SECTOR_SIZES, STANDARD_MODES
from .names import trim_all, unsigned

_MAX_U32 = 4294967295
_MAX_PART = 10**15  # larger minutes would not fit a 64-bit number of frames


def to_sectors(minutes: Column, seconds: Column, frames: Column) -> Column:
    return (minutes.cast("bigint") * 60 + seconds) * 75 + frames


def msf_parts(text: Column, limit: int = _MAX_U32) -> list[Column]:
    """Minutes, seconds and frames; each null if it is too large, all if the text is not three numbers."""
    whole = r"\A([+]?[0-9]+):([+]?[0-9]+):([+]?[0-9]+)\z"
    return [unsigned(F.regexp_extract(text, whole, i), limit) for i in (1, 2, 3)]


def msf_to_sectors(text: Column, limit: int = _MAX_PART) -> Column:
    """Sectors of a time code, or null."""
    return to_sectors(*msf_parts(text, limit))


def sectors_to_msf(n: Column) -> Column:
    return F.format_string("%02d:%02d:%02d", F.floor(n / 4500), F.pmod(F.floor(n / 75), F.lit(60)), F.pmod(n, F.lit(75)))


def trailing_msf(rest: Column) -> Column:
    """The time code that is all of ``rest`` before ``//``, or null."""
    clean = trim_all(F.substring_index(rest, "//", 1))
    return F.when(msf_to_sectors(clean, _MAX_U32).isNotNull(), clean)


def classify_mode(mode: Column) -> Column:
    """Audio, Data or Unknown."""
    m = F.upper(mode)
    return F.when(m == "AUDIO", "Audio").when(m.startswith("MODE1") | m.startswith("MODE2"), "Data").otherwise("Unknown")


def _lookup(mode: Column, table: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[F.upper(mode)]


def standard_mode(mode: Column) -> Column:
    """Standard name of a mode of the extended dialect; null for any other."""
    return _lookup(mode, STANDARD_MODES)


def sector_size(mode: Column) -> Column:
    return F.coalesce(_lookup(mode, SECTOR_SIZES), F.lit(2352))
