"""Column functions over titles with disc tags, such as ``Game (USA) (Disc 2)``."""

from pyspark.sql import Column
from pyspark.sql import functions as F

_MAX_U32 = 4294967295


def rtrim_all(c: Column) -> Column:
    """Without trailing white space of any script (``rtrim`` only knows spaces)."""
    return F.regexp_replace(c, r"(?U)\s+\z", "")


def trim_all(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def strip_disc_tag(name: Column) -> Column:
    """Without the first `` (Disc <digits>)``; unchanged if the first such opening is malformed."""
    at = F.instr(name, " (Disc ")
    tag = F.length(F.regexp_extract(F.substr(name, at), r"\A \(Disc [0-9]+\)", 0))
    return F.when((at > 0) & (tag > 0), F.concat(F.substr(name, F.lit(1), at - 1), F.substr(name, at + tag))).otherwise(name)


def unsigned(text: Column, limit: int) -> Column:
    """Whole number from 0 to ``limit`` (under 10**18) in decimal digits with an optional plus, else null."""
    number = F.regexp_extract(text, r"\A[+]?0*([0-9]{1,18})\z", 1).try_cast("bigint")
    return F.when(number <= limit, number)


def disc_number(name: Column) -> Column:
    """Number in the first ``(Disc ...)``, or null."""
    inside = F.regexp_extract(name, r"\(Disc ([^)]*)\)", 1)
    return unsigned(inside, _MAX_U32)


def trim_to_paren_boundary(name: Column) -> Column:
    """Without an unfinished group in brackets at the end."""
    clean = rtrim_all(name)
    balanced = F.length(F.regexp_replace(clean, r"[^(]", "")) == F.length(F.regexp_replace(clean, r"[^)]", ""))
    pieces = F.split(clean, r" \(", -1)
    cut = F.array_join(F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0))), " (")
    return F.when(balanced | (F.size(pieces) == 1), clean).otherwise(rtrim_all(cut))


def common_prefix(one: Column, two: Column) -> Column:
    """Longest common prefix in whole characters."""
    n = F.least(F.length(one), F.length(two))
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    differ = F.filter(places, lambda i: F.substr(one, i, F.lit(1)) != F.substr(two, i, F.lit(1)))
    return F.substr(one, F.lit(1), F.when(F.size(differ) > 0, F.get(differ, F.lit(0)) - 1).otherwise(n))
