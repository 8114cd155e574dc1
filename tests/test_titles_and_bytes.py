"""Titles, bytes, time codes, modes and digests on literal cases."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from platterlake import errors as E
from platterlake.functions import binary as B
from platterlake.functions import checksums as K
from platterlake.functions import names as N
from platterlake.functions import timecode as T
from platterlake.operators import hashing, titles


def apply(spark, f, values, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, a {kind}").select("i", f(F.col("a")).alias("r")).collect()
    return [r.r for r in sorted(rows)]


def test_strip_disc_tag(spark):
    cases = {
        "Final Fantasy VII (Disc 1) (USA)": "Final Fantasy VII (USA)",
        "Game (USA) (Disc 12)": "Game (USA)",
        "Crash Bandicoot (USA)": "Crash Bandicoot (USA)",
        "A (Disc X) (Disc 2)": "A (Disc X) (Disc 2)",
        "A (Disc 1) (Disc 2)": "A (Disc 2)",
        "Game(Disc 1)": "Game(Disc 1)",
        "Game (disc 1)": "Game (disc 1)",
        "Game (Disc )": "Game (Disc )",
        "Game (Disc 1": "Game (Disc 1",
        "": "",
        "é\n (Disc 3)x": "é\nx",
    }
    assert apply(spark, N.strip_disc_tag, cases) == list(cases.values())
    assert apply(spark, N.strip_disc_tag, [None]) == [None]


def test_disc_number(spark):
    cases = {"G (Disc 2) (USA).chd": 2, "Game(Disc 1)": 1, "G (Disc +7)": 7, "G (Disc  2)": None, "G (Disc x) (Disc 2)": None, "G (Disc 4294967295)": 4294967295, "G (Disc 4294967296)": None, "G (Disc 000000000000000000000007)": 7, "G (Disc -1)": None, "G": None, "G (Disc 5": None, "G (Disc 0)": 0}
    assert apply(spark, N.disc_number, cases) == list(cases.values())


def group(spark, names):
    rows = titles.disc_groups(spark.createDataFrame(list(enumerate(names)), "idx long, name string")).collect()
    return sorted((r.primary_index, r.base_name, list(r.member_indices)) for r in rows)


def test_groups(spark):
    ff = "Final Fantasy VII (USA)"
    assert group(spark, [f"{ff} (Disc {i})" for i in (1, 2, 3)] + ["Crash Bandicoot (USA)"]) == [(0, ff, [0, 1, 2])]
    assert group(spark, ["Some Game (Disc 1)", "Another Game (USA)"]) == []
    assert group(spark, ["Game (USA) (Disc 3)", "Game (USA) (Disc 1)", "Game (USA) (Disc 2)"]) == [(1, "Game (USA)", [1, 2, 0])]
    two = group(spark, ["A (Disc 1)", "A (Disc 2)", "B (Disc 2)", "B (Disc 1)", "C"])
    assert two == [(0, "A", [0, 1]), (3, "B", [3, 2])]
    assert group(spark, ["A (Disc 1)", "A (Disc 1)", "A (Disc 1)"]) == [(0, "A", [0, 1, 2])]
    assert group(spark, []) == []


def test_base_names(spark):
    sets = {
        "one": ["Game (Disc 2) (USA)"],
        "plain": ["Game (USA)"],
        "tagged": ["Game (USA) (Disc 1)", "Other"],
        "scenario": ["Resident Evil 2 (Japan) (Leon Hen)", "Resident Evil 2 (Japan) (Claire Hen)"],
        "letter": ["Game (USA) (A Disc)", "Game (USA) (B Disc)"],
        "none": ["abc", "xyz"],
        "accent": ["Pokémon é1", "Pokémon è2"],
    }
    rows = [(k, i, n) for k, names in sets.items() for i, n in enumerate(names)]
    got = {r.key: r.base_name for r in titles.base_names(spark.createDataFrame(rows, "key string, idx int, name string"), "key").collect()}
    assert got == {"one": "Game (USA)", "plain": "Game (USA)", "tagged": "Game (USA)", "scenario": "Resident Evil 2 (Japan)", "letter": "Game (USA)", "none": "", "accent": "Pokémon"}
    same = {r.key: r.base_name for r in titles.same_game(spark.createDataFrame([("a", "G (Disc 1)"), ("a", "G (Disc 2)"), ("b", "G (Disc 1)"), ("b", "H (Disc 1)")], "key string, name string"), "key").collect()}
    assert same == {"a": "G", "b": None}


def test_trim_to_paren_boundary(spark):
    cases = {"RE2 (JP) (": "RE2 (JP)", "RE2 (JP) (Cla": "RE2 (JP)", "RE2 (JP)": "RE2 (JP)", "RE2 (JP) 　": "RE2 (JP)", "RE2(x": "RE2(x", "": ""}
    assert apply(spark, N.trim_to_paren_boundary, cases) == list(cases.values())


def test_bytes(spark):
    assert apply(spark, B.read_ascii, [b"HELLO\0WORLD", b"\x01\x02ABC", b"", b"\0", b"\xffA\x7fB"], "binary") == ["HELLO", "ABC", "", "", "AB"]
    assert apply(spark, B.read_ascii_fixed, [b"HELLO\0\0\0", b"\xff\xffABC\xff\xff", b"  PADDED  ", b"A\0B"], "binary") == ["HELLO", "ABC", "PADDED", "A B"]
    assert apply(spark, B.read_padded, [b"ABC   ", b"\xff\xfe", b"ABC\0 ", "é ".encode()], "binary") == ["ABC", "", "ABC\0", "é"]
    assert apply(spark, lambda c: B.unsigned_le(c, 1, 4), [b"\x00\x80\xff\xa9\xc3", b"\x00\x01"], "binary") == [0xC3A9FF80, None]
    assert apply(spark, lambda c: B.unsigned_be(c, 0, 2), [b"\x01\x02"], "binary") == [258]


def test_sizes(spark):
    cases = {0: "0 bytes", 512: "512 bytes", 1024: "1 KB", 262144: "256 KB", 1048576: "1 MB", 1025: "1025 bytes", 1 << 30: "1024 MB", 1536: "1536 bytes"}
    assert apply(spark, B.format_bytes, cases, "long") == list(cases.values())
    cases = {0: "0 B", 512: "512 B", 1024: "1.0 KB", 1536: "1.5 KB", 1280: "1.2 KB", 1048575: "1024.0 KB", 1 << 30: "1.0 GB", 5 << 30: "5.0 GB"}
    assert apply(spark, B.format_bytes_approx, cases, "long") == list(cases.values())


def test_time_codes(spark):
    assert apply(spark, T.msf_to_sectors, ["54:04:52", "01:32:21", "00:00:00", "1:2", "a:0:0", "1:2:3:4", "+1:00:00", "99999:59:74"]) == [243352, 6921, 0, None, None, None, 4500, 449999999]
    assert apply(spark, T.sectors_to_msf, [243352, 6921, 0, 4500 * 100], "long") == ["54:04:52", "01:32:21", "00:00:00", "100:00:00"]
    assert apply(spark, T.trailing_msf, [" 01:32:21 // x", "01:32:21", "", "// 00:00:01", "x", "01:32"]) == ["01:32:21", "01:32:21", None, None, None, None]


def test_modes(spark):
    modes = ["AUDIO", "audio", "MODE1/2352", "mode2_raw", "CDG", "MODE3", "MODE2"]
    assert apply(spark, T.classify_mode, modes) == ["Audio", "Audio", "Data", "Data", "Unknown", "Unknown", "Data"]
    assert apply(spark, T.standard_mode, ["MODE2_RAW", "mode1_raw", "MODE2_FORM1", "MODE2_FORM2", "MODE2_FORM_MIX", "MODE1", "AUDIO"]) == ["MODE2/2352", "MODE1/2352", "MODE2/2048", "MODE2/2324", "MODE2/2336", None, None]
    assert apply(spark, T.sector_size, ["MODE1/2048", "MODE2_FORM2", "MODE2", "MODE1", "AUDIO", "x"]) == [2048, 2324, 2336, 2352, 2352, 2352]


def test_digests(spark):
    assert apply(spark, K.crc32_hex, [b"123456789", b""], "binary") == ["cbf43926", "00000000"]
    for mode in K.MODES:
        r = apply(spark, lambda c, m=mode: K.file_hashes(c, m), [b"abc"], "binary")[0]
        assert (r.crc32, r.data_size, r.warnings) == ("352441c2", 3, [])
        assert r.sha1 == (hashlib.sha1(b"abc").hexdigest() if K.has_sha1(mode) else None)
        assert r.md5 == (hashlib.md5(b"abc").hexdigest() if K.has_md5(mode) else None)
    wrong = apply(spark, lambda c: K.verify(K.expected_checksum(F.lit("Crc32"), F.unhex(F.lit("cbf43926"))), c), [b"123456789", b"x"], "binary")
    assert wrong[0] is None and wrong[1].kind == "ChecksumMismatch"
    assert apply(spark, K.algorithm_name, ["Crc16", "Sha256", "Additive", "N64"]) == ["CRC-16", "SHA-256", "Additive", "N64"]


def test_crc32_of_documents(spark, tmp_path):
    import __spark_entry__

    texts = [(i, None if i == 7 else f"text {i} é日 " * (i * i % 91), "ab"[i % 2]) for i in range(333)]
    spark.createDataFrame(texts, "doc_id long, text string, source string").repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    known = __spark_entry__.queries()
    one = {r.doc_id: (r.crc32, r.data_size) for r in known["documents_crc32"](spark, str(tmp_path)).collect()}
    raw = {i: t.encode() for i, t, _ in texts if t is not None}
    assert one == {i: (f"{zlib.crc32(x):08x}", len(x)) for i, x in raw.items()} | {7: (None, None)}
    whole = {s: b"".join((t or "").encode() for _, t, x in texts if x == s) for s in "ab"}
    got = {r.path: (r.crc32, r.data_size) for r in known["chunked_documents_crc32"](spark, str(tmp_path)).collect()}
    assert got == {s: (f"{zlib.crc32(x):08x}", len(x)) for s, x in whole.items()}


def test_chunked_digests(spark):
    data = [bytes([i % 251]) * (i * 7 % 50) for i in range(60)]
    rows = spark.createDataFrame([("p", i, d) for i, d in enumerate(data)] + [("q", 0, b""), ("r", 0, None)], "path string, seq int, data binary").repartition(5)
    whole = b"".join(data)
    for mode in K.MODES:
        got = {r.path: r for r in hashing.chunked_hashes(rows, mode).collect()}
        assert got["p"].crc32 == f"{zlib.crc32(whole):08x}" and got["p"].data_size == len(whole)
        assert got["p"].sha1 == (hashlib.sha1(whole).hexdigest() if K.has_sha1(mode) else None)
        assert got["p"].md5 == (hashlib.md5(whole).hexdigest() if K.has_md5(mode) else None)
        assert got["q"].crc32 == got["r"].crc32 == "00000000"


def test_errors(spark):
    rows = spark.range(1).select(E.too_small(12, F.lit(3)).alias("e"), E.no_error().alias("n"), E.other("gone").alias("o"))
    r = rows.select("*", E.display(F.col("e")).alias("t"), E.display(F.col("n")).alias("none"), E.fail_fast(F.lit(1), F.col("n")).alias("v")).first()
    assert r.e.kind == "TooSmall" and r.n is None and r.o.message == "gone" and r.none is None and r.v == 1
    assert r.t == "Data too small: expected at least 12 bytes, got 3"
    with pytest.raises(Exception, match="gone"):
        rows.select(E.fail_fast(F.lit(1), F.col("o"))).collect()
    with pytest.raises(ValueError):
        E.error("Nope", "x")
