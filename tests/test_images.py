"""Images made in memory: formats, sectors, volumes, files, audio, containers, data sources."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In

from platterlake import fixtures
from platterlake.constants import CD_SYNC, CHD_MAGIC
from platterlake.functions import checksums
from platterlake.operators import chd, hashing, images, layout, pcm
from platterlake.sources import chd as container
from platterlake.sources import flac
from platterlake.sources import images as sources


def record(lba, size, name, flags=0):
    body = bytes([0]) + struct.pack("<I", lba) + bytes(4) + struct.pack("<I", size) + bytes(11) + bytes([flags]) + bytes(6) + bytes([len(name)]) + name
    return bytes([len(body) + 1]) + body


def descriptor(system=b"PLAYSTATION", volume=b"TEST_VOLUME"):
    out = bytearray(2048)
    out[:6] = b"\x01CD001"
    out[8:40], out[40:72] = system.ljust(32), volume.ljust(32)
    out[80:84] = struct.pack("<I", 200)
    out[156:190] = record(18, 2048, b"\0")
    return bytes(out)


CONTENT = b"Hello, world!" * 200


def iso(files=((b"TEST.TXT;1", 19, len(CONTENT)),), system=b"PLAYSTATION"):
    root = b"".join([record(18, 2048, b"\0"), record(18, 2048, b"\1"), *(record(a, n, f) for f, a, n in files)]).ljust(2048, b"\0")
    return bytes(16 * 2048) + descriptor(system) + bytes(2048) + root + CONTENT.ljust(4096, b"\0")


def raw(plain, offset=24):
    return b"".join(CD_SYNC + bytes(offset - 12) + plain[i : i + 2048] + bytes(2352 - 2048 - offset) for i in range(0, len(plain), 2048))


def rows(spark, items):
    return spark.createDataFrame([(str(i), bytearray(c)) for i, c in enumerate(items)], "path string, content binary")


def test_formats(spark):
    cases = [iso(), raw(iso())[:4000], CHD_MAGIC + bytes(20), b'FILE "a" BINARY\n TRACK 01 AUDIO', b"\xde\xad\xbe\xef" + bytes(8), b"short", b"", b"x FILE y\x01 TRACK z", b"file a\x1a track b", b"REM " * 200 + b"FILE a\nTRACK b", bytes(40000)]
    fmt, err = images.detect_format(F.col("content"))
    got = rows(spark, cases).select("path", fmt.alias("f"), err.alias("e")).collect()
    got = [(r.f, r.e and r.e.kind) for r in sorted(got, key=lambda r: int(r.path))]
    bad = (None, "InvalidFormat")
    assert got == [("Iso2048", None), ("RawSector2352", None), ("Chd", None), ("Cue", None), bad, (None, "TooSmall"), (None, "TooSmall"), bad, ("Cue", None), bad, bad]
    names = spark.createDataFrame([("Iso2048",), ("Chd",)], "f string").select(images.format_name(F.col("f")), images.format_extension(F.col("f"))).collect()
    assert [tuple(r) for r in names] == [("ISO 9660", "iso"), ("CHD", "chd")]


def sectors(spark, *items):
    fmt, _ = images.detect_format(F.col("content"))
    return images.split_sectors(rows(spark, items).withColumn("format", fmt))


def test_volumes_and_files(spark):
    wrong = bytearray(iso())
    wrong[16 * 2048] = 2
    s = sectors(spark, iso(), raw(iso(system=b"SEGA SEGASATURN")), wrong, iso(files=((b"BIG.BIN;1", 19, 300 << 20), (b"far.bin", 500, 10), (b"empty", 0, 0), (b"empty;2", 19, 5))), iso()[: 10 * 2048])
    got = {r.path: r for r in images.volumes(s).collect()}
    assert tuple(got["0"].pvd) == ("PLAYSTATION", "TEST_VOLUME", 200, 18, 2048) and got["1"].pvd.system_identifier == "SEGA SEGASATURN"
    assert got["2"].pvd is None and got["2"].error.message == "Expected PVD type 0x01, got 0x02"
    names = {(r.path, r.file_identifier): (r.extent_lba, r.data_length) for r in images.directory(s).collect()}
    assert names["0", "TEST.TXT;1"] == (19, len(CONTENT)) and ("0", ".") in names and ("1", "..") in names
    wanted = spark.createDataFrame([("0", "test.txt"), ("1", "TEST.TXT"), ("0", "TEST.TXT;1"), ("0", "nope"), ("2", "test.txt"), ("3", "big.bin"), ("3", "FAR.BIN"), ("3", "EMPTY"), ("0", ".")], "path string, filename string")
    files = {(r.path, r.filename): (r.content and bytes(r.content), r.error and r.error.kind) for r in images.file_contents(s, images.find_files(s, wanted)).collect()}
    assert files["0", "test.txt"] == files["1", "TEST.TXT"] == (CONTENT, None)
    assert files["0", "TEST.TXT;1"][1] == files["0", "nope"][1] == "Other" and files["2", "test.txt"][1] == "InvalidFormat"
    assert files["3", "big.bin"][1] == files["3", "FAR.BIN"][1] == "CorruptedHeader"
    assert files["3", "EMPTY"][1] is None and not files["3", "EMPTY"][0]
    assert len(files["0", "."][0]) == 2048


def test_records(spark):
    cases = [record(5, 6, b"A.TXT;1", 2), record(1, 2, b"\0"), record(1, 2, b"\1"), record(1, 2, b"x")[:32], b"\x20" + bytes(40), b"\x22" + bytes(31) + b"\x09" + bytes(30), record(1, 2, b"\xff\xfe")]
    got = [r.r for r in sorted(rows(spark, cases).select("path", images.parse_record(F.col("content")).alias("r")).collect())]
    assert [r and r.file_identifier for r in got[:6]] == ["A.TXT;1", ".", "..", None, None, None] and got[6].file_identifier == "��"
    assert (got[0].extent_lba, got[0].data_length, got[0].file_flags) == (5, 6, 2)


def test_numbered_sectors(spark):
    data = rows(spark, [iso(), raw(iso(), 16), b"x"]).withColumn("f", F.element_at(F.array(F.lit("Iso2048"), F.lit("RawSector2352"), F.lit("Cue")), F.col("path").cast("int") + 1))
    for f, n in ((images.sector_data, 16), (images.sector_data_mode1, 16), (images.sector_data, 999)):
        value, err = f(F.col("content"), F.lit(n), F.col("f"))
        got = [(r.v and bytes(r.v)[:6], r.e and r.e.kind) for r in sorted(data.select("path", value.alias("v"), err.alias("e")).collect(), key=lambda r: r.path)]
        assert got[2] == (None, "UnsupportedVariant")
        assert got[0] == ((b"\x01CD001", None) if n == 16 else (None, "CorruptedHeader"))
        if f is images.sector_data_mode1:
            assert got[1] == (b"\x01CD001", None)


def test_audio(spark):
    one = bytes([0x34, 0x12, 0x78, 0x56, 0xFF, 0xFF, 0x00, 0x80]).ljust(2352, b"\0")
    two = bytes([0xEF, 0xBE, 0xAD, 0xDE]).ljust(2352, b"\0")
    s = spark.createDataFrame([("d", 0, bytearray(one)), ("d", 1, bytearray(one)), ("d", 2, bytearray(two))], "path string, sector long, raw binary")
    tracks = [("d", 1, 150, 2, "Audio"), ("d", 2, 152, 1, "Audio"), ("d", 3, 150, 1, "Data"), ("d", 4, 149, 2, "Audio"), ("d", 5, 151, 9, "Audio"), ("d", 6, 150, 0, "Audio"), ("d", 7, 150, 1, "Unknown")]
    lay = spark.createDataFrame([(*t, "m", None) for t in tracks], "path string, number long, absolute_offset long, length_sectors long, kind string, mode string, error struct<kind:string,message:string>")
    got = {}
    for r in pcm.track_samples(s, lay).collect():
        got.setdefault(r.number, {})[r.sector] = (r.samples, r.error and r.error.kind)
    assert got[1][150][0][:3] == [0x56781234, 0x8000FFFF, 0] and len(got[1][151][0]) == 588
    assert got[2] == {152: ([0xDEADBEEF, *[0] * 587], None)}
    assert got[3] == got[4] == got[7] == {None: (None, "InvalidFormat")} and 6 not in got
    assert {k: v[1] for k, v in got[5].items()} == {151: None, 152: None, 153: "Io"} and got[5][153][0] is None
    c = pcm.channels(pcm.track_samples(s, lay.where("number = 1"))).where("sector = 150 and sample < 2").orderBy("sample").collect()
    assert [(r.left, r.right) for r in c] == [(0x1234, 0x5678), (-1, -32768)]
    swapped = pcm.track_samples(s, lay.where("number = 2"), byte_swap=True).first().samples[0]
    assert swapped == 0xADDE << 16 | 0xEFBE
    assert lay.where("number = 1").select(pcm.total_samples(F.col("length_sectors") * 5).alias("n")).first().n == 5880


def make_container(path, plain, tags, unit=2448, per=4, codec=b"", kinds=None):
    """A container of whole units; with a codec, ``kinds`` says how each hunk is kept."""
    hunk = unit * per
    data = plain.ljust(-(-len(plain) // hunk) * hunk, b"\0")
    hunks = [data[i : i + hunk] for i in range(0, len(data), hunk)]
    meta, at = b"", 124
    for i, (tag, text) in enumerate(tags):
        following = at + len(meta) + 16 + len(text) if i + 1 < len(tags) else 0
        meta += tag + struct.pack(">IQ", len(text), following) + text
    if not codec:
        map_at = at + len(meta)
        first = -(-(map_at + 4 * len(hunks)) // hunk)
        index = b"".join(struct.pack(">I", first + i if any(h) else 0) for i, h in enumerate(hunks))
        body = (meta + index).ljust(first * hunk - 124, b"\0") + b"".join(hunks)
    else:
        packed, bits = [], ""
        for i, h in enumerate(hunks):
            kind = kinds[i]
            if kind == 0:
                x = pack_hunk(codec, h, per)
                packed.append(x)
                bits += f"{len(x):020b}" + "0" * 16
            elif kind == 4:
                packed.append(h)
                bits += "0" * 16
            elif kind == 5:
                bits += f"{hunks.index(h):08b}"
        # Three symbols 0, 4 and 5, of lengths 1, 2 and 2: the longer codes come first.
        lengths = {0: 1, 4: 2, 5: 2}
        tree = "".join("00010001" if lengths.get(i) == 1 else f"{lengths.get(i, 0):04b}" for i in range(16))
        code = {4: "00", 5: "01", 0: "1"}
        stream = tree + "".join(code[k] for k in kinds) + bits
        stream = stream.ljust(-(-len(stream) // 8) * 8, "0")
        stream = int(stream, 2).to_bytes(len(stream) // 8, "big")
        map_at = at + len(meta)
        start = map_at + 16 + len(stream)
        index = struct.pack(">I", len(stream)) + start.to_bytes(6, "big") + bytes(2) + bytes([20, 8, 0, 0]) + stream
        body = meta + index + b"".join(packed)
    head = CHD_MAGIC + struct.pack(">II", 124, 5) + struct.pack(">4s12x", codec) + struct.pack(">QQQII", len(plain), map_at, at if tags else 0, hunk, unit)
    path.write_bytes(head.ljust(124, b"\0") + body)


def deflate(x):
    c = zlib.compressobj(9, zlib.DEFLATED, -15)
    return c.compress(x) + c.flush()


def pack_hunk(codec, h, per):
    if codec == b"zlib":
        return deflate(h)
    main = b"".join(h[i * 2448 : i * 2448 + 2352] for i in range(per))
    sub = b"".join(h[i * 2448 + 2352 : (i + 1) * 2448] for i in range(per))
    flags, clean = 0, bytearray(main)
    for i in range(per):
        s = bytearray(main[i * 2352 : (i + 1) * 2352])
        full = bytearray(s)
        full[:12] = CD_SYNC
        container.write_parity(full)
        if bytes(full) == bytes(s):
            flags |= 1 << i
            s[:12] = bytes(12)
            s[0x81C:] = bytes(len(s) - 0x81C)
            clean[i * 2352 : (i + 1) * 2352] = s
    x = deflate(bytes(clean))
    return bytes([flags]) + len(x).to_bytes(2, "big") + x + deflate(sub)


TAGS = [(b"CHT2", b"TRACK:1 TYPE:MODE1_RAW SUBTYPE:NONE FRAMES:21"), (b"CHTR", b"TRACK:2 TYPE:AUDIO FRAMES:3\0"), (b"XYZZ", b"other")]


@pytest.mark.parametrize("codec", [b"", b"zlib", b"cdzl"])
def test_container(spark, tmp_path, codec):
    units = []
    plain = raw(iso(), 24)
    for i in range(len(plain) // 2352):
        s = bytearray(plain[i * 2352 : (i + 1) * 2352])
        s[15] = 2 if i % 2 else 1
        if i % 3:
            container.write_parity(s)
        units.append(bytes(s) + bytes([i]) * 96)
    units += [bytes([i]) * 2448 for i in (7, 8, 9)]
    units += units[4:8] * 2 if codec else []
    while len(units) % 4:
        units.append(bytes([len(units)]) * 2448)
    hunks = [b"".join(units[i : i + 4]) for i in range(0, len(units), 4)]
    kinds = [5 if h in hunks[:i] else 4 if i == 2 else 0 for i, h in enumerate(hunks)]
    path = tmp_path / "x.chd"
    make_container(path, b"".join(units), TAGS, codec=codec, kinds=kinds)
    sources.register(spark)
    read = lambda f: spark.read.format(f).option("path", str(path)).load()
    info = read("chd_info").first()
    assert (info.version, info.hunk_size, info.total_hunks, info.logical_size, info.error) == (5, 4 * 2448, len(hunks), len(units) * 2448, None)
    got = read("chd_sectors").orderBy("sector").collect()
    assert [bytes(r.raw) for r in got] == [u[:2352] for u in units] and not any(r.error for r in got)
    meta = read("chd_meta")
    assert [(r.tag, r.text) for r in meta.orderBy("seq").collect()] == [(t.decode(), x.decode()) for t, x in TAGS]
    tracks = chd.parse_tracks(meta)
    assert [(r.number, r.absolute_offset, r.length_sectors, r.kind) for r in layout.chd_layout(tracks).orderBy("ordinal").collect()] == [(1, 150, 21, "Data"), (2, 171, 3, "Audio")]
    s = read("chd_sectors").where("error is null").drop("error")
    wanted = spark.createDataFrame([(str(path), "test.txt")], "path string, filename string")
    assert bytes(images.file_contents(s, images.find_files(s, wanted)).first().content) == CONTENT
    audio = pcm.track_samples(s, layout.chd_layout(tracks)).where("number = 2 and error is null")
    assert sorted((r.sector, r.samples[0]) for r in audio.collect())[0][0] == 171


def test_container_errors(spark, tmp_path):
    (tmp_path / "a.chd").write_bytes(b"nothing here at all")
    make_container(tmp_path / "b.chd", bytes(range(256)) * 153, [], codec=b"huff", kinds=[0, 0, 0, 0, 0][: -(-256 * 153 // 9792)])
    (tmp_path / "c.chd").write_bytes(CHD_MAGIC + struct.pack(">II", 108, 4) + bytes(100))
    sources.register(spark)
    got = {r.path.rsplit("/", 1)[1]: r.error and r.error.kind for r in spark.read.format("chd_info").option("path", str(tmp_path)).load().collect()}
    assert got == {"a.chd": "InvalidFormat", "b.chd": None, "c.chd": "UnsupportedVariant"}
    bad = {r.path.rsplit("/", 1)[1]: r.error.kind for r in spark.read.format("chd_sectors").option("path", str(tmp_path)).load().collect()}
    assert bad == {"a.chd": "InvalidFormat", "b.chd": "UnsupportedVariant", "c.chd": "UnsupportedVariant"}


def test_sources(spark, tmp_path, monkeypatch):
    (tmp_path / "a.iso").write_bytes(iso())
    (tmp_path / "b.bin").write_bytes(raw(iso()) + b"tail")
    (tmp_path / "e.bin").write_bytes(b"")
    sources.register(spark)
    heads = {r.path.rsplit("/", 1)[1]: r for r in spark.read.format("head").option("path", str(tmp_path)).load().collect()}
    assert heads["a.iso"].length == len(iso()) and len(heads["a.iso"]["head"]) == images.HEAD and heads["e.bin"].length == 0
    fmt, err = images.detect_format(F.col("head"), F.col("length"))
    found = spark.read.format("head").option("path", f"{tmp_path}/a.iso,{tmp_path}/b.bin").load().select(fmt.alias("f")).collect()
    assert sorted(r.f for r in found) == ["Iso2048", "RawSector2352"]
    got = spark.read.format("sectors").option("path", f"{tmp_path}/b.bin").load().orderBy("sector").collect()
    assert b"".join(bytes(r.raw) for r in got) == raw(iso())
    got = spark.read.format("sectors").option("path", f"{tmp_path}/a.iso").option("sector_size", 2048).load()
    assert images.volumes(got).first().pvd.volume_identifier == "TEST_VOLUME"
    assert spark.read.format("sectors").option("path", f"{tmp_path}/e.bin").load().count() == 0
    with pytest.raises(Exception, match="nope"):
        spark.read.format("sectors").option("path", f"{tmp_path}/nope").load().count()


def bit_text(x, n):
    return f"{x & ((1 << n) - 1):0{n}b}" if n else ""


def rice(values, k):
    folded = [v << 1 if v >= 0 else (-v << 1) - 1 for v in values]
    return "".join("0" * (u >> k) + "1" + bit_text(u, k) for u in folded)


def audio_frame(left, right, kinds, channels=1):
    """A frame of two subframes: constant, verbatim, fixed (order 2, two partitions) or linear (order 1)."""
    n = len(left)
    text = "11111111111110" + "00" + "0111" + "1001" + bit_text(channels, 4) + "100" + "0" + "00000000" + bit_text(n - 1, 16) + "0" * 8
    for i, (x, kind) in enumerate(zip((left, right), kinds, strict=True)):
        depth = 16 + (channels in (8, 10) and i == 1 or channels == 9 and i == 0)
        if kind == "constant":
            text += "0" + "000000" + "0" + bit_text(x[0], depth)
        elif kind == "verbatim":  # its values are even: one bit is wasted
            text += "0" + "000001" + "1" + "1" + "".join(bit_text(v >> 1, depth - 1) for v in x)
        elif kind == "fixed":
            r = [x[t] - 2 * x[t - 1] + x[t - 2] for t in range(2, n)]
            text += "0" + "001010" + "0" + bit_text(x[0], depth) + bit_text(x[1], depth) + "00" + "0001" + "0011" + rice(r[: n // 2 - 2], 3) + "1111" + "10100"
            text += "".join(bit_text(v, 20) for v in r[n // 2 - 2 :])
        else:
            r = [x[t] - (7 * x[t - 1] >> 3) for t in range(1, n)]
            text += "0" + "100000" + "0" + bit_text(x[0], depth) + "0100" + "00011" + bit_text(7, 5) + "01" + "0000" + "00110" + rice(r, 6)
    text += "0" * (-len(text) % 8) + "0" * 16
    return int(text, 2).to_bytes(len(text) // 8, "big")


def two_channels(n, seed=0):
    rng = np.random.default_rng(seed)
    return [int(v) for v in rng.integers(-3000, 3000, n).cumsum() % 4000 - 2000], [int(v) * 2 for v in rng.integers(-9000, 9000, n)]


def test_audio_frames():
    left, right = two_channels(256)
    want = np.stack([left, right], 1)
    mid, side = [(a + b) >> 1 for a, b in want.tolist()], [a - b for a, b in want.tolist()]
    data = b"".join(
        [
            audio_frame(left, right, ("fixed", "verbatim")),
            audio_frame(left, side, ("linear", "fixed"), 8),
            audio_frame(side, right, ("fixed", "linear"), 9),
            audio_frame(mid, side, ("fixed", "linear"), 10),
            audio_frame([-5] * 256, [7] * 256, ("constant", "constant")),
        ]
    )
    got, n = flac.decode(data + b"after", 5 * 256)
    assert n == len(data)
    assert all((got[i * 256 : i * 256 + 256] == want).all() for i in range(4))
    assert (got[1024:] == [-5, 7]).all()
    with pytest.raises(EOFError):
        flac.decode(data[:-200], 5 * 256)


@pytest.mark.parametrize("codec", [b"cdfl", b"flac", b"cdzs"])
def test_container_of_audio(spark, tmp_path, monkeypatch, codec):
    per, sector = 4, 2352
    hunks = []
    for i in range(5):
        left, right = two_channels(per * (2448 if codec == b"flac" else sector) // 4, i)
        pcm_ = np.stack([left, right], 1).astype(">i2").tobytes()
        hunks.append(pcm_ if codec == b"flac" else b"".join(pcm_[k * sector : (k + 1) * sector] + bytes([i]) * 96 for k in range(per)))

    def pack(_, h, per):
        if codec == b"flac":
            x = np.frombuffer(h, ">i2").reshape(-1, 2)
            return b"B" + audio_frame(x[:, 0].tolist(), x[:, 1].tolist(), ("fixed", "verbatim"))
        main, sub = (b"".join(h[k * 2448 + a : k * 2448 + b] for k in range(per)) for a, b in ((0, sector), (sector, 2448)))
        if codec == b"cdzs":
            z = pytest.importorskip("zstandard").ZstdCompressor()
            x = z.compress(main)
            return b"\0" + len(x).to_bytes(2, "big") + x + z.compress(sub)
        x = np.frombuffer(main, ">i2").reshape(-1, 2).astype(int)
        return audio_frame(x[:, 0].tolist(), x[:, 1].tolist(), ("linear", "verbatim")) + deflate(sub)

    monkeypatch.setitem(globals(), "pack_hunk", pack)
    path = tmp_path / "a.chd"
    make_container(path, b"".join(hunks), TAGS, codec=codec, kinds=[0] * 5)
    sources.register(spark)
    got = spark.read.format("chd_sectors").option("path", str(path)).load().orderBy("sector").collect()
    whole = b"".join(hunks)
    assert not any(r.error for r in got)
    assert [bytes(r.raw) for r in got] == [whole[i : i + sector] for i in range(0, len(whole), 2448)]


def test_conditions_reach_the_sources(spark, tmp_path):
    for name in ("a.bin", "b.bin"):
        (tmp_path / name).write_bytes(fixtures.raw_image(fixtures.volume({"X.TXT": b"some text"})))
    sources.register(spark)
    load = lambda f: spark.read.format(f).option("path", str(tmp_path)).load()
    assert [(r.path[-5:], r.sector) for r in load("sectors").where("sector = 16 and path like '%a.bin'").collect()] == [("a.bin", 16)]
    assert sorted(r.sector for r in load("sectors").where(f"sector > 17 and sector <= 19 and path = '{tmp_path}/b.bin'").collect()) == [18, 19]
    assert images.volumes(load("sectors")).count() == 2
    # Only what is asked for is planned, and so read.
    reader = sources.SectorSource({"path": str(tmp_path)}).reader(None)
    assert len(list(reader.pushFilters([EqualTo(("path",), f"{tmp_path}/b.bin"), In(("sector",), (16, 18, 19, 400))]))) == 2
    assert [(p.path[-5:], p.first, p.end) for p in reader.partitions()] == [("b.bin", 16, 17), ("b.bin", 18, 20)]
    make_container(tmp_path / "c.chd", bytes(2448 * 40), TAGS)
    some = spark.read.format("chd_sectors").option("path", f"{tmp_path}/c.chd").load().where("sector >= 5 and sector < 9")
    assert sorted(r.sector for r in some.collect()) == [5, 6, 7, 8]


def test_layouts_of_containers_with_faults(spark, tmp_path):
    make_container(tmp_path / "good.chd", bytes(2448 * 40), TAGS)
    make_container(tmp_path / "none.chd", bytes(2448 * 4), TAGS[2:])
    make_container(tmp_path / "bare.chd", bytes(2448 * 4), [])
    (tmp_path / "bad.chd").write_bytes(b"nothing")
    whole = (tmp_path / "good.chd").read_bytes()
    (tmp_path / "cut.chd").write_bytes(whole[:150])
    sources.register(spark)
    load = lambda f: spark.read.format(f).option("path", str(tmp_path)).load()
    got = layout.read_chd_layout(load("chd_meta"), load("chd_info")).collect()
    said = {(r.path.rsplit("/", 1)[1], r.number, r.error and r.error.kind) for r in got}
    assert said == {("good.chd", 1, None), ("good.chd", 2, None), ("none.chd", None, "InvalidFormat"), ("bare.chd", None, "InvalidFormat"), ("bad.chd", None, "InvalidFormat"), ("cut.chd", None, "CorruptedHeader")}


def test_audio_over_several_files(spark):
    images_ = {"one.bin": 3, "two.bin": 2}
    rows_ = [(name, i, bytearray([k * 10 + i, 0, 0, 0]) + bytearray(2348)) for k, (name, n) in enumerate(images_.items()) for i in range(n)]
    sectors_ = spark.createDataFrame(rows_, "path string, sector bigint, raw binary")
    files = spark.createDataFrame([("disc", 0, "one.bin", 3 * 2352), ("disc", 1, "two.bin", 2 * 2352)], "path string, file_no int, image string, size_bytes bigint")
    got = pcm.joined_sectors(sectors_, files).orderBy("sector").collect()
    assert [(r.path, r.sector, r.raw[0]) for r in got] == [("disc", i, x) for i, x in enumerate([0, 1, 2, 10, 11])]


def test_progress_and_declared_size(spark):
    chunks = spark.createDataFrame([("a", 1, bytearray(b"xy")), ("a", 2, bytearray(b"z"))], "path string, seq int, data binary")
    seen_rows, seen = hashing.with_progress(chunks)
    assert hashing.chunked_hashes(seen_rows).first().data_size == 3
    assert seen.get == {"chunks": 2, "bytes": 3}
    h = chunks.select(checksums.file_hashes(F.col("data"), "Crc32Sha1", F.lit(9)).alias("h")).first().h
    assert (h.data_size, h.declared_size, h.md5) == (2, 9, None) and h.sha1


def test_fixtures(spark):
    files = {"READ.ME": b"r" * 3000, "B.TXT": b"bb"}
    for image in (fixtures.volume(files), fixtures.raw_image(fixtures.volume(files))):
        s = sectors(spark, image)
        wanted = spark.createDataFrame([("0", "read.me"), ("0", "b.txt")], "path string, filename string")
        got = {r.filename: bytes(r.content) for r in images.file_contents(s, images.find_files(s, wanted)).collect()}
        assert got == {"read.me": files["READ.ME"], "b.txt": files["B.TXT"]}
    data, _ = images.sector_data_mode1(F.lit(fixtures.raw_sector(b"one", 1)), F.lit(0), F.lit("RawSector2352"))
    assert bytes(spark.range(1).select(data.alias("d")).first().d)[:3] == b"one"
