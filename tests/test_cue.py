"""Cue sheets: parsing, compatibility, conversion, layouts."""

import pytest
from pyspark.sql import functions as F

from platterlake.operators import chd, cue, layout


def sheets(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, text string")


def parsed(spark, text, **more):
    p = cue.parse(sheets(spark, text), **more)
    files = [(r.filename, r.file_type) for r in p.files.orderBy("file_no").collect()]
    tracks = [(r.file_no, r.number, r.mode) for r in p.tracks.orderBy("ordinal").collect()]
    indexes = [(r.ordinal, r.number, r.sector) for r in p.indexes.orderBy("p").collect()]
    return files, tracks, indexes, [r.error.message for r in p.errors.collect()]


def test_parse_standard(spark):
    text = 'REM x\r\nFILE "game 1.bin" BINARY\r\n  TRACK 01 MODE2/2352\r\n    INDEX 01 00:00:00\r\n  track 02 AUDIO\r\n    PREGAP 00:02:00\r\n    INDEX 00 54:04:50\r\n    INDEX 01 54:04:52\r\nFILE b.wav WAVE\r\n  TRACK 03 AUDIO\r\n    INDEX 01 00:00:33'
    files, tracks, indexes, errors = parsed(spark, text)
    assert files == [("game 1.bin", "BINARY"), ("b.wav", "WAVE")]
    assert tracks == [(1, 1, "MODE2/2352"), (1, 2, "AUDIO"), (2, 3, "AUDIO")]
    assert indexes == [(1, 1, 0), (2, 0, 243350), (2, 1, 243352), (3, 1, 33)] and not errors


def test_parse_extended(spark):
    text = 'CD_ROM_XA\nTRACK MODE2_RAW\nNO COPY\nDATAFILE "game.bin" 01:32:21 // length\nTRACK AUDIO\nINDEX 01 00:00:00\nFILE "a.wav" #0\nTRACK AUDIO\nAUDIOFILE "b.wav" 0\n'
    files, tracks, indexes, errors = parsed(spark, text)
    assert files == [("game.bin", "BINARY"), ("a.wav", "#0"), ("b.wav", "0")]
    assert tracks == [(1, 1, "MODE2_RAW"), (1, 2, "AUDIO"), (2, 3, "AUDIO")]
    assert indexes == [(2, 1, 0)] and not errors


@pytest.mark.parametrize(
    "line, tracks, indexes",
    [
        ("TRACK 300 AUDIO", [(1, 1, "300")], []),
        ("TRACK 01", [(1, 1, "01")], []),
        ("TRACK 7 MODE1/2048 x", [(1, 7, "MODE1/2048")], []),
        ("TRACK AUDIO\nINDEX x 00:00:00\nINDEX 256 00:00:00\nINDEX 01 00:00\nINDEX 01 1:2:3:4\nINDEX 01", [(1, 1, "AUDIO")], []),
        ("TRACK AUDIO\nINDEX  1  00:70:80", [(1, 1, "AUDIO")], [(1, 1, 5330)]),
        ("INDEX 01 00:00:00", [], []),
        ("TRACKS 01 AUDIO\n// TRACK 01 AUDIO", [], []),
    ],
)
def test_odd_lines(spark, line, tracks, indexes):
    assert parsed(spark, f"FILE a.bin BINARY\n{line}") == ([("a.bin", "BINARY")], tracks, indexes, [])


def test_names_of_files(spark):
    assert parsed(spark, 'FILE  "a" BINARY')[0] == [("", '"a" BINARY')]
    assert parsed(spark, 'FILE "" BINARY\nFILE x')[0] == [("", "BINARY"), ("x", "")]
    assert parsed(spark, "FILE\t\"a\"\nfile b.bin")[0] == [("b.bin", "")]
    assert parsed(spark, "﻿FILE a B\nFILE b B", strip_bom=True)[0] == [("a", "B"), ("b", "B")]
    assert parsed(spark, "﻿FILE a B\nFILE b B")[0] == [("b", "B")]


def test_parse_errors(spark):
    bad = sheets(spark, "", "TRACK 01 AUDIO", 'FILE "a', "FILE a B\n" + "TRACK AUDIO\n" * 256, "FILE a B", None)
    got = {r.path: r.error.message for r in cue.parse(bad).errors.collect()}
    assert got == {"0": cue.NO_FILE, "1": cue.NO_FILE, "2": cue.OPEN_QUOTE, "3": cue.TOO_MANY, "5": cue.NO_FILE}


def test_compatibility(spark):
    texts = [
        'FILE "a.bin" BINARY\n  TRACK 01 MODE1/2352\n    INDEX 01 00:00:00',
        "CD_ROM\n\nCD_ROM_XA\nTRACK MODE2_RAW\nTRACK 05 MODE1_RAW\nTRACK AUDIO\nTRACK MODE1\n",
        "// only a comment",
        "AUDIOFILE \"a.wav\" #16278192 0 00:08:08\nSILENCE 00:02:00\n",
        "DATAFILE \"a.bin\"\nSTART\nSTARTED\nno copy",
        "STARTED\nZEROES 1\nFILE x #3",
        "",
        "//CD_DA\nREM CD_DA\n",
    ]
    rows = {int(r.path): r for r in cue.compatibility(sheets(spark, *texts)).collect()}
    assert rows[0].is_standard and not rows[0].can_auto_fix and rows[0].summary == ""
    assert rows[1].disc_type_header == "CD_ROM_XA" and [tuple(x) for x in rows[1].cdwin_track_modes] == [(1, "MODE2_RAW"), (5, "MODE1_RAW")]
    assert rows[1].summary == "CD_ROM_XA header, 2 CDRWin track mode(s)" and rows[1].can_auto_fix
    assert rows[2].has_comments and not rows[2].is_standard and rows[2].summary == "comments"
    assert rows[3].unfixable_reason == cue.UNFIXABLE and not rows[3].can_auto_fix and rows[3].summary == "AUDIOFILE, extra directives"
    assert rows[4].has_datafile and rows[4].has_extra_directives and rows[4].summary == "DATAFILE, extra directives"
    assert rows[5].is_standard and rows[6].is_standard
    assert rows[7].disc_type_header is None and rows[7].has_comments


def converted(spark, text):
    r = cue.convert(sheets(spark, text)).first()
    return r.text.split("\n")[:-1] if r.text is not None else r.error.message


@pytest.mark.parametrize("old, new", [("MODE2_RAW", "MODE2/2352"), ("MODE1_RAW", "MODE1/2352"), ("MODE2_FORM1", "MODE2/2048"), ("MODE2_FORM2", "MODE2/2324"), ("MODE2_FORM_MIX", "MODE2/2336")])
def test_convert_modes(spark, old, new):
    assert converted(spark, f'CD_ROM_XA\nTRACK {old}\nDATAFILE "game.bin"') == ['FILE "game.bin" BINARY', f"  TRACK 01 {new}", "    INDEX 01 00:00:00"]


def test_convert_keeps_standard_sheets_and_their_layout(spark):
    text = 'FILE "a.bin" BINARY\n  TRACK 01 MODE2/2352\n    INDEX 01 00:00:00\n  TRACK 02 AUDIO\n    PREGAP 00:02:00\n    INDEX 01 00:10:00\n'
    assert "\n".join(converted(spark, "REM dropped\nTITLE x\n" + text)) + "\n" == text


def test_convert_lengths_add_up_within_one_file(spark):
    text = "TRACK MODE1_RAW\nDATAFILE x.bin 00:00:10\nTRACK AUDIO\nDATAFILE x.bin 00:00:20\nTRACK MODE2_FORM2\nDATAFILE x.bin 00:01:00 // c\nTRACK AUDIO\nDATAFILE y.bin 00:00:01\nTRACK AUDIO\nDATAFILE x.bin\n"
    assert converted(spark, text) == [
        'FILE "x.bin" BINARY', "  TRACK 01 MODE1/2352", "    INDEX 01 00:00:00", "  TRACK 02 AUDIO", "    INDEX 01 00:00:10",
        "  TRACK 03 MODE2/2324", "    INDEX 01 00:00:30", 'FILE "y.bin" BINARY', "  TRACK 04 AUDIO", "    INDEX 01 00:00:00",
        "  TRACK 05 AUDIO", "    INDEX 01 00:00:00",
    ]


def test_convert_tracks_and_their_files(spark):
    assert converted(spark, 'TRACK AUDIO\nAUDIOFILE "a.wav" 0\nTRACK AUDIO\nAUDIOFILE "b.wav"') == [
        'FILE "a.wav" WAVE', "  TRACK 01 AUDIO", "    INDEX 01 00:00:00", 'FILE "b.wav" WAVE', "  TRACK 02 AUDIO", "    INDEX 01 00:00:00",
    ]
    # FILE lets go the tracks before it first, so they follow the file before.
    assert converted(spark, 'TRACK MODE2_RAW\nDATAFILE a.bin\nTRACK AUDIO\nINDEX 01 00:00:05\nFILE "b.wav" #0 00:01:00\nPOSTGAP 00:02:00') == [
        'FILE "a.bin" BINARY', "  TRACK 01 MODE2/2352", "    INDEX 01 00:00:00", "  TRACK 02 AUDIO", "    INDEX 01 00:00:05", 'FILE "b.wav" WAVE', "    POSTGAP 00:02:00",
    ]
    assert converted(spark, "TRACK 04 AUDIO\nPREGAP 00:02:00\nFILE x.bin motorola z\nDATAFILE y\nDATAFILE y") == [
        "  TRACK 04 AUDIO", "    PREGAP 00:02:00", 'FILE "x.bin" motorola', 'FILE "y" BINARY', 'FILE "y" BINARY',
    ]


def test_convert_errors(spark):
    assert converted(spark, 'AUDIOFILE "a.wav" #100') == cue.BYTE_OFFSET
    assert converted(spark, 'DATAFILE "a.bin') == cue.OPEN_QUOTE
    assert converted(spark, "REM nothing\n// at all\nCD_DA") == cue.NO_OUTPUT
    assert converted(spark, "") == cue.NO_OUTPUT


def laid_out(spark, text, sizes, read=layout.cue_layout):
    rows = read(sheets(spark, text), spark.createDataFrame([("0", f, n) for f, n in sizes.items()], "path string, filename string, size_bytes long")).orderBy("ordinal").collect()
    if rows and rows[0].error:
        assert len(rows) == 1
        return rows[0].error.kind, rows[0].error.message
    return [(r.number, r.absolute_offset, r.length_sectors, r.kind) for r in rows]


def test_layout_of_published_discs(spark):
    three = 'FILE "a.bin" BINARY\nTRACK 01 AUDIO\nINDEX 01 00:00:00\nTRACK 02 AUDIO\nINDEX 00 16:40:00\nINDEX 01 16:43:33\nTRACK 03 AUDIO\nINDEX 01 28:54:23'
    assert laid_out(spark, three, {"a.bin": 335953 * 2352}) == [(1, 150, 75258, "Audio"), (2, 75408, 54815, "Audio"), (3, 130223, 205880, "Audio")]
    hidden = "FILE a.bin BINARY\n" + "".join(f"TRACK 0{i} AUDIO\nINDEX 01 {m}\n" for i, m in enumerate(["00:00:33", "23:53:08", "39:46:03", "63:15:65"], 1))
    assert [x[1] for x in laid_out(spark, hidden, {"a.bin": 356290 * 2352})] == [183, 107633, 179103, 284840]
    files = "".join(f"FILE f{i}.bin BINARY\nTRACK 0{i} MODE1/2352\nINDEX 01 00:00:00\n" for i in (1, 2, 3))
    sizes = {"f1.bin": 75258 * 2352, "f2.bin": 54815 * 2352, "f3.bin": 205880 * 2352}
    assert laid_out(spark, files, sizes) == [(1, 150, 75258, "Data"), (2, 75408, 54815, "Data"), (3, 130223, 205880, "Data")]
    rows = layout.cue_layout(sheets(spark, files), spark.createDataFrame([("0", f, n) for f, n in sizes.items()], "path string, filename string, size_bytes long"))
    assert layout.lead_out(rows).first().lead_out == 336103


def test_layout_details(spark):
    text = "FILE e.bin BINARY\nFILE a.bin BINARY\nTRACK 01 AUDIO\nINDEX 01 00:00:02\nINDEX 01 00:09:00\nTRACK 02 AUDIO\nINDEX 01 00:00:02\nFILE b.bin BINARY\nTRACK 03 CDG\nINDEX 01 00:00:05"
    assert laid_out(spark, text, {"a.bin": 10 * 2352, "b.bin": 9 * 2352}) == [(1, 152, 0, "Audio"), (2, 152, 8, "Audio"), (3, 160, 4, "Unknown")]


def test_layout_errors(spark):
    one = "FILE a.bin BINARY\nTRACK 01 AUDIO\nINDEX 01 00:00:00\n"
    assert laid_out(spark, one, {})[0] == "Io"
    assert "not a multiple" in laid_out(spark, one, {"a.bin": 2352 * 100 + 7})[1]
    assert "missing INDEX 01" in laid_out(spark, one.replace("INDEX 01", "INDEX 00"), {"a.bin": 2352})[1]
    assert "monotonically" in laid_out(spark, one.replace("00:00:00", "00:00:09") + "TRACK 02 AUDIO\nINDEX 01 00:00:08", {"a.bin": 99 * 2352})[1]
    assert "ends before" in laid_out(spark, one.replace("00:00:00", "00:00:09"), {"a.bin": 2 * 2352})[1]
    assert laid_out(spark, "FILE a.bin B", {}) == ("InvalidFormat", cue.NO_TRACKS)
    assert laid_out(spark, "", {}) == ("InvalidFormat", cue.NO_FILE)
    # The first file's problem comes first.
    two = one + "FILE b.bin BINARY\nTRACK 02 AUDIO\n"
    assert laid_out(spark, two, {"a.bin": 5})[1].startswith("BIN file 'a.bin' size 5")


def test_read_layout_converts_first(spark):
    text = "CD_ROM_XA\nTRACK MODE2_RAW\nDATAFILE x.bin 00:00:10\nTRACK AUDIO\nDATAFILE x.bin 00:00:20\n"
    assert laid_out(spark, text, {"x.bin": 30 * 2352}, layout.read_layout) == [(1, 150, 10, "Data"), (2, 160, 20, "Audio")]
    assert laid_out(spark, 'AUDIOFILE "a.wav" #3', {}, layout.read_layout) == ("InvalidFormat", cue.UNFIXABLE)


def test_container_tracks(spark):
    text = "TRACK:1 TYPE:MODE2_RAW SUBTYPE:NONE FRAMES:229020 PREFRAMES:150"
    fields = spark.createDataFrame([(text,)], "text string").select(*(chd.meta_field(F.col("text"), f).alias(f) for f in ("TRACK", "TYPE", "FRAMES", "RAMES", "PGTYPE"))).first()
    assert tuple(fields) == ("1", "MODE2_RAW", "229020", None, None)
    meta = [
        ("d", 0, "CHT2", "TRACK:3 TYPE:AUDIO FRAMES:906\0"), ("d", 1, "CHTR", "TRACK:1 TYPE:MODE1_RAW FRAMES:19560"), ("d", 2, "CHT2", "TRACK:2 TYPE:MODE2_RAW FRAMES:78407"),
        ("d", 3, "CHT2", "TRACK:4 FRAMES:x"), ("d", 4, "XXXX", "TRACK:5 FRAMES:1"), ("a", 0, "CHT2", "TRACK:300 FRAMES:7"), ("t", 0, "CHT2", "TRACK:1 TYPE:MODE1 FRAMES:5"), ("t", 1, "CHT2", "TRACK:2 TYPE:MODE1 FRAMES:5 FRAMES:9"),
    ]
    rows = chd.parse_tracks(spark.createDataFrame(meta, "path string, seq long, tag string, text string"))
    got = sorted((r.path, r.track_number, r.track_type, r.frames, r.start_sector) for r in rows.collect())
    assert got == [("a", 300, "UNKNOWN", 7, 0), ("d", 1, "MODE1_RAW", 19560, 0), ("d", 2, "MODE2_RAW", 78407, 19560), ("d", 3, "AUDIO", 906, 97967), ("t", 1, "MODE1", 5, 0), ("t", 2, "MODE1", 5, 5)]
    assert {r.path: r.track_number for r in chd.largest_data_track(rows).collect()} == {"d": 2, "t": 2}
    assert {r.path: r.frames for r in chd.track1_frames(rows).collect()} == {"d": 19560, "t": 5}
    assert {r.path: r.skipped for r in chd.skipped_tracks(spark.createDataFrame(meta, "path string, seq long, tag string, text string")).collect()} == {"d": 1, "a": 0, "t": 0}
    lay = {(r.path, r.number): (r.absolute_offset, r.length_sectors, r.kind, r.error) for r in layout.chd_layout(rows).collect()}
    assert lay["d", 3] == (98117, 906, "Audio", None) and lay["d", 1][:3] == (150, 19560, "Data") and lay["a", 300][3].kind == "InvalidFormat"
