"""What decides how queries grow: how often rows are dealt, and whether lines of sheets are sorted."""

import re

import pytest

import __spark_entry__
from platterlake.operators import cue, layout

#: By query: dealings and windows in its plan.  The join with the sizes reads the sheets twice.
MOST = {
    "cue_read_layout": (2, 0),  # F1
    "cue_convert": (1, 0),  # F2
    "cue_compat": (1, 0),  # F3
    "cue_layout": (2, 0),  # F4
    "cue_lead_out": (3, 0),  # F5
    "cue_tracks": (1, 0),  # F6
    "cue_files": (1, 0),  # F7
    "track1_frames": (1, 0),  # F8
    "chd_tracks": (1, 1),  # F9
    "chd_layout": (1, 2),  # F10
    "largest_data_track": (1, 1),  # F11
    "cue_indexes": (1, 0),  # F12
    "chd_skipped_tracks": (1, 0),  # F13
}


def counts(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return tuple(len(re.findall(what, plan)) for what in (r"\bExchange \w", r"\bWindow \["))


@pytest.mark.parametrize("name", MOST)
def test_rows_are_dealt_once(spark, name):
    assert counts(__spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")) == MOST[name]


def test_read_layout_sorts_no_lines(spark):
    sheets = spark.createDataFrame([("0", "CD_ROM_XA\nTRACK AUDIO\nDATAFILE x.bin")], "path string, text string")
    sizes = spark.createDataFrame([("0", "x.bin", 2352 * 30)], "path string, filename string, size_bytes long")
    rows = layout.read_layout(sheets, sizes)
    assert counts(rows)[1] == 0 and [(r.absolute_offset, r.length_sectors) for r in rows.collect()] == [(150, 30)]


def test_a_long_sheet_takes_linear_time(spark):
    text = "FILE a.bin BINARY\nTRACK AUDIO\n" + "INDEX 01 00:00:01\n" * 200000
    sheets = spark.createDataFrame([("0", text)], "path string, text string")
    assert cue.parse(sheets).indexes.count() == 200000


def test_names_that_are_not_utf8_keep_their_bytes(spark):
    sheets = spark.sql("""select '0' as path, cast(x'46494C4520636166E92E62696E2042494E4152590A' as string) as text""")
    assert bytes(cue.parse(sheets).files.selectExpr("cast(filename as binary) b").first().b) == b"caf\xe9.bin"
