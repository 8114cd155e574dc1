"""Folders of sheets, streams of arrivals, and the driver's entry points."""

import __spark_entry__
from platterlake.operators import layout
from platterlake.sources import sheets
from platterlake.streaming import arrivals


def test_layout_from_a_folder(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x y.cue").write_text('FILE "t.bin" BINARY\nTRACK 01 AUDIO\nINDEX 01 00:00:00\n')
    (tmp_path / "a" / "t.bin").write_bytes(bytes(2352 * 3))
    (tmp_path / "b.cue").write_text('FILE "t.bin" BINARY\nTRACK 01 AUDIO\nINDEX 01 00:00:00\n')
    found = sheets.read_sheets(spark, str(tmp_path))
    sizes = sheets.sizes_for(found, sheets.file_sizes(spark, str(tmp_path)))
    got = {r.path.rsplit("/", 1)[1]: (r.length_sectors, r.error and r.error.kind) for r in layout.read_layout(found, sizes).collect()}
    assert got == {"x%20y.cue": (3, None), "b.cue": (None, "Io")}


def test_sizes_read_no_content(spark, tmp_path):
    (tmp_path / "t.bin").write_bytes(b"123")
    plan = sheets.file_sizes(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]


def test_arrivals(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.chd").write_bytes(b"MComprHD" + bytes(8))
    (inbox / "b.cue").write_text("FILE a B\nTRACK 01 AUDIO")

    def run(df, name):
        q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    assert sorted((r.path.rsplit("/", 1)[1], r.format) for r in run(arrivals.arriving_images(spark, str(inbox)), "images")) == [("a.chd", "Chd"), ("b.cue", "Cue")]
    assert [r.text for r in run(arrivals.arriving_sheets(spark, str(inbox)), "sheets")] == ["FILE a B\nTRACK 01 AUDIO"]


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert {"path", "ordinal", "number", "absolute_offset"} <= set(df.columns) and df.limit(1).count() == 1
    known, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(known) and len(known) > 35
