"""Queries over the synthetic tables, one for each operator, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import binary as B
from ..functions import checksums as K
from ..functions import names as N
from ..functions import timecode as T
from ..operators import chd, cue, hashing, images, layout, pcm, titles
from ..sources import sheets
from . import stored
from . import synth as S

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Enters a function under its own name, with its SQL."""

    def enter(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return enter


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- Cue sheets and layouts

_TRACKS = """WITH t AS (SELECT 'o' || l_orderkey AS path, l_linenumber::BIGINT AS n, sum(l_quantity)::BIGINT AS frames,
  CASE min(l_returnflag) WHEN 'A' THEN 'MODE1_RAW' WHEN 'N' THEN 'AUDIO' ELSE 'MODE2_RAW' END AS mode FROM lineitem GROUP BY l_orderkey, l_linenumber),
u AS (SELECT *, row_number() OVER w AS i, (sum(frames) OVER w - frames)::BIGINT AS before, count(*) OVER (PARTITION BY path) AS k,
  CASE mode WHEN 'AUDIO' THEN 'AUDIO' ELSE left(mode, 5) || '/2352' END AS std,
  CASE mode WHEN 'AUDIO' THEN 'Audio' ELSE 'Data' END AS kind FROM t WINDOW w AS (PARTITION BY path ORDER BY n))
"""
_MSF = "printf('%02d:%02d:%02d', {0} // 4500, ({0} // 75) % 60, {0} % 75)"


@query(_TRACKS + "SELECT path, i AS ordinal, n AS number, 150 + before AS absolute_offset, frames AS length_sectors, kind, std AS mode FROM u")
def cue_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheets = S.standard_sheets(spark, sf_dir)
    rows = layout.cue_layout(sheets.select("path", "text"), S.sizes(sheets))
    return rows.select("path", F.col("ordinal").cast("bigint").alias("ordinal"), "number", "absolute_offset", "length_sectors", "kind", "mode")


@query(_TRACKS + "SELECT path, 150 + sum(frames)::BIGINT AS lead_out FROM t GROUP BY path")
def cue_lead_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheets = S.standard_sheets(spark, sf_dir)
    return layout.lead_out(layout.cue_layout(sheets.select("path", "text"), S.sizes(sheets)))


@query("SELECT DISTINCT 'o' || l_orderkey AS path, 1::BIGINT AS file_no, 'o' || l_orderkey || '.bin' AS filename, 'BINARY' AS file_type FROM lineitem")
def cue_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cue.parse(S.standard_sheets(spark, sf_dir)).files


@query(_TRACKS + "SELECT path, 1::BIGINT AS file_no, i AS ordinal, n AS number, std AS mode FROM u")
def cue_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cue.parse(S.standard_sheets(spark, sf_dir)).tracks


@query(_TRACKS + "SELECT path, i AS ordinal, 1::BIGINT AS number, before // 4500 AS minutes, (before // 75) % 60 AS seconds, before % 75 AS frames, before AS sector FROM u")
def cue_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cue.parse(S.standard_sheets(spark, sf_dir)).indexes.drop("p")


@query("SELECT n_name AS path, CASE WHEN n_nationkey % 3 = 0 THEN 'CUE sheet contains no FILE entries' ELSE 'Unterminated quote in CUE FILE line' END AS message FROM nation WHERE n_nationkey % 3 < 2")
def cue_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey") % 3
    text = F.when(k == 0, F.lit("TRACK 01 AUDIO\nINDEX 01 00:00:00")).when(k == 1, F.concat(F.lit('FILE "'), "n_name")).otherwise(F.lit("file a.bin binary"))
    sheets = S.table(spark, sf_dir, "nation").select(F.col("n_name").alias("path"), text.alias("text"))
    return cue.parse(sheets).errors.select("path", "error.message")


@query(
    _TRACKS
    + """SELECT path, 'CD_ROM_XA' AS disc_type_header, coalesce(string_agg(CASE WHEN mode <> 'AUDIO' THEN i || '=' || mode END, ',' ORDER BY i), '') AS modes,
  true AS has_datafile, false AS has_audiofile, true AS has_extra_directives, true AS has_comments, false AS is_standard, true AS can_auto_fix,
  'CD_ROM_XA header, ' || CASE WHEN count(*) FILTER (WHERE mode <> 'AUDIO') > 0 THEN count(*) FILTER (WHERE mode <> 'AUDIO') || ' CDRWin track mode(s), ' ELSE '' END
    || 'DATAFILE, extra directives, comments' AS summary FROM u GROUP BY path"""
)
def cue_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cue.compatibility(S.extended_sheets(spark, sf_dir))
    modes = F.array_join(F.transform("cdwin_track_modes", lambda x: F.concat(x["number"].cast("string"), F.lit("="), x["mode"])), ",")
    return rows.select("path", "disc_type_header", modes.alias("modes"), "has_datafile", "has_audiofile", "has_extra_directives", "has_comments", "is_standard", "can_auto_fix", "summary")


@query(
    _TRACKS
    + "SELECT path, 'FILE \"' || path || '.bin\" BINARY' || chr(10) || string_agg('  TRACK ' || printf('%02d', i) || ' ' || std || chr(10) || '    INDEX 01 ' || "
    + _MSF.format("before")
    + " || chr(10), '' ORDER BY i) AS text FROM u GROUP BY path"
)
def cue_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cue.convert(S.extended_sheets(spark, sf_dir)).where("error is null").select("path", "text")


@query(_TRACKS + "SELECT path, i AS number, 150 + before AS absolute_offset, frames AS length_sectors, kind, std AS mode FROM u")
def cue_read_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheets = S.extended_sheets(spark, sf_dir)
    return layout.read_layout(sheets.select("path", "text"), S.sizes(sheets)).select("path", "number", "absolute_offset", "length_sectors", "kind", "mode")


# --- Time codes and modes


@query("SELECT o_orderkey, " + _MSF.format("(o_orderkey * 37)") + " AS msf, o_orderkey * 37 AS sectors FROM orders")
def msf_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.table(spark, sf_dir, "orders").select("o_orderkey", T.sectors_to_msf(F.col("o_orderkey") * 37).alias("msf"))
    return rows.withColumn("sectors", T.msf_to_sectors(F.col("msf")))


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, mode, CASE WHEN mode = 'audio' THEN 'Audio' WHEN mode IN ('MODE1/2048', 'mode2_form2', 'Mode2') THEN 'Data' ELSE 'Unknown' END AS kind,
  CASE mode WHEN 'mode2_form2' THEN 'MODE2/2324' END AS standard, CASE mode WHEN 'MODE1/2048' THEN 2048 WHEN 'mode2_form2' THEN 2324 WHEN 'Mode2' THEN 2336 ELSE 2352 END AS size
FROM (SELECT *, CASE l_partkey % 5 WHEN 0 THEN 'audio' WHEN 1 THEN 'MODE1/2048' WHEN 2 THEN 'mode2_form2' WHEN 3 THEN 'Mode2' ELSE 'CDG' END AS mode FROM lineitem)"""
)
def track_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_partkey") % 5
    mode = F.when(k == 0, "audio").when(k == 1, "MODE1/2048").when(k == 2, "mode2_form2").when(k == 3, "Mode2").otherwise("CDG")
    rows = S.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", mode.alias("mode"))
    m = F.col("mode")
    return rows.select("*", T.classify_mode(m).alias("kind"), T.standard_mode(m).alias("standard"), T.sector_size(m).alias("size"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN " + _MSF.format("o_orderkey") + " END AS msf FROM orders")
def trailing_msf(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = F.when(F.col("o_orderkey") % 3 == 0, F.concat(T.sectors_to_msf(F.col("o_orderkey")), F.lit(" // x"))).when(F.col("o_orderkey") % 3 == 1, F.lit("00:01")).otherwise(F.lit("// 00:00:01"))
    return S.table(spark, sf_dir, "orders").select("o_orderkey", T.trailing_msf(rest).alias("msf"))


# --- Container tags

@query(_TRACKS + "SELECT path, n AS track_number, mode AS track_type, frames, before AS start_sector FROM u")
def chd_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chd.parse_tracks(S.metadata(spark, sf_dir)).drop("seq")


@query(_TRACKS + "SELECT path, 1::BIGINT AS skipped FROM u WHERE n = 1 UNION ALL SELECT path, 0::BIGINT FROM u GROUP BY path HAVING min(n) > 1")
def chd_skipped_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chd.skipped_tracks(S.metadata(spark, sf_dir))


@query(_TRACKS + "SELECT path, i AS ordinal, n AS number, 150 + before AS absolute_offset, frames AS length_sectors, kind, mode FROM u")
def chd_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = layout.chd_layout(chd.parse_tracks(S.metadata(spark, sf_dir)))
    return rows.select("path", F.col("ordinal").cast("bigint").alias("ordinal"), "number", "absolute_offset", "length_sectors", "kind", "mode")


@query(_TRACKS + "SELECT path, n AS track_number, mode AS track_type, frames, before AS start_sector FROM u WHERE mode <> 'AUDIO' QUALIFY row_number() OVER (PARTITION BY path ORDER BY frames DESC, n DESC) = 1")
def largest_data_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chd.largest_data_track(chd.parse_tracks(S.metadata(spark, sf_dir)))


@query(_TRACKS + "SELECT path, frames FROM u WHERE n = 1")
def track1_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chd.track1_frames(chd.parse_tracks(S.metadata(spark, sf_dir)))


@query(
    _TRACKS
    + """SELECT path, n, mode AS type, frames::VARCHAR AS frames, 'NONE' AS subtype, NULL::VARCHAR AS pgtype FROM u
UNION ALL SELECT path, 9, 'AUDIO', NULL, NULL, NULL FROM u WHERE n = 1 UNION ALL SELECT path, 8, NULL, '5', NULL, NULL FROM u WHERE n = 1"""
)
def meta_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = lambda f: chd.meta_field(F.col("text"), f)
    return S.metadata(spark, sf_dir).select("path", field("TRACK").cast("bigint").alias("n"), field("TYPE").alias("type"), field("FRAMES").alias("frames"), field("SUBTYPE").alias("subtype"), field("PGTYPE").alias("pgtype"))


# --- Titles

_TITLES = """WITH t AS (SELECT p_partkey AS idx, CASE WHEN p_size % 5 <> 0 THEN p_size::BIGINT END AS number, p_name || ' (' || p_brand || ')' AS base,
  p_name || ' (Disc ' || CASE WHEN p_size % 5 <> 0 THEN p_size::VARCHAR ELSE 'Two' END || ') (' || p_brand || ')' AS name FROM part)
"""


@query(_TITLES + "SELECT idx, number, CASE WHEN number IS NULL THEN name ELSE base END AS base FROM t")
def disc_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("name")
    return S.titles(spark, sf_dir).select("idx", N.disc_number(name).alias("number"), N.strip_disc_tag(name).alias("base"))


@query(
    _TITLES
    + """SELECT base AS base_name, arg_min(idx, (number, idx)) AS primary_index, string_agg(idx, ',' ORDER BY number, idx) AS members
FROM t WHERE number IS NOT NULL GROUP BY base HAVING count(*) > 1"""
)
def disc_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = titles.disc_groups(S.titles(spark, sf_dir))
    return rows.select("base_name", "primary_index", F.array_join(F.col("member_indices").cast("array<string>"), ",").alias("members"))


@query(
    _TITLES
    + """SELECT base AS base_name, first_value(idx) OVER w AS primary_index, idx AS member_index, (row_number() OVER w - 1)::INT AS position FROM t
WHERE number IS NOT NULL AND base IN (SELECT base FROM t WHERE number IS NOT NULL GROUP BY base HAVING count(*) > 1) WINDOW w AS (PARTITION BY base ORDER BY number, idx)"""
)
def disc_group_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return titles.disc_group_members(S.titles(spark, sf_dir))


@query("SELECT p_brand AS key, CASE WHEN min(p_type) = max(p_type) THEN p_brand || ' (' || min(p_type) || ')' ELSE p_brand END AS base_name FROM part GROUP BY p_brand")
def base_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.table(spark, sf_dir, "part").select(F.col("p_brand").alias("key"), F.col("p_partkey").alias("idx"), F.concat("p_brand", F.lit(" ("), "p_type", F.lit(")")).alias("name"))
    return titles.base_names(rows, "key")


@query("SELECT p_name AS key, CASE WHEN min(p_size % 2) = max(p_size % 2) THEN p_name || CASE WHEN min(p_size % 2) = 0 THEN ' (A)' ELSE ' (B)' END END AS base_name FROM part GROUP BY p_name")
def same_game(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("p_name", F.format_string(" (Disc %d)", "p_size"), F.when(F.col("p_size") % 2 == 0, " (A)").otherwise(" (B)"))
    return titles.same_game(S.table(spark, sf_dir, "part").select(F.col("p_name").alias("key"), name.alias("name")), "key")


@query("SELECT p_partkey, p_name AS cut, p_name || ' (' || p_brand || ')' AS whole, left(p_name, p_size % 9) AS prefix FROM part")
def name_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    return S.table(spark, sf_dir, "part").select(
        "p_partkey",
        N.trim_to_paren_boundary(F.concat(name, F.lit(" ("), "p_type")).alias("cut"),
        N.trim_to_paren_boundary(F.concat(name, F.lit(" ("), "p_brand", F.lit(")  "))).alias("whole"),
        N.common_prefix(name, F.concat(F.substr(name, F.lit(1), F.col("p_size") % 9), F.lit("~~"))).alias("prefix"),
    )


# --- Bytes and digests


@query("SELECT doc_id, sha1(text) AS sha1, md5(text) AS md5, octet_length(encode(text))::BIGINT AS data_size FROM documents")
def hashes_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.table(spark, sf_dir, "documents").select("doc_id", K.file_hashes(F.col("text").cast("binary")).alias("h"))
    return rows.select("doc_id", "h.sha1", "h.md5", "h.data_size")


_CRC = """printf('%08x', xor(list_reduce(flatten([[4294967295::BIGINT], flatten(list_transform(range(octet_length(encode({0}))), lambda i:
  list_transform(range(8), lambda k: (ascii(substr({0}, i + 1, 1)) >> k) & 1)))]), lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295))"""


@query(f"SELECT c_custkey, {_CRC.format('c_name')} AS crc32 FROM customer")
def hash_crc32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "customer").select("c_custkey", K.crc32_hex(F.col("c_name").cast("binary")).alias("crc32"))


@query("SELECT source AS path, sha1(string_agg(text, '' ORDER BY doc_id)) AS sha1, md5(string_agg(text, '' ORDER BY doc_id)) AS md5, sum(octet_length(encode(text)))::BIGINT AS data_size FROM documents GROUP BY source")
def chunked_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.table(spark, sf_dir, "documents").select(F.col("source").alias("path"), F.col("doc_id").alias("seq"), F.col("text").cast("binary").alias("data"))
    return hashing.chunked_hashes(rows).drop("crc32")


@query(f"SELECT n_regionkey::VARCHAR AS path, {_CRC.format('t')} AS crc32, length(t)::BIGINT AS data_size FROM (SELECT n_regionkey, string_agg(n_name, '' ORDER BY n_nationkey) AS t FROM nation GROUP BY n_regionkey)")
def chunked_crc32(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("string").alias("path"), F.col("n_nationkey").alias("seq"), F.col("n_name").cast("binary").alias("data"))
    return hashing.mergeable_crc32(rows)


@query()
def documents_crc32(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CRC-32 of whole texts; SQL would go bit by bit."""
    rows = S.table(spark, sf_dir, "documents").select("doc_id", K.file_hashes(F.col("text").cast("binary"), "Crc32").alias("h"))
    return rows.select("doc_id", "h.crc32", "h.data_size")


@query()
def chunked_documents_crc32(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CRC-32 of each source's texts, joined from those of the documents."""
    rows = S.table(spark, sf_dir, "documents").select(F.col("source").alias("path"), F.col("doc_id").alias("seq"), F.col("text").cast("binary").alias("data"))
    return hashing.mergeable_crc32(rows)


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'MD5' WHEN 1 THEN 'SHA-1' ELSE 'own' END AS name, CASE doc_id % 3 WHEN 0 THEN md5(text) WHEN 1 THEN sha1(text) ELSE lower(hex(doc_id::VARCHAR)) END AS hex, false AS mismatch FROM documents")
def expected_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, text = F.col("doc_id") % 3, F.col("text").cast("binary")
    algorithm = F.when(k == 0, "Md5").when(k == 1, "Sha1").otherwise("own")
    value = F.when(k == 0, F.unhex(F.md5(text))).when(k == 1, F.unhex(F.sha1(text))).otherwise(F.col("doc_id").cast("string").cast("binary"))
    rows = S.table(spark, sf_dir, "documents").select("doc_id", K.expected_checksum(algorithm, value).alias("e"), text.alias("d"))
    return rows.select("doc_id", K.algorithm_name(F.col("e.algorithm")).alias("name"), K.hex_value(F.col("e")).alias("hex"), K.verify(F.col("e"), F.col("d")).isNotNull().alias("mismatch"))


_SIZE = "(o_orderkey * CASE o_orderkey % 4 WHEN 0 THEN 1048576 WHEN 1 THEN 1024 ELSE 1 END)"


@query(
    f"""SELECT o_orderkey, CASE WHEN n >= 1048576 AND n % 1048576 = 0 THEN (n // 1048576) || ' MB' WHEN n >= 1024 AND n % 1024 = 0 THEN (n // 1024) || ' KB' ELSE n || ' bytes' END AS exact,
  CASE WHEN a >= 1073741824 THEN printf('%.1f GB', a / 1073741824.0::DOUBLE) WHEN a >= 1048576 THEN printf('%.1f MB', a / 1048576.0::DOUBLE) WHEN a >= 1024 THEN printf('%.1f KB', a / 1024.0::DOUBLE) ELSE a || ' B' END AS approx
FROM (SELECT o_orderkey, {_SIZE} AS n, o_orderkey * 64 * CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 1009 ELSE 1000003 END AS a FROM orders)"""
)
def sizes_for_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    n = k * F.when(k % 4 == 0, 1048576).when(k % 4 == 1, 1024).otherwise(1)
    a = k * 64 * F.when(k % 3 == 0, 1).when(k % 3 == 1, 1009).otherwise(1000003)
    return S.table(spark, sf_dir, "orders").select("o_orderkey", B.format_bytes(n).alias("exact"), B.format_bytes_approx(a).alias("approx"))


@query(
    r"""SELECT doc_id, regexp_replace(text, '[^\x20-\x7E]', '', 'g') AS ascii,
  trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\x{10000}-\x{10FFFF}]', '    ', 'g'), '[\x{800}-\x{FFFF}]', '   ', 'g'), '[\x{80}-\x{7FF}]', '  ', 'g'), '[^\x20-\x7E]', ' ', 'g'), ' ') AS fixed,
  rtrim(text, ' ' || chr(9) || chr(10) || chr(13)) AS padded FROM documents"""
)
def read_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.col("text").cast("binary")
    zero = F.concat(data, F.lit(b"\x00tail"))
    return S.table(spark, sf_dir, "documents").select("doc_id", B.read_ascii(zero).alias("ascii"), B.read_ascii_fixed(data).alias("fixed"), B.read_padded(F.concat(data, F.lit(b"  \n"))).alias("padded"))


@query("SELECT o_orderkey, (o_orderkey * 2654435761) % 4294967296 AS le, ((o_orderkey * 2654435761) % 65536) AS le16 FROM orders")
def little_endian(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = S.le32(F.col("o_orderkey") * 2654435761 % 4294967296)
    return S.table(spark, sf_dir, "orders").select("o_orderkey", B.unsigned_le(data, 0, 4).alias("le"), B.unsigned_le(data, 0, 2).alias("le16"))


# --- Images


@query(
    """SELECT p_partkey AS path, CASE p_partkey % 6 WHEN 0 THEN 'Chd' WHEN 1 THEN 'RawSector2352' WHEN 2 THEN 'Cue' WHEN 3 THEN 'Iso2048' END AS format,
  CASE p_partkey % 6 WHEN 0 THEN 'CHD' WHEN 1 THEN 'Raw BIN (2352)' WHEN 2 THEN 'CUE Sheet' WHEN 3 THEN 'ISO 9660' END AS name,
  CASE p_partkey % 6 WHEN 0 THEN 'chd' WHEN 1 THEN 'bin' WHEN 2 THEN 'cue' WHEN 3 THEN 'iso' END AS extension,
  CASE p_partkey % 6 WHEN 4 THEN 'TooSmall' WHEN 5 THEN 'InvalidFormat' END AS error FROM part"""
)
def detect_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    fmt, err = images.detect_format(F.col("content"))
    rows = S.heads(spark, sf_dir).select("path", fmt.alias("format"), err.alias("e"))
    f = F.col("format")
    return rows.select("path", "format", images.format_name(f).alias("name"), images.format_extension(f).alias("extension"), F.col("e.kind").alias("error"))


@query("SELECT n_name AS path, 'PLAYER' AS system_identifier, n_name AS volume_identifier, 1000 + n_nationkey::BIGINT AS volume_space_size, 18::BIGINT AS root_dir_extent_lba, 2048::BIGINT AS root_dir_data_length FROM nation")
def volume_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.volumes(S.volume_sectors(spark, sf_dir)).where("error is null").select("path", "pvd.*")


@query(
    """SELECT n_name AS path, pos, lba::BIGINT AS extent_lba, len::BIGINT AS data_length, 0::BIGINT AS file_flags, id AS file_identifier FROM nation,
LATERAL (VALUES (0, 18, 2048, '.'), (34, 18, 2048, '..'), (68, 20, 2048 + n_nationkey, 'f' || n_nationkey || '.txt;1')) AS r(pos, lba, len, id)"""
)
def directory_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.directory(S.volume_sectors(spark, sf_dir)).drop("sector")


@query(
    """SELECT n_name AS path, 'F' || n_nationkey || '.TXT' AS filename, md5(left(repeat(n_name, 2048), 2048 + n_nationkey)) AS content, NULL::VARCHAR AS error FROM nation
UNION ALL SELECT n_name, 'missing', NULL, 'File ''missing'' not found in root directory' FROM nation"""
)
def find_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    sectors = S.volume_sectors(spark, sf_dir)
    n = S.table(spark, sf_dir, "nation")
    wanted = n.select(F.col("n_name").alias("path"), F.explode(F.array(F.format_string("F%d.TXT", "n_nationkey"), F.lit("missing"))).alias("filename"))
    rows = images.file_contents(sectors, images.find_files(sectors, wanted))
    return rows.select("path", "filename", F.md5("content").alias("content"), F.col("error.message").alias("error"))


@query("SELECT n_name AS path, s AS sector, md5(d) AS data, CASE WHEN d IS NULL THEN 'CorruptedHeader' END AS error FROM (SELECT n_name, s, CASE WHEN s < 2 THEN repeat(chr((65 + s)::INT), 2048) END AS d FROM nation, (SELECT unnest([0, 1, 2])::BIGINT AS s))")
def numbered_sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.when(F.col("n_nationkey") % 2 == 0, F.lit(b"A" * 2048 + b"B" * 2048)).otherwise(F.lit(bytes(16) + b"A" * 2048 + bytes(288 + 16) + b"B" * 2048 + bytes(288)))
    rows = S.table(spark, sf_dir, "nation").select(F.col("n_name").alias("path"), content.alias("c"), F.when(F.col("n_nationkey") % 2 == 0, "Iso2048").otherwise("RawSector2352").alias("f"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(2).cast("bigint"))).alias("sector"))
    data, err = images.sector_data_mode1(F.col("c"), F.col("sector"), F.col("f"))
    return rows.select("path", "sector", F.md5(data).alias("data"), err["kind"].alias("error"))


@query(
    """SELECT s_name AS path, CASE WHEN s_nationkey % 5 <> 0 THEN 150 + k END AS sector, CASE WHEN s_nationkey % 5 <> 0 THEN 588 END AS n, CASE WHEN s_nationkey % 5 <> 0 THEN (s_suppkey * 196608) % 4294967296 + s_nationkey END AS first,
  CASE WHEN s_nationkey % 5 <> 0 THEN 0::BIGINT END AS last, CASE WHEN s_nationkey % 5 = 0 THEN 'InvalidFormat' END AS error
FROM supplier, (SELECT unnest(range(4)) AS k) WHERE k <= CASE WHEN s_nationkey % 5 = 0 THEN 0 ELSE s_nationkey % 4 END"""
)
def pcm_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pcm.track_samples(*S.audio_sectors(spark, sf_dir))
    return rows.select("path", "sector", F.size("samples").alias("n"), F.get("samples", F.lit(0)).alias("first"), F.get("samples", F.lit(587)).alias("last"), F.col("error.kind").alias("error"))


@query("SELECT s_name AS path, (s_nationkey % 4 + 1)::BIGINT * 588 AS total FROM supplier")
def total_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, tracks = S.audio_sectors(spark, sf_dir)
    return tracks.select("path", pcm.total_samples(F.col("length_sectors")).alias("total"))


# --- Files that are read back from the shared folder


@query("SELECT n_nationkey::VARCHAR AS path, 21 * CASE WHEN n_nationkey % 2 = 0 THEN 2048 ELSE 2352 END::BIGINT AS length, CASE WHEN n_nationkey % 2 = 0 THEN 'Iso2048' ELSE 'RawSector2352' END AS format FROM nation")
def stored_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored.read(spark, sf_dir, "image", "head")
    return rows.select("path", "length", images.detect_format(F.col("head"), F.col("length"))[0].alias("format"))


@query("SELECT n_nationkey::VARCHAR AS path, n_name AS volume_identifier, 21::BIGINT AS volume_space_size, 18::BIGINT AS root_dir_extent_lba FROM nation WHERE n_nationkey % 2 = 1")
def stored_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the descriptor's sector of each raw image is read."""
    rows = images.volumes(stored.read(spark, sf_dir, "image", "sectors").where("sector = 16")).where("error is null")
    return rows.select("path", "pvd.volume_identifier", "pvd.volume_space_size", "pvd.root_dir_extent_lba")


@query("SELECT n_nationkey::VARCHAR AS path, 5::BIGINT AS version, 19584::BIGINT AS hunk_size, 3::BIGINT AS total_hunks, 51408::BIGINT AS logical_size, 2448::BIGINT AS unit_bytes, NULL::VARCHAR AS error FROM nation")
def container_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored.read(spark, sf_dir, "container", "chd_info").withColumn("error", F.col("error.kind"))


@query("SELECT n_nationkey::VARCHAR AS path, s AS sector, md5(left(repeat(n_name, 2100), 2049 + n_nationkey)[1 + 2048 * (s - 19):2048 * (s - 18)]) AS data FROM nation, (SELECT unnest([19, 20])::BIGINT AS s)")
def container_sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User data of two sectors, without what fills the last."""
    rows = stored.read(spark, sf_dir, "container", "chd_sectors").where("sector >= 19 and sector < 21 and error is null")
    data = images.user_data(F.col("raw"))
    size = F.when(F.col("sector") == 19, 2048).otherwise(F.col("path").cast("int") + 1)
    return rows.select("path", "sector", F.md5(F.substr(data, F.lit(1), size)).alias("data"))


@query(
    """SELECT n_nationkey::VARCHAR AS path, t AS number, CASE t WHEN 1 THEN 150 ELSE 171 END::BIGINT AS absolute_offset, CASE t WHEN 1 THEN 21 ELSE n_nationkey + 1 END::BIGINT AS length_sectors, NULL::VARCHAR AS error
FROM nation, (SELECT unnest([1, 2])::BIGINT AS t) WHERE n_nationkey % 5 <> 0 UNION ALL SELECT n_nationkey::VARCHAR, NULL, NULL, NULL, 'InvalidFormat' FROM nation WHERE n_nationkey % 5 = 0"""
)
def container_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth container has no tracks."""
    at = stored.written(spark, sf_dir, "container")
    load = lambda source: spark.read.format(source).option("path", at).load()
    rows = layout.read_chd_layout(load("chd_meta"), load("chd_info"))
    return rows.select(stored.key(F.col("path")).alias("path"), "number", "absolute_offset", "length_sectors", F.col("error.kind").alias("error"))


@query("SELECT n_nationkey::VARCHAR AS path, md5(left(repeat(n_name, 2100), 2049 + n_nationkey)) AS content FROM nation")
def container_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptor, directory and file of the volume in each container."""
    sectors = stored.read(spark, sf_dir, "container", "chd_sectors").where("error is null").drop("error")
    wanted = S.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("path"), F.format_string("f%d.txt", "n_nationkey").alias("filename"))
    return images.file_contents(sectors, images.find_files(sectors, wanted)).select("path", F.md5("content").alias("content"))


@query("SELECT n_nationkey::VARCHAR AS path, t AS number, CASE t WHEN 1 THEN 150 ELSE 152 END::BIGINT AS absolute_offset, CASE t WHEN 1 THEN 2 ELSE n_nationkey + 1 END::BIGINT AS length_sectors FROM nation, (SELECT unnest([1, 2])::BIGINT AS t)")
def folder_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets and sizes of a folder; no image is opened."""
    at = stored.written(spark, sf_dir, "sheet")
    found = sheets.read_sheets(spark, at)
    rows = layout.read_layout(found, sheets.sizes_for(found, sheets.file_sizes(spark, at))).where("error is null")
    return rows.select(stored.key(F.col("path")).alias("path"), F.col("number").cast("bigint").alias("number"), "absolute_offset", "length_sectors")
