"""Fixed values of CD images (public standards) and closed vocabularies."""

CD_SYNC = bytes([0] + [255] * 10 + [0])
ISO_SECTOR, RAW_SECTOR = 2048, 2352
MODE1_OFFSET, MODE2_FORM1_OFFSET = 16, 24
VOLUME_SECTOR = 16
SECTOR_MODE_AT, SECTOR_SUBMODE_AT, SECTOR_USER_DATA_AT = 15, 18, 24
CHD_MAGIC = b"MComprHD"
CHD_CD_SECTOR = 2448
LEAD_IN = 150
FRAMES_PER_SECOND = 75
SAMPLES_PER_SECTOR = 588
MAX_FILE = 256 * 1024 * 1024

ISO, RAW, CUE, CHD = "Iso2048", "RawSector2352", "Cue", "Chd"
FORMAT_NAMES = {ISO: "ISO 9660", RAW: "Raw BIN (2352)", CUE: "CUE Sheet", CHD: "CHD"}
FORMAT_EXTENSIONS = {ISO: "iso", RAW: "bin", CUE: "cue", CHD: "chd"}

#: Disc types and directives of the extended cue dialect, and its track modes with their standard names.
DISC_TYPES = ("CD_ROM_XA", "CD_ROM", "CD_DA")
EXTRA_DIRECTIVES = ("NO COPY", "NO PRE_EMPHASIS", "TWO_CHANNEL_AUDIO", "SILENCE", "START", "ZERO")
STANDARD_MODES = {"MODE2_RAW": "MODE2/2352", "MODE1_RAW": "MODE1/2352", "MODE2_FORM1": "MODE2/2048", "MODE2_FORM2": "MODE2/2324", "MODE2_FORM_MIX": "MODE2/2336"}
#: Bytes of a sector by mode, where not 2352.
SECTOR_SIZES = {"MODE1/2048": 2048, "MODE2_FORM1": 2048, "MODE2/2048": 2048, "MODE2/2324": 2324, "MODE2_FORM2": 2324, "MODE2/2336": 2336, "MODE2": 2336, "MODE2_FORM_MIX": 2336}
FILE_TYPES = ("BINARY", "MOTOROLA", "AIFF", "WAVE", "MP3")
