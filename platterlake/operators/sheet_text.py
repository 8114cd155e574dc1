"""A cue sheet read line by line: plain functions of one text, and the Arrow functions that run them on columns.

A sheet is one value, so what a sequential reader remembers stays within its row:
nothing is dealt, sorted or kept beyond it, and the work is linear in the text.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import DISC_TYPES, EXTRA_DIRECTIVES, FILE_TYPES, LEAD_IN, RAW_SECTOR, SECTOR_SIZES, STANDARD_MODES

NO_FILE = "CUE sheet contains no FILE entries"
OPEN_QUOTE = "Unterminated quote in CUE FILE line"
NO_TRACKS = "CUE has no tracks after parsing"
NO_OUTPUT = "CUE sheet produced no output after conversion"
BYTE_OFFSET = "AUDIOFILE with byte offset (#) cannot be converted to standard CUE"
TOO_MANY = "CUE sheet has more than 255 TRACK lines"
UNFIXABLE = "AUDIOFILE with byte offset (#) cannot be converted to standard CUE without splitting the audio file"

#: White space of any script, as Java's ``(?U)\s`` has it.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACES = re.compile(f"[{SPACE}]+")
_NUMBER = re.compile(r"[+]?0*([0-9]{1,18})\Z")
_MSF = re.compile(r"[+]?0*([0-9]{1,18}):[+]?0*([0-9]{1,18}):[+]?0*([0-9]{1,18})\Z")
_QUOTED = re.compile('"([^"]*)"')
_MAX_U32 = 4294967295
_FILES = frozenset(("FILE", "DATAFILE", "AUDIOFILE"))
_KINDS = _FILES | {"TRACK", "INDEX", "PREGAP", "POSTGAP"}
_EXTRA_STARTS = tuple(f"{word} " for word in EXTRA_DIRECTIVES)
#: Lines that were read are remembered if they are short: sheets repeat each other's.
_SHORT, _REMEMBERED = 200, 1 << 14


def unsigned(text: str | None, limit: int) -> int | None:
    m = _NUMBER.match(text) if text is not None else None
    n = int(m[1]) if m else None
    return n if n is not None and n <= limit else None


def msf_parts(text: str | None) -> tuple[int, int, int] | None:
    """Minutes, seconds and frames, or nothing unless all three are numbers in range."""
    m = _MSF.match(text) if text is not None else None
    parts = (int(m[1]), int(m[2]), int(m[3])) if m else None
    return parts if parts and max(parts) <= _MAX_U32 else None


def sectors(msf: tuple[int, int, int]) -> int:
    return (msf[0] * 60 + msf[1]) * 75 + msf[2]


def file_parts(line: str, kind: str) -> tuple[str, str, bool]:
    """Name, what follows it, and whether its quote is open, of a FILE, DATAFILE or AUDIOFILE line."""
    rest = line[len(kind) + 1 :]
    if not rest.startswith('"'):
        name, _, after = rest.partition(" ")
        return name, after.strip(SPACE), False
    m = _QUOTED.match(rest)
    return (m[1], rest[m.end() :].strip(SPACE), False) if m else ("", rest.strip(SPACE), True)


def track_parts(line: str) -> tuple[int | None, str | None]:
    """Number, if there is one, and mode of a TRACK line."""
    words = _SPACES.split(line)
    number = unsigned(words[1], 255) if len(words) >= 3 else None
    return (number, words[2]) if number is not None else (None, words[1] if len(words) > 1 else None)


def index_parts(line: str) -> tuple[int | None, tuple[int, int, int] | None]:
    """Number and time code of an INDEX line; each may be missing."""
    words = _SPACES.split(line)
    return unsigned(words[1], 255) if len(words) > 1 else None, msf_parts(words[2]) if len(words) > 2 else None


class Line:
    """A line that is not blank, trimmed; what ``parts`` are depends on its kind."""

    __slots__ = ("kind", "line", "parts", "upper")

    def __init__(self, line: str) -> None:
        self.line, self.upper, self.parts = line, line.upper(), None
        word, space, _ = self.upper.partition(" ")
        self.kind = kind = "COMMENT" if line.startswith("//") else word if space and word in _KINDS else "OTHER"
        if kind in _FILES:
            self.parts = file_parts(line, kind)
        elif kind == "TRACK":
            self.parts = track_parts(line)
        elif kind == "INDEX":
            self.parts = index_parts(line)


def _read(raw: str) -> Line | None:
    line = raw.strip(SPACE)
    return Line(line) if line else None


_read_short = functools.lru_cache(_REMEMBERED)(_read)


def lines(text: str | None) -> list[tuple[int, Line]]:
    """Non-blank lines with their numbers in the sheet."""
    if text is None:
        return []
    return [(p, x) for p, raw in enumerate(text.split("\n")) if (x := _read_short(raw) if len(raw) < _SHORT else _read(raw))]


class Sheet:
    """files (name, type), tracks (owner, ordinal, number, mode), indexes (ordinal, p, number, msf), problem."""

    __slots__ = ("files", "indexes", "problem", "tracks")

    def __init__(self, text: str | None) -> None:
        self.files, self.tracks, self.indexes = [], [], []
        broken = False
        last_owner = None
        for p, x in lines(text):
            kind = x.kind
            if kind in _FILES:
                name, after, open_ = x.parts
                broken |= open_
                self.files.append((name, "BINARY" if kind == "DATAFILE" else after))
            elif kind == "TRACK":
                last_owner = len(self.files) or 1  # tracks before the first file belong to it
                ordinal = len(self.tracks) + 1
                number, mode = x.parts
                self.tracks.append((last_owner, ordinal, ordinal if number is None else number, mode))
            elif kind == "INDEX" and last_owner == (len(self.files) or 1):
                number, msf = x.parts
                if number is not None and msf is not None:
                    self.indexes.append((len(self.tracks), p, number, msf))
        self.problem = OPEN_QUOTE if broken else NO_FILE if not self.files else TOO_MANY if len(self.tracks) > 255 else None


def files(text: str | None) -> Iterator[tuple]:
    s = Sheet(text)
    if not s.problem:
        yield from ((i, *f) for i, f in enumerate(s.files, 1))


def tracks(text: str | None) -> list[tuple]:
    s = Sheet(text)
    return [] if s.problem else s.tracks


def indexes(text: str | None) -> Iterator[tuple]:
    s = Sheet(text)
    if not s.problem:
        yield from ((ordinal, p, number, *msf, sectors(msf)) for ordinal, p, number, msf in s.indexes)


def errors(text: str | None) -> list[tuple]:
    problem = Sheet(text).problem
    return [(problem,)] if problem else []


def _extra(upper: str) -> bool:
    return upper in EXTRA_DIRECTIVES or upper.startswith(_EXTRA_STARTS)


def compatibility(text: str | None) -> tuple:
    """Last disc type, numbers and names of extended modes, and whether there is a DATAFILE, an AUDIOFILE, an extra
    directive, a comment, an AUDIOFILE with a byte offset."""
    return _compatibility(lines(text))


def _compatibility(read: list[tuple[int, Line]]) -> tuple:
    disc_type, numbers, modes = None, [], []
    datafile = audiofile = extra = comment = offset = False
    auto = 0
    for _, x in read:
        kind = x.kind
        if kind == "TRACK":
            auto += 1
            number, mode = x.parts
            if mode is not None and mode.upper() in STANDARD_MODES:
                numbers.append(auto if number is None else number)
                modes.append(mode)
        elif kind == "COMMENT":
            comment = True
        elif kind == "DATAFILE":
            datafile = True
        elif kind == "AUDIOFILE":
            audiofile = True
            offset |= "#" in x.line
        elif kind == "OTHER":
            if x.upper in DISC_TYPES:
                disc_type = x.upper
            extra = extra or _extra(x.upper)
    return disc_type, numbers, modes, datafile, audiofile, extra, comment, offset


def _size_of(mode: str | None) -> int:
    return RAW_SECTOR if mode is None else SECTOR_SIZES.get(mode.upper(), RAW_SECTOR)


def _file_type(kind: str, upper: str, rest: str) -> str:
    if kind != "FILE":
        return "WAVE" if kind == "AUDIOFILE" else "BINARY"
    if rest == "" or rest.startswith("#"):
        return "WAVE" if ".WAV" in upper else "BINARY"
    word = _SPACES.split(rest, maxsplit=1)[0]
    return word if word.upper() in FILE_TYPES else "BINARY"


def convert(text: str | None) -> tuple[str | None, str | None]:
    """The sheet in the standard dialect, or why it has none.

    Tracks wait for the next FILE, DATAFILE or AUDIOFILE line: they go before its own
    output for FILE and at the sheet's end, after it for the others.
    """
    return _convert(lines(text))


def _convert(read: list[tuple[int, Line]]) -> tuple[str | None, str | None]:
    out: list[str] = []
    waiting: list[tuple[int, str | None, list[str]]] = []
    known: set[str] = set()
    last = ("", "")  # kind and name of the last file line
    filled = auto = 0  # bytes of the run of DATAFILE lines of one name
    mode = None

    def let_go(filled: int = 0) -> None:
        for i, (number, of, own) in enumerate(waiting):
            out.append(f"  TRACK {number:02d} {of}")
            if not own:
                n = filled // _size_of(of) if i == 0 else 0
                own = [f"    INDEX 01 {n // 4500:02d}:{n // 75 % 60:02d}:{n % 75:02d}"]
            out.extend(own)
        waiting.clear()

    for _, x in read:
        kind = x.kind
        if kind == "TRACK":
            auto += 1
            number, mode = x.parts
            mode = mode and STANDARD_MODES.get(mode.upper(), mode)
            waiting.append((auto if number is None else number, mode, []))
        elif kind in _FILES:
            name, rest, broken = x.parts
            if broken:
                return None, OPEN_QUOTE
            if kind == "AUDIOFILE" and "#" in x.line:
                return None, BYTE_OFFSET
            if kind != "DATAFILE" or last != (kind, name):
                filled = 0
            shown = not (kind == "DATAFILE" and waiting and name in known)
            if kind == "FILE":
                let_go()
            if shown:
                out.append(f'FILE "{name}" {_file_type(kind, x.upper, rest)}')
            if kind != "FILE":
                let_go(filled)
            if kind == "DATAFILE":
                msf = msf_parts(rest.partition("//")[0].strip(SPACE))
                filled += sectors(msf) * _size_of(mode) if msf else 0
            known.add(name)
            last = (kind, name)
        elif kind in _KINDS:
            (waiting[-1][2] if waiting else out).append(f"    {x.line}")
    let_go()
    return ("\n".join(out) + "\n", None) if out else (None, NO_OUTPUT)


def standardize(text: str | None) -> tuple[str | None, str | None]:
    """A standard sheet as it is, another converted, or why there is none."""
    read = lines(text)
    disc_type, numbers, _, datafile, audiofile, extra, comment, offset = _compatibility(read)
    if disc_type is None and not (numbers or datafile or audiofile or extra or comment):
        return text, None
    return (None, UNFIXABLE) if offset else _convert(read)


def _layout_problem(s: Sheet, begins: list, lengths: list, sizes: dict) -> tuple[str, str] | None:
    """Kind and message of the first problem, in order of the files, of: size, alignment, missing INDEX 01, negative length."""
    found = None
    for i, (owner, ordinal, number, _) in enumerate(s.tracks):
        name = s.files[owner - 1][0]
        size = sizes.get(name)
        if size is None:
            step, told = 0, ("Io", f"BIN '{name}': not found")
        elif size % RAW_SECTOR:
            step, told = 0, ("InvalidFormat", f"BIN file '{name}' size {size} is not a multiple of {RAW_SECTOR}")
        elif begins[i] is None:
            step, told = 1, ("InvalidFormat", f"track {number} missing INDEX 01 in CUE")
        elif lengths[i] < 0:
            last = i + 1 == len(s.tracks) or s.tracks[i + 1][0] != owner
            step, told = 2, ("InvalidFormat", f"BIN '{name}' ends before track {number}'s INDEX 01" if last else "CUE INDEX 01 offsets are not monotonically increasing")
        else:
            continue
        if found is None or (owner, step, ordinal) < found[0]:
            found = (owner, step, ordinal), told
    return found and found[1]


def layout(text: str | None, names: list | None, sizes: list | None) -> list[tuple]:
    """Per track: ordinal, number, absolute_offset, length_sectors, mode, null, null; or one row with the kind and message of an error alone."""
    bad = lambda kind, message: [(None, None, None, None, None, kind, message)]
    s = Sheet(text)
    if s.problem or not s.tracks:
        return bad("InvalidFormat", s.problem or NO_TRACKS)
    of = dict(zip(names or (), sizes or (), strict=True))
    begins: list[int | None] = [None] * len(s.tracks)
    for ordinal, _, number, msf in s.indexes:
        if number == 1 and begins[ordinal - 1] is None:
            begins[ordinal - 1] = sectors(msf)
    lengths = []
    for i, (owner, *_) in enumerate(s.tracks):
        end = begins[i + 1] if i + 1 < len(s.tracks) and s.tracks[i + 1][0] == owner else None
        if end is None:
            size = of.get(s.files[owner - 1][0])
            end = None if size is None else size // RAW_SECTOR
        lengths.append(None if end is None or begins[i] is None else end - begins[i])
    problem = _layout_problem(s, begins, lengths, of)
    if problem:
        return bad(*problem)
    at, rows = LEAD_IN + begins[0], []
    for (_, ordinal, number, mode), length in zip(s.tracks, lengths, strict=True):
        rows.append((ordinal, number, at, length, mode, None, None))
        at += length
    return rows


def read_layout(text: str | None, names: list | None, sizes: list | None) -> list[tuple]:
    made, problem = standardize(text)
    return [(None, None, None, None, None, "InvalidFormat", problem)] if problem else layout(made, names, sizes)


# --- On columns


def _values(column: pa.Array) -> list:
    """Values of a column; bytes that are no UTF-8 are kept as lone surrogates."""
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        flat, lengths = iter(_values(column.flatten())), column.value_lengths().to_numpy(zero_copy_only=False).tolist()
        valid = column.is_valid().to_numpy(zero_copy_only=False).tolist()
        return [list(itertools.islice(flat, int(n))) if some else None for n, some in zip(lengths, valid, strict=True)]
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        return column.to_pylist()
    data = column.view(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_numpy(zero_copy_only=False)
    return [None if b is None else b.decode("utf-8", "surrogateescape") for b in data.tolist()]


_TYPES = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}


def _column(values: tuple | list, kind: str) -> pa.Array:
    try:
        return pa.array(values, _TYPES[kind])
    except UnicodeEncodeError:
        if kind == "array<string>":
            lengths = [len(v) for v in values]
            return pa.ListArray.from_arrays(pa.array(itertools.accumulate(lengths, initial=0), pa.int32()), _column([x for v in values for x in v], "string"))
        return pa.array([None if v is None else v.encode("utf-8", "surrogateescape") for v in values], pa.binary()).view(pa.string())


def rows(each: Callable, fields: dict[str, str], *columns: Column | str) -> Column:
    """Array of structs: what ``each`` gives for a row's values."""
    names, kinds = list(fields), list(fields.values())

    def run(columns: tuple[pa.Array, ...]) -> pa.Array:
        flat: list[tuple] = []
        ends = [0]
        for values in zip(*(_values(c) for c in columns), strict=True):
            flat.extend(each(*values))
            ends.append(len(flat))
        made = zip(*flat, strict=True) if flat else [()] * len(kinds)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([_column(v, k) for v, k in zip(made, kinds, strict=True)], names))

    def of_text(a: pa.Array) -> pa.Array:
        return run((a,))

    def of_text_and_sizes(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
        return run((a, b, c))

    kind = f"array<struct<{','.join(f'{n}:{k}' for n, k in fields.items())}>>"
    return F.arrow_udf(of_text if len(columns) == 1 else of_text_and_sizes, kind)(*columns)
