"""Small images made in memory, for tests and trials: volumes, directories, raw sectors."""

from __future__ import annotations

import struct

from .constants import CD_SYNC, CHD_MAGIC, ISO_SECTOR, RAW_SECTOR

#: Sectors of the parts of :func:`volume`.
DESCRIPTOR_AT, ROOT_AT, FIRST_FILE_AT = 16, 18, 19


def directory_record(name: bytes, sector: int, size: int, flags: int = 0) -> bytes:
    """An ISO 9660 directory record; numbers in little-endian form only."""
    body = struct.pack("<BIIII7xB6xB", 0, sector, 0, size, 0, flags, len(name)) + name
    return bytes([len(body) + 1]) + body


def descriptor_sector(system: str = "PLATTERLAKE", volume: str = "FIXTURE", sectors: int = 100) -> bytes:
    """A primary volume descriptor whose root directory is one sector."""
    out = bytearray(ISO_SECTOR)
    out[:7] = b"\x01CD001\x01"
    out[8:40], out[40:72] = system.encode().ljust(32)[:32], volume.encode().ljust(32)[:32]
    struct.pack_into("<I", out, 80, sectors)
    root = directory_record(b"\0", ROOT_AT, ISO_SECTOR)
    out[156 : 156 + len(root)] = root
    return bytes(out)


def volume(files: dict[str, bytes] | None = None, system: str = "PLATTERLAKE", name: str = "FIXTURE") -> bytes:
    """A plain image with the files in its root directory, each from a sector of its own on."""
    records, body, at = [directory_record(b"\0", ROOT_AT, ISO_SECTOR), directory_record(b"\1", ROOT_AT, ISO_SECTOR)], b"", FIRST_FILE_AT
    for key, content in (files or {}).items():
        records.append(directory_record(f"{key};1".encode(), at, len(content)))
        body += content.ljust(-(-len(content) // ISO_SECTOR) * ISO_SECTOR, b"\0")
        at = FIRST_FILE_AT + len(body) // ISO_SECTOR
    root = b"".join(records)
    if len(root) > ISO_SECTOR:
        raise ValueError("the root directory is one sector")
    return bytes(DESCRIPTOR_AT * ISO_SECTOR) + descriptor_sector(system, name, at) + bytes(ISO_SECTOR) + root.ljust(ISO_SECTOR, b"\0") + body


def raw_sector(data: bytes, mode: int = 2) -> bytes:
    """A raw sector around 2048 bytes of user data: mode 1, or mode 2 form 1."""
    before = CD_SYNC + bytes([0, 2, 0, mode]) + bytes(8 if mode == 2 else 0)
    return (before + data.ljust(ISO_SECTOR, b"\0")[:ISO_SECTOR]).ljust(RAW_SECTOR, b"\0")


def raw_image(plain: bytes, mode: int = 2) -> bytes:
    """A plain image in raw sectors."""
    return b"".join(raw_sector(plain[i : i + ISO_SECTOR], mode) for i in range(0, len(plain), ISO_SECTOR))


def container(units: list[bytes], tags: list[tuple[bytes, bytes]] = (), per_hunk: int = 8) -> bytes:
    """A compressed-hunk container, version 5, whose hunks are stored plainly; the units have one length."""
    size = len(units[0])
    hunk = size * per_hunk
    data = b"".join(units)
    hunks = -(-len(data) // hunk)
    entries, at = b"", 124
    for i, (tag, text) in enumerate(tags):
        following = at + len(entries) + 16 + len(text) if i + 1 < len(tags) else 0
        entries += tag + struct.pack(">IQ", len(text), following) + text
    map_at = at + len(entries)
    first = -(-(map_at + 4 * hunks) // hunk)
    head = CHD_MAGIC + struct.pack(">II16xQQQII", 124, 5, len(data), map_at, at if tags else 0, hunk, size)
    body = head.ljust(at, b"\0") + entries + b"".join(struct.pack(">I", first + i) for i in range(hunks))
    return body.ljust(first * hunk, b"\0") + data.ljust(hunks * hunk, b"\0")
