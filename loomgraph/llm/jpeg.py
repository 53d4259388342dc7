"""The luma plane of baseline JPEG frames, as motion-JPEG files of other writers hold them."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np

#: The Huffman tables that a motion-JPEG frame without tables of its own uses (ITU T.81, Annex K), as the
#: number of codes of each length from 1 to 16, and the symbols in order.
DC_LUMA = bytes.fromhex("00010501010101010100000000000000"), bytes(range(12))
DC_CHROMA = bytes.fromhex("00030101010101010101010000000000"), bytes(range(12))
AC_LUMA = bytes.fromhex("0002010303020403050504040000017d"), bytes.fromhex(
    "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a"
    "434445464748494a535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aa"
    "b2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa"
)
AC_CHROMA = bytes.fromhex("00020102040403040705040400010277"), bytes.fromhex(
    "0001020311040521310612415107617113223281081442 91a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a"
    "434445464748494a535455565758595a636465666768696a737475767778797a82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aa"
    "b2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa"
)


def codes(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    """(length, code) of each symbol: codes of a length follow each other, and double with each further bit."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for symbol in symbols[at : at + n]:
            out[length, code] = symbol
            code += 1
        at += n
        code <<= 1
    return out


class Bits:
    """Bits of entropy-coded bytes, highest first; zeros after the end."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> int:
        first, last = self.at >> 3, (self.at + n + 7) >> 3
        chunk = self.data[first:last].ljust(last - first, b"\0")
        self.at += n
        return (int.from_bytes(chunk, "big") >> (8 * last - self.at)) & ((1 << n) - 1)

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            if (length, code) in table:
                return table[length, code]
        raise ValueError("no such code")

    def signed(self, size: int) -> int:
        value = self.take(size) if size else 0
        return value if not size or value >> (size - 1) else value - (1 << size) + 1


def segments(frame: bytes) -> Iterator[tuple[int, bytes, int]]:
    """(marker, body, place after it) up to and with the start of the scan."""
    at = 2
    while at + 4 <= len(frame):
        if frame[at] != 0xFF:
            raise ValueError("no marker where one should be")
        marker = frame[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        length = struct.unpack_from(">H", frame, at + 2)[0]
        yield marker, frame[at + 4 : at + 2 + length], at + 2 + length
        at += 2 + length
        if marker == 0xDA:
            return


def luma(frame: bytes, basis: np.ndarray) -> np.ndarray:
    """The first component of a baseline frame, rows by columns. basis: coefficients in zigzag order to pixels.

    Any quantisation, Huffman tables, sampling and restart intervals; one scan of all components. Progressive and
    lossless frames, and ones that are cut short before their scan, raise a ValueError.
    """
    quant: dict[int, np.ndarray] = {}
    huffman = {0x00: codes(*DC_LUMA), 0x01: codes(*DC_CHROMA), 0x10: codes(*AC_LUMA), 0x11: codes(*AC_CHROMA)}
    parts, scan, restart, height, width, start = [], b"", 0, 0, 0, None
    for marker, body, after in segments(frame):
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 128 if wide else 64
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.float32)
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                huffman[body[0]] = codes(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker in (0xC0, 0xC1):
            height, width = struct.unpack_from(">HH", body, 1)
            parts = [(body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * body[5], 3)]
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("only baseline frames are decoded")
        elif marker == 0xDD:
            restart = struct.unpack(">H", body[:2])[0]
        elif marker == 0xDA:
            scan, start = body, after
    if start is None or not parts or scan[0] != len(parts) or not height or not width:
        raise ValueError("no frame with one scan of all its components")
    tables = {scan[1 + 2 * k]: scan[2 + 2 * k] for k in range(scan[0])}
    single = len(parts) == 1
    across, down = (1, 1) if single else (max(p[1] for p in parts), max(p[2] for p in parts))
    columns, rows = -(-width // (8 * across)), -(-height // (8 * down))
    _, wide, tall, table = parts[0]
    wide, tall = (1, 1) if single else (wide, tall)
    found = np.zeros((rows * tall, columns * wide, 64), np.float32)
    end = frame.rfind(b"\xff\xd9")
    data = frame[start : end if end > start else len(frame)]
    intervals = re.split(rb"\xff[\xd0-\xd7]", data) if restart else [data]
    unit = 0
    for k, interval in enumerate(intervals):
        bits, before = Bits(interval.replace(b"\xff\0", b"\xff")), dict.fromkeys(tables, 0)
        unit = k * restart
        for unit in range(unit, min(unit + restart, rows * columns) if restart else rows * columns):
            for index, (name, h, v, _) in enumerate(parts):
                for block in range(1 if single else h * v):
                    values = np.zeros(64, np.float32) if not index else None
                    before[name] += bits.signed(bits.symbol(huffman[tables[name] >> 4]))
                    at = 1
                    if values is not None:
                        values[0] = before[name]
                    while at < 64:
                        symbol = bits.symbol(huffman[0x10 | tables[name] & 15])
                        run, size = symbol >> 4, symbol & 15
                        if not size and run < 15:
                            break
                        at += run
                        value = bits.signed(size)
                        if values is not None and at < 64:
                            values[at] = value
                        at += 1
                    if values is not None:
                        found[unit // columns * tall + block // wide, unit % columns * wide + block % wide] = values
    pixels = np.clip(np.rint((found * quant[table]).reshape(-1, 64) @ basis + 128), 0, 255).astype(np.uint8)
    plane = pixels.reshape(rows * tall, columns * wide, 8, 8).swapaxes(1, 2).reshape(rows * tall * 8, columns * wide * 8)
    return plane[: -(-height * tall // down), : -(-width * wide // across)]
