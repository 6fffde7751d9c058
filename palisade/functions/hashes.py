"""Hashes of files that other programs write: CRC-32C of bytes, keyed SipHash of many values at once."""

from __future__ import annotations

import numpy as np

# The reflected Castagnoli polynomial, and the four words that SipHash starts from.
CASTAGNOLI = 0x82F63B78
SIP_START = (0x736F6D6570736575, 0x646F72616E646F6D, 0x6C7967656E657261, 0x7465646279746573)


def _crc_table() -> list[int]:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(CASTAGNOLI), table >> 1).astype(np.uint32)
    return table.tolist()


_TABLE = _crc_table()


def crc32c(data: bytes, crc: int = 0) -> int:
    crc ^= 0xFFFFFFFF
    for byte in data:
        crc = crc >> 8 ^ _TABLE[(crc ^ byte) & 0xFF]
    return crc ^ 0xFFFFFFFF


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return x << np.uint64(bits) | x >> np.uint64(64 - bits)


def _rounds(v: list[np.ndarray], n: int) -> list[np.ndarray]:
    a, b, c, d = v
    for _ in range(n):
        a, c = a + b, c + d
        b, d = _turned(b, 13) ^ a, _turned(d, 16) ^ c
        a, c = _turned(a, 32) + d, c + b
        b, d = _turned(b, 17) ^ c, _turned(d, 21) ^ a
        c = _turned(c, 32)
    return [a, b, c, d]


def siphash(values: list[bytes], key: tuple[int, int], compress: int = 1, finish: int = 3) -> np.ndarray:
    """SipHash of each value, as unsigned 64-bit integers. Values with as many words of eight bytes go through the rounds together."""
    out = np.zeros(len(values), np.uint64)
    words = np.array([len(v) // 8 + 1 for v in values], np.int64)
    for n in np.unique(words).tolist():
        at = np.flatnonzero(words == n)
        padded = b"".join(values[k].ljust(8 * n - 1, b"\0") + bytes([len(values[k]) & 0xFF]) for k in at.tolist())
        blocks = np.frombuffer(padded, "<u8").reshape(len(at), n)
        state = [np.full(len(at), start ^ key[k % 2], np.uint64) for k, start in enumerate(SIP_START)]
        for block in blocks.T:
            state[3] = state[3] ^ block
            state = _rounds(state, compress)
            state[0] = state[0] ^ block
        state[2] = state[2] ^ np.uint64(0xFF)
        state = _rounds(state, finish)
        out[at] = state[0] ^ state[1] ^ state[2] ^ state[3]
    return out
