"""RIFF waveforms: chunks by their sizes, and the sample formats that recorders write.

PCM of 8 to 32 bits, in containers that may be wider than the sample; floats of 32 and 64 bits; A-law and mu-law;
each by its own tag or by that of the extensible format. RF64 has the size of its data in a chunk of its own.
Sizes that are wrong, as a stream leaves them that was never closed, do not matter: a chunk ends where the
file does, and a data chunk of size 0 or of all ones goes to the end. An odd chunk is padded. What cannot be read has a
reason instead of a waveform, so that one bad file costs no task.
"""

from __future__ import annotations

import struct

import numpy as np

PCM, FLOAT, A_LAW, MU_LAW, EXTENSIBLE = 1, 3, 6, 7, 0xFFFE
UNKNOWN = 0xFFFFFFFF
#: Chunks that may stand behind the data: before one of these a size of 0 is what it says.
OTHERS = (b"LIST", b"fact", b"cue ", b"id3 ", b"bext", b"smpl", b"JUNK", b"PAD ")


class Unreadable(ValueError):
    """Why the bytes are no waveform."""


def chunks(content: bytes) -> dict[bytes, bytes]:
    """The first chunk of each name, cut where the file ends."""
    if len(content) < 12 or content[:4] not in (b"RIFF", b"RF64") or content[8:12] != b"WAVE":
        raise Unreadable("no RIFF waveform")
    found: dict[bytes, bytes] = {}
    at, wide = 12, None
    while at + 8 <= len(content):
        name, size = content[at : at + 4], struct.unpack_from("<I", content, at + 4)[0]
        left = len(content) - at - 8
        if name == b"ds64" and left >= 16:
            wide = struct.unpack_from("<Q", content, at + 16)[0]
        if name == b"data":
            if size == UNKNOWN:
                size = wide if wide is not None else left
            elif not size and content[at + 8 : at + 12] not in OTHERS:
                size = left
        size = min(size, left)
        found.setdefault(name, content[at + 8 : at + 8 + size])
        at += 8 + size + size % 2
    return found


def a_law(b: np.ndarray) -> np.ndarray:
    """Samples of -1 to 1 of 8-bit A-law codes: a sign, three bits of a segment and four within it, every other bit turned over."""
    code = b.astype(np.int32) ^ 0x55
    segment, step = code >> 4 & 7, code & 15
    size = np.where(segment == 0, 2 * step + 1, (2 * step + 33) << np.maximum(segment - 1, 0))
    return np.where(code & 0x80, size, -size) / 4096.0


def mu_law(b: np.ndarray) -> np.ndarray:
    """Samples of -1 to 1 of 8-bit mu-law codes: all bits turned over, segments that begin 33 below their powers of two."""
    code = ~b.astype(np.int32) & 0xFF
    size = ((2 * (code & 15) + 33) << (code >> 4 & 7)) - 33
    return np.where(code & 0x80, -size, size) / 8192.0


def integers(raw: bytes, width: int, bits: int) -> np.ndarray:
    """Signed whole numbers of `width` bytes, whose upper `bits` are the sample, as shares of full scale; 8 bits are unsigned."""
    if width == 1:
        return (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    b = np.zeros((len(raw) // width, 4), np.uint8)
    b[:, 4 - width :] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    x = b.view("<i4")[:, 0]
    # Bits below the sample's are not part of it.
    return (x >> (32 - bits) if bits < 32 else x) / 2.0 ** (bits - 1)


def parse(content: bytes) -> tuple[np.ndarray, int]:
    """Channels of samples in -1 to 1 (floats as they are) and the rate."""
    own = chunks(content)
    head = own.get(b"fmt ")
    if head is None or len(head) < 16:
        raise Unreadable("no format")
    if b"data" not in own:
        raise Unreadable("no data")
    tag, channels, rate, _, align, bits = struct.unpack_from("<HHIIHH", head)
    if tag == EXTENSIBLE:
        if len(head) < 26:
            raise Unreadable("the extension is cut off")
        valid, tag = struct.unpack_from("<H", head, 18)[0], struct.unpack_from("<H", head, 24)[0]
    else:
        valid = bits
    if not channels or not rate:
        raise Unreadable("no channels" if not channels else "no rate")
    width = -(-bits // 8)
    if align and align % channels == 0 and align // channels > width:
        width = align // channels  # a sample in a wider container
    raw = own[b"data"]
    raw = raw[: len(raw) // (width * channels) * width * channels if width else 0]
    if tag == PCM and 1 <= width <= 4 and 0 < (valid or bits) <= 8 * width:
        x = integers(raw, width, valid or bits)
    elif tag == FLOAT and width in (4, 8):
        x = np.frombuffer(raw, f"<f{width}").astype(float)
    elif tag in (A_LAW, MU_LAW) and width == 1:
        x = (a_law if tag == A_LAW else mu_law)(np.frombuffer(raw, np.uint8))
    else:
        raise Unreadable(f"format {tag} of {bits} bits")
    return x.reshape(-1, channels).T, rate
