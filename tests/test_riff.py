import struct

import numpy as np
import pytest

from auralake.sources import files, riff

RNG = np.random.default_rng(0)
X = np.clip(RNG.normal(size=(2, 50)) / 3, -1, 0.999)


def made(tag, bits, raw, channels=2, rate=24_000, align=None, extra=b"", head=b"RIFF", before=b"", after=b"", size=None, total=None):
    align = align if align is not None else channels * bits // 8
    fmt = struct.pack("<HHIIHH", tag, channels, rate, rate * align, align, bits) + extra
    body = b"WAVE" + before + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(raw) if size is None else size) + raw + b"\0" * (len(raw) % 2) + after
    return head + struct.pack("<I", len(body) if total is None else total) + body


def ints(bits, width=None):
    width = width or bits // 8
    v = np.round(X.T.ravel() * 2 ** (bits - 1)).clip(-(2 ** (bits - 1)), 2 ** (bits - 1) - 1).astype(np.int64) << (8 * width - bits)
    return b"".join(int(x).to_bytes(width, "little", signed=True) for x in v)


def extensible(valid, tag):
    return struct.pack("<HHI", 22, valid, 3) + struct.pack("<H", tag) + bytes.fromhex("000000001000800000aa00389b71")


FORMS = {
    "u8": (made(1, 8, bytes((np.round(X.T.ravel() * 127) + 128).astype(np.uint8))), 2**-6),
    "s16": (made(1, 16, ints(16)), 2**-15), "s24": (made(1, 24, ints(24)), 2**-23), "s32": (made(1, 32, ints(32)), 2**-23),
    "24 in 32": (made(0xFFFE, 32, ints(24, 4), extra=extensible(24, 1)), 2**-23), "20 in 24": (made(0xFFFE, 24, ints(20, 3), extra=extensible(20, 1)), 2**-19),
    "24 of an align of 4": (made(1, 24, ints(24, 4), align=8), 2**-23),
    "f32": (made(3, 32, X.T.astype("<f4").tobytes()), 1e-7), "f64": (made(3, 64, X.T.astype("<f8").tobytes()), 1e-7), "f32 extensible": (made(0xFFFE, 32, X.T.astype("<f4").tobytes(), extra=extensible(32, 3)), 1e-7),
    "odd chunk before": (made(1, 16, ints(16), before=b"LIST\x05\0\0\0abcde\0"), 2**-15), "chunk after": (made(1, 16, ints(16), after=b"id3 \x04\0\0\0abcd"), 2**-15),
    "never closed": (made(1, 16, ints(16), size=0, total=0), 2**-15), "all ones": (made(1, 16, ints(16), size=0xFFFFFFFF, total=0xFFFFFFFF), 2**-15), "too long": (made(1, 16, ints(16), size=10**6), 2**-15),
    "RF64": (made(1, 16, ints(16), head=b"RF64", before=b"ds64" + struct.pack("<IQQQI", 28, 0, 200, 50, 0), size=0xFFFFFFFF, total=0xFFFFFFFF, after=b"id3 \x04\0\0\0abcd"), 2**-15),
}


@pytest.mark.parametrize("name", sorted(FORMS))
def test_forms(name):
    content, error = FORMS[name]
    wave, rate = riff.parse(content)
    assert rate == 24_000 and wave.shape == X.shape and np.abs(wave - X).max() <= error


def test_companded_codes():
    """Every code of both laws against the tables' own rules, segment by segment."""
    codes = np.arange(256, dtype=np.uint8)
    for tag, f in ((6, riff.a_law), (7, riff.mu_law)):
        wave, _ = riff.parse(made(tag, 8, bytes(codes), channels=1))
        assert np.array_equal(wave[0], f(codes))
    mu = riff.mu_law(codes) * 8192
    assert mu[0xFF] == mu[0x7F] == 0 and mu[0x80] == 8031 and mu[0x00] == -8031 and np.array_equal(mu[:128], -mu[128:])
    assert (np.diff(mu[128:]) < 0).all()
    steps = -np.diff(mu[128:])
    assert [int(steps[16 * k]) for k in range(8)] == [2 << 7 - k for k in range(8)]
    a = riff.a_law(codes ^ 0x55) * 4096
    assert a[0x80] == 1 and a[0xFF] == 4032 and np.array_equal(a[:128], -a[128:]) and (np.diff(a[128:]) > 0).all()


BROKEN = {"": "no RIFF waveform", "RIFFxxxxWAV": "no RIFF waveform", "text": "no RIFF waveform"}


@pytest.mark.parametrize("content, why", [*((k.encode(), v) for k, v in BROKEN.items()), (b"RIFF\0\0\0\0WAVE", "no format"), (made(2, 4, b"ab"), "format 2 of 4 bits"), (made(1, 16, b"", channels=0), "no channels"), (made(1, 16, b"", rate=0), "no rate"), (made(0xFFFE, 16, b""), "the extension is cut off"), (made(85, 0, b"abc", align=1), "format 85 of 0 bits"), (made(1, 16, ints(16))[:40], "no data")])
def test_reasons(content, why):
    with pytest.raises(riff.Unreadable, match=why):
        riff.parse(content)


def test_cut_anywhere_is_a_waveform_or_a_reason():
    whole = FORMS["chunk after"][0]
    for n in range(len(whole)):
        try:
            wave, _ = riff.parse(whole[:n])
            assert wave.shape[0] == 2
        except riff.Unreadable:
            assert n < 44


def test_bad_files_cost_no_task(spark, tmp_path):
    (tmp_path / "good.wav").write_bytes(FORMS["f32"][0])
    (tmp_path / "bad.wav").write_bytes(b"not a wave")
    rows = {r.path.rsplit("/", 1)[1]: r for r in files.wav(spark, str(tmp_path)).collect()}
    assert rows["bad.wav"].wave is None and rows["bad.wav"].reason == "no RIFF waveform" and rows["bad.wav"].rate is None
    assert rows["good.wav"].reason is None and rows["good.wav"].rate == 24_000 and np.abs(np.array(rows["good.wav"].wave) - X).max() < 1e-6
