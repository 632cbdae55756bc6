"""Binary sensor frames as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FrameFormat:
    """Fixed layout, big-endian: a clock, signed words, unsigned words, the last of which is the sync word.

    The values are those of the sensor's published frame: 4 + 18 + 8 bytes.
    """

    clock_bytes: int = 4
    signed: tuple[str, ...] = ("ax", "ay", "az", "gx", "gy", "gz", "hx", "hy", "hz")
    unsigned: tuple[str, ...] = ("hf1", "hf2", "hf3", "sync")
    sync: int = 4095
    scale: dict[str, float] = field(default_factory=lambda: {"a": 0.009576806641, "g": 0.002130528872, "h": 0.4788403320})

    @property
    def size(self) -> int:
        return self.clock_bytes + 2 * (len(self.signed) + len(self.unsigned))


def _unsigned(frame: Column, at: int, size: int) -> Column:
    return F.conv(F.hex(F.substring(frame, at, size)), 16, 10).cast("long")


def decode_frame(frame: Column, layout: FrameFormat) -> dict[str, Column]:
    """tx_us and scaled channels; all null where the length or the sync word is wrong."""
    at, out = 1 + layout.clock_bytes, {}
    raw = {}
    for name in layout.signed:
        word = _unsigned(frame, at, 2)
        raw[name] = F.when(word >= 32768, word - 65536).otherwise(word)
        at += 2
    for name in layout.unsigned:
        raw[name] = _unsigned(frame, at, 2)
        at += 2
    good = (F.octet_length(frame) == layout.size) & (raw["sync"] == layout.sync)
    out["tx_us"] = F.when(good, _unsigned(frame, 1, layout.clock_bytes))
    for name in layout.signed:
        out[name] = F.when(good, raw[name] * F.lit(layout.scale[name[0]]))
    for name in layout.unsigned[:-1]:
        out[name] = F.when(good, raw[name])
    return out


def encode_frame(tx_us: Column, channels: dict[str, Column], layout: FrameFormat) -> Column:
    """Inverse of decode_frame: codes rounded half to even and clipped to their range, the clock cut to its width."""
    clock = F.lpad(F.hex(F.pmod(tx_us, F.lit(1 << (8 * layout.clock_bytes)))), 2 * layout.clock_bytes, "0")
    parts = [clock]
    for name in layout.signed:
        code = F.greatest(F.lit(-32768), F.least(F.lit(32767), F.rint(channels[name] / layout.scale[name[0]]).cast("long")))
        parts.append(F.lpad(F.hex(F.pmod(code, F.lit(65536))), 4, "0"))
    for name in layout.unsigned[:-1]:
        parts.append(F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(65535), channels[name]))), 4, "0"))
    parts.append(F.lit(f"{layout.sync:04X}"))
    return F.unhex(F.concat(*parts))


def _crc_step(c: int) -> int:
    for _ in range(8):
        c = ((c << 1) ^ 0x1021 if c & 0x8000 else c << 1) & 0xFFFF
    return c


#: The check sum's step for each byte.
_CRC_STEPS = [_crc_step(b << 8) for b in range(256)]


def crc16(data: Column) -> Column:
    """CRC-16 with polynomial 0x1021 and start 0xFFFF, of a binary column."""
    length = F.octet_length(data)
    index = F.when(length > 0, F.sequence(F.lit(1), length)).otherwise(F.array().cast("array<int>"))

    table = F.array(*[F.lit(c) for c in _CRC_STEPS])

    def step(crc: Column, k: Column) -> Column:
        byte = F.conv(F.hex(F.substring(data, k, F.lit(1))), 16, 10).cast("int")
        return F.shiftleft(crc.bitwiseAND(0xFF), 8).bitwiseXOR(F.get(table, F.shiftright(crc, 8).bitwiseXOR(byte)))

    return F.aggregate(index, F.lit(0xFFFF), step)


def frame_kind(data: Column, size: int = 42, header: str = "A55A", least: int = 3, patience: int = 600) -> Column:
    """Which frames a stream's first bytes hold: "v2" if there are `least` headers in a row exactly `size` bytes apart,
    each of a whole frame; "v1" if there are not and at least `patience` bytes; else null, as it cannot be told yet.

    data is worked anew at each place, so it should be a column; whole streams are for sources.bytestreams.stream_kinds()."""
    n, word = F.octet_length(data), bytes.fromhex(header)
    places = F.when(n >= least * size, F.sequence(F.lit(0), F.greatest(n - least * size, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    here = lambda i: F.substring(data, i + 1, F.lit(len(word))) == F.lit(word)
    found = F.exists(places, lambda i: here(i) & here(i + size) & here(i + 2 * size)) if least == 3 else F.exists(places, lambda i: F.forall(F.sequence(F.lit(0), F.lit(least - 1)), lambda k: here(i + k * size)))
    return F.when(found, "v2").when(n >= patience, "v1")


def expanded_format(code: Column) -> Column:
    """A struct code as an array of single letters: "2h3B" is h, h, B, B, B; byte order marks are passed over."""
    counts, letters = F.regexp_extract_all(code, F.lit(r"([0-9]*)([A-Za-z])"), 1), F.regexp_extract_all(code, F.lit(r"([0-9]*)([A-Za-z])"), 2)
    return F.flatten(F.zip_with(counts, letters, lambda n, c: F.array_repeat(c, F.when(n == "", F.lit("1")).otherwise(n).cast("int"))))
