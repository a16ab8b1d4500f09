"""Bit streams and dictionary coders. Streams are coded one by one, many at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class BitWriter:
    """Bits lowest first, bytes in order; whole bytes leave the register as they fill."""

    def __init__(self):
        self.done, self.value, self.size = bytearray(), 0, 0

    def write(self, value: int, bits: int) -> None:
        self.value |= (value & ((1 << bits) - 1)) << self.size
        self.size += bits
        if whole := self.size // 8:
            self.done += (self.value & ((1 << 8 * whole) - 1)).to_bytes(whole, "little")
            self.value >>= 8 * whole
            self.size -= 8 * whole

    def bytes(self) -> bytes:
        return bytes(self.done) + (bytes([self.value]) if self.size else b"")


class BitReader:
    """Reads what ``BitWriter`` wrote; bytes enter the register as they are asked for."""

    def __init__(self, data: bytes):
        self.data, self.at, self.value, self.held = data, 0, 0, 0

    def read(self, bits: int) -> int | None:
        """The next bits as a number, or None if there are too few."""
        if bits > self.held + 8 * (len(self.data) - self.at):
            return None
        if (more := -(-(bits - self.held) // 8)) > 0:
            self.value |= int.from_bytes(self.data[self.at : self.at + more], "little") << self.held
            self.at += more
            self.held += 8 * more
        out = self.value & ((1 << bits) - 1)
        self.value >>= bits
        self.held -= bits
        return out


def _width(entries: int) -> int:
    """Bits of a code that may name any entry, or none."""
    return entries.bit_length()


def lz78_encode(symbols: list[int], bits: int = 16) -> bytes:
    """Codes (entry before, symbol), entries numbered from 1 as they appear, and at last the entry under way."""
    known: dict[tuple[int, int], int] = {}
    out, at = [], 0
    for s in symbols:
        if (found := known.get((at, s))) is not None:
            at = found
            continue
        out += [(at, _width(len(known))), (s, bits)]
        known[at, s] = len(known) + 1
        at = 0
    out.append((at, _width(len(known))))
    return pack_bits(out)


def pack_bits(parts: list[tuple[int, int]]) -> bytes:
    """Numbers of so many bits each."""
    w = BitWriter()
    for v, bits in parts:
        w.write(v, bits)
    return w.bytes()


def lz78_decode(data: bytes, bits: int = 16) -> list[int]:
    known: list[tuple[int, int]] = []
    out: list[int] = []
    take = BitReader(data).read

    def spell(entry: int) -> list[int]:
        word = []
        while entry:
            entry, s = known[entry - 1]
            word.append(s)
        return word[::-1]

    while (entry := take(_width(len(known)))) is not None:
        if entry > len(known):
            raise ValueError("a code names no entry")
        s = take(bits)
        out += spell(entry)
        if s is None:
            break
        out.append(s)
        known.append((entry, s))
    return out


def lzw_encode(symbols: list[int], bits: int = 8) -> bytes:
    """Codes of growing width over an alphabet of 2**bits symbols; width follows the number of entries."""
    known: dict[tuple[int, ...] | tuple[int, int], int] = {}
    size, out, at = 1 << bits, [], -1
    for s in symbols:
        if at < 0:
            at = s
        elif (found := known.get((at, s))) is not None:
            at = found
        else:
            out.append((at, (size - 1).bit_length()))
            known[at, s] = size
            size += 1
            at = s
    if at >= 0:
        out.append((at, (size - 1).bit_length()))
    return len(symbols).to_bytes(8, "little") + pack_bits(out)


def lzw_decode(data: bytes, bits: int = 8) -> list[int]:
    n, reader = int.from_bytes(data[:8], "little"), BitReader(data[8:])
    entries: list[tuple[int, int]] = []
    base, out, last = 1 << bits, [], -1

    def spell(code: int) -> list[int]:
        word = []
        while code >= base:
            code, s = entries[code - base]
            word.append(s)
        return [code, *word[::-1]]

    while len(out) < n:
        size = base + len(entries) + (last >= 0)
        code = reader.read((size - 1).bit_length())
        if last >= 0:
            first = spell(code)[0] if code < base + len(entries) else spell(last)[0]
            entries.append((last, first))
        out += spell(code)
        last = code
    return out


def _code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        streams = batch.column(1).to_pylist()
        a, b = [lz78_encode(s) for s in streams], [lzw_encode(s, 16) for s in streams]
        same = [lz78_decode(x) == s and lzw_decode(y, 16) == s for x, y, s in zip(a, b, streams, strict=True)]
        yield pa.RecordBatch.from_pydict({"stream_id": batch.column(0), "symbols": pa.array(list(map(len, streams)), pa.int64()), "lz78_bytes": pa.array(list(map(len, a)), pa.int64()), "lzw_bytes": pa.array(list(map(len, b)), pa.int64()), "same": pa.array(same, pa.bool_())})


def code_streams(streams: DataFrame) -> DataFrame:
    """Streams (stream_id, symbols array<int>) through both coders and back."""
    return streams.select(F.col("stream_id").cast("long"), F.col("symbols").cast("array<int>")).mapInArrow(_code, "stream_id long, symbols long, lz78_bytes long, lzw_bytes long, same boolean")


#: How far apart symbols of so many bits may be, upwards less one, to count as near (fixed values).
NEAR = {8: 1, 16: 2}


def near_symbol(a: Column, b: Column, bits: int) -> Column:
    """Whether a - b, around the alphabet, is from -NEAR to NEAR - 1."""
    return F.pmod(a.cast("long") - b.cast("long") + NEAR[bits], F.lit(1 << bits)) < 2 * NEAR[bits]


#: Distance-and-length codes: bits of the distance by its kind, and the first distance of each kind (fixed values).
DISTANCE_BITS, DISTANCE_FROM = (5, 7, 9, 11), (0, 32, 128, 512)


def pack_match(distance: Column, length: Column) -> Column:
    """16 bits: kind, length, distance. Null where they do not fit: a distance's kind leaves 14 bits less its own for the length."""
    kind, bits = F.lit(0), F.lit(DISTANCE_BITS[0])
    for k in range(1, 4):
        far = distance >= DISTANCE_FROM[k]
        kind, bits = F.when(far, k).otherwise(kind), F.when(far, DISTANCE_BITS[k]).otherwise(bits)
    base = F.pow(F.lit(2), bits).cast("long")
    fits = (distance >= 0) & (distance < 1 << DISTANCE_BITS[-1]) & (length >= 0) & (length * base < 16384)
    return F.when(fits, kind * 16384 + length * base + distance).cast("long")


def code_bits(parts: list[tuple[Column, int]]) -> Column:
    """Numbers of so many bits each, 63 in all at most, lowest first, as one number."""
    if sum(b for _, b in parts) > 63:
        raise ValueError("more than 63 bits")
    out, at = F.lit(0).cast("long"), 0
    for v, bits in parts:
        out = out.bitwiseOR(F.shiftleft(v.cast("long").bitwiseAND((1 << bits) - 1), at))
        at += bits
    return out


def read_bits(packed: Column, widths: list[int]) -> list[Column]:
    """The numbers of a packed one."""
    starts = [sum(widths[:i]) for i in range(len(widths))]
    return [F.shiftright(packed, a).bitwiseAND((1 << w) - 1) for a, w in zip(starts, widths, strict=True)]


def excess(parts: list[tuple[Column, int]]) -> list[Column]:
    """What each number has above its bits: 0 where it fits."""
    return [F.shiftright(v.cast("long"), bits) for v, bits in parts]


def carried(parts: list[tuple[Column, int]]) -> Column:
    """What is to be added to the packed number so that it is the sum of the numbers, each shifted to its place: what does not fit runs into the next bits."""
    out, at = F.lit(0).cast("long"), 0
    for (_, bits), over in zip(parts, excess(parts), strict=True):
        at += bits
        out = out + F.shiftleft(over, at)
    return out


def unpack_match(code: Column) -> tuple[Column, Column]:
    """Distance and length."""
    kind, body = F.floor(code / 16384), code % 16384
    base = F.element_at(F.array(*[F.lit(1 << b) for b in DISTANCE_BITS]), kind.cast("int") + 1)
    return (body % base).cast("long"), F.floor(body / base).cast("long")
