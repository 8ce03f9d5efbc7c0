"""Varints, zigzag numbers and length-delimited messages: the wire format under block files."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

_M64 = (1 << 64) - 1


def read_varint(buf: bytes, at: int) -> tuple[int, int]:
    shift = value = 0
    while True:
        b = buf[at]
        at += 1
        value |= (b & 0x7F) << shift
        if b < 0x80:
            return value & _M64, at
        shift += 7
        if shift > 63:
            raise ValueError("a varint of more than ten bytes")


def varint(value: int) -> bytes:
    value &= _M64
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def zigzag(value: int) -> int:
    return (value << 1 ^ value >> 63) & _M64


def unzigzag(value: int) -> int:
    return value >> 1 ^ -(value & 1)


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fields(buf: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a message: integers for varints, bytes for what is length-delimited."""
    at, end = 0, len(buf)
    while at < end:
        tag, at = read_varint(buf, at)
        kind = tag & 7
        if kind == 0:
            value, at = read_varint(buf, at)
            yield tag >> 3, value
        elif kind == 2:
            n, at = read_varint(buf, at)
            if at + n > end:
                raise ValueError("a field reaches beyond its message")
            yield tag >> 3, bytes(buf[at : at + n])
            at += n
        elif kind in (1, 5):
            at += 8 if kind == 1 else 4
        else:
            raise ValueError(f"wire type {kind}")


def message(*parts: tuple[int, int | bytes | str | None]) -> bytes:
    """A message of the given fields; None is left out."""
    out = bytearray()
    for number, value in parts:
        if value is None:
            continue
        if isinstance(value, int):
            out += varint(number << 3) + varint(value)
        else:
            body = value.encode() if isinstance(value, str) else value
            out += varint(number << 3 | 2) + varint(len(body)) + body
    return bytes(out)


def packed(values: Iterable[int]) -> bytes:
    return b"".join(map(varint, values))


def unpacked(buf: bytes) -> list[int]:
    out, at = [], 0
    while at < len(buf):
        value, at = read_varint(buf, at)
        out.append(value)
    return out


def packed_deltas(values: Iterable[int]) -> bytes:
    last, out = 0, []
    for v in values:
        out.append(zigzag(v - last))
        last = v
    return packed(out)


def unpacked_deltas(buf: bytes) -> list[int]:
    last, out = 0, []
    for v in unpacked(buf):
        last += unzigzag(v)
        out.append(last)
    return out
