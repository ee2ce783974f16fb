"""A reader of the Thrift compact protocol, in which Parquet's metadata is written.

Structures become dictionaries by field number; what the numbers mean is up to the caller.
"""

from __future__ import annotations

import struct

from lamella.errors import CorruptFileError

_STOP, _TRUE, _FALSE, _BYTE, _I16, _I32, _I64, _DOUBLE, _BINARY, _LIST, _SET, _MAP, _STRUCT = range(13)


class CompactReader:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def _take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise CorruptFileError("metadata ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def varint(self) -> int:
        value = shift = 0
        while True:
            byte = self._take(1)[0]
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7
            if shift > 63:
                raise CorruptFileError("a number in the metadata is too long")

    def zigzag(self) -> int:
        value = self.varint()
        return (value >> 1) ^ -(value & 1)

    def _value(self, kind: int, depth: int):
        if kind in (_TRUE, _FALSE):  # inside a list each has a byte of its own
            return self._take(1)[0] == _TRUE
        if kind == _BYTE:
            return struct.unpack("b", self._take(1))[0]
        if kind in (_I16, _I32, _I64):
            return self.zigzag()
        if kind == _DOUBLE:
            return struct.unpack("<d", self._take(8))[0]
        if kind == _BINARY:
            return self._take(self.varint())
        if kind in (_LIST, _SET):
            head = self._take(1)[0]
            size = head >> 4 if head >> 4 < 15 else self.varint()
            if size > len(self.data):
                raise CorruptFileError("a list in the metadata is longer than the metadata")
            return [self._value(head & 15, depth) for _ in range(size)]
        if kind == _MAP:
            size = self.varint()
            if not size:
                return {}
            kinds = self._take(1)[0]
            return {self._value(kinds >> 4, depth): self._value(kinds & 15, depth) for _ in range(size)}
        if kind == _STRUCT:
            return self.structure(depth + 1)
        raise CorruptFileError(f"no such kind of value: {kind}")

    def structure(self, depth: int = 0) -> dict:
        if depth > 64:
            raise CorruptFileError("metadata is nested too deeply")
        fields: dict = {}
        last = 0
        while (head := self._take(1)[0]) != _STOP:
            kind, delta = head & 15, head >> 4
            last = last + delta if delta else self.zigzag()
            fields[last] = kind == _TRUE if kind in (_TRUE, _FALSE) else self._value(kind, depth)
        return fields
