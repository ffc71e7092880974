"""Compound files: directory and streams, from bytes, by the public format description."""

from __future__ import annotations

import struct

END, FREE = 0xFFFFFFFE, 0xFFFFFFFF


class CompoundFile:
    def __init__(self, data: bytes):
        if data[:8] != b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
            raise ValueError("not a compound file")
        self.data = data
        shift, mini_shift = struct.unpack_from("<HH", data, 30)
        self.size, self.mini = 1 << shift, 1 << mini_shift
        first_dir, _, self.cutoff, first_mini_fat, _, first_difat, _ = struct.unpack_from("<7I", data, 48)
        tables = [x for x in struct.unpack_from("<109I", data, 76) if x < END]
        at, seen = first_difat, set()
        while at < END and at not in seen:
            seen.add(at)
            more = struct.unpack(f"<{self.size // 4}I", self._sector(at))
            tables += [x for x in more[:-1] if x < END]
            at = more[-1]
        self.fat = [x for t in tables for x in struct.unpack(f"<{self.size // 4}I", self._sector(t))]
        self.mini_fat = [x for s in self._chain(first_mini_fat, self.fat) for x in struct.unpack(f"<{self.size // 4}I", self._sector(s))]
        directory = b"".join(self._sector(s) for s in self._chain(first_dir, self.fat))
        self.entries: dict[str, tuple[int, int, int]] = {}
        self.root = (END, 0)
        for i in range(0, len(directory) - 127, 128):
            length, kind = struct.unpack_from("<HB", directory, i + 64)
            if kind in (1, 2, 5) and 2 <= length <= 64:
                name = directory[i : i + length - 2].decode("utf-16-le", "replace")
                start, size = struct.unpack_from("<IQ", directory, i + 116)
                if kind == 5:
                    self.root = (start, size)
                else:
                    self.entries.setdefault(name, (kind, start, size & 0xFFFFFFFF))

    def _sector(self, n: int) -> bytes:
        at = (n + 1) * self.size
        return self.data[at : at + self.size].ljust(self.size, b"\0")

    @staticmethod
    def _chain(at: int, fat: list[int]) -> list[int]:
        out: list[int] = []
        while at < END and at < len(fat) and len(out) <= len(fat):
            out.append(at)
            at = fat[at]
        return out

    def names(self) -> list[str]:
        return list(self.entries)

    def read(self, name: str) -> bytes:
        kind, start, size = self.entries[name]
        if kind != 2:
            raise KeyError(name)
        if size >= self.cutoff:
            return b"".join(self._sector(s) for s in self._chain(start, self.fat))[:size]
        whole = b"".join(self._sector(s) for s in self._chain(self.root[0], self.fat))
        return b"".join(whole[s * self.mini : (s + 1) * self.mini] for s in self._chain(start, self.mini_fat))[:size]
