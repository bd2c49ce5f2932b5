"""Compound files: folders and streams in one file, by the public [MS-CFB] layout."""

from __future__ import annotations

import struct

SIGNATURE = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
_END = 0xFFFFFFFA


class CompoundFile:
    """The streams of a compound file, by path."""

    def __init__(self, data: bytes):
        if data[:8] != SIGNATURE:
            raise ValueError("not a compound file")
        self.data = data
        self.sector = 1 << struct.unpack_from("<H", data, 30)[0]
        self.small = 1 << struct.unpack_from("<H", data, 32)[0]
        first_dir, self.cutoff, first_mini = struct.unpack_from("<I", data, 48)[0], *struct.unpack_from("<II", data, 56)
        first_difat = struct.unpack_from("<I", data, 68)[0]
        difat = list(struct.unpack_from("<109I", data, 76))
        per = self.sector // 4
        seen = 0
        while first_difat < _END and seen < len(data) // self.sector + 1:
            block = struct.unpack(f"<{per}I", self._sector(first_difat))
            difat += block[:-1]
            first_difat, seen = block[-1], seen + 1
        self.fat = [x for s in difat if s < _END for x in struct.unpack(f"<{per}I", self._sector(s))]
        mini = self._chain(first_mini)
        self.minifat = list(struct.unpack(f"<{len(mini) // 4}I", mini))
        folder = self._chain(first_dir)
        self.entries = [self._entry(folder[i : i + 128]) for i in range(0, len(folder) - 127, 128)]
        root = self.entries[0]
        self.ministream = self._chain(root["start"])[: root["size"]]
        self.streams: dict[tuple[str, ...], dict] = {}
        self._walk(root["child"], ())

    def _sector(self, n: int) -> bytes:
        at = (n + 1) * self.sector
        return self.data[at : at + self.sector].ljust(self.sector, b"\0")

    def _chain(self, n: int) -> bytes:
        out, seen = [], set()
        while n < _END and n not in seen:
            seen.add(n)
            out.append(self._sector(n))
            n = self.fat[n] if n < len(self.fat) else _END
        return b"".join(out)

    @staticmethod
    def _entry(raw: bytes) -> dict:
        size = struct.unpack_from("<H", raw, 64)[0]
        left, right, child = struct.unpack_from("<III", raw, 68)
        start, length = struct.unpack_from("<IQ", raw, 116)
        return {"name": raw[: max(size - 2, 0)].decode("utf-16-le", "replace"), "kind": raw[66], "left": left, "right": right, "child": child, "start": start, "size": length}

    def _walk(self, n: int, path: tuple[str, ...]) -> None:
        todo, seen = [(n, path)], set()
        while todo:
            n, path = todo.pop()
            if n >= len(self.entries) or n in seen:
                continue
            seen.add(n)
            e = self.entries[n]
            todo += [(e["left"], path), (e["right"], path)]
            here = (*path, e["name"])
            if e["kind"] == 1:
                todo.append((e["child"], here))
            elif e["kind"] == 2:
                self.streams[here] = e

    def read(self, *path: str) -> bytes:
        e = self.streams[path]
        if e["size"] >= self.cutoff:
            return self._chain(e["start"])[: e["size"]]
        out, n, seen = [], e["start"], set()
        while n < _END and n not in seen:
            seen.add(n)
            out.append(self.ministream[n * self.small : (n + 1) * self.small])
            n = self.minifat[n] if n < len(self.minifat) else _END
        return b"".join(out)[: e["size"]]
