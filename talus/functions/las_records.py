"""Uncompressed LAS files (published ASPRS layout) as numpy arrays."""

from __future__ import annotations

import struct

import numpy as np

# Record layouts and extra-byte types of the LAS specification.
_CORE = [("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("intensity", "<u2")]
_OLD = _CORE + [("flags", "u1"), ("classification", "u1"), ("angle", "i1"), ("user", "u1"), ("source", "<u2")]
_NEW = _CORE + [
    ("returns", "u1"), ("flags", "u1"), ("classification", "u1"), ("user", "u1"), ("angle", "<i2"), ("source", "<u2"),
    ("gps_time", "<f8"),
]
_GPS = [("gps_time", "<f8")]
_RGB = [("red", "<u2"), ("green", "<u2"), ("blue", "<u2")]
FORMATS = {
    0: _OLD,
    1: _OLD + _GPS,
    2: _OLD + _RGB,
    3: _OLD + _GPS + _RGB,
    6: _NEW,
    7: _NEW + _RGB,
    8: _NEW + _RGB + [("nir", "<u2")],
}
EXTRA_TYPES = {1: "u1", 2: "i1", 3: "<u2", 4: "<i2", 5: "<u4", 6: "<i4", 7: "<u8", 8: "<i8", 9: "<f4", 10: "<f8"}


def read_header(f) -> dict:
    """Counts, scaling and record layout from an open file; points are not read."""
    f.seek(0)
    head = f.read(375)
    if head[:4] != b"LASF":
        raise ValueError("not a LAS file")
    minor = head[25]
    size, start, n_vlr, fmt, length, count = struct.unpack_from("<HIIBHI", head, 94)
    if fmt & 0x80 or fmt not in FORMATS:
        raise ValueError(f"unsupported point format {fmt}")
    if minor >= 4:
        count = struct.unpack_from("<Q", head, 247)[0] or count
    extra = []
    at = size
    for _ in range(n_vlr):
        f.seek(at)
        vlr = f.read(54)
        record_id, n = struct.unpack_from("<HH", vlr, 18)
        if vlr[2:18].rstrip(b"\0") == b"LASF_Spec" and record_id == 4:
            body = f.read(n)
            for i in range(0, n - n % 192, 192):
                kind, options = body[i + 2], body[i + 3]
                name = body[i + 4 : i + 36].split(b"\0")[0].decode("utf-8", "replace")
                scale = struct.unpack_from("<d", body, i + 112)[0] if options & 8 else 1.0
                offset = struct.unpack_from("<d", body, i + 136)[0] if options & 16 else 0.0
                extra.append((name, EXTRA_TYPES[kind], scale, offset))
        at += 54 + n
    layout = FORMATS[fmt] + [(name, t) for name, t, _, _ in extra]
    dtype = np.dtype(layout)
    if dtype.itemsize < length:
        dtype = np.dtype(layout + [("_rest", f"V{length - dtype.itemsize}")])
    return {
        "count": count, "start": start, "dtype": dtype, "extra": extra,
        "scale": struct.unpack_from("<3d", head, 131), "offset": struct.unpack_from("<3d", head, 155),
        "bounds": struct.unpack_from("<6d", head, 179),  # greatest and least x, y, z
    }


def read_range(f, head: dict, first: int, n: int, wanted: list[str], exact: bool = False) -> dict[str, np.ndarray]:
    """Columns of ``n`` records from ``first`` on, ``exact`` ones as whole numbers; absent columns become NaN."""
    f.seek(head["start"] + first * head["dtype"].itemsize)
    rec = np.frombuffer(f.read(n * head["dtype"].itemsize), dtype=head["dtype"])
    scaled = {name: (s, o) for name, _, s, o in head["extra"]}
    out = {"point_id": np.arange(first, first + len(rec), dtype=np.int64)}
    for name in wanted:
        if name in ("x", "y", "z"):
            i = "xyz".index(name)
            out[name] = rec[name.upper()] * head["scale"][i] + head["offset"][i]
        elif name in rec.dtype.names:
            s, o = scaled.get(name, (1.0, 0.0))
            whole = exact and rec.dtype[name].kind in "iu" and (s, o) == (1.0, 0.0)
            out[name] = rec[name].astype(np.int64) if whole else rec[name].astype(float) * s + o
        else:
            out[name] = np.full(len(rec), np.nan)
    return out


def columns_of(head: dict) -> list[tuple[str, str]]:
    """Names and SQL types of what a file holds: coordinates, then the record's other fields; whole numbers unless scaled."""
    scaled = {name for name, _, s, o in head["extra"] if (s, o) != (1.0, 0.0)}
    out = [(a, "double") for a in "xyz"]
    for name in head["dtype"].names:
        if name not in ("X", "Y", "Z", "_rest"):
            whole = head["dtype"][name].kind in "iu" and name not in scaled
            out.append((name, "bigint" if whole else "double"))
    return out


class Layout:
    """A file of version 1.4, point format 6: named fields of the format in place, all other columns as extra bytes."""

    def __init__(self, kinds: dict[str, np.dtype], low: dict[str, float], high: dict[str, float], scale: float) -> None:
        own = {name for name, _ in _NEW}
        self.extra = {c: k.newbyteorder("<") for c, k in kinds.items() if c not in own | {"x", "y", "z"}}
        self.dtype = np.dtype(_NEW + list(self.extra.items()))
        self.scale, self.offset = scale, {a: float(np.floor(low[a])) for a in "xyz"}
        self.bounds = [v for a in "xyz" for v in (high[a], low[a])]

    def header(self, n: int) -> bytes:
        """All that comes before ``n`` records."""
        codes = {t: code for code, t in EXTRA_TYPES.items()}
        described = b""
        for name, kind in self.extra.items():
            field = bytearray(192)
            field[2] = codes[kind.str.replace("|", "")]
            field[4 : 4 + len(name.encode())] = name.encode()[:32]
            described += bytes(field)
        vlr = struct.pack("<H16sHH32s", 0, b"LASF_Spec", 4, len(described), b"") + described if self.extra else b""
        head = bytearray(375)
        head[:4], head[24], head[25] = b"LASF", 1, 4
        struct.pack_into("<HIIBHI", head, 94, 375, 375 + len(vlr), int(bool(self.extra)), 6, self.dtype.itemsize, 0)
        struct.pack_into("<3d3d6d", head, 131, *[self.scale] * 3, *self.offset.values(), *self.bounds)
        struct.pack_into("<Q", head, 247, n)
        return bytes(head) + vlr

    def records(self, columns: dict[str, np.ndarray]) -> bytes:
        rec = np.zeros(len(columns["x"]), self.dtype)
        for name, v in columns.items():
            if name in ("x", "y", "z"):
                rec[name.upper()] = np.round((v - self.offset[name]) / self.scale)
            else:
                rec[name] = v
        return rec.tobytes()


def encode(columns: dict[str, np.ndarray], scale: float) -> bytes:
    """A whole file of columns at hand."""
    n = len(columns["x"])
    ends = [{a: float(fn(columns[a])) if n else 0.0 for a in "xyz"} for fn in (np.min, np.max)]
    layout = Layout({c: v.dtype for c, v in columns.items()}, *ends, scale)
    return layout.header(n) + layout.records(columns)
