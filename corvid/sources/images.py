"""Image and array files in bytes: PNG both ways, level 5 .mat files, .npy."""

from __future__ import annotations

import io
import struct
import zlib

import numpy as np

# The signature of a PNG file, channels by its colour type, and the numeric types of .mat elements.
PNG = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
MAT_TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
MAT_MATRIX, MAT_COMPRESSED = 14, 15


def _unfiltered(raw: bytes, rows: int, stride: int, step: int) -> np.ndarray:
    """Lines of a PNG after its line filters are undone; step is the distance to the pixel on the left."""
    lines = np.frombuffer(raw, np.uint8).reshape(rows, stride + 1)
    out = np.zeros((rows + 1, stride), np.uint8)
    for y, line in enumerate(lines):
        kind, now, up = line[0], line[1:].copy(), out[y]
        if kind == 2:
            now += up
        elif kind == 1:
            for c in range(step):
                now[c::step] = np.cumsum(now[c::step], dtype=np.uint8)
        elif kind:
            was, above = now.tolist(), up.tolist()
            for i in range(stride):
                left, corner = (was[i - step], above[i - step]) if i >= step else (0, 0)
                if kind == 3:
                    guess = (left + above[i]) // 2
                else:
                    # The neighbour nearest to left + above - corner; ties go to the left one, then to the one above.
                    guess = min((left, above[i], corner), key=lambda v, p=left + above[i] - corner: abs(p - v))
                was[i] = (was[i] + guess) & 255
            now = np.array(was, np.uint8)
        out[y + 1] = now
    return out[1:]


def read_png(content: bytes) -> np.ndarray:
    """(rows, columns, channels) of a PNG without interlacing; pixels of a palette are its numbers, which are labels in a mask."""
    if content[:8] != PNG:
        raise ValueError("not a PNG file")
    at, data, head = 8, b"", None
    while at < len(content):
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        body = content[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data += body
        at += size + 12
    width, height, depth, colour, _, _, interlaced = head
    if interlaced:
        raise ValueError("interlaced PNG files are not read")
    channels = CHANNELS[colour]
    stride = (width * channels * depth + 7) // 8
    lines = _unfiltered(zlib.decompress(data), height, stride, max(1, channels * depth // 8))
    if depth == 16:
        pixels = lines.view(">u2").astype(np.uint16)
    elif depth == 8:
        pixels = lines
    else:
        bits = np.unpackbits(lines, axis=1).reshape(height, -1, depth)
        pixels = (bits * (1 << np.arange(depth)[::-1])).sum(axis=2).astype(np.uint8)
    return pixels[:, : width * channels].reshape(height, width, channels)


def png_bytes(image: np.ndarray) -> bytes:
    """A PNG of (rows, columns) or (rows, columns, 1 to 4 channels) of bytes."""
    a = np.asarray(image, np.uint8)
    a = a[..., None] if a.ndim == 2 else a
    colour = {n: k for k, n in CHANNELS.items() if k != 3}[a.shape[2]]
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    lines = np.concatenate([np.zeros((len(a), 1), np.uint8), a.reshape(len(a), -1)], axis=1)
    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def npy_bytes(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, np.asarray(array), allow_pickle=False)
    return out.getvalue()


def _elements(data: bytes, order: str):
    """(type, body) of the elements of a .mat file or matrix; bodies of up to 4 bytes may stand in the tag."""
    at = 0
    while at + 8 <= len(data):
        kind, size = struct.unpack(order + "II", data[at : at + 8])
        if kind >> 16:
            yield kind & 0xFFFF, data[at + 4 : at + 4 + (kind >> 16)]
            at += 8
            continue
        yield kind, data[at + 8 : at + 8 + size]
        at += 8 + (size if kind == MAT_COMPRESSED else -(-size // 8) * 8)


def read_mat(content: bytes) -> dict[str, np.ndarray]:
    """The real numeric arrays of a level 5 .mat file by name, in their order; cells, structures and texts are left out."""
    if content[126:128] not in (b"IM", b"MI"):
        raise ValueError("not a level 5 .mat file")
    order = "<" if content[126:128] == b"IM" else ">"
    out = {}
    for kind, body in _elements(content[128:], order):
        if kind == MAT_COMPRESSED:
            kind, body = next(_elements(zlib.decompress(body), order))
        if kind != MAT_MATRIX:
            continue
        parts = list(_elements(body, order))
        if len(parts) < 4 or not 6 <= parts[0][1][0 if order == "<" else 3] <= 15:
            continue
        shape = np.frombuffer(parts[1][1], order + "i4")
        values = np.frombuffer(parts[3][1], order + MAT_TYPES[parts[3][0]])
        out[parts[2][1].decode("latin-1")] = values.reshape(shape, order="F").astype(values.dtype.newbyteorder("="))
    return out
