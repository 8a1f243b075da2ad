"""Reading well-known binary in step, beside a reader that goes from byte to byte."""

from __future__ import annotations

import random
import struct
import time

import numpy as np
import pyarrow as pa
import pytest

from cairngeo.functions import geometry as G

NAMES = [None, "Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon", "GeometryCollection"]


class Plain:
    """(type, [(member, kind, rings)]) of one blob, value by value."""

    def __init__(self, blob):
        self.blob, self.at, self.parts = blob, 0, []
        self.top = self.shape(0, None)

    def number(self, order, kind):
        (value,) = struct.unpack_from(order + kind, self.blob, self.at)
        self.at += struct.calcsize(kind)
        return value

    def vertex(self, order, dims):
        return [self.number(order, "d") for _ in range(dims)][:2]

    def line(self, order, dims):
        return [self.vertex(order, dims) for _ in range(self.number(order, "I"))]

    def shape(self, member, kind):
        order = "<" if self.blob[self.at] else ">"
        self.at += 1
        code = self.number(order, "I")
        if code & 0x20000000:
            self.at += 4
        iso, base = divmod(code & 0x0FFFFFFF, 1000)
        dims = 2 + bool(code & 0x80000000 or iso in (1, 3)) + bool(code & 0x40000000 or iso in (2, 3))
        name = kind or NAMES[base]
        if base == 1:
            xy = self.vertex(order, dims)
            if all(v == v for v in xy):
                self.parts.append((member, name, [[xy]]))
        elif base == 2:
            self.parts.append((member, name, [self.line(order, dims)]))
        elif base == 3:
            self.parts.append((member, name, [self.line(order, dims) for _ in range(self.number(order, "I"))]))
        else:
            for _ in range(self.number(order, "I")):
                if base == 7:
                    self.shape(self.parts[-1][0] + 1 if self.parts else 0, None)
                else:
                    self.shape(member, name)
        return NAMES[base]


def some(rng, base, depth=0):
    """A random geometry in a random byte order, with Z and M in either spelling, or a system."""
    order = rng.choice("<>")
    z, m = rng.random() < 0.3, rng.random() < 0.2
    code, dims = base, 2 + z + m
    system = b""
    if rng.random() < 0.5:
        code += 1000 * (z + 2 * m)
    else:
        code |= (0x80000000 if z else 0) | (0x40000000 if m else 0)
        if depth == 0 and rng.random() < 0.3:
            code, system = code | 0x20000000, struct.pack(order + "I", 3006)

    def run(n):
        return b"".join(struct.pack(order + "d" * dims, *[rng.uniform(-1e6, 1e6) for _ in range(dims)]) for _ in range(n))

    def line(n):
        return struct.pack(order + "I", n) + run(n)

    head = struct.pack("B", order == "<") + struct.pack(order + "I", code) + system
    if base == 1:
        return head + (struct.pack(order + "d" * dims, *[float("nan")] * dims) if rng.random() < 0.15 else run(1))
    if base == 2:
        return head + line(rng.choice([0, 1, 2, 9]))
    if base == 3:
        return head + struct.pack(order + "I", n := rng.choice([0, 1, 1, 2, 6])) + b"".join(line(rng.randint(0, 6)) for _ in range(n))
    kinds = [base - 3] if base < 7 else [1, 2, 3, 4, 5, 6, *([7] if depth < 3 else [])]
    inner = [some(rng, rng.choice(kinds), depth + 1) for _ in range(rng.choice([0, 1, 2, 4]))]
    return head + struct.pack(order + "I", len(inner)) + b"".join(inner)


def shown(value):
    return None if value is None else (value["type"], [(p["member"], p["kind"], [[[v["x"], v["y"]] for v in r] for r in p["rings"]]) for p in value["parts"]])


@pytest.mark.parametrize("seed", range(6))
def test_batches_equal_the_plain_reader(seed):
    rng = random.Random(seed)
    blobs = [some(rng, rng.randint(1, 7)) if rng.random() > 0.1 else None for _ in range(400)]
    want = [None if b is None else (p.top, p.parts) for b, p in ((b, None if b is None else Plain(b)) for b in blobs)]
    assert [shown(v) for v in G.decode_batch(pa.array(blobs, pa.binary())).to_pylist()] == want
    cut = pa.array([b"\x01", *blobs, b"\x01"], pa.large_binary()).slice(1, len(blobs))
    assert [shown(v) for v in G.decode_batch(cut).to_pylist()] == want


def test_what_is_read_is_written_back():
    rng = random.Random(11)
    first = G.decode_batch(pa.array([some(rng, rng.randint(1, 7)) for _ in range(300)], pa.binary()))
    assert G.decode_batch(G.encode_batch(first)).to_pylist() == first.to_pylist()


def test_empty_batches_and_only_nulls():
    assert G.decode_batch(pa.array([], pa.binary())).to_pylist() == []
    assert G.decode_batch(pa.array([None, None], pa.binary())).to_pylist() == [None, None]


@pytest.mark.parametrize(
    ("blob", "told"),
    [
        (b"", "too short"),
        (b"\x01\x01\x00", "too short"),
        (b"\x02" + bytes(20), "byte order 2"),
        (struct.pack("<BI", 1, 8) + bytes(16), "geometry type 8"),
        (struct.pack("<BI", 1, 1) + bytes(15), "too short"),
        (struct.pack("<BII", 1, 2, 3) + bytes(47), "too short"),
        (struct.pack("<BII", 1, 3, 2**31) + bytes(40), "too short"),
        (struct.pack("<BIII", 1, 3, 1, 9) + bytes(40), "too short"),
        (struct.pack("<BII", 1, 7, 2**32 - 1) + bytes(9), "too short"),
    ],
)
def test_bad_bytes_are_errors(blob, told):
    good = struct.pack("<BIdd", 1, 1, 1.0, 2.0)
    with pytest.raises(ValueError, match=told):
        G.decode_batch(pa.array([good, blob], pa.binary()))


def test_many_polygons_need_no_step_each():
    ring = np.cumsum(np.ones((9, 2)), axis=0).astype("<f8").tobytes()
    blob = struct.pack("<BII", 1, 3, 2) + 2 * (struct.pack("<I", 9) + ring)
    blobs = pa.array([blob] * 30_000, pa.binary())
    begin = time.perf_counter()
    decoded = G.decode_batch(blobs)
    assert time.perf_counter() - begin < 5 and len(decoded) == 30_000
    assert len(decoded[29_999].as_py()["parts"][0]["rings"]) == 2


def written(geometry):
    """Little-endian bytes of one decoded geometry, value by value."""
    head = lambda code: struct.pack("<BI", 1, code)

    def line(ring):
        return struct.pack("<I", len(ring)) + b"".join(struct.pack("<dd", v["x"], v["y"]) for v in ring)

    def shape(code, rings):
        if code == 1:
            return head(1) + struct.pack("<dd", rings[0][0]["x"], rings[0][0]["y"])
        return head(code) + (line(rings[0]) if code == 2 else struct.pack("<I", len(rings)) + b"".join(map(line, rings)))

    def whole(name, parts):
        code = NAMES.index(name)
        if code == 7:
            cuts = [k for k in range(len(parts)) if not k or parts[k]["member"] != parts[k - 1]["member"]]
            groups = [parts[a:b] for a, b in zip(cuts, [*cuts[1:], len(parts)])]
            return head(7) + struct.pack("<I", len(groups)) + b"".join(whole(g[0]["kind"], g) for g in groups)
        if code >= 4:
            return head(code) + struct.pack("<I", len(parts)) + b"".join(shape(code - 3, p["rings"]) for p in parts)
        if not parts:
            return head(code) + (struct.pack("<dd", float("nan"), float("nan")) if code == 1 else struct.pack("<I", 0))
        return shape(code, parts[0]["rings"])

    return None if geometry is None or geometry["type"] is None else whole(geometry["type"], geometry["parts"])


@pytest.mark.parametrize("seed", range(6))
def test_written_bytes_equal_the_plain_writer(seed):
    rng = random.Random(100 + seed)
    blobs = [some(rng, rng.randint(1, 7)) if rng.random() > 0.1 else None for _ in range(400)]
    geometries = G.decode_batch(pa.array(blobs, pa.binary()))
    want = [written(v) for v in geometries.to_pylist()]
    assert G.encode_batch(geometries).to_pylist() == want
    assert G.encode_batch(geometries.slice(37, 200)).to_pylist() == want[37:237]
    again = pa.array(geometries.to_pylist(), geometries.type)  # as Spark builds it, nulls inside
    assert G.encode_batch(again).to_pylist() == want


def test_writing_nothing_and_only_nulls():
    none = G.decode_batch(pa.array([None, None], pa.binary()))
    assert G.encode_batch(none).to_pylist() == [None, None] and G.encode_batch(none.slice(0, 0)).to_pylist() == []
