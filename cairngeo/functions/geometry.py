"""Geometry as nested columns.

A geometry is ``STRUCT<type, parts>``. A part is one point, one line or one
polygon: ``rings`` holds its vertex lists (a polygon's first ring is the shell,
the others are holes), ``kind`` is the type name of the member it came from and
``member`` its position in a GeometryCollection (0 elsewhere). Collections in
collections are flattened to one level. Coordinates are kept as x and y only.

Everything but WKB reading and writing is a built-in expression. The longer ones
are written as SQL text over column names (or other SQL snippets): parsing one
text is far quicker than assembling the same tree call by call, and the texts
also serve as the bodies of the SQL functions. WKB goes through Arrow: a batch is read in
step, level by level, and all its coordinates are gathered at once; it is written
as one list of heads, counts and vertices.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERTEX_TYPE = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
PART_TYPE = T.StructType(
    [
        T.StructField("member", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("rings", T.ArrayType(T.ArrayType(VERTEX_TYPE))),
    ]
)
GEOM_TYPE = T.StructType(
    [T.StructField("type", T.StringType()), T.StructField("parts", T.ArrayType(PART_TYPE))]
)

# Geometry type codes and names of the well-known binary format.
TYPE_NAMES = {
    1: "Point",
    2: "LineString",
    3: "Polygon",
    4: "MultiPoint",
    5: "MultiLineString",
    6: "MultiPolygon",
    7: "GeometryCollection",
}

# Bytes taken by each envelope type of a GeoPackage geometry header.
ENVELOPE_BYTES = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}

TYPE_CODES = {name: code for code, name in TYPE_NAMES.items()}
_VERTEX = pa.struct([("x", pa.float64()), ("y", pa.float64())])
_PART = pa.struct(
    [("member", pa.int32()), ("kind", pa.string()), ("rings", pa.list_(pa.list_(_VERTEX)))]
)


# --- GeoPackage header -------------------------------------------------------


def strip_header(blob: Column) -> Column:
    """Well-known binary inside a GeoPackage blob; bytes without the mark pass through."""
    flags = F.conv(F.hex(F.substring(blob, 4, 1)), 16, 10).cast("int")
    envelope = F.shiftright(flags, 1).bitwiseAND(F.lit(7))
    size = F.lit(0)
    for code, width in ENVELOPE_BYTES.items():
        if width:
            size = F.when(envelope == code, width).otherwise(size)
    return (
        F.when(F.length(blob) < 8, F.raise_error(F.lit("geometry blob shorter than 8 bytes")).cast("binary"))
        .when(F.substring(blob, 1, 2) == F.lit(b"GP"), F.substr(blob, F.lit(9) + size))
        .otherwise(blob)
    )


def without_header(blob: bytes | None) -> bytes | None:
    """The same for one blob at hand."""
    if not blob:
        return None
    if len(blob) < 8:
        raise ValueError("geometry blob shorter than 8 bytes")
    if blob[:2] != b"GP":
        return blob
    return blob[8 + ENVELOPE_BYTES.get(blob[3] >> 1 & 7, 0) :]


# --- WKB, Arrow batches ------------------------------------------------------


class _Bytes:
    """The blobs of an Arrow batch as one run of bytes; values are read at many places at once."""

    def __init__(self, blobs: pa.Array):
        if not pa.types.is_large_binary(blobs.type):
            blobs = blobs.cast(pa.large_binary())
        self.null = ~blobs.is_valid().to_numpy(zero_copy_only=False)
        bounds = np.frombuffer(blobs.buffers()[1], np.int64)[blobs.offset : blobs.offset + len(blobs) + 1]
        data = blobs.buffers()[2]
        held = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
        self.begin, self.end = bounds[:-1] - bounds[0], bounds[1:] - bounds[0]
        self.data = np.concatenate([held, np.zeros(24, np.uint8)])  # a view of whole words at any place stays inside

    def check(self, at: np.ndarray, size: np.ndarray | int, end: np.ndarray) -> None:
        if (at + size > end).any():
            raise ValueError("well-known binary too short")

    def words(self, at: np.ndarray, kind: str) -> np.ndarray:
        """Little-endian numbers of four or eight bytes at any places."""
        size = np.dtype(kind).itemsize
        out = np.empty(len(at), kind)
        for shift in range(size):
            here = at % size == shift
            if here.any():
                view = np.frombuffer(self.data, kind, (len(self.data) - shift) // size, shift)
                out[here] = view[at[here] // size]
        return out

    def numbers(self, at: np.ndarray, swapped: np.ndarray, kind: str) -> np.ndarray:
        """Numbers at any places, those of ``swapped`` in the other byte order."""
        out = self.words(at, kind)
        return np.where(swapped, out.byteswap(), out) if swapped.any() else out


class _Levels:
    """Parts and runs of vertices of a batch, in the order in which they are met."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []  # geometry, member, kind, runs
        self.runs: list[tuple[np.ndarray, ...]] = []  # geometry, place, vertices, bytes a vertex, swapped

    @staticmethod
    def _in_order(found: list[tuple[np.ndarray, ...]], width: int) -> list[np.ndarray]:
        """One array per column, geometry by geometry; a step adds one row of a geometry at most."""
        if not found:
            return [np.zeros(0, np.int64)] * width
        columns = [np.concatenate(c) for c in zip(*found, strict=True)]
        order = np.argsort(columns[0], kind="stable")
        return [c[order] for c in columns]

    def ordered(self) -> tuple[list[np.ndarray], list[np.ndarray]]:
        return self._in_order(self.parts, 4), self._in_order(self.runs, 5)


def _headers(data: _Bytes, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(swapped, type code, bytes a vertex, place behind the header) of the geometries at these places."""
    data.check(at, 5, end)
    order = data.data[at]
    if (order > 1).any():
        raise ValueError(f"unknown byte order {order[order > 1][0]}")
    swapped = order == 0
    code = data.numbers(at + 1, swapped, "<u4").astype(np.int64)
    iso, base = np.divmod(code & 0x0FFFFFFF, 1000)
    has_z = (code & 0x80000000 != 0) | (iso == 1) | (iso == 3)
    has_m = (code & 0x40000000 != 0) | (iso == 2) | (iso == 3)
    unknown = (base < 1) | (base > 7)
    if unknown.any():
        raise ValueError(f"unknown geometry type {base[unknown][0]}")
    return swapped, base, 8 * (2 + has_z.astype(np.int64) + has_m), at + 5 + 4 * (code & 0x20000000 != 0)


def _walk(data: _Bytes) -> tuple[np.ndarray, _Levels]:
    """(type code of each blob, levels): every blob is read in step, a header or a ring of each at a time.

    Every blob has a place, a stack of how many geometries are left in what holds it, and the rings left of its polygon.
    The number of steps is that of the headers and rings of the longest blob, whatever the number of blobs.
    """
    count, levels = len(data.begin), _Levels()
    place, top = data.begin.copy(), np.zeros(count, np.int64)
    depth, last = np.zeros(count, np.int64), np.full(count, -1)  # last: member of the last part
    left: list[np.ndarray] = []  # per depth, geometries left of a container
    multi, member = np.zeros(count, np.int64), np.zeros(count, np.int64)  # the Multi type around a shape, its member
    multi_depth = np.zeros(count, np.int64)
    rings, swapped, width = np.zeros(count, np.int64), np.zeros(count, bool), np.zeros(count, np.int64)
    active = np.flatnonzero(~data.null)
    while len(active):
        done = []
        ringed = active[rings[active] > 0]
        if len(ringed):  # the next ring of polygons
            at = place[ringed]
            data.check(at, 4, data.end[ringed])
            size = data.numbers(at, swapped[ringed], "<u4").astype(np.int64)
            data.check(at + 4, size * width[ringed], data.end[ringed])
            levels.runs.append((ringed, at + 4, size, width[ringed], swapped[ringed]))
            place[ringed] = at + 4 + size * width[ringed]
            rings[ringed] -= 1
            done.append(ringed[rings[ringed] == 0])
        fresh = np.setdiff1d(active, ringed, assume_unique=True)
        if len(fresh):
            flip, base, bytes_, at = _headers(data, place[fresh], data.end[fresh])
            first = depth[fresh] == 0
            top[fresh] = np.where(first & (top[fresh] == 0), base, top[fresh])
            plain = multi[fresh] == 0
            # a member of a collection gets the number behind that of the last part
            inside = plain & ~first
            member[fresh[inside]] = last[fresh[inside]] + 1
            kind = np.where(plain, base, multi[fresh])

            point = base == 1
            if point.any():
                g, where = fresh[point], at[point]
                data.check(where, bytes_[point], data.end[g])
                xy = [data.numbers(where + k, flip[point], "<f8") for k in (0, 8)]
                there = ~(np.isnan(xy[0]) | np.isnan(xy[1]))
                levels.parts.append((g[there], member[g[there]], kind[point][there], np.ones(there.sum(), np.int64)))
                levels.runs.append((g[there], where[there], np.ones(there.sum(), np.int64), bytes_[point][there], flip[point][there]))
                last[g[there]] = member[g[there]]
                place[g] = where + bytes_[point]
                done.append(g)
            many = ~point
            if many.any():
                g, where, of = fresh[many], at[many], base[many]
                data.check(where, 4, data.end[g])
                size = data.numbers(where, flip[many], "<u4").astype(np.int64)
                place[g] = where + 4
                line, area, holds = of == 2, of == 3, of >= 4
                if line.any():
                    n, bytes_of = size[line], bytes_[many][line]
                    data.check(where[line] + 4, n * bytes_of, data.end[g[line]])
                    levels.runs.append((g[line], where[line] + 4, n, bytes_of, flip[many][line]))
                    place[g[line]] += n * bytes_of
                    done.append(g[line])
                if area.any():
                    data.check(where[area] + 4, 4 * size[area], data.end[g[area]])
                    rings[g[area]], swapped[g[area]], width[g[area]] = size[area], flip[many][area], bytes_[many][area]
                    done.append(g[area][size[area] == 0])
                shape = line | area
                runs_of = np.where(line, 1, size)
                levels.parts.append((g[shape], member[g[shape]], kind[many][shape], runs_of[shape]))
                last[g[shape]] = member[g[shape]]
                if holds.any():
                    g, size, of = g[holds], size[holds], of[holds]
                    data.check(place[g], 5 * size, data.end[g])
                    depth[g] += 1
                    while len(left) < depth[g].max():
                        left.append(np.zeros(count, np.int64))
                    for level in np.unique(depth[g]):
                        here = depth[g] == level
                        left[level - 1][g[here]] = size[here]
                    outer = (of < 7) & (multi[g] == 0)
                    multi[g[outer]], multi_depth[g[outer]] = of[outer], depth[g[outer]]
                    empty = g[size == 0]
                    depth[empty] -= 1
                    closed = empty[(multi[empty] > 0) & (multi_depth[empty] > depth[empty])]
                    multi[closed] = 0
                    done.append(empty)
        # a shape that is read counts for what holds it, and so on outwards
        ended = np.concatenate(done) if done else np.zeros(0, np.int64)
        over = [ended[depth[ended] == 0]]
        rising = ended[depth[ended] > 0]
        while len(rising):
            for level in np.unique(depth[rising]):
                left[level - 1][rising[depth[rising] == level]] -= 1
            rising = rising[_left_of(left, depth, rising) == 0]
            depth[rising] -= 1
            closed = rising[(multi[rising] > 0) & (multi_depth[rising] > depth[rising])]
            multi[closed] = 0
            over.append(rising[depth[rising] == 0])
            rising = rising[depth[rising] > 0]
        active = np.setdiff1d(active, np.concatenate(over), assume_unique=True)
    return top, levels


def _left_of(left: list[np.ndarray], depth: np.ndarray, rows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows), np.int64)
    for level in np.unique(depth[rows]):
        here = depth[rows] == level
        out[here] = left[level - 1][rows[here]]
    return out


def _coordinates(data: _Bytes, at: np.ndarray, size: np.ndarray, width: np.ndarray, swapped: np.ndarray) -> np.ndarray:
    """x and y of all vertices of all runs, in one gather."""
    within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    places, flip = np.repeat(at, size) + within * np.repeat(width, size), np.repeat(swapped, size)
    return np.column_stack([data.numbers(places + k, flip, "<f8") for k in (0, 8)])


def _offsets(sizes) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int32), pa.int32())


def _nested(types, null, part_sizes, members, kinds, ring_sizes, vertex_sizes, xy: np.ndarray) -> pa.Array:
    """Arrow geometry array from its sizes, level by level, and all coordinates in one run."""
    axes = [pa.array(np.ascontiguousarray(xy[:, k])) for k in (0, 1)]
    rings = pa.ListArray.from_arrays(_offsets(vertex_sizes), pa.StructArray.from_arrays(axes, ["x", "y"]))
    shapes = pa.ListArray.from_arrays(_offsets(ring_sizes), rings)
    parts = pa.StructArray.from_arrays(
        [pa.array(members, pa.int32()), pa.array(kinds, pa.string()), shapes], fields=list(_PART)
    )
    return pa.StructArray.from_arrays(
        [pa.array(types, pa.string()), pa.ListArray.from_arrays(_offsets(part_sizes), parts)],
        ["type", "parts"],
        mask=pa.array(null, pa.bool_()),
    )


POINT_HEAD = np.frombuffer(struct.pack("<BI", 1, 1), np.uint8)
POINT_BYTES = 21


def _plain_points(blobs: pa.Array) -> np.ndarray | None:
    """Coordinates of a batch that is little-endian 2D points throughout, else nothing."""
    count = len(blobs)
    if not count or blobs.null_count or not pa.types.is_binary(blobs.type):
        return None
    offsets = np.frombuffer(blobs.buffers()[1], np.int32)[blobs.offset : blobs.offset + count + 1]
    if (np.diff(offsets) != POINT_BYTES).any():
        return None
    data = np.frombuffer(blobs.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(count, POINT_BYTES)
    if (data[:, :5] != POINT_HEAD).any():
        return None
    xy = np.ascontiguousarray(data[:, 5:]).view("<f8")
    return None if np.isnan(xy).any() else xy


def decode_batch(blobs: pa.Array) -> pa.Array:
    """Arrow binary array to Arrow geometry array."""
    xy = _plain_points(blobs)
    if xy is not None:
        ones, names = np.ones(len(xy), np.int64), ["Point"] * len(xy)
        return _nested(names, np.zeros(len(xy), bool), ones, np.zeros(len(xy), np.int32), names, ones, ones, xy)
    data = _Bytes(blobs)
    top, levels = _walk(data)
    (of, members, kinds, ring_sizes), (_, at, size, width, swapped) = levels.ordered()
    names = np.array([None, *TYPE_NAMES.values()], dtype=object)
    part_sizes = np.bincount(of, minlength=len(blobs)) if len(of) else np.zeros(len(blobs), np.int64)
    return _nested(names[top], data.null, part_sizes, members.astype(np.int32), names[kinds], ring_sizes, size, _coordinates(data, at, size, width, swapped))


def _starts(sizes: np.ndarray) -> np.ndarray:
    """Where each of a row of lists begins in their flat values."""
    return np.cumsum(sizes) - sizes


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """(sizes, values) of an Arrow list array; the values of rows that are null are left out."""
    offsets, there = lists.offsets.to_numpy(), lists.is_valid().to_numpy(zero_copy_only=False)
    sizes = np.where(there, np.diff(offsets), 0)
    if there.all() and sizes.sum() == offsets[-1] - offsets[0]:
        return sizes, lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    places = np.repeat(offsets[:-1] - _starts(sizes), sizes) + np.arange(sizes.sum())
    return sizes, lists.values.take(pa.array(places))


def _codes(names: pa.Array) -> np.ndarray:
    """Type codes of names, 0 for none."""
    coded = names.dictionary_encode()
    table = np.array([*(TYPE_CODES.get(n, 0) for n in coded.dictionary.to_pylist()), 0], np.int64)
    return table[np.asarray(pa.compute.fill_null(coded.indices, len(table) - 1))]


def encode_batch(geoms: pa.Array) -> pa.Array:
    """Arrow geometry array to little-endian 2D well-known binary.

    The bytes of a batch are heads, counts and vertices. All of these are rows of one list, put in order by geometry, part and ring;
    running sums of their sizes are their places, and each sort is written at once.
    """
    count = len(geoms)
    top = np.where(geoms.is_valid().to_numpy(zero_copy_only=False), _codes(geoms.field("type")), 0)
    part_sizes, parts = _flat(geoms.field("parts"))
    there = top > 0
    if (part_sizes[~there] > 0).any():  # parts without a type belong to no geometry
        keep = np.repeat(there, part_sizes)
        parts, part_sizes = parts.filter(pa.array(keep)), np.where(there, part_sizes, 0)
    ring_sizes, rings = _flat(parts.field("rings"))
    vertex_sizes, vertices = _flat(rings)
    xy = np.column_stack([vertices.field(k).to_numpy(zero_copy_only=False) for k in "xy"]).astype("<f8")
    owner = np.repeat(np.arange(count), part_sizes)
    kinds, members = _codes(parts.field("kind")), parts.field("member").to_numpy(zero_copy_only=False)

    # what a part is within its geometry: a shape by itself, one of a Multi type, or in a member of a collection
    in_collection = top[owner] == 7
    whole = np.where(in_collection, kinds, top[owner])  # the type around the shape
    shape = np.where(whole >= 4, whole - 3, whole)
    opens = np.ones(len(owner), bool)  # a part that begins a member
    opens[1:] = (owner[1:] != owner[:-1]) | (members[1:] != members[:-1])
    group = np.cumsum(opens) - 1
    first = np.flatnonzero(opens)
    group_sizes = np.bincount(group, minlength=len(first)) if len(owner) else np.zeros(0, np.int64)
    shown = (whole >= 4) | opens  # of a shape by itself only the first part
    ring_owner = np.repeat(np.arange(len(owner)), ring_sizes)
    ring_first = np.arange(len(ring_owner)) == _starts(ring_sizes)[ring_owner]
    ring_shown = shown[ring_owner] & ((shape[ring_owner] == 3) | ring_first)

    # rows: geometry, part (-1 before the first), level, then head code, count (-1: none), vertices' ring (-1: none)
    held = np.flatnonzero(top >= 4)
    bare = np.flatnonzero((top > 0) & (top < 4) & (part_sizes == 0))
    multis = first[in_collection[first] & (whole[first] >= 4)]
    shapes, lines = np.flatnonzero(shown), np.flatnonzero(ring_shown)
    members_of = np.where(top[held] == 7, np.bincount(owner[first], minlength=count)[held], part_sizes[held])
    none = lambda of: np.full(len(of), -1)
    rows = [
        (held, none(held), 0, top[held], members_of, none(held)),
        (bare, none(bare), 0, top[bare], np.where(top[bare] == 1, -1, 0), np.where(top[bare] == 1, -2, -1)),
        (owner[multis], multis, 0, whole[multis], group_sizes[group[multis]], none(multis)),
        (owner[shapes], shapes, 1, shape[shapes], np.where(shape[shapes] == 3, ring_sizes[shapes], -1), none(shapes)),
        (owner[ring_owner[lines]], ring_owner[lines], 2, np.zeros(len(lines), np.int64), np.where(shape[ring_owner[lines]] == 1, -1, vertex_sizes[lines]), lines),
    ]
    of, part, level, code, number, run = (
        np.concatenate([np.broadcast_to(row[k], row[0].shape) for row in rows]).astype(np.int64) for k in range(6)
    )
    run_size = np.where(run >= 0, vertex_sizes[np.maximum(run, 0)] if len(vertex_sizes) else 0, np.where(run == -2, 1, 0))
    size = 5 * (code > 0) + 4 * (number >= 0) + 16 * run_size
    order = np.lexsort((np.maximum(run, 0), level, part, of))
    at = np.empty(len(order), np.int64)
    at[order] = _starts(size[order])

    out = np.zeros(int(size.sum()), np.uint8)
    heads = code > 0
    out[at[heads]], out[at[heads] + 1] = 1, code[heads]
    after = at + 5 * heads
    counted = number >= 0
    out[after[counted][:, None] + np.arange(4)] = number[counted].astype("<u4").view(np.uint8).reshape(-1, 4)
    after = after + 4 * counted
    runs = np.flatnonzero(run >= 0)
    runs = runs[np.argsort(run[runs], kind="stable")]
    taken = np.repeat(np.where(ring_shown, np.arange(len(ring_owner)), -1), vertex_sizes) >= 0
    within = np.arange(run_size[runs].sum()) - np.repeat(_starts(run_size[runs]), run_size[runs])
    places = np.repeat(after[runs], run_size[runs]) + 16 * within
    out[places[:, None] + np.arange(16)] = np.ascontiguousarray(xy[taken]).view(np.uint8).reshape(-1, 16)
    empty = after[run == -2]
    out[empty[:, None] + np.arange(16)] = np.full((len(empty), 2), np.nan).astype("<f8").view(np.uint8).reshape(-1, 16)

    offsets = np.zeros(count + 1, np.int64)
    np.cumsum(np.bincount(of, size, count), out=offsets[1:])
    if offsets[-1] > np.iinfo(np.int32).max:
        raise ValueError("a batch of geometries beyond 2 GB")
    valid = pa.py_buffer(np.packbits(there, bitorder="little"))
    return pa.Array.from_buffers(pa.binary(), count, [valid, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out)])


@F.arrow_udf(GEOM_TYPE)
def parse_wkb(blob: pa.Array) -> pa.Array:
    return decode_batch(blob)


@F.arrow_udf(T.BinaryType())
def write_wkb(geom: pa.Array) -> pa.Array:
    return encode_batch(geom)


# --- constructors ------------------------------------------------------------


def vertex(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def geometry(kind: str, rings: Column) -> Column:
    """One-part geometry of ``kind`` from an array of vertex lists."""
    part = F.struct(F.lit(0).alias("member"), F.lit(kind).alias("kind"), rings.alias("rings"))
    return F.struct(F.lit(kind).alias("type"), F.array(part).alias("parts"))


def point(x: Column, y: Column) -> Column:
    return geometry("Point", F.array(F.array(vertex(x, y))))


def polygon(*corners: tuple[Column, Column]) -> Column:
    """Polygon with one closed ring through the given corners."""
    ring = [vertex(x, y) for x, y in (*corners, corners[0])]
    return geometry("Polygon", F.array(F.array(*ring)))


def box(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    return polygon((xmin, ymin), (xmax, ymin), (xmax, ymax), (xmin, ymax))


# --- vertices, envelope, centre ----------------------------------------------


def rings_sql(g: str) -> str:
    return f"flatten(transform({g}.parts, p -> p.rings))"


def vertices_sql(g: str) -> str:
    return f"flatten({rings_sql(g)})"


def vertices(g: str) -> Column:
    """All vertices of all rings of all parts, in order."""
    return F.expr(vertices_sql(g))


ENVELOPE_SIDES = {"xmin": ("min", "x"), "ymin": ("min", "y"), "xmax": ("max", "x"), "ymax": ("max", "y")}


def envelope_sql(g: str) -> dict[str, str]:
    return {
        name: f"array_{end}(transform({vertices_sql(g)}, v -> v.{axis}))"
        for name, (end, axis) in ENVELOPE_SIDES.items()
    }


def envelope(g: str) -> dict[str, Column]:
    """xmin, ymin, xmax, ymax; null for a null or empty geometry."""
    return {name: F.expr(text) for name, text in envelope_sql(g).items()}


def centroid_sql(g: str) -> str:
    def mean(axis: str) -> str:
        total = f"aggregate({vertices_sql(g)}, 0.0D, (acc, v) -> acc + v.{axis})"
        count = f"size({vertices_sql(g)})"
        return f"CASE WHEN {count} > 0 THEN {total} / {count} WHEN {g} IS NOT NULL THEN 0.0D END"

    return f"struct({mean('x')} AS x, {mean('y')} AS y)"


def centroid(g: str) -> Column:
    """Mean of all vertices as a vertex, (0, 0) when there are none."""
    return F.expr(centroid_sql(g))


def map_rings_sql(g: str, ring: str) -> str:
    """The geometry with each ring ``r`` replaced by the snippet ``ring``."""
    moved = (
        f"transform({g}.parts, p -> struct(p.member AS member, p.kind AS kind, "
        f"transform(p.rings, r -> {ring}) AS rings))"
    )
    return f"CASE WHEN {g} IS NOT NULL THEN struct({g}.type AS type, {moved} AS parts) END"


# --- text forms ----------------------------------------------------------------


def number_sql(x: str) -> str:
    """Shortest decimal text without an exponent."""
    spelled = f"regexp_replace(cast(cast({x} AS decimal(38,17)) AS string), r'(\\.\\d+?)0+$', '$1')"
    return f"if({x} = 0 OR abs({x}) BETWEEN 1e-3 AND 9999999.0D, cast({x} AS string), {spelled})"


def as_text_sql(g: str) -> str:
    pair = f"concat({number_sql('v.x')}, ' ', {number_sql('v.y')})"
    ring = f"array_join(transform(r, v -> {pair}), ', ')"
    line = f"concat('(', array_join(transform(p.rings, r -> {ring}), ', '), ')')"
    shape = f"concat('(', array_join(transform(p.rings, r -> concat('(', {ring}, ')')), ', '), ')')"
    lines, shapes = f"transform({g}.parts, p -> {line})", f"transform({g}.parts, p -> {shape})"
    body = (
        f"CASE WHEN size({g}.parts) = 0 THEN ' EMPTY' "
        f"WHEN {g}.type IN ('Point', 'LineString') THEN get({lines}, 0) "
        f"WHEN {g}.type = 'Polygon' THEN get({shapes}, 0) "
        f"WHEN {g}.type IN ('MultiPoint', 'MultiLineString') THEN concat('(', array_join({lines}, ', '), ')') "
        f"WHEN {g}.type = 'MultiPolygon' THEN concat('(', array_join({shapes}, ', '), ')') "
        f"WHEN {g}.type IS NOT NULL THEN raise_error(concat('no text form for ', {g}.type)) END"
    )
    return f"concat(upper({g}.type), {body})"


def as_text(g: str) -> Column:
    """Well-known text. GeometryCollection is not supported and raises."""
    return F.expr(as_text_sql(g))


def as_geojson_sql(g: str) -> str:
    pair = f"concat('[', {number_sql('v.x')}, ',', {number_sql('v.y')}, ']')"
    ring = f"concat('[', array_join(transform(r, v -> {pair}), ','), ']')"

    def single(kind: str, parts: str) -> str:
        points = f"transform(flatten(flatten(transform({parts}, p -> p.rings))), v -> {pair})"
        lines = f"transform(flatten(transform({parts}, p -> p.rings)), r -> {ring})"
        shapes = f"transform({parts}, p -> concat('[', array_join(transform(p.rings, r -> {ring}), ','), ']'))"
        coordinates = (
            f"CASE WHEN {kind} = 'Point' THEN coalesce(get({points}, 0), '[]') "
            f"WHEN {kind} = 'LineString' THEN coalesce(get({lines}, 0), '[]') "
            f"WHEN {kind} = 'Polygon' THEN coalesce(get({shapes}, 0), '[]') "
            f"WHEN {kind} = 'MultiPoint' THEN concat('[', array_join({points}, ','), ']') "
            f"WHEN {kind} = 'MultiLineString' THEN concat('[', array_join({lines}, ','), ']') "
            f"ELSE concat('[', array_join({shapes}, ','), ']') END"
        )
        return f"concat('{{\"type\":\"', {kind}, '\",\"coordinates\":', {coordinates}, '}}')"

    numbers = f"array_sort(array_distinct(transform({g}.parts, p -> p.member)))"
    own = f"filter({g}.parts, k -> k.member = m)"
    member = single(f"get({own}, 0).kind", own)
    members = (
        f"concat('{{\"type\":\"GeometryCollection\",\"geometries\":[', "
        f"array_join(transform({numbers}, m -> {member}), ','), ']}}')"
    )
    return (
        f"CASE WHEN {g}.type = 'GeometryCollection' THEN {members} "
        f"WHEN {g}.type IS NOT NULL THEN {single(f'{g}.type', f'{g}.parts')} END"
    )


def as_geojson(g: str) -> Column:
    """GeoJSON geometry text for every type, collections included."""
    return F.expr(as_geojson_sql(g))


# --- predicates --------------------------------------------------------------


def boxes_overlap_sql(a: dict[str, str], b: dict[str, str]) -> str:
    """Closed envelopes share at least one point."""
    return (
        f"{a['xmin']} <= {b['xmax']} AND {a['xmax']} >= {b['xmin']} "
        f"AND {a['ymin']} <= {b['ymax']} AND {a['ymax']} >= {b['ymin']}"
    )


def _edges(r: str) -> str:
    """Consecutive vertex pairs of a ring; a lone vertex gives one edge of no length."""
    steps = f"greatest(size({r}) - 1, 0)"
    pairs = f"zip_with(slice({r}, 1, {steps}), slice({r}, 2, {steps}), (v, w) -> struct(v AS p, w AS q))"
    return f"if(size({r}) = 1, transform({r}, v -> struct(v AS p, v AS q)), {pairs})"


def _segments(g: str) -> str:
    return f"flatten(transform({rings_sql(g)}, r -> {_edges('r')}))"


def _side(s: str, x: str, y: str) -> str:
    """> 0 left of the edge, < 0 right of it, 0 on its line."""
    return f"(({s}.q.x - {s}.p.x) * ({y} - {s}.p.y) - ({s}.q.y - {s}.p.y) * ({x} - {s}.p.x))"


def _span(s: str) -> dict[str, str]:
    return {
        "xmin": f"least({s}.p.x, {s}.q.x)",
        "ymin": f"least({s}.p.y, {s}.q.y)",
        "xmax": f"greatest({s}.p.x, {s}.q.x)",
        "ymax": f"greatest({s}.p.y, {s}.q.y)",
    }


def contains_sql(g: str, x: str, y: str) -> str:
    """Even-odd test of a point against each polygon part, holes left out."""
    crosses = f"((e.p.y > {y}) <> (e.q.y > {y})) AND ((e.q.y > e.p.y) = ({_side('e', x, y)} > 0))"
    edges = f"flatten(transform(o.rings, r -> {_edges('r')}))"
    return (
        f"exists({g}.parts, o -> o.kind IN ('Polygon', 'MultiPolygon') "
        f"AND size(filter({edges}, e -> {crosses})) % 2 = 1)"
    )


def intersects_box_sql(g: str, b: dict[str, str]) -> str:
    corners = [(b["xmin"], b["ymin"]), (b["xmin"], b["ymax"]), (b["xmax"], b["ymin"]), (b["xmax"], b["ymax"])]
    sides = ", ".join(_side("s", x, y) for x, y in corners)
    meets = f"{boxes_overlap_sql(_span('s'), b)} AND least({sides}) <= 0 AND greatest({sides}) >= 0"
    return f"(exists({_segments(g)}, s -> {meets}) OR {contains_sql(g, b['xmin'], b['ymin'])})"


def intersects_box(g: str, b: dict[str, str]) -> Column:
    """Exact closed test of a geometry against an axis-parallel box."""
    return F.expr(intersects_box_sql(g, b))


def intersects_sql(a: str, b: str, a_box: dict[str, str] | None = None, b_box: dict[str, str] | None = None) -> str:
    """Closed test of two geometries; with their envelopes only the segments that reach into the other's are compared."""

    def across(s: str, t: str) -> str:
        ends = [f"signum({_side(s, f'{t}.{end}.x', f'{t}.{end}.y')})" for end in "pq"]
        return f"{ends[0]} * {ends[1]} <= 0"

    def one_inside(outer: str, inner: str) -> str:
        # one vertex per part is enough: an edge that crosses was found already
        firsts = f"filter(transform({inner}.parts, p -> get(get(p.rings, 0), 0)), f -> f IS NOT NULL)"
        return f"exists({firsts}, f -> {contains_sql(outer, 'f.x', 'f.y')})"

    meet = f"{boxes_overlap_sql(_span('s'), _span('t'))} AND {across('s', 't')} AND {across('t', 's')}"
    near_a, near_b = _segments(a), _segments(b)
    if a_box and b_box:
        near_a = f"filter({near_a}, s -> {boxes_overlap_sql(_span('s'), b_box)})"
        near_b = f"filter({near_b}, t -> {boxes_overlap_sql(_span('t'), a_box)})"
    crossing = f"exists({near_a}, s -> exists({near_b}, t -> {meet}))"
    return f"({crossing} OR {one_inside(a, b)} OR {one_inside(b, a)})"


def intersects(a: str, b: str) -> Column:
    """Exact closed test of two geometries."""
    return F.expr(intersects_sql(a, b))


def is_axis_box_sql(g: str) -> str:
    ring = f"get(get({g}.parts, 0).rings, 0)"
    straight = f"forall({_edges(ring)}, s -> s.p.x = s.q.x OR s.p.y = s.q.y)"
    four_corners = (
        f"size({ring}) = 5 AND size(array_distinct({ring})) = 4 AND get({ring}, 0) = get({ring}, 4) AND {straight}"
    )
    return (
        f"coalesce(size({g}.parts) = 1 AND size(get({g}.parts, 0).rings) = 1 "
        f"AND ({g}.type = 'Point' OR ({g}.type = 'Polygon' AND {four_corners})), false)"
    )


def is_axis_box(g: str) -> Column:
    """True for a point or an axis-parallel rectangle, whose envelope is the shape itself."""
    return F.expr(is_axis_box_sql(g))


CONVEX_EDGES = 4  # their sums stand in one compiled test, which gets slow when it is long
_CLEAR = 1e-12  # share of the terms of a side beyond which their difference has a certain sign; rounding makes some 1e-15


def convex_edges_sql(g: str) -> str:
    """(x, y, dx, dy, x, y, ...) of the edges of a strictly convex ring, inside on their left; null for any other geometry.

    ``meets_convex_sql`` tells most boxes apart from such a geometry by a few sums, without lambdas.
    """
    ring = f"get(get({g}.parts, 0).rings, 0)"
    terms = [f"(e.q.{a} - e.p.{a}) * (v.{b} - e.p.{b})" for a, b in ("xy", "yx")]
    one, two = terms

    def around(sign: str) -> str:  # every vertex but the edge's own clearly on one side: convex, and once around
        return (
            f"forall({_edges(ring)}, e -> forall({ring}, v -> v = e.p OR v = e.q "
            f"OR {sign}({one} - {two}) > 1e-9D * (abs({one}) + abs({two}))))"
        )

    def listed(sign: str) -> str:
        return f"flatten(transform({_edges(ring)}, e -> array(e.p.x, e.p.y, {sign}(e.q.x - e.p.x), {sign}(e.q.y - e.p.y))))"

    plain = (
        f"{g}.type = 'Polygon' AND size({g}.parts) = 1 AND get({g}.parts, 0).kind = 'Polygon' AND size(get({g}.parts, 0).rings) = 1 "
        f"AND size({ring}) BETWEEN 4 AND {CONVEX_EDGES + 1} AND get({ring}, 0) = element_at({ring}, -1) "
        f"AND size(array_distinct({ring})) = size({ring}) - 1 AND forall({ring}, v -> abs(v.x) < 1e100 AND abs(v.y) < 1e100)"
    )
    return f"CASE WHEN NOT coalesce({plain}, false) THEN null WHEN {around('')} THEN {listed('')} WHEN {around('-')} THEN {listed('-')} END"


def meets_convex_sql(edges: str, b: dict[str, str]) -> str:
    """Whether a box, whose envelope meets that of the geometry, meets it: true or false where that is certain, null elsewhere.

    Convex shapes are apart if and only if an edge of one has all of the other beyond it.
    """

    def reach(k: int) -> tuple[str, str]:  # the box's corner farthest inside the edge, as two terms
        x, y, dx, dy = (f"get({edges}, {4 * k + i})" for i in range(4))
        return f"({dx} * (if({dx} >= 0, {b['ymax']}, {b['ymin']}) - {y}))", f"({dy} * (if({dy} >= 0, {b['xmin']}, {b['xmax']}) - {x}))"

    reaches = [reach(k) for k in range(CONVEX_EDGES)]
    clear = [f"{_CLEAR!r}D * (abs({one}) + abs({two}))" for one, two in reaches]
    beyond = " OR ".join(f"coalesce({two} - {one} > {c}, false)" for (one, two), c in zip(reaches, clear, strict=True))
    within = " AND ".join(f"coalesce({one} - {two} > {c}, true)" for (one, two), c in zip(reaches, clear, strict=True))
    return f"CASE WHEN {edges} IS NULL THEN null WHEN {beyond} THEN false WHEN {within} THEN true END"
