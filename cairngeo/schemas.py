"""Schemas of landed inputs. Field names are those of the files."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


S, L, D, B, TS = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType()

FILE_ENTRY = _struct(title=S, href=S, displaySize=S, updated=S, length=L, size=L)

DELIVERY_STATS = _struct(
    produkttyp=S,
    product_type=S,
    datatyp=S,
    data_type=S,
    features=T.ArrayType(
        _struct(
            properties=_struct(filnamn=S, statistik=T.ArrayType(_struct(tabellnamn=S, antalObjekt=L))),
            geometry=_struct(type=S, coordinates=S),
        )
    ),
)
RINGS = T.ArrayType(T.ArrayType(T.ArrayType(D)))

TILE_INDEX = T.ArrayType(_struct(href=S, title=S, length=L))

ORDER_METADATA = _struct(
    order_id=S, download_date=S, files=T.ArrayType(FILE_ENTRY), total_size=L, package_name=S
)

STATION = _struct(
    LocationSignature=S, AdvertisedLocationName=S, Advertised=B, Geometry=_struct(WGS84=S)
)

PLACE = T.ArrayType(_struct(LocationName=S))
ANNOUNCEMENT = _struct(
    announcement_id=L,
    AdvertisedTrainIdent=S,
    LocationSignature=S,
    Operator=S,
    ActivityType=S,
    FromLocation=PLACE,
    ToLocation=PLACE,
    TimeAtLocation=TS,
    AdvertisedTimeAtLocation=TS,
)

VALUE = _struct(Value=D)
WEATHER = _struct(
    Id=S,
    Name=S,
    Geometry=_struct(WGS84=S),
    Observation=_struct(
        Sample=TS,
        Air=_struct(Temperature=VALUE, RelativeHumidity=VALUE, VisibleDistance=VALUE),
        Surface=_struct(Temperature=VALUE),
        Wind=T.ArrayType(_struct(Speed=VALUE, Direction=VALUE)),
        Weather=_struct(Precipitation=S),
    ),
)

POINTS = _struct(
    tile=S, node_key=S, x=D, y=D, z=D, red=T.IntegerType(), green=T.IntegerType(), blue=T.IntegerType(),
    intensity=T.IntegerType(),
)

# ``error`` is set on the one row of an archive that cannot be read; crc and size are those of its directory
MEMBER = _struct(order_id=S, path=S, zip_name=S, entry=L, inner_path=S, extension=S, size=L, crc=L, error=S)

COLUMN = _struct(name=S, type=S)
CATALOGUE = _struct(
    order_id=S,
    zip_name=S,
    inner_path=S,
    source_hash=S,
    layer_name=S,
    geometry_column=S,
    geometry_type=S,
    srid=T.IntegerType(),
    feature_count=L,
    columns=T.ArrayType(COLUMN),
    min_x=D,
    min_y=D,
    max_x=D,
    max_y=D,
    error=S,
)

# A layer or a feature of an unpacked member; values are under their storage classes
EXTRACTED = T.StructType(
    [
        *CATALOGUE.fields,
        T.StructField("kind", S),
        T.StructField("row_no", L),
        T.StructField("source_row", L),
        T.StructField("blob", T.BinaryType()),
        T.StructField("values", T.ArrayType(_struct(i=L, d=D, s=S, b=T.BinaryType()))),
    ]
)
