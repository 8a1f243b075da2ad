"""Names, sizes, times and file types as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# File extension to data type.
EXTENSION_TYPES = {
    ".gpkg": "vector_gpkg",
    ".laz": "lidar_laz",
    ".las": "lidar_laz",
    ".tif": "raster_dem",
    ".tiff": "raster_dem",
    ".jp2": "raster_ortho",
}

# Product words in delivery metadata to data type.
PRODUCT_TYPES = {
    "topografi": "vector_gpkg",
    "administrativ": "vector_gpkg",
    "fastighet": "vector_gpkg",
    "hojddata": "raster_dem",
    "hojdmodell": "raster_dem",
    "laserdata": "lidar_laz",
    "ortofoto": "raster_ortho",
}

# Metadata keys that may carry a product word.
HINT_KEYS = ("produkttyp", "product_type", "datatyp", "data_type")

# Data type labels.
TYPE_LABELS = {
    "vector_gpkg": "Vector (GeoPackage)",
    "lidar_laz": "LiDAR (LAZ)",
    "lidar_index": "LiDAR (On-Demand)",
    "raster_dem": "Raster (DEM)",
    "raster_ortho": "Raster (Orthophoto)",
    "unknown": "Unknown",
}

# Source column type to Spark type; any other becomes a string.
COLUMN_TYPES = {
    "INTEGER": T.LongType(),
    "REAL": T.DoubleType(),
    "TEXT": T.StringType(),
    "BLOB": T.BinaryType(),
    "NUMERIC": T.DecimalType(38, 18),
    "BOOLEAN": T.BooleanType(),
}

# Patterns of tile titles, nation-wide layer endings, converted tiles.
TILE_TITLE = r"^[^_]+_(\d+)_(\d+)_.*\.laz$"
LAYER_ENDINGS = r"(_sverige|_sweden)$"
CONVERTED_ENDING = ".copc.laz"
TILE_ENDING = ".laz"

KB, MB, GB = 1024, 1024**2, 1024**3


def _lookup(table: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(item) for entry in table.items() for item in entry]
    return F.try_element_at(F.create_map(*pairs), key)


# --- file names --------------------------------------------------------------


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(path: Column) -> Column:
    """Lower-case last extension with its dot; empty for none or a leading dot only."""
    return F.lower(F.regexp_extract(base_name(path), r"[^.](\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=[^.])\.[^.]+$", "")


def data_type(ext: Column) -> Column:
    """Data type of an extension, null for one that is not known."""
    return _lookup(EXTENSION_TYPES, ext)


def type_label(kind: Column) -> Column:
    return F.coalesce(_lookup(TYPE_LABELS, kind), F.lit("Unknown"))


def is_publishable(kind: Column) -> Column:
    return kind == "vector_gpkg"


def product_hint(values: list[Column]) -> Column:
    """Data type named by the metadata; the last key with a known word decides."""

    def hint(value: Column) -> Column:
        low = F.lower(value)
        found = F.lit(None).cast("string")
        for word, kind in reversed(PRODUCT_TYPES.items()):
            found = F.when(low.contains(word), kind).otherwise(found)
        return found

    return F.coalesce(*[hint(value) for value in reversed(values)])


def layer_name(path: Column) -> Column:
    """Layer named by a member path: its stem without one nation-wide ending."""
    return F.regexp_replace(stem(path), LAYER_ENDINGS, "")


def table_name(layer: Column) -> Column:
    clean = F.regexp_replace(F.lower(layer), "[^a-z0-9_]", "_")
    return F.when(clean.rlike("^[0-9]"), F.concat(F.lit("_"), clean)).otherwise(clean)


def clean_name(name: str) -> str:
    """Driver-side twin of :func:`table_name`, for one name at a time."""
    out = "".join(c if c.isascii() and (c.isalnum() or c == "_") else "_" for c in name.lower())
    return "_" + out if out[:1].isdigit() else out


def grid_numbers(title: Column, index_name: Column) -> dict[str, Column]:
    """Grid numbers in a tile title, else ten times those of its index file."""

    def number(group: int) -> Column:
        own = F.regexp_extract(title, TILE_TITLE, group)
        index = F.regexp_extract(index_name, r"^(\d+)_(\d+)$", group)
        return F.coalesce(
            F.nullif(own, F.lit("")).cast("int"), F.nullif(index, F.lit("")).cast("int") * 10
        )

    return {"grid_x": number(1), "grid_y": number(2)}


def converted_name(tile: Column) -> Column:
    """Converted file of a tile, given with or without its ending."""
    return F.concat(F.regexp_replace(tile, r"\.laz$", ""), F.lit(CONVERTED_ENDING))


def converted_stem(name: Column) -> Column:
    """Tile name of a converted file."""
    return F.replace(name, F.lit(CONVERTED_ENDING), F.lit(""))


def source_tile(name: Column) -> Column:
    return F.concat(converted_stem(name), F.lit(TILE_ENDING))


# --- sizes ---------------------------------------------------------------------


def size_text(size: Column) -> Column:
    """Bytes with a unit: one decimal for KB and MB, two for GB, ties to even."""
    number = size.cast("double")
    return (
        F.when(size < KB, F.format_string("%d B", size.cast("bigint")))
        .when(size < MB, F.format_string("%.1f KB", F.bround(number / KB, 1)))
        .when(size < GB, F.format_string("%.1f MB", F.bround(number / MB, 1)))
        .otherwise(F.format_string("%.2f GB", F.bround(number / GB, 2)))
    )


def size_text_short(size: Column) -> Column:
    """Bytes with a unit, one decimal at most, no trailing zero, ties up."""
    number = size.cast("double")

    def scaled(base: int, unit: str) -> Column:
        shown = F.regexp_replace(F.format_string("%.1f", number / base), r"\.0$", "")
        return F.concat(shown, F.lit(" " + unit))

    return (
        F.when(size < KB, F.format_string("%d B", size.cast("bigint")))
        .when(size < MB, scaled(KB, "KB"))
        .when(size < GB, scaled(MB, "MB"))
        .otherwise(scaled(GB, "GB"))
    )


def size_mb(size: Column, digits: int = 2) -> Column:
    """Megabytes, ties to even."""
    return F.bround(size / MB, digits)


def file_length(*candidates: Column) -> Column:
    """First length that is present, else zero."""
    return F.coalesce(*candidates, F.lit(0)).cast("bigint")


# --- times and numbers ---------------------------------------------------------


def iso_instant(text: Column) -> Column:
    """ISO-8601 text to an instant; naive text is in the session zone, bad text gives null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(text))


def minute_text(text: Column) -> Column:
    """Date text to the minute; text that is no date is kept as it is."""
    return F.coalesce(F.date_format(iso_instant(text), "yyyy-MM-dd HH:mm"), text)


def grouped(number: Column) -> Column:
    """Whole number with thousands separators."""
    return F.format_number(number.cast("bigint"), 0)


def rendered(df: DataFrame) -> DataFrame:
    """Rows as a result list shows them: ISO times, ``<binary>`` for bytes."""

    def show(field: T.StructField) -> Column:
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.BinaryType):
            return F.when(value.isNotNull(), F.lit("<binary>")).alias(field.name)
        if isinstance(field.dataType, T.DateType):
            return F.date_format(value, "yyyy-MM-dd").alias(field.name)
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            whole = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
            part = F.date_format(value, ".SSSSSS")
            zone = (
                F.date_format(value, "xxx") if isinstance(field.dataType, T.TimestampType) else F.lit("")
            )
            return F.concat(whole, F.when(part == ".000000", "").otherwise(part), zone).alias(field.name)
        return value

    return df.select(*[show(field) for field in df.schema.fields])


def spark_type(source_type: str) -> T.DataType:
    """Spark type of a source column type, looked up by its whole name."""
    return COLUMN_TYPES.get(source_type.upper(), T.StringType())
