"""Column functions on image file names, paths and metric names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Image file types, name layouts and patterns.
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "webp")
PITTS_NOTE_PATTERN = r"(?i)^pitch(\d+)_yaw(\d+)$"
PITTS_MIN_FIELDS = 15
YAW_STEP_DEGREES = 30
YAW_VIEWS = 12
CITY_IMAGE_FORMAT = "%s_%07d_%04d_%02d_%03d_%s_%s_%s.jpg"

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_stem(name: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(name, r"\.[^.]*$", "")


def has_image_extension(path: Column) -> Column:
    """Whether the last extension is one of the image types, in any case."""
    extension = F.lower(F.regexp_extract(file_name(path), r"[^.]\.([^.]*)$", 1))
    return extension.isin(*IMAGE_EXTENSIONS)


def lenient_double(text: Column) -> Column:
    """Number in the trimmed text, or null."""
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(_NUMBER), trimmed.try_cast("double"))


def _fields(name: Column) -> Column:
    return F.split(file_stem(name), "@")


def _once(value: Column, build) -> Column:
    """``build(value)`` with *value* computed a single time per row."""
    return F.element_at(F.transform(F.array(value), build), 1)


def lenient_position(name: Column) -> Column:
    """Struct of utm_east, utm_north, heading of an ``@``-name; null where unreadable."""

    def build(parts: Column) -> Column:
        skip = F.when(F.element_at(parts, 1) == "", 1).otherwise(0)

        def field(index: int) -> Column:
            return lenient_double(F.try_element_at(parts, skip + F.lit(index + 1)))

        return F.struct(
            field(0).alias("utm_east"), field(1).alias("utm_north"), field(8).alias("heading")
        )

    return _once(_fields(name), build)


def strict_pitts(name: Column) -> Column:
    """Struct of the fields of a panorama-view name, with a ``problem`` text.

    ``problem`` is null for a well-formed name.  The heading is derived from the
    yaw view: view 1 looks to 0 degrees and each further view adds 30.
    """

    def build(parts: Column) -> Column:
        def field(index: int) -> Column:
            return F.try_element_at(parts, F.lit(index + 1))

        def view(group: int) -> Column:
            return F.regexp_extract(field(14), PITTS_NOTE_PATTERN, group).try_cast("int")

        return F.struct(
            F.size(parts).alias("n"), lenient_double(field(1)).alias("utm_east"),
            lenient_double(field(2)).alias("utm_north"), view(1).alias("pitch_index"),
            view(2).alias("yaw_index"), field(8).alias("tile_text"),
            F.trim(field(8)).try_cast("int").alias("tile"), field(7).alias("pano_id"),
        )

    def judge(p: Column) -> Column:
        has_tile = p["tile_text"] != ""
        problem = (
            F.when(p["n"] < PITTS_MIN_FIELDS, F.lit("too few fields"))
            .when(p["utm_east"].isNull() | p["utm_north"].isNull(), F.lit("position is not a number"))
            .when(has_tile & p["tile"].isNull(), F.lit("tile is not a number"))
            .when(p["yaw_index"].isNull() | p["pitch_index"].isNull(), F.lit("pitch and yaw not found"))
            .when(~p["yaw_index"].between(1, YAW_VIEWS), F.lit("yaw out of range"))
        )
        return F.struct(
            p["utm_east"].alias("utm_east"), p["utm_north"].alias("utm_north"),
            ((p["yaw_index"] - 1) * YAW_STEP_DEGREES).cast("double").alias("heading"),
            p["pitch_index"].alias("pitch_index"), p["yaw_index"].alias("yaw_index"),
            F.when(has_tile, p["tile"]).alias("tile_num"), p["pano_id"].alias("pano_id"),
            problem.alias("problem"),
        )

    return _once(_once(_fields(name), build), judge)


def relative_path(path: Column, *bases: str) -> Column:
    """Path below the first base that contains it, else the path itself."""
    options = [_below(path, base.rstrip("/") + "/") for base in bases]
    return F.coalesce(*options, path)


def _below(path: Column, prefix: str) -> Column:
    return F.when(
        path.startswith(prefix), F.substring(path, len(prefix) + 1, 2_147_483_647)
    )


def walk_key(path: Column) -> Column:
    """Sort key of a depth-first walk: files of a folder before its subfolders.

    Folder names are marked 1 and the file name 0 behind a NUL, which no name holds
    and which sorts before every other character.
    """
    folder = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.concat(
        F.replace(folder, F.lit("/"), F.lit("\u00001")), F.lit("\u00000"), file_name(path)
    )


def city_image_path(
    city: Column, place: Column, year: Column, month: Column, north: Column,
    lat: Column, lon: Column, pano: Column,
) -> Column:
    """Path of a city image, with the place number as it stands in the CSV."""
    name = F.format_string(
        CITY_IMAGE_FORMAT, city, place, year, month, north,
        plain_number(lat), plain_number(lon), pano,
    )
    return F.concat(F.lit("Images/"), city, F.lit("/"), name)


def plain_number(value: Column) -> Column:
    """Shortest text of a double, with an exponent only below 1e-4 and from 1e16 on."""
    text = value.cast("string")
    size = F.abs(value)
    digits = F.regexp_replace(F.regexp_extract(text, "^-?(.*)E", 1), r"\.0$|\.", "")
    power = F.regexp_extract(text, "E(-?[0-9]+)$", 1).try_cast("int")
    sign = F.when(value < 0, F.lit("-")).otherwise(F.lit(""))
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    whole = F.concat(sign, F.rpad(digits, power + 1, "0"), F.lit(".0"))
    # a number of 17 digits below 1e16 keeps its fraction
    large = F.when(F.length(digits) <= power + 1, whole).otherwise(
        F.concat(sign, F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, F.length(digits)))
    )
    mantissa = F.regexp_replace(F.regexp_extract(text, "^(.*)E", 1), r"\.0$", "")
    tail = F.concat(F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+")), F.lpad(F.abs(power).cast("string"), 2, "0"))
    return (
        F.when(~F.contains(text, F.lit("E")), text)
        .when((size >= 1e-4) & (size < 1), small).when((size >= 1) & (size < 1e16), large)
        .otherwise(F.concat(mantissa, tail))
    )


def is_recall_metric(name: Column) -> Column:
    return F.contains(name, F.lit("/R@"))


def metric_dataset(name: Column) -> Column:
    """Part before the last ``/``, without a leading ``test/``."""
    return F.regexp_replace(F.regexp_extract(name, r"^(.*)/[^/]*$", 1), "^test/", "")


def metric_label(name: Column) -> Column:
    return F.regexp_extract(name, r"([^/]*)$", 1)


def percent_text(name: Column, value: Column) -> Column:
    """One decimal, halves to even; recalls are shown in percent."""
    return one_decimal(F.when(is_recall_metric(name), value * 100).otherwise(value))


def one_decimal(value: Column) -> Column:
    """The double itself, not its short text, rounded to one decimal; exact ties go to the even digit.

    Ten times the value is taken exactly as a sum of two doubles, so that the place of
    the value between two tenths is known.
    """
    size = F.abs(value)
    a, b = size * 8, size * 2
    ten = a + b
    high = ten - b  # two-sum: what the addition has lost
    lost = (a - high) + (b - (ten - high))
    low = F.floor(ten).cast("double")
    beyond = ten - low - 0.5
    odd = F.pmod(low, F.lit(2.0)) == 1.0
    up = (beyond > 0) | ((beyond == 0) & ((lost > 0) | ((lost == 0) & odd)))
    tenths = (low + up.cast("double")).cast("long")
    text = F.concat(
        F.when(value < 0, F.lit("-")).otherwise(F.lit("")), F.floor(tenths / 10).cast("string"), F.lit("."),
        F.pmod(tenths, F.lit(10)).cast("string"),
    )
    return F.when(size < 1e14, text).otherwise(F.format_string("%.1f", value))


