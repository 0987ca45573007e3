"""Free-text photo queries as metadata and remaining words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Months, brands of cameras and lenses in the order they are tried, fields and their other names.
MONTHS = "january february march april may june july august september october november december".split()
CAMERAS = [
    "sony", "canon", "nikon", "fuji", "fujifilm", "leica", "olympus", "panasonic", "pentax", "ricoh", "hasselblad", "apple", "samsung", "google",
    "lumix", "sigma", "phase one", "mamiya", "minolta", "kodak", "casio", "epson", "xiaomi",
]
LENSES = ["zeiss", "sigma", "tamron", "tokina", "canon", "nikon", "sony", "fujinon", "leica", "olympus", "panasonic", "pentax", "ricoh", "hasselblad"]
FIELDS = """year month location city country caption date_taken date_modified date_digitized camera_make camera_model camera_serial lens_model
lens_make lens_info lens_id lens_serial aperture focal_length shutter_speed iso exposure_program white_balance flash_fired tags keywords subject
file_extension image_format color_mode resolution width height aspect_ratio filename path file_size_mb color_temperature contrast saturation
sharpness metering_mode scene_type exposure_bias""".split()
ALIASES = {"aperture_value": "aperture", "focal_length_35mm": "focal_length"}

_PARTS = {"aperture": r"(?i)f/?\s?(\d+\.?\d*)", "focal_length": r"(?i)(\d+\.?\d*)\s?mm", "iso": r"(?i)iso\s?(\d+)", "shutter_speed": r"(?i)(1/\d+s|\d+\.?\d*s)"}
_TAG, _KEYWORD = r"(?i)(?:tag:|#)(\w+)", r"(?i)(?:keyword:|kw:)(\w+)"
_FIELD = rf"(?i)({'|'.join(sorted([*FIELDS, *ALIASES], key=len, reverse=True))})\s*[:=]\s*([\w\-.]+)"


def parse(text: Column) -> dict[str, Column]:
    """The metadata of a query, in lower case, and `rest`, the words that are no metadata. `fields` holds
    what stands as name:value or name=value, under the canonical name, in the order of appearance."""
    lower = F.lower(text)
    part = lambda pattern: F.nullif(F.regexp_extract(lower, pattern, 1), F.lit(""))
    first = lambda words: F.coalesce(*[F.when(lower.contains(w), w) for w in words])
    joined = lambda pattern: F.nullif(F.array_join(F.regexp_extract_all(lower, F.lit(pattern), 1), ","), F.lit(""))
    canonical = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    names, values = (F.regexp_extract_all(lower, F.lit(_FIELD), g) for g in (1, 2))
    fields = F.zip_with(names, values, lambda n, v: F.concat(F.coalesce(canonical[n], n), F.lit("="), v))
    found = {"year": part(r"((?:19|20)\d{2})"), "month": first(MONTHS), "camera_make": first(CAMERAS), "lens_make": first(LENSES)}
    rest = text
    for word in found.values():
        rest = F.when(word.isNull(), rest).otherwise(F.regexp_replace(rest, F.concat(F.lit("(?i)"), word), F.lit("")))
    for pattern in (*_PARTS.values(), _TAG, _KEYWORD, _FIELD):
        rest = F.regexp_replace(rest, pattern, "")
    return {
        **found,
        "aperture": F.concat(F.lit("f/"), part(_PARTS["aperture"])),
        "focal_length": F.concat(part(_PARTS["focal_length"]), F.lit("mm")),
        "iso": part(_PARTS["iso"]), "shutter_speed": part(_PARTS["shutter_speed"]),
        "tags": joined(_TAG), "keywords": joined(_KEYWORD), "fields": F.nullif(F.array_join(fields, ","), F.lit("")),
        "rest": F.trim(F.regexp_replace(rest, r"\s+", " ")),
    }


# Properties of photo metadata and the fields they fill, the earlier before the later; labels of codes.
PROPERTIES = {
    "aperture": ["FNumber", "ApertureValue"], "camera_make": ["Make", "CameraManufacturer"], "camera_model": ["Model", "CameraModel"],
    "date_taken": ["DateTimeOriginal", "DateTime", "CreateDate", "DateCreated"], "date_modified": ["ModifyDate"], "exposure_program": ["ExposureProgram"],
    "flash_fired": ["Flash"], "focal_length": ["FocalLength", "FocalLengthIn35mmFilm"], "iso": ["ISO", "ISOSpeedRatings", "ISOSpeedRating"],
    "shutter_speed": ["ExposureTime", "ShutterSpeedValue"], "white_balance": ["WhiteBalance"], "lens_model": ["Lens", "LensModel"], "lens_info": ["LensInfo"],
    "lens_make": ["LensMake", "LensManufacturer"], "lens_id": ["LensID"], "lens_serial": ["LensSerialNumber"], "camera_serial": ["BodySerialNumber", "CameraSerialNumber"],
    "color_temperature": ["Temperature"],
}
PROGRAMS = ["Not Defined", "Manual", "Normal", "Aperture Priority", "Shutter Priority", "Creative", "Action", "Portrait", "Landscape"]
LOWER = {"camera_make", "camera_model", "lens_make", "lens_model"}
LABELS = {
    "exposure_program": {str(k): v for k, v in enumerate(PROGRAMS)}, "white_balance": {"0": "Auto", "1": "Manual"},
    "flash_fired": {"0": "False", "1": "True", "9": "True", "16": "False"},
}


def properties(raw: Column) -> Column:
    """Photo properties (map of strings by local name) as a map of fields: `f/2.8`, `50mm`, `0.00500s`, labels of
    codes, times as `yyyy-MM-dd HH:mm:ss`, makes and models in lower case. What cannot be formatted stays as it is, but for times, which are
    left out; unknown properties, nulls and empty values are left out."""
    as_double = lambda v: F.when(v.rlike(r"^\s*[-+]?(?:\d+\.?\d*|\.\d+)\s*$"), v.cast("double"))

    def shown(field: str, v: Column) -> Column:
        if field == "aperture":
            return F.when(as_double(v).isNotNull(), F.concat(F.lit("f/"), F.format_string("%.1f", as_double(v)))).otherwise(v)
        if field == "focal_length":
            return F.when(v.contains("mm"), v).otherwise(F.concat(v, F.lit("mm")))
        if field == "shutter_speed":
            return F.when(as_double(v).isNotNull(), F.concat(F.format_string("%.5f", as_double(v)), F.lit("s"))).otherwise(v)
        if field == "date_taken":
            plain = F.regexp_extract(v, r"^([^+.]*)", 1)
            return F.when(plain.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$|^\d{4}:\d{2}:\d{2} \d{2}:\d{2}:\d{2}$"), F.regexp_replace(plain, r"^(\d{4})[:-](\d{2})[:-](\d{2})[T ](.*)$", "$1-$2-$3 $4"))
        if field in LOWER:
            return F.lower(v)
        if field in LABELS:
            labels = F.create_map(*[F.lit(x) for pair in LABELS[field].items() for x in pair])
            return F.coalesce(F.try_element_at(labels, v), v)
        return v

    # A lambda's variable holds the value of a field, so that it is looked up once.
    field = lambda f, v: F.transform(F.array(v), lambda x: F.struct(F.lit(f).alias("key"), shown(f, x).alias("value")))[0]
    found = [field(f, F.coalesce(*[F.nullif(F.try_element_at(raw, F.lit(n)), F.lit("")) for n in names])) for f, names in PROPERTIES.items()]
    return F.when(raw.isNotNull(), F.map_from_entries(F.filter(F.array(*found), lambda s: s["value"].isNotNull())))
