"""Names, paths and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the media formats, names and vocabularies that results must agree with.
MEDIA_EXTENSIONS = ["jpg", "jpeg", "png", "heic", "heif", "gif", "webp", "bmp", "tif", "tiff", "mp4", "mov", "m4v"]
INDEX_MIME = {
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "heic": "image/heic", "heif": "image/heic", "gif": "image/gif",
    "webp": "image/webp", "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff", "mp4": "video/mp4", "m4v": "video/mp4", "mov": "video/quicktime",
}
DISPLAY_MIME = INDEX_MIME | {"mov": "video/mp4"}
COPYABLE = ["jpg", "jpeg", "png"]
RENDERABLE = ["jpg", "jpeg", "png", "webp", "gif", "bmp"]
BANNED_NAMES = [
    "family gathering", "weekend moments", "family time", "special memories", "good times", "fun times", "daily life", "everyday moments",
]
EVENT_TYPES = [
    "holiday", "birthday", "vacation", "sports", "school", "family", "anniversary", "graduation", "travel", "day_trip", "misc", "other",
]
PEOPLE_FOCUS = ["family", "individual", "mixed", "unknown"]
CONFIDENCES = ["high", "medium", "low"]
STATUSES = ["queued", "indexed", "image_reviewed", "video_reviewed", "date_verified", "grouped", "filed", "excluded"]
LEGACY_STATUSES = ["downloading", "downloaded", "metadata_extracted", "date_review_pending", "error"]


def extension(name: Column) -> Column:
    """Lower-case extension of a file name; '' without one."""
    return F.lower(F.regexp_extract(name, r"[^/]\.([^./]*)$", 1))


def mime_of(name: Column, table: dict[str, str] = INDEX_MIME) -> Column:
    """MIME type by extension, else application/octet-stream."""
    kinds = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(kinds, extension(name)), F.lit("application/octet-stream"))


def sanitize_folder_name(name: Column) -> Column:
    """Reserved characters become '-', outer blanks go, then the dots at the end, then the spaces before those."""
    clean = F.regexp_replace(name, r'[<>:"/\\|?*]', "-")
    return F.rtrim(F.rtrim(F.trim(clean, F.lit(" \t\r\n")), F.lit(".")), F.lit(" "))


def filename_prefix(name: Column) -> Column:
    """Lower-case stem without trailing digits, underscores, hyphens and spaces."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"\.[^.]*$", ""), r"[0-9_\- ]+$", "")


def normalise_name(name: Column) -> Column:
    return F.lower(F.trim(name))


def with_year(name: Column, year: Column) -> Column:
    """'YYYY - name', once."""
    prefix = F.concat(year.cast("string"), F.lit(" - "))
    return F.when(F.startswith(name, prefix), name).otherwise(F.concat(prefix, name))


def without_year(name: Column, year: Column) -> Column:
    prefix = F.concat(year.cast("string"), F.lit(" - "))
    return F.when(F.startswith(name, prefix), F.substr(name, F.length(prefix) + 1)).otherwise(name)


def remap_status(status: Column) -> Column:
    """Known statuses stay, retired ones are indexed, others queued."""
    return F.when(status.isin(STATUSES), status).when(status.isin(LEGACY_STATUSES), "indexed").otherwise("queued")


def format_bytes(n: Column) -> Column:
    """'1.5 MB', '12 KB' or '7 B'."""
    mb, kb = n / 1048576, n / 1024
    return (
        F.when(n >= 1048576, F.concat(F.format_string("%.1f", mb), F.lit(" MB")))
        .when(n >= 1024, F.concat(F.floor(kb + 0.5).cast("string"), F.lit(" KB")))
        .otherwise(F.concat(n.cast("string"), F.lit(" B")))
    )


def format_duration(seconds: Column) -> Column:
    """'m:ss' of a rounded, non-negative number of seconds; null for null, which greatest() passes over."""
    total = F.greatest(F.lit(0), F.floor(seconds + 0.5))
    return F.when(seconds.isNotNull(), F.concat(F.floor(total / 60).cast("string"), F.lit(":"), F.lpad((total % 60).cast("string"), 2, "0")))


def model_id(provider: Column, model: Column) -> Column:
    """'provider:model'."""
    return F.concat(provider, F.lit(":"), model)


def long_path(path: Column, most: int = 240) -> Column:
    """A Windows path of more than `most` bytes with the prefix that lifts the limit, once; others unchanged."""
    return F.when((F.octet_length(path) > most) & ~F.startswith(path, F.lit("\\\\?\\")), F.concat(F.lit("\\\\?\\"), path)).otherwise(path)


def location_hint(city: Column, country: Column) -> Column:
    return F.concat(F.lit("GPS data suggests these photos were taken in: "), city, F.lit(", "), country)


def auth_status(message: Column, default: str = "error") -> Column:
    """Status named by the text of a sign-in error; the first rule that fits."""
    m = F.lower(message)
    return (
        F.when(m.contains("password missing") | m.contains("no password entered"), "session_required")
        .when(m.contains("invalid email"), "invalid_credentials")
        .when(m.contains("advanced data protection") | m.contains("adp"), "adp_unsupported")
        .when(m.contains("missing apple_id field") | m.contains("srp"), "error")
        .otherwise(default)
    )


def data_url(mime: Column, content: Column, size: Column, cap: int = 25 * 1024 * 1024) -> Column:
    """A data: URL of binary content, null above the size cap."""
    return F.when(size <= cap, F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64(content)))
