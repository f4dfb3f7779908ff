"""Asset keys, identifiers and timestamps as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Image extensions, key prefixes and the name space of point ids.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp", ".bmp", ".tiff")
NARROW_EXTENSIONS = (".jpg", ".jpeg", ".png")
ANONYMOUS = "anonymous-images"
PROFILES = "user-profiles"
TEMPORARY = "temp-uploads"
RESULTS = "clustering-results"
DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"

API_ID = r"^[\p{L}\p{N}_\-.@]{1,64}$"
PATH_ID = r"^[a-zA-Z0-9_-]+$"


def has_extension(key: Column, extensions: tuple[str, ...] = IMAGE_EXTENSIONS) -> Column:
    pattern = "|".join(e.lstrip(".") for e in extensions)
    return F.lower(key).rlike(rf"\.({pattern})$")


def parse_asset_path(path: Column) -> Column:
    """Struct of main_category, sub_category, batch_name, user_id, filename and three flags.

    Fewer than two parts: everything NULL and the flags false.
    """
    parts = F.split(F.regexp_replace(path, "^/+|/+$", ""), "/")
    # bound to a lambda variable, so that the key is split once and not in every branch
    return F.get(F.transform(F.array(parts), _describe_parts), F.lit(0))


def _describe_parts(parts: Column) -> Column:
    n = F.size(parts)
    main = F.when(n >= 2, F.get(parts, F.lit(0)))
    second, last = F.get(parts, F.lit(1)), F.get(parts, n - 1)

    def is_kind(prefix: str) -> Column:
        return F.coalesce(main == prefix, F.lit(False))

    anonymous, profile, temporary = is_kind(ANONYMOUS), is_kind(PROFILES), is_kind(TEMPORARY)
    filename = F.when(anonymous | temporary, last).when(
        profile, F.when(n > 2, last).otherwise(F.lit("profile.jpg"))
    )
    return F.struct(
        main.alias("main_category"),
        F.when(temporary, second).alias("sub_category"),
        F.when(anonymous, second).alias("batch_name"),
        F.when(profile, second).alias("user_id"),
        filename.alias("filename"),
        anonymous.alias("is_anonymous"),
        profile.alias("is_user_profile"),
        temporary.alias("is_temp"),
    )


def clean_path_component(name: Column) -> Column:
    """Unsafe characters to ``_``, runs of it joined, ends trimmed, ``default`` if nothing is left."""
    safe = F.regexp_replace(F.coalesce(name, F.lit("")), "[^a-zA-Z0-9-]+", "_")
    return F.lower(F.regexp_replace(F.btrim(safe, F.lit("_")), "^$", "default"))


def clean_filename(name: Column) -> Column:
    """Cleaned stem plus the extension as it was; ``.jpg`` when there is none.

    Leading dots belong to the stem: ``.hidden`` has no extension.
    """
    extension = F.regexp_extract(name, r"^.*[^./][^/]*?(\.[^./]*)$", 1)

    def cleaned(ext: Column) -> Column:
        stem = F.substring(name, F.lit(1), F.length(name) - F.length(ext))
        return F.concat(clean_path_component(stem), F.when(ext == "", ".jpg").otherwise(ext))

    made = F.get(F.transform(F.array(extension), cleaned), F.lit(0))
    return F.when(name.isNull() | (name == ""), F.lit("file.jpg")).otherwise(made)


def anonymous_path(batch: Column) -> Column:
    return F.concat_ws("/", F.lit(ANONYMOUS), clean_path_component(batch))


def profile_path(user_id: Column) -> Column:
    return F.concat_ws("/", F.lit(PROFILES), clean_path_component(user_id))


def profile_image_key(user_id: Column, filename: Column | None = None) -> Column:
    name = F.lit("profile.jpg") if filename is None else filename
    return F.concat_ws("/", profile_path(user_id), clean_filename(name))


def temp_path(session: Column) -> Column:
    return F.concat_ws("/", F.lit(TEMPORARY), clean_path_component(session))


def results_path(bucket: Column, sub_bucket: Column) -> Column:
    return F.concat_ws("/", F.lit(RESULTS), clean_path_component(bucket), clean_path_component(sub_bucket))


def surrogate_user_id(email: Column, name: Column) -> Column:
    """``user_`` + first 12 hex digits of md5 of e-mail or name; a random uuid without both."""
    source = F.coalesce(F.nullif(email, F.lit("")), F.nullif(name, F.lit("")))
    hashed = F.concat(F.lit("user_"), F.substring(F.md5(source.cast("binary")), 1, 12))
    return F.when(source.isNotNull(), hashed).otherwise(F.expr("uuid()"))


def sequential_user_id(number: Column) -> Column:
    """``user_000001`` style id of a running number."""
    return F.format_string("user_%06d", number)


def timestamp_user_id(at: Column) -> Column:
    return F.concat(F.lit("user_"), F.unix_millis(at).cast("string"))


def valid_user_id(user_id: Column) -> Column:
    """1 to 64 word characters (of any script), ``-``, ``.`` or ``@``."""
    return F.coalesce(user_id.rlike(API_ID), F.lit(False))


def valid_path_id(user_id: Column) -> Column:
    return F.coalesce(user_id.rlike(PATH_ID), F.lit(False))


def run_table_name(kind: str, bucket: Column, sub_bucket: Column) -> Column:
    """Name of the result table of a bucket; one derivation for writers and readers."""
    return F.lower(F.regexp_replace(F.concat_ws("_", F.lit(kind), bucket, sub_bucket), "[/-]", "_"))


def point_id(face_id: Column, run_id: Column) -> Column:
    """Name-based uuid (version 5, DNS name space) of ``face_id`` + ``_`` + ``run_id``."""
    name = F.concat_ws("_", face_id, run_id).cast("binary")
    digest = F.sha1(F.concat(F.unhex(F.lit(DNS_NAMESPACE)), name))
    nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int")
    variant = F.substring(F.lit("89ab"), nibble % 4 + 1, F.lit(1))
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"),
        F.substring(digest, 14, 3), F.lit("-"), variant, F.substring(digest, 18, 3),
        F.lit("-"), F.substring(digest, 21, 12),
    )


def coerce_timestamp(text: Column) -> tuple[Column, Column]:
    """(timestamp, bad flag) of an ISO string; what cannot be read is NULL and flagged."""
    parsed = F.try_to_timestamp(text)
    return parsed, text.isNotNull() & parsed.isNull()
