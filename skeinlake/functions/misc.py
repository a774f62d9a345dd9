"""Hashes, paths, media types, dates and small conversions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File extensions of media types.
EXTENSIONS = {
    "image/jpeg": ".jpg", "image/png": ".png", "image/gif": ".gif", "image/webp": ".webp", "image/avif": ".avif", "video/webm": ".webm", "video/mp4": ".mp4",
    "video/quicktime": ".mov", "audio/mpeg": ".mp3", "application/pdf": ".pdf", "text/plain": ".txt", "application/zip": ".zip", "application/x-7z-compressed": ".7z",
}
#: Media types of file extensions.
TYPES = {
    ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".gif": "image/gif", ".webp": "image/webp", ".webm": "video/webm", ".mp4": "video/mp4",
    ".pdf": "application/pdf", ".mp3": "audio/mpeg", ".txt": "text/plain", ".zip": "application/zip", ".mov": "video/quicktime", ".avif": "image/avif", ".7z": "application/x-7z-compressed",
}
#: First bytes of files, in hex.
MAGIC = {"FFD8FF": "image/jpeg", "89504E47": "image/png", "47494638": "image/gif", "1A45DFA3": "video/webm", "25504446": "application/pdf", "494433": "audio/mpeg", "504B0304": "application/zip", "377ABCAF": "application/x-7z-compressed"}
#: English and Spanish names of weekdays, Sunday first.
WEEKDAYS = [("sun", "sunday", "dom", "domingo"), ("mon", "monday", "lun", "lunes"), ("tue", "tuesday", "mar", "martes"), ("wed", "wednesday", "mié", "mie", "miércoles"), ("thu", "thursday", "jue", "jueves"), ("fri", "friday", "vie", "viernes"), ("sat", "saturday", "sáb", "sab", "sábado")]


def _map(d: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in d.items() for x in kv))


def extension(name: Column) -> Column:
    """The extension of a file name or address, with its dot; '' if it has none."""
    return F.lower(F.regexp_extract(name, r"(\.[A-Za-z0-9]+)$", 1))


def extension_of_type(mime: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(EXTENSIONS), F.lower(mime)), F.lit(".bin"))


def type_of_name(name: Column) -> Column:
    return F.try_element_at(_map(TYPES), extension(name))


def type_of_bytes(body: Column) -> Column:
    head, out = F.hex(F.substring(body, 1, 8)), F.lit(None).cast("string")
    for magic, mime in MAGIC.items():
        out = F.when(head.startswith(magic), mime).otherwise(out)
    return F.when(F.substring(head, 9, 8) == "66747970", "video/mp4").otherwise(out)


def media_class(mime: Column) -> Column:
    """image, audio or video; null for other types and for a class without a kind."""
    return F.when(mime.rlike("^(image|audio|video)/."), F.substring_index(mime, "/", 1))


def media_jobs(mime: Column) -> Column:
    """The analyses a stored file is handed to: text and image vector of images, speech of sound and video."""
    k = media_class(mime)
    return F.when(k == "image", F.array(F.lit("ocr"), F.lit("clip"))).when(k.isin("audio", "video"), F.array(F.lit("speech"))).otherwise(F.array().cast("array<string>"))


def stored_path(digest: Column, ext: Column, kind: str = "full") -> Column:
    """kind/ab/cd/<hash><ext>: where a file of that hash is kept."""
    return F.concat_ws("/", F.lit(kind), F.substring(digest, 1, 2), F.substring(digest, 3, 2), F.concat(digest, ext))


def hex_of_base64(c: Column) -> Column:
    return F.lower(F.hex(F.unbase64(c)))


def resolve_url(base: Column, u: Column) -> Column:
    """An absolute address of one that is absolute, without a scheme, from the root or relative."""
    root = F.regexp_extract(base, r"^(https?://[^/]+)", 1)
    return (
        F.when(u.rlike("^https?://"), u)
        .when(u.startswith("//"), F.concat(F.lit("https:"), u))
        .when(u.startswith("/"), F.concat(root, u))
        .when(u == "", u)
        .otherwise(F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), u))
    )


def unix_time(c: Column) -> Column:
    """A time of seconds since 1970; null for 0, less, and null."""
    return F.when(c > 0, F.timestamp_seconds(c))


def hours_between(a: Column, b: Column) -> Column:
    """Hours from b to a."""
    return (F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) / 3.6e9


def display_date(c: Column) -> Column:
    """UTC time of a displayed date: MM/DD/YY (Day), YYYY/MM/DD (Day), DD-MM-YY; null if it is none of them.

    Where month and day could be swapped, the weekday's name, in English or Spanish, decides; else the month comes first.
    """
    tail = r"\s*(\d{1,2}):(\d{2})(?::(\d{2}))?"
    day_name = r"\s*\(([\p{L}]{2,10})\)"
    slash, long_, dash = rf"^\s*(\d{{1,2}})/(\d{{1,2}})/(\d{{2}}){day_name}{tail}", rf"^\s*(\d{{4}})/(\d{{1,2}})/(\d{{1,2}}){day_name}{tail}", rf"^\s*(\d{{1,2}})-(\d{{1,2}})-(\d{{2}}){tail}"
    get = lambda p, k: F.regexp_extract(c, p, k)
    num = lambda p, k: F.when(get(p, k) != "", get(p, k).cast("int")).otherwise(0)

    def at(p, y, m, d, hour) -> Column:
        valid = (m >= 1) & (m <= 12) & (d >= 1) & (d <= 31)
        return F.when(valid, F.try_make_timestamp(y, m, d, num(p, hour), num(p, hour + 1), num(p, hour + 2).cast("decimal(16,6)")))

    names = {n: i + 1 for i, day in enumerate(WEEKDAYS) for n in day}
    wanted = F.try_element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), F.lower(get(slash, 4)))
    md = at(slash, num(slash, 3) + 2000, num(slash, 1), num(slash, 2), 5)
    dm = at(slash, num(slash, 3) + 2000, num(slash, 2), num(slash, 1), 5)
    fits = lambda t: t.isNotNull() & (wanted.isNull() | (F.dayofweek(t) == wanted))
    return (
        F.when(c.rlike(long_), at(long_, num(long_, 1), num(long_, 2), num(long_, 3), 5))
        .when(c.rlike(dash), at(dash, num(dash, 3) + 2000, num(dash, 2), num(dash, 1), 4))
        .when(c.rlike(slash), F.when(fits(md), md).when(fits(dm), dm).otherwise(md))
    )


def tolerant_long(c: Column) -> Column:
    """A whole number that may be written as text or be null."""
    return F.when(F.trim(c).rlike(r"^[+-]?\d{1,18}$"), F.trim(c).cast("long"))


def first_text(*cs: Column) -> Column:
    """The first that is neither null nor empty, else ''."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in cs), F.lit(""))


def human_size(c: Column) -> Column:
    """Bytes with a unit and one decimal from KB on."""
    return (
        F.when(c < 1024, F.format_string("%d B", c))
        .when(c < 1024**2, F.format_string("%.1f KB", c / 1024))
        .when(c < 1024**3, F.format_string("%.1f MB", c / 1024**2))
        .otherwise(F.format_string("%.1f GB", c / 1024**3))
    )


def severity(kind: Column, value: Column) -> Column:
    """How bad an anomaly is; unknown kinds are medium."""
    limit = F.when(kind == "volume", 5.0).when(kind == "burst", 10.0).when(kind == "coordination", 5.0)
    return F.when(limit.isNull(), "medium").when(value > limit, "critical").otherwise("high")
