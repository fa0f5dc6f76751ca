"""Scalar functions of the catalog as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File kinds by extension, and the media types of all of them.
RAW = ("nef", "cr2", "cr3", "arw", "orf", "raf", "rw2", "dng", "pef", "srw", "x3f", "3fr")
PICTURE = ("jpg", "jpeg", "png", "gif", "bmp", "tif", "tiff", "webp", "heic", "heif")
VIDEO = ("mp4", "mov", "avi", "mkv", "m4v", "mts", "mpg", "mpeg", "wmv", "webm", "flv", "3gp")
MIME = {
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp", "tif": "image/tiff", "tiff": "image/tiff", "heic": "image/heic", "heif": "image/heif", "bmp": "image/bmp",
    "mp4": "video/mp4", "mov": "video/quicktime", "avi": "video/x-msvideo", "mkv": "video/x-matroska", "m4v": "video/mp4", "wmv": "video/x-ms-wmv", "mts": "video/mp2t", "mpg": "video/mpeg", "mpeg": "video/mpeg", "webm": "video/webm", "flv": "video/x-flv", "3gp": "video/3gpp",
    "nef": "image/x-nikon-nef", "cr2": "image/x-canon-cr2", "cr3": "image/x-canon-cr3", "arw": "image/x-sony-arw", "orf": "image/x-olympus-orf", "raf": "image/x-fuji-raf", "rw2": "image/x-panasonic-rw2", "dng": "image/x-adobe-dng", "pef": "image/x-pentax-pef", "srw": "image/x-samsung-srw", "x3f": "image/x-sigma-x3f", "3fr": "image/x-hasselblad-3fr",
}
#: Colour labels.
COLORS = {"red": 1, "orange": 2, "yellow": 3, "green": 4, "blue": 5, "magenta": 6, "gray": 7, "grey": 7, "black": 8, "white": 9}
SEPARATORS = (".", "-", "_", " ")
#: Folders whose copies go first, and the folder of the dated archive.
STAGING, ARCHIVE = ("AB_TO_SORT",), "Ordered by Dates"
#: What the fingerprint of a log message leaves out, in this order.
VOLATILE = [(r"\[\s*\w+:\d+@\d+(?:\.\d+)?\]\s*", ""), (r"\b\d+(?:\.\d+)?\b", "N"), (r"\b0x[0-9a-fA-F]+\b", "0xN"), (r"[A-Za-z]:\\[^\s]+", "PATH"), (r"/[^\s]+", "PATH")]


def stem(name: Column) -> Column:
    """Lower case, without the last extension."""
    return F.lower(F.regexp_replace(name, r"\.[^.]*$", ""))


def extension(name: Column) -> Column:
    """Lower case, without the dot; empty where there is none."""
    return F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))


def media_kind(name: Column) -> Column:
    ext = extension(name)
    return F.when(ext.isin(*RAW), "raw").when(ext.isin(*VIDEO), "video").when(ext.isin(*PICTURE), "image")


def is_raw(name: Column) -> Column:
    """X03"""
    return extension(name).isin(*RAW)


def mime(name: Column) -> Column:
    """The media type of a file's name; that of bytes where the extension is not known."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in MIME.items() for x in pair]), extension(name)), F.lit("application/octet-stream"))


def raw_parent(album: Column) -> Column:
    """The album that holds a RAW folder, "/" at the top, null for other albums."""
    path = F.rtrim(album, F.lit("/"))
    return F.when(path.isin("RAW", "/RAW"), "/").when(F.endswith(path, F.lit("/RAW")), F.left(path, F.length(path) - 4))


def sanitized_api(label: Column) -> Column:
    """X06"""
    clean = F.regexp_replace(label, "[^A-Za-z0-9_]", "_")
    return F.when(clean.rlike("^[0-9]"), F.concat(F.lit("_"), clean)).otherwise(clean)


def sanitized_file(label: Column) -> Column:
    """X07"""
    clean = F.regexp_replace(label, "[^A-Za-z0-9]", "_")
    return F.when(clean == "", "_").otherwise(clean)


def sanitized_import(label: Column, fallback: str = "unknown") -> Column:
    """Runs of underscores become one, none at the ends, 63 characters at most."""
    clean = F.left(F.trim(F.regexp_replace(F.regexp_replace(label, "[^A-Za-z0-9]", "_"), "_+", "_"), F.lit("_")), F.lit(63))
    return F.when(clean == "", fallback).otherwise(clean)


def folder_tier(album: Column, staging: tuple[str, ...] = STAGING, archive: str = ARCHIVE) -> Column:
    """0 staging, 1 dated archive, 2 anything arranged by hand; bounded by segments."""
    path = F.ltrim(F.coalesce(album, F.lit("")), F.lit("/"))
    inside = lambda top: (path == top) | F.startswith(path, F.lit(top + "/"))
    early = F.lit(False)
    for top in staging:
        early = early | inside(top)
    return F.when(early, 0).when(inside(archive), 1).otherwise(2)


def normalized_message(message: Column) -> Column:
    """X29"""
    for pattern, by in VOLATILE:
        message = F.regexp_replace(message, pattern, by)
    return F.left(F.trim(message), F.lit(512))


def fingerprint(level: Column, logger: Column, message: Column) -> Column:
    """SHA-1 of level, logger and normalized message."""
    return F.sha1(F.concat_ws("|", level.cast("string"), F.coalesce(logger, F.lit("")), normalized_message(message)))


def inferred_date(filename: Column, album: Column) -> tuple[Column, Column]:
    """The date that a file's name or folders give, and by which rule; both null where none does.

    A full date in the name with separators, then eight digits of a year from 1900 to 2099, then the deepest folder
    that is such a year or a year and month. Only the first match of a pattern counts; if it is no date, the next rule
    is tried.
    """
    name = F.regexp_replace(filename, r"\.[^.]*$", "")

    def dated(pattern: str) -> Column:
        at = [F.regexp_extract(name, pattern, k) for k in (1, 2, 3)]
        return F.when(at[0] != "", F.try_to_date(F.concat_ws("-", *at), "yyyy-MM-dd"))

    # The three patterns, and the names of the rules.
    full = dated(r"(?<!\d)(\d{4})[-_](\d{2})[-_](\d{2})(?!\d)")
    compact = dated(r"(?<!\d)((?:19|20)\d{2})(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])(?!\d)")
    folders = F.filter(F.split(F.replace(album, F.lit("\\"), F.lit("/")), "/"), lambda p: p.rlike(r"^(19|20)\d{2}([/-](0[1-9]|1[0-2]))?$"))
    deepest = F.get(folders, F.size(folders) - 1)
    folder = F.when(F.length(deepest) == 4, F.try_to_date(F.concat(deepest, F.lit("-01-01")), "yyyy-MM-dd")).otherwise(F.try_to_date(F.concat(deepest, F.lit("-01")), "yyyy-MM-dd"))
    date = F.coalesce(full, compact, folder)
    by = F.when(full.isNotNull(), "filename_ymd").when(compact.isNotNull(), "filename_yyyymmdd").when(folder.isNotNull(), F.when(F.length(deepest) == 4, "folder_year").otherwise("folder_year_month"))
    return date, by


def exif_time(*fields: Column) -> Column:
    """The first field whose first 19 characters are a time."""
    return F.coalesce(*[F.try_to_timestamp(F.left(f, F.lit(19)), F.lit("yyyy:MM:dd HH:mm:ss")) for f in fields])


def gps_number(text: Column) -> Column:
    """X19"""
    clean = F.trim(text)
    return F.when(~F.lower(clean).isin("undef", "none", "n/a", ""), clean.try_cast("double"))


def color_number(name: Column) -> Column:
    """X20"""
    return F.element_at(F.create_map(*[F.lit(x) for pair in COLORS.items() for x in pair]), F.lower(name))


def rating(value: Column) -> Column:
    """X21"""
    return F.least(F.greatest(value, F.lit(0)), F.lit(5))


def box_fractions(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> list[Column]:
    """Centre and size as fractions of the picture, six decimals."""
    part = lambda value, whole: F.round(value / whole, 6)
    return [part(x + w / 2, width), part(y + h / 2, height), part(w, width), part(h, height)]


def box_pixels(cx: Column, cy: Column, w: Column, h: Column, width: Column, height: Column) -> list[Column]:
    """Corner and size in pixels, cut to whole ones."""
    return [((cx - w / 2) * width).cast("int"), ((cy - h / 2) * height).cast("int"), (w * width).cast("int"), (h * height).cast("int")]


def rect(text: Column) -> list[Column]:
    """X, y, width, height, with or without decimals, from XML, JSON or the first four words; nulls otherwise."""
    made = rect_struct(text)
    return [made[n] for n in ("x", "y", "width", "height")]


def rect_struct(text: Column) -> Column:
    """X24 as one struct, null otherwise, for large tables: made once a row, it has the text matched, parsed or split once.

    A text is parsed as JSON only where an object can begin, and split only where it is neither XML nor JSON.
    """
    names = ("x", "y", "width", "height")
    pattern = r"<rect\s+" + r"\s+".join(f'{n}="([^"]+)"' for n in names)
    number = lambda a, k: F.nullif(F.get(a, F.lit(k)), F.lit("")).try_cast("double")
    fields = lambda value: F.struct(*[value(k).alias(n) for k, n in enumerate(names)])
    whole = lambda r: F.when(reduce(lambda a, b: a & b, [r[n].isNotNull() for n in names]), r)
    once = lambda value, made: F.get(F.transform(F.array(value), made), F.lit(0))
    xml = F.when(F.contains(text, F.lit("<rect")), once(F.split(F.regexp_extract(text, pattern, 0), '"'), lambda a: whole(fields(lambda k: number(a, 2 * k + 1)))))
    json = F.when(F.startswith(F.ltrim(text, F.lit(" \t\r\n")), F.lit("{")), once(F.try_parse_json(text), lambda v: whole(fields(lambda k: F.try_variant_get(v, f"$.{names[k]}", "double")))))
    words = once(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "), lambda a: whole(fields(lambda k: number(a, k))))
    return F.coalesce(xml, json, words)


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over union of two boxes with keys x, y, w, h."""
    width = F.greatest(F.lit(0), F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]))
    height = F.greatest(F.lit(0), F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]))
    common = width * height
    union = a["w"] * a["h"] + b["w"] * b["h"] - common
    return F.when(union > 0, common / union).otherwise(0.0)


def crop(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, pad: float = 0.2) -> list[Column]:
    """Left, top, right, bottom of the box with padding, inside the picture."""
    px, py = (w * pad).cast("int"), (h * pad).cast("int")
    return [F.greatest(F.lit(0), x - px), F.greatest(F.lit(0), y - py), F.least(width, x + w + px), F.least(height, y + h + py)]


def dot(a: Column, b: Column) -> Column:
    """X30 for unit vectors, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def unit(v: Column) -> Column:
    """X31"""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))


def rounded(x: Column, digits: int) -> Column:
    """The binary number rounded to decimals, exact ties to the even one, as Python's round does.

    x * 10^digits is rounded by its exact value: the product in double precision and, from the halves of x, its error.
    """
    scale = float(10**digits)
    size = F.abs(x.cast("double"))
    upper = size * 134217729.0 - (size * 134217729.0 - size)
    product = size * scale
    error = (upper * scale - product) + (size - upper) * scale
    whole = F.floor(product)
    over = (product - whole - 0.5) + error
    up = (over > 0) | ((over == 0) & (whole % 2 == 1))
    return F.when(product < 2**52, F.signum(x) * (whole + up.cast("int")) / scale).otherwise(x.cast("double"))


def iso_time(text: Column) -> Column:
    """The time of an ISO text, with or without a zone (UTC where there is none); null for other texts."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(text), r"Z$", "+00:00"))


def iso_text(time: Column) -> Column:
    """X15"""
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss")


#: What the legacy importer takes for a video.
IMPORTED_VIDEO = ("mp4", "mov", "avi", "mkv", "wmv", "flv", "m4v", "mts", "m2ts", "webm")


def imported_media(filename: Column) -> Column:
    """X04"""
    return F.when(F.lower(F.regexp_extract(filename, r"[^.]*$", 0)).isin(*IMPORTED_VIDEO), "video").otherwise("image")


def thresholds(sensitivity: float) -> tuple[float, float, float]:
    """Threshold, margin and floor of automatic confirmation."""
    s = min(1.0, max(0.0, sensitivity))
    return round(0.90 - 0.20 * s, 4), round(0.08 - 0.05 * s, 4), round(0.85 - 0.20 * s, 4)


def threshold_columns(sensitivity: Column) -> list[Column]:
    """X32 for a column of sensitivities."""
    s = F.least(F.lit(1.0), F.greatest(F.lit(0.0), sensitivity))
    return [rounded(top - fall * s, 4) for top, fall in ((0.90, 0.20), (0.08, 0.05), (0.85, 0.20))]


def adaptive_threshold(base: float, floor: float, faces: Column, low: int = 20, high: int = 300) -> Column:
    """Falls from base to the floor as a person has more faces."""
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (faces - low) / (high - low)))
    return F.greatest(F.lit(min(base, floor)), F.lit(base) - share * max(0.0, base - floor))


def confidence_band(score: Column) -> Column:
    """X38"""
    return F.when(score >= 0.75, "high").when(score >= 0.5, "medium").otherwise("low")


def human_bytes(n: Column) -> Column:
    """Units of 1024 up to TB, one decimal but for bytes."""
    size = n.cast("double")
    step = F.when(n < 1024, 0).when(n < 1024**2, 1).when(n < 1024**3, 2).when(n < 1024**4, 3).otherwise(4)
    return F.when(n < 1024, F.format_string("%d B", n.cast("long"))).otherwise(F.format_string("%.1f %s", size / F.pow(F.lit(1024.0), step), F.element_at(F.array(*[F.lit(u) for u in ("KB", "MB", "GB", "TB")]), F.greatest(step, F.lit(1)))))


def _short(x: Column) -> Column:
    """A number without decimals where it is whole, else with one."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(F.format_string("%.1f", x))


def human_shutter(seconds: Column) -> Column:
    """Seconds from one on, else 1/n; a dash where there is no positive number."""
    x = seconds.try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (x <= 0), "—").when(x >= 1, F.concat(_short(x), F.lit("s"))).otherwise(F.concat(F.lit("1/"), F.floor(1 / x + 0.5).cast("string")))


def human_aperture(number: Column) -> Column:
    """X37"""
    x = number.try_cast("double")
    return F.when(x.isNull() | F.isnan(x), "—").otherwise(F.concat(F.lit("f/"), _short(x)))


def human_duration(seconds: Column) -> Column:
    """H:mm:ss, or m:ss under an hour."""
    s = seconds.cast("long")
    short = F.format_string("%d:%02d", (s / 60).cast("long"), s % 60)
    return F.when(s < 3600, short).otherwise(F.format_string("%d:%02d:%02d", (s / 3600).cast("long"), ((s % 3600) / 60).cast("long"), s % 60))


def month_range(year: Column, month: Column) -> list[Column]:
    """First and last day."""
    first = F.make_date(year, month, F.lit(1))
    return [first, F.last_day(first)]


def destination(filename: Column, taken: Column, root: str = "") -> Column:
    """YYYY/MM below the root from a name that begins with PXL_ (12 characters at least), else from the time; the root itself without either."""
    under = lambda *parts: F.concat_ws("/", *([F.lit(root)] if root else []), *parts)
    named = F.startswith(filename, F.lit("PXL_")) & (F.char_length(filename) >= 12)
    return F.when(named, under(F.substring(filename, 5, 4), F.substring(filename, 9, 2))).when(taken.isNotNull(), under(F.date_format(taken, "yyyy"), F.date_format(taken, "MM"))).otherwise(root)


def guessed_level(line: Column) -> Column:
    """By the first of these words in a line (FATAL stands for CRITICAL, WARN for WARNING), or INFO."""
    word = F.upper(F.regexp_extract(line, r"(?i)\b(FATAL|ERROR|WARN(?:ING)?|INFO|DEBUG)\b", 1))
    return F.when(word == "", "INFO").when(word == "WARN", "WARNING").when(word == "FATAL", "CRITICAL").otherwise(word)
