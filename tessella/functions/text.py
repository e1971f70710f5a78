"""Strings, paths, urls and tags as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the library scan takes for audio, and how the parts of a source are told apart.
EXTENSIONS = (".aac", ".aif", ".aiff", ".flac", ".m4a", ".mp3", ".ogg", ".opus", ".wav", ".wma")
SAMPLE_BYTES, ID_LETTERS = 163_840, 24
TRACK_URL = r"^https?://open\.spotify\.com/track/([A-Za-z0-9]+)"
# Media types by extension.
MIME = {".mp3": "audio/mpeg", ".flac": "audio/flac", ".wav": "audio/wav", ".ogg": "audio/ogg", ".m4a": "audio/mp4", ".aac": "audio/aac", ".opus": "audio/opus"}


def first_element(values: Column) -> Column:
    """The first of a list of tag values; null of none."""
    return F.get(values, F.lit(0))


def content_id(content: Column) -> Column:
    """Of binary content: the first letters of the sha-256 of its first bytes."""
    return F.left(F.sha2(F.substring(content, 1, SAMPLE_BYTES), 256), F.lit(ID_LETTERS))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-cased, with its dot; '' for names that only begin with dots."""
    return F.lower(F.regexp_extract(file_name(path), r"^\.*[^.].*?(\.[^.]*)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"^(\.*[^.].*?)\.[^.]*$", "$1")


def is_audio(path: Column, extensions: tuple[str, ...] = EXTENSIONS, depth: int | None = None) -> Column:
    """Whether a file is one a scan takes: by its extension, and at most `depth` folders down."""
    known = extension(path).isin(*extensions)
    return known if depth is None else known & (F.size(F.split(path, "/")) <= depth)


def mime(path: Column) -> Column:
    out = F.lit("audio/mpeg")
    for ext, kind in MIME.items():
        out = F.when(extension(path) == ext, kind).otherwise(out)
    return out


def present(x: Column) -> Column:
    """Null for an empty string."""
    return F.nullif(x, F.lit(""))


def first_present(*xs: Column) -> Column:
    return F.coalesce(*[present(x) for x in xs])


def source_kind(source: Column, exists: Column) -> Column:
    return F.when(F.instr(source, "://") > 0, "url").when(exists, "local").otherwise("text")


def resolver(source: Column) -> Column:
    """The first resolver that takes the source; null if none does."""
    web = source.rlike("^https?://")
    return F.when(source.startswith("file://") | ~source.contains("://"), "local").when(source.rlike(TRACK_URL), "spotify").when(web, "ytdlp")


def track_id(url: Column) -> Column:
    return present(F.regexp_extract(url, TRACK_URL, 1))


def file_url_path(url: Column) -> Column:
    """Path of a file:// url, percent-decoded; a plus sign stays one."""
    return F.try_url_decode(F.replace(F.regexp_extract(url, r"^file://[^/]*(/.*)$", 1), F.lit("+"), F.lit("%2B")))


def numeric_id(x: Column) -> Column:
    return F.coalesce(present(F.regexp_replace(F.replace(x, F.lit("track_"), F.lit("")), "^0+", "")), F.lit("0"))


def tag_names(tags: Column) -> Column:
    """Sorted set of lower-cased tags, each what follows its last `---`."""
    each = F.filter(F.split(F.coalesce(tags, F.lit("")), r"\s+"), lambda t: t != "")
    return F.array_sort(F.array_distinct(F.transform(each, lambda t: F.lower(F.element_at(F.split(t, "---"), -1)))))


def tags_wanted(tags: Column, wanted: list[str]) -> Column:
    return F.lit(True) if not wanted else F.arrays_overlap(tag_names(tags), F.array(*map(F.lit, wanted)))


def unsafe_path(path: Column) -> Column:
    return path.startswith("/") | F.array_contains(F.split(path, "/"), "..")


def html_escape(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def megabytes(size: Column) -> Column:
    return size / 1_048_576


def posix(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def seconds(milliseconds: Column) -> Column:
    """Seconds of whole milliseconds given as text; null where it is no number."""
    return milliseconds.try_cast("int") / 1000.0


def track_url(key: Column) -> Column:
    return F.concat(F.lit("https://open.spotify.com/track/"), key)


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)
