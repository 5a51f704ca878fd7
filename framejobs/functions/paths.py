"""Column expressions over file names, paths and slugs."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, functions as F

from framejobs import vocab

# White space as the data producers define it: ASCII white space plus the Unicode spaces.
SPACE = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_SYSTEM_SEGMENT = (
    r"(?:^|/)(?:\.|~\$|(?:"
    + "|".join(name.replace(".", r"\.") for name in vocab.SYSTEM_NAMES)
    + r")(?:/|\z))"
)


def normalize_path(path: Column) -> Column:
    """Forward slashes, none leading or trailing."""
    return F.btrim(F.translate(path, "\\", "/"), F.lit("/"))


def segments(path: Column) -> Column:
    """Non-empty path segments."""
    return F.filter(F.split(path, "/"), lambda part: part != "")


def file_extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./\\]+)\z", 1))


def base_name(path: Column) -> Column:
    last = F.regexp_extract(path, r"([^/\\]*)\z", 1)
    return F.when(last == "", path).otherwise(last)


def strip_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^./\\]+\z", "")


def with_extension(name: Column, extension: Column) -> Column:
    """Swap the extension, keeping everything before the last dot."""
    base = F.regexp_replace(name, r"\.[^./]+\z", "")
    return F.concat(F.when(base == "", F.lit("untitled")).otherwise(base), F.lit("."), extension)


def is_system_path(path: Column) -> Column:
    """True when any segment is a dotfile, a lock file or operating-system bookkeeping."""
    return F.lower(normalize_path(path)).rlike(_SYSTEM_SEGMENT)


def is_supported_image(name: Column, mime: Column) -> Column:
    """The extension decides; a MIME type that is present and not an image vetoes."""
    by_name = file_extension(name).isin(*vocab.SUPPORTED_EXTENSIONS)
    kind = F.lower(mime)
    return (
        F.when(mime.isNull() | (mime == ""), by_name)
        .when(~kind.startswith("image/"), F.lit(False))
        .when(kind.isin(*vocab.SUPPORTED_MIME_TYPES), F.lit(True))
        .otherwise(by_name)
    )


def skip_reason(path: Column, name: Column, mime: Column, size: Column) -> Column:
    """First reason to skip a file, or null when it is accepted."""
    return (
        F.when(is_system_path(path), "system_file")
        .when(size <= 0, "empty")
        .when(size > vocab.MAX_FILE_BYTES, "too_large")
        .when(~is_supported_image(name, mime), "unsupported_type")
    )


def classify_file(path: Column, name: Column, mime: Column, size: Column) -> Column:
    reason = skip_reason(path, name, mime, size)
    return F.struct(reason.isNull().alias("accepted"), reason.alias("reason"))


def display_name(name: Column) -> Column:
    """'RED-DRESS_front__01.jpg' -> 'RED-DRESS front 01'."""
    text = strip_extension(base_name(name))
    text = F.regexp_replace(text, r"_+|-{2,}", " ")
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


@lru_cache(maxsize=1)
def _decomposition_tables() -> tuple[str, str, dict[str, str]]:
    """Compatibility decompositions that leave ASCII letters or digits, built from the Unicode rule.

    One-to-one entries go through ``translate``; combining marks sit past the end of the target so
    that ``translate`` deletes them; one-to-many entries are looked up separately.
    """
    marks = "".join(chr(c) for c in range(0x300, 0x370))
    source, target, wide = [], [], {}
    for code in range(0x80, sys.maxunicode + 1):
        if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xDFFF or 0x300 <= code < 0x370:
            continue
        char = chr(code)
        if not unicodedata.decomposition(char):
            continue
        flat = "".join(c for c in unicodedata.normalize("NFKD", char) if not 0x300 <= ord(c) < 0x370)
        if not any(c in "abcdefghijklmnopqrstuvwxyz0123456789" for c in flat):
            continue
        if len(flat) == 1:
            source.append(char)
            target.append(flat)
        else:
            wide[char] = "".join(c if c.isascii() else "-" for c in flat)
    return "".join(source) + marks, "".join(target), wide


def slugify(value: Column, longest: int = 80) -> Column:
    """Lower-case ASCII slug for display, never a key: at most ``longest`` characters; 'item' when nothing is left.

    ASCII text never reaches the decomposition branch, and no branch leaves the JVM.
    """
    source, target, wide = _decomposition_tables()
    lowered = F.lower(value)
    single = F.translate(lowered, source, target)
    wide_map = F.str_to_map(F.lit("\t".join(f"{k}\n{v}" for k, v in wide.items())), F.lit("\t"), F.lit("\n"))
    full = F.array_join(
        F.transform(F.split(single, ""), lambda c: F.coalesce(F.element_at(wide_map, c), c)), ""
    )
    wide_class = "[" + "".join(f"\\x{{{ord(c):X}}}" for c in wide) + "]"
    plain = (
        F.when(~lowered.rlike(r"[^\x00-\x7F]"), lowered)
        .when(single.rlike(wide_class), full)
        .otherwise(single)
    )
    slug = F.substring(F.btrim(F.regexp_replace(plain, "[^a-z0-9]+", "-"), F.lit("-")), 1, longest)
    return F.when(slug == "", "item").otherwise(slug)


def natural_key(name: Column) -> Column:
    """Sortable key under which embedded numbers compare as numbers.

    A digit run becomes '0' + its length + its digits without leading zeros, so longer numbers sort
    after shorter ones and a digit run keeps its place among text chunks.
    """
    chunks = F.regexp_extract_all(F.lower(name), F.lit(r"([0-9]+|[^0-9]+)"), F.lit(0))

    def encode(chunk: Column) -> Column:
        digits = F.ltrim(chunk, F.lit("0"))
        return F.when(
            chunk.rlike(r"\A[0-9]"),
            F.concat(F.lit("0"), F.lpad(F.length(digits).cast("string"), 4, "0"), digits),
        ).otherwise(chunk)

    return F.transform(chunks, encode)


def folder_of(path: Column) -> Column:
    """Folder part of a normalised path, '' at the root."""
    collapsed = F.regexp_replace(path, "/{2,}", "/")
    return F.regexp_extract(collapsed, r"(?s)\A(.*)/[^/]*\z", 1)


def exif_timestamp(value: Column) -> Column:
    """'YYYY:MM:DD HH:MM:SS' (or with a T) as a timestamp, null when malformed."""
    text = F.trim(value)
    shape = r"\A\d{4}:\d{2}:\d{2}[ T]\d{2}:\d{2}:\d{2}\z"
    return F.when(
        text.rlike(shape),
        F.try_to_timestamp(F.regexp_replace(text, "T", " "), F.lit("yyyy:MM:dd HH:mm:ss")),
    )


def display_size(width: Column, height: Column, orientation: Column) -> Column:
    """Width and height after the camera rotation is applied."""
    turned = F.coalesce(orientation.between(5, 8), F.lit(False))
    return F.struct(
        F.when(turned, height).otherwise(width).alias("width"),
        F.when(turned, width).otherwise(height).alias("height"),
    )


def mime_of_format(fmt: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in vocab.MIME_BY_FORMAT.items() for x in pair])
    return F.coalesce(F.element_at(table, fmt), F.lit("application/octet-stream"))


def extension_of_mime(mime: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in vocab.EXTENSION_BY_MIME.items() for x in pair])
    return F.coalesce(F.element_at(table, F.lower(mime)), F.lit("bin"))


def stored_mime(name: Column, mime: Column) -> Column:
    """Type under which an accepted image is stored: the declared one if supported, else that of the extension."""
    declared = F.lower(mime)
    return F.when(declared.isin(*vocab.SUPPORTED_MIME_TYPES), declared).otherwise(
        mime_of_format(F.regexp_replace(file_extension(name), r"\Atif\z", "tiff")))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def original_key(source_hash: Column, mime: Column) -> Column:
    return F.concat(
        F.substring(source_hash, 1, 2), F.lit("/"), F.substring(source_hash, 3, 2), F.lit("/"),
        source_hash, F.lit("."), extension_of_mime(mime),
    )


def derived_key(source_hash: Column, kind: Column, extension: Column) -> Column:
    return F.concat_ws(
        "/", F.substring(source_hash, 1, 2), F.substring(source_hash, 3, 2), source_hash,
        F.concat(kind, F.lit("."), extension),
    )


def creative_key(batch_id: Column, creative_id: Column, extension: Column) -> Column:
    return F.concat(batch_id, F.lit("/"), creative_id, F.lit("."), extension)


def safe_name(value: Column) -> Column:
    """A label as a file name valid on every desktop system."""
    text = F.translate(value, '<>:"/\\|?* ', "-" * 10)
    text = F.regexp_replace(text, SPACE + "+", " ")
    edge = r"[." + SPACE[1:-1] + "]+"
    text = F.regexp_replace(text, rf"\A{edge}|{edge}\z", "")
    text = F.substring(text, 1, 80)
    return F.when(text == "", "untitled").otherwise(text)


def safe_segment(value: Column) -> Column:
    """One path segment with only the illegal characters replaced."""
    edge = r"[." + SPACE[1:-1] + "]+"
    text = F.regexp_replace(F.translate(value, '<>:"/\\|?*', "_________"), rf"\A{edge}|{edge}\z", "")
    return F.when(text == "", "untitled").otherwise(text)


def catalog_path(relative_path: Column, extension: Column, import_name: Column) -> Column:
    """Archive path that mirrors the import, without the import's own root folder."""
    parts = segments(relative_path)
    rooted = F.coalesce(F.get(parts, F.lit(0)) == import_name, F.lit(False)) & (import_name != "")
    parts = F.when(rooted, F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    count = F.size(parts)
    base = F.regexp_replace(F.get(parts, count - 1), r"\.[^./]+\z", "")
    base = F.when(base == "", "untitled").otherwise(base)
    folders = F.transform(F.slice(parts, F.lit(1), F.greatest(count - 1, F.lit(0))), safe_segment)
    leaf = F.concat(safe_segment(base), F.lit("."), extension)
    return F.when(count == 0, F.concat(F.lit("untitled."), extension)).otherwise(
        F.array_join(F.concat(folders, F.array(leaf)), "/")
    )
