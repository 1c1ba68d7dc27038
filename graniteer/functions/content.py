"""Columns derived from content: hashes, kind of content, search counts, limits and warnings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .blake3 import blake3

# Names and signatures that decide results.
TEXT_EXTENSIONS = ("txt", "log", "json", "xml", "yaml", "yml", "csv", "md", "rst", "ini", "cfg", "conf", "toml", "env", "html", "htm", "css", "js", "mjs", "cjs", "ts", "tsx", "jsx", "go", "py", "rb", "php", "java", "kt", "swift", "sh", "bash", "zsh", "ps1")
SIGNATURES = (("89504E470D0A1A0A", "image/png"), ("FFD8FF", "image/jpeg"), ("474946383761", "image/gif"), ("474946383961", "image/gif"), ("255044462D", "application/pdf"), ("504B0304", "application/zip"), ("1F8B08", "application/gzip"), ("7F454C46", "application/x-executable"), ("425A68", "application/x-bzip2"), ("377ABCAF271C", "application/x-7z-compressed"), ("FD377A585A00", "application/x-xz"), ("494433", "audio/mpeg"), ("4F676753", "audio/ogg"), ("424D", "image/bmp"), ("49492A00", "image/tiff"), ("4D4D002A", "image/tiff"), ("00000100", "image/vnd.microsoft.icon"), ("664C6143", "audio/x-flac"), ("1A45DFA3", "video/x-matroska"), ("D0CF11E0A1B11AE1", "application/msword"), ("7B5C727466", "application/rtf"), ("28B52FFD", "application/zstd"), ("526172211A07", "application/vnd.rar"), ("53514C69746520666F726D6174203300", "application/vnd.sqlite3"), ("0061736D", "application/wasm"), ("774F4646", "application/font-woff"), ("774F4632", "application/font-woff"))
#: Containers by what they say after four or eight bytes, and packed documents by a folder's name in the header.
RIFF = {"57415645": "audio/x-wav", "41564920": "video/x-msvideo", "57454250": "image/webp"}
BRANDS = {"4D344120": "audio/mp4", "71742020": "video/quicktime", "68656963": "image/heif", "61766966": "image/avif"}
PACKED = {"word/": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "xl/": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "ppt/": "application/vnd.openxmlformats-officedocument.presentationml.presentation"}
HEADER = 4_096


def hashes(content: Column, algorithms: tuple[str, ...]) -> Column:
    """map of algorithm to hex; names that are not known are left out."""
    known = {"md5": lambda: F.md5(content), "sha1": lambda: F.sha1(content), "sha256": lambda: F.sha2(content, 256), "blake3": lambda: blake3(content)}
    pairs = [x for a in dict.fromkeys(algorithms) if a in known for x in (F.lit(a), known[a]())]
    return F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,string>")


def let(value: Column, body) -> Column:
    """body(value), where value is worked out once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def mime(content: Column) -> Column:
    """Kind by signature; `unknown` without one."""
    return let(F.hex(F.substring(content, 1, 16)), lambda head: _kind(head, content))


def _kind(head: Column, content: Column) -> Column:
    cases = [(F.substring(head, 9, 8) == "66747970", let(F.substring(head, 17, 8), lambda x: _one_of(x, BRANDS, "video/mp4")))]
    cases += [(head.startswith("52494646"), let(F.substring(head, 17, 8), lambda x: _one_of(x, RIFF, "unknown")))]
    # A local header's name field (30 bytes in) or a later one's.
    cases += [(head.startswith("504B0304"), let(F.hex(F.substring(content, 1, HEADER)), _packed))]
    cases += [(head.startswith(sign), F.lit(kind)) for sign, kind in SIGNATURES]
    out = F.when(*cases[0])
    for case, kind in cases[1:]:
        out = out.when(case, kind)
    return out.otherwise("unknown")


def _one_of(x: Column, kinds: dict[str, str], other: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for p in kinds.items() for v in p]), x), F.lit(other))


def _packed(sample: Column) -> Column:
    out = F
    for folder, kind in PACKED.items():
        out = out.when(sample.contains(folder.encode().hex().upper()), F.lit(kind))
    return out.otherwise("application/zip")


def looks_like_text(content: Column) -> Column:
    """First 4,096 bytes: some, valid UTF-8, no NUL, control bytes at most a tenth."""

    def judge(text: Column) -> Column:
        controls = F.length(text) - F.length(F.regexp_replace(text, "[\\x00-\\x08\\x0E-\\x1F]", ""))
        return (text != "") & ~text.contains("\x00") & (controls <= F.floor(F.octet_length(text) / 10))

    return let(F.coalesce(F.try_validate_utf8(F.substring(content, 1, HEADER).cast("string")), F.lit("")), judge)


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./]*)$", 1))


def eligible(name: Column, kind: Column, content: Column) -> Column:
    texty = kind.startswith("text/") | kind.contains("json") | kind.contains("xml") | kind.contains("html") | kind.contains("javascript")
    return extension(name).isin(*TEXT_EXTENSIONS) | texty | (kind.isin("unknown", "application/octet-stream") & looks_like_text(content))


def search_count(text: Column, term: str) -> Column:
    """Occurrences that do not overlap, case and all."""
    t = F.coalesce(text, F.lit(""))
    return F.floor((F.octet_length(t) - F.octet_length(F.replace(t, F.lit(term), F.lit("")))) / len(term.encode())).cast("int")


def search_hits(text: Column, terms: tuple[str, ...]) -> Column:
    terms = tuple(dict.fromkeys(t for t in (x.strip() for x in terms) if t))
    if not terms:
        return F.lit(None).cast("map<string,int>")
    each = F.array(*[F.struct(F.lit(t).alias("k"), search_count(text, t).alias("v")) for t in terms])
    return F.map_from_entries(F.filter(each, lambda x: x["v"] > 0))


def size_warning(size: Column, most: int) -> Column:
    """Set where full-file work is skipped."""
    return F.when((F.lit(most) > 0) & (size > most), F.lit(f"full-file operations skipped for files larger than {most} bytes"))


def content_limit(most: int) -> int | None:
    """0: none; negative: the default of 10 MiB."""
    return None if most == 0 else most if most > 0 else 10 * 1024 * 1024


def lane(size: Column, name: Column, fuzzy: bool = False, fuzzy_min: int = 256, fuzzy_max: int = 20 << 20, scan_files: bool = True) -> Column:
    """How costly a file's work is."""
    heavy = (size >= fuzzy_min) & (size <= fuzzy_max if fuzzy_max > 0 else F.lit(True)) if fuzzy else F.lit(False)
    if scan_files:
        heavy = heavy | extension(name).isin("jpg", "jpeg", "png", "pdf", "docx")
    return F.when(heavy, "expensive").when(size <= 64 << 10, "small").when(size <= 4 << 20, "medium").otherwise("large")
