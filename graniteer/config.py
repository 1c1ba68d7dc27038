"""A scan's options: the query of this engine."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import asdict, dataclass, field, fields, replace
from datetime import datetime


def csv_list(text: str) -> list[str]:
    """Split at commas and trim; empty items stay."""
    return [x.strip() for x in text.split(",")] if text else []


def pattern_map(text: str) -> dict[str, str]:
    """A JSON object of name to pattern; anything else gives none."""
    try:
        found = json.loads(text)
    except ValueError:
        return {}
    return {str(k): v for k, v in found.items() if isinstance(v, str)} if isinstance(found, dict) else {}


def parse_time(text: str) -> datetime | None:
    """An RFC 3339 instant, or None."""
    if not re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)", text):
        return None
    try:
        return datetime.fromisoformat(text)
    except ValueError:
        return None


def header_map(text: str) -> dict[str, str]:
    """`k=v` items; those without = or a key are left out."""
    pairs = (x.partition("=") for x in csv_list(text))
    return {k.strip(): v.strip() for k, eq, v in pairs if eq and k.strip()}


#: What options may say.
CHOICES = {
    "output_format": ("json",),
    "sensitive_engine": ("auto", "hybrid", "deterministic"),
    "sensitive_longtail": ("off", "sampled", "full"),
    "sensitive_overlap": ("independent", "exact"),
    "sensitive_match_mode": ("all", "first"),
    "redact_sensitive": ("", "none", "mask", "hash"),
    "delta_cache_mode": ("mtime", "chunk"),
    "profile": ("adaptive", "ultra"),
}
#: Options that must not be negative, and the most that some may be.
NOT_NEGATIVE = ("content_scan_max_bytes", "delta_cache_max_bytes", "fuzzy_min_size", "fuzzy_max_size", "max_io_per_second", "metadata_max_bytes", "otel_timeout", "sensitive_max_matches_per_type", "sensitive_max_total_matches", "xattr_max_value_size")
MOST = {"delta_chunk_bytes": 64 << 20, "sensitive_window_bytes": 16 << 20}
MOST_SCANNED = 256 << 20


@dataclass(frozen=True)
class ScanConfig:
    start_paths: tuple[str, ...] = (".",)
    all_drives: bool = False
    scan_files: bool = True
    scan_sensitive: bool = False
    scan_processes: bool = False
    extended_process_info: bool = False
    collect_system_info: bool = False
    collect_scheduled_tasks: bool = True
    collect_users: bool = True
    collect_groups: bool = True
    collect_admins: bool = True
    output_format: str = "json"
    output_file_name: str = "scan.ndjson"
    hash_algorithms: tuple[str, ...] = ("md5", "sha1", "sha256")
    search_terms: tuple[str, ...] = ()
    include_patterns: tuple[str, ...] = ()
    exclude_patterns: tuple[str, ...] = ()
    max_file_size: int = 10_485_760
    content_scan_max_bytes: int = 10 * 1024 * 1024
    max_output_file_size: int = 104_857_600
    max_io_per_second: int = 1_000
    skip_count: bool = True
    include_sensitive_data_types: tuple[str, ...] = ()
    exclude_sensitive_data_types: tuple[str, ...] = ()
    custom_patterns: dict[str, str] = field(default_factory=dict)
    sensitive_engine: str = "auto"
    sensitive_longtail: str = "sampled"
    sensitive_window_bytes: int = 4_096
    sensitive_overlap: str = "independent"
    sensitive_match_mode: str = "all"
    sensitive_max_matches_per_type: int = 100
    sensitive_max_total_matches: int = 1_000
    redact_sensitive: str = "mask"
    fuzzy_hash: bool = False
    fuzzy_algorithms: tuple[str, ...] = ("tlsh",)
    fuzzy_table: tuple[int, ...] = ()
    fuzzy_min_size: int = 256
    fuzzy_max_size: int = 20 * 1024 * 1024
    delta_scan: bool = False
    delta_cache_mode: str = "chunk"
    delta_cache_dir: str = ""
    delta_cache_max_bytes: int = 1 << 30
    delta_chunk_bytes: int = 262_144
    last_scan_file: str = ".graniteer_last_scan"
    last_scan_time: str = ""
    metadata_max_bytes: int = 1 << 20
    collect_xattrs: bool = True
    xattr_max_value_size: int = 1_024
    collect_acl: bool = True
    scan_ads: bool = False
    collect_metadata: bool = True
    export_paths: bool = False
    export_sensitive: bool = False
    export_cmdline: bool = False
    otel_endpoint: str = ""
    otel_headers: dict[str, str] = field(default_factory=dict)
    otel_service_name: str = "graniteer"
    otel_timeout: float = 5.0
    profile: str = "adaptive"

    def __post_init__(self) -> None:
        errors = [f"{k} must be one of {', '.join(map(repr, v))}" for k, v in CHOICES.items() if getattr(self, k) not in v]
        errors += [f"{k} must not be negative" for k in NOT_NEGATIVE if getattr(self, k) < 0]
        errors += [f"{k} must be from 1 to {v}" for k, v in MOST.items() if not 0 < getattr(self, k) <= v]
        for bad, why in (
            (not (self.scan_files or self.scan_processes or self.scan_sensitive or self.collect_system_info), "nothing to collect: enable files, sensitive data, processes or system information"),
            (not self.start_paths and not self.all_drives and (self.scan_files or self.scan_sensitive), "a scan of files needs a start path"),
            (self.all_drives, "all_drives exists on Windows only"),
            (self.max_output_file_size <= 0, "max_output_file_size must be positive"),
            (self.scan_sensitive and self.content_scan_max_bytes == 0, "sensitive scans need a bound on content_scan_max_bytes"),
            (self.scan_sensitive and self.content_scan_max_bytes > MOST_SCANNED, f"sensitive scans read {MOST_SCANNED} bytes of a file at most"),
            (bool(self.otel_endpoint) and not self.otel_endpoint.startswith(("http://", "https://")), "otel_endpoint needs http:// or https://"),
            (self.delta_scan and not self.last_scan_file and not self.last_scan_time, "a delta scan needs the last scan's time, or the file that holds it"),
            (bool(self.last_scan_time) and parse_time(self.last_scan_time) is None, "last_scan_time must be a date and time with an offset"),
        ):
            if bad:
                errors.append(why)
        if errors:
            raise ValueError("; ".join(errors))

    @staticmethod
    def load(path: str | None = None, **given) -> ScanConfig:
        """Defaults, then a JSON file (unknown keys are ignored), then what is given."""
        known = {f.name: f for f in fields(ScanConfig)}
        values = {}
        if path:
            with open(path, encoding="utf-8") as f:
                values = {k: v for k, v in json.load(f).items() if k in known}
        values |= given
        values = {k: tuple(v) if isinstance(v, list) else v for k, v in values.items()}
        return ScanConfig(**values).normalised()

    def normalised(self) -> ScanConfig:
        """sha256 is always computed; none means no redaction; a fuzzy window is not empty; ultra turns regexes off."""
        algorithms = tuple(dict.fromkeys((*self.hash_algorithms, "sha256")))
        out = replace(
            self,
            hash_algorithms=algorithms,
            redact_sensitive="" if self.redact_sensitive == "none" else self.redact_sensitive,
            fuzzy_max_size=max(self.fuzzy_max_size, self.fuzzy_min_size) if self.fuzzy_max_size > 0 else self.fuzzy_max_size,
            search_terms=tuple(dict.fromkeys(t for t in (x.strip() for x in self.search_terms) if t)),
        )
        return replace(out, sensitive_engine="deterministic", sensitive_longtail="off") if out.profile == "ultra" else out

    @property
    def longtail(self) -> str:
        """Regexes run unless the engine is deterministic."""
        return "off" if self.sensitive_engine == "deterministic" else self.sensitive_longtail

    @property
    def per_type_limit(self) -> int:
        return 1 if self.sensitive_match_mode == "first" else self.sensitive_max_matches_per_type

    def fingerprint(self) -> str:
        """Of the options that decide a file's results; results are reused only under the same one."""
        names = ("search_terms", "scan_sensitive", "include_sensitive_data_types", "exclude_sensitive_data_types", "custom_patterns", "sensitive_engine", "sensitive_longtail", "sensitive_window_bytes", "sensitive_overlap", "sensitive_match_mode", "sensitive_max_matches_per_type", "sensitive_max_total_matches", "hash_algorithms", "fuzzy_hash", "fuzzy_algorithms", "fuzzy_table")
        held = asdict(self)
        return hashlib.sha256(json.dumps({k: held[k] for k in names}, sort_keys=True).encode()).hexdigest()


def newer_release(current: str, latest: str) -> bool:
    """Dated tags (2024-01-31...) compare as text, x.y.z by number; dev and anything else is never older."""
    dated = re.compile(r"v?(\d{4}[.-]\d{2}[.-]\d{2}.*)$")
    a, b = dated.match(current), dated.match(latest)
    if a and b:
        return b[1] > a[1]
    strict = re.compile(r"v?(\d+)\.(\d+)\.(\d+)$")
    a, b = strict.match(current), strict.match(latest)
    return bool(a and b) and tuple(map(int, b.groups())) > tuple(map(int, a.groups()))
