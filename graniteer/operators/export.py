"""Records as log entries for collectors: attributes, OTLP bodies, and a sink that posts them.

An attribute value is the OTLP union as a struct with one member set, so that to_json gives the wire form.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .records import SYSTEM_LISTS, for_export, sorted_map, without_empties

VALUE = "struct<stringValue:string,intValue:string,doubleValue:double,arrayValue:struct<values:array<struct<stringValue:string>>>,kvlistValue:struct<values:array<struct<key:string,value:struct<stringValue:string>>>>>"
ATTRIBUTES = f"array<struct<key:string,value:{VALUE}>>"
#: Public semantic-convention names (fixed values): column to key.
PROCESS_KEYS = {"pid": "process.pid", "ppid": "process.parent_pid", "name": "process.executable.name", "exe": "process.executable.path", "cmdline": "process.command_line", "username": "process.owner", "start_time": "process.creation.time"}
FILE_TEXTS = ("mime_type", "mod_time", "creation_time", "access_time", "change_time", "permissions", "owner")
METRIC_FIELDS = ("start_time", "end_time", "total_files", "files_scanned", "files_processed", "total_processes")


def _value(**member: Column) -> Column:
    kinds = {"stringValue": "string", "intValue": "string", "doubleValue": "double", "arrayValue": "struct<values:array<struct<stringValue:string>>>", "kvlistValue": "struct<values:array<struct<key:string,value:struct<stringValue:string>>>>"}
    return F.struct(*[member.get(k, F.lit(None)).cast(t).alias(k) for k, t in kinds.items()])


def _text(c: Column) -> Column:
    return F.when(c != "", _value(stringValue=c))


def _entry(key: str | Column, value: Column) -> Column:
    """Null, and so left out, without a value."""
    return F.when(value.isNotNull(), F.struct((F.lit(key) if isinstance(key, str) else key).alias("key"), value.alias("value")))


def _of(df: DataFrame, name: str, as_text: bool = False) -> Column:
    """A column's value by its type; empty ones are null. Nested types become JSON text."""
    kind, c = dict(df.dtypes)[name], F.col(f"`{name}`")
    if kind in ("int", "bigint", "smallint", "tinyint"):
        return F.when(c.isNotNull(), _value(intValue=c.cast("string")))
    if kind in ("float", "double"):
        return F.when(c.isNotNull(), _value(doubleValue=c))
    if kind == "array<string>" and not as_text:
        return F.when(F.size(c) > 0, _value(arrayValue=F.struct(F.transform(c, lambda x: F.struct(x.alias("stringValue"))).alias("values"))))
    if kind == "map<string,string>" and not as_text:
        pairs = F.transform(F.map_entries(sorted_map(c)), lambda e: F.struct(e["key"].alias("key"), F.struct(e["value"].alias("stringValue")).alias("value")))
        return F.when(F.size(c) > 0, _value(kvlistValue=F.struct(pairs.alias("values"))))
    if kind.startswith(("array<", "map<")):
        return F.when(F.size(c) > 0, _value(stringValue=F.to_json(sorted_map(c) if kind.startswith("map<") else c)))
    return _text(c.cast("string"))


def _spread(m: Column, prefix: str) -> Column:
    """One entry for each pair of a map whose value is not empty."""
    pairs = F.filter(F.map_entries(sorted_map(m)), lambda e: e["value"] != "")
    return F.coalesce(F.transform(pairs, lambda e: F.struct(F.concat(F.lit(prefix), e["key"]).alias("key"), _value(stringValue=e["value"]).alias("value"))), F.array().cast(ATTRIBUTES))


def attributes(df: DataFrame, record_type: str, paths: bool = False, sensitive: bool = False, cmdline: bool = False, prefix: str = "graniteer") -> Column:
    """The attributes of each record, in a fixed order, without empty ones; the three policies admit paths, matches and command lines."""
    have, parts, spread = set(df.columns), [], []

    def add(key: str, name: str) -> None:
        if name in have:
            parts.append(_entry(key, _of(df, name)))

    if record_type == "file":
        base = F.regexp_extract("path", r"([^/]*)$", 1) if "path" in have else F.lit(None).cast("string")
        if paths and "path" in have:
            add("file.path", "path")
            above = F.regexp_replace("path", "/+[^/]*$", "")
            parts.append(_entry("file.directory", F.when(F.col("path") != "", _value(stringValue=F.when(F.col("path").contains("/"), F.when(above == "", "/").otherwise(above)).otherwise(".")))))
            parts.append(_entry("file.extension", _text(F.regexp_extract(base, r"\.([^.]*)$", 1))))
        name = F.coalesce(F.when(F.col("name") != "", F.col("name")), base) if "name" in have else base
        parts.append(_entry("file.name", _text(name)))
        add("file.size", "size")
        for c in FILE_TEXTS:
            add(f"{prefix}.file.{c}", c)
        add(f"{prefix}.file.id", "file_id")
        add(f"{prefix}.file.attributes", "attributes")
        for c, one in (("hashes", "hash"), ("fuzzy_hashes", "fuzzy_hash")):
            if c in have:
                add(f"{prefix}.file.{c}", c)
                spread.append((len(parts), _spread(F.col(c), f"{prefix}.file.{one}.")))
        if sensitive:
            for c in ("metadata", "xattrs", "acl", "alternate_data_streams", "sensitive_data", "search_hits"):
                add(f"{prefix}.file.{c}", c)
    elif record_type == "process":
        left_out = {"exe": paths, "cmdline": cmdline}
        for c, key in PROCESS_KEYS.items():
            if left_out.get(c, True):
                add(key, c)
        add(f"{prefix}.process.cpu_percent", "cpu_percent")
        add(f"{prefix}.process.memory_percent", "memory_percent")
    elif record_type == "system_info":
        add("os.description", "os_version")
        add("os.version", "os_version")
        for c in SYSTEM_LISTS if sensitive else ():
            add(f"{prefix}.system.{c}", c)
        for c in SYSTEM_LISTS:
            if f"{c}_count" in have:
                add(f"{prefix}.system.{c}_count", f"{c}_count")
            elif c in have:
                parts.append(_entry(f"{prefix}.system.{c}_count", F.when(F.col(c).isNotNull(), _value(intValue=F.size(c).cast("string")))))
    elif record_type == "metrics":
        for c in METRIC_FIELDS:
            add(f"{prefix}.metrics.{c}", c)
    if not parts:
        return F.array().cast(ATTRIBUTES)
    runs, at = [], 0
    for place, each in [*spread, (len(parts), None)]:
        if parts[at:place]:
            runs.append(F.array_compact(F.array(*parts[at:place])).cast(ATTRIBUTES))
        runs += [each.cast(ATTRIBUTES)] if each is not None else []
        at = place
    return F.concat(*runs)


def log_records(df: DataFrame, record_type: str, paths: bool = False, sensitive: bool = False, cmdline: bool = False) -> DataFrame:
    """(record_type, json): one OTLP log record a row; its body is the record as the policies leave it."""
    counts = {f"{c}_count": F.size(c) for c in SYSTEM_LISTS if c in df.columns and f"{c}_count" not in df.columns}
    wide = df.withColumns(counts) if record_type == "system_info" and counts else df
    kept = for_export(df, record_type, paths, sensitive, cmdline).columns
    payload = F.to_json(F.struct(*without_empties(wide.select(*kept))))
    head = F.array(F.struct(F.lit("record_type").alias("key"), _value(stringValue=F.lit(record_type)).alias("value"))).cast(ATTRIBUTES)
    line = F.struct(F.struct(payload.alias("stringValue")).alias("body"), F.concat(head, attributes(wide, record_type, paths, sensitive, cmdline)).alias("attributes"))
    return wide.select(F.lit(record_type).alias("record_type"), F.to_json(line).alias("json"))


def endpoint_of(url: str) -> str:
    """An address without a path gets the standard one for logs."""
    scheme, sep, rest = url.partition("://")
    if not sep or scheme not in ("http", "https") or not rest.strip("/"):
        raise ValueError("the endpoint must be an http or https address")
    return url if "/" in rest.rstrip("/") else f"{scheme}://{rest.rstrip('/')}/v1/logs"


def post_logs(logs: DataFrame, url: str, service: str = "graniteer", headers: dict[str, str] | None = None, batch: int = 512, tries: int = 3, timeout: float = 10.0) -> None:
    """Each task posts its own rows in batches. A batch is tried again on failure, so a collector may see it twice."""
    target = endpoint_of(url)
    start = json.dumps({"attributes": [{"key": "service.name", "value": {"stringValue": service}}]})

    def send(lines: list[str]) -> None:
        data = ('{"resourceLogs":[{"resource":' + start + ',"scopeLogs":[{"logRecords":[' + ",".join(lines) + "]}]}]}").encode()
        for k in range(tries):
            try:
                urllib.request.urlopen(urllib.request.Request(target, data, {"Content-Type": "application/json", **(headers or {})}), timeout=timeout).close()
                return
            except (urllib.error.URLError, TimeoutError):
                if k + 1 == tries:
                    raise
                time.sleep(0.2 * 2**k)

    def post(rows) -> None:
        held: list[str] = []
        for r in rows:
            held.append(r["json"])
            if len(held) >= batch:
                send(held)
                held = []
        if held:
            send(held)

    logs.select("json").foreachPartition(post)
