import dataclasses
import hashlib
import json
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from graniteer.config import ScanConfig, csv_list, header_map, newer_release, parse_time, pattern_map
from graniteer.functions import fuzzy
from graniteer.operators import records, sysinfo
from graniteer.plans import run
from graniteer.plans.scan import scan
from graniteer.sources.files import base_columns, private_file, tree
from graniteer.streaming import delta, rescan


def rows(spark, *items):
    return spark.createDataFrame([(n, n, len(b), b, None) for n, b in items], "path string, name string, size long, content binary, mtime timestamp")


def test_tree_keeps_hidden_and_skips_links(spark, tmp_path):
    (tmp_path / "a/.b").mkdir(parents=True)
    (tmp_path / "top.txt").write_text("x")
    (tmp_path / "a/.hidden").write_text("y")
    (tmp_path / "a/.b/deep.txt").write_text("zz")
    os.symlink(tmp_path / "top.txt", tmp_path / "a/link")
    got = base_columns(tree(spark, (str(tmp_path),), content=True)).collect()
    assert sorted(r["name"] for r in got) == [".hidden", "deep.txt", "top.txt"]
    assert {r["name"]: bytes(r["content"]) for r in got}["deep.txt"] == b"zz"
    assert [r["attributes"] for r in got if r["name"] == ".hidden"] == [["hidden"]] and got[0]["permissions"].startswith("-rw")


def test_scan_record(spark):
    cfg = ScanConfig.load(scan_sensitive=True, search_terms=["alpha", ""], max_file_size=100)
    big = b"alpha " * 50
    got = {r["path"]: r for r in scan(rows(spark, ("a.txt", b"alpha z@mail.example.org"), ("b.txt", big), ("c.bin", b"\x00\x01"), ("d.txt", b"\xff alpha \xc3")), cfg).collect()}
    assert got["a.txt"]["search_hits"] == {"alpha": 1} and got["a.txt"]["sensitive_data"] == {"email": ["**************.org"]}
    assert got["d.txt"]["search_hits"] == {"alpha": 1}  # bytes that are no text do not end the scan
    assert got["b.txt"]["hashes"] is None and "full-file" in got["b.txt"]["collection_warnings"][0] and got["b.txt"]["search_hits"] == {"alpha": 50}
    assert not any(c.startswith("__") for c in got["c.bin"].asDict()) and got["c.bin"]["content_scan_bytes"] is None and set(got["c.bin"]["hashes"]) == {"md5", "sha1", "sha256"}
    only = scan(rows(spark, ("a.txt", b"test@example.com"), ("n.txt", b"nothing")), ScanConfig.load(scan_files=False, scan_sensitive=True))
    assert [r["path"] for r in only.collect()] == ["a.txt"]
    cut = scan(rows(spark, ("a.txt", b"alpha beta alpha gamma")), ScanConfig.load(search_terms=["alpha"], content_scan_max_bytes=5)).first()
    assert cut["content_scan_truncated"] and cut["content_scan_bytes"] == 5 and cut["search_hits"] == {"alpha": 1}


def test_config():
    cfg = ScanConfig.load(hash_algorithms=["md5"], redact_sensitive="none", profile="ultra", sensitive_longtail="sampled")
    assert cfg.hash_algorithms == ("md5", "sha256") and cfg.redact_sensitive == "" and cfg.sensitive_longtail == "off"
    with pytest.raises(ValueError):
        ScanConfig(sensitive_longtail="some")
    assert cfg.fingerprint() != ScanConfig.load().fingerprint() and ScanConfig(sensitive_engine="deterministic").longtail == "off"
    for bad in (
        {"scan_files": False}, {"start_paths": ()}, {"all_drives": True}, {"output_format": "xml"}, {"fuzzy_min_size": -1}, {"profile": "fast"}, {"sensitive_engine": "none"}, {"sensitive_match_mode": "last"},
        {"delta_cache_mode": "none"}, {"delta_cache_max_bytes": -1}, {"delta_chunk_bytes": 0}, {"delta_chunk_bytes": 1 << 40}, {"sensitive_window_bytes": 0}, {"sensitive_window_bytes": 1 << 40},
        {"xattr_max_value_size": -1}, {"otel_timeout": -1}, {"otel_endpoint": "collector:4318"}, {"max_io_per_second": -1}, {"sensitive_max_matches_per_type": -1}, {"sensitive_max_total_matches": -1},
        {"metadata_max_bytes": -1}, {"content_scan_max_bytes": -1}, {"scan_sensitive": True, "content_scan_max_bytes": 0}, {"scan_sensitive": True, "content_scan_max_bytes": 1 << 40},
        {"delta_scan": True, "last_scan_file": ""}, {"last_scan_time": "yesterday"}, {"last_scan_time": "2024-13-01T00:00:00Z"}, {"max_output_file_size": 0}, {"redact_sensitive": "blur"},
    ):
        with pytest.raises(ValueError):
            ScanConfig(**bad)


def test_option_texts():
    assert csv_list("a, b,,c ") == ["a", "b", "", "c"] and csv_list("") == []
    assert pattern_map('{"a": "x", "b": 1}') == {"a": "x"} and pattern_map("[1]") == pattern_map("{") == {}
    assert header_map("k=v, x = y=z, bad, =w") == {"k": "v", "x": "y=z"}
    assert parse_time("2024-01-31T10:00:00+02:00") and parse_time("2024-01-31T10:00:00.5Z") and not parse_time("2024-01-31")
    assert newer_release("1.2.3", "1.10.0") and not newer_release("dev", "1.0.0") and newer_release("2024-01-02", "2024-02-01")


def test_export_rotates_and_ends_with_metrics(spark, tmp_path):
    files = spark.createDataFrame([("p" * 150,)] * 4, "path string")
    lines = records.union_records(records.envelopes(records.metrics(files, F.lit(True)), "metrics"), records.envelopes(files, "file"))
    done = records.export_ndjson(lines, str(tmp_path / "out.ndjson"), 200)
    assert len(done) > 1 and done[1].endswith("out.1.ndjson") and oct(os.stat(done[0]).st_mode)[-3:] == "600"
    last = json.loads(open(done[-1]).read().splitlines()[-1])
    assert last["record_type"] == "metrics" and last["schema_version"] == "2"


def test_export_policy(spark):
    df = spark.createDataFrame([("p", "c", "e")], "path string, cmdline string, exe string")
    assert records.for_export(df, "process").columns == ["path"]
    assert "path" not in records.for_export(df, "file").columns


def test_chunks_are_reused_with_their_neighbours(spark):
    was = spark.createDataFrame([(1, b"aaaabbbbccccdddd")], "k long, c binary")
    now = spark.createDataFrame([(1, b"aaaaXbbbccccdddd")], "k long, c binary")
    got = delta.reusable(delta.chunks(now, "k", "c", 4), delta.chunks(was, "k", "c", 4), "k").orderBy("idx").collect()
    assert [r["same"] for r in got] == [True, False, True, True] and [r["reuse"] for r in got] == [False, False, False, True]
    held = spark.createDataFrame([("a", 1, 60), ("b", 2, 30), ("c", 3, 20)], "path_key string, mtime long, size long")
    assert {r["path_key"] for r in delta.kept_by_cache(held, 60).where("kept").collect()} == {"b", "c"}


def test_cache_keeps_the_newest_over_many_cells(spark, monkeypatch):
    monkeypatch.setattr(delta, "TIME_RANGES", 7)
    rng = random.Random(3)
    rows_ = [(hashlib.sha256(str(i).encode()).hexdigest(), rng.choice([None, 5, 5, 5, rng.randrange(100)]), rng.randrange(1, 50)) for i in range(300)]
    got = {r["path_key"] for r in delta.kept_by_cache(spark.createDataFrame(rows_, "path_key string, mtime long, size long"), 3000).where("kept").collect()}
    total, want = 0, set()
    for k, _, n in sorted(rows_, key=lambda r: (r[1] is not None, r[1] or 0, r[0]), reverse=True):
        total += n
        if total <= 3000:
            want.add(k)
    assert got == want
    none = spark.createDataFrame([], "path_key string, mtime long, size long")
    assert delta.kept_by_cache(none, 10).count() == 0


def test_rescan_reuses_what_has_not_changed(spark):
    cfg = ScanConfig(scan_sensitive=True, search_terms=("tin",), include_sensitive_data_types=("email", "api_key"), redact_sensitive="", delta_chunk_bytes=64, sensitive_max_matches_per_type=4)
    line = b"tin k@l.net api_key=q1 tin "
    old = [("a", line * 20), ("b", line * 9), ("c", b"tin" * 50)]
    now = [("a", line * 20 + b" z@z.org api_key=q2 t"), ("b", b"tin " + line * 9), ("c", b"tin" * 50), ("d", line)]
    frame = lambda x: spark.createDataFrame([(p, bytearray(c), None) for p, c in x], "path string, content binary, mtime timestamp")
    first = rescan.rescan(frame(old), spark.createDataFrame([], rescan.STATE), cfg)
    assert first.where("reused").count() == 0
    again = rescan.rescan(frame(now), first.drop("reused"), cfg).cache()
    key = {hashlib.sha256(p.encode()).hexdigest(): p for p, _ in now}
    reused = Counter(key[r["path_key"]] for r in again.where("reused").collect())
    assert reused == {"a": 8 - 0, "c": 3} or reused == {"a": 7, "c": 3}
    assert {key[r["path_key"]]: r["hits"] for r in rescan.file_hits(again).collect()} == {p: c.count(b"tin") for p, c in now}
    got = {key[r["path_key"]]: r["sensitive"] for r in rescan.file_sensitive(again, cfg).collect()}
    assert got["a"]["data"] == {"email": ["k@l.net"] * 4, "api_key": ["api_key=q1", "api_key=q2"]} and got["a"]["truncated"]
    assert got["b"]["counts"] == {"email": 4, "api_key": 1} and got["c"] is None and got["d"]["counts"] == {"email": 1, "api_key": 1}
    other = dataclasses.replace(cfg, search_terms=("pan",))
    assert rescan.rescan(frame(now), first.drop("reused"), other).where("reused").count() == 0
    state = rescan.next_state(first.drop("reused"), again, 1 << 20)
    assert state.count() == again.count() and rescan.next_state(first.drop("reused"), again, 0).count() == 0



def test_rescan_of_a_file_cut_at_a_chunk_and_of_terms_that_overlap(spark):
    cfg = ScanConfig(scan_sensitive=True, search_terms=("aba", "tin"), include_sensitive_data_types=("credit_card",), redact_sensitive="", delta_chunk_bytes=64)
    frame = lambda x: spark.createDataFrame([("a", bytearray(x), None), ("b", bytearray(b"ab" * 200 + b"a"), None)], "path string, content binary, mtime timestamp")
    old = b"." * 120 + b"4111111111111111 tin"
    first = rescan.rescan(frame(old), spark.createDataFrame([], rescan.STATE), cfg).drop("reused")
    again = rescan.rescan(frame(old[:128]), first, cfg).cache()
    key = hashlib.sha256(b"a").hexdigest()
    assert {(r["path_key"] == key, r["term"]): r["hits"] for r in rescan.file_hits(again).collect()} == {(False, "aba"): 100}
    assert all(r["sensitive"] is None for r in rescan.file_sensitive(again, cfg).collect())
    assert {r["path_key"] == key: r["sensitive"] for r in rescan.file_sensitive(first, cfg).collect()}[True]["counts"] == {"credit_card": 1}


def test_snapshots_of_the_state(spark, tmp_path):
    cfg = ScanConfig(search_terms=("tin",), delta_chunk_bytes=8)
    files = spark.createDataFrame([("a", bytearray(b"tin " * 9), None)], "path string, content binary, mtime timestamp")
    assert rescan.load(spark, str(tmp_path / "none")).count() == 0
    first = rescan.rescan(files, rescan.load(spark, str(tmp_path)), cfg).drop("reused")
    rescan.save(first, str(tmp_path))
    os.makedirs(tmp_path / "99991231T000000000000")  # not whole
    assert rescan.rescan(files, rescan.load(spark, str(tmp_path)), cfg).where("not reused").count() == 0


def test_stream_takes_each_file_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    seen = []
    for k in range(2):
        (tmp_path / f"in/{k}.txt").write_text("x" * (k + 1))
        (tmp_path / f"in/{k}.bin").write_text("x")
        delta.stream_new_files(spark, str(tmp_path / "in"), "*.txt", lambda b, n: seen.extend(r["length"] for r in b.collect()), str(tmp_path / "at"), 1).awaitTermination()
    assert sorted(seen) == [1, 2]


def test_own_columns_must_be_new(spark):
    class Size:
        name = "size"
        enabled = staticmethod(lambda cfg: True)
        columns = staticmethod(lambda df, cfg: {"size": F.lit(1)})

    with pytest.raises(ValueError):
        scan(rows(spark, ("a.txt", b"x")), ScanConfig(), (Size(),))


def test_own_digest(spark):
    fuzzy.register("Length", lambda value, table: str(len(value)))
    try:
        df = spark.createDataFrame([(bytearray(b"x" * 300),)], "c binary")
        assert df.select(fuzzy.fuzzy_hashes(F.col("c"), F.octet_length("c"), names=("LENGTH", "none"))).first()[0] == {"length": "300"}
    finally:
        del fuzzy.HASHERS["length"]


def test_when_a_rescan_goes_by_chunks(spark):
    applies = lambda cfg, n, whole: spark.range(1).select(rescan.applies(cfg, F.lit(n), whole)).first()[0]
    search = ScanConfig(search_terms=("x",), delta_chunk_bytes=100)
    assert applies(search, 1, False) and not applies(search, 500, True) and applies(search, 501, True)
    assert not applies(ScanConfig(), 10**6, False) and not applies(dataclasses.replace(search, delta_cache_mode="mtime"), 10**6, False)
    assert not applies(dataclasses.replace(search, scan_sensitive=True), 10**6, False) and applies(dataclasses.replace(search, scan_sensitive=True, redact_sensitive=""), 10**6, False)
    assert rescan.sensitive_by_chunk(ScanConfig(scan_sensitive=True, include_sensitive_data_types=("ssn",)))
    assert not rescan.sensitive_by_chunk(ScanConfig(scan_sensitive=True)) and not rescan.sensitive_by_chunk(ScanConfig(scan_sensitive=True, include_sensitive_data_types=("ssn",), sensitive_match_mode="first"))


def test_private_files_refuse_links(tmp_path):
    with private_file(str(tmp_path / "a")) as f:
        f.write(b"1")
    assert oct(os.stat(tmp_path / "a").st_mode)[-3:] == "600"
    (tmp_path / "d").mkdir()
    os.symlink(tmp_path / "a", tmp_path / "link")
    os.symlink(tmp_path / "d", tmp_path / "way")
    os.mkfifo(tmp_path / "pipe")
    for name in ("link", "way/b", "pipe", "d"):
        with pytest.raises(OSError):
            private_file(str(tmp_path / name))


def test_a_run_leaves_its_own_files_out(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("one.txt", "out.ndjson", "out.7.ndjson", "out.x.ndjson", "mark"):
        (tmp_path / "in" / name).write_text("tin")
    cfg = ScanConfig(start_paths=(str(tmp_path / "in"),), output_file_name=str(tmp_path / "in/out.ndjson"), last_scan_file=str(tmp_path / "in/mark"), search_terms=("tin",), skip_count=False)
    done = run.run(spark, cfg)
    held = [json.loads(x) for p in done for x in open(p)]
    assert sorted(r["payload"]["name"] for r in held if r["record_type"] == "file") == ["one.txt", "out.x.ndjson"]
    assert held[-1]["record_type"] == "metrics" and held[-1]["payload"]["files_processed"] == 2 and parse_time((tmp_path / "in/mark").read_text())
    later = dataclasses.replace(cfg, delta_scan=True, output_file_name=str(tmp_path / "later.ndjson"))
    os.utime(tmp_path / "in/one.txt", (0, 1_600_000_000))
    os.utime(tmp_path / "in/out.x.ndjson", (0, 4_000_000_000))
    assert [r["name"] for r in run.file_records(spark, later, run.last_scan(later)).orderBy("name").collect()] == ["out.ndjson", "out.x.ndjson"]
    assert run.run(spark, later, str(tmp_path / "folder")) == [str(tmp_path / "folder")] and spark.read.text(str(tmp_path / "folder")).count() == 3


def test_system_inventory(spark):
    assert sysinfo.socket_address("0100007F:0050") == "127.0.0.1:80" and sysinfo.socket_address("00000000000000000000000001000000:1F90") == "::1:8080"
    table = "head\n 0: 0100007F:0050 00000000:0000 0A 0:0 0:0 0 0 0 991 1\n"
    assert sysinfo.socket_rows(table, {"991": 7}, True) == [("127.0.0.1:80", "0.0.0.0:0", "LISTEN", 7)]
    assert sysinfo.interface_addresses("1: lo    inet 127.0.0.1/8 scope host\n2: e0@x    inet6 fe80::1/64 scope link\n") == {"lo": ["127.0.0.1/8"], "e0": ["fe80::1/64"]}
    assert sysinfo.colon_names(":x\na:b") == ["a"]
    me = {r["pid"]: r for r in sysinfo.processes(spark, True).collect()}[os.getpid()]
    assert me["cpu_percent"] >= 0 and me["memory_percent"] > 0 and me["exe"] and me["username"] and me["start_time"]
    off = sysinfo.system_info(spark, False, False, False, False).first()
    assert off["users"] is off["groups"] is off["admins"] is off["scheduled_tasks"] is None
    assert sysinfo.colon_names("root:x:0\n# c\n\nuser1:x\n") == ["root", "user1"]
    assert sysinfo.service_rows("a.service loaded active running A\nshort line\n") == [("a.service", "active")]
    row = sysinfo.system_info(spark).first()
    assert isinstance(row["collection_warnings"], dict)
    assert sysinfo.processes(spark, True).where("pid = 1").count() <= 1
