"""Readers, the writer and the file manifest on small files."""

import hashlib
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import intake, packages
from fleetlens.sources import readers
from fleetlens.sources.file_tree import file_tree


@pytest.fixture(scope="module")
def folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def write_lines(folder, name, *records):
    path = os.path.join(folder, name)
    with open(path, "w") as f:
        f.writelines((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in records)
    return path


def test_read_heartbeats_keeps_unknown_keys(spark, folder):
    beat = {
        "server_id": "s1", "timestamp": "2026-05-06T12:00:00Z", "cpu_percent": None, "brand_new": {"a": [1]},
        "disks": [{"device": "/dev/sda1", "mountpoint": "/", "total_bytes": 2**64 - 1, "used_bytes": 1, "used_percent": 0.5}],
        "disk_latency": None, "detected_capabilities": {"docker": True, "ansible": False},
    }
    df = readers.read_heartbeats(spark, write_lines(folder, "hb.json", beat, "{broken"))
    good, bad = intake.quarantine(df, {**intake.missing("server_id"), "not JSON": F.col("raw").isNull()})
    row = good.select("disks", F.try_variant_get("raw", "$.brand_new.a[0]", "int").alias("n"), "cpu_percent", "detected_capabilities").first()
    assert int(row.disks[0].total_bytes) == 2**64 - 1 and row.n == 1 and row.cpu_percent is None
    assert row.detected_capabilities == {"docker": True, "ansible": False}
    assert [r.reasons for r in bad.select("reasons").collect()] == [["missing server_id", "not JSON"]]
    assert intake.explode_children(good, "disk_latency").count() == 0
    with pytest.raises(ValueError):
        intake.explode_children(good, "nothing")


def test_other_posted_records(spark, folder):
    at = "2026-05-06T12:00:00.5Z"
    batch = {"server_id": "s", "results": [{"monitor_id": "m", "checked_at": at, "status": "ok", "latency_ms": 3, "details": {"port": {"open": True}}}]}
    checks = readers.read_check_results(spark, write_lines(folder, "c.json", batch))
    assert checks.select(F.try_variant_get("details", "$.port.open", "boolean")).first()[0] is True
    found = readers.read_discovery(spark, write_lines(folder, "d.json", {"server_id": "s", "discovered_at": at, "services": [{"name": "nginx", "type": "systemd", "ports": [80]}]}))
    assert found.select(F.inline("services")).first().ports == [80]
    run = {"server_id": "s", "monitor_id": "m", "playbook_id": "p", "trigger": "auto", "success": True, "steps": [{"order": 1, "exit_code": 0}], "started_at": at, "finished_at": at}
    log = readers.read_remediation_log(spark, write_lines(folder, "r.json", run, {"server_id": "s"}))
    good, bad = intake.quarantine(log, intake.endpoint_rules("remediation-log"))
    assert (good.count(), bad.count()) == (1, 1) and "missing steps" in bad.first().reasons
    ops = readers.read_ops_result(spark, write_lines(folder, "o.json", {"run_id": "r", "status": "partial", "step_results": [{"step_id": "1", "changed": True}]}))
    assert ops.first().step_results[0].changed is True
    audit = readers.read_audit_result(spark, write_lines(folder, "a.json", {"run_id": "r", "results": [{"check_key": "k", "confidence": 0.5, "normalized": {"summary": "x"}, "errors": ["e"]}]}))
    assert audit.select(F.inline("results")).select("confidence", "errors").first() == (0.5, ["e"])
    command = readers.read_command_result(spark, write_lines(folder, "x.json", {"command_id": "c", "exit_code": 2, "duration_ms": 9}))
    assert command.select("exit_code", "duration_ms").first() == (2, 9)


def test_write_table_and_file_manifest(spark, folder):
    df = spark.range(100).selectExpr("id", "id % 3 AS day")
    readers.write_table(df, f"{folder}/t", ["day"])
    readers.write_table(df, f"{folder}/t", ["day"])
    assert spark.read.parquet(f"{folder}/t").groupBy("day").count().count() == 3
    assert spark.read.parquet(f"{folder}/t").count() == 200

    os.makedirs(f"{folder}/tree/sub")
    for name, data in (("a.txt", b"alpha"), ("sub/b.bin", b"\x00\xff")):
        with open(f"{folder}/tree/{name}", "wb") as f:
            f.write(data)
    rows = {r.path: r for r in readers.file_manifest(spark, f"{folder}/tree").collect()}
    assert set(rows) == {"a.txt", "sub/b.bin"}
    assert rows["a.txt"].digest == "sha256:" + hashlib.sha256(b"alpha").hexdigest() and rows["sub/b.bin"].size == 2


def test_read_stanzas(spark, folder):
    text = (
        "Package: nginx\nVersion: 1.24.0-2\nArchitecture: amd64\nSize: 10\nSHA256: " + "a" * 64
        + "\n\nPackage: vim\nVersion: 9\nArchitecture: amd64\n\nPackage: apache2-bin\nVersion: 2.4\nArchitecture: amd64\n"
        "Source: apache2 (2.4-1)\nDescription: x\n more: text\nSize: 5\nSHA256: " + "b" * 64 + "\n"
    )
    path = os.path.join(folder, "Packages")
    with open(path, "w") as f:
        f.write(text)
    rows = {r.name: r for r in packages.parse_stanzas(readers.read_stanzas(spark, path)).collect()}
    assert set(rows) == {"nginx", "apache2-bin"}
    assert (rows["apache2-bin"].source_name, rows["apache2-bin"].source_version) == ("apache2", "2.4-1")
    assert rows["nginx"].size == 10 and rows["nginx"].error is None


def test_stanzas_are_numbered_alike_however_a_file_is_split(spark, folder):
    path = os.path.join(folder, "Numbered")
    blocks = [f"Package: p{i}\nText: {'x' * (i * 37 % 400)}" for i in range(300)]
    with open(path, "w") as f:
        f.write("\n\n".join(blocks[:150]) + "\n\n\n\n" + "\n\n".join(blocks[150:]) + "\n\n")
    conf = {"spark.sql.files.maxPartitionBytes": ("128m", "4k"), "spark.sql.files.openCostInBytes": ("4m", "0")}
    seen = []
    for k in range(2):
        for name, values in conf.items():
            spark.conf.set(name, values[k])
        df = readers.read_stanzas(spark, path)
        seen.append(({(r.stanza_no, r.stanza.split("\n")[0]) for r in df.collect()}, spark.read.text(path).rdd.getNumPartitions()))
    for name in conf:
        spark.conf.unset(name)
    assert seen[0][0] == seen[1][0] == {(i + 1, f"Package: p{i}") for i in range(300)}
    assert seen[0][1] == 1 and seen[1][1] >= 10


def test_file_tree(spark, folder):
    root = os.path.join(folder, "walked")
    os.makedirs(os.path.join(root, "a", "b", "empty"))
    blocks = os.urandom(1 << 20) * 9 + b"tail"  # more than two blocks
    for name, data in (("x", b""), ("a/ü y", b"text"), ("a/b/large", blocks)):
        with open(os.path.join(root, name), "wb") as f:
            f.write(data)
    os.chmod(os.path.join(root, "x"), 0o640)
    os.symlink("x", os.path.join(root, "a", "link"))
    os.symlink("a", os.path.join(root, "folder-link"))
    os.utime(os.path.join(root, "x"), ns=(0, 1_700_000_000_999_999_999))
    got = {r.path: r for r in file_tree(spark, root).collect()}
    assert {p: r.type for p, r in got.items()} == {
        "x": "file", "a": "directory", "a/ü y": "file", "a/b": "directory", "a/b/large": "file", "a/b/empty": "directory", "a/link": "link", "folder-link": "link"}
    assert got["a/b/large"].digest == "sha256:" + hashlib.sha256(blocks).hexdigest() and got["a/b/large"].size == len(blocks)
    assert got["x"].mode == 0o640 and got["x"].mtime == 1_700_000_000 and got["x"].digest == "sha256:" + hashlib.sha256(b"").hexdigest()
    assert got["a/link"].digest == "" and got["a"].size == 0
    assert file_tree(spark, os.path.join(root, "a", "b", "empty")).collect() == []
    for bad in (os.path.join(root, "x"), os.path.join(root, "folder-link"), "s3a://bucket/x"):
        with pytest.raises(ValueError):
            file_tree(spark, bad)


def test_files_are_hashed_block_by_block(folder, monkeypatch):
    from fleetlens.sources import file_tree as module

    path = os.path.join(folder, "blocks")
    data = os.urandom(1000)
    with open(path, "wb") as f:
        f.write(data)
    monkeypatch.setattr(module, "BLOCK", 7)
    assert module.digest_of(path) == "sha256:" + hashlib.sha256(data).hexdigest()
