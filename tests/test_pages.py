"""Pages cut by composed reports against a plain loop."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fleetlens.functions.pages import Limits, Report, cut_pages
from fleetlens.operators import packages


def plain(sizes, room, rows):
    """Page of each row, cut one after another."""
    pages, page, n, used = [], -1, 0, 0
    for size in sizes:
        if page < 0 or n == rows or used + size > room:
            page, n, used = page + 1, 0, 0
        pages.append(page)
        n, used = n + 1, used + size
    return pages


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=120), st.integers(1, 9), st.integers(1, 90), st.lists(st.integers(1, 119), max_size=12), st.integers(0, 3))
def test_reports_compose(sizes, rows, room, cuts, grouping):
    limits = Limits(rows, room - 1)
    edges = sorted({0, len(sizes), *(c for c in cuts if c < len(sizes))})
    stretches = [np.array(sizes[a:b], np.int64) for a, b in zip(edges, edges[1:])]
    reports = [Report.of(s, 0, limits) for s in stretches]
    want = plain(sizes, room, rows)
    # followed one by one, and composed first to last or in pairs
    at = (0, 0, 0)
    for report, end in zip(reports, edges[1:]):
        if grouping and len(reports) > 1:
            break
        out, used, started = report.leave(at[0], at[1], limits)
        at = out, used, at[2] + started
        assert at[2] == want[end - 1] + 1
    whole = reports
    while len(whole) > 1:
        step = 2 if grouping == 2 else len(whole)
        merged = []
        for k in range(0, len(whole), step):
            one, *rest = whole[k : k + step]
            for other in rest:
                one = one.then(other, limits)
            merged.append(one)
        whole = merged
    out, used, started = whole[0].leave(0, 0, limits)
    last = [s for s, p in zip(sizes, want) if p == want[-1]]
    assert (out, used, started) == (len(last), sum(last), want[-1] + 1)
    for j in range(min(limits.width(0), len(sizes) - 1) + 1):
        tail = plain(sizes[j:], room, rows)
        assert whole[0].exits[j] == tail.count(tail[-1]) and whole[0].pages[j] == tail[-1] + 1


@pytest.fixture
def many_ranges(spark):
    names = {"spark.sql.shuffle.partitions": "37", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def by_capture(rows):
    found = {}
    for r in sorted(rows, key=lambda r: (r.name, r.architecture, r.row_bytes)):
        found.setdefault(r.capture_id, []).append(r)
    return found


def test_a_capture_of_100000_rows(spark, many_ranges):
    rng = random.Random(3)
    rows = [("large", f"p{i:06d}", "amd64", rng.choice([20, 90, 300]), 50) for i in range(100_000)]
    rows += [(None if c == 7 else f"c{c}", f"p{i}", rng.choice(["amd64", "i386"]), rng.randint(0, 700), 50) for c in range(40) for i in range(rng.randint(1, 30))]
    rows += [("repeated", "p", "amd64", 10, 50)] * 900
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "capture_id string, name string, architecture string, row_bytes long, overhead long").repartition(8)
    pages, refused = packages.paginate(df, max_rows=250, max_bytes=2_000, max_pages=40)
    got = by_capture(pages.collect())
    assert sum(map(len, got.values())) == len(rows)
    for capture, own in got.items():
        assert [r.page for r in own] == plain([r.row_bytes + 1 for r in own], 1_951, 250), capture
    assert {tuple(r) for r in refused.collect()} == {("large", "package budget exceeded")}
    assert pages.select("capture_id").where("capture_id = 'large'").count() == 100_000


def test_pages_longer_than_a_range(spark, many_ranges):
    df = spark.range(400).select(F.lit("a").alias("k"), F.format_string("%05d", "id").alias("name"), F.lit(1).cast("long").alias("size"), F.lit(0).cast("long").alias("o"))
    for rows, room in ((1, 10**6), (100, 10**6), (399, 10**6), (400, 10**6), (10**9, 10**6), (10**9, 75)):
        got = [r.page for r in cut_pages(df, "k", ["name"], "size", "o", Limits(rows, room)).orderBy("name").collect()]
        assert got == plain([2] * 400, room + 1, rows)


def test_no_rows(spark):
    df = spark.createDataFrame([], "capture_id string, name string, architecture string, row_bytes long, overhead long")
    pages, refused = packages.paginate(df)
    assert pages.collect() == [] and refused.collect() == [] and pages.columns == [*df.columns, "page"]
