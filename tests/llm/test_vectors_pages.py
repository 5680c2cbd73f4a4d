"""Vectors and web archives on small awkward tables, and the pipeline."""

from __future__ import annotations

import gzip
import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from compare import connect, difference
from conftest import SF
from hard import prose, table

from creditloom.llm import forest, warc
from creditloom.llm.queries import ORACLES, QUERIES
from creditloom.session import fresh_path


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    assert difference(QUERIES[name](spark, SF), connect(SF), ORACLES[name]) is None


def test_there_is_one_query_for_each_operator():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))


# operator 6


def plain_links(rows):
    n = len(rows)
    unit = [None if v is None or lab is None or any(x is None or not np.isfinite(x) for x in v) or not np.any(v) else np.array(v, dtype=float) / np.linalg.norm(np.array(v, dtype=float)) for _, v, lab in rows]
    links, parent = [0] * n, list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(n):
        for b in range(a):
            if unit[a] is not None and unit[b] is not None and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.93:
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    low = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            low[root(k)] = min(i, low.get(root(k), i))
    return Counter((i, links[k], low.get(root(k)), i is not None and low.get(root(k)) == i) for k, (i, _, _) in enumerate(rows))


def vectors(n=900, dim=12):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(n // 6, dim))
    rows = []
    for i in range(n):
        v = centres[rng.integers(len(centres))] + rng.normal(size=dim) * rng.choice([0.02, 0.1, 1.0])
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(2))))
    rows += [(2000 + i, rows[5][1], rows[5][2]) for i in range(30)] + [rows[7], (None, rows[5][1], rows[5][2])]
    rows += [(3000, None, 1), (3001, [0.0] * dim, 1), (3002, [None] * dim, 1), (3003, [float("nan")] * dim, 1), (3004, rows[0][1], None), (3005, [], 1), (3006, rows[0][1][:5], rows[0][2]), (3007, rows[0][1][:5], rows[0][2])]
    return rows


@pytest.mark.parametrize("leaf", [5000, 60])
def test_links_equal_brute_force(spark, leaf):
    rows = vectors()
    held = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, cid string").repartition(4)
    got = Counter(map(tuple, forest.linked_vectors(held, leaf=leaf).collect()))
    expected = plain_links(rows)
    if leaf > len(rows):
        assert got == expected
    else:
        found, there = (sum(k[1] * n for k, n in c.items()) for c in (got, expected))
        assert 0.99 * there <= found <= there


def test_links_within_a_dense_group(spark):
    rng = np.random.default_rng(8)
    n, dim = 3000, 64
    unit = rng.normal(size=(n, dim))
    unit[: n // 3] = rng.normal(size=dim) + rng.normal(size=(n // 3, dim)) * 0.22
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    there = (unit @ unit.T >= 0.93).sum(axis=1) - 1
    assert there[: n // 3].mean() > 0.9 * (n // 3)
    held = spark.createDataFrame([(i, v, 1) for i, v in enumerate(unit.tolist())], "vec_id long, embedding array<double>, label int").repartition(4)
    got = {r.vec_id: r.n_links for r in forest.linked_vectors(held, leaf=47).collect()}
    assert all(got[i] <= there[i] for i in range(n))
    assert sum(got.values()) >= 0.98 * there.sum()


def test_no_vectors(spark):
    assert forest.linked_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0


# operator 9


def archive(records, packed):
    made = [warc.record(i, f"http://a/{i}", p, hashlib.sha256(p).hexdigest(), None, "1970-01-01T00:00:00Z") for i, p in records]
    return [warc.members(x) for x in made] if packed else made


@pytest.mark.parametrize("packed", [True, False])
@pytest.mark.parametrize("damage", ["none", "flip", "cut", "junk", "head"])
def test_reader_recovers_what_lies_behind_damage(packed, damage):
    rng = random.Random(1)
    payloads = [(i, (prose(rng, 50) + "\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n").encode()) for i in range(5)]
    parts = archive(payloads, packed)
    whole = b"".join(parts)
    at = sum(map(len, parts[:2]))
    lost, gap = set(), None
    data = bytearray(whole)
    if damage == "flip":
        data[at + len(parts[2]) // 2] ^= 0xFF
        lost, gap = {2}, (at, at + len(parts[2]))
    elif damage == "cut":
        data = data[: len(whole) - 10]
        lost, gap = {4}, (len(whole) - len(parts[4]), len(whole) - 10)
    elif damage == "junk":
        data[at:at] = b"garbage \x1f\x8b\x08 WARC/1. "
        gap = (at, at + len(b"garbage \x1f\x8b\x08 WARC/1. "))
    elif damage == "head":
        data[:3] = b"\0\0\0"
        lost, gap = {0}, (0, len(parts[0]))
    found = list(warc.salvage(bytes(data)))
    kept = [x for x in found if not x.reason]
    assert [x.head["warc-record-id"] for x in kept] == [f"<urn:page:{i}>" for i in range(5) if i not in lost]
    assert all(x.block == warc.HTTP + payloads[int(x.head["warc-record-id"][10:-1])][1] for x in kept)
    gaps = [(x.start, x.end) for x in found if x.reason]
    assert gaps == ([gap] if gap else [])
    spans = sorted((x.start, x.end) for x in found)
    assert spans[0][0] == 0 and spans[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))


@pytest.mark.parametrize("level", [0, 6])
def test_one_member_of_many_records_loses_the_damaged_one_only(level):
    rng = random.Random(2)
    payloads = [(i, (prose(rng, 400) + "\r\nWARC/1.1\r\n").encode()) for i in range(5)]
    parts = archive(payloads, False)
    data = bytearray(gzip.compress(b"".join(parts), level))
    at = len(data) // 2
    data[at] ^= 0x10
    found = list(warc.salvage(bytes(data) + warc.members(parts[0])))
    kept = [int(x.head["warc-record-id"][10:-1]) for x in found if not x.reason]
    assert all(x.block == warc.HTTP + payloads[i][1] for i, x in zip(kept, (x for x in found if not x.reason), strict=True))
    assert any(x.reason for x in found) and kept[-1] == 0
    # stored bytes lose the record that was hit; compressed ones can't be unpacked behind the damage
    assert kept[:-1] == [0, 1, 3, 4] if level == 0 else kept[:2] == [0, 1]


def test_heads_of_any_length(spark):
    url = "http://a/" + "u" * (2 << 20)
    pages = spark.createDataFrame([(1, url, "x" * 200), (2, "http://b", "x" * 200), (3, url + "?", None)], "page_id long, url string, html string")
    rows = {r.page_id: r for r in warc.page_rows(warc.archive_and_read(pages)).collect()}
    assert rows[2].record_type == "revisit" and rows[2].refers_to == 1 and rows[3].payload_bytes == 0
    data = warc.record(7, url, b"p", hashlib.sha256(b"p").hexdigest(), None, "1970-01-01T00:00:00Z")
    assert [(x.reason, x.head["warc-target-uri"]) for x in warc.salvage(data)] == [(None, url)]


def test_tiny_and_huge_vectors_link_like_others(spark):
    rows = [(1, [1e-200, 1e-200], 1), (2, [3e-200, 3e-200], 1), (3, [1.0, 1.0], 1), (4, [1e200, 1e200], 1), (5, [1e200, -1e200], 1), (6, [5e-324, 5e-324], 1)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in forest.linked_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (4, 1), 2: (4, 1), 3: (4, 1), 4: (4, 1), 5: (0, 5), 6: (4, 1)}


def test_members_are_plain_gzip_and_long_records_span_several():
    data = warc.record(1, None, b"x" * (35 << 20), hashlib.sha256(b"x" * (35 << 20)).hexdigest(), None, "1970-01-01T00:00:00Z")
    packed = warc.members(data)
    assert packed[-1:] == b"\0" and gzip.decompress(packed) == data
    found = list(warc.salvage(packed + warc.members(warc.record(2, None, b"", hashlib.sha256(b"").hexdigest(), None, "1970-01-01T00:00:00Z"))))
    assert [x.reason for x in found] == [None, None] and found[0].end == len(packed)


def test_pages_come_back(spark):
    long = "<p>" + "é" * 200
    rows = [(1, "http://a", long), (2, "http://b\n", long), (2, "http://b\n", long), (3, None, None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (None, "u", long), (7, "u", "y" * 300_000), (0, "u", long)]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, payload string, digest string").repartition(3)
    got = Counter(map(tuple, warc.page_rows(warc.archive_and_read(pages)).collect()))
    raw = [(i, (h or "").encode()) for i, _, h in rows]
    expected = Counter()
    for i, p in raw:
        ids = [j for j, q in raw if q == p and j is not None]
        low = min(ids) if ids and len(p) >= 100 and i is not None else i
        expected[(i, len(p), hashlib.sha256(p).hexdigest(), "response" if low == i else "revisit", None if low == i else low)] += 1
    assert got == expected
    assert warc.page_rows(warc.archive_and_read(pages.where("false"))).count() == 0


def test_archives_are_files_that_other_readers_take(spark):
    path = fresh_path(spark, "archives")
    warc.write_archives(spark.createDataFrame([(i, "http://a", "page %d " % i * 50) for i in range(20)], "page_id long, url string, html string").coalesce(1), path)
    content = b"".join(gzip.decompress(r.content) for r in spark.read.format("binaryFile").load(path).collect() if r.length)
    assert content.count(b"WARC/1.1\r\n") == 20 and content.endswith(b"\r\n\r\n")


# pipeline


def test_pipeline_stages_keep_columns_and_take_effect(spark):
    import corpus_pipeline

    rng = random.Random(9)
    good = [(i, prose(rng, 150)) for i in range(60)]
    copies = [(100 + i, good[i][1] + " more") for i in range(5)]
    junk = [(200 + i, " ".join(w + "###" for w in prose(rng, 90).split(" "))) for i in range(10)] + [(300, None), (301, ""), (302, "few words")]
    docs, seen = table(spark, good + copies + junk), []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, SF), name)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == table(spark).columns
            seen.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert seen[-1] == {i for i, _ in good} and 302 not in seen[0] and not seen[1] & {i for i, _ in junk}
    assert {r.doc_id for r in docs.select("doc_id").collect()} == seen[-1]
    assert len(corpus_pipeline.STAGES) == 5
