"""Merkle manifest, WARC archives and hard negatives against brute force on small and awkward tables."""

from __future__ import annotations

import random
from hashlib import sha256
from io import BytesIO

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderlens.llm import hard_negatives, merkle, warc
from orderlens.llm.order import by_ranges, numbered


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def root_and_paths(leaves):
    """Level by level, without blocks: the root and each leaf's (place, others) steps."""
    paths, nodes, below = [[] for _ in leaves], list(leaves), [[i] for i in range(len(leaves))]
    while len(nodes) > 1:
        up, held = [], []
        for lo in range(0, len(nodes), 16):
            run = nodes[lo : lo + 16]
            for at, members in enumerate(below[lo : lo + 16]):
                for i in members:
                    paths[i].append((at, "".join(run[:at] + run[at + 1 :])))
            up.append(h(*run))
            held.append([i for members in below[lo : lo + 16] for i in members])
        nodes, below = up, held
    return nodes[0], paths


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_manifest_matches_level_by_level(spark, levels):
    rng = random.Random(levels)
    rows = [(k, rng.choice(["hot", "hot", "b", "é", None])) for k in range(600)] + [(None, "b"), (5, "hot"), (5, "hot"), (7, "alone")]
    frame = spark.createDataFrame([(*r, "clash", 9) for r in rows], "doc_id long, source string, root string, witness int")
    leaf = merkle.leaf_digest(F.col("doc_id"), F.col("source"))
    out = merkle.manifest(frame.withColumn("leaf", leaf), "source", ["doc_id"], levels=levels).collect()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    trees, paths = {}, {}
    for name in {s for _, s in rows}:
        own = sorted(((i is not None, i or 0), h(field(i), field(name))) for i, s in rows if s == name)
        trees[name], steps = root_and_paths([d for _, d in own])
        for (key, d), p in zip(own, steps):
            paths.setdefault((name, key), []).append((d, p))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    root, tops = root_and_paths([trees[s] for s in order])
    assert len(out) == len(rows)
    for r in out:
        got = (r.leaf, [(s["at"], s["siblings"]) for s in r.witness])
        want = [(d, p + tops[order.index(r.source)]) for d, p in paths[r.source, (r.doc_id is not None, r.doc_id or 0)]]
        assert got in want and r.subroot == trees[r.source] and r.root == root
    again = spark.createDataFrame(out).withColumn("up", merkle.folded(F.col("leaf"), F.col("witness")))
    assert again.where("up = root").count() == len(rows)
    assert again.where(merkle.folded(F.sha2(F.lit("x"), 256), F.col("witness")) == F.col("root")).count() == 0
    assert merkle.manifest(frame.withColumn("leaf", leaf).where("false"), "source", ["doc_id"]).count() == 0


def test_a_lone_row_is_its_own_root(spark):
    frame = spark.createDataFrame([(1, "s")], "doc_id long, source string").withColumn("leaf", merkle.leaf_digest(F.col("doc_id")))
    row = merkle.manifest(frame, "source", ["doc_id"]).first()
    assert row.root == row.subroot == row.leaf == h("1:1") and row.witness == []


def test_rows_of_a_hot_group_are_numbered(spark):
    frame = spark.range(5000).select(F.when(F.col("id") < 4000, "hot").otherwise(F.col("id").cast("string")).alias("g"), "id")
    got = numbered(by_ranges(frame, "g", "id", partitions=13), "g", "numbered").where("g = 'hot'").orderBy("id").collect()
    assert [r.position for r in got] == list(range(4000)) and {r.n for r in got} == {4000}


LONG = "<p>" + "long text " * 30_000 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n</p>"
PAGES = [
    (1, "http://www.b.example:80/x?q=1#top", "a" * 100),
    (2, "https://a.example/", "a" * 100),  # revisits 1
    (2, "https://a.example/", "a" * 100),  # a repeated row
    (3, "https://a.example", "a" * 99),
    (4, "https://a.example/", "a" * 99),  # too small to be a revisit
    (5, None, None),
    (6, "no address\nat all", ""),
    (7, "https://a.example/é", LONG),
    (8, "https://b.example/x?q=1", LONG),
    (None, "https://a.example/", "a" * 100),
]


def test_archives_give_back_every_page(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "RECORDS_PER_FILE", 3)
    monkeypatch.setattr(warc, "RANGE_ROWS", 4)
    frame = spark.createDataFrame([(*p, "2024-01-02 03:04:05", 1) for p in PAGES], "page_id long, url string, html string, captured string, size int")
    warc.write_archives(frame.repartition(3), str(tmp_path / "w"))
    entries = warc.read_archives(spark, str(tmp_path / "w"))
    got = warc.capture_index(entries).orderBy("place").collect()
    assert [r.place for r in got] == list(range(len(PAGES)))
    keys = [(r.url_key, r.date, r.page_id is not None, r.page_id or 0) for r in got]
    assert keys == sorted(keys)
    assert {r.page_id: r.url_key for r in got}[1] == "example,b)/x?q=1"
    first = {2: 1, 8: 7}
    want = sorted((str(i), len((t or "").encode()), h(t or ""), first.get(i)) for i, _, t in PAGES)
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.refers_to) for r in got) == want
    assert all(r.record_type == ("revisit" if r.refers_to else "response") for r in got)
    texts = sorted((r.page_id, r.payload.decode()) for r in warc.restored(spark, str(tmp_path / "w")).collect())
    assert texts == sorted((i, t or "") for i, _, t in PAGES if i)
    warc.write_archives(frame.where("false"), str(tmp_path / "none"))
    assert warc.capture_index(warc.read_archives(spark, str(tmp_path / "none"))).count() == 0


def test_a_cut_archive_or_changed_payload_is_noticed():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 9\r\n\r\n123"
    with pytest.raises(ValueError, match="cut"):
        list(warc.records(BytesIO(record)))
    fields = {"warc-type": "response", "warc-payload-digest": "sha256:" + h("abc"), "warc-record-id": "x"}
    assert warc._entry(fields, b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\nabc")[2] == b"abc"
    with pytest.raises(ValueError, match="match"):
        warc._entry(fields, b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\nabd")


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 16, 33])
def test_loser_tree_merges(k):
    rng = random.Random(k)
    runs = [sorted(rng.randrange(20) for _ in range(rng.randrange(9))) for _ in range(k)]
    got = list(warc.merged(runs))
    assert got == sorted(((r, p) for r, run in enumerate(runs) for p in range(len(run))), key=lambda x: (runs[x[0]][x[1]], x))


@pytest.mark.parametrize("shape", [(1, 1, 1), (65, 64, 130), (129, 67, 64), (200, 200, 200), (3, 500, 70), (64, 0, 64)])
def test_strassen_is_exact(shape):
    rng = np.random.default_rng(1)
    for top in (100, 2**25, 2**31):
        a, b = rng.integers(-top, top, shape[:2]), rng.integers(-top, top, shape[1:])
        assert (hard_negatives.product(a, b) == a @ b).all()


def negatives(rows):
    """The result from Python integers."""
    sound = {}
    for i, label, v in sorted((r for r in rows if None not in r), key=lambda r: (r[0], r[1])):
        if all(x is not None and np.isfinite(x) for x in v):
            sound.setdefault(i, (label, [int(np.floor(256 * float(np.float32(x)))) for x in v]))
    out = set()
    dot = lambda p, q: sum(x * y for x, y in zip(p, q))
    for a, (label, v) in sound.items():
        if a % 50 == 0:
            scored = sorted((-dot(v, w), i, other) for i, (other, w) in sound.items() if i != a)
            for s, p, other in [x for x in scored if x[2] == label][:5]:
                inside = [(n, -t) for t, n, o in scored if o != label and 50 * -s <= 100 * -t <= 95 * -s][:3]
                out |= {(a, p, k, n, -s, t) for k, (n, t) in enumerate(inside, 1)}
    return out


def test_hard_negatives_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ANCHORS", 4)
    monkeypatch.setattr(hard_negatives, "CANDIDATES", 60)
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(3, 6))
    rows = []
    for i in range(700):
        label = 0 if i % 3 else int(rng.integers(0, 3))
        rows.append((i, label, [float(x) for x in np.float32(centre[label] + rng.normal(size=6) * 2).round(1)]))
    rows += [(700, 1, None), (750, None, [1.0] * 6), (800, 2, [None] * 6), (850, 2, [float("nan")] * 6), (900, 1, [float("inf")] * 6)]
    rows += [(950, 7, [1.0] * 6), (1000, 1, [2.0, 1.0]), (1050, 2, []), (None, 1, [1.0] * 6), (50, *rows[50][1:]), (1100, 1, [0.0] * 6)]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, label int, embedding array<float>, q string")
    ready = hard_negatives.integer_rows(frame, "embedding", "label")
    got = {tuple(r) for r in hard_negatives.hard_negatives(ready, F.col("vec_id") % 50 == 0).collect()}
    assert got == negatives(rows) and got
    assert hard_negatives.hard_negatives(ready.where("false"), F.col("vec_id") % 50 == 0).count() == 0
    assert hard_negatives.hard_negatives(ready.where("vec_id = 50"), F.col("vec_id") % 50 == 0).count() == 0


def test_scores_beyond_doubles_stay_exact(spark):
    rows = [(k, k % 2, [float(2**17 + 3 * k + j) for j in range(5)]) for k in range(60)]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    ready = hard_negatives.integer_rows(frame, "embedding", "label", scale=256)
    got = {tuple(r) for r in hard_negatives.hard_negatives(ready, F.col("vec_id") % 50 == 0, low=0, high=200).collect()}
    dot = lambda a, b: sum(int(256 * x) * int(256 * y) for x, y in zip(rows[a][2], rows[b][2]))
    assert got and all(p == dot(a, b) and s == dot(a, n) for a, b, _, n, p, s in got)
