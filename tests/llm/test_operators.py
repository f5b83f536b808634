"""Edge cases and brute-force comparisons of the training-data operators on small frames."""

from __future__ import annotations

import hashlib
import json
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orderlens.llm import chat_format, decontaminate, license_scan, line_dedup, near_dedup, nearest, packing, sharding, token_counts, toxicity

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, n_lines int, rejected string"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


WORDS = [f"w{k}x" for k in range(400)]
BASE = prose(1, 120)
EDITED = BASE.replace(BASE.split()[60], "changed", 1)
LINES = "\n".join(prose(k, 15) for k in range(20, 26))
ROWS = [
    (1, BASE, "en", "a"),
    (2, EDITED, "en", "a"),
    (3, BASE, None, "b"),
    (3, BASE, None, "b"),  # a repeated row
    (4, None, "en", None),
    (5, "", "en", "b"),
    (6, " \n\n ", "de", "b"),
    (7, "one two", "en", "b"),
    (8, "one two", "en", "b"),
    (9, LINES, "en", "c"),
    (10, prose(30, 9) + "\n" + LINES.split("\n", 2)[2] + "\nends here", "en", "c"),
    (11, prose(40, 30_000), "en", "c"),  # very long
    (None, "no id at all", "en", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, lang, s, len(t) if t else None, 9, 9, "clash") for i, t, lang, s in ROWS]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def shingles(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def test_near_duplicates_match_brute_force(docs, none):
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect()}
    size = {i: len(shingles(t)) for i, t, *_ in ROWS}
    root = {1: 1, 2: 1, 3: 1, 7: 7, 8: 7}
    want = {(i, size[i], root.get(i, i), root.get(i, i) == i) for i, *_ in ROWS if i is not None} | {(None, 1, None, True)}
    assert got == want
    assert near_dedup.near_duplicates(none).count() == 0


@pytest.mark.parametrize("block", [near_dedup.BLOCK_SHINGLES, 2000])
def test_near_duplicates_of_a_chain_and_a_large_group(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", block)
    rng = random.Random(3)
    words = prose(5, 200).split()
    texts = []
    for _ in range(150):  # each two edits away from the base, which is absent
        own = list(words)
        for at in rng.sample(range(5, 195), 2):
            own[at] = f"e{rng.random()}"
        texts.append(" ".join(own))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(frame).collect()}
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        for a in range(len(texts)):
            for b in range(a):
                if root[a] != root[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    low, high = sorted((root[a], root[b]))
                    root = [low if r == high else r for r in root]
        break
    assert got == dict(enumerate(root))


def test_texts_that_share_an_id_are_one_document(spark):
    other, third = prose(70, 90), prose(71, 50)
    rows = [(5, BASE), (5, other), (9, EDITED), (12, other), (3, third), (5, third), (20, prose(72, 40))]
    got = {(r.doc_id, r.component_id) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(5, 3), (9, 3), (12, 3), (3, 3), (20, 20)}


def test_near_dedup_stage_links_from_four_fifths_on(spark):
    import corpus_pipeline

    words = prose(60, 300).split()
    for at in (50, 100, 150, 200, 250):
        words[at] = f"edit{at}"
    texts = [prose(60, 300), " ".join(words), prose(61, 300)]
    both, all_ = len(shingles(texts[0]) & shingles(texts[1])), len(shingles(texts[0]) | shingles(texts[1]))
    assert 0.80 <= both / all_ < 0.85
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, frame, "").collect()) == [0, 2]


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**64, (2, 3000), dtype=np.uint64)
    b[:2000] = a[:2000]
    ra, rb = near_dedup.registers(a), near_dedup.registers(b)
    assert (near_dedup.merge_registers(ra, rb) == near_dedup.registers(np.union1d(a, b))).all()
    n = np.array([3000.0])
    j = near_dedup.estimated(n, n, np.array([(ra > rb).sum()]), np.array([(ra < rb).sum()]))
    assert abs(j[0] - 0.5) < 0.2


def test_lines_of_later_documents_go(docs, none):
    got = {(r.doc_id, r.text, r.lines_removed) for r in line_dedup.deduplicated_lines(docs).collect()}
    left = prose(30, 9) + "\nends here"
    want = {(i, t, 0) for i, t, *_ in ROWS if i not in (3, 10)} | {(3, "", 1), (10, left, 4)}
    assert got == want
    out = line_dedup.deduplicated_lines(none)
    assert out.count() == 0 and set(out.columns) == {*docs.columns, "lines_removed"}


def test_lines_of_blocks_of_short_lines_go(spark):
    one, two, three = ("\n".join([prose(k, 4)]) for k in (80, 81, 82))
    texts = [f"{one}\n{two}", f"{two}\n{three}", f"{one}\n{two}\n{three}", f"start\n{one}\n{two}\n{three}\nend"]
    rng = random.Random(11)
    short = [prose(90 + k, rng.randrange(0, 7)) or "-" for k in range(8)]
    texts += ["\n".join(rng.choice(short) for _ in range(rng.randrange(1, 9))) for _ in range(120)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.deduplicated_lines(frame).collect()}
    assert got[3] == "start\nend"
    lines = [t.split("\n") for t in texts]
    for d, own in enumerate(lines):
        runs = {tuple(x[s:e]) for x in lines[:d] for s in range(len(x)) for e in range(s + 1, len(x) + 1)}
        gone = set()
        for s in range(len(own)):
            for e in range(s + 1, len(own) + 1):
                if sum(len(x.split()) for x in own[s:e]) >= 10 and tuple(own[s:e]) in runs:
                    gone.update(range(s, e))
        assert got[d] == "\n".join(x for k, x in enumerate(own) if k not in gone)


def test_common_blocks():
    sizes = [20] * 6
    assert line_dedup.common_blocks([1, 2, 3], [3, 1, 2, 9, 9, 1], sizes, 10) == [0, 1, 2, 5]  # moved and repeated
    assert line_dedup.common_blocks([1, 2], [1, 5], [3, 20], 10) == []
    assert line_dedup.patience([1, 7, 2, 7, 3], [1, 2, 7, 3]) == [(0, 0), (2, 1), (3, 2), (4, 3)]


def test_decontamination(spark, docs, none):
    item = prose(50, 40)
    words = item.split()
    words[7] = words[20] = "else"
    rows = [(1, prose(51, 300) + " " + item + " " + prose(52, 50)), (2, "A " + " ".join(words)), (3, prose(53, 200)), (4, None), (5, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(7, item, 1), (8, None, 1), (9, "", 1), (None, "tiny item", 1)], "item_id long, text string, score int")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(frame, items).collect()}
    assert set(got) == {(1, 7), (2, 7)}
    assert got[1, 7].score == 1 and (got[1, 7].first_word, got[1, 7].end_word) == (300, 340)
    assert got[2, 7].score == pytest.approx((38 - 2) / 40)
    assert decontaminate.contaminated(none, items).count() == 0
    assert decontaminate.contaminated(docs, items.where("false")).count() == 0


def test_decontamination_finds_every_pair_that_reaches_the_score(spark):
    rng = random.Random(9)
    items = [f"i{k}x{j}" for k in range(30) for j in range(20)]
    items = [" ".join(items[20 * k : 20 * k + 20]) for k in range(30)] + ["pair word", "solo"]
    texts = []
    for k, item in enumerate(items[:30]):  # every third to fifth word replaced, or words put in between
        words = item.split()
        if k % 2:
            words = [f"r{k}" if j % (3 + k % 3) == 2 else w for j, w in enumerate(words)]
        else:
            words = [x for j, w in enumerate(words) for x in ([w, f"n{j}"] if j % (2 + k % 4) == 1 else [w])]
        texts.append(" ".join([prose(70 + k, 60), *words, prose(170 + k, 60)]))
    texts += [texts[0]] * 20 + [rng.choice(items) + " solo pair " + prose(400, 3)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id, round(r.score, 9)) for r in decontaminate.contaminated(frame, bench).collect()}
    want = set()
    code = {}
    numbers = lambda t: np.array([code.setdefault(w, len(code)) for w in t.split()])
    for d, text in enumerate(texts):
        for i, item in enumerate(items):
            score = decontaminate.local_alignment(numbers(text), numbers(item))[0] / len(item.split())
            if score >= 0.5:
                want.add((d, i, round(score, 9)))
    assert got == want and len(want) > 40


def test_local_alignment_matches_the_table():
    rng = np.random.default_rng(0)
    for _ in range(30):
        a, b = rng.integers(0, 4, 15), rng.integers(0, 4, 9)
        h = np.zeros((10, 16), dtype=int)
        for i in range(1, 10):
            for j in range(1, 16):
                h[i, j] = max(0, h[i - 1, j - 1] + (1 if b[i - 1] == a[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert decontaminate.local_alignment(a, b)[0] == h.max()


def test_packing_round_trip(docs, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(VOCABULARY)
    got = packing.packed_documents(docs, VOCABULARY, group=4).toPandas()
    want = []
    for i, text, *_ in ROWS:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            want.append((str(i), k // 2048, k, zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())))
    ids = ["None" if np.isnan(x) else str(int(x)) for x in got.doc_id]
    assert sorted(want) == sorted(zip(ids, got.piece, got.start, map(zlib.crc32, got.ids)))
    for _, held in got.sort_values("offset").groupby("sequence_id"):
        assert list(held.offset) == [0, *held.length.cumsum()[:-1]] and held.length.sum() <= 2048
    assert packing.packed_documents(none, VOCABULARY).count() == 0


def test_word_ids_are_those_of_the_tokenizer():
    from tokenizers import Tokenizer

    tokenizer, rng = Tokenizer.from_file(VOCABULARY), random.Random(11)
    parts = ["A", "b", "\u00c9", "e\u0301", "\u0130", "\u0131", "\u03a3", "\u03c2", "\u01c5", "\u00df", "\ufb01", "\u0301", " ", "\u2028", "\x85", "\xa0"]
    parts += ["\n", "\t", "\x0b", "\x1c", "\0", ".", ",", "&&&", "(", "\\", "|", "<", "'", "'s", "'S", "'ll", "<|", "<|endoftext|>", "<|startoftext|>"]
    parts += ["\u4e2d", "\ud55c", "\u3131", "0", "12", "\u00b2", "\u00bd", "\U0001f600", "\u200d", "_", "-", "\u212a", "\u212b", "\u1e9e", "word", "Wort"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(4000)] + ["", None, "word " * 20_000]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    got = [[] for _ in texts]
    for part in packing._piece_batches(VOCABULARY, 2048)(iter([batch])):
        for row in part.to_pylist():
            assert row["start"] == len(got[row["doc_id"]]) == 2048 * row["piece"] and 4 * row["length"] == len(row["ids"])
            got[row["doc_id"]] += np.frombuffer(row["ids"], "<u4").tolist()
    assert got == [tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]


def test_packing_bound_and_fit():
    rng = np.random.default_rng(4)
    for _ in range(20):
        lengths = rng.integers(1, 100, 200)
        bins, _, fill = packing.best_fit(lengths, 100)
        assert (np.bincount(bins, lengths) == fill).all() and fill.max() <= 100
        assert -(-lengths.sum() // 100) <= packing.lower_bound(lengths, 100) <= len(fill)
    assert packing.lower_bound(np.array([51, 51, 51]), 100) == 3


def test_severity(spark, docs, none):
    rng = random.Random(2)
    rows = [(i, prose(i, 60) + (" vile nasty," if i % 3 == 0 else "") + (" vile awful" if i % 6 == 0 else "")) for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)] + [(999, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit_severity(frame, labels)
    got = toxicity.severity(frame.where("doc_id >= 200"), model).collect()
    assert all(r.rejected == (r.doc_id % 3 == 0) for r in got)
    assert model.thresholds[0] < model.thresholds[1]
    clash = toxicity.severity(docs, model, docs.columns)
    assert clash.count() == len(ROWS) and not clash.where("rejected").count() and clash.columns.count("rejected") == 1
    assert toxicity.severity(none, toxicity.fit_severity(none, labels)).count() == 0
    assert not toxicity.severity(frame, toxicity.fit_severity(frame, labels.where("toxic = 0"))).where("rejected").count()


def greedy(word: tuple[int, ...], pieces: set[tuple[int, ...]]) -> int:
    """Pieces of a word by trying the longest first, or -1 if none fits somewhere."""
    n = 0
    while word:
        size = next((k for k in range(min(len(word), 80), 0, -1) if word[:k] in pieces), 0)
        if not size:
            return -1
        word, n = word[size:], n + 1
    return n


def test_token_counts_match_greedy(docs, none):
    pieces = token_counts.vocabulary(VOCABULARY)
    with open(VOCABULARY, encoding="utf-8") as file:
        named = json.load(file)["model"]["vocab"]
    assert len(pieces) == len(named)  # no piece is lost or merged with another
    got = sorted((str(r[0]), r[1], r[2], r[3]) for r in token_counts.token_counts(docs, VOCABULARY).collect())
    want = []
    for i, text, *_ in ROWS:
        words = re.findall(r"\w+|[^\w\s]+", (text or "").lower())
        found = [greedy((*w.encode(), token_counts.END), pieces) for w in words]
        want.append((str(i), len(words), sum(max(n, 1) for n in found), found.count(-1)))
    assert got == sorted(want)
    assert token_counts.token_counts(none, VOCABULARY).count() == 0
    small = token_counts.Automaton([b"a", b"abcd", b"b", b"bc"])
    assert [small.count(w) for w in (b"abcd", b"abc", b"abcx", b"ab", b"")] == [1, 2, -1, 2, 0]


def test_token_counts_of_random_words_with_end_marks():
    rng, end = random.Random(5), token_counts.END
    for _ in range(300):
        pieces = {tuple(rng.choices(b"abc", k=rng.randint(1, 4))) + (end,) * rng.randint(0, 1) for _ in range(12)}
        automaton = token_counts.Automaton(sorted(pieces))
        for _ in range(20):
            word = (*rng.choices(b"abc", k=rng.randint(1, 12)), end)
            assert automaton.count(word) == greedy(word, pieces)


def hilbert(point: list[int], bits: int) -> int:
    """Place on the curve by turning quadrants (two dimensions)."""
    x, y, d, s = *point, 0, 1 << (bits - 1)
    while s:
        rx, ry = int(bool(x & s)), int(bool(y & s))
        d += s * s * ((3 * rx) ^ ry)
        if not ry:
            if rx:
                x, y = (s - 1) - (x & (s - 1)), (s - 1) - (y & (s - 1))
            x, y = y, x
        s >>= 1
    return d


def test_hilbert_index_walks_by_one_step(spark):
    side = 8
    grid = spark.range(side**3).selectExpr("id % 8 as x", "id div 8 % 8 as y", "id div 64 as z")
    rows = grid.withColumn("h", sharding.hilbert_index([F.col(c) for c in "xyz"], 3)).orderBy("h").collect()
    assert [r.h for r in rows] == list(range(side**3))
    assert all(abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) == 1 for a, b in zip(rows, rows[1:]))


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_shards(docs, none, law):
    by = {"lang": F.col("lang"), "n_chars": F.col("n_chars")}
    got = sharding.hilbert_shards(docs, 4, by, ["doc_id"], law).toPandas()
    assert len(got) == len(ROWS)
    for _, held in got.groupby("shard"):
        assert sorted(held.slot) == list(range(len(held)))
    if law == "rows":
        assert got.shard.value_counts().agg(["min", "max"]).tolist() == [3, 4]
    assert sharding.hilbert_shards(none, 4, by, ["doc_id"], law).count() == 0


def test_cells_follow_the_curve_over_ranks_of_whole_strings(spark):
    """Strings that share more than seven bytes get levels of their own; cells are those of an independent curve."""
    bits, rng = 3, random.Random(7)
    rows = [(k, f"https://host/crawl-{rng.randrange(40):03}" if k % 9 else None, rng.randrange(1000)) for k in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_chars long")
    got = sharding.with_cell(df, {"source": F.col("source"), "n_chars": F.col("n_chars")}, bits).collect()
    sources = sorted((r[1] for r in rows), key=lambda s: (s is not None, s or ""))
    level = {s: sources.index(s) * (1 << bits) // len(rows) for s in set(sources)}
    dense = {n: k for k, n in enumerate(sorted(set(level.values())))}
    cells = {}
    for r in got:
        cells.setdefault((dense[level[r.source]], r["__cell"]), []).append(r.n_chars)
    assert len({s for s, _ in cells}) == 1 << bits
    ranges = {}
    for (x, cell), held in cells.items():
        y = next(y for y in range(1 << bits) if hilbert([x, y], bits) == cell)
        low, high = ranges.get(y, (1000, -1))
        ranges[y] = min(low, *held, low), max(high, *held, high)
    spans = [ranges[y] for y in sorted(ranges)]
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_shards_by_bytes_are_near_even_and_maps_may_be_columns(spark):
    rows = [(k, "x" * (k % 50), {"k": k}) for k in range(2000)] + [(5000, None, None), (5000, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, extra map<string, int>")
    got = sharding.hilbert_shards(df, 6, {"doc_id": F.col("doc_id")}, ["doc_id"], "bytes").toPandas()
    size = got.text.fillna("").str.len() + sharding.ROW_BYTES
    held = size.groupby(got.shard).sum()
    assert len(got) == len(rows) and len(held) == 6 and held.max() - held.min() <= 2 * size.max()


def test_written_shards_read_back_in_order(spark, tmp_path):
    df = spark.range(100).selectExpr("id as doc_id", "repeat('y', cast(id % 7 as int)) as text")
    sharded = sharding.hilbert_shards(df, 3, {"doc_id": F.col("doc_id")}, ["doc_id"], "rows")
    sharding.write_shards(sharded, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted(map(tuple, back.select("doc_id", "shard", "slot").collect())) == sorted(
        map(tuple, sharded.select("doc_id", "shard", "slot").collect())
    )


@pytest.mark.parametrize("budget", [1024, 60])
def test_chat_windows_read_back(spark, budget):
    said = "<|im_end|><|im_start|>assistant &lt;| &amp; ok"
    rows = [(1, 0, "system", "be <|kind|>"), (1, 1, "user", None), (1, 2, "assistant", said), (1, None, "user", "first"), (2, 0, "system", "alone")]
    rows += [(3, k, ("user", "assistant")[k % 2], prose(k, k % 17)) for k in range(600)] + [(4, 0, "we\nird", "x"), (4, 0, "we\nird", "x"), (None, 1, "user", "y")]
    rows += [(5, 0, "system", "rules")] + [(5, k, "assistant", prose(k, 12)) for k in range(1, 40)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, window int")
    windows = chat_format.chat_windows(frame, budget, 20)
    read = chat_format.turns_of(windows).orderBy("conv_id", "window").collect()
    turns, targets = {}, {}
    for r in read:
        turns.setdefault(r.conv_id, []).extend(r.turns)
        targets.setdefault(r.conv_id, []).extend(r.targets)
    low = float("-inf")
    want, loss = {}, {}
    for c, _, role, text in sorted(rows, key=lambda r: (r[0] or 0, low if r[1] is None else r[1])):
        want.setdefault(c, []).append(f"{role}\n{text or ''}\n")
        if role == "assistant":
            loss.setdefault(c, []).append(text or "")
    assert turns == want and {c: t for c, t in targets.items() if t} == loss
    long = windows.where(F.col("n_tokens") > budget).where("size(split(text, '<[|]im_start[|]>')) - repeated > 2")
    assert not long.count()
    if budget == 60:
        again = windows.where("conv_id = 5 and window > 0").collect()
        assert again and all("system\nrules" in w.text and w.repeated >= 1 for w in again)
    assert chat_format.chat_windows(frame.where("false")).count() == 0


def test_nearest_matches_brute_force(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 20))
    x[300:400] = x[0]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    bad = [(700, None, 1), (800, [0.0] * 20, 1), (900, [1.0] * 19 + [None], 1), (1000, [float("nan")] * 20, 1), (1100, [1.0], 1), (None, [1.0] * 20, 1)]
    frame = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, rank int")
    got = nearest.nearest(frame, frame.where("vec_id % 100 = 0"), 10, candidates=150).toPandas()
    hits = 0
    for q in range(0, 600, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        want = np.lexsort((np.arange(600), d))[:10]
        own = got[got.query_id == q].sort_values("rank")
        assert list(own["rank"]) == list(range(1, 11)) and np.allclose(own.score, d[own.vec_id])
        hits += len(set(own.vec_id) & set(want))
    assert set(got.query_id) == set(range(0, 600, 100)) and hits >= 54
    assert nearest.nearest(frame.where("false"), frame, 10).count() == 0
    assert nearest.nearest(frame, frame.where("false"), 10).count() == 0


def test_nearest_widens_a_radius_of_too_few_candidates(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4000, 20))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = nearest.nearest(frame, frame.where("vec_id % 100 = 0"), 10, candidates=12).toPandas()
    hits = 0
    for q in range(0, 4000, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        own = got[got.query_id == q].sort_values("rank")
        assert own.vec_id.is_unique and np.allclose(own.score, d[own.vec_id])
        hits += len(set(own.vec_id) & set(np.argsort(d)[:10]))
    assert hits >= 0.9 * 400


def test_licence_notices(spark, docs, none):
    texts = ["Intro\nLicensed under the Apache License, Version 2.0.\nx", "released under the mit license", "My driving license is new.", None, "", "a\n\nThis work is licensed under the GNU General Public License"]
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, family string")
    got = {(r.doc_id, r.paragraph, r.family, r.confirmed) for r in license_scan.licence_notices(frame).collect()}
    assert got == {(0, 1, "apache-2.0", True), (1, 0, "mit", True), (5, 2, "gpl", True)}
    assert license_scan.licence_notices(docs).count() == 0 and license_scan.licence_notices(none).count() == 0


def test_queries_are_registered():
    from orderlens.llm.queries import QUERIES

    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 11))
    assert hashlib.sha256(b"").hexdigest()
