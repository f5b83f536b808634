"""Members of a block are compared by registers without a search for each of them."""

import numpy as np
import pyarrow as pa

from orderlens.llm import near_dedup


def _block(members: int, within: bool) -> pa.RecordBatch:
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    sets = [np.union1d(base[: 400 - 9 * (k % 20)], rng.integers(0, 2**63, 9 * (k % 20), dtype=np.uint64)) for k in range(members)]
    columns = {
        "block": np.zeros(members, np.int64),
        "node": np.arange(members),
        "root": np.arange(members) // 2,
        "straggler": [within or k % 3 == 0 for k in range(members)],
        "within": [within] * members,
        "n_shingles": [len(s) for s in sets],
        "registers": [near_dedup.registers(s).tobytes() for s in sets],
    }
    return pa.RecordBatch.from_pydict(columns)


def _hits(batch: pa.RecordBatch, percent: int) -> list[int]:
    return [n for b in near_dedup._members_in_reach(percent)(iter([batch])) for n in b.column(1).to_pylist()]


def _by_estimate(batch: pa.RecordBatch, percent: int) -> list[int]:
    rows, regs = batch.to_pylist(), near_dedup._rows(batch.column(6))
    least = percent / 100 - near_dedup.MARGIN * np.sqrt(percent * (100 - percent) / 1e4 / near_dedup.REGISTERS)
    hit = set()
    for x in rows:
        for y in rows:
            if x["straggler"] and x["root"] != y["root"] and (x["within"] or not y["straggler"]):
                n, m = x["n_shingles"], y["n_shingles"]
                a, b = regs[x["node"]], regs[y["node"]]
                counts = np.array([(a > b).sum()]), np.array([(a < b).sum()])
                if 100 * min(n, m) >= percent * max(n, m):
                    if near_dedup.estimated(np.array([n * 1.0]), np.array([m * 1.0]), *counts)[0] >= least:
                        hit |= {x["node"], y["node"]}
    return sorted(hit)


def test_members_in_reach_are_those_of_the_estimate(monkeypatch):
    for within in (True, False):
        batch = _block(41, within)
        for percent in (60, 85, 97):
            assert _hits(batch, percent) == _by_estimate(batch, percent)
    assert 0 < len(_hits(batch, 97)) < 41

    def searched(*_):
        raise AssertionError("a search for each member")

    monkeypatch.setattr(near_dedup, "estimated", searched)
    assert _hits(batch, 85)


def test_slope_decides_as_the_estimate_does():
    rng = np.random.default_rng(3)
    n_u = rng.integers(1, 3000, 20_000)
    n_v = np.maximum(1, (n_u * rng.uniform(0.8, 1.25, len(n_u))).astype(int))
    fits = 100 * np.minimum(n_u, n_v) >= 80 * np.maximum(n_u, n_v)
    n_u, n_v = n_u[fits].astype(float), n_v[fits].astype(float)
    above = rng.integers(0, 60, len(n_u))
    below = rng.integers(0, 97, len(n_u)) % (97 - above)
    for least in (0.3, 0.55, 0.79):
        found = near_dedup.reaches(n_u, n_v, above, below, least)
        assert (found == (near_dedup.estimated(n_u, n_v, above, below) >= least)).all()
        assert 0 < found.mean() < 1
    assert near_dedup.reaches(n_u, n_v, above, below, 0.0).all()
