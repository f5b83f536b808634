"""Severity of toxic text by cumulative-link ordinal regression on hashed words.

``P(grade <= k) = sigmoid(theta_k - w.x)``: one weight vector for all ordered
thresholds. x holds log(1 + occurrences) of hashed lower-case words and of their
first eight bytes. Only features that a likelihood-ratio test finds more
frequent in toxic rows take part, under an L1 penalty, so scores of very long
clean texts do not drift. Where labels carry no `severity`, grade 0 is not
toxic, and toxic rows are halved into grades 1 and 2 by the mass of such features.

The model is fitted on at most SAMPLE_TOXIC + SAMPLE_CLEAN labelled rows (the
first by a hash of their id), whose word counts go to the driver; scoring reads
every text whole.

Cases: null and empty texts have no words and get the score of x = 0. Labels
without document, null labels and labels of either class missing altogether are
allowed; without toxic labels no text is rejected. Repeated rows are scored
each. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from orderlens.llm.hashing import Units, mix, tokens

BITS = 18
RESULTS = ("severity", "p_toxic", "grade", "rejected")
SAMPLE_TOXIC, SAMPLE_CLEAN = 2000, 4000
PENALTY = 0.0003
PREFIX_BYTES = 8
EVIDENCE = 18.0  # likelihood ratio a feature must reach
STEPS = 400
REJECT_AT = 0.35  # probability of a grade above 0


@dataclass
class SeverityModel:
    weights: np.ndarray  # by hash bucket, mostly zero
    thresholds: np.ndarray  # ascending, one fewer than grades

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold, a row for each score."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -50, 50)))


def _features(units: Units) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and prefixes of a slice, and the text of each."""
    text = np.searchsorted(units.bounds, np.arange(len(units.hashes)), side="right") - 1
    return np.concatenate((_bucket(units.hashes), _bucket(mix(units.prefixes(PREFIX_BYTES))))), np.concatenate((text, text))


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, counts = [], []
        for units in tokens(batch.column(1)):
            bucket, text = _features(units)
            pair, n = np.unique((text << BITS) + bucket, return_counts=True)
            ends = np.searchsorted(pair >> BITS, np.arange(1, len(units)))
            rows.extend(np.split(pair % (1 << BITS), ends))
            counts.extend(np.split(n, ends))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([x.astype(np.int32).tobytes() for x in rows], pa.binary()),
                pa.array([x.astype(np.int32).tobytes() for x in counts], pa.binary()),
            ],
            names=["grade", "buckets", "counts"],
        )


def _sample(docs: DataFrame, labels: DataFrame) -> list:
    grade = F.col("severity") if "severity" in labels.columns else F.col("toxic")
    known = labels.select(F.col("doc_id").alias("id"), grade.cast("int").alias("grade")).where("grade is not null")

    def first(condition: str, most: int) -> DataFrame:
        return known.where(condition).orderBy(F.xxhash64("id"), "id", "grade").limit(most)

    chosen = first("grade > 0", SAMPLE_TOXIC).unionByName(first("grade <= 0", SAMPLE_CLEAN))
    text = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"))
    read = text.join(F.broadcast(chosen), "id").select("grade", "text")
    return read.mapInArrow(_count_batches, "grade int, buckets binary, counts binary").collect()


def _telling(toxic: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Buckets that far more toxic rows hold than chance gives."""
    size = 1 << BITS
    a, b = (np.bincount(col[toxic[row] == side], minlength=size) for side in (True, False))
    share = toxic.mean()
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = 2 * (np.nan_to_num(a * np.log(a / ((a + b) * share))) + np.nan_to_num(b * np.log(b / ((a + b) * (1 - share)))))
    return (ratio >= EVIDENCE) & (a > 4 * share / max(1 - share, 1e-9) * b)


def _halved(grade: np.ndarray, row: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """Grades 0, 1, 2 out of 0 and 1: toxic rows by their mass of telling features, at the median."""
    toxic = grade > 0
    total = np.bincount(row, mass, minlength=len(grade))
    high = (total >= np.median(total[toxic])) & (total > total[toxic].min())
    return np.where(toxic, 1 + high, 0)


def fit_severity(docs: DataFrame, labels: DataFrame) -> SeverityModel:
    # Packed bytes keep the sample small on the driver; sorted, as tasks end in any order.
    sample = sorted((r["grade"], bytes(r["buckets"]), bytes(r["counts"])) for r in _sample(docs, labels))
    grade = np.array([g for g, _, _ in sample], dtype=np.int64)
    if not (grade > 0).any():
        return SeverityModel(np.zeros(1 << BITS), np.array([50.0]))
    row = np.repeat(np.arange(len(sample), dtype=np.int32), [len(b) // 4 for _, b, _ in sample])
    col = np.frombuffer(b"".join(b for _, b, _ in sample), np.int32)
    count = np.frombuffer(b"".join(c for _, _, c in sample), np.int32)
    del sample
    telling = _telling(grade > 0, row, col)
    used = np.flatnonzero(telling)
    keep = telling[col]
    row, col, count = row[keep], np.searchsorted(used, col[keep]), count[keep]
    if "severity" not in labels.columns:
        grade = _halved(grade, row, count)
    weights, thresholds = _fit(grade, row, col, np.log1p(count), len(used))
    full = np.zeros(1 << BITS)
    full[used] = weights
    return SeverityModel(full, thresholds)


def _fit(grade: np.ndarray, row: np.ndarray, col: np.ndarray, value: np.ndarray, width: int):
    """Accelerated proximal gradient on the mean negative log-likelihood."""
    n, top = len(grade), int(grade.max())
    share = np.full(n, 1 / n)
    # Thresholds as a first one and positive steps keep their order.
    theta, gaps = 1.0, np.zeros(max(0, top - 1))
    w = np.zeros(width)
    step = 4.0 / max(1e-9, np.bincount(col, value**2 * share[row], minlength=width).max(initial=0) * 40)
    seen, pace = (w, theta, gaps), 1.0
    for _ in range(STEPS):
        cuts = theta + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))
        score = np.bincount(row, value * w[col], minlength=n)
        ends = np.concatenate((np.full((n, 1), -60.0), cuts[None, :] - score[:, None], np.full((n, 1), 60.0)), axis=1)
        at = 1 / (1 + np.exp(-np.clip(ends, -60, 60)))
        slope = at * (1 - at)
        slope[:, 0] = slope[:, -1] = 0
        k = np.arange(n)
        inside = np.maximum(at[k, grade + 1] - at[k, grade], 1e-12)
        hi, lo = slope[k, grade + 1] / inside * share, slope[k, grade] / inside * share
        d_score = hi - lo  # of the negative log-likelihood
        d_cut = np.zeros(top)
        np.add.at(d_cut, grade[grade < top], -hi[grade < top])
        np.add.at(d_cut, grade[grade > 0] - 1, lo[grade > 0])
        d_w = np.bincount(col, value * d_score[row], minlength=width)
        after = d_cut[::-1].cumsum()[::-1]
        moved = w - step * d_w
        new = (
            np.sign(moved) * np.maximum(np.abs(moved) - step * PENALTY, 0),
            theta - min(step, 2.0) * d_cut.sum(),
            gaps - min(step, 2.0) * after[1:] * np.exp(gaps),
        )
        faster = (1 + np.sqrt(1 + 4 * pace**2)) / 2
        push = (pace - 1) / faster
        w, theta, gaps = (x + push * (x - y) for x, y in zip(new, seen))
        seen, pace = new, faster
    w, theta, gaps = seen
    return w, theta + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))


def _scores(model: SeverityModel, keep: Sequence[str], at: int):
    """The columns `keep` and the scores of the texts in column `at`."""
    weights = model.weights.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.zeros(batch.num_rows)
            for units in tokens(batch.column(at)):
                bucket, text = _features(units)
                told = np.flatnonzero(weights[bucket])
                pair, n = np.unique((text[told] << BITS) + bucket[told], return_counts=True)
                mass = np.log1p(n) * model.weights[pair % (1 << BITS)]
                score[units.first : units.first + len(units)] += np.bincount(pair >> BITS, mass, minlength=len(units))
            above = model.above(score)
            grades = -np.diff(above, axis=1, prepend=1.0, append=0.0)
            results = [
                pa.array(above.sum(axis=1)),
                pa.array(above[:, 0]),
                pa.array(grades.argmax(axis=1).astype(np.int32)),
                pa.array(above[:, 0] >= REJECT_AT),
            ]
            kept = batch.select(keep)
            yield pa.RecordBatch.from_arrays([*kept.columns, *results], names=[*keep, *RESULTS])

    return run


def severity(docs: DataFrame, model: SeverityModel, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row for each row of `docs`: the columns `keep`, expected severity, probability of any toxicity, likeliest grade, verdict.

    Columns of `keep` that bear the name of a result give way to it.
    """
    keep = [c for c in keep if c not in RESULTS]
    own = "text" in keep and docs.schema["text"].dataType == StringType()  # a kept text need not be sent twice
    rows = docs.select(*keep) if own else docs.select(*keep, F.col("text").cast("string").alias("__scored"))
    fields = [rows.schema[c] for c in keep]
    added = StructType().add("severity", "double").add("p_toxic", "double").add("grade", "integer").add("rejected", "boolean")
    return rows.mapInArrow(_scores(model, keep, keep.index("text") if own else len(keep)), StructType([*fields, *added.fields]))
