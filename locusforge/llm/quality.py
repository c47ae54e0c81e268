"""Quality rules: rule statistics of each text, and an isolation forest over them.

Trees of random splits are grown over a bounded sample of rows labelled good; a text that few splits set apart
from them is anomalous. The score that separates is calibrated on the labelled rows that the forest has not seen (half of
them, by a hash of the id), as counts by score bin; the shares caught and falsely rejected there are reported.

Edge cases: a null or empty text has no words and fails the base rule; ties and repeated rows get the same verdict;
without usable labels the forest isn't grown and the base rule alone decides; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from . import textcore as T

SYMBOLS = T.byte_table(b"#*$%&|<>")
DIGITS = T.byte_table(b"0123456789")
MARKS = T.byte_table(b"!?;:=_^~@{}[]\\/\"")
WINDOW = 8
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
COUNTS = [*BASE, "n_upper", "n_digits", "n_marks", "n_lines"]


def statistics(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of COUNTS for each text of a batch."""
    w = T.words(data, off, T.NOT_SPACE)
    lead = (data & 0xC0) != 0x80
    first, hashes = T.windows(T.span_hashes(data, w.start, w.end), w.doc, WINDOW)
    key = T.mix(hashes ^ (w.doc[first].astype(T.U) * T._P))
    order = np.argsort(key, kind="stable")
    same = (key[order][1:] == key[order][:-1]) & (w.doc[first][order][1:] == w.doc[first][order][:-1])
    again = np.zeros(len(key), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    repeated = T.covered(first[again], WINDOW, len(w.start))
    lines, dups = np.zeros(len(off) - 1, np.int64), np.zeros(len(off) - 1, np.int64)
    raw = data.tobytes()
    for i in range(len(off) - 1):
        said = [x for x in raw[off[i] : off[i + 1]].split(b"\n") if x.strip()]
        lines[i], dups[i] = len(said), len(said) - len(set(said))
    return {
        "n_words": np.diff(w.ptr),
        "word_chars": T.sums(lead & T.NOT_SPACE[data], off),
        "n_symbols": T.sums(SYMBOLS[data], off),
        "n_dup_lines": dups,
        "n_repeat_words": T.sums(repeated, w.ptr),
        "n_upper": T.sums(T.UPPER[data], off),
        "n_digits": T.sums(DIGITS[data], off),
        "n_marks": T.sums(MARKS[data], off),
        "n_lines": lines,
    }


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    """One row for each text: mean word length, and roots of shares, which tell small ones apart."""
    c = {k: np.asarray(v, np.float64) for k, v in c.items()}
    words, chars, lines = (np.maximum(1, c[k]) for k in ("n_words", "word_chars", "n_lines"))
    shares = [c["n_symbols"] / words, c["n_upper"] / chars, c["n_digits"] / chars, c["n_marks"] / chars, c["n_dup_lines"] / lines, c["n_repeat_words"] / words]
    return np.stack([np.minimum(c["word_chars"] / words, 50), *(np.sqrt(np.minimum(x, 1)) for x in shares)], axis=1)


def _expected(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, np.float64)
    m = np.maximum(n, 2)
    return np.where(n > 2, 2 * (np.log(m - 1) + 0.5772156649015329) - 2 * (m - 1) / m, np.where(n == 2, 1.0, 0.0))


@dataclass
class IsolationForest:
    """Trees as arrays: feature (-1 in a leaf), threshold, children, and the path length that a leaf stands for."""

    trees: int = 128
    rows: int = 256
    depth: int = 10
    seed: int = 11
    grown: list[tuple[np.ndarray, ...]] = field(default_factory=list)
    psi: int = 2

    def fit(self, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> IsolationForest:
        """Random cuts within the box from low to high; each part keeps its own box, so that a cut can set empty space apart."""
        rng = np.random.default_rng(self.seed)
        self.psi = max(2, min(self.rows, len(x)))
        for _ in range(self.trees):
            sample = x[rng.choice(len(x), min(self.psi, len(x)), replace=False)]
            nodes: list[list[float]] = []
            todo = [(sample, np.array(low, float), np.array(high, float), 0, -1, 0)]
            while todo:
                part, lo, hi, depth, parent, side = todo.pop()
                at = len(nodes)
                if parent >= 0:
                    nodes[parent][2 + side] = at
                can = np.flatnonzero(hi > lo)
                if depth >= self.depth or len(part) <= 1 or not len(can):
                    nodes.append([-1, 0.0, at, at, depth + float(_expected(len(part)))])
                    continue
                f = int(rng.choice(can))
                cut = rng.uniform(lo[f], hi[f])
                nodes.append([f, cut, 0, 0, 0.0])
                left = part[:, f] < cut
                upper, lower = hi.copy(), lo.copy()
                upper[f] = lower[f] = cut
                todo += [(part[left], lo, upper, depth + 1, at, 0), (part[~left], lower, hi, depth + 1, at, 1)]
            a = np.array(nodes)
            self.grown.append((a[:, 0].astype(np.int64), a[:, 1], a[:, 2:4].astype(np.int64), a[:, 4]))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 to the power of minus the mean path length over the expected one: near 1 for anomalies."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, cut, child, depth in self.grown:
            at = np.zeros(len(x), np.int64)
            while True:
                f = feature[at]
                if (f < 0).all():
                    break
                right = x[rows, np.maximum(f, 0)] >= cut[at]
                at = child[at, right.astype(np.int64)]
            total += depth[at]
        return np.exp2(-total / max(1, len(self.grown)) / float(_expected(self.psi)))


def rule_statistics(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of `carry` and COUNTS for each document."""
    shared.prepare(docs.sparkSession)
    keys = ["doc_id", *carry]
    fields = ", ".join(f"{k} {docs.schema[k].dataType.simpleString()}" for k in keys)

    @shared.lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, off in shared.steps(batch, "text"):
                c = statistics(data, off)
                yield pa.RecordBatch.from_arrays([*(rows.column(k) for k in keys), *(pa.array(c[k].astype(np.int64)) for k in COUNTS)], [*keys, *COUNTS])

    return docs.select(*keys, shared.text_bytes()).mapInArrow(count, f"{fields}, " + ", ".join(f"{k} long" for k in COUNTS))


def _scored(counts: DataFrame, forest: IsolationForest, extra: tuple[str, ...] = ()) -> DataFrame:
    held = counts.sparkSession.sparkContext.broadcast(forest)  # trees x rows nodes, whatever the input
    keep = ["doc_id", *extra, *COUNTS]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in counts.select(keep).schema)

    @shared.lean
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features({k: b.column(k).to_numpy(zero_copy_only=False) for k in COUNTS})
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.round(held.value.score(x), 6))], [*b.schema.names, "anomaly"])

    return counts.select(keep).mapInArrow(add, f"{fields}, anomaly double")


def threshold_from(bins: list[tuple[float, int, int]], max_false_reject: float) -> float | None:
    """From (score, good, bad) counts the score above which the most bad minus good rows lie, while at most the given share of good rows does."""
    good, total, best, at = 0, sum(b[1] for b in bins), 0, None
    net = 0
    for score, g, b in sorted(bins, reverse=True):
        good, net = good + g, net + b - g
        if good > max_false_reject * total:
            break
        if net > best:
            best, at = net, score
    return at


def shares(bins: list[tuple[float, int, int]], cut: float | None) -> tuple[float | None, float | None]:
    """(caught of the bad, rejected of the good) by a cut."""
    out = []
    for which in (2, 1):
        total = sum(b[which] for b in bins)
        out.append(sum(b[which] for b in bins if cut is not None and b[0] >= cut) / total if total else None)
    return out[0], out[1]


def quality_rules(docs: DataFrame, labels: DataFrame, *, sample_rows: int = 8192, trees: int = 128, tree_rows: int = 256, max_false_reject: float = 0.005, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of `carry`, base statistics, base_failed, anomaly (score), anomaly_cut and its held-out caught_share and false_share, kept.

    sample_rows bounds the good and the bad labelled rows that the forest sees, each: those with the least hash of
    their id. Good rows are what trees isolate; both give the box that cuts are drawn from.
    """
    counts = shared.materialize(rule_statistics(docs, carry), "quality")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    label = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = shared.materialize(counts.where(~failed).join(label, "doc_id"), "labelled")
    seen = F.xxhash64("doc_id") % 2 == 0

    def sample(which: str) -> np.ndarray:
        rows = known.where(seen).where(which).select(F.xxhash64("doc_id").alias("h"), *COUNTS).orderBy("h", *COUNTS).limit(sample_rows).toPandas()
        return features({k: rows[k].to_numpy() for k in COUNTS})

    cut, bins, forest, good = None, [], IsolationForest(trees, tree_rows), sample("quality = 1")
    if len(good) >= 2:
        box = np.concatenate([good, sample("quality <> 1")])
        forest.fit(good, box.min(0), box.max(0))
        rows = _scored(known.where(~seen), forest, ("quality",)).groupBy(F.floor(F.col("anomaly") * 500).alias("bin")).agg(F.sum(F.expr("int(quality = 1)")).alias("g"), F.sum(F.expr("int(quality <> 1)")).alias("b")).collect()  # at most 501 rows
        bins = [(r.bin / 500, r.g, r.b) for r in rows]
        cut = threshold_from(bins, max_false_reject)
    caught, wrong = shares(bins, cut)
    scored = _scored(counts, forest, carry) if forest.grown else counts.withColumn("anomaly", F.lit(0.0))
    fits = F.lit(True) if cut is None else F.floor(F.col("anomaly") * 500) / 500 < F.lit(cut)
    told = {"anomaly_cut": cut, "caught_share": caught, "false_share": wrong}
    scored = scored.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & fits)
    return scored.select("doc_id", *carry, *BASE, "base_failed", "anomaly", *(F.lit(v).cast("double").alias(k) for k, v in told.items()), "kept")
