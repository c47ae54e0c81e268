import re
from collections import Counter

import numpy as np

from locusforge.llm import entry, quality
from tests.llm import brute

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = Counter(windows)
    hit = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


TEXTS = [None, "", " \n\t", "a", "é ü#|", "a b c d e f g h a b c d e f g h", "x " * 40, "l1 é\nl1 é\n\nl1 é \nl2", "a\x0bb\x0cc\x85d\xa0e f", " ".join(f"w{i % 11}" for i in range(300)), "w" * 300_000, " ".join(map(str, range(30_000)))]


def test_statistics_equal_plain_counts(spark):
    got = {r.doc_id: r for r in quality.rule_statistics(brute.docs(spark, TEXTS)).collect()}
    for i, text in enumerate(TEXTS):
        assert tuple(got[i][k] for k in quality.BASE) == plain(text), text and text[:50]


def test_alike_words_make_no_repeats():
    one, two = brute.thue_morse(1024)
    rest = " ".join("abcdefg")
    data = np.frombuffer(f"{rest} {one} {rest} {two}".encode(), np.uint8)
    assert quality.statistics(data, np.array([0, len(data)]))["n_repeat_words"].tolist() == [0]


def test_query_on_small_tables(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = entry.op1_quality_rules(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = plain(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.kept and r.base_failed)


def test_forest_finds_labelled_junk_and_leaves_clean_texts(spark):
    sf = "/root/testdata/sf0.1"
    out = quality.quality_rules(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    rows = out.where("not base_failed").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in rows}
    assert n[0, False] / (n[0, False] + n.get((0, True), 0)) > 0.9
    assert n.get((1, False), 0) / (n[1, True] + n.get((1, False), 0)) <= 0.006


def test_anomalies_score_above_the_rest_and_runs_agree():
    rng = np.random.default_rng(1)
    x = np.abs(rng.normal(0, 0.05, (500, 4)))
    forest = quality.IsolationForest(trees=64).fit(x, np.zeros(4), np.ones(4))
    same = quality.IsolationForest(trees=64).fit(x, np.zeros(4), np.ones(4))
    odd = np.array([[0.9, 0, 0, 0], [0.5, 0.5, 0.5, 0.5]])
    assert forest.score(odd).min() > np.quantile(forest.score(x), 0.99)
    assert (forest.score(x) == same.score(x)).all()


def walk(tree, x):
    """One row down one tree, one node at a time."""
    feature, cut, child, depth = tree
    at = 0
    while feature[at] >= 0:
        at = child[at][1 if x[feature[at]] >= cut[at] else 0]
    return depth[at]


def test_scores_equal_a_plain_walk_down_fixed_trees():
    tree = (np.array([0, -1, 1, -1, -1]), np.array([0.5, 0, 0.25, 0, 0]), np.array([[1, 2], [1, 1], [3, 4], [3, 3], [4, 4]]), np.array([0, 1.0, 0, 2.0, 3.5]))
    forest = quality.IsolationForest(psi=4, grown=[tree])
    c4 = 2 * (np.log(3) + 0.5772156649015329) - 2 * 3 / 4
    x = np.array([[0.4, 0.9], [0.5, 0.2], [0.9, 0.25]])
    assert np.allclose(forest.score(x), [2 ** (-d / c4) for d in (1.0, 2.0, 3.5)], atol=1e-12)
    rng = np.random.default_rng(3)
    x = rng.random((300, 5))
    forest = quality.IsolationForest(trees=9, rows=64).fit(x[:200], np.zeros(5), np.ones(5))
    c = 2 * (np.log(63) + 0.5772156649015329) - 2 * 63 / 64
    assert np.allclose(forest.score(x), [2 ** (-np.mean([walk(t, row) for t in forest.grown]) / c) for row in x], atol=1e-12)


def test_verdicts_equal_a_plain_application_of_the_rules(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = entry.op1_quality_rules(spark, sf).collect()
    cut = rows[0].anomaly_cut
    assert cut is not None and all((r.anomaly_cut, r.caught_share, r.false_share) == (cut, rows[0].caught_share, rows[0].false_share) for r in rows)
    unseen = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").where("xxhash64(doc_id) % 2 <> 0 and quality is not null").collect()}
    held = [(unseen[r.doc_id], r.kept) for r in rows if r.doc_id in unseen and not r.base_failed]
    assert rows[0].caught_share == sum(q == 0 and not k for q, k in held) / sum(q == 0 for q, _ in held) > 0.3
    assert rows[0].false_share == sum(q == 1 and not k for q, k in held) / sum(q == 1 for q, _ in held) <= 0.005
    for r in rows:
        n, _, _, _, repeats = plain(docs[r.doc_id])
        assert r.kept == (n >= 20 and 100 * repeats <= 30 * n and np.floor(r.anomaly * 500) / 500 < cut)


def test_threshold_bounds_false_rejects():
    bins = [(0.9, 0, 10), (0.8, 1, 5), (0.7, 50, 5), (0.3, 949, 0)]
    assert quality.threshold_from(bins, 0.005) == 0.8
    assert quality.threshold_from(bins, 0.0) == 0.9
    assert quality.threshold_from([], 0.005) is None


def test_without_labels_the_base_rule_decides(spark, sf_dir):
    docs = brute.docs(spark, ["word " * 5, " ".join(map(str, range(40))), None])
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    for some in (labels.limit(0), labels.selectExpr("doc_id", "cast(null as int) as quality", "toxic")):
        got = {r.doc_id: r.kept for r in quality.quality_rules(docs, some).collect()}
        assert got == {0: False, 1: True, 2: False}
    assert quality.quality_rules(docs.limit(0), labels).count() == 0
    extra = docs.selectExpr("doc_id", "text", "1 as n_words", "'x' as quality")
    assert quality.quality_rules(extra.union(extra), labels).count() == 6
