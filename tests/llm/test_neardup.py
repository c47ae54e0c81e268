import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from locusforge.llm import components, entry, neardup, shared
from tests.llm import brute

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def plain(texts):
    """{id: (size, component)} by comparing all that share a shingle."""
    sets, parent = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    by = defaultdict(list)
    for i in sorted(sets):
        for j, both in Counter(j for s in sets[i] for j in by[s]).items():
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        for s in sets[i]:
            by[s].append(i)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def equal(spark, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(brute.docs(spark, texts)).collect()}
    assert got == plain(dict(enumerate(texts)))
    return got


def near_copies(n, words, changes, seed):
    r = random.Random(seed)
    base = [f"w{r.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(r.randrange(changes + 1)):
            copy[r.randrange(words)] = f"x{r.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


def test_query_equals_all_pairs(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = entry.op9_near_duplicates(spark, sf).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == plain(docs)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_large_groups_short_texts_and_shared_passages(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [None, "", " ", "a b", "A  b", "a b c d e", "a b c d e", "b a", *near_copies(250, 120, 12, 1), *near_copies(40, 12, 2, 2), *near_copies(3, 4000, 40, 3)]
    texts += [f"{passage} " + " ".join(f"u{i}-{j}" for j in range(8 + i % 50)) for i in range(150)]
    texts += ["same text of six words here"] * 60
    got = equal(spark, texts)
    assert got[0] == (0, 0) and got[3][1] == got[4][1] == 3 and got[7][1] == 7


def test_pairs_in_a_region_dense_at_full_depth(spark):
    r, passage, texts, want = random.Random(9), " ".join(f"p{i}" for i in range(122)), [], {}
    for i in range(1500):
        own = [f"u{i}-{j}" for j in range(23)]
        texts.append(f"{passage} " + " ".join(own))
        want[len(texts) - 1] = len(texts) - 1
        if i < 400:  # 121 of 161 shingles stay; other texts of the region share 118 of 164
            texts.append(f"{passage} " + " ".join(own[:3] + [f"n{i}-{j}" for j in range(20)]))
            want[len(texts) - 1] = len(texts) - 2
    name = list(range(len(texts)))
    r.shuffle(name)  # ids say nothing of the pairs
    docs = spark.createDataFrame([(name[i], t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in neardup.near_duplicates(docs).collect()}
    pairs = {i: min(name[i], name[i + 1]) for i in range(0, 800, 2)}
    assert got == {name[i]: pairs.get(c, name[i]) for i, c in want.items()}


def test_rare_shingles_meet_in_every_similar_pair(monkeypatch):
    monkeypatch.setattr(neardup, "MEET", 5)
    r = np.random.default_rng(4)
    for percent in (60, 75, 90):
        sets = [np.unique(r.choice(40, r.integers(1, 40)).astype(neardup.T.U)) for _ in range(120)] + [np.arange(30, dtype=neardup.T.U) + neardup.T.U(i // 2) for i in range(12)]
        common = np.arange(0, 40, 3).astype(neardup.T.U)
        text, n, place, token = neardup.prefixes(sets, common, common.astype(np.int64) + 2, percent)
        order = np.lexsort((text % 50, token))
        found = {frozenset(p) for u, v in neardup.meetings(token[order], text[order] % 50, text[order], n[order], place[order], percent) for p in zip(u.tolist(), v.tolist(), strict=True)}
        want = {frozenset((i, j)) for i in range(len(sets)) for j in range(i) if i % 50 != j % 50 and neardup.similar([sets[i]], [sets[j]], percent)}
        assert want and want <= found


def test_a_pair_at_the_threshold(spark):
    base = [f"t{i}" for i in range(39)]  # 35 shingles, of which a new end keeps 30 of 40
    assert equal(spark, [" ".join(base), " ".join([*base[:34], *[f"n{i}" for i in range(5)]])])[1] == (35, 0)
    assert equal(spark, [" ".join(base), " ".join([*base[:33], *[f"n{i}" for i in range(6)]])])[1] == (35, 1)


def test_alike_words_and_text_ids(spark):
    one, two = brute.thue_morse(1024)
    assert {i: c for i, (_, c) in equal(spark, [one, two, f"a b {one}", f"a b {two}", one]).items()} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 0}
    with pytest.raises(ValueError, match="integer"):
        neardup.near_duplicates(spark.createDataFrame([("x", "a b")], "doc_id string, text string"))


def test_repeated_ids_keep_the_links_of_each_text(spark):
    a, b = near_copies(1, 60, 0, 5)[0], near_copies(1, 60, 0, 6)[0]
    d = spark.createDataFrame([(5, a), (5, b), (6, a + " tail"), (7, b + " tail")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in neardup.near_duplicates(d).collect()} == {(5, 5), (6, 5), (7, 5)}


def test_full_filter_and_ranges_cut_at_hot_groups_alone(spark, monkeypatch):
    monkeypatch.setattr(shared, "SIEVE_BITS", 4)
    monkeypatch.setattr(shared, "HOT_KEYS", 2)
    equal(spark, [*near_copies(80, 40, 4, 3), *near_copies(30, 12, 2, 4), *near_copies(2, 30, 2, 5)])


def test_null_ids_repeats_and_empty_tables(spark):
    d = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (None, "z"), (9, None)], "doc_id long, text string").withColumn("component", shared.F.lit("clash"))
    got = sorted(map(tuple, neardup.near_duplicates(d).collect()), key=str)
    assert got == sorted([(None, 2, 4, False), (4, 2, 4, True), (4, 2, 4, True), (None, 1, None, True), (9, 0, 9, True)], key=str)
    assert neardup.near_duplicates(d.limit(0)).count() == 0


def test_sets_don_t_depend_on_batches():
    texts = [b"a b c d e f g", b"", b"x y", b"a B c d e f g"]
    off = np.cumsum([0, *map(len, texts)])
    together = neardup.shingle_sets(np.frombuffer(b"".join(texts), np.uint8), off)
    for t, s in zip(texts, together, strict=True):
        assert (neardup.shingle_sets(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] == s).all()
    assert (together[0] == together[3]).all() and [len(s) for s in together] == [3, 0, 1, 3]


def test_components_of_chains_stars_and_rings(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 60)] + [(2000 + i, 2000 + (i + 1) % 30) for i in range(30)] + [(5, 5)]
    r.shuffle(edges)
    got = {x.node: x.component for x in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(60)}, **{2000 + i: 2000 for i in range(30)}}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0
