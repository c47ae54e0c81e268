import subprocess
import sys

import numpy as np
import pyarrow as pa

from locusforge.llm import shared
from locusforge.llm import textcore as T


def test_steps_keep_rows_whole():
    batch = pa.record_batch([pa.array([b"a" * n for n in (0, 3, 10, 1, 0, 2)], pa.binary()), pa.array(range(6))], ["text", "i"]).slice(1)
    parts = list(shared.steps(batch, "text", 4))
    assert [r.column("i").to_pylist() for r, _, _ in parts] == [[1], [2], [3, 4, 5]]
    assert all(len(d) == o[-1] and o[0] == 0 for _, d, o in parts)


def test_hashes_don_t_depend_on_place_or_neighbours():
    words = [b"a", b"bb", b"x" * 200_000, b"a", "é".encode(), b"bb"]
    data = np.frombuffer(b" ".join(words), np.uint8)
    w = T.words(data, np.array([0, len(data)]), T.NOT_SPACE)
    h = T.span_hashes(data, w.start, w.end)
    assert h[0] == h[3] and h[1] == h[5] and len(set(h.tolist())) == 4
    for i, word in enumerate(words):
        assert T.span_hashes(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))[0] == h[i]


def test_materialized_tables_are_released(spark):
    made = shared.materialize(spark.range(3), "t")
    path = made.inputFiles()[0]
    assert made.count() == 3
    kept, shared._MADE[:] = shared._MADE[:-1], shared._MADE[-1:]
    shared.release(spark)
    shared._MADE[:] = kept
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def test_sieve_keeps_all_rows_and_tells_keys_apart(spark, monkeypatch):
    rows = spark.range(5000).selectExpr("id", "cast(id % 700 as string) as k", "'x' as lf_map", "1 as LF_BITS")
    some = spark.range(0, 700, 7).selectExpr("cast(id as string) as k")
    want = {i for i in range(5000) if i % 700 % 7}
    for bits in (shared.SIEVE_BITS, 1 << 17, 64):
        monkeypatch.setattr(shared, "SIEVE_BITS", bits)
        clear, others = shared.sieve(rows, some, ["k"])
        a, b = {r.id for r in clear.collect()}, {r.id for r in others.collect()}
        assert a <= want and not a & b and len(a | b) == 5000 and clear.columns == rows.columns
        assert bits < 1 << 20 or a == want
        out = shared.without(rows, some, ["k"])
        assert {r.id for r in out.collect()} == want and out.columns == rows.columns


def test_join_spread_deals_hot_keys_and_loses_none(spark, monkeypatch):
    monkeypatch.setattr(shared, "HOT_KEYS", 10)
    rows = shared.materialize(spark.range(3000).selectExpr("id", "if(id % 3 = 0, 'hot', cast(id % 50 as string)) as k"), "rows")
    table = spark.createDataFrame([("hot", 1), *((str(i), i) for i in range(0, 50, 2))], "k string, v int")
    inner = sorted((r.id, r.v) for r in shared.join_spread(rows, table, "k").collect())
    assert inner == sorted((i, 1 if i % 3 == 0 else i % 50) for i in range(3000) if i % 3 == 0 or i % 50 % 2 == 0)
    left = shared.join_spread(rows, table, "k", "left")
    assert left.count() == 3000 and left.where("v is null").count() == 3000 - len(inner)


def test_distinct_spans_by_keys_where_hashes_meet(monkeypatch):
    words = [b"a", b"bb", b"a", b"x" * 17, b"x" * 18, b"bb", b"x" * 17, b"12345678", b"123456789"]
    data = np.frombuffer(b"".join(words), np.uint8)
    edge = np.cumsum([0, *map(len, words)])
    for folded in (T._folded, lambda n, head, tail: np.zeros(len(n), T.U)):
        monkeypatch.setattr(T, "_folded", folded)
        first, which = T.distinct_spans(data, edge[:-1], edge[1:])
        assert [words[first[i]] for i in which] == words and len(first) == len(set(words))


def test_arrow_batches_are_about_a_step(spark):
    shared.prepare(spark)
    rows = spark.range(4000, numPartitions=1).selectExpr("repeat('abcdefgh', 512) as text")  # 16 MB

    def told(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.nbytes]), pa.array([b.num_rows])], ["size", "n"])

    got = rows.mapInArrow(told, "size long, n long").collect()
    assert sum(r.n for r in got) == 4000 and max(r.size for r in got) <= shared.STEP_BYTES


def test_workers_are_left_small():
    code = """
import gc, re, sys
import pyarrow as pa
from locusforge.llm import shared

def held():
    return sum(map(int, re.findall(r"Pss_Anon: +([0-9]+)", open("/proc/self/smaps_rollup").read()))) / 1024

def run(batches):
    kept = []
    for b in batches:
        kept += [bytearray(3000) for _ in range(40_000)]  # 120 MB in parts that aren't mapped by themselves
        yield b
        left.append(bytearray(3000))  # stays above them

left = []
batch = pa.record_batch([pa.array([1])], ["a"])
before = held()
assert [b.num_rows for b in shared.lean(run)(iter([batch]))] == [1] and run.__name__ == shared.lean(run).__name__
print(held() - before)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=120)
    assert float(done.stdout) < 40
