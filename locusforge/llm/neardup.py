"""Near-duplicates: MinHash signatures in an LSH forest, links confirmed on whole shingle sets.

Texts with equal sets are one class. Each tree of the forest orders the classes by its own labels of DEPTH min-hashes;
neighbours in that order share the longest prefixes. A task has whole groups, but for the few that are hot. Groups that share BASE_DEPTH values are searched whole where they
are small; a denser region is searched at the least depth at which it is small, and its neighbours in order are
candidates besides. Links of next neighbours are confirmed and joined into components first; the second pass takes up
candidates between components. What dense regions may still hold is found exactly: all texts of a dense group with more
than one component are joined on the rare shingles by which two sets that are similar enough have to meet (prefixes in
order of frequency). Two texts of similarity s share a prefix of BASE_DEPTH in some tree with probability
1 - (1 - s^3)^TREES: all but 2 in 100,000 at 0.75.

Edge cases: null texts and texts without words have an empty set and link with nothing; with fewer than five words the
whole sequence is the one shingle; repeated rows share their class; rows with a null id take the least id of their
class, and a class without any id is linked with nothing; an id that repeats links the texts it names; ids are integers, others
raise ValueError; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from . import textcore as T
from .components import components

SHINGLE = 5
TREES = 20
DEPTH = 8
BASE_DEPTH = 3
SMALL = 48  # a group of so many is searched whole
NEAR = 4  # neighbours in order that a row of a dense region is held against besides
SAMPLE = 8192  # texts that tell which shingles of dense regions are common; of the exact join it sets the cost alone
COMMON = 500_000  # such shingles
MEET = 1 << 22  # pairs that are held at once
LIST = 1024  # nodes that one row of candidates lists, about
HOUSE = 64  # texts that ask at one place
_R = np.random.default_rng(77)
_A = (_R.integers(0, 1 << 31, TREES * DEPTH, dtype=np.int64) * 2 + 1).astype(np.uint32)
_B = _R.integers(0, 1 << 32, TREES * DEPTH, dtype=np.int64).astype(np.uint32)
_TAIL = np.random.default_rng(78).integers(1, 1 << 62, SHINGLE, dtype=np.int64).astype(T.U)


def shingle_sets(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    lowered = T.LOWERED[data]
    w = T.words(lowered, off, T.NOT_SPACE)
    h = T.span_hashes(lowered, w.start, w.end)
    first, window = T.windows(h, w.doc, SHINGLE)
    cut = np.searchsorted(first, w.ptr)
    out = []
    for i in range(len(off) - 1):
        n = int(w.ptr[i + 1] - w.ptr[i])
        if n >= SHINGLE:
            part = np.sort(window[cut[i] : cut[i + 1]])
            out.append(part[np.concatenate([[True], part[1:] != part[:-1]])])
        elif n:
            whole = (h[w.ptr[i] : w.ptr[i + 1]] * (_TAIL[:n] * T.U(2) + T.U(1))).sum(dtype=T.U)
            out.append(T.mix(np.array([whole + T.U(n)], T.U)))
        else:
            out.append(np.zeros(0, T.U))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """TREES x DEPTH min-hashes of a set that isn't empty."""
    high = (shingles >> T.U(32)).astype(np.uint32)
    least = np.full(len(_A), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(high), 1024):
        least = np.minimum(least, (high[i : i + 1024, None] * _A + _B).min(axis=0))
    return least


def _sketch(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of `carry`, size and 128-bit digest of the set, label (big-endian min-hashes; null for an empty set)."""
    shared.prepare(docs.sparkSession)
    salt = T.U(0xD6E8FEB86659FD93)

    @shared.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, off in shared.steps(batch, "text"):
                sets = shingle_sets(data, off)
                a = np.array([T.mix(s).sum(dtype=T.U) for s in sets], T.U).view(np.int64)
                b = np.array([T.mix(s ^ salt).sum(dtype=T.U) for s in sets], T.U).view(np.int64)
                labels = [signature(s).astype(">u4").tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([*(rows.column(k) for k in ("doc_id", *carry)), pa.array([len(s) for s in sets], pa.int64()), pa.array(a), pa.array(b), pa.array(labels, pa.binary())], ["doc_id", *carry, "n_shingles", "da", "db", "label"])

    fields = "".join(f"{k} {docs.schema[k].dataType.simpleString()}, " for k in carry)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *carry, shared.text_bytes()).mapInArrow(run, f"doc_id long, {fields}n_shingles long, da long, db long, label binary")


def candidates(tree: np.ndarray, label: np.ndarray, node: np.ndarray, size: np.ndarray, group: np.ndarray | None, percent: int, near: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that are in order of (tree, label).

    Without group: next neighbours. group: components of the rows; then all pairs across components in groups that are
    small, and up to `near` neighbours in dense regions.
    """
    n = len(node)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    same = np.concatenate([np.zeros((1, DEPTH), bool), label[1:] == label[:-1]]) & np.concatenate([[False], tree[1:] == tree[:-1]])[:, None]
    common = np.cumprod(same, axis=1).sum(axis=1)  # values shared with the row before
    at = np.arange(n)
    start = np.zeros((DEPTH + 1, n), np.int64)
    small = np.full(n, DEPTH + 1)
    for d in range(DEPTH, BASE_DEPTH - 1, -1):
        new = common < d
        start[d] = np.maximum.accumulate(np.where(new, at, 0))
        number = np.cumsum(new) - 1
        small = np.where(np.bincount(number)[number] <= SMALL, d, small)
    if group is None:
        reach, near = np.zeros(n, np.int64), 1
    else:
        reach = np.where(small <= DEPTH, at - start[np.minimum(small, DEPTH), at], 0)
    reach = np.maximum(reach, np.minimum(near, at - start[BASE_DEPTH]))
    out_u, out_v = [], []
    o, live = 1, np.flatnonzero(reach >= 1)
    while len(live):
        i, j = live, live - o
        ok = (size[i] * percent <= size[j] * 100) & (size[j] * percent <= size[i] * 100) & (node[i] != node[j])
        if group is not None:
            ok &= group[i] != group[j]
        out_u.append(node[i][ok])
        out_v.append(node[j][ok])
        o += 1
        live = live[reach[live] >= o]
    return np.concatenate([np.zeros(0, np.int64), *out_u]), np.concatenate([np.zeros(0, np.int64), *out_v])


def lists(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(asking node, part, start of its list, asked nodes): of each pair the node with more partners asks, in parts of some LIST."""
    pair = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], axis=1), axis=0)
    names, which = np.unique(pair, return_inverse=True)
    count = np.bincount(which.ravel(), minlength=len(names))[which.reshape(pair.shape)]
    first = count[:, 0] >= count[:, 1]
    asks, asked = np.where(first, pair[:, 0], pair[:, 1]), np.where(first, pair[:, 1], pair[:, 0])
    most = np.where(first, count[:, 0], count[:, 1])
    parts = 1 << np.ceil(np.log2(np.maximum(1, most / LIST))).astype(np.int64)
    part = (T.mix(asked.astype(T.U)) >> T.U(33)).astype(np.int64) % parts
    order = np.lexsort((asked, part, asks))
    asks, asked, part = asks[order], asked[order], part[order]
    start = np.flatnonzero(np.concatenate([[True], (asks[1:] != asks[:-1]) | (part[1:] != part[:-1])])) if len(asks) else np.zeros(0, np.int64)
    return asks[start], part[start], np.append(start, len(asks)), asked


def _trees(classes: DataFrame, *more: str) -> DataFrame:
    """tree, prefix (BASE_DEPTH values), node and the columns of `more`, once a tree."""
    return classes.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1)))).select("tree", F.expr(f"substring(label, tree * {4 * DEPTH} + 1, {4 * BASE_DEPTH})").alias("prefix"), "node", *more)


def _hot(classes: DataFrame) -> DataFrame:
    """(tree, prefix) of groups with more rows than a HOT_KEYS-th of all; there are HOT_KEYS at most."""
    keyed = _trees(classes)
    cap = max(SMALL, classes.count() * TREES // shared.HOT_KEYS)
    return shared.materialize(keyed.groupBy("tree", "prefix").count().where(F.col("count") > cap).select("tree", "prefix", F.lit(True).alias("hot")), "hot")


def _pairs(classes: DataFrame, hot: DataFrame, percent: int, groups: DataFrame | None = None, near: int = NEAR) -> DataFrame:
    """asks, part, asked (array): candidates of the forest. classes: node, n_shingles, label."""
    rows = classes
    grouped = groups is not None
    if grouped:
        rows = rows.join(groups.select("node", "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    more = ["component"] * grouped
    rows = _trees(rows, "n_shingles", *more, "label").withColumn("label", F.expr(f"substring(label, tree * {4 * DEPTH} + 1, {4 * DEPTH})"))
    rows = rows.join(F.broadcast(hot), ["tree", "prefix"], "left")
    place = F.when(F.col("hot"), F.concat("label", F.unhex(F.lpad(F.hex("node"), 16, "0")))).otherwise(F.col("prefix"))  # only hot groups are cut between tasks
    ordered = rows.withColumn("place", place).repartitionByRange("tree", "place").sortWithinPartitions("tree", "label", "node").select("tree", "label", "node", "n_shingles", *more)

    @shared.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))  # one range of narrow rows, sized by the shuffle
        if not table.num_rows:
            return
        col = lambda k: table.column(k).combine_chunks().to_numpy(zero_copy_only=False)
        raw, _ = shared.buffers(table.column("label"))
        label = raw.view(">u4").reshape(-1, DEPTH).astype(np.uint32)
        u, v = candidates(col("tree"), label, col("node"), col("n_shingles"), col("component") if grouped else None, percent, near)
        yield from _listed(u, v)

    return _gathered(ordered.mapInArrow(run, "asks long, part long, asked array<bigint>"))


def _listed(u: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
    asks, part, edge, asked = lists(u, v)
    for i in range(0, len(asks), 5000):
        j = min(len(asks), i + 5000)
        items = pa.ListArray.from_arrays(pa.array((edge[i : j + 1] - edge[i]).astype(np.int32)), pa.array(asked[edge[i] : edge[j]]))
        yield pa.RecordBatch.from_arrays([pa.array(asks[i:j]), pa.array(part[i:j]), items], ["asks", "part", "asked"])


def _gathered(found: DataFrame) -> DataFrame:
    return shared.materialize(found.groupBy("asks", "part").agg(F.array_distinct(F.flatten(F.collect_list("asked"))).alias("asked")), "asked")


def _dense(classes: DataFrame, groups: DataFrame) -> DataFrame:
    """(node, component) of all in a group of BASE_DEPTH values that is more than SMALL and holds several components."""
    rows = classes.join(groups.select("node", "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    keyed = _trees(rows, "component")
    mixed = keyed.groupBy("tree", "prefix").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high"))
    mixed = shared.materialize(mixed.where((F.col("n") > SMALL) & (F.col("low") < F.col("high"))).select("tree", "prefix"), "mixed")
    return shared.materialize(keyed.join(mixed, ["tree", "prefix"], "left_semi").select("node", "component").distinct(), "dense")


def prefixes(sets: list[np.ndarray], common: np.ndarray, count: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, size, place, shingle) of the rarest shingles of each set, one of which each similar set has among its own rarest."""
    size = np.array([len(s) for s in sets], np.int64)
    text, all_of = np.repeat(np.arange(len(sets)), size), np.concatenate([np.zeros(0, T.U), *sets])
    rank = np.zeros(len(all_of), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, all_of), len(common) - 1)
        rank = np.where(common[at] == all_of, count[at], 0)
    all_of = all_of[np.lexsort((all_of, rank, text))]
    place = np.arange(len(all_of)) - (np.cumsum(size) - size)[text]
    n = size[text]
    keep = place <= n + (-percent * n // 100)
    return text[keep], n[keep], place[keep], all_of[keep]


def meetings(token: np.ndarray, component: np.ndarray, node: np.ndarray, n: np.ndarray, place: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs across components with a shingle in common that leaves both enough; rows are in order of (token, component).

    The smaller set of a similar pair holds the first of their common shingles among fewer places, so those rows ask.
    """
    new = np.concatenate([[True], token[1:] != token[:-1]])
    part = new | np.concatenate([[True], component[1:] != component[:-1]])
    edge, cut = np.append(np.flatnonzero(new), len(token)), np.append(np.flatnonzero(part), len(token))
    g, c = np.cumsum(new) - 1, np.cumsum(part) - 1
    own = cut[c + 1] - cut[c]
    others = edge[g + 1] - edge[g] - own
    asks = np.flatnonzero((others > 0) & (place <= n + (-2 * percent * n // (100 + percent))))
    ends = np.cumsum(others[asks])
    at = 0
    while at < len(asks):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - others[asks[at]] + MEET, "right")))
        i = np.repeat(asks[at:to], others[asks[at:to]])
        j = np.arange(len(i)) - np.repeat(ends[at:to] - others[asks[at:to]] - (ends[at] - others[asks[at]]), others[asks[at:to]]) + edge[g[i]]
        j += np.where(j >= cut[c[i]], own[i], 0)
        ok = (n[i] <= n[j]) & (n[j] * percent <= n[i] * 100) & (np.minimum(n[i] - place[i], n[j] - place[j]) >= -(-percent * (n[i] + n[j]) // (100 + percent)))
        yield node[i[ok]], node[j[ok]]
        at = to


def _rare_pairs(docs: DataFrame, dense: DataFrame, percent: int) -> DataFrame:
    """asks, part, asked (array): every pair across components of `dense` that may be similar enough."""
    spark = docs.sparkSession

    def texts(nodes: DataFrame) -> DataFrame:
        return _texts(docs, nodes).join(nodes, "node")

    @shared.lean
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, off in shared.steps(batch, "text"):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shingle_sets(data, off)).view(np.int64))], ["token"])

    some = dense.orderBy(F.xxhash64("node"), "node").limit(SAMPLE)
    known = texts(F.broadcast(some)).mapInArrow(spread, "token long").groupBy("token").count().where("count > 1").orderBy(F.desc("count"), "token").limit(COMMON).toPandas()
    common, order = np.unique(known["token"].to_numpy(np.int64).view(T.U), return_index=True)
    held = spark.sparkContext.broadcast((common, known["count"].to_numpy(np.int64)[order]))
    names = ["token", "component", "node", "n", "place"]

    @shared.lean
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, off in shared.steps(batch, "text"):
                text, n, place, token = prefixes(shingle_sets(data, off), *held.value, percent)
                at = pa.array(text)
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), rows.column("component").take(at), rows.column("node").take(at), pa.array(n.astype(np.int32)), pa.array(place.astype(np.int32))], names)

    rare = texts(dense).mapInArrow(make, "token long, component long, node long, n int, place int")
    together = rare.repartition("token").sortWithinPartitions("token", "component")

    @shared.lean
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us: list[np.ndarray] = []
        vs: list[np.ndarray] = []

        def work(table: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
            token, component, node, n, place = (table.column(k).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64) for k in names)
            for u, v in meetings(token, component, node, n, place, percent):
                us.append(u)
                vs.append(v)
                if sum(map(len, us)) >= MEET:
                    yield from _listed(np.concatenate(us), np.concatenate(vs))
                    us.clear(), vs.clear()
            if last and us:
                yield from _listed(np.concatenate(us), np.concatenate(vs))

        waiting, rows, enough = [], 0, 1 << 19
        for batch in batches:
            waiting.append(batch)
            rows += batch.num_rows
            if rows < enough:
                continue
            table = pa.Table.from_batches(waiting)
            token = table.column("token").combine_chunks().to_numpy(zero_copy_only=False)
            cut = int(np.searchsorted(token, token[-1]))  # the last shingle may go on
            yield from work(table.slice(0, cut), False)
            waiting, rows = table.slice(cut).to_batches(), len(token) - cut
            enough = max(1 << 19, 2 * rows)
        if rows:
            yield from work(pa.Table.from_batches(waiting), True)

    return _gathered(together.mapInArrow(meet, "asks long, part long, asked array<bigint>"))


def _texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and text of the documents that are among the nodes, and of a few others; texts don't move."""
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("node"), shared.text_bytes())
    return shared.sieve(rows, nodes, ["node"])[1]


def _confirmed(docs: DataFrame, lists: DataFrame, percent: int) -> DataFrame:
    """(u, v) of the candidates whose full sets are similar enough.

    Those that ask and share their least partner live together, in blocks of some HOUSE and by part of their lists; a set
    travels to each block where it is asked for, meets the sets held there, and is let go. So a few texts that each have
    thousands of partners cost each partner a few trips, and a task holds a block at a time.
    """
    least = lists.groupBy("asks").agg(F.min(F.array_min("asked")).alias("least"))
    blocks = least.groupBy("least").agg(F.ceil(F.count("*") / HOUSE).alias("blocks"))
    housed = least.join(blocks, "least").select("asks", "least", F.pmod(F.xxhash64("asks"), "blocks").alias("block"))
    homes = shared.materialize(lists.join(housed, "asks").select("asks", "asked", F.xxhash64("least", "block", "part").alias("host")), "homes")
    trips = homes.groupBy("host").agg(F.array_distinct(F.flatten(F.collect_list("asked"))).alias("asked")).select("host", F.explode("asked").alias("node"))
    routes = shared.materialize(homes.select(F.col("asks").alias("node"), "host", "asked").union(trips.select("node", "host", F.lit(None).cast("array<bigint>"))), "routes")
    texts = _texts(docs, routes)  # the join with routes below drops what the filter lets through

    @shared.lean
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, off in shared.steps(batch, "text"):
                yield pa.RecordBatch.from_arrays([rows.column("node"), pa.array([s.tobytes() for s in shingle_sets(data, off)], pa.binary())], ["node", "shingles"])

    sent = texts.mapInArrow(make, "node long, shingles binary").join(routes, "node").select("host", F.col("asked").isNull().alias("travels"), "node", "asked", "shingles")
    together = sent.repartition("host").sortWithinPartitions("host", "travels")

    @shared.lean
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        sought: dict[int, list[int]] = {}
        host = None
        for batch in batches:
            out_u, out_v = [], []
            shingles, asked = batch.column("shingles"), batch.column("asked")
            for i, (h, travels, node) in enumerate(zip(*(batch.column(k).to_pylist() for k in ("host", "travels", "node")), strict=True)):
                if h != host:
                    host, held, sought = h, {}, {}
                own = np.frombuffer(shingles[i].as_buffer(), T.U)
                if not travels:
                    if node not in held:
                        for other in asked[i].as_py():
                            sought.setdefault(other, []).append(node)
                    held.setdefault(node, []).append(own.copy())
                    continue
                for other in sought.get(node, ()):
                    if similar(held[other], [own], percent):
                        out_u.append(node)
                        out_v.append(other)
            yield pa.RecordBatch.from_arrays([pa.array(out_u, pa.int64()), pa.array(out_v, pa.int64())], ["u", "v"])

    return shared.materialize(together.mapInArrow(meet, "u long, v long"), "links")


def similar(xs: list[np.ndarray], ys: list[np.ndarray], percent: int) -> bool:
    """Whether any two sets reach the similarity; an id that repeats with other texts has several."""
    for x in xs:
        for y in ys:
            if min(len(x), len(y)) * 100 < percent * max(len(x), len(y)):
                continue
            both = np.concatenate([x, y])
            both.sort()
            inter = int((both[1:] == both[:-1]).sum())
            if inter and 100 * inter >= percent * (len(x) + len(y) - inter):
                return True
    return False


def _stars(joined: DataFrame) -> DataFrame:
    return joined.select(F.col("node").alias("u"), F.col("component").alias("v"))


def near_duplicates(docs: DataFrame, percent: int = 75, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of `carry`, n_shingles, component_id, kept for each row."""
    if docs.schema["doc_id"].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise ValueError("doc_id has to be an integer")
    sketches = shared.materialize(_sketch(docs, carry), "sketches")
    digest = ["da", "db", "n_shingles"]
    # equal sets have equal labels
    classes = shared.materialize(sketches.where("n_shingles > 0").groupBy(*digest).agg(F.min("doc_id").alias("node"), F.min("label").alias("label")), "classes")
    nodes = classes.where("node is not null").select("node", "n_shingles", "label")
    hot = _hot(nodes)
    links = _confirmed(docs, _pairs(nodes, hot, percent), percent)
    joined = shared.materialize(components(links), "joined")
    links = _confirmed(docs, _pairs(nodes, hot, percent, joined), percent)
    joined = shared.materialize(components(_stars(joined).union(links)), "joined")
    dense = _dense(nodes, joined)
    if dense.limit(1).count():
        links = _confirmed(docs, _rare_pairs(docs, dense, percent), percent)
        joined = shared.materialize(components(_stars(joined).union(links)), "joined")
    named = classes.join(joined, "node", "left").select(*digest, F.coalesce("component", "node").alias("root"))
    out = sketches.select("doc_id", *carry, *digest).join(named, digest, "left")
    component = F.when(F.col("n_shingles") > 0, F.col("root")).otherwise(F.col("doc_id"))
    return out.select("doc_id", *carry, "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))).withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType)).withColumn("component_id", F.col("component_id").cast(docs.schema["doc_id"].dataType))
