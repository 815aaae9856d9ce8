"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints within ``k`` bits of each other are linked, and every document gets the
smallest id of its linked group. Steps:

1. a 64-bit SimHash per document, computed where the text is (no shuffle);
2. equal fingerprints become one node, by a partial aggregate, so a third of all rows being
   one text costs one row per map task;
3. the 64 bits are grouped into ``m`` partitions, correlated bits together, so the partitions
   are as independent of each other as they can be;
4. by the generalised pigeonhole principle two fingerprints within ``k`` bits agree in some
   partition ``i`` up to ``t_i`` bits whenever the thresholds sum to ``k - m + 1`` (-1 leaves a
   partition out). Dynamic programming picks the thresholds with the fewest estimated
   candidates, from the value counts of all fingerprints;
5. each node is filed under its partition values and probes the values within the threshold.
   Values shared by many nodes are cut into blocks; each pair of blocks is one unit of work,
   so no value needs one task, and no pair is skipped;
6. a unit verifies its pairs on all 64 bits in vectors and emits only links that join
   different parts (at most one per node), never all pairs;
7. connected components over the links by alternating star contractions.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quayside.llm.common import documents, map_texts
from quayside.session import stage

BITS = 64


# -- fingerprints ----------------------------------------------------------------------

def fingerprint(text: bytes, width: int = 3) -> int:
    """SimHash over the XXH64 (seed 42) of all word shingles; 0 without words."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # bytes: lower-cases A-Z, splits at the six ASCII blanks
    if not words:
        return 0
    if len(words) <= width:
        return xxh64_intdigest(b" ".join(words), 42)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-width] + 1]).tolist()
    h = np.fromiter([xxh64_intdigest(line[s:e], 42) for s, e in zip(starts, ends[width - 1:].tolist())], np.uint64, len(starts))
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i:i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h)).view(">u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The key and ``fp``, the fingerprint as a signed long. Null texts have no words."""
    def fn(texts: list[str]) -> dict[str, list]:
        out = [fingerprint(t.encode("utf-8"), width) for t in texts]
        return {"fp": [_long(x) for x in out]}

    return map_texts(docs, fn, {"fp": "bigint"}, key, text_col)


# -- partitions and thresholds ---------------------------------------------------------

def partition_count(n: float, k: int) -> int:
    """Number of partitions with the least expected work for ``n`` spread-out fingerprints:
    probes plus candidate pairs if the values were even. Wider partitions (fewer of them)
    suit more fingerprints."""
    def work(m: int) -> float:
        width, rest = BITS / m, k - m + 1
        if rest < 0:
            probes = m + rest
        else:
            base, more = divmod(rest, m)
            ball = lambda e: sum(_choose(width, i) for i in range(e + 1))
            probes = more * ball(base + 1) + (m - more) * ball(base)
        return n * probes + n * n * probes / 2.0 ** width
    return min(range(max(1, min(2, k)), k + 2), key=work)


def _choose(n: float, i: int) -> float:
    out = 1.0
    for j in range(i):
        out *= (n - j) / (j + 1)
    return out


def bit_moments(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and the 64 x 64 matrix of how often two bits are both one,
    over all rows: one partial matrix per task, summed in Spark."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS), np.int64), 0
        for b in batches:
            v = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(v), 8192):
                x = ((v[i:i + 8192, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float32)
                total += (x.T @ x).astype(np.int64)
                n += len(x)
        i, j = np.triu_indices(BITS)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(i, -1), pa.int32()), pa.array(np.append(j, -1), pa.int32()),
                                          pa.array(np.append(total[i, j], n), pa.int64())], ["i", "j", "n"])

    out = np.zeros((BITS, BITS), np.int64)
    n = 0
    for r in fps.select("fp").mapInArrow(partial, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        if r.i < 0:
            n = r.n
        else:
            out[r.i, r.j] = out[r.j, r.i] = r.n
    return n, out


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """``m`` groups of (nearly) equal size with correlated bits in the same group: each group
    starts at the most correlated free bit and takes the bits closest to it."""
    p = np.diag(both) / max(n, 1)
    var = np.maximum(p * (1 - p), 1e-9)
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.sqrt(np.outer(var, var))
    free, groups = set(range(BITS)), []
    for g in range(m):
        size = BITS // m + (g < BITS % m)
        rest = sorted(free)
        group = [max(rest, key=lambda b: (corr[b, [r for r in rest if r != b]].sum() if len(rest) > 1 else 0, -b))]
        while len(group) < size:
            group.append(max((b for b in rest if b not in group), key=lambda b: (corr[b, group].mean(), -b)))
        free -= set(group)
        groups.append(sorted(group))
    return groups


def allocate(cost: list[list[float]], total: int) -> list[int]:
    """Thresholds t_i (from -1) with the given sum and the least summed cost, by dynamic
    programming over the partitions; ``cost[i][t + 1]`` is partition i's at threshold t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for c in cost:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for s, (w, ts) in best.items():
            for e, x in enumerate(c):
                if (got := nxt.get(s + e - 1)) is None or w + x < got[0]:
                    nxt[s + e - 1] = (w + x, [*ts, e - 1])
        best = nxt
    return best[total][1]


def _long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _value(fp, group: list[int]):
    """The group's bits of a fingerprint, in their places (all other bits zero)."""
    return fp.bitwiseAND(F.lit(_long(sum(1 << b for b in group))))


def thresholds(nodes: DataFrame, n: int, both: np.ndarray, groups: list[list[int]], k: int) -> list[int]:
    """Per-partition thresholds. The candidates at threshold 0 are counted over all
    fingerprints (pairs of equal values); for wider ones they are carried on by how likely
    a bit differs."""
    values = F.explode(F.array(*(F.struct(F.lit(i).alias("part"), _value(F.col("fp"), g).alias("v")) for i, g in enumerate(groups))))
    same = {r.part: float(r.pairs) for r in nodes.select(values.alias("x")).groupBy("x.part", "x.v").count()
            .groupBy("part").agg(F.sum(F.col("count").cast("double") * F.col("count")).alias("pairs")).collect()}
    p = np.diag(both) / max(n, 1)
    differ = np.clip(2 * p * (1 - p), 1e-3, 0.5)
    cost = []
    for i, g in enumerate(groups):
        odds = differ[g] / (1 - differ[g])
        # elementary symmetric sums: weight of values that differ in exactly e bits
        e = np.zeros(k + 1)
        e[0] = 1
        for o in odds:
            e[1:] = e[1:] + o * e[:-1]
        probes = np.cumsum([_choose(len(g), j) for j in range(k + 1)])
        cost.append([0.0, *(float(same.get(i, 0) * e[:t + 1].sum() + n * probes[t]) for t in range(k + 1))])
    return allocate(cost, k - len(groups) + 1)


def _masks(group: list[int], radius: int) -> list[int]:
    """All changes of up to ``radius`` of the group's bits."""
    return [_long(sum(1 << b for b in bits)) for r in range(radius + 1) for bits in combinations(group, r)]


# -- probing and verifying -------------------------------------------------------------

def _joined(fp: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the connected parts of one unit's fingerprints (within ``k`` bits)."""
    fp = np.unique(fp)
    root = np.arange(len(fp))
    src, dst = [], []
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= k
    for i in range(len(fp)):
        j = np.flatnonzero(near[i, :i])
        roots = np.unique(root[j])
        roots = roots[roots != root[i]]
        if len(roots):
            low = min(roots.min(), root[i])
            mine = root[i]
            for r in roots:
                hit = j[root[j] == r][0]
                src.append(i)
                dst.append(hit)
            root[np.isin(root, np.append(roots, mine))] = low
    return fp[np.array(src, int)], fp[np.array(dst, int)]


def _unit_links(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by unit; a unit may reach over batches and is bounded by two blocks."""
    keep_u, keep_fp = np.zeros((0, 4), np.int64), np.zeros(0, np.uint64)

    def links(u: np.ndarray, fp: np.ndarray):
        if not len(fp):
            return [], []
        cut = np.flatnonzero((u[1:] != u[:-1]).any(1)) + 1
        starts, ends = np.append(0, cut), np.append(cut, len(fp))
        size = ends - starts
        src, dst = [], []
        two = starts[size == 2]  # most units: one comparison each, all at once
        hit = two[(fp[two] != fp[two + 1]) & (np.bitwise_count(fp[two] ^ fp[two + 1]) <= k)]
        src.append(fp[hit])
        dst.append(fp[hit + 1])
        for s, e in zip(starts[size > 2].tolist(), ends[size > 2].tolist()):
            a, b = _joined(fp[s:e], k)
            src.append(a)
            dst.append(b)
        return src, dst

    def out(src, dst):
        a, b = (np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64) for x in (src, dst))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        u = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], 1)
        fp = batch.column(4).to_numpy(zero_copy_only=False).view(np.uint64)
        u, fp = np.concatenate([keep_u, u]), np.concatenate([keep_fp, fp])
        same = np.flatnonzero((u != u[-1]).any(1)) if len(u) else np.zeros(0, int)
        cut = same[-1] + 1 if len(same) else 0
        keep_u, keep_fp = u[cut:], fp[cut:]
        yield out(*links(u[:cut], fp[:cut]))
    yield out(*links(keep_u, keep_fp))


def fingerprint_links(nodes: DataFrame, k: int = 3, block: int = 256, partitions: int | None = None) -> DataFrame:
    """Links (a, b) among distinct fingerprints ``fp`` that span all its groups linked at ``k``
    or fewer differing bits. ``nodes`` is read several times and should be a stored table."""
    n, both = bit_moments(nodes)
    m = partitions or partition_count(max(n, 1), k)
    groups = group_bits(n, both, m)
    radius = thresholds(nodes, n, both, groups, k)

    def filed(part: int, group: list[int], t: int):
        return F.transform(F.array(*(F.lit(x) for x in _masks(group, t))),
                           lambda mask: F.struct(F.lit(part).alias("part"), _value(F.col("fp"), group).bitwiseXOR(mask).alias("v")))

    used = [filed(i, g, t) for i, (g, t) in enumerate(zip(groups, radius)) if t >= 0]
    entries = nodes.select("fp", F.explode(F.concat(*used)).alias("x")).select("fp", "x.part", "x.v")
    # values shared by many entries are cut into blocks; there are at most entries / block of
    # them, and they are broadcast only if there are few (otherwise Spark picks the join)
    hot = stage(entries.groupBy("part", "v").count().where(F.col("count") > block), "hot-values")
    few = hot.count() <= 50_000
    sized = entries.join(F.broadcast(hot) if few else hot, ["part", "v"], "left")
    blocks = F.coalesce(F.ceil(F.col("count") / F.lit(block)), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    # in a cut value each node goes to the units of its block with every block
    units = (sized.select("fp", "part", "v", blocks.alias("blocks"), own.alias("own"))
             .select("fp", "part", "v", "own", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
             .select("part", "v", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "fp"))
    return (units.repartition("part", "v", "p", "q").sortWithinPartitions("part", "v", "p", "q")
            .mapInArrow(lambda it: _unit_links(it, k), "a long, b long").distinct())


# -- connected components --------------------------------------------------------------

def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node with an edge but the roots themselves; root is the
    smallest node of its component.

    Alternating star contractions: first every node sends its larger neighbours to its
    smallest one, then the smaller. Each half round is a partial-min aggregate and a join of
    tables on shared storage: a lost executor re-reads them, and Spark can split the join
    at a node with very many edges. It stops when a round changes nothing.
    """
    cur = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stage(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "low")
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: all edges run from the larger to the smaller node
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.expr("stack(2, b, m, a, m)").alias("a", "b")).where("a <> b").distinct()
        cur = stage(small, "edges")
        now = tuple(cur.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31)))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return cur.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")


# -- the operator ----------------------------------------------------------------------

def simhash_components(docs: DataFrame, width: int = 3, k: int = 3, key: str = "doc_id", text_col: str = "text",
                       block: int = 256) -> DataFrame:
    """Per row: the key, ``fingerprint`` (16 hex digits), ``component_id`` (smallest key
    reachable over links, own included) and ``fp`` (the fingerprint as a long).

    Texts without words share fingerprint 0 and are linked like any other. Null texts have
    no words. A null key takes part and never becomes a component id unless its whole
    component has none. Repeated rows stay. An empty table gives an empty result.
    """
    return _labelled(docs, width, k, key, text_col, block).select(
        key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "fp")


def _labelled(docs: DataFrame, width: int, k: int, key: str, text_col: str, block: int) -> DataFrame:
    """The key, ``fp``, ``root`` (smallest fingerprint of the component) and ``component_id``."""
    keyed = stage(fingerprints(docs, width, key, text_col), "fingerprints")
    nodes = stage(keyed.groupBy("fp").agg(F.min(key).alias("low")), "nodes")
    roots = components(fingerprint_links(nodes, k, block))
    named = stage(nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root")), "roots")
    lows = stage(named.groupBy("root").agg(F.min("low").alias("component_id")), "component-ids")
    label = stage(named.join(lows, "root").select("fp", "root", "component_id"), "labels")
    return keyed.join(label, "fp")


def keep_one(docs: DataFrame, width: int = 3, k: int = 3, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each linked group: the one with the smallest key (a null key only if there
    is no other). All columns of ``docs`` stay.

    Rows that repeat a kept key are told apart by their fingerprints, and of rows alike in
    both the one with the smallest text hash stays.
    """
    keyed = stage(_labelled(docs, width, k, key, text_col, 256), "linked")
    first = keyed.groupBy("root").agg(F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("k"), F.col("fp").alias("f"))).alias("x"))
    reps = stage(first.select("x.k", "x.f"), "representatives")
    twice = stage(keyed.groupBy(F.col(key).alias("k")).count().where("count > 1").select("k"), "repeated-keys")
    once = reps.join(twice, reps.k.eqNullSafe(twice.k), "left_anti").select(F.col("k").alias("once_key"))
    single = docs.join(once, docs[key].eqNullSafe(once["once_key"]), "left_semi")
    if twice.isEmpty():
        return single
    cols = docs.columns
    many = docs.join(twice, docs[key].eqNullSafe(twice["k"]), "left_semi").select(F.struct(*(F.col(f"`{c}`") for c in cols)).alias("row"))
    hashed = fingerprints(many.select("row", F.col(f"row.`{text_col}`").alias("t")), width, "row", "t")
    row_key = F.col(f"row.`{key}`")
    of_reps = hashed.join(reps, row_key.eqNullSafe(F.col("k")) & (F.col("fp") == F.col("f")), "left_semi")
    one = of_reps.groupBy(row_key.alias("k"), "fp").agg(F.min_by("row", F.xxhash64(F.coalesce(F.col(f"row.`{text_col}`"), F.lit("")))).alias("row"))
    return single.unionByName(one.select("row.*"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components over all documents: 3-word shingles, links at 3 or fewer bits."""
    return simhash_components(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")
