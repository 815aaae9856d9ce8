"""Prefix trie of conversations by the Euler-tour technique.

Nodes are the distinct sequences of first turns. A turn's hash depends on its place and its
content, and a prefix is known by the exclusive-or of its turns' hashes, which is a
running total: it is computed in blocks, so a conversation of any length is spread over many
tasks. That no two contents share a node is checked on all members.

Every node gives an enter and an exit arc. The arcs form one list, the Euler tour, which
is ranked by random-mate contraction: in each round about a quarter of the arcs is spliced
out by one shuffle, until a bounded rest can be ranked in one task; then the rounds are
undone in reverse. The work of all rounds together is proportional to the number of arcs.
A node's subtree lies between its two arcs, so sums over subtrees are differences of
prefix sums at arc positions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quayside.llm.common import in_order, running, word_count
from quayside.session import stage

_NOTHING = hashlib.sha256(b"").hexdigest()


# -- conversations -------------------------------------------------------------------------


def ordered_turns(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Turns in order: conv, pos (from 1), digest (of role and text) and words. Null turns
    come first; turns that tie stand in order of their digests, equal ones are turns each.
    A null role or text is the empty one. Rows without a conversation are left out."""
    clean = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    src = conversations.where(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("conv"), F.col(turn).alias("turn"),
        F.sha2(F.concat(F.length(clean(role)).cast("string"), F.lit(":"), clean(role), clean(text)), 256).alias("digest"),
        word_count(clean(text)).alias("words"))
    ranked = in_order(src, ["conv"], [F.col("turn").asc_nulls_first(), F.col("digest")], "turns")
    return stage(ranked.select("conv", (F.col("place") + 1).alias("pos"), "digest", "words"), "ordered-turns")


def shared_heads(turns: DataFrame, group: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) with heads shared inside groups of ids: conversation c gets the
    first h turns of conversation c - c % group, h = crc32(c) % most, in place of its own
    first h. Conversations: conv and ``n``, the number of its turns (0 if none is left)."""
    convs = turns.groupBy("conv").agg(F.max("pos").alias("own")).withColumns(
        {"base": F.col("conv") - F.col("conv") % group, "h": F.crc32(F.col("conv").cast("string").cast("binary")) % most})
    heads = turns.where((F.col("conv") % group == 0) & (F.col("pos") < most))
    have = heads.groupBy(F.col("conv").alias("b")).agg(F.max("pos").alias("b_n"))
    convs = stage(convs.join(have, F.col("base") == F.col("b"), "left")
                  .select("conv", "base", "h", F.least(F.col("h"), F.coalesce("b_n", F.lit(0))).alias("k"), "own"), "conversations")
    c = convs.select(F.col("conv").alias("c"), "base", "h", "k")
    given = heads.join(c, (heads.conv == F.col("base")) & (heads.pos <= F.col("h"))).select(F.col("c").alias("conv"), "pos", "digest", "words")
    own = (turns.join(c, (turns.conv == F.col("c")) & (turns.pos > F.col("h")))
           .select("conv", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "digest", "words"))
    return given.unionByName(own), convs.select("conv", (F.col("k") + F.greatest(F.lit(0), F.col("own") - F.col("h"))).alias("n"))


# -- nodes ---------------------------------------------------------------------------------


def _prefixes(turns: DataFrame, longest: int) -> DataFrame:
    """Per turn its prefix's name (x1, x2) and that of the prefix before it (p1, p2)."""
    lanes = turns.select("conv", "pos", "words", *(F.xxhash64(F.lit(s), "pos", "digest").alias(f"l{s}") for s in (1, 2)))
    run = running(lanes, ["conv"], "pos", {"x1": "l1", "x2": "l2"}, longest, "bit_xor")
    return run.withColumns({f"p{s}": F.col(f"x{s}").bitwiseXOR(F.col(f"l{s}")) for s in (1, 2)})


def _nodes(prefixes: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node: depth, x1, x2, p1, p2, conv_id, n_convs, words. Members of one node
    must agree in their last turn and, by the names, in the node above: so in all turns."""
    one = lambda c: F.min(c) == F.max(c)
    sure = F.when(one("l1") & one("l2"), F.count("*")).otherwise(F.raise_error(F.lit("two prefixes share a name")).cast("long"))
    deep = prefixes.groupBy(F.col("pos").alias("depth"), "x1", "x2").agg(
        F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("conv").alias("conv_id"), sure.alias("n_convs"), F.min("words").alias("words"))
    zero = F.lit(0).cast("long")
    root = (convs.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
            .select(zero.alias("depth"), zero.alias("x1"), zero.alias("x2"), F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"),
                    "conv_id", "n_convs", zero.alias("words")))
    return deep.unionByName(root)


def _ends(prefixes: DataFrame, convs: DataFrame, chunk: int = 1 << 16) -> DataFrame:
    """Per node at which conversations end: their ids' hash. Ids are sorted over range
    partitions and joined to chunks there; the chunks of a node then pass one task as a
    stream, since a hash can only be fed in order."""
    last = prefixes.join(convs.select(F.col("conv").alias("c"), "n"), (F.col("conv") == F.col("c")) & (F.col("pos") == F.col("n")))
    zero = F.lit(0).cast("long")
    ends = (last.select(F.col("pos").alias("depth"), "x1", "x2", "conv")
            .unionByName(convs.where("n = 0").select(zero.alias("depth"), zero.alias("x1"), zero.alias("x2"), "conv")))
    node = ["depth", "x1", "x2"]

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, chunk // 20):
            for (d, x, y), ids in rows:
                yield (d, x, y, ids[0], ",".join(map(str, ids)))

    def to_batches(rows, schema):
        buf, size = [], 0
        for r in rows:
            buf.append(r)
            size += 100 + (len(r[-1]) if isinstance(r[-1], str) else 0)
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*buf), schema.types)], schema=schema)
                buf, size = [], 0
        if buf:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*buf), schema.types)], schema=schema)

    parts = pa.schema([*((c, pa.int64()) for c in (*node, "first")), ("ids", pa.string())])
    hashes = pa.schema([*((c, pa.int64()) for c in node), ("ends_sha256", pa.string())])

    def hashed(batches: Iterator[pa.RecordBatch]):
        now, state = None, None
        for batch in batches:
            for d, x, y, ids in zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 4))):
                if (d, x, y) != now:
                    if now is not None:
                        yield (*now, state.hexdigest())
                    now, state = (d, x, y), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
        if now is not None:
            yield (*now, state.hexdigest())

    order = [*node, "conv"]
    joined = (ends.repartitionByRange(*order).sortWithinPartitions(*order)
              .mapInArrow(lambda b: to_batches(chunks(b), parts), "depth long, x1 long, x2 long, first long, ids string"))
    return (joined.repartition(*node).sortWithinPartitions(*node, "first")
            .mapInArrow(lambda b: to_batches(hashed(b), hashes), "depth long, x1 long, x2 long, ends_sha256 string"))


def _groups(batches: Iterator[pa.RecordBatch], most: int):
    """Runs of ids of one node in a sorted stream of (depth, x1, x2, conv), at most ``most`` at a time."""
    now, ids = None, []
    for batch in batches:
        out = []
        for d, x, y, c in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if (d, x, y) != now or len(ids) >= most:
                if ids:
                    out.append((now, ids))
                now, ids = (d, x, y), []
            ids.append(c)
        yield out
    if ids:
        yield [(now, ids)]


# -- the tour ------------------------------------------------------------------------------


def list_rank(arcs: DataFrame, residue: int = 50_000, seed: int = 11) -> DataFrame:
    """(id, pos): positions from 0 along the list that ``next`` (null at the end) makes of ``arcs``
    (id, next).

    Random mate: an arc whose coin is 1 is spliced out by its predecessor if that one's coin
    is 0; both meet at the arc's id in one aggregation. Each round keeps about three quarters;
    at ``residue`` arcs at most, whatever the input, the rest is walked in one task. Then
    every spliced arc gets its predecessor's position plus the length in between.
    """
    left = arcs.select("id", "next", F.lit(1).cast("long").alias("len"))
    n, rounds = left.count(), []
    while n > residue:
        coin = lambda c, r=len(rounds): F.xxhash64(F.lit(seed), F.lit(r), c).bitwiseAND(F.lit(1)) == 1
        meet = F.when(~coin(F.col("id")) & F.col("next").isNotNull() & coin(F.col("next")), F.col("next")).otherwise(F.col("id"))
        own = F.col("id") == F.col("at")
        met = stage(left.withColumn("at", meet).groupBy("at").agg(
            F.max(F.when(own, F.col("next"))).alias("next"), F.max(F.when(own, F.col("len"))).alias("len"),
            F.max(F.when(~own, F.col("id"))).alias("ahead"), F.max(F.when(~own, F.col("len"))).alias("gap")), f"round-{len(rounds)}")
        rounds.append(met.where("ahead is not null").select(F.col("at").alias("id"), "ahead", "gap"))
        left = met.select(F.coalesce("ahead", "at").alias("id"), "next", (F.col("len") + F.coalesce("gap", F.lit(0))).alias("len"))
        n = left.count()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        follow: dict[int, tuple] = {}
        for b in batches:
            follow.update(zip(b.column(0).to_pylist(), zip(b.column(1).to_pylist(), b.column(2).to_pylist())))
        at = next(iter(follow.keys() - {x for x, _ in follow.values()}), None)
        ids, pos, here = [], [], 0
        while at is not None:
            ids.append(at)
            pos.append(here)
            at, step = follow[at]
            here += step
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(pos, pa.int64())], ["id", "pos"])

    known = stage(left.coalesce(1).mapInArrow(walk, "id long, pos long"), "ranked")
    for k in range(len(rounds) - 1, -1, -1):
        gone = rounds[k]
        placed = known.withColumnRenamed("id", "k_id").join(gone, F.col("k_id") == F.col("ahead")).select("id", (F.col("pos") + F.col("gap")).alias("pos"))
        known = stage(known.unionByName(placed), f"ranked-{k}")
    return known


def prefix_trie(turns: DataFrame, convs: DataFrame, residue: int = 50_000) -> DataFrame:
    """Trie of conversations: one row per distinct sequence of first d turns, d = 0 included.

    ``turns``: conv, pos (dense, from 1), digest, words; ``convs``: every conversation, also
    those without turns, with its number of turns ``n``. Per node: conv_id (smallest
    member), depth, parent_conv_id (the parent's; null at the root), n_convs, n_children,
    n_leaves (childless nodes in the subtree), saved_tokens (over the subtree, (n_convs - 1)
    times the words of the last turn) and ends_sha256 (SHA-256 of the ids, ascending and
    comma-joined, of the conversations that end here). A node's id is (conv_id, depth).
    No conversations: no rows.
    """
    head = convs.agg(F.max("n").alias("longest"), F.min("conv").alias("root")).first()
    longest = head["longest"] or 0
    prefixes = stage(_prefixes(turns, longest), "prefixes")
    nodes = stage(_nodes(prefixes, convs), "nodes")
    ends = _ends(prefixes, convs)

    # The parent's conv_id; all nodes of depth 1 have the root's, which needs no join.
    up = nodes.where("depth > 0").select(F.col("depth").alias("u_depth"), F.col("x1").alias("u1"), F.col("x2").alias("u2"), F.col("conv_id").alias("parent_conv"))
    below = nodes.where("depth > 1").join(up, (F.col("depth") - 1 == F.col("u_depth")) & (F.col("p1") == F.col("u1")) & (F.col("p2") == F.col("u2")))
    plain = ["conv_id", "depth", "x1", "x2", "n_convs", "words"]
    held = (below.select(*plain, "parent_conv").unionByName(nodes.where("depth = 1").select(*plain, F.lit(head["root"]).cast("long").alias("parent_conv")))
            .withColumn("up", F.col("depth") - 1))
    placed = in_order(held, ["parent_conv", "up"], [F.col("conv_id")], "siblings").drop("place")
    root = nodes.where("depth = 0").select(*plain, F.lit(None).cast("long").alias("parent_conv"), F.lit(None).cast("long").alias("up"),
                                           F.lit(-1).cast("long").alias("at"), F.lit(None).cast("long").alias("next_at"))
    everyone = placed.select(root.columns).unionByName(root)
    children = placed.groupBy(F.col("parent_conv").alias("c_conv"), F.col("up").alias("c_depth")).agg(
        F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count("*").alias("n_children"))
    tree = stage(everyone.join(children, (F.col("conv_id") == F.col("c_conv")) & (F.col("depth") == F.col("c_depth")), "left")
                 .drop("c_conv", "c_depth", "up").fillna(0, ["n_children"]), "tree")

    # Arc 2 * at enters a node, 2 * at + 1 leaves it; children stand in order of conv_id.
    enter, leave = F.col("at") * 2, F.col("at") * 2 + 1
    arcs = tree.select(F.explode(F.array_compact(F.array(
        F.struct(enter.alias("id"), F.coalesce(F.col("first_at") * 2, leave).alias("next")),
        F.when(F.col("next_at").isNotNull() | (F.col("at") == -1), F.struct(leave.alias("id"), (F.col("next_at") * 2).alias("next"))),
        F.when(F.col("last_at").isNotNull(), F.struct((F.col("last_at") * 2 + 1).alias("id"), leave.alias("next")))))).alias("a")).select("a.*")
    ranked = list_rank(arcs, residue)

    # Prefix sums along the tour; a node's own values stand on its enter arc.
    weights = tree.select("at", (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("save"))
    entering = F.col("id").bitwiseAND(F.lit(1)) == 0
    on_arcs = stage(ranked.withColumn("node", F.shiftright("id", 1)).join(weights, F.col("node") == F.col("at"))
                    .select("pos", "node", entering.alias("in"), F.when(entering, F.col("leaf")).otherwise(0).alias("leaf"),
                            F.when(entering, F.col("save")).otherwise(0).alias("save")), "tour")
    summed = running(on_arcs, [], "pos", {"s_leaf": "leaf", "s_save": "save"}, max(0, on_arcs.count() - 1))
    part = lambda c: F.sum(F.when(F.col("in"), F.col(c) - F.col(f"s_{c}")).otherwise(F.col(f"s_{c}")))
    subtree = summed.groupBy("node").agg(part("leaf").alias("n_leaves"), part("save").alias("saved_tokens"))

    out = tree.join(subtree, F.col("at") == F.col("node")).join(ends, ["depth", "x1", "x2"], "left")
    return out.select("conv_id", "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.lit(_NOTHING)).alias("ends_sha256"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trie of all conversations, rebuilt on heads shared inside groups of 20 ids."""
    turns, convs = shared_heads(ordered_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return prefix_trie(turns, convs)


SQL = r"""
WITH RECURSIVE bits AS (
  SELECT i::BIGINT AS i, i::BIGINT AS v, 0 AS s FROM range(256) r(i)
  UNION ALL SELECT i, xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END), s + 1 FROM bits WHERE s < 8),
tab AS (SELECT i, v FROM bits WHERE s = 8),
ids AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
crc AS (
  SELECT c, c::VARCHAR AS t, 4294967295::BIGINT AS v, 1 AS p FROM ids
  UNION ALL SELECT c, t, xor(crc.v >> 8, tab.v), p + 1 FROM crc JOIN tab ON tab.i = xor(crc.v, ascii(substr(t, p, 1))::BIGINT) & 255 WHERE p <= length(t)),
h AS (SELECT c, (xor(v, 4294967295) % 4)::BIGINT AS h FROM crc WHERE p = length(t) + 1),
turns AS (
  SELECT conv_id AS c, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS d,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS words, turn FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, d, words, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, d) AS i FROM turns),
made AS (
  SELECT h.c, 0 AS side, o.i, o.d, o.words FROM h JOIN own o ON o.c = h.c - h.c % 20 AND o.i <= h.h
  UNION ALL SELECT h.c, 1, o.i, o.d, o.words FROM h JOIN own o ON o.c = h.c AND o.i > h.h),
pos AS (SELECT c, d, words, row_number() OVER (PARTITION BY c ORDER BY side, i) AS p FROM made),
pre AS (
  SELECT c, p, words, list(d) OVER (PARTITION BY c ORDER BY p) AS k FROM pos
  UNION ALL SELECT c, 0, 0, []::VARCHAR[] FROM ids),
last AS (SELECT c, max(p) AS n FROM pre GROUP BY c),
node AS (
  SELECT k, p AS depth, min(pre.c) AS conv_id, count(*) AS n_convs, max(words) AS words,
         string_agg(pre.c::VARCHAR, ',' ORDER BY pre.c) FILTER (p = n) AS ends
  FROM pre JOIN last ON pre.c = last.c GROUP BY k, p),
kids AS (SELECT k[:len(k) - 1] AS k, count(*) AS n FROM node WHERE depth > 0 GROUP BY 1),
val AS (SELECT node.*, coalesce(kids.n, 0) AS n_children FROM node LEFT JOIN kids ON node.k = kids.k),
sub AS (
  SELECT a.k, sum((u.n_children = 0)::INT)::BIGINT AS n_leaves, sum((u.n_convs - 1) * u.words)::BIGINT AS saved_tokens
  FROM val u JOIN pre a ON a.c = u.conv_id AND a.p <= u.depth GROUP BY a.k)
SELECT v.conv_id, v.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, v.n_convs, v.n_children, sub.n_leaves, sub.saved_tokens,
       sha256(coalesce(v.ends, '')) AS ends_sha256
FROM val v JOIN sub ON sub.k = v.k LEFT JOIN val up ON v.depth > 0 AND up.k = v.k[:len(v.k) - 1]
"""
