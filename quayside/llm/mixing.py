"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

The words of every source are laid out in a line: its documents are dealt into blocks by a
hash, the blocks stand in hash order, and the documents of a block in hash order. A
source's target says how far along its line the mix reads; beyond the end the line starts
again (the second copy), so a target of up to two times the source is met to the word, and
only the document at the stop is cut.

The blocks the mix reads are dealt to output shards. The exact block quotas of all
sources are split down a binary tree: a node draws how many blocks of each source go left
from the multivariate hypergeometric distribution, the rest goes right, until every shard
has its own quotas. Each shard reads the next blocks of each source's line that belong to
it, so shards are disjoint, and shuffles its documents by a hash.

Nothing is sampled on the way: sizes, targets, quotas and positions come from all rows, and
all draws follow from the seed, so reruns agree whatever the partitioning.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from quayside.llm.common import clean_text, documents, in_order, word_count
from quayside.session import scratch_dir, stage

WEIGHTS = (5, 2, 1)


def mix_targets(sizes: list[int], weights: list[int], share: Fraction, most: int) -> list[Fraction]:
    """Targets by weight of ``share`` times all sizes; none above ``most`` times its size, what
    is over is shared again by weight until none is above. Exact arithmetic."""
    left, open_, out = share * sum(sizes), list(range(len(sizes))), [Fraction(0)] * len(sizes)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = Fraction(most * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def split_quotas(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """Blocks of each source for each shard (shards x sources); the columns sum to the quotas
    and shard totals differ by one block at most."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def split(first: int, count: int, have: np.ndarray, node: int) -> None:
        if count == 1 or not have.sum():
            out[first] = have
            return
        left = count // 2
        draws = int(have.sum()) * left // count
        rng = np.random.default_rng([seed, node])
        took = rng.multivariate_hypergeometric(have, draws, method="marginals") if len(have) else have
        split(first, left, took, 2 * node)
        split(first + left, count - left, have - took, 2 * node + 1)

    split(0, shards, np.array(quotas, np.int64), 1)
    return out


def _hashed(docs: DataFrame, key: str, text_col: str, source_col: str, seed: int, carry: tuple[str, ...]) -> DataFrame:
    """k, source, size, h, wordy (there is a word) and ``row``, a struct of the columns in ``carry``."""
    text = clean_text(text_col)
    row = F.struct(*(F.col(f"`{c}`") for c in carry)) if carry else F.lit(None).cast("string")
    return docs.select(F.col(key).alias("k"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"),
                       F.xxhash64(F.lit(seed), F.col(key).cast("string"), text).alias("h"), text.rlike(r"[^\x20\x09-\x0D]").alias("wordy"), row.alias("row"))


def _bounded(df: DataFrame, most: int = 20_000) -> DataFrame:
    """A broadcast hint if the (stored) table has few rows; otherwise Spark picks the join."""
    return F.broadcast(df) if df.count() <= most else df


def _spread(rows: DataFrame, hot: DataFrame | None, seed: int, name: str) -> DataFrame:
    """Gives rows of the hashes in ``hot`` hashes of their own: equal rows are exchangeable, so
    their number among their equals, which needs no task to hold them all, tells them apart."""
    if hot is None:
        return rows
    same = F.col("h") == F.col("hot_h")
    placed = in_order(rows.join(hot, same, "left_semi"), ["h"], [], name)
    own = F.when(F.col("place") > 0, F.xxhash64(F.lit(seed + 2), "h", "place")).otherwise(F.col("h"))
    return rows.join(hot, same, "left_anti").unionByName(placed.withColumn("h", own).select(rows.columns))


def _in_blocks(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Rows joined to the row of their source, with ``block``: a range of the hash."""
    unit = F.shiftrightunsigned("h", 11).cast("double") / F.lit(float(1 << 53))
    t = table.withColumnRenamed("source", "t_source")
    return rows.join(t, rows.source.eqNullSafe(F.col("t_source"))).drop("t_source").withColumn("block", F.floor(unit * F.col("n_blocks")))


def _placed_blocks(rows: DataFrame) -> DataFrame:
    """Blocks that hold words: rank, block, words, ``block_start`` (words before it in its
    source's line) and ``position`` among the source's blocks. Ranges of 1024 blocks carry the
    sums, so a source with a third of all rows is spread over many tasks."""
    words = stage(rows.groupBy("rank", "block").agg(F.sum("size").alias("words")).withColumn("range", F.floor(F.col("block") / 1024)), "block-words")
    before = Window.partitionBy("rank").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (words.groupBy("rank", "range").agg(F.sum("words").alias("w"), F.count("*").alias("n"))
              .select("rank", "range", F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0")))
    inside = Window.partitionBy("rank", "range").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = words.withColumns({"w1": F.coalesce(F.sum("words").over(inside), F.lit(0)), "n1": F.count("*").over(inside)})
    return stage(placed.join(ranges, ["rank", "range"])
                 .select("rank", "block", "words", (F.col("w0") + F.col("w1")).alias("block_start"), (F.col("n0") + F.col("n1")).alias("position")), "blocks")


class Mix:
    """What a mix takes: ``sources`` (one row per source), ``draws`` (one per document and
    copy) and ``rows`` (one per document). ``words`` is the number of words it takes."""

    def __init__(self, laid: DataFrame, sources: DataFrame, draws: DataFrame, shards: int = 16, words: int = 0):
        self.laid, self.sources, self.draws, self.shards, self.words = laid, sources, draws, shards, words

    @property
    def rows(self) -> DataFrame:
        return self.rows_of(self.draws)

    def rows_of(self, draws: DataFrame) -> DataFrame:
        """Every document with what the given draws take of it; a row is told by its ``uid``."""
        d = (draws.groupBy(F.col("uid").alias("d_uid"))
             .agg(F.sum("words").alias("d_taken"), F.sort_array(F.collect_list(F.struct("copy", "shard"))).getField("shard").alias("d_shards")))
        rest = [c for c in self.laid.columns if c != "uid"]
        return self.laid.join(d, F.col("uid") == F.col("d_uid"), "left").select(*rest, F.coalesce("d_taken", F.lit(0)).cast("long").alias("taken"),
                                                                                F.coalesce("d_shards", F.array().cast("array<int>")).alias("shards"))

    def deal(self, words_per_part: int = 4_000_000) -> DataFrame:
        """The draws dealt to their shards in one shuffle: shard after shard, each in order of
        ``place``. A shard has as many parts as its words ask for; places are hashes, so
        equal cuts of their range are even and no sample has to find them."""
        parts = max(1, -(-self.words // (self.shards * words_per_part)))
        unit = F.col("place").cast("double") / F.lit(2.0 ** 64) + F.lit(0.5)
        part = F.least(F.floor(unit * F.lit(parts)), F.lit(parts - 1))
        return (self.draws.repartitionById(self.shards * parts, (F.col("shard") * F.lit(parts) + part).cast("int"))
                .sortWithinPartitions("shard", "place"))


def mix_sources(docs: DataFrame, key: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights: tuple[int, ...] = WEIGHTS, share: Fraction = Fraction(3, 2), most: int = 2, shards: int = 16,
                seed: int = 17, block_docs: int = 64, max_sources: int = 100_000, carry: tuple[str, ...] = ()) -> Mix:
    """Mix the sources to targets.

    Sources rank by code point, null last, and weigh ``weights`` in turn. They share ``share``
    times all words; no target is above ``most`` times its source. ``draws`` has a row per
    (document, copy) the mix takes: key, rank (of its source), copy, shard, place (order
    inside the shard), words (all of the document but for the last of each source and copy),
    size, mostly (at least half of the document is taken), ``uid`` (the row's number, unless columns are
    carried) and ``row``, the columns named in ``carry``. ``rows`` has the key, size,
    source_size, target (of its source), taken (the words of the document's draws; at most
    ``most`` times its size) and shards (the shard of each copy drawn).

    Blocks are read in order, so a source's last block per copy tells for every other block
    whether it is read, and only the rows of last blocks are summed one by one. Whole rows
    are thus shuffled only to be dealt to their shards.

    Null and wordless texts have size 0 and are never taken. Repeated rows are rows of their
    own; where more than 16 blocks' worth of rows are equal in key and text they are spread over the
    source's blocks by their number. Sources without words have target 0. An empty table
    gives empty results. One row per source goes to the driver, which fails clearly beyond
    ``max_sources`` sources.
    """
    spark = docs.sparkSession
    narrow = stage(_hashed(docs, key, text_col, source_col, seed, ()).select("k", "source", "size", "h").withColumn("uid", F.monotonically_increasing_id()), "sizes")
    found = narrow.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("docs")).limit(max_sources + 1).collect()
    if len(found) > max_sources:
        raise ValueError(f"more than {max_sources} sources; raise max_sources if the driver can hold them")
    found.sort(key=lambda r: (r.source is None, r.source or ""))  # Python compares by code point
    sizes = [r.words for r in found]
    targets = mix_targets(sizes, [weights[i % len(weights)] for i in range(len(found))], share, most)
    stops = [int(t + Fraction(1, 2)) for t in targets]
    table = [(r.source, i, r.words, float(t), stop, -(-r.docs // block_docs)) for i, (r, t, stop) in enumerate(zip(found, targets, stops))]
    sources = spark.createDataFrame(table, "source string, rank int, source_size long, target double, stop long, n_blocks long")
    small = (lambda df: F.broadcast(df)) if len(table) <= 20_000 else (lambda df: df)

    # Rows equal in key and text share a hash; the few hashes with very many are spread.
    hot = stage(narrow.where("size > 0").groupBy("h").count().where(F.col("count") > 16 * block_docs).select(F.col("h").alias("hot_h")), "equal-rows")
    n_hot = hot.count()
    hot = None if not n_hot else F.broadcast(hot) if n_hot <= 20_000 else hot
    counted = narrow.where("size > 0").withColumn("row", F.lit(None).cast("string"))
    counted = stage(_spread(counted, hot, seed, "equal"), "spread") if hot is not None else counted
    blocks = _placed_blocks(_in_blocks(counted, small(sources)))

    # Exact block quotas: the blocks of each copy that begin before the stop.
    known = blocks.join(small(sources.select("rank", "source_size", "stop")), "rank")
    reach = [F.greatest(F.lit(0), F.col("stop") - F.lit(c) * F.col("source_size")) for c in range(most)]
    inside = [F.col("block_start") < reach[c] for c in range(most)]
    last = stage(known.groupBy("rank").agg(*(F.struct(F.count_if(inside[c]).alias("n"), F.max(F.when(inside[c], F.col("block"))).alias("block"),
                                                      F.max(F.when(inside[c], F.col("block_start"))).alias("start"),
                                                      F.max(F.when(inside[c], F.col("block_start") + F.col("words"))).alias("end")).alias(f"c{c}") for c in range(most))), "last-blocks")
    quota = {r["rank"]: [r[f"c{c}"].n for c in range(most)] for r in last.collect()}
    split = split_quotas([sum(quota.get(i, [0])) for i in range(len(found))], shards, seed)
    ends = np.cumsum(split, 0)  # shard j reads the blocks [ends[j-1], ends[j]) of a source's line
    cuts = small(spark.createDataFrame([(i, [int(x) for x in ends[:, i]]) for i in range(len(found))], "rank int, ends array<bigint>"))
    # the first block of every shard, per source and copy
    turns = [F.when(inside[c], F.struct(F.lit(c).alias("copy"), (F.col("position") + sum((F.col(f"c{b}.n") for b in range(c)), F.lit(0))).alias("turn"))) for c in range(most)]
    turn = known.join(small(last), "rank").join(cuts, "rank").withColumn("t", F.explode(F.array_compact(F.array(*turns))))
    shard = F.least(F.size(F.filter("ends", lambda e: e <= F.col("t.turn"))), F.lit(shards - 1))
    firsts = (turn.groupBy("rank", F.col("t.copy").alias("copy"), shard.alias("shard")).agg(F.min("block").alias("first"))
              .groupBy("rank").agg(F.collect_list(F.struct("copy", "first", "shard")).alias("firsts")))
    plan = small(stage(small(sources.drop("target")).join(last, "rank").join(firsts, "rank"), "plan"))

    def draw(rows: DataFrame) -> DataFrame:
        copies = [F.struct(F.lit(c).alias("copy"), reach[c].alias("reach"), F.col(f"c{c}.block").alias("last"), F.col(f"c{c}.start").alias("start"),
                           (F.col(f"c{c}.end") > reach[c]).alias("cut")) for c in range(most)]
        at = _in_blocks(rows, plan).withColumn("c", F.explode(F.array(*copies))).where(F.col("block") <= F.col("c.last"))
        own = F.filter("firsts", lambda f: (f["copy"] == F.col("c.copy")) & (f["first"] <= F.col("block")))
        at = at.withColumns({"shard": F.array_max(own).getField("shard"), "place": F.xxhash64(F.lit(seed + 1), "h", "c.copy")})
        stop = F.col("c.cut") & (F.col("block") == F.col("c.last"))
        out = [F.col("k").alias(key), "rank", F.col("c.copy").alias("copy"), "shard", "place"]
        rest = ["uid", "row"]
        whole = at.where(~stop).select(*out, F.col("size").alias("words"), "size", F.lit(True).alias("mostly"), *rest)
        before = Window.partitionBy("rank", "c.copy").orderBy("h", "size", "k").rowsBetween(Window.unboundedPreceding, -1)
        left = F.least(F.col("size"), F.col("c.reach") - F.col("c.start") - F.coalesce(F.sum("size").over(before), F.lit(0)))
        part = at.where(stop).withColumn("words", left).where("words > 0").select(*out, "words", "size", (F.col("words") * 2 >= F.col("size")).alias("mostly"), *rest)
        return whole.unionByName(part)

    laid = narrow.join(small(sources.select(F.col("source").alias("s_source"), "source_size", "target")), narrow.source.eqNullSafe(F.col("s_source")))
    laid = laid.select(F.col("k").alias(key), "size", "source_size", "target", "uid")
    if carry:
        wide = _hashed(docs, key, text_col, source_col, seed, carry).where("wordy").drop("wordy").withColumn("uid", F.lit(None).cast("long"))
        draws = draw(_spread(wide, hot, seed, "equal-wide"))
    else:
        draws = draw(counted)
    return Mix(laid, sources, draws, shards, sum(stops))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as whole rows of ``docs``: a row per (document, copy) that the mix takes,
    dealt to the shards and shuffled inside them (part files in order hold shard after
    shard). The document at a source's stop comes whole if the mix takes at least half of
    it, else not. Nulls, empty texts, repeated rows and empty tables as in :func:`mix_sources`:
    rows without words are never taken, equal rows are drawn each."""
    mix = mix_sources(docs, carry=tuple(docs.columns), **options)
    mix.draws = mix.draws.where("mostly")
    return mix.deal().select("row.*")


def write_shards(mix: Mix, path: str) -> None:
    """The draws of a mix in one folder per shard, shuffled inside the shard by ``place``."""
    mix.deal(256_000_000).write.partitionBy("shard").parquet(path)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to weights 5, 2, 1 over 150 % of all words: the draws are written
    to 16 shards, and the result is what the shards hold of every document."""
    mix = mix_sources(documents(spark, sf_dir))
    path = scratch_dir(spark, "shards")
    write_shards(mix, path)
    return mix.rows_of(spark.read.schema(mix.draws.schema).parquet(path))
