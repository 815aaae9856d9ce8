"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from quayside.session import stage

# White space of the word rule ``[^\x20\x09-\x0D]+`` used across the corpus operators.
WORD = r"[^\x20\x09-\x0D]+"

_ARROW = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(),
          "int": pa.int32(), "binary": pa.binary()}
_SPARK = {"bigint": T.LongType(), "string": T.StringType(), "boolean": T.BooleanType(), "double": T.DoubleType(),
          "int": T.IntegerType(), "binary": T.BinaryType()}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path(name: str) -> str:
    """Place of a vocabulary file of the installed ``public_tokenizers`` package (each node
    has the package, so workers resolve the name themselves)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def clean_text(text_col: str = "text"):
    """The text column with null as the empty text."""
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def map_texts(docs: DataFrame, fn: Callable[[list[str]], dict[str, list]], schema: dict[str, str],
              key: str = "doc_id", text_col: str = "text", batch_bytes: int = 8 << 20) -> DataFrame:
    """Run ``fn`` over the whole texts of every Arrow batch, without a shuffle.

    ``fn`` gets a list of texts of about ``batch_bytes`` bytes (one longer text stands
    alone) and returns one list per column of ``schema`` (name to Spark type). The result
    has the key column and those columns.
    """
    src = docs.select(F.col(key).alias("k"), clean_text(text_col).cast("binary").alias("t"))
    out_schema = T.StructType([T.StructField(key, src.schema["k"].dataType), *(T.StructField(c, _SPARK[t]) for c, t in schema.items())])
    names = list(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got: dict[str, list] = {c: [] for c in names}
            sizes = pc.binary_length(batch.column(1)).to_pylist()
            at = 0
            while at < len(sizes):
                end, size = at + 1, sizes[at]
                while end < len(sizes) and size + sizes[end] <= batch_bytes:
                    size += sizes[end]
                    end += 1
                part = fn([b.decode("utf-8", "replace") for b in batch.column(1).slice(at, end - at).to_pylist()])
                for c in names:
                    got[c].extend(part[c])
                at = end
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(got[c], _ARROW[schema[c]]) for c in names)], [key, *names])

    return src.mapInArrow(run, out_schema)


class Spans:
    """Spans taken in a text. A question about one is a bisection: among the spans that begin
    before its end, the one that reaches farthest tells."""

    def __init__(self, spans):
        self._lay(sorted(spans))

    def _lay(self, spans: list[tuple[int, int]]) -> None:
        self.spans, self.starts, self.reach, far = spans, [s for s, _ in spans], [], 0
        for _, e in spans:
            far = max(far, e)
            self.reach.append(far)

    def take_free(self, spans) -> list[tuple[int, int]]:
        """Of ``spans``, in order of their starts, those that meet neither a taken span nor one
        accepted before; they are taken now."""
        out, last = [], 0
        for s, e in spans:
            i = bisect_left(self.starts, e)
            if s >= last and not (i and self.reach[i - 1] > s):
                out.append((s, e))
                last = e
        if out:
            self._lay(sorted([*self.spans, *out]))
        return out


def word_count(text):
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text column without nulls."""
    return F.size(F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")).cast("long")


# -- order and running totals without a hot task -------------------------------------------


def in_order(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """The rows with ``at`` (a unique number in the order of keys and ``order``), ``place``
    (rank in the key's group, from 0) and ``next_at`` (``at`` of the group's next row).

    Rows are range-partitioned, so a group of any size is spread over tasks; rows that are
    equal in everything are told apart by their input position. The result is staged.
    """
    by = [*map(F.col, keys), *order, F.col("_tie")]
    rows = stage(df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie")
                 .withColumn("at", F.monotonically_increasing_id()), name)
    part = F.shiftright("at", 33)
    runs = rows.groupBy(*(F.col(k).alias(f"_{k}") for k in keys), part.alias("_part")).agg(F.min("at").alias("first"), F.max("at").alias("last"))
    w = Window.partitionBy(*(f"_{k}" for k in keys)).orderBy("_part")
    runs = runs.withColumns({"before": F.coalesce(F.sum(F.col("last") - F.col("first") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
                             "follow": F.lead("first").over(w)})
    same = part == F.col("_part")
    for k in keys:
        same = same & (F.col(k) == F.col(f"_{k}"))
    return rows.join(runs, same).select(*rows.columns, (F.col("at") - F.col("first") + F.col("before")).alias("place"),
                                        F.when(F.col("at") < F.col("last"), F.col("at") + 1).otherwise(F.col("follow")).alias("next_at"))


def running(df: DataFrame, keys: list[str], pos: str, totals: dict[str, str], last: int, fold: str = "sum", width: int = 4096) -> DataFrame:
    """The rows with the inclusive running total of each column (new name to column) along
    the dense position ``pos`` (0 to at most ``last``) of each group.

    Blocks of ``width`` positions are totalled alone, and block totals run the same way one
    level up, so no window holds more than ``width`` rows. ``fold``: sum or bit_xor.
    """
    f = {"sum": F.sum, "bit_xor": F.bit_xor}[fold]
    plus = (lambda a, b: a + b) if fold == "sum" else (lambda a, b: a.bitwiseXOR(b))
    block = F.floor(F.col(pos) / F.lit(width)).cast("long")
    rows = df.withColumn("_block", block)
    w = Window.partitionBy(*keys, "_block").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.withColumns({n: f(c).over(w) for n, c in totals.items()})
    if last < width:
        return inside.drop("_block")
    blocks = rows.groupBy(*keys, F.col("_block").alias("_pos")).agg(*(f(c).alias(c) for c in totals.values()))
    above = running(blocks, keys, "_pos", {f"_run_{n}": c for n, c in totals.items()}, last // width, fold, width)
    before = above.select(*(F.col(k).alias(f"_{k}") for k in keys), (F.col("_pos") + 1).alias("_after"), *(f"_run_{n}" for n in totals))
    same = F.col("_block") == F.col("_after")
    for k in keys:
        same = same & (F.col(k) == F.col(f"_{k}"))
    out = inside.join(before, same, "left")
    return out.select(*df.columns, *(plus(F.col(n), F.coalesce(F.col(f"_run_{n}"), F.lit(0))).alias(n) for n in totals))
