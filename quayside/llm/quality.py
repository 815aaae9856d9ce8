"""Quality rules as weak supervision, in DataFrame functions only.

Each rule looks at one statistic of a text and votes good, votes bad or abstains. How far a
rule can be trusted is not set by hand: expectation-maximisation over all documents
estimates, per rule, how often it votes bad on good and on bad texts, and with these each
text gets a posterior probability of being good. A text is kept if that is at least one
half; one stray vote does not drop a text, as it would if all rules had to pass.

The statistics come from built-in functions inside one projection (no shuffle). The
estimation runs on the counts of vote patterns: one partial aggregate whose result has at
most three to the number of rules rows, however many documents there are.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quayside.llm.common import clean_text, documents
from quayside.session import stage

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
# Frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = (
    "the of and to in is that for it as was with be by on not are this at from or an have a "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an "
    "le la les de des et un une du en que qui dans pour par sur au plus ne se pas il elle avec "
    "el los las y que un una del se por con no su para es al lo como más o pero sus"
).split()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def text_stats(text: Column) -> Column:
    """Struct of the statistics of one text (a column without nulls).

    ``n_words``, ``word_chars`` (code points in words), ``n_symbols``, ``n_dup_lines`` (lines
    with a word, equal to an earlier one), ``n_repeat_words`` (words in three-word windows
    that occur twice or more, the first included), and for the rules ``n_lines`` (with a
    word), ``n_upper``, ``n_exclaim``, ``n_function``, ``n_distinct``. Windows are compared by a
    64-bit hash within one text.
    """
    words = F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)

    def of_words(w: Column) -> Column:
        n = F.size(w)
        windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<bigint>"))
        return F.struct(
            n.cast("long").alias("n_words"), let(windows, repeat_words).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(FUNCTION_WORDS))).cast("long").alias("n_function"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"))

    without = lambda chars: F.length(F.translate(text, chars, ""))
    return let(let(words, of_words), lambda s: F.struct(
        s["n_words"].alias("n_words"), without(BLANKS).cast("long").alias("word_chars"),
        (F.length(text) - without(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        s["n_repeat_words"].alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.length(text) - F.length(F.regexp_replace(text, "\\p{Lu}", ""))).cast("long").alias("n_upper"),
        (F.length(text) - without("!")).cast("long").alias("n_exclaim"),
        s["n_function"].alias("n_function"), s["n_distinct"].alias("n_distinct")))


def repeat_words(windows: Column) -> Column:
    """Words covered by windows (hashes in text order) that occur at least twice. Only texts
    that have such windows sort them."""
    def covered(s: Column) -> Column:
        same = lambda i, x: F.coalesce(F.get(s, i)["h"] == x["h"], F.lit(False))
        again = F.filter(s, lambda x, i: (F.when(i > 0, same(i - 1, x)).otherwise(F.lit(False))) | same(i + 1, x))
        places = F.sort_array(F.transform(again, lambda x: x["i"]))
        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
        return F.aggregate(places, zero, lambda a, p: F.struct(
            (a["n"] + F.least(F.lit(3), p - a["last"])).cast("long").alias("n"), p.alias("last")), lambda a: a["n"])

    placed = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), let(F.sort_array(placed), covered)).otherwise(F.lit(0).cast("long"))


# -- rules -------------------------------------------------------------------------------

@dataclass(frozen=True)
class Rule:
    """Votes bad where ``bad`` holds, good where ``good`` holds and bad does not, else abstains."""

    name: str
    bad: Callable[[Column], Column]
    good: Callable[[Column], Column]


def _share(part: str, whole: str) -> Callable[[Column], Column]:
    return lambda s: s[part] / F.greatest(s[whole], F.lit(1))


def _above(name: str, part: str, whole: str, good: float, bad: float) -> Rule:
    share = _share(part, whole)
    return Rule(name, lambda s: share(s) > bad, lambda s: share(s) <= good)


def _below(name: str, part: str, whole: str, bad: float, good: float) -> Rule:
    share = _share(part, whole)
    return Rule(name, lambda s: share(s) < bad, lambda s: share(s) >= good)


RULES = (
    _above("symbols", "n_symbols", "n_words", 0.02, 0.1),
    _above("duplicate lines", "n_dup_lines", "n_lines", 0.2, 0.5),
    _above("repeated words", "n_repeat_words", "n_words", 0.15, 0.35),
    _above("capitals", "n_upper", "word_chars", 0.15, 0.4),
    _above("exclamations", "n_exclaim", "n_words", 0.05, 0.2),
    _below("function words", "n_function", "n_words", 0.03, 0.08),
    _below("distinct words", "n_distinct", "n_words", 0.08, 0.2),
    Rule("word length", lambda s: ~(_share("word_chars", "n_words")(s).between(2.5, 14)), lambda s: _share("word_chars", "n_words")(s).between(3.5, 10)),
)


def votes(stats: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Vote pattern as text, a character per rule: b(ad), g(ood) or - (abstains)."""
    return F.concat(*(F.when(r.bad(stats), "b").when(r.good(stats), "g").otherwise("-") for r in rules))


@dataclass
class VoteModel:
    """``bad_on_good[j]``: how often rule j votes bad on good texts when it votes at all;
    ``bad_on_bad[j]`` the same on bad texts; ``good``: share of good texts."""

    good: float
    bad_on_good: list[float]
    bad_on_bad: list[float]

    def posterior(self, pattern: Column) -> Column:
        """Probability that a text with this vote pattern is good."""
        logit = F.lit(math.log(self.good / (1 - self.good)))
        for j, (g, b) in enumerate(zip(self.bad_on_good, self.bad_on_bad)):
            v = F.substring(pattern, j + 1, 1)
            logit = logit + F.when(v == "b", math.log(g / b)).when(v == "g", math.log((1 - g) / (1 - b))).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def estimate(patterns: list[tuple[str, int]], rounds: int = 200) -> VoteModel:
    """Expectation-maximisation on vote patterns and their counts.

    It starts from rules that are mostly right (a text with no bad vote is good) and smooths
    with one text per rule and class. A rule that turns out no better than chance gets
    equal rates, so it stops counting; it never counts the wrong way round.
    """
    n_rules = len(patterns[0][0]) if patterns else len(RULES)
    model = VoteModel(0.9, [0.02] * n_rules, [0.3] * n_rules)
    total = sum(n for _, n in patterns)
    for _ in range(rounds if total else 0):
        good, cast = 0.0, [[1e-9, 1e-9, 1e-9, 1e-9] for _ in range(n_rules)]  # votes on good, bad ones; on bad, bad ones
        for pattern, n in patterns:
            logit = math.log(model.good / (1 - model.good))
            for j, v in enumerate(pattern):
                g, b = model.bad_on_good[j], model.bad_on_bad[j]
                logit += math.log(g / b) if v == "b" else math.log((1 - g) / (1 - b)) if v == "g" else 0.0
            p = 1 / (1 + math.exp(-max(-40.0, min(40.0, logit))))
            good += p * n
            for j, v in enumerate(pattern):
                if v != "-":
                    cast[j][0] += p * n
                    cast[j][2] += (1 - p) * n
                    if v == "b":
                        cast[j][1] += p * n
                        cast[j][3] += (1 - p) * n
        g_rate = [(x[1] + 0.02) / (x[0] + 1) for x in cast]
        b_rate = [max((x[3] + 0.3) / (x[2] + 1), g) for x, g in zip(cast, g_rate)]
        before, model = model, VoteModel(min(0.995, max(0.5, (good + 0.9) / (total + 1))), g_rate, b_rate)
        if abs(before.good - model.good) < 1e-10:
            break
    clip = lambda x: min(1 - 1e-4, max(1e-4, x))
    return VoteModel(model.good, [clip(x) for x in model.bad_on_good], [clip(x) for x in model.bad_on_bad])


def fit_votes(df: DataFrame, pattern: str) -> VoteModel:
    """The model for a column of vote patterns; counts cover all rows."""
    rows = df.groupBy(pattern).count().collect()  # at most 3 ** rules rows
    return estimate(sorted((r[0], r["count"]) for r in rows))


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < 50) | (100 * stats["n_repeat_words"] > 50 * stats["n_words"])


def quality(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the key, the statistics of :func:`text_stats` in columns, ``votes``, ``p_good``
    (posterior), ``base_failed`` (under 50 words or over half of them repeated) and ``kept``
    (false if base_failed, else p_good >= 0.5).

    Null texts have no words, so they fail the base rule; repeated rows stay and count in the
    estimate each; an empty table gives an empty result; other columns are ignored.
    """
    rows = stage(docs.select(F.col(key).alias("k"), text_stats(clean_text(text_col)).alias("s"))
                 .select("k", "s", votes(F.col("s")).alias("votes")), "quality")
    p = fit_votes(rows, "votes").posterior(F.col("votes"))
    failed = base_failed(F.col("s"))
    return rows.select(F.col("k").alias(key), "s.*", "votes", p.alias("p_good"), failed.alias("base_failed"),
                       (~failed & (p >= 0.5)).alias("kept"))


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`quality` keeps, all columns unchanged. Statistics and
    texts are written once together, so no join is needed to bring them back."""
    cols = docs.columns
    rows = stage(docs.select(F.struct(*(F.col(f"`{c}`") for c in cols)).alias("row"), text_stats(clean_text(text_col)).alias("s"))
                 .select("row", votes(F.col("s")).alias("votes"), base_failed(F.col("s")).alias("failed")), "quality")
    p = fit_votes(rows, "votes").posterior(F.col("votes"))
    return rows.where(~F.col("failed") & (p >= 0.5)).select("row.*")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole document text."""
    return quality(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")
