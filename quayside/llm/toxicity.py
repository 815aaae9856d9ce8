"""Toxicity by a subsequence string-kernel support vector machine on Nyström landmarks.

The kernel compares two words by the three-letter subsequences they share, gaps allowed: a
subsequence that spans ``s`` letters weighs ``DECAY ** s``, up to ``SPAN`` letters. So an
insult with letters inserted, dropped or doubled stays close to the insult, and inflected
forms stay close to each other. The features of a word are its normalised kernel values to
the landmarks, whitened by the landmarks' own kernel matrix (Nyström); a linear support
vector machine on them scores the word. A text scores as its worst word, put on the scale of
probabilities by a logistic fit on labelled texts.

Training uses a bounded, documented sample of labelled texts. Labels are given per text, so
the words to blame are found first: letter groups that occur in toxic texts far more often
than chance allows (a bound that counts how many groups were tried). The words that hold
them are the positive examples and landmarks; words of clean texts are the negative ones.
"""

from __future__ import annotations

import heapq
import math
import re
import warnings
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from quayside.llm.common import clean_text, documents, map_texts

SPAN, DECAY, WINDOW = 5, 0.5, 22
# offsets of the second and third letter, and the weight of the spanned letters
_GAPS = [(j, k, DECAY ** (k + 1)) for k in range(2, SPAN) for j in range(1, k)]
# Digits and signs written for letters.
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
_NOT_LETTER = re.compile(r"[\W\d_]+")
_EDGE = "!$.,;:?\"'()[]{}<>|*#%&-_=+/\\`~"
# single letters in a row, parted by blanks or signs
_SPACED = re.compile(r"(?<!\w)(?:[^\W\d_][\s.\-_*]{1,2}){3,}[^\W\d_](?!\w)")


def normalize(token: str) -> str:
    """Letters of a lower-case token: signs at its ends go, inner ones and digits are read as
    the letters they stand for or dropped."""
    token = token.strip(_EDGE)
    if token.isalpha():
        return token
    return _NOT_LETTER.sub("", token.translate(_LEET)) if any(c.isalpha() for c in token) else ""


def tokens_of(text: str) -> set[str]:
    """Distinct lower-case tokens of a text, spaced-out words joined."""
    low = text.lower()
    out = set(low.split())
    for m in _SPACED.finditer(low):
        out.add(_NOT_LETTER.sub("", m.group()))
    return out


def windows_of(word: str) -> list[str]:
    if len(word) <= WINDOW:
        return [word]
    return [word[i:i + WINDOW] for i in range(0, len(word) - WINDOW // 2, WINDOW // 2)]


def _symbols(words: list[str]) -> np.ndarray:
    """Words as rows of letter codes from 1 to 63 (a to z own codes, others folded), with a
    mark at either end; 0 pads."""
    out = np.zeros((len(words), WINDOW + 2), np.int64)
    out[:, 0] = 62
    for i, w in enumerate(words):
        c = np.array([ord(x) for x in w], np.int64)
        out[i, 1:len(c) + 1] = np.where((c >= 97) & (c <= 122), c - 96, 27 + c % 35)
        out[i, len(c) + 1] = 63
    return out


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, weight) of every distinct three-letter subsequence of every word."""
    s = _symbols(words)
    rows, codes, weights = [], [], []
    for j, k, w in _GAPS:
        a, b, c = s[:, :-k], s[:, j:j - k], s[:, k:]
        r, at = np.nonzero(c)
        rows.append(r)
        codes.append((a[r, at] << 12) | (b[r, at] << 6) | c[r, at])
        weights.append(np.full(len(r), w))
    row, code, weight = np.concatenate(rows), np.concatenate(codes), np.concatenate(weights)
    key = row << 18 | code
    order = np.argsort(key, kind="stable")
    key, weight = key[order], weight[order]
    if not len(key):
        return row, code, weight
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[first] >> 18, key[first] & 0x3FFFF, np.add.reduceat(weight, first)


@dataclass
class KernelSvm:
    landmarks: list[str]
    weights: np.ndarray  # per landmark, whitening included
    bias: float
    text_weights: np.ndarray = field(default_factory=lambda: np.array([1.0, 0.0, 0.0, 0.0, 0.0]))
    kept: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        r, c, w = subsequences(self.landmarks)
        norm = np.sqrt(np.bincount(r, w * w, len(self.landmarks)))
        self.codes, at = np.unique(c, return_inverse=True)
        self.table = np.zeros((len(self.codes) + 1, len(self.landmarks)))
        self.table[at, r] = w / norm[r]
        self.place = np.full(1 << 18, len(self.codes), np.int32)
        self.place[self.codes] = np.arange(len(self.codes))

    def kernel(self, words: list[str]) -> np.ndarray:
        """Normalised kernel values, words x landmarks; words under three letters get zeros."""
        r, c, w = subsequences(words)
        norm = np.sqrt(np.maximum(np.bincount(r, w * w, len(words)), 1e-300))
        at = self.place[c]
        hit = np.flatnonzero(at < len(self.codes))
        out = np.zeros((len(words), len(self.landmarks)))
        if len(hit):
            rows, weight = r[hit], (w[hit] / norm[r[hit]])[:, None]
            first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
            out[rows[first]] = np.add.reduceat(self.table[at[hit]] * weight, first, axis=0)
        return out

    def margins(self, words: list[str]) -> np.ndarray:
        """Scores of words: the weighted sum of their kernel values. The sum over the landmarks
        is taken once per subsequence, not once per word."""
        per_code = np.append(self.table[:-1] @ self.weights, 0.0)
        out = []
        for i in range(0, len(words), 4096):
            n = len(words[i:i + 4096])
            r, c, w = subsequences(words[i:i + 4096])
            norm = np.sqrt(np.maximum(np.bincount(r, w * w, n), 1e-300))
            out.append(np.bincount(r, w * per_code[self.place[c]], n) / norm + self.bias)
        return np.concatenate(out or [np.zeros(0)])

    def score_texts(self, texts: list[str], max_kept: int = 1_000_000) -> list[float]:
        """Scores in 0 to 1; margins of seen tokens are remembered up to a bound."""
        bags = [tokens_of(t) for t in texts]
        kept = self.kept
        new = list({t for b in bags for t in b if t not in kept})
        units, owner = [], []
        for i, t in enumerate(new):
            for w in windows_of(normalize(t)):
                if len(w) >= 3:
                    units.append(w)
                    owner.append(i)
        best = np.full(len(new), self.bias)
        np.maximum.at(best, np.array(owner, np.int64), self.margins(units))
        found = dict(zip(new, best.tolist()))
        if len(kept) + len(found) > max_kept:
            found.update((t, kept[t]) for b in bags for t in b if t in kept)
            kept.clear()
        kept.update(found)
        z = np.array([self.text_features([kept[t] for t in b]) for b in bags]).reshape(-1, 5) @ self.text_weights
        return (1 / (1 + np.exp(-np.clip(z, -30, 30)))).tolist()

    def text_features(self, margins: list[float]) -> list[float]:
        """Of a text: how far its three worst words come over -0.5, the first of these also
        times the logarithm of its number of distinct words (a long text has more chances
        for one odd word), and one."""
        top = [max(0.0, min(2.0, m + 0.5)) for m in heapq.nlargest(3, margins)]
        top += [0.0] * (3 - len(top))
        return [*top, top[0] * math.log(max(len(margins), 1)) / 5, 1.0]


# -- training ----------------------------------------------------------------------------

def _groups(word: str) -> set[str]:
    """Letter groups of a word: 4 and 5 letters anywhere, 4 to 8 at the start, the whole word
    if it is short."""
    out = {word[i:i + n] for n in (4, 5) for i in range(len(word) - n + 1)}
    out.update("^" + word[:n] for n in range(4, min(8, len(word)) + 1))
    if len(word) <= 12:
        out.add(f"^{word}$")
    return out


def telling_groups(toxic: list[set[str]], clean: list[set[str]], most: int = 96) -> dict[str, list[str]]:
    """Letter groups whose surplus in toxic texts beats chance even for the number of groups
    tried (binomial bound), with the toxic-only words that hold them; chosen greedily by the
    uses of words they newly explain."""
    of_word = {w: _groups(w) for w in {w for b in toxic for w in b}}
    in_toxic: Counter[str] = Counter()
    for b in toxic:
        in_toxic.update({g for w in b for g in of_word[w]})
    seen = {g for g, n in in_toxic.items() if n >= 3}
    known: dict[str, set[str]] = {}
    in_clean: Counter[str] = Counter()
    for b in clean:
        for w in b:
            if w not in known:
                known[w] = _groups(w) & seen
        in_clean.update({g for w in b for g in known[w]})
    share = len(toxic) / (len(toxic) + len(clean))
    need = math.log(max(len(in_toxic), 1) / 0.01)

    def surplus(n_t: int, n_c: int) -> float:
        n, q = n_t + n_c, n_t / (n_t + n_c)
        if q <= share:
            return 0.0
        return n * (q * math.log(q / share) + ((1 - q) * math.log((1 - q) / (1 - share)) if q < 1 else 0.0))

    strong = {g for g in seen if in_clean[g] <= 0.02 * in_toxic[g] and surplus(in_toxic[g], in_clean[g]) >= need}
    uses = Counter(w for b in toxic for w in b)
    holders: dict[str, set[str]] = {g: set() for g in strong}
    for w, gs in of_word.items():
        if w not in known:  # words of clean texts are never to blame
            for g in gs & strong:
                holders[g].add(w)
    out: dict[str, list[str]] = {}
    covered: set[str] = set()
    while len(out) < most and holders:
        gain = {g: sum(uses[w] for w in ws - covered) for g, ws in holders.items()}
        g = max(holders, key=lambda g: (gain[g], -in_clean[g], len(g), g))
        if gain[g] < 3:
            break
        covered |= holders[g]
        out[g] = sorted(holders.pop(g), key=lambda w: (-uses[w], len(w), w))
    return out


def disguised(word: str, rng: np.random.Generator) -> str:
    """A copy with one or two letters inserted, doubled or dropped."""
    letters = list(word)
    for _ in range(int(rng.integers(1, 3))):
        i = int(rng.integers(1, len(letters)))
        kind = int(rng.integers(0, 3))
        if kind == 0:
            letters.insert(i, chr(97 + int(rng.integers(0, 26))))
        elif kind == 1:
            letters.insert(i, letters[i - 1])
        elif len(letters) > 5:
            letters.pop(i)
    return "".join(letters)


def train(toxic: list[set[str]], clean: list[set[str]], base_rate: float | None = None, seed: int = 11,
          landmarks_per_group: int = 3, max_negatives: int = 20_000) -> KernelSvm | None:
    """The model from the word sets of labelled texts, or None if the toxic texts have
    nothing in common that clean ones lack. ``base_rate`` is the share of toxic texts among
    all that the sample stands for (None: the share in the sample)."""
    rng = np.random.default_rng(seed)
    blamed = telling_groups(toxic, clean) if toxic and clean else {}
    if not blamed:
        return None
    in_clean = {w for b in clean for w in b}
    usual = sorted(w for w in in_clean if 3 <= len(w) <= WINDOW)
    marks = list(dict.fromkeys(w[:WINDOW] for ws in blamed.values() for w in ws[:landmarks_per_group]))
    first = KernelSvm(marks, np.zeros(len(marks)), 0.0)
    near = np.concatenate([first.kernel(usual[i:i + 2048]).max(1) for i in range(0, len(usual), 2048)] or [np.zeros(0)])
    closest = np.argsort(-near, kind="stable")
    # landmarks on the other side: the clean words closest to an insult, and some at random
    marks += [w for w in dict.fromkeys([usual[i] for i in closest[:96]] + [usual[i] for i in rng.permutation(len(usual))[:32]]) if w not in marks]
    svm = KernelSvm(marks, np.zeros(len(marks)), 0.0)
    picked = sorted({*closest[:max_negatives // 2].tolist(), *rng.permutation(len(usual))[:max_negatives // 2].tolist()})
    negative = [usual[i] for i in picked]
    positive = sorted({w[:WINDOW] for ws in blamed.values() for w in ws})
    bent = [disguised(w, rng)[:WINDOW] for w in positive if len(w) >= 5]
    positive += [w for w in bent if w not in in_clean]
    # Nyström features: kernel values whitened by the landmarks' own kernel matrix
    val, vec = np.linalg.eigh(svm.kernel(marks))
    white = vec / np.sqrt(np.maximum(val, 1e-2))
    parts = [svm.kernel(ws[i:i + 2048]) @ white for ws in (positive, negative) for i in range(0, len(ws), 2048)]
    y = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
    beta, svm.bias = _linear_svm(np.concatenate(parts), y)
    svm.weights = white @ beta
    _calibrate(svm, toxic, clean, base_rate)
    return svm


def _linear_svm(x: np.ndarray, y: np.ndarray, reg: float = 1e-5, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Squared hinge loss with both classes weighted alike, by Newton steps on the rows inside
    the margin."""
    d = np.concatenate([x, np.ones((len(x), 1))], 1)
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    ridge = np.diag(np.append(np.full(x.shape[1], reg), 1e-9))
    w = np.zeros(d.shape[1])
    for _ in range(rounds):
        inside = y * (d @ w) < 1
        a = d[inside] * weight[inside, None]
        new = np.linalg.solve(a.T @ d[inside] + ridge, a.T @ y[inside])
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w[:-1], float(w[-1])


def _calibrate(svm: KernelSvm, toxic: list[set[str]], clean: list[set[str]], base_rate: float | None = None) -> None:
    """Logistic fit of text labels on the text features, by damped Newton steps; the texts of
    either label weigh so much that their shares are those of all labelled texts."""
    bags = [*toxic, *clean]
    words = sorted({w for b in bags for w in b})
    flat = [(i, v) for i, w in enumerate(words) for v in windows_of(w) if len(v) >= 3]
    m = np.full(len(words), svm.bias)
    np.maximum.at(m, np.array([i for i, _ in flat], np.int64), svm.margins([v for _, v in flat]))
    of = dict(zip(words, m.tolist()))
    d = np.array([svm.text_features([of[w] for w in b]) for b in bags])
    y = np.concatenate([np.full(len(toxic), (len(toxic) + 1) / (len(toxic) + 2)), np.full(len(clean), 1 / (len(clean) + 2))])
    share = len(toxic) / len(bags)
    rate = share if base_rate is None else base_rate
    weight = np.concatenate([np.full(len(toxic), rate / share), np.full(len(clean), (1 - rate) / (1 - share))])
    w = np.zeros(5)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        h = d.T @ (d * (weight * p * (1 - p))[:, None]) + 0.05 * np.eye(5)
        w = w - np.clip(np.linalg.solve(h, d.T @ (weight * (p - y)) + 0.05 * w), -1, 1)
    svm.text_weights = w


def held_out(key: str):
    """True where CRC-32 of the key as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def labelled_bags(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
                  max_toxic: int = 1_500, max_clean: int = 2_500, max_words: int = 2_000_000) -> tuple[list[set[str]], list[set[str]], float]:
    """Word sets of toxic and of clean labelled texts, and the share of toxic ones among all
    labels that are not held out (counted in full, whatever the sample). The texts are not
    held out either: at most ``max_toxic`` toxic and ``max_clean`` clean ones (those with the smallest key hashes), and at most about
    ``max_words`` words: they are taken in hash order, and only a text that does not fit any
    more is left out (with a warning). A key labelled twice is toxic if any label says so; null labels do
    not count."""
    marks = labels.where(F.col(label_col).isNotNull() & F.col(key).isNotNull() & ~held_out(key)).groupBy(F.col(key).alias("k")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    counts = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}
    chosen = None
    for y, most in ((1, max_toxic), (0, max_clean)):
        part = marks.where(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    one = docs.select(F.col(key).alias("k"), clean_text(text_col).alias("t")).join(F.broadcast(chosen), "k")  # bounded above
    bags = map_texts(one, lambda ts: {"words": [" ".join(sorted({w for t in tokens_of(x) if (w := normalize(t))})) for x in ts]}, {"words": "string"}, "k", "t")
    rows = bags.join(F.broadcast(chosen), "k").select("k", "y", "words")
    toxic, clean, left, seen, skipped = [], [], max_words, {}, 0
    for r in rows.orderBy(F.xxhash64("k"), "k", "words").toLocalIterator():
        words = {seen.setdefault(w, w) for w in r.words.split(" ") if w}
        if len(words) > left:
            skipped += 1
            continue
        left -= len(words)
        (toxic if r.y else clean).append(words)
    if skipped:
        warnings.warn(f"{skipped} labelled texts left out of training: more than {max_words} words (max_words)")
    return toxic, clean, counts.get(1, 0) / max(counts.get(0, 0) + counts.get(1, 0), 1)


def toxicity_scores(docs: DataFrame, model: KernelSvm | None, base_rate: float = 0.0, key: str = "doc_id", text_col: str = "text",
                    threshold: float = 0.3) -> DataFrame:
    """Per row: the key, ``score`` (0 to 1) and ``predicted`` (1 if score >= threshold).

    Only the text is an input of the score. Null texts count as empty; without a model
    every text scores ``base_rate``; repeated rows stay; an empty table gives an empty
    result; other columns are ignored.
    """
    def fn(texts: list[str]) -> dict[str, list]:
        s = model.score_texts(texts) if model is not None else [base_rate] * len(texts)
        return {"score": s, "predicted": [int(x >= threshold) for x in s]}

    return map_texts(docs, fn, {"score": "double", "predicted": "int"}, key, text_col)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole document text, learnt from labels that are not held out."""
    docs = documents(spark, sf_dir)
    toxic, clean, base_rate = labelled_bags(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity_scores(docs, train(toxic, clean, base_rate), base_rate)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
