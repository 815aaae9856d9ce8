"""BPE encoding and decoding by a prefix-sharing trie.

A byte-pair encoding has a useful property: a token sequence is the encoding of its bytes
exactly when every two neighbours are (the encoding of the two tokens' bytes is those two
tokens). So each prefix of a word has one *last token*: the token ending there that fits
behind the last token of what is left before it. The encoder puts the distinct words of a
batch into a trie and walks it depth first, passing the last tokens down: what words share
as a prefix is encoded once, and a word's encoding is read off by jumping back from its
node. The work is linear in the number of trie nodes, also for words of megabytes.

Texts stay where they are: the encoder runs inside ``mapInArrow`` without a shuffle, and
each worker remembers encoded pieces up to a bound.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
from array import array
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession

from quayside.llm.common import documents, map_texts, tokenizer_path
from quayside.llm.token_counts import _PIECE

# Fixed value: the byte-level pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_NEVER = 1 << 60


def byte_alphabet() -> dict[str, int]:
    """Printable character of a vocabulary file to the byte it stands for: printable Latin-1
    characters stand for themselves, the other bytes for 256, 257, ... in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class TrieBpe:
    """Encoder and decoder for a byte-level BPE vocabulary file (``tokenizers`` JSON)."""

    def __init__(self, path: str, max_pieces: int = 400_000, max_pairs: int = 1_000_000, longest_kept: int = 64):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec["normalizer"]:
            raise ValueError(f"not a plain byte-level BPE vocabulary: {path}")
        self.max_pieces, self.max_pairs, self.longest_kept = max_pieces, max_pairs, longest_kept
        alphabet = byte_alphabet()
        as_bytes = lambda s: bytes(alphabet[c] for c in s)
        self.bytes_of = {i: as_bytes(t) for t, i in model["vocab"].items()}
        self.special = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        self.bytes_of.update({i: t.encode() for t, i in self.special.items()})
        vocab = {as_bytes(t): i for t, i in model["vocab"].items()}
        # rank at which a token is made, and the two tokens it is made of
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            x, y, t = model["vocab"][a], model["vocab"][b], model["vocab"][a + b]
            if (x, y) not in self.merged:
                self.merged[x, y] = t
            if t not in self.parts:
                self.rank[t], self.parts[t] = r, (x, y)
        self._right: dict[int, list[int]] = {}
        self._left: dict[int, list[int]] = {}
        self.pairs: dict[int, bool] = {}
        # A token counts only if its own bytes encode to it: its two halves must be such
        # tokens, and the merge of the halves must be the one that makes it.
        own: dict[int, bool] = {}
        for t in sorted(vocab.values(), key=lambda t: self.rank.get(t, -1)):
            own[t] = t not in self.parts or (own[self.parts[t][0]] and own[self.parts[t][1]] and self._halves_meet(t))
        self.vocab = {b: t for b, t in vocab.items() if own[t]}
        tails: dict[bytes, set[int]] = {}
        for b in self.vocab:
            if len(b) > 1:
                tails.setdefault(b[-2:], set()).add(len(b))
        # lengths of the tokens that end with these two bytes, longest first
        self.tails = {k: tuple(sorted(v, reverse=True)) for k, v in tails.items()}
        self.byte_token = [vocab[bytes([b])] for b in range(256)]
        self.pieces, self.words, self._table = _Numbered(), {}, None
        self._special_at = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self._pattern = regex.compile(PATTERN)

    # -- which two tokens may stand side by side -------------------------------------

    def _edge(self, t: int, side: int) -> list[int]:
        """Tokens that stand at the right (side 1) or left (0) end of ``t`` while it is
        built, from the single byte up to ``t``."""
        memo = self._right if side else self._left
        if t not in memo:
            memo[t] = [*(self._edge(self.parts[t][side], side) if t in self.parts else []), t]
        return memo[t]

    def _first_bridge(self, a: int, b: int) -> int | None:
        """The first merge across the border while a's and b's bytes are built side by side,
        or None if both get complete before any."""
        left, right = self._edge(a, 1), self._edge(b, 0)
        i = j = 0
        while True:
            grow_a = self.rank[left[i + 1]] if i + 1 < len(left) else _NEVER
            grow_b = self.rank[right[j + 1]] if j + 1 < len(right) else _NEVER
            c = self.merged.get((left[i], right[j]))
            # of equal ranks the leftmost pair merges first: a's own growth, the bridge, b's
            if c is not None and self.rank[c] < grow_a and self.rank[c] <= grow_b:
                return c if i + 1 == len(left) and j + 1 == len(right) else -1
            if grow_a == grow_b == _NEVER:
                return None
            if grow_a <= grow_b:
                i += 1
            else:
                j += 1

    def _halves_meet(self, t: int) -> bool:
        return self._first_bridge(*self.parts[t]) == t

    def fits(self, a: int, b: int) -> bool:
        """True if the bytes of a and b together encode to [a, b]."""
        key = a << 20 | b
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) >= self.max_pairs:
                self.pairs.clear()
            ok = self.pairs[key] = self._first_bridge(a, b) is None
        return ok

    # -- the trie ----------------------------------------------------------------------

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Encodings of distinct words, in the order given.

        Sorted words visit the nodes of their trie depth first, so the branch down to a word
        is the common prefix with the word before it and what the word adds; only the
        added nodes are worked out, from the last tokens of the branch.
        """
        order = sorted(range(len(words)), key=words.__getitem__)
        out: list[list[int]] = [[] for _ in words]
        last, size = [0], [0]  # the branch: last token and its length by depth
        vocab, tails, fits, pairs, single = self.vocab, self.tails, self.fits, self.pairs, self.byte_token
        for w, shared in zip(order, shared_prefixes([words[i] for i in order])):
            word = words[w]
            del last[shared + 1:], size[shared + 1:]
            for d in range(shared + 1, len(word) + 1):
                for n in tails.get(word[d - 2:d], ()) if d > 1 else ():
                    if n < d:
                        t = vocab.get(word[d - n:d])
                        if t is not None:
                            key = last[d - n] << 20 | t
                            ok = pairs.get(key)
                            if ok or ok is None and fits(last[d - n], t):
                                break
                    elif n == d:
                        t = vocab.get(word[:d])
                        if t is not None:
                            break
                else:
                    t, n = single[word[d - 1]], 1
                last.append(t)
                size.append(n)
            ids, d = out[w], len(word)
            while d:
                ids.append(last[d])
                d -= size[d]
            ids.reverse()
        return out

    # -- texts -------------------------------------------------------------------------

    def _segments(self, piece: str):
        """Runs between special strings, and the specials' ids."""
        at = 0
        if self._special_at is not None:
            for m in self._special_at.finditer(piece):
                yield piece[at:m.start()], self.special[m.group()]
                at = m.end()
        yield piece[at:], None

    def _words_of(self, piece: str) -> list:
        """Words and special ids of a piece; most pieces are one word of letters."""
        if piece.isalpha() or piece[:1] == " " and piece[1:].isalpha():
            return [piece]
        if any(x in piece for x in self.special):
            out: list = []
            for run, special in self._segments(piece):
                out += self._pattern.findall(run)
                if special is not None:
                    out.append(special)
            return out
        return self._pattern.findall(piece)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers.

        Texts become numbers of pieces first, so that the new pieces, and of these the new
        words, of the whole batch meet in one trie."""
        kept = self.pieces
        if len(kept.coded) > self.max_pieces:
            kept.clear()
            kept.coded, kept.new = [], []
        number = kept.__getitem__
        cut = [array("I", map(number, _PIECE.findall(t))) for t in texts]
        new, kept.new = kept.new, []
        if len(self.words) > self.max_pieces:
            self.words.clear()
        plans, index, words = [], {}, self.words
        for p in new:
            plan = self._words_of(p)
            plans.append(plan)
            for w in plan:
                if w.__class__ is str and w not in words:
                    index[w] = None
        for w, ids in zip(index, self.encode_words([w.encode("utf-8") for w in index])):
            words[w] = struct.pack(f"<{len(ids)}I", *ids)
        for p, plan in zip(new, plans):
            kept.coded[kept[p]] = words[plan[0]] if len(plan) == 1 and plan[0].__class__ is str else b"".join(
                [words[w] if w.__class__ is str else struct.pack("<I", w) for w in plan])
        out = [b"".join(map(kept.coded.__getitem__, ps)) for ps in cut]
        for p in new:  # a number is never given twice, so a forgotten long piece leaves an empty place
            if len(p) > self.longest_kept:
                kept.coded[kept.pop(p)] = b""
        for w in index:
            if len(w) > self.longest_kept:
                del words[w]
        return out

    def decode(self, ids: bytes, step: int = 1 << 18) -> str:
        """Text of the ids; bytes that are not UTF-8 become replacement characters.

        One gather per ``step`` tokens: each token's bytes lie in a row in one table."""
        if self._table is None:
            size = [len(self.bytes_of.get(i, b"")) for i in range(max(self.bytes_of) + 1)]
            ends = np.cumsum(size)
            self._table = (np.frombuffer(b"".join([self.bytes_of.get(i, b"") for i in range(len(size))]), np.uint8), ends - size, np.array(size))
        table, starts, sizes = self._table
        out = []
        tokens = np.frombuffer(ids, "<u4")
        for at in range(0, len(tokens), step):
            part = tokens[at:at + step]
            size = sizes[part]
            ends = np.cumsum(size)
            out.append(table[np.repeat(starts[part] - ends + size, size) + np.arange(ends[-1])].tobytes())
        return b"".join(out).decode("utf-8", "replace")


class _Numbered(dict):
    """Pieces to numbers; a new piece gets the next one. ``coded`` holds the encoding of each."""

    def __init__(self):
        super().__init__()
        self.coded: list[bytes] = []
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self.coded)
        self.coded.append(b"")
        self.new.append(piece)
        return n


def shared_prefixes(words: list[bytes], wide: int = 24) -> list[int]:
    """Length of the common prefix of each of the sorted words with the word before it."""
    n = len(words)
    if not n:
        return []
    cells = np.frombuffer(b"".join([w[:wide].ljust(wide, b"\0") for w in words]), np.uint8).reshape(n, wide)
    lengths = np.fromiter(map(len, words), np.int64, n)
    same = cells[1:] == cells[:-1]
    first = np.where(same.all(1), wide, same.argmin(1))
    out = [0, *np.minimum(first, np.minimum(lengths[1:], lengths[:-1])).tolist()]
    for i in np.flatnonzero(np.array(out) >= wide).tolist():
        out[i] = _common(words[i - 1], words[i])
    return out


def _common(a: bytes, b: bytes) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    return low


@lru_cache(maxsize=2)
def _codec(path: str) -> TrieBpe:
    return TrieBpe(path)


def _open(tokenizer: str) -> TrieBpe:
    return _codec(tokenizer if os.path.isabs(tokenizer) else tokenizer_path(tokenizer))


def bpe_encode(docs: DataFrame, tokenizer: str, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the key, ``ids`` (binary, little-endian unsigned 32-bit) and ``n_tokens``.

    ``tokenizer`` names a byte-level BPE file of the installed vocabularies or is a path
    that every node has. Special strings inside a text become their special ids. Null texts
    encode as empty texts (no ids); repeated rows stay; other columns are ignored.
    """
    def fn(texts: list[str]) -> dict[str, list]:
        ids = _open(tokenizer).encode_batch(texts)
        return {"ids": ids, "n_tokens": [len(x) // 4 for x in ids]}

    return map_texts(docs, fn, {"ids": "binary", "n_tokens": "bigint"}, key, text_col)


def bpe_decode(encoded: DataFrame, tokenizer: str, key: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: the key and ``text``, the decoded ids (null ids: the empty text)."""
    from pyspark.sql import functions as F

    src = encoded.select(F.col(key), F.coalesce(F.hex(F.col(ids_col)), F.lit("")).alias("h"))

    def fn(hexes: list[str]) -> dict[str, list]:
        codec = _open(tokenizer)
        return {"text": [codec.decode(bytes.fromhex(h)) for h in hexes]}

    return map_texts(src, fn, {"text": "string"}, key, "h")


def bpe_round_trip(docs: DataFrame, tokenizer: str, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, decode its ids again, and return ``n_tokens`` with the SHA-256 of
    both: ``ids_sha256`` over the ids as little-endian unsigned 32-bit integers,
    ``decoded_sha256`` over the decoded text in UTF-8. Both directions run on the same
    batch, so the ids are never shuffled or written. Nulls and repeats as in
    :func:`bpe_encode`."""
    def fn(texts: list[str]) -> dict[str, list]:
        codec = _open(tokenizer)
        coded = codec.encode_batch(texts)
        return {"n_tokens": [len(x) // 4 for x in coded],
                "ids_sha256": [hashlib.sha256(x).hexdigest() for x in coded],
                "decoded_sha256": [hashlib.sha256(codec.decode(x).encode("utf-8")).hexdigest() for x in coded]}

    return map_texts(docs, fn, {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}, key, text_col)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every whole document text with the byte-level 50k vocabulary."""
    return bpe_round_trip(documents(spark, sf_dir), "byte_bpe_50k.json")
