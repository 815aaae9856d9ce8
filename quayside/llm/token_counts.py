"""Token counts: batch encoding inside Arrow functions, lengths only.

Each text is cut at safe boundaries (before white space that follows a non-space
character): no pre-token of the byte-level pattern and no word of the other public
vocabularies reaches across one, so the pieces' counts add up to the text's count. Distinct
pieces are encoded once per worker in batches of about equal bytes; only their lengths are
kept. There is no shuffle, and a very long text is never encoded in one call unless it
has no safe boundary.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from quayside.llm.common import documents, map_texts, tokenizer_path

# Fixed value: the characters with the Unicode property White_Space, which the vocabularies'
# patterns mean by \s (Python's own \s has U+001C to U+001F as well).
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# a piece: white space and the run of other characters behind it
_PIECE = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")


class PieceCounter:
    """Token counts of texts by one vocabulary; remembers the counts of up to
    ``max_pieces`` distinct pieces (then starts afresh, so memory is bounded)."""

    def __init__(self, path: str, batch_bytes: int = 1 << 18, max_pieces: int = 1_000_000, longest_kept: int = 64):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.batch_bytes, self.max_pieces, self.longest_kept = batch_bytes, max_pieces, longest_kept
        self.kept: dict[str, int] = {}
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.no_truncation()
            tok.no_padding()
            self._encode = lambda xs: [len(e.ids) for e in tok.encode_batch_fast(xs, add_special_tokens=False)]
            self.cut = self._byte_level(tok)
        else:
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            self._encode = lambda xs: [len(e) for e in sp.encode(xs, num_threads=1)]
            self.cut = False  # its normaliser adds and merges blanks, so texts stay whole

    @staticmethod
    def _byte_level(tok) -> bool:
        """Cutting is exact for a byte-level pre-tokenizer without a normaliser."""
        import json

        spec = json.loads(tok.to_str())
        pre = spec.get("pre_tokenizer") or {}
        plain = all(not (a["lstrip"] or a["rstrip"] or a["single_word"] or re.search(r"\s", a["content"]))
                    for a in spec.get("added_tokens", []))
        return (spec.get("normalizer") is None and pre.get("type") == "ByteLevel"
                and pre.get("use_regex", True) and not pre.get("add_prefix_space") and plain)

    def encode_lengths(self, pieces: list[str]) -> list[int]:
        """Lengths of the pieces' encodings, in batches balanced by bytes."""
        out, batch, size = [], [], 0
        for p in pieces:
            batch.append(p)
            size += len(p)
            if size >= self.batch_bytes:
                out += self._encode(batch)
                batch, size = [], 0
        return out + (self._encode(batch) if batch else [])

    def count(self, texts: list[str]) -> list[int]:
        if not self.cut:
            return self.encode_lengths(texts)
        kept = self.kept
        cut = [_PIECE.findall(t) for t in texts]
        new = list({p for ps in cut for p in ps if p not in kept})
        found = dict(zip(new, self.encode_lengths(new)))
        if len(kept) + len(found) > self.max_pieces:
            # pieces of this batch that were known must stay known until it is counted
            found.update((p, kept[p]) for ps in cut for p in ps if p in kept)
            kept.clear()
        kept.update(found)
        out = [sum(map(kept.__getitem__, ps)) for ps in cut]
        for p in found:
            if len(p) > self.longest_kept:
                kept.pop(p, None)
        return out


@lru_cache(maxsize=2)
def _counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def token_counts(docs: DataFrame, tokenizer: str, key: str = "doc_id", text_col: str = "text",
                 limit: int = 1024) -> DataFrame:
    """Per row: the key, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (n_tokens > limit).

    ``tokenizer`` names a file of the installed vocabularies (``.json``: tokenizers,
    ``.model``: sentencepiece) or is a path that every node has. No special tokens are
    added; special strings inside a text count as the library treats them by default.
    Null texts count as empty (0 tokens); repeated rows are counted each; an empty table
    gives an empty table; other columns are ignored.
    """
    def fn(texts: list[str]) -> dict[str, list]:
        path = tokenizer if os.path.isabs(tokenizer) else tokenizer_path(tokenizer)
        n = _counter(path).count(texts)
        return {"n_bytes": [len(t.encode("utf-8")) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

    return map_texts(docs, fn, {"n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"}, key, text_col)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole document text by the byte-level 50k vocabulary."""
    return token_counts(documents(spark, sf_dir), "byte_bpe_50k.json")
