"""Driver queries of the corpus operators and the DuckDB statements of those that SQL can
express."""

from __future__ import annotations

from quayside.llm import (bpe, mixing, pii, prefix_trie, quality, secrets, sharding, simhash, token_counts, topk, toxicity, warc,
                          whitening)

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_mixing": mixing.op2_mixing,
    "op3_simhash": simhash.op3_simhash,
    "op4_topk": topk.op4_topk,
    "op5_secrets": secrets.op5_secrets,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_quality": quality.op7_quality,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_sharding": sharding.op9_sharding,
    "op10_pii": pii.op10_pii,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_warc": warc.op12_warc,
    "op13_whitening": whitening.op13_whitening,
}

SQL = {"op4_topk": topk.SQL, "op11_prefix_trie": prefix_trie.SQL, "op12_warc": warc.SQL}
