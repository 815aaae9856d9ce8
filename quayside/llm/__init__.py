"""Operators for building training corpora: tokenising, mixing, near-duplicates, search,
secrets, personal data, quality, toxicity, sharding, shared conversation prefixes, web
archives and whitened embeddings.

Nothing else in the library imports this package; the driver entry adds its queries when
the package is there. Conventions shared by all operators:

* input columns are chosen by name, every other column is ignored, so extra columns with
  any name are harmless;
* a null text counts as the empty text, empty tables give empty results;
* a repeated row is a row of its own and is kept.
"""
