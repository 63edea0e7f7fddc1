"""Training-data operators: near-duplicate removal, quality rules, tokenising,
classifiers, mixing, chat formatting and fingerprints over a table of texts.

Nothing outside this subpackage imports it.  ``queries`` holds the thin
registered queries and their SQL oracles."""
