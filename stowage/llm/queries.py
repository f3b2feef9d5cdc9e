"""All queries of the training-data operators, and their SQL where there is any."""

from __future__ import annotations

from . import bpe, chat_format, decontaminate, embedding_dedup, html_extract, line_dedup, quality_classifier, secret_scan, simhash_dedup, suffix_dedup

MODULES = (bpe, chat_format, decontaminate, embedding_dedup, html_extract, line_dedup, quality_classifier, secret_scan, simhash_dedup, suffix_dedup)

QUERIES = {name: query for module in MODULES for name, query, _ in module.registered()}
ORACLES = {name: sql for module in MODULES for name, _, sql in module.registered() if sql}
