"""Training-data operators: packing, token stores, search, tokenisation, filters, deduplication, formatting.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it, so the rest of the engine works without it.
"""
