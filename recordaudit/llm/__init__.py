"""Training-data operators: URL filter, decontamination, fingerprints, language
ID, language-model scoring, secret scan, WARC, near-duplicate join,
SentencePiece coding and sharding.  Nothing else in the library imports this
subpackage; its queries are in :mod:`recordaudit.llm.catalog`.
"""
