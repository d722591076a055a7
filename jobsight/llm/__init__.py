"""Training-data operators: deduplication, decontamination, tokenization, extraction and curation.

Nothing outside this folder imports it. Every operator takes DataFrames, reads whole tables and whole
texts, and returns a DataFrame; the registered queries are in ``jobsight.llm.queries``.
"""
