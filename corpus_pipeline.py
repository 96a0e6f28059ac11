"""A training corpus in five stages; each takes (spark, docs, sf_dir) and returns a DataFrame.

The stages live in lagspark.llm.pipeline: language ID, line dedup, MinHash near-dedup, mixing
of sources, SentencePiece encoding. run(spark, sf_dir) applies them to documents.
"""

from __future__ import annotations

from lagspark.llm.pipeline import (
    ORACLE_SQL, STAGES, drop_boilerplate_lines, drop_near_duplicates, identify_language, mix_sources, run, tokenize,
)

__all__ = ["ORACLE_SQL", "STAGES", "drop_boilerplate_lines", "drop_near_duplicates", "identify_language", "mix_sources", "run", "tokenize"]
