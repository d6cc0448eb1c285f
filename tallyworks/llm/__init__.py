"""Operators of a training-data pipeline; one module per operator, each with its query.

Nothing outside this folder, ``corpus_pipeline.py`` and ``__spark_entry__.py``
imports it.
"""

from tallyworks.llm.registry import ORACLES, QUERIES  # noqa: F401
from tallyworks.llm import (  # noqa: F401
    conversations,
    decontamination,
    html_wrappers,
    language,
    lexical_search,
    line_quality,
    maxent_lm,
    mixing,
    packing,
    periodic_runs,
    pii_tagger,
    simhash,
    substrings,
)
