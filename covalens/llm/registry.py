"""The queries and the SQL that ``__spark_entry__`` adds."""

from __future__ import annotations

import corpus_pipeline
from covalens.llm import preference, queries

QUERIES = {name: f for name, f in vars(queries).items() if name.startswith("op")} | {"pipeline": corpus_pipeline.run}
ORACLES: dict[str, str] = {"op4_preference_formatting": preference.ORACLE}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
