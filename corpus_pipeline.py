"""Entry to the corpus pipeline of lodegrain.llm.pipeline: STAGES, run(spark, sf_dir) and ORACLE_SQL."""

from lodegrain.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
