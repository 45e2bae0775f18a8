"""The corpus pipeline of ledgerfold.llm: STAGES, run(spark, sf_dir) and ORACLE_SQL."""

from ledgerfold.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
