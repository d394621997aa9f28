"""The corpus pipeline of `sparkloom.llm.pipeline`: its stages, its run and its SQL."""

from sparkloom.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
