"""From raw documents to packed training sequences; the stages are in siftmill.llm.pipeline, and this file goes with that subpackage."""

from siftmill.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
