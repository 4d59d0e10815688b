"""The corpus pipeline: stages and their run are in :mod:`plait.llm.stages`."""

from plait.llm.stages import ORACLE_SQL, STAGES, run  # noqa: F401
