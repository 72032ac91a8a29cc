"""armada: evaluate language models on question tables and route questions
among them by quality and price, as Spark DataFrame jobs.

Sub-packages
------------
functions   column expressions (prompt text, answer parsing, vector algebra)
operators   DataFrame -> DataFrame operators (grading, sampling, statistics,
            routing, policy metrics, online learning, batch inference slots)
sources     readers for the input tables and the writers (sinks)
plans       the registered query catalogue and its DuckDB oracle SQL
streaming   Structured Streaming versions of scoring and learning
"""

from armada.config import RouterConfig, ARMS, ARM_PRICES  # noqa: F401

__version__ = "0.1.0"
