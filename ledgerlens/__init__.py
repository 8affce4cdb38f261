"""ledgerlens — Spark-native transaction risk analytics.

Every operator is ``DataFrame -> DataFrame`` on the public PySpark API:
sources (``ledgerlens.sources``), scalar column functions
(``ledgerlens.functions``), relational / graph / metric / drift operators
(``ledgerlens.operators``), composed jobs (``ledgerlens.plans``) and
Structured Streaming jobs (``ledgerlens.streaming``).
"""

__version__ = "0.1.0"
