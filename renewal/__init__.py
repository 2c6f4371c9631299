"""renewal — Spark-native churn-modelling toolkit.

Sub-packages: ``sources`` (readers, writers, fixture frames), ``functions`` (column
expressions), ``operators`` (DataFrame → DataFrame steps), ``plans`` (composed flows and
the query catalog), ``streaming`` (incremental scoring).
"""

__version__ = "0.1.0"
