"""tabloom: Spark-native preparation, profiling and modelling of wide project-effort tables.

Subpackages: ``sources`` (scans/sinks), ``functions`` (column expressions),
``operators`` (DataFrame -> DataFrame operators and fitted plans),
``plans`` (the fitted preprocessing plan and the registered queries),
``streaming`` (Structured Streaming scoring and windowed summaries).
"""

__version__ = "0.1.0"
