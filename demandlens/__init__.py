"""demandlens: Spark-native analytics for long-format entity x item demand data.

Every operator is a function ``DataFrame(s) + parameters -> DataFrame`` that
stays lazy; the only actions are the small, explicitly documented decisions
(support fallback, rule tier) taken on bounded aggregates.

Layout:
    sources/    readers, writers, and the stand-in views over the driver tables
    functions/  Column-level helpers (text normalisation, coercion, matching)
    operators/  the analytic operators, one module per family
    plans/      the registered queries and their DuckDB oracle SQL
    streaming/  incremental (Structured Streaming) form of the frequency counts
"""

from demandlens.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
