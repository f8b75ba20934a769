"""riskmart: encounter-level readmission-risk analytics on Spark.

Subpackages:
  functions  column-expression builders and the fixed values they use
  sources    readers (CSV, code tables, views, streams) and sinks (versioned layers,
             insert-or-ignore, batch partitions, exports, models)
  operators  skew-safe order operators, aggregates, bounded exact quantiles,
             profiles, joins, top-k and samples, validation, ML
  plans      the encounter adapter, warehouse and feature jobs, operational
             load, and the registered queries with their SQL oracles
  streaming  the Structured Streaming live path and stateful aggregates
"""
