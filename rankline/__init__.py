"""rankline: rank history, rank features and rank prediction on Spark.

Everything is expressed with the DataFrame / SQL / Structured Streaming / ML
APIs; Catalyst chooses the physical plan.  Sub-packages:

* ``sources``   - table views, CSV ingest, insert-if-absent, leaderboard files
* ``functions`` - reusable column expressions (dates, factor arrays, rounding)
* ``operators`` - history windows, factor encodings, features, quality checks,
                  metrics and report tables
* ``plans``     - model pipelines (Spark ML) and the query catalogue
* ``streaming`` - idempotent micro-batch insert and scoring
"""

__version__ = "0.1.0"
