"""evalspark: evaluate free-text classifiers with PySpark DataFrames.

Sub-packages
- ``functions``: Column builders (words, crop, prompt templates, response parsers, stub predictor).
- ``operators``: DataFrame operators (metrics, statistics, sampling, comparison, reshaping, topics, scoring).
- ``sources``: readers, validators, run-log tables and sinks.
- ``plans``: the registered queries and their DuckDB oracle SQL.
- ``streaming``: the streaming scoring job.
"""

__version__ = "0.1.0"
