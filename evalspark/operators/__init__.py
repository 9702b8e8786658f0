"""DataFrame operators: metrics, statistics, sampling, comparison, reshaping, topics and scoring."""
