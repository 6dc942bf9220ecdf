"""edgeloom: a Spark-first engine for missing-edge benchmarks on large graphs."""

__version__ = "0.1.0"
