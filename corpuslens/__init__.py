"""DataFrame operators for corpus analytics, evidence mining, reuse, and run history on Spark."""
