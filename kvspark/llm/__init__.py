"""Training-data operators.

Self-contained: nothing outside this package imports it, and it imports nothing from the rest of the
library. Queries and their SQL are in :mod:`kvspark.llm.queries`.
"""
