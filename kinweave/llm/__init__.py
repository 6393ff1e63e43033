"""Operators for preparing language-model training data, each a Spark job.

Nothing outside this subpackage imports it; ``queries.py`` lists the registered queries
and ``oracles.py`` their SQL.
"""
