"""Registered queries: a Spark callable, and the SQL that must give the same rows."""

QUERIES = {}
SQL = {}


def query(name: str, sql: str = None):
    """Register ``fn(spark, sf_dir) -> DataFrame``; without ``sql`` it is checked by tests only."""
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add
