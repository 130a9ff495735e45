"""The queries of this folder and their check SQL."""

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` and, where SQL can express it, its check."""
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add
