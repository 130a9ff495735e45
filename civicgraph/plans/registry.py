"""Collects the named queries and the SQL each one is checked against."""

from ..sources.fixtures import view, view_sql

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` and its check SQL."""
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def ctes(*parts, body):
    """SQL text: fixture views and named sub-queries, then the body.

    A part is the name of a fixture view or a (name, sql) pair.
    """
    named = [(p, view_sql(p)) if isinstance(p, str) else p for p in parts]
    return "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in named) + "\n" + body


class Views:
    """Attribute access to the fixture views of one data folder."""

    def __init__(self, spark, sf_dir):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name):
        return view(self.spark, self.sf_dir, name)


# ---- SQL fragments the checks share -------------------------------------

def r_even(x, digits=0):
    return f"(round_even(CAST(({x}) AS DOUBLE) * CAST(1e{digits} AS DOUBLE), 0) / CAST(1e{digits} AS DOUBLE))"


def planar2(lat1, lon1, lat2, lon2):
    dy = f"(({lat1}) - ({lat2})) * CAST(111320 AS DOUBLE)"
    dx = f"(({lon1}) - ({lon2})) * CAST(85390 AS DOUBLE)"
    return f"(({dy}) * ({dy}) + ({dx}) * ({dx}))"


def deg2(lat1, lon1, lat2, lon2):
    return f"((({lat1}) - ({lat2})) * (({lat1}) - ({lat2})) + (({lon1}) - ({lon2})) * (({lon1}) - ({lon2})))"


def miles(lat1, lon1, lat2, lon2):
    s1 = f"sin((radians({lat2}) - radians({lat1})) / CAST(2 AS DOUBLE))"
    s2 = f"sin((radians({lon2}) - radians({lon1})) / CAST(2 AS DOUBLE))"
    return (f"(CAST(3959 AS DOUBLE) * CAST(2 AS DOUBLE) * asin(sqrt({s1} * {s1} + "
            f"cos(radians({lat1})) * cos(radians({lat2})) * {s2} * {s2})))")
