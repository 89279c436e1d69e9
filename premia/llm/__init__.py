"""Operators of a large-scale training-data pipeline and their registered queries."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with the query, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def all_queries():
    from premia.llm import queries

    return dict(queries.QUERIES)


def all_sql() -> dict[str, str]:
    from premia.llm import checks

    return dict(checks.SQL)
