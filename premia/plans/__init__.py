"""Compositions of operators and the registry of runnable queries."""


def all_queries():
    from premia.plans import checks_models, checks_rows, checks_sets  # noqa: F401
    from premia.plans.registry import QUERIES

    return dict(QUERIES)
