"""SQL that recomputes the registered queries for comparison."""


def all_sql() -> dict[str, str]:
    from oracle import rows, sets

    return {**rows.SQL, **sets.SQL}
