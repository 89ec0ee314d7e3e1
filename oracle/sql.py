"""All checking SQL, by query name."""

from oracle import business, explore, forecast, inventory, policy, profit, sources


def all_sql() -> dict[str, str]:
    return {**inventory.SQL, **business.SQL, **explore.SQL, **policy.SQL, **forecast.SQL, **profit.SQL, **sources.SQL}
