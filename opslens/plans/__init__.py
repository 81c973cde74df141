from opslens.plans.registry import all_queries, oracles  # noqa: F401
