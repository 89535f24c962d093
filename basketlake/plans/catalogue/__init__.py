"""Every operator as a named query over the given tables, with an independent SQL statement."""

from basketlake.plans.catalogue import (  # noqa: F401
    lines, customers, histories, analysis, recommending, evaluation, serving,
    modelling)
from basketlake.plans.catalogue import registry

QUERIES = dict(registry.QUERIES)
ORACLES = {name: registry.statement(sql) for name, sql in registry.ORACLES.items()}
