"""Named query plans over the driver tables, each with a DuckDB oracle where SQL can state it.

Importing this package registers every plan; ``queries()`` / ``oracle_sql()`` expose them.
"""

from kiln.plans.registry import queries, oracle_sql, REGISTRY, ORACLE  # noqa: F401
from kiln.plans import q_profile, q_prep, q_dist, q_eval, q_models, q_io  # noqa: F401,E402
