"""All registered queries of the tabular engine."""

from tallymill.plans import inventory, tabular

QUERIES = tabular.QUERIES | inventory.QUERIES
ORACLE_SQL = tabular.ORACLE_SQL | inventory.ORACLE_SQL
