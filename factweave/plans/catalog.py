"""All registered queries of the library and the SQL beside them."""

from factweave.plans import extraction, grounding, naming, parties, results, substrate, verification

MODULES = (extraction, grounding, naming, parties, results, substrate, verification)

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in MODULES for name, sql in module.SQL.items()}
