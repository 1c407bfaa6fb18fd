"""All registered queries and their checking SQL."""

from workload import comparison, evaluation, extraction, jobs, merging, outcomes, preparation, scripting, storage

MODULES = [extraction, outcomes, evaluation, preparation, comparison, scripting, storage, jobs, merging]

QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
