"""All queries of the library and their SQL."""

from . import queries_files, queries_more, queries_people, queries_results, queries_rules, queries_timeline

QUERIES = {k: f for m in (queries_files, queries_people, queries_timeline, queries_results, queries_more, queries_rules) for k, f in m.QUERIES.items()}
SQL = {k: s for m in (queries_files, queries_people, queries_timeline, queries_results, queries_more, queries_rules) for k, s in m.SQL.items()}
