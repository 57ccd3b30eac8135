"""The same views and queries as DuckDB statements."""

from __future__ import annotations

VIEWS = {
    "fn": "SELECT p_partkey AS id, p_name AS name, p_type AS file, p_brand AS service, p_size AS start_line, p_size + 9 AS end_line FROM part",
    "hop": "SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS dst, l_discount FROM lineitem WHERE l_returnflag = 'R'",
    "sites": "SELECT src, dst, max(CASE WHEN l_discount < 0.04 THEN 0.95 WHEN l_discount < 0.08 THEN 0.85 ELSE 0.7 END)::DOUBLE AS confidence, count(*) AS sites FROM hop WHERE dst IS NOT NULL GROUP BY src, dst",
    "calls": "SELECT src, dst, confidence FROM sites",
    "res": "SELECT DISTINCT l_partkey AS src, CASE l_suppkey % 3 WHEN 0 THEN 'CONNECTS_TO' WHEN 1 THEN 'PRODUCES_TO' ELSE 'CONSUMES_FROM' END AS type, l_suppkey AS dst FROM lineitem WHERE l_linestatus = 'F'",
    "prod": "SELECT DISTINCT l_suppkey AS node, l_partkey AS hub FROM lineitem WHERE l_linestatus = 'F'",
    "cons": "SELECT DISTINCT l_suppkey AS node, l_partkey AS hub FROM lineitem WHERE l_linestatus = 'O'",
    "pagep": "SELECT page_id, url, coalesce(nullif(regexp_replace(split_part(lower(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1)), '?', 1), '/+$', ''), ''), '/') AS path FROM pages",
    "routes": "SELECT page_id AS handler, 's' || (page_id % 3) AS service, CASE WHEN page_id % 2 = 0 THEN path ELSE regexp_extract(path, '^(/[^/]*)', 1) || '/{id}' END AS route, CASE WHEN page_id % 3 = 0 THEN 'POST' ELSE 'GET' END AS method FROM pagep",
    "callers": "SELECT page_id AS caller, 's' || (page_id % 4) AS service, url, path FROM pagep",
    "ev": "SELECT event_id, ts, user_id, event_type AS query, user_id % 500 AS top_id, least(value / 100, 1.0)::DOUBLE AS top_score FROM events",
    "kw": "SELECT CASE WHEN doc_id % 3 = 0 THEN 'Class' ELSE 'Function' END AS label, source || '_' || doc_id AS name, lang AS file, text AS docstring, source AS service FROM documents",
    "before": "SELECT DISTINCT '/' || o_orderpriority || '/' || o_custkey AS path, o_orderstatus AS method FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01'",
    "after": "SELECT DISTINCT '/' || o_orderpriority || '/' || o_custkey AS path, o_orderstatus AS method FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01'",
    "art": "SELECT doc_id AS id, ['test_log', 'diff', 'terminal_output', 'document'][doc_id % 4 + 1] AS kind, text AS content FROM documents",
    "stamped": "SELECT c_mktsegment AS label, c_custkey AS id, CASE WHEN c_custkey % 11 <> 0 THEN CASE WHEN c_custkey % 13 = 0 THEN '0.9' ELSE '1.0' END END AS schema_version, CASE WHEN c_nationkey <> 3 THEN c_nationkey END AS first_seen, c_custkey AS last_seen, CASE WHEN c_acctbal > 0 THEN 'scan' END AS source FROM customer",
    "deg_in": "SELECT dst AS id, count(*) AS fan_in FROM calls GROUP BY dst",
    "deg_out": "SELECT src AS id, count(*) AS blast_radius FROM calls GROUP BY src",
}
_NEEDS = {"sites": ["hop"], "calls": ["hop", "sites"], "routes": ["pagep"], "callers": ["pagep"], "deg_in": ["hop", "sites", "calls"], "deg_out": ["hop", "sites", "calls"]}


def using(*names: str, sql: str) -> str:
    """A statement with the named views in front."""
    order: list[str] = []
    for name in names:
        for need in [*_NEEDS.get(name, []), name]:
            if need not in order:
                order.append(need)
    views = ", ".join(f"{n} AS ({VIEWS[n]})" for n in order)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {views}, {body[14:]}"
    if body.upper().startswith("WITH"):
        return f"WITH {views}, {body[4:]}"
    return f"WITH {views} {body}"
