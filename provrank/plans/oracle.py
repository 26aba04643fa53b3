"""DuckDB statements of the fixtures and of PageRank, from which the queries' oracles are put together."""

from __future__ import annotations

_WEIGHT = "CASE {c} WHEN 'cites' THEN 1.0 WHEN 'cited_by' THEN 1.0 WHEN 'authored_by' THEN 0.6 WHEN 'wrote' THEN 0.6 WHEN 'published_in' THEN 0.3 WHEN 'published' THEN 0.3 ELSE 0.5 END"
_REVERSE = "CASE rel WHEN 'cites' THEN 'cited_by' WHEN 'authored_by' THEN 'wrote' WHEN 'published_in' THEN 'published' ELSE rel END"

_TAIL = f"""
edges AS MATERIALIZED (SELECT 'e' || substr(sha1(src || chr(31) || rel || chr(31) || dst), 1, 16) AS edge_id, src, rel, dst, weight FROM raw_edges),
papers AS MATERIALIZED (SELECT b.*, coalesce(c.n, 0) AS citation_count FROM base_papers b LEFT JOIN (SELECT dst, count(*) AS n FROM edges WHERE rel = 'cites' GROUP BY 1) c ON c.dst = b.paper_id),
nodes AS MATERIALIZED (SELECT paper_id AS node_id, 'paper' AS kind, paper_id AS label FROM papers
  UNION ALL SELECT DISTINCT dst, split_part(dst, ':', 1), split_part(dst, ':', 2) FROM edges WHERE rel <> 'cites'),
arcs AS MATERIALIZED (SELECT edge_id, src, rel, dst, weight * {_WEIGHT.format(c="rel")} AS weight FROM edges
  UNION ALL SELECT edge_id, dst, {_REVERSE}, src, weight * {_WEIGHT.format(c=f"({_REVERSE})")} FROM edges),
tr AS MATERIALIZED (SELECT *, weight / sum(weight) OVER (PARTITION BY src) AS p FROM arcs),
seed AS (SELECT paper_id AS s FROM papers ORDER BY citation_count DESC, paper_id LIMIT 1)"""

F1 = (
    """WITH RECURSIVE
o AS (SELECT 'P' || lpad(o_orderkey::VARCHAR, 10, '0') AS paper_id, * FROM orders),
prior AS (SELECT paper_id, unnest([lag(paper_id, 1) OVER w, lag(paper_id, 2) OVER w]) AS ref FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
li AS (SELECT l_orderkey, l_partkey, 1 / (1 + avg(l_discount)) AS w FROM lineitem GROUP BY 1, 2),
li2 AS (SELECT * FROM li WHERE l_partkey IN (SELECT l_partkey FROM li GROUP BY 1 HAVING count(*) >= 2)),
raw_edges AS (
  SELECT paper_id AS src, 'cites' AS rel, ref AS dst, 1.0::DOUBLE AS weight FROM prior WHERE ref IS NOT NULL
  UNION ALL SELECT paper_id, 'authored_by', 'author:' || lpad(o_custkey::VARCHAR, 10, '0'), 1.0 FROM o
  UNION ALL SELECT paper_id, 'published_in', 'venue:' || regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '-', 'g'), 1.0 FROM o
  UNION ALL SELECT 'P' || lpad(l_orderkey::VARCHAR, 10, '0'), 'shares_concept', 'concept:' || lpad(l_partkey::VARCHAR, 10, '0'), w FROM li2),
base_papers AS (SELECT paper_id, '' AS title, '' AS abstract, year(o_orderdate) AS year, o_orderpriority AS venue FROM o),"""
    + _TAIL
)

F2 = (
    """WITH RECURSIVE
d AS (SELECT 'D' || lpad(doc_id::VARCHAR, 10, '0') AS paper_id, * FROM documents),
prior AS (SELECT paper_id, unnest([lag(paper_id, 1) OVER w, lag(paper_id, 2) OVER w]) AS ref FROM d WINDOW w AS (PARTITION BY source, lang ORDER BY doc_id)),
raw_edges AS (
  SELECT paper_id AS src, 'cites' AS rel, ref AS dst, 1.0::DOUBLE AS weight FROM prior WHERE ref IS NOT NULL
  UNION ALL SELECT paper_id, 'authored_by', 'author:' || lang || '-' || (doc_id % 97)::VARCHAR, 1.0 FROM d
  UNION ALL SELECT paper_id, 'published_in', 'venue:' || source, 1.0 FROM d
  UNION ALL SELECT paper_id, 'shares_concept', 'concept:' || lang, 1.0 FROM d),
base_papers AS (SELECT paper_id, '' AS title, text AS abstract, (1990 + doc_id % 30)::INT AS year, source AS venue FROM d),"""
    + _TAIL
)


def ppr(start: str, steps: int, name: str = "pr", alpha: float = 0.15) -> str:
    """CTEs start and name(it, node_id, x) after 0..steps steps; every node has an arc, so no mass is lost."""
    return f""",
start AS MATERIALIZED ({start}),
{name}(it, node_id, x) AS (SELECT 0, node_id, v FROM start
  UNION ALL SELECT it + 1, a.dst, {alpha} * max(s.v) + sum({1 - alpha} * x * a.p) FROM {name} JOIN tr a ON a.src = {name}.node_id JOIN start s ON s.node_id = a.dst WHERE it < {steps} GROUP BY it, a.dst)"""


SEED_START = "SELECT node_id, CASE WHEN node_id = s THEN 1.0::DOUBLE ELSE 0.0 END AS v FROM nodes, seed"

BM25 = r"""
query AS (SELECT term, count(*) AS times FROM (SELECT unnest(regexp_extract_all(lower(trim(title || '. ' || abstract)), '[a-z0-9]+')) AS term FROM papers WHERE paper_id = (SELECT s FROM one)) GROUP BY 1),
words AS (SELECT paper_id, regexp_extract_all(lower(trim(title || '. ' || abstract)), '[a-z0-9]+') AS w FROM papers),
sized AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM words),
flat AS (SELECT paper_id, len(w) AS dl, unnest(w) AS term FROM words),
tf AS (SELECT paper_id, dl, term, count(*) AS tf FROM flat GROUP BY ALL),
df AS (SELECT term, count(*) AS n FROM tf GROUP BY 1),
idf0 AS (SELECT term, ln(s.n - df.n + 0.5) - ln(df.n + 0.5) AS idf FROM df, sized s),
idf AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM idf0) ELSE idf END AS idf FROM idf0),
hit AS (SELECT paper_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS s FROM tf JOIN query USING (term) JOIN idf USING (term), sized GROUP BY 1),
bm AS (SELECT paper_id, coalesce(s, 0.0) AS bm25 FROM papers LEFT JOIN hit USING (paper_id)),
qv AS (SELECT embedding AS q FROM embeddings WHERE 'D' || lpad(vec_id::VARCHAR, 10, '0') = (SELECT s FROM one)),
dn AS (SELECT paper_id, coalesce(list_dot_product(embedding::DOUBLE[], q::DOUBLE[]), 0.0) AS dense FROM papers LEFT JOIN (SELECT 'D' || lpad(vec_id::VARCHAR, 10, '0') AS paper_id, embedding, q FROM embeddings, qv) USING (paper_id)),
fused AS (SELECT paper_id, bm25, dense, row_number() OVER (ORDER BY round(bm25, 9) DESC, paper_id) AS bm25_rank, row_number() OVER (ORDER BY round(dense, 9) DESC, paper_id) AS dense_rank FROM bm JOIN dn USING (paper_id))"""
