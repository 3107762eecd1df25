"""DuckDB SQL for op3."""

OP3 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0 AND NOT isnan(x)) AS s FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0),
  pair AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(len(list_filter(list_zip(q.s, v.s), lambda x: x[1] <> x[2])) AS INTEGER) AS distance FROM v q, v WHERE q.vec_id % 100 = 0),
  ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank FROM pair)
SELECT query_id, rank, vec_id, distance FROM ranked WHERE rank <= 10
"""
