"""DuckDB SQL for op6, op8 and op9."""

from .sql_near_dup import WORDS

_ITEM_WORDS = WORDS.replace("words AS", "item_words AS").replace("FROM words", "FROM item_words").replace("shingle AS", "item AS").replace("FROM documents", "FROM benchmark WHERE item_id IS NOT NULL").replace("doc_id", "item_id")

OP6 = f"""
WITH {WORDS}, {_ITEM_WORDS},
  size AS (SELECT item_id, count(*) AS q FROM item GROUP BY item_id),
  hit AS (SELECT doc_id, item_id, count(*) AS c FROM item JOIN shingle USING (s) GROUP BY ALL),
  found AS (SELECT doc_id, item_id, c / q AS part FROM hit JOIN size USING (item_id) WHERE 100 * c >= 80 * q)
SELECT d.doc_id, count(item_id) AS n_items, coalesce(string_agg(CAST(item_id AS VARCHAR), ';' ORDER BY item_id), '') AS item_ids, max(part) AS containment
FROM documents d LEFT JOIN found USING (doc_id) GROUP BY d.doc_id
"""

OP8 = """
WITH RECURSIVE
  counted AS (SELECT coalesce(source, '') AS s, count(*) AS c FROM documents GROUP BY ALL),
  raw AS (SELECT s, CAST(floor(sqrt(c * 1000000.0)) AS BIGINT) AS w, (c + 9) // 10 AS quanta, row_number() OVER (ORDER BY s) AS i FROM counted),
  shared AS (SELECT CAST(list_reduce(list(w), lambda a, b: gcd(a, b)) AS BIGINT) AS g FROM raw),
  weight AS (SELECT s, i, quanta, w // g AS w FROM raw, shared),
  total AS (SELECT CAST(sum(w) AS BIGINT) AS w, count(*) AS n FROM weight),
  frames AS (SELECT CAST((max((quanta + 2) * t.w // r.w + 1) + 511) // 512 AS BIGINT) AS n FROM weight r, total t),
  huffman(step, nodes, made) AS (
    SELECT 0, (SELECT list_sort(list({'w': w, 'i': i, 'own': [i]})) FROM weight), CAST(NULL AS STRUCT(l BIGINT[], r BIGINT[], wl BIGINT, wn BIGINT))
    UNION ALL
    SELECT step + 1, list_sort(list_append(nodes[3:], {'w': nodes[1].w + nodes[2].w, 'i': least(nodes[1].i, nodes[2].i), 'own': list_concat(nodes[1].own, nodes[2].own)})),
      {'l': nodes[1].own, 'r': nodes[2].own, 'wl': nodes[1].w, 'wn': nodes[1].w + nodes[2].w}
    FROM huffman WHERE len(nodes) > 1
  ),
  level AS (SELECT i, list_contains(made.l, i) AS at_left, made.wl AS wl, made.wn AS wn, row_number() OVER (PARTITION BY i ORDER BY step DESC) AS depth
            FROM huffman, weight WHERE made IS NOT NULL AND (list_contains(made.l, i) OR list_contains(made.r, i))),
  down(i, f, depth, n) AS (
    SELECT i, f, CAST(0 AS BIGINT), f * 512 FROM weight, (SELECT unnest(range(0, n + 1)) AS f FROM frames)
    UNION ALL
    SELECT i, f, v.depth, CASE WHEN at_left THEN (n // wn) * wl + (2 * (n % wn) * wl + wn) // (2 * wn) ELSE n - (n // wn) * wl - (2 * (n % wn) * wl + wn) // (2 * wn) END
    FROM down JOIN level v USING (i) WHERE v.depth = down.depth + 1
  ),
  had AS (SELECT i, f, n FROM down QUALIFY row_number() OVER (PARTITION BY i, f ORDER BY depth DESC) = 1),
  frame AS (SELECT a.f, list(a.n ORDER BY a.i) AS past, list(b.n - a.n ORDER BY a.i) AS cs FROM had a JOIN had b ON b.i = a.i AND b.f = a.f + 1 GROUP BY a.f),
  edf(f, slot, taken, pick) AS (
    SELECT f, CAST(-1 AS BIGINT), list_transform(cs, lambda x: CAST(0 AS BIGINT)), CAST(0 AS BIGINT) FROM frame
    UNION ALL
    SELECT f, slot + 1, list_transform(taken, lambda k, i: CASE WHEN i = p THEN k + 1 ELSE k END), p
    FROM (SELECT f, slot, taken, list_min(list_filter(list_transform(taken, lambda k, i: CASE WHEN k < cs[i] AND (k * 512) // cs[i] <= slot + 1 THEN {'d': ((k + 1) * 512 + cs[i] - 1) // cs[i], 'i': i} END), lambda x: x IS NOT NULL)).i AS p FROM edf JOIN frame USING (f) WHERE slot + 1 < 512)
  ),
  plan AS (SELECT e.pick AS i, past[e.pick] + e.taken[e.pick] - 1 AS k, e.f * 512 + slot AS slot FROM edf e JOIN frame USING (f) WHERE slot >= 0),
  ranked AS (SELECT doc_id, coalesce(source, '') AS s, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) - 1 AS mix_rank FROM documents)
SELECT r.doc_id, r.s AS source, r.mix_rank, p.slot AS mix_slot, r.mix_rank % 10 AS mix_within
FROM ranked r JOIN weight USING (s) JOIN plan p ON p.i = weight.i AND p.k = r.mix_rank // 10
"""

OP9 = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
  win AS (SELECT doc_id, unnest(range(0, len(x) // 2 - 199)) AS s, x FROM t),
  hashed AS (SELECT doc_id, s, md5_number(substr(x, 2 * s + 1, 400)) AS h FROM win),
  twice AS (SELECT h FROM hashed GROUP BY h HAVING count(*) > 1),
  hit AS (SELECT doc_id, s, s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS gap FROM hashed SEMI JOIN twice USING (h)),
  run AS (SELECT doc_id, s, sum(CASE WHEN gap <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s) AS r FROM hit),
  span AS (SELECT doc_id, r, min(s) AS b, max(s) + 200 AS e FROM run GROUP BY doc_id, r),
  edge AS (SELECT doc_id, list(b ORDER BY b) AS bs, list(e ORDER BY b) AS es, sum(e - b) AS removed FROM span GROUP BY doc_id)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(len(bs), 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN bs IS NULL THEN x ELSE array_to_string(list_transform(range(0, len(bs) + 1), lambda i:
    substr(x, 2 * (CASE WHEN i = 0 THEN 0 ELSE es[i] END) + 1, 2 * ((CASE WHEN i = len(bs) THEN len(x) // 2 ELSE bs[i + 1] END) - (CASE WHEN i = 0 THEN 0 ELSE es[i] END)))), '') END)) AS kept_sha256
FROM t LEFT JOIN edge USING (doc_id)
"""
