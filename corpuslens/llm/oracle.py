"""DuckDB SQL with the rows of the registered queries, where SQL can express them."""

from __future__ import annotations

NORM = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3 = f"""
WITH n AS (SELECT doc_id, {NORM} AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM n JOIN g USING (norm)
"""

OP9 = r"""
WITH d AS (
  SELECT doc_id, md5(CAST(doc_id AS VARCHAR)) AS h,
    CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS src,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (SELECT src, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY src),
w AS (SELECT *, 2 * source_size AS cap,
    [5, 2, 1][((row_number() OVER (ORDER BY src) - 1) % 3) + 1] AS weight FROM s),
l AS (SELECT *, (sum(source_size) OVER () * CAST(1.5 AS DOUBLE)
      - coalesce(sum(cap) OVER (ORDER BY cap / weight, src
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY cap / weight, src
          ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT min_by(level, (cap / weight, src)) FILTER (cap / weight > level) AS final FROM l),
t AS (SELECT src, source_size,
    CASE WHEN final IS NULL THEN CAST(cap AS DOUBLE) ELSE least(CAST(cap AS DOUBLE), weight * final) END AS target
  FROM w, f),
p AS (SELECT d.*, source_size, target, CAST(floor(target + 0.5) AS BIGINT) AS quota,
    coalesce(sum(size) OVER (PARTITION BY src ORDER BY h
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
  FROM d JOIN t USING (src))
SELECT doc_id, size, source_size, target,
  CAST(greatest(0, least(size, quota - place))
    + greatest(0, least(size, quota - source_size - place)) AS BIGINT) AS taken
FROM p
"""

OP11 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms, row_number() OVER () AS row FROM documents),
b AS (SELECT item_id, row_number() OVER () AS q, unnest(regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
c AS (SELECT count(*) FILTER (len(terms) > 0) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM d),
p AS (SELECT row, doc_id, len(terms) AS n, unnest(terms) AS term FROM d),
t AS (SELECT row, doc_id, n, term, count(*) AS tf FROM p
  WHERE term IN (SELECT term FROM b) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * CAST(n_docs AS DOUBLE) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM t, c GROUP BY term, n_docs),
i AS (SELECT row, doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms)) AS impact
  FROM t, c),
s AS (SELECT q, item_id, row, doc_id, CAST(sum(w * impact) AS BIGINT) AS score
  FROM b JOIN w USING (term) JOIN i USING (term) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10
"""

ORACLE_SQL: dict[str, str] = {"op3_exact_dedup": OP3, "op9_mixing": OP9, "op11_ranked_search": OP11}
