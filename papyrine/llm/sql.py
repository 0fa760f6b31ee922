"""SQL of the queries of this package that SQL can express on whole tables."""

from __future__ import annotations

#: Items of a basket as TESTDATA.md defines them: both lists, united over all rows of a paper.
_ITEMS = r"""
rows_ AS (
  SELECT paper_id, unnest([genes_json, diseases_json]) AS j FROM paper_entities
), names AS (
  SELECT paper_id, unnest(CAST(CAST(j AS JSON) AS VARCHAR[])) AS x FROM rows_ WHERE json_valid(j) AND json_type(j) = 'ARRAY'
), items AS (
  SELECT DISTINCT paper_id, lower(regexp_replace(x, '^\s+|\s+$', '', 'g')) AS item FROM names
  WHERE regexp_replace(x, '^\s+|\s+$', '', 'g') <> ''
), n_items AS (SELECT item, count(*) AS n FROM items GROUP BY item),
total AS (SELECT count(DISTINCT paper_id) AS n FROM paper_entities)
"""

_TERMS = r"""
texts AS (
  SELECT row_number() OVER () AS r, paper_id,
    lower(concat_ws(chr(10), coalesce(title, ''), coalesce(abstract, ''),
      CASE WHEN json_valid(keywords_json) AND json_type(keywords_json) = 'ARRAY' THEN array_to_string(CAST(CAST(keywords_json AS JSON) AS VARCHAR[]), chr(10)) ELSE '' END)) AS t
  FROM papers
), terms AS (
  SELECT r, paper_id, unnest(regexp_extract_all(t, '[a-z0-9]+')) AS term FROM texts
)
"""

_PLACES = r"""
best AS (
  SELECT query_id, method, paper_id, max(score) AS score, min(paper_rank) AS paper_rank FROM search_results
  GROUP BY ALL
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, method ORDER BY score DESC NULLS LAST,
      CASE WHEN score IS NULL THEN coalesce(paper_rank, 2147483647) ELSE 0 END, paper_id) AS row_no,
    CASE WHEN score IS NULL THEN coalesce(paper_rank, 2147483647) ELSE 0 END AS tie
  FROM best
), mid AS (
  SELECT *, avg(row_no) OVER (PARTITION BY query_id, method, score, tie) AS place FROM placed
)
"""

ORACLES: dict[str, str] = {
    "p3_found": f"""WITH {_TERMS}, tf AS (SELECT r, paper_id, term, count(*) AS tf FROM terms WHERE regexp_full_match(term, '[a-z]{{6,}}') GROUP BY ALL),
df AS (SELECT term, count(DISTINCT paper_id) AS df FROM tf GROUP BY term)
SELECT DISTINCT paper_id, term FROM tf JOIN df USING (term) WHERE tf >= 3 AND df <= 5""",
    "p4_found": f"""WITH {_ITEMS}, pairs AS (
  SELECT a.item AS item_a, b.item AS item_b, count(*) AS n_ab FROM items a JOIN items b ON a.paper_id = b.paper_id AND a.item < b.item GROUP BY ALL
)
SELECT item_a, item_b FROM pairs JOIN n_items x ON x.item = item_a JOIN n_items y ON y.item = item_b, total
WHERE n_ab >= 10 AND n_ab * total.n >= 5 * x.n * y.n""",
    "p4_pairs": f"""WITH {_ITEMS}, pairs AS (
  SELECT a.item AS item_a, b.item AS item_b, count(*) AS n_ab FROM items a JOIN items b ON a.paper_id = b.paper_id AND a.item < b.item GROUP BY ALL
)
SELECT item_a, item_b, n_ab, x.n AS n_a, y.n AS n_b, round(n_ab * total.n / (x.n * y.n), 6) AS lift
FROM pairs JOIN n_items x ON x.item = item_a JOIN n_items y ON y.item = item_b, total""",
    "p5_found": f"""WITH {_PLACES}, tops AS (
  SELECT query_id, paper_id, count(*) AS n FROM placed WHERE row_no <= 3 AND score IS NOT NULL GROUP BY ALL
), m AS (SELECT query_id, count(DISTINCT method) AS k FROM placed GROUP BY query_id HAVING count(DISTINCT method) >= 2)
SELECT query_id, min(paper_id) AS paper_id FROM tops JOIN m USING (query_id) WHERE n = k GROUP BY query_id HAVING count(*) = 1""",
    "p5_order": f"""WITH {_PLACES}, f AS (
  SELECT query_id, paper_id, round(sum(1.0 / (60.0 + place)), 12) AS fused, CAST(count(*) AS INTEGER) AS methods FROM mid GROUP BY ALL
)
SELECT query_id, paper_id, round(fused, 9) AS fused, methods, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, paper_id) AS fused_rank FROM f""",
}
