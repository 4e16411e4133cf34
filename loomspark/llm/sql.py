"""DuckDB SQL of the pN_ queries that SQL can express."""

from loomspark.functions.expr import INSTITUTION
from loomspark.plans.catalog import FACT
from loomspark.plans.packed import WHITE, entries_sql

#: Latest decision per unordered pair, then reachability.
_P2 = """
WITH RECURSIVE pairs AS (
  SELECT least(left_id, right_id) AS a, greatest(left_id, right_id) AS b, decided_at, lower(regexp_replace(decision, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) AS word
  FROM author_matches WHERE left_id IS NOT NULL AND right_id IS NOT NULL AND left_id <> right_id
), last AS (
  SELECT a, b, arg_max(word, decided_at) FILTER (WHERE word IS NOT NULL) AS word, max(decided_at) FILTER (WHERE word IS NOT NULL) AS said, max(decided_at) AS latest FROM pairs GROUP BY a, b
), links AS (
  SELECT a, b FROM last WHERE word = 'match' AND said = latest AND a IN (SELECT mention_id FROM author_mentions) AND b IN (SELECT mention_id FROM author_mentions)
), edges AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach(node, root) AS (
  SELECT a, a FROM edges UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.node
), grouped AS (
  SELECT node AS mention_id, min(root) AS group_id FROM reach GROUP BY node
)
"""

_FOLD = "nullif(regexp_replace(nfc_normalize({c}), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'), '')"
_P1 = f"""
WITH rows AS (
  SELECT id, coder, coded_at, upper(left({_FOLD.format(c='include')}, 1)) AS include, {_FOLD.format(c='func')} AS func, {_FOLD.format(c='meth')} AS meth, {_FOLD.format(c='lang_group')} AS lang_group FROM codings WHERE id IS NOT NULL AND coder IS NOT NULL
), last AS (
  SELECT id, coder, arg_max(row(include, func, meth, lang_group), coded_at) AS r FROM rows WHERE coalesce(include, func, meth, lang_group) IS NOT NULL GROUP BY 1, 2
), long AS (
  SELECT 'include' AS axis, id, coder, r[1] AS label FROM last UNION ALL SELECT 'func', id, coder, r[2] FROM last UNION ALL SELECT 'meth', id, coder, r[3] FROM last UNION ALL SELECT 'lang_group', id, coder, r[4] FROM last
), cells AS (
  SELECT axis, id, label, count(*) AS c FROM long WHERE label IS NOT NULL GROUP BY 1, 2, 3
), items AS (
  SELECT axis, id, sum(c) AS n, sum(c * (c - 1)) AS same FROM cells GROUP BY 1, 2 HAVING sum(c) > 1
), seen AS (
  SELECT axis, count(*) AS items, sum(n) AS answers, sum(same / (n - 1)) AS agree FROM items GROUP BY 1
), margins AS (
  SELECT axis, label, sum(c) AS m FROM cells WHERE (axis, id) IN (SELECT (axis, id) FROM items) GROUP BY 1, 2
), chance AS (
  SELECT axis, sum(m * (m - 1)) AS mm FROM margins GROUP BY 1
), f AS (
  SELECT axis, items, answers::BIGINT AS answers, agree / answers AS observed, mm / (answers * (answers - 1)) AS expected FROM seen JOIN chance USING (axis)
)
SELECT axis, items, answers, round(observed, 6) AS observed, round(expected, 6) AS expected, round(CASE WHEN expected = 1 THEN 1 ELSE 1 - (1 - observed) / (1 - expected) END, 6) AS alpha FROM f
"""

_P3 = f"""WITH {FACT}, v AS (SELECT 'meth' AS field, meth AS category FROM fact UNION ALL SELECT 'reason', reason FROM fact UNION ALL SELECT 'lang_group', lang FROM fact), n AS (SELECT field, category, count(*) AS n FROM v WHERE category <> '' GROUP BY 1, 2),
t AS (SELECT t.*, greatest(CAST(t.target_share AS DECIMAL(20,10)) * t.sample_rows, t.min_rows) AS quota, coalesce(n.n, 0) AS available FROM sample_targets t LEFT JOIN n USING (field, category))"""

_FULL, _HALF = "".join(chr(c) for c in range(0xFF01, 0xFF5F) if c != 0xFF07), "".join(chr(c) for c in range(0x21, 0x7F) if c != 0x27)
_NFKC = f"translate(nfc_normalize(entry), '{_FULL}', '{_HALF}')"
_P4 = f"""WITH {entries_sql(("kw_ko", "kw_en"))}, t AS (SELECT field, arti_id, trim(regexp_replace(lower(trim(regexp_replace({_NFKC}, '{WHITE}+', ' ', 'g'))), '[·\\-–—]+', ' ', 'g')) AS term FROM entries),
f AS (SELECT field, term, count(*) AS occurrences, count(DISTINCT arti_id) AS records FROM t WHERE term <> '' GROUP BY 1, 2), terms AS (SELECT *, CASE WHEN records <= 2 THEN 'rare' WHEN records * 100 > (SELECT count(*) FROM one) * 5 THEN 'common' ELSE '' END AS mark FROM f)"""
_SHAPE = r"^\s*([^(]+?)\s*(?:\((.*)\))?\s*$"
_P6 = f"""WITH {entries_sql(("authors",))}, e AS (SELECT arti_id, regexp_replace({_NFKC}, '{WHITE}+', ' ', 'g') AS e FROM entries), p AS (SELECT arti_id, trim(regexp_extract(e, '{_SHAPE}', 1)) AS name, regexp_extract(e, '{_SHAPE}', 2) AS place FROM e),
k AS (SELECT DISTINCT arti_id, name || '|' || CASE WHEN trim(regexp_extract(place, '{INSTITUTION}', 1)) <> '' THEN trim(regexp_extract(place, '{INSTITUTION}', 1)) ELSE regexp_split_to_array(trim(place), ' +')[1] END AS a FROM p WHERE name <> '' AND trim(place) <> ''), n AS (SELECT a, count(*) AS n FROM k GROUP BY a),
ab AS (SELECT x.a AS item_a, y.a AS item_b, count(*) AS n_ab FROM k x JOIN k y ON x.arti_id = y.arti_id AND x.a < y.a GROUP BY 1, 2 HAVING count(*) >= 5),
pairs AS (SELECT item_a, item_b, na.n AS n_a, nb.n AS n_b, n_ab, round(n_ab * (SELECT count(*) FROM one) / (na.n * nb.n), 6) AS lift FROM ab JOIN n na ON na.a = item_a JOIN n nb ON nb.a = item_b WHERE n_ab * (SELECT count(*) FROM one) >= 3 * na.n * nb.n)"""

SQL = {
    "p4_terms": _P4 + " SELECT field, term, occurrences, records, mark FROM terms",
    "p4_found": _P4 + " SELECT field, term, mark FROM terms WHERE mark <> ''",
    "p6_pairs": _P6 + " SELECT * FROM pairs",
    "p6_found": _P6 + " SELECT item_a AS author_a, item_b AS author_b FROM pairs",
    "p1_agreement": _P1,
    "p3_found": f"""WITH {FACT}, v AS (SELECT 'meth' AS field, meth AS category FROM fact UNION ALL SELECT 'reason', reason FROM fact UNION ALL SELECT 'lang_group', lang FROM fact), n AS (SELECT field, category, count(*) AS n FROM v WHERE category <> '' GROUP BY 1, 2)
SELECT t.plan_id, t.category FROM sample_targets t LEFT JOIN n USING (field, category) WHERE greatest(CAST(t.target_share AS DECIMAL(20,10)) * t.sample_rows, t.min_rows) > coalesce(n.n, 0)""",
    "p3_balance": _P3 + " SELECT plan_id, field, category, round(CAST(quota AS DOUBLE), 4) AS quota, available, true AS within, quota > available AS short FROM t",
    "p9_balance": "SELECT mix_id, source, (SELECT count(*) FROM documents d WHERE d.source = t.source) AS documents, true AS within, true AS allowed FROM mix_targets t",
    "p2_found": _P2 + "SELECT group_id, mention_id FROM grouped",
    "p2_assignment": _P2 + "SELECT coalesce(g.group_id, m.mention_id) AS group_id, m.mention_id FROM (SELECT DISTINCT mention_id FROM author_mentions WHERE mention_id IS NOT NULL) m LEFT JOIN grouped g USING (mention_id)",
}
