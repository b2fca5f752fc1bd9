"""DuckDB SQL for the queries of this subpackage that SQL can express.

The others hash with XXH64 or CRC-32, learn, encode or compress, for which DuckDB has no functions; tests/llm hold them against brute-force versions."""

#: Lines as op7 compares them, and the keys that two lines one edit apart share: the beginning or the end, cut at the middle of the longer one.
_LINES = r"""split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
  named AS (SELECT doc_id, line_no, lower(trim(regexp_replace(raw, '[\x20\x09-\x0D\xA0]+', ' ', 'g'), ' ')) AS line FROM (SELECT doc_id, unnest(l) AS raw, unnest(range(len(l)))::INT AS line_no FROM split)),
  lines AS (SELECT * FROM named WHERE line != ''),
  firsts AS (SELECT line, length(line) AS n, min(ROW(coalesce(doc_id, 9223372036854775807), line_no)) AS place FROM lines GROUP BY line),
  halves AS (SELECT line, n, place, m FROM (SELECT *, unnest([n // 2, (n + 1) // 2]) AS m FROM firsts WHERE n >= 15)),
  keys AS (SELECT DISTINCT line, n, place, 'before' AS side, left(line, m) AS key FROM halves UNION SELECT line, n, place, 'after', right(line, m) FROM halves UNION SELECT line, n, place, 'after', right(line, m + 1) FROM halves),
  met AS (SELECT DISTINCT a.line AS a, b.line AS b, a.n AS na, b.n AS nb, b.place FROM keys a JOIN keys b USING (side, key) WHERE a.line != b.line AND greatest(a.n, b.n) >= 16 AND abs(a.n - b.n) <= 1),
  begun AS (SELECT *, coalesce(list_position(list_transform(range(1, least(na, nb) + 1), lambda i: substr(a, i, 1) != substr(b, i, 1)), true) - 1, least(na, nb)) AS same FROM met),
  near AS (SELECT a AS line, min(place) AS place FROM begun WHERE substr(a, same + CASE WHEN na >= nb THEN 2 ELSE 1 END) = substr(b, same + CASE WHEN nb >= na THEN 2 ELSE 1 END) GROUP BY a),
  kept AS (SELECT f.line, least(f.place, coalesce(near.place, f.place)) AS place FROM firsts f LEFT JOIN near USING (line))"""

#: Every term of a language for each of its sources, with both shares.
_SHARES = r"""docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
  said AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
  counts AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS n_docs FROM said GROUP BY ALL),
  kept AS (SELECT lang, term, sum(n)::BIGINT AS n FROM counts GROUP BY ALL HAVING sum(n_docs) >= 3),
  langs AS (SELECT lang, count(*) AS v, sum(n)::BIGINT AS n FROM kept GROUP BY ALL),
  grp AS (SELECT DISTINCT lang, source FROM docs),
  dense AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS lang_n FROM grp g JOIN kept k ON k.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
  sums AS (SELECT lang, source, sum(n)::BIGINT AS n FROM dense GROUP BY ALL),
  shares AS (SELECT d.lang, d.source, d.term, d.n, (1 + 1000000000::HUGEINT * (d.n + 1) // (s.n + l.v))::BIGINT AS p, (1 + 1000000000::HUGEINT * (d.lang_n + 1) // (l.n + l.v))::BIGINT AS q
    FROM dense d JOIN sums s ON s.lang = d.lang AND s.source = d.source JOIN langs l ON l.lang = d.lang)"""

ORACLES: dict[str, str] = {
    "op11_top_k": """WITH whole AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  met AS (SELECT q.vec_id AS query_id, q.r, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM whole q JOIN whole c ON q.vec_id % 100 = 0 AND q.r != c.r),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST)::INT AS rank FROM met)
  SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10""",
    "op12_divergence": f"""WITH {_SHARES}, far AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source != b.source GROUP BY ALL),
  pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source != b.source LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
  terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM shares WHERE n > 0 AND p > q),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INT AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
  SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200""",
    "op7_line_dedup": f"""WITH {_LINES} SELECT doc_id, line_no, nullif(place[1], 9223372036854775807) AS kept_doc_id, place[2] AS kept_line_no FROM lines JOIN kept USING (line)
  WHERE ROW(coalesce(doc_id, 9223372036854775807), line_no) > place""",
}
