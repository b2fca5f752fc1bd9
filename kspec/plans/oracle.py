"""DuckDB SQL for the queries of catalog.py."""

from __future__ import annotations

from .catalog import CELLS, GENOME, LONG_K, SEEK, K

SEQS = """seqs AS (SELECT doc_id AS seq_id, translate(lower(regexp_replace(text, '[^A-Za-z.\\n]', '', 'g')), 'abcdefghijklmnopqrstuvwxyz.' || chr(10), 'acgtacgtacgtacgtacgtacgtac--') AS seq FROM documents)"""
KMERS = f"""km AS (SELECT seq_id, pos, least(w, reverse(translate(w, 'acgt', 'tgca'))) AS kmer
  FROM (SELECT seq_id, (i - 1)::INT AS pos, substr(seq, i, {K}) AS w FROM (SELECT seq_id, seq, unnest(range(1, length(seq) - {K - 2})) AS i FROM seqs WHERE length(seq) >= {K}))
  WHERE w NOT LIKE '%-%')"""
COUNTS = """c AS (SELECT kmer, count(*) FILTER (seq_id % 8 IN (0,1,2,3)) AS mat, count(*) FILTER (seq_id % 8 IN (2,3,4,5)) AS pat, count(*) FILTER (seq_id % 8 IN (0,1,2,3,4,5)) AS child,
  count(*) FILTER (seq_id % 8 IN (0,1,6)) AS asm1, count(*) FILTER (seq_id % 8 IN (4,5,7)) AS asm2, count(*) AS whole FROM km GROUP BY kmer)"""
BASE = f"WITH {SEQS}, {KMERS}, {COUNTS}"



def hist(of: str) -> str:
    return f"SELECT {of}::BIGINT AS multiplicity, count(*) AS n_unique, sum({of})::BIGINT AS n_instances FROM c WHERE {of} > 0 GROUP BY 1"


CN_CLASS = "CASE WHEN asm1 = 0 THEN 'read-only' WHEN asm1 > 4 THEN '>4' ELSE asm1::VARCHAR END"
CN = f"SELECT {CN_CLASS} AS copies, least(asm1, 5) AS class_ord, least(child, 1000)::BIGINT AS multiplicity, count(*) AS n_unique, sum(child)::BIGINT AS n_instances FROM c WHERE child > 0 GROUP BY 1, 2, 3"
MEMBER = "CASE WHEN asm1 > 0 AND asm2 > 0 THEN 'shared' WHEN asm1 > 0 THEN 'asm1-only' WHEN asm2 > 0 THEN 'asm2-only' ELSE 'read-only' END"


def dense_steps(hist: str, value: str) -> str:
    """CTEs d and s: all bins of a histogram CTE, and each with the one before."""
    return f"""d AS (SELECT b.multiplicity, coalesce(h.{value}, 0) AS n FROM (SELECT unnest(range(1, (SELECT max(multiplicity) FROM {hist}) + 1)) AS multiplicity) b LEFT JOIN {hist} h USING (multiplicity)),
  s AS (SELECT multiplicity, n, lag(n) OVER (ORDER BY multiplicity) AS prev FROM d)"""


def rise(hist: str, op: str, name: str) -> str:
    s = dense_steps(hist, "n_unique").replace("d AS", f"d_{name} AS", 1).replace("FROM d)", f"FROM d_{name})").replace("  s AS", f"  s_{name} AS")
    return f"{s}, {name} AS (SELECT coalesce(min(multiplicity) FILTER (n {op} prev), max(multiplicity))::BIGINT AS thresh FROM s_{name})"


def solid(of: str) -> str:
    return f"h AS ({hist(of)}), {rise('h', '>=', 't')}, solid AS (SELECT thresh, sum(n_unique)::BIGINT AS solid_count FROM h, t WHERE multiplicity >= thresh GROUP BY thresh)"


def specific(own: str, other: str) -> str:
    return f"sp AS (SELECT kmer, {own} AS cnt, child FROM c WHERE {own} > 0 AND {other} = 0)"


def inherited(own: str, other: str) -> str:
    h1 = "h1 AS (SELECT cnt AS multiplicity, count(*) AS n_unique FROM sp GROUP BY 1)"
    return f"{specific(own, other)}, {h1}, {rise('h1', '>', 't1')}, inh AS (SELECT kmer, child AS cnt FROM sp, t1 WHERE cnt >= thresh AND child > 0)"


def hap(own: str, other: str) -> str:
    h2 = "h2 AS (SELECT cnt AS multiplicity, count(*) AS n_unique FROM inh GROUP BY 1)"
    return f"{inherited(own, other)}, {h2}, {rise('h2', '>', 't2')}"


CURVES = f"""cn AS ({CN}), cls AS (SELECT DISTINCT copies, class_ord FROM cn), grid AS (SELECT copies, class_ord, unnest(range(1, 1001)) AS multiplicity FROM cls),
  bins AS (SELECT g.copies, g.class_ord, g.multiplicity, coalesce(cn.n_instances, 0) AS n FROM grid g LEFT JOIN cn ON g.copies = cn.copies AND g.multiplicity = cn.multiplicity),
  st AS (SELECT *, lag(n) OVER w AS prev, lead(n) OVER w AS next FROM bins WINDOW w AS (PARTITION BY copies ORDER BY multiplicity)),
  fr AS (SELECT *, coalesce(min(multiplicity) FILTER (n >= prev) OVER (PARTITION BY copies), 1000) AS from_k FROM st),
  pk AS (SELECT copies, class_ord, multiplicity AS xm, n AS ym, row_number() OVER (PARTITION BY copies ORDER BY n DESC, multiplicity DESC) AS r FROM fr WHERE multiplicity >= from_k AND (multiplicity < 1000 OR multiplicity = from_k)),
  top AS (SELECT xm AS xmax, ym AS ymax FROM pk WHERE r = 1 ORDER BY ym DESC, class_ord, xm DESC LIMIT 1)"""
SECOND = f"""{CURVES}, tr AS (SELECT *, last_value(CASE WHEN n > prev THEN 1 WHEN n < prev THEN -1 END IGNORE NULLS) OVER (PARTITION BY copies ORDER BY multiplicity ROWS UNBOUNDED PRECEDING) AS trend FROM st),
  sec AS (SELECT multiplicity FROM tr, top WHERE trend > 0 AND (next < n OR multiplicity = 999) AND multiplicity > xmax AND multiplicity < 1000 AND n >= 0.1 * ymax ORDER BY class_ord DESC, multiplicity DESC LIMIT 1),
  peaks AS (SELECT xmax, ymax, coalesce((SELECT multiplicity FROM sec), xmax) AS xsec FROM top)"""


STACK = f"""cn AS ({CN}), sb AS (SELECT b.multiplicity, coalesce(h.n, 0)::BIGINT AS n FROM (SELECT unnest(range(1, 1001)) AS multiplicity) b LEFT JOIN (SELECT multiplicity, sum(n_instances) AS n FROM cn GROUP BY 1) h USING (multiplicity)),
  ss AS (SELECT *, lag(n) OVER (ORDER BY multiplicity) AS prev, lead(n) OVER (ORDER BY multiplicity) AS next FROM sb), sr AS (SELECT min(multiplicity) AS k FROM ss WHERE n > prev AND multiplicity < 1000),
  stop AS (SELECT multiplicity AS xmax, n AS ymax FROM ss, sr WHERE multiplicity >= k AND multiplicity < 1000 ORDER BY n DESC, multiplicity DESC LIMIT 1),
  str AS (SELECT *, last_value(CASE WHEN n > prev THEN 1 WHEN n < prev THEN -1 END IGNORE NULLS) OVER (ORDER BY multiplicity ROWS UNBOUNDED PRECEDING) AS trend FROM ss),
  ssec AS (SELECT max(multiplicity) AS m FROM str, stop WHERE trend > 0 AND (next < n OR multiplicity = 999) AND multiplicity > xmax AND multiplicity < 1000 AND n >= 0.1 * ymax)"""


def peak(line: str, along: str, max_line: int, cells: str, name: str) -> str:
    return f"""g_{name} AS (SELECT l.line, a.ap, coalesce(x.n, 0) AS n FROM (SELECT unnest(range(0, {max_line + 1})) AS line) l CROSS JOIN (SELECT unnest(range(1, {CELLS + 1})) AS ap) a LEFT JOIN {cells} x ON x.{line} = l.line AND x.{along} = a.ap),
  p1_{name} AS (SELECT *, lag(n) OVER (PARTITION BY line ORDER BY ap) AS prev FROM g_{name}),
  p2_{name} AS (SELECT *, coalesce(min(ap) FILTER (n >= prev) OVER (PARTITION BY line), {CELLS}) AS begin_at FROM p1_{name}),
  p3_{name} AS (SELECT line, n, ap FROM p2_{name} WHERE ap >= begin_at QUALIFY row_number() OVER (PARTITION BY line ORDER BY n DESC, ap DESC) = 1),
  {name} AS (SELECT pos, height FROM (SELECT ap AS pos, n AS height FROM p3_{name} ORDER BY n DESC, line LIMIT 1) WHERE height > 0 AND pos < {CELLS})"""


JOINT = f"jm AS (SELECT asm1 AS cnt1, asm2 AS cnt2, count(*) AS n FROM c WHERE asm1 + asm2 > 0 AND asm1 <= {CELLS} AND asm2 <= {CELLS} GROUP BY 1, 2)"
GC = "length(translate(kmer, 'at', ''))"
GCM = f"gm AS (SELECT {GC}::INT AS gc, whole AS cnt, count(*) AS n FROM c WHERE whole <= {CELLS} GROUP BY 1, 2)"
PEAKS = f"{JOINT}, {peak('cnt2', 'cnt1', CELLS, 'jm', 'px')}, {peak('cnt1', 'cnt2', CELLS, 'jm', 'py')}, pk AS (SELECT 'cnt1' AS axis, pos, height FROM px UNION ALL SELECT 'cnt2', pos, height FROM py)"


def smooth(cells: str, row: str, col: str, rows: int, height: str) -> str:
    return f"""SELECT r::BIGINT AS {row}, k::BIGINT AS {col}, least(coalesce(s, 0) // 4, ({height}))::BIGINT AS n
  FROM (SELECT unnest(range(0, {rows})) AS r) CROSS JOIN (SELECT unnest(range(0, {CELLS})) AS k)
  LEFT JOIN (SELECT {row} - a AS r, {col} - b AS k, sum(n)::BIGINT AS s FROM {cells}, (VALUES (0,0),(0,1),(1,0),(1,1)) v(a, b) GROUP BY 1, 2) USING (r, k) WHERE ({height}) IS NOT NULL"""


def banded(cells: str, row: str, col: str, bins: int) -> str:
    """Runs of cells of a row in one band, of smoothed cells."""
    return f"""SELECT {row}, min({col}) AS beg, max({col}) + 1 AS "end", band FROM (SELECT *, {col} - row_number() OVER (PARTITION BY {row}, band ORDER BY {col}) AS run FROM (
    SELECT {row}, {col}, least((n - low) * {bins} // greatest(high - low, 1), {bins - 1})::INT AS band FROM ({cells}) CROSS JOIN (SELECT min(n) AS low, max(n) AS high FROM ({cells})))) GROUP BY {row}, band, run"""


def prof(role: str) -> str:
    of = {"asm1": "seq_id % 8 IN (0,1,6)", "asm2": "seq_id % 8 IN (4,5,7)", "whole": "true"}[role]
    return f"SELECT seq_id, pos, {role} AS self_cnt, child AS read_cnt, mat AS mat_cnt, pat AS pat_cnt FROM km JOIN c USING (kmer) WHERE {of}"


QV = f"100 * (1 - pow(1 - miss / total, 1.0 / {K})) AS err_pct, CASE WHEN miss > 0 THEN -10 * log10(1 - pow(1 - miss / total, 1.0 / {K})) END AS qv"
CONTIGS = f"""runs AS (SELECT seq_id, pos, sum(new) OVER (PARTITION BY seq_id ORDER BY pos) AS contig FROM (SELECT seq_id, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY seq_id ORDER BY pos) > 1 THEN 1 ELSE 0 END AS new FROM km)),
  ctg AS (SELECT seq_id, contig::BIGINT AS contig, min(pos)::BIGINT AS beg, count(*) AS n_pos, count(*) + {K - 1} AS size FROM runs GROUP BY 1, 2)"""

UNBROKEN = """ub AS (SELECT doc_id, translate(lower(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'abcdefghijklmnopqrstuvwxyz', 'acgtacgtacgtacgtacgtacgtac') AS seq FROM documents)"""


def windows(source: str, key: str, name: str) -> str:
    return f"""{name} AS (SELECT {key}, pos, least(w, reverse(translate(w, 'acgt', 'tgca'))) AS kmer FROM (SELECT {key}, (i - 1)::INT AS pos, substr(seq, i, {K}) AS w FROM (SELECT {key}, seq, unnest(range(1, length(seq) - {K - 2})) AS i FROM {source} WHERE length(seq) >= {K})))"""


SITES = f"""WITH {UNBROKEN}, {windows('ub', 'doc_id', 'uk')},
  marks AS (SELECT kmer, count(*) FILTER (doc_id % 8 IN (0,1,2,3)) AS mat, count(*) FILTER (doc_id % 8 IN (2,3,4,5)) AS pat FROM uk GROUP BY kmer HAVING (mat > 0) != (pat > 0)),
  ch AS (SELECT doc_id // 8 AS seq_id, string_agg(seq, '' ORDER BY list_position([0,4,1,5,2,6,3,7], doc_id % 8)) AS seq FROM ub GROUP BY 1), {windows('ch', 'seq_id', 'ck')},
  sg AS (SELECT seq_id, pos, CASE WHEN mat > 0 THEN 1 ELSE -1 END AS sign FROM ck JOIN marks USING (kmer)),
  il AS (SELECT *, sum(new) OVER (PARTITION BY seq_id ORDER BY pos) AS island FROM (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY seq_id ORDER BY pos) >= {K} THEN 1 ELSE 0 END AS new FROM sg)),
  sites AS (SELECT seq_id, 0::BIGINT AS contig, min(pos)::BIGINT AS beg, (max(pos) + {K})::BIGINT AS "end", sum(sign)::BIGINT AS mrk, count(*) AS n FROM il GROUP BY seq_id, island),
  kept AS (SELECT *, abs(mrk) >= (n + 3) // 4 AS kept FROM sites)"""
PURE = f"""{SITES}, sw AS (SELECT seq_id, contig, beg, "end", mrk > 0 AS m, CASE WHEN mrk > 0 THEN ("end" - beg) - (n - mrk) // 2 ELSE (n + mrk) // 2 - ("end" - beg) END AS w FROM kept WHERE kept),
  tn AS (SELECT *, CASE WHEN lag(m) OVER (PARTITION BY seq_id, contig ORDER BY beg) != m THEN 1 ELSE 0 END AS t FROM sw), rn AS (SELECT *, sum(t) OVER (PARTITION BY seq_id, contig ORDER BY beg) AS run FROM tn)
  SELECT seq_id, contig, min(beg) AS beg, max("end") AS "end", sum(w)::BIGINT AS mrk FROM rn GROUP BY seq_id, contig, run"""

CTG = "seq_id, contig"
#: Phase blocks by recursion over the gaps between groups of anchors: of two equally good splits of a gap the choice depends on what the left group has got so far.
PHASED = f"""{PURE.replace(" SELECT seq_id, contig, min(beg) AS beg,", ", pure AS (SELECT seq_id, contig, min(beg) AS beg,")} ),
  pb AS (SELECT *, row_number() OVER (PARTITION BY {CTG} ORDER BY beg) - 1 AS i, count(*) OVER (PARTITION BY {CTG}) AS total, ("end" - beg >= 20000 OR abs(mrk) >= {5 * K}) AS anchor FROM pure),
  an AS (SELECT *, sum(CASE WHEN turn THEN 1 ELSE 0 END) OVER (PARTITION BY {CTG} ORDER BY i) AS g FROM (SELECT *, coalesce((mrk < 0) != lag(mrk < 0) OVER (PARTITION BY {CTG} ORDER BY i), false) AS turn FROM pb WHERE anchor)),
  gr AS (SELECT {CTG}, g, bool_or(mrk < 0) AS neg, min(i) AS fi, max(i) AS li, min(beg) AS beg, max("end") AS "end" FROM an GROUP BY {CTG}, g),
  gm AS (SELECT gr.seq_id, gr.contig, g, fi, li, any_value(gr.beg) AS beg, any_value(gr."end") AS "end", coalesce(sum(mrk) FILTER ((mrk < 0) = neg), 0) AS mrk, coalesce(sum(mrk) FILTER ((mrk < 0) != neg), 0) AS opp
    FROM gr JOIN pb ON pb.seq_id = gr.seq_id AND pb.contig = gr.contig AND i BETWEEN fi AND li GROUP BY gr.seq_id, gr.contig, g, fi, li),
  ng AS (SELECT {CTG}, any_value(total) AS total, min(beg) AS first_beg, (SELECT count(*) FROM gm WHERE gm.seq_id = pb.seq_id AND gm.contig = pb.contig) AS groups FROM pb GROUP BY {CTG}),
  gap AS (SELECT n.seq_id, n.contig, n.n, n.n = n.groups AS is_last, coalesce(l.li, -1) AS lo, coalesce(r.fi, n.total) AS hi FROM (SELECT *, unnest(range(0, groups + 1)) AS n FROM ng) n
    LEFT JOIN gm l ON l.seq_id = n.seq_id AND l.contig = n.contig AND l.g = n.n - 1 LEFT JOIN gm r ON r.seq_id = n.seq_id AND r.contig = n.contig AND r.g = n.n),
  gl AS (SELECT *, hi - lo - 1 + (hi - lo - 1) % 2 AS size, CASE WHEN is_last THEN 0 ELSE (hi - lo - 1) % 2 END AS shift FROM gap),
  sm AS (SELECT gl.seq_id, gl.contig, n, i - lo - 1 + shift AS j, beg, "end", mrk FROM gl JOIN pb ON pb.seq_id = gl.seq_id AND pb.contig = gl.contig AND i > lo AND i < hi),
  cuts AS (SELECT {CTG}, n, unnest(range(0, size + 1, 2)) AS cut FROM gl),
  op AS (SELECT c.seq_id, c.contig, c.n, cut, coalesce(sum(abs(mrk)) FILTER ((j < cut AND j % 2 = 0) OR (j > cut AND j % 2 = 1)), 0) AS cost,
    coalesce(sum(mrk) FILTER (j < cut AND j % 2 = 1), 0) AS l_own, coalesce(sum(mrk) FILTER (j < cut AND j % 2 = 0), 0) AS l_opp, coalesce(sum(mrk) FILTER (j >= cut AND j % 2 = 0), 0) AS r_own, coalesce(sum(mrk) FILTER (j >= cut AND j % 2 = 1), 0) AS r_opp,
    max("end") FILTER (j < cut) AS head_end, min(beg) FILTER (j >= cut) AS tail_beg, max("end") FILTER (j >= cut) AS tail_end
    FROM cuts c LEFT JOIN sm ON sm.seq_id = c.seq_id AND sm.contig = c.contig AND sm.n = c.n GROUP BY c.seq_id, c.contig, c.n, cut),
  be AS (SELECT * FROM (SELECT *, min(cost) OVER (PARTITION BY {CTG}, n) AS least FROM op) WHERE cost = least),
  pk AS (SELECT *, cut = min(cut) OVER (PARTITION BY {CTG}, n) AS early, cut = max(cut) OVER (PARTITION BY {CTG}, n) AS late FROM be),
  rc AS (SELECT c.seq_id, c.contig, c.n, c.cut, (coalesce(gm.mrk, 0) + c.r_own)::BIGINT AS held FROM pk c LEFT JOIN gm ON gm.seq_id = c.seq_id AND gm.contig = c.contig AND gm.g = 0 WHERE c.n = 0 AND early
    UNION ALL SELECT c.seq_id, c.contig, c.n, c.cut, (coalesce(gm.mrk, 0) + c.r_own)::BIGINT FROM rc JOIN pk c ON c.seq_id = rc.seq_id AND c.contig = rc.contig AND c.n = rc.n + 1
      LEFT JOIN gm ON gm.seq_id = c.seq_id AND gm.contig = c.contig AND gm.g = c.n WHERE CASE WHEN abs(rc.held) > abs(coalesce(gm.mrk, 0)) THEN late ELSE early END),
  pick AS (SELECT op.*, gl.is_last FROM rc JOIN op USING (seq_id, contig, n, cut) JOIN gl USING (seq_id, contig, n)),
  merged AS (SELECT {CTG}, -1 AS o, first_beg AS beg, head_end AS "end", l_own AS mrk, l_opp AS opp FROM pick JOIN ng USING (seq_id, contig) WHERE n = 0 AND cut > 0
    UNION ALL SELECT gm.seq_id, gm.contig, gm.g, coalesce(b.tail_beg, gm.beg), coalesce(a.head_end, gm."end"), gm.mrk + b.r_own + a.l_own, gm.opp + b.r_opp + a.l_opp FROM gm
      JOIN pick b ON b.seq_id = gm.seq_id AND b.contig = gm.contig AND b.n = gm.g JOIN pick a ON a.seq_id = gm.seq_id AND a.contig = gm.contig AND a.n = gm.g + 1
    UNION ALL SELECT {CTG}, n, tail_beg, tail_end, r_own, r_opp FROM pick WHERE is_last AND tail_beg IS NOT NULL AND r_own != 0),
  placed AS (SELECT *, row_number() OVER (PARTITION BY {CTG} ORDER BY o) - 1 AS block, count(*) OVER (PARTITION BY {CTG}) AS blocks FROM merged),
  snapped AS (SELECT p.seq_id, p.contig, block, CASE WHEN block = 0 THEN 0 ELSE beg END::BIGINT AS beg, CASE WHEN block = blocks - 1 THEN length(ch_seq.seq) ELSE "end" END::BIGINT AS "end", CASE WHEN mrk > 0 THEN 'mat' ELSE 'pat' END AS phase,
    abs(opp)::BIGINT AS switches, abs(mrk)::BIGINT AS own FROM placed p JOIN (SELECT doc_id // 8 AS seq_id, string_agg(seq, '') AS seq FROM ub GROUP BY 1) ch_seq ON ch_seq.seq_id = p.seq_id),
  phased AS (SELECT {CTG}, block, beg, "end", phase, 100.0::DOUBLE * switches / (switches + own) AS switch_pct, switches, switches + own AS markers,
    CASE WHEN phase = 'mat' THEN own ELSE switches END AS mat, CASE WHEN phase = 'mat' THEN switches ELSE own END AS pat, "end" - beg AS size FROM snapped)"""
PHASED = PHASED.replace("WITH ", "WITH RECURSIVE ", 1)


def curve(total: str) -> str:
    """Shares of the contigs' sum (total), or of a number."""
    return f"""WITH {SEQS}, {KMERS}, {CONTIGS}, s AS (SELECT size, (sum(size) OVER (ORDER BY size DESC, seq_id, contig ROWS UNBOUNDED PRECEDING))::BIGINT AS cum, (sum(size) OVER ())::BIGINT AS total FROM ctg),
          t AS (SELECT 'contig' AS type, size, cum, 100.0::DOUBLE * cum / {total} AS n, 100.0::DOUBLE * (cum - size) / {total} AS n2 FROM s)
          SELECT * FROM t UNION ALL SELECT 'contig', 0, max(cum), max(n), max(n) FROM t HAVING count(*) > 0"""


def outputs(of: dict[str, tuple[str, str]], cap: int) -> str:
    """Histograms of outputs: name -> which k-mers, and their counts."""
    each = " UNION ALL ".join(f"SELECT '{n}' AS output, ({cnt})::BIGINT AS cnt FROM c WHERE {on}" for n, (on, cnt) in of.items())
    return f"{BASE}, o AS ({each}) SELECT output, least(cnt, {cap})::BIGINT AS multiplicity, count(*) AS n_unique, sum(cnt)::BIGINT AS n_instances FROM o GROUP BY 1, 2"


ONLY_ASM1 = ("asm1 > 0 AND child = 0", "asm1")
COPIES = {"0": ("child > 0 AND asm1 = 0", "child"), **{str(n): (f"child > 0 AND asm1 = {n}", "child") for n in range(1, 5)}, "5": ("child > 0 AND asm1 >= 5", "child"), "6": ONLY_ASM1}
TWO = {
    "0": ("child > 0 AND asm1 = 0 AND asm2 = 0", "child"), "1": ("child > 0 AND asm1 > 0 AND asm2 = 0", "child"), "2": ("child > 0 AND asm1 = 0 AND asm2 > 0", "child"), "3": ("child > 0 AND asm1 > 0 AND asm2 > 0", "child"),
    "4": ("child = 0 AND asm1 > 0 AND asm2 > 0", "asm1 + asm2"), "5": ("child = 0 AND asm1 > 0 AND asm2 = 0", "asm1"), "6": ("child = 0 AND asm1 = 0 AND asm2 > 0", "asm2"),
}
SOLID_12 = {"0": ("asm1 > 0 AND child >= 12", "asm1"), "1": ("asm2 > 0 AND child >= 12", "asm2"), "2": ("asm1 + asm2 > 0 AND child >= 12", "asm1 + asm2")}


def _queries() -> dict[str, str]:
    q = {
        "expression_copy_number": outputs(COPIES, 1000),
        "expression_one_assembly": outputs({"0": COPIES["0"], "1": ("child > 0 AND asm1 > 0", "child"), "2": ONLY_ASM1}, 1000),
        "expression_two_assemblies": outputs(TWO, 1000),
        "expression_specific": f"{BASE} SELECT kmer, CASE WHEN pat = 0 THEN mat ELSE 0 END AS mat, CASE WHEN mat = 0 THEN pat ELSE 0 END AS pat FROM c WHERE (mat > 0) != (pat > 0)",
        "expression_inherited": f"{BASE}, o AS (SELECT kmer, CASE WHEN mat >= 2 AND pat = 0 THEN child ELSE 0 END AS mat, CASE WHEN pat >= 3 AND mat = 0 THEN child ELSE 0 END AS pat FROM c) SELECT kmer, mat, pat FROM o WHERE mat > 0 OR pat > 0",
        "expression_solid": outputs(SOLID_12, 1),
        "kmer_table": f"{BASE} SELECT kmer, whole AS cnt FROM c",
        "kmer_table_40": f"""WITH {SEQS}, {KMERS.replace(f"i, {K})", f"i, {LONG_K})").replace(f"length(seq) - {K - 2}", f"length(seq) - {LONG_K - 2}").replace(f"length(seq) >= {K}", f"length(seq) >= {LONG_K}")} SELECT kmer, count(*) AS cnt FROM km GROUP BY kmer""",
        "binary_table": f"{BASE} SELECT kmer, least(whole, 32767) AS cnt FROM c",
        "binary_histogram": f"{BASE} SELECT least(whole, 500)::BIGINT AS multiplicity, count(*) AS n_unique, sum(whole)::BIGINT AS n_instances FROM c GROUP BY 1",
        "binary_profiles": f"""{BASE}, pos AS (SELECT seq_id, unnest(range(0, length(seq) - {K - 1}))::INT AS pos FROM seqs WHERE length(seq) >= {K})
          SELECT pos.seq_id, pos.pos, least(coalesce(child, 0), 32767) AS read_cnt FROM pos LEFT JOIN km ON km.seq_id = pos.seq_id AND km.pos = pos.pos LEFT JOIN c USING (kmer)""",
        "kmer_seek_ordinal": f"{BASE}, o AS (SELECT row_number() OVER (ORDER BY kmer) - 1 AS ordinal, kmer, whole AS cnt, count(*) OVER () AS total FROM c) SELECT ordinal, kmer, cnt FROM o WHERE ordinal >= total // 2 AND ordinal < total // 2 + 1000",
        "kmer_seek_key": f"{BASE}, o AS (SELECT row_number() OVER (ORDER BY kmer) - 1 AS ordinal, kmer, whole AS cnt FROM c) SELECT ordinal, kmer, cnt FROM o WHERE kmer >= '{SEEK}' ORDER BY kmer LIMIT 1000",
        "table_full_outer": f"{BASE} SELECT kmer, asm1 AS cnt1, asm2 AS cnt2 FROM c WHERE asm1 > 0 OR asm2 > 0",
        "kmer_lookup": f"""{BASE}, bs AS (SELECT item_id, translate(lower(regexp_replace(text, '[^A-Za-z.\\n]', '', 'g')), 'abcdefghijklmnopqrstuvwxyz.' || chr(10), 'acgtacgtacgtacgtacgtacgtac--') AS seq FROM benchmark), {windows('bs', 'item_id', 'bk')}
          SELECT kmer, whole AS cnt FROM c WHERE kmer IN (SELECT kmer FROM bk)""",
        "kmer_hist": f"{BASE} {hist('whole')}",
        "kmer_hist_capped": f"{BASE} SELECT least(whole, 100)::BIGINT AS multiplicity, count(*) AS n_unique, sum(whole)::BIGINT AS n_instances FROM c GROUP BY 1",
        "kmer_hist_reranged": f"{BASE} SELECT greatest(2, least(whole, 50))::BIGINT AS multiplicity, count(*) AS n_unique, sum(whole)::BIGINT AS n_instances FROM c GROUP BY 1",
        "solid_threshold": f"{BASE}, {solid('whole')} SELECT thresh, solid_count FROM solid",
        "table_minus": f"{BASE} SELECT kmer, mat AS cnt FROM c WHERE mat > 0 AND pat = 0",
        "table_semi": f"{BASE} SELECT kmer, child AS cnt FROM c WHERE child > 0 AND asm1 > 0",
        "table_semi_filtered": f"{BASE} SELECT kmer, child AS cnt FROM c WHERE child > 0 AND asm1 >= 2",
        "table_inner_sum": f"{BASE} SELECT kmer, asm1 + asm2 AS cnt FROM c WHERE asm1 > 0 AND asm2 > 0",
        "table_union_sum": f"{BASE} SELECT kmer, asm1 + asm2 AS cnt FROM c WHERE asm1 > 0 OR asm2 > 0",
        "table_count_eq": f"{BASE} SELECT kmer, whole AS cnt FROM c WHERE whole = 3",
        "table_count_ge": f"{BASE} SELECT kmer, whole AS cnt FROM c WHERE whole >= 12",
        "cn_spectrum": f"{BASE} SELECT copies, class_ord::INT AS class_ord, multiplicity, n_unique, n_instances FROM ({CN})",
        "cn_zero": f"{BASE} SELECT CASE WHEN asm1 = 1 THEN '1' ELSE '>1' END AS copies, sum(asm1)::BIGINT AS n_instances FROM c WHERE child = 0 AND asm1 > 0 GROUP BY 1",
        "asm_spectrum_1": f"{BASE} SELECT CASE WHEN asm1 > 0 THEN 'asm1' ELSE 'read-only' END AS class, least(child, 1000)::BIGINT AS multiplicity, count(*) AS n_unique, sum(child)::BIGINT AS n_instances FROM c WHERE child > 0 GROUP BY 1, 2",
        "asm_spectrum_2": f"{BASE} SELECT {MEMBER} AS class, least(child, 1000)::BIGINT AS multiplicity, count(*) AS n_unique, sum(child)::BIGINT AS n_instances FROM c WHERE child > 0 GROUP BY 1, 2",
        "asm_zero": f"{BASE} SELECT {MEMBER} AS class, sum(asm1 + asm2)::BIGINT AS n_instances FROM c WHERE child = 0 AND asm1 + asm2 > 0 GROUP BY 1",
        "spectrum_plot": f"{BASE}, {CURVES} SELECT copies, class_ord::INT AS class_ord, multiplicity, n::BIGINT AS n FROM bins WHERE multiplicity < 1000",
        "plot_limits": f"""{BASE}, {CURVES}, tp AS (SELECT multiplicity AS m, n FROM bins WHERE copies != 'read-only' AND multiplicity > 3 AND multiplicity < 1000 ORDER BY n DESC, m LIMIT 1), z AS (SELECT coalesce(sum(asm1), 0) AS z FROM c WHERE child = 0)
          SELECT m * 2.5::DOUBLE AS x_limit, greatest(n * 1.1::DOUBLE, z * 1.1::DOUBLE) AS y_limit FROM tp, z""",
        "primary_peak": f"{BASE}, {CURVES} SELECT xmax, ymax FROM top",
        "stacked_peak": f"{BASE}, {STACK} SELECT xmax, ymax FROM stop",
        "stacked_limits": f"{BASE}, {STACK} SELECT floor((xmax + coalesce(m, xmax)) * 2.1 / 2)::BIGINT AS x_limit, floor(ymax * 1.1)::BIGINT AS y_limit FROM stop, ssec",
        "max_bucket": f"{BASE} SELECT max(n) AS n FROM (SELECT count(*) AS n FROM c GROUP BY substr(kmer, 1, 6))",
        "spectrum_peaks": f"{BASE}, {SECOND} SELECT xmax, ymax, xsec FROM peaks",
        "axis_limits": f"""{BASE}, {SECOND}, lim AS (SELECT floor((xmax + xsec) * 2.1 / 2)::BIGINT AS x0, floor(ymax * 1.1)::BIGINT AS y_limit FROM peaks),
          up AS (SELECT copies, multiplicity, sum(n) OVER (PARTITION BY copies ORDER BY multiplicity) AS upto, floor(sum(n) OVER (PARTITION BY copies)::DOUBLE * 0.98) AS want, max(n) OVER (PARTITION BY copies) AS ym FROM bins WHERE multiplicity < 1000),
          wd AS (SELECT copies, min(multiplicity) AS x, max(ym) AS ym FROM up WHERE upto > want GROUP BY 1)
          SELECT greatest(x0, (SELECT max(x) FROM wd, lim WHERE ym > 0.01 * y_limit)) AS x_limit, y_limit FROM lim""",
        "completeness": f"""{BASE}, {solid('child')}, f AS (SELECT count(*) FILTER (asm1 > 0) AS a, count(*) FILTER (asm2 > 0) AS b, count(*) FILTER (asm1 > 0 OR asm2 > 0) AS e FROM c, solid WHERE child >= thresh)
          SELECT assembly, found, solid_count AS total, 100.0::DOUBLE * found / solid_count AS pct FROM (SELECT 'asm1' AS assembly, a AS found FROM f UNION ALL SELECT 'asm2', b FROM f UNION ALL SELECT 'both', e FROM f), solid""",
        "parent_completeness": f"""{BASE} SELECT assembly, parent, found, total, 100.0::DOUBLE * found / total AS pct FROM (
          {' UNION ALL '.join(f"SELECT '{a}' AS assembly, '{p}' AS parent, count(*) FILTER ({p} > 0) AS found, count(*) AS total FROM c WHERE {a} > 0" for a in ('asm1', 'asm2') for p in ('mat', 'pat'))})""",
        "joint_matrix": f"{BASE} SELECT asm1 AS cnt1, asm2 AS cnt2, count(*) AS n FROM c WHERE asm1 + asm2 > 0 AND asm1 <= 1000 AND asm2 <= 1000 GROUP BY 1, 2",
        "joint_matrix_smoothed": f"{BASE}, {PEAKS} {smooth('jm', 'cnt1', 'cnt2', CELLS, 'SELECT max(height) FROM pk')}",
        **{f"contour_bands_{n}": f"{BASE}, {PEAKS}, sm AS ({smooth('jm', 'cnt1', 'cnt2', CELLS, 'SELECT max(height) FROM pk')}) {banded('SELECT * FROM sm', 'cnt1', 'cnt2', n)}" for n in (6, 12)},
        "contour_bands_gc": f"{BASE}, {GCM}, {peak('gc', 'cnt', K, 'gm', 'pg')}, sm AS ({smooth('gm', 'gc', 'cnt', K, 'SELECT max(height) FROM pg')}) {banded('SELECT * FROM sm', 'gc', 'cnt', 10)}",
        "matrix_peaks": f"{BASE}, {PEAKS} SELECT axis, pos, height FROM pk",
        "gc_matrix": f"{BASE} SELECT {GC}::INT AS gc, whole AS cnt, count(*) AS n FROM c WHERE whole <= 1000 GROUP BY 1, 2",
        "gc_matrix_smoothed": f"{BASE}, {GCM}, {peak('gc', 'cnt', K, 'gm', 'pg')} {smooth('gm', 'gc', 'cnt', K, 'SELECT max(height) FROM pg')}",
        "relative_profile": f"{BASE} SELECT seq_id, pos, self_cnt, read_cnt FROM ({prof('whole')})",
        "scaffold_qv": f"{BASE}, m AS (SELECT seq_id, count(*) FILTER (read_cnt = 0) AS miss, count(*) AS total FROM ({prof('whole')}) GROUP BY 1) SELECT seq_id, miss, total, {QV} FROM m",
        "assembly_qv": f"""{BASE}, m AS (SELECT a AS assembly, count(*) FILTER (read_cnt = 0) AS miss, count(*) AS total FROM (SELECT 'asm1' AS a, * FROM ({prof('asm1')}) UNION ALL SELECT 'asm2', * FROM ({prof('asm2')})) GROUP BY 1),
          e AS (SELECT * FROM m UNION ALL SELECT 'both', sum(miss)::BIGINT, sum(total)::BIGINT FROM m) SELECT assembly, miss, total, {QV} FROM e""",
        "unsupported_bed": f"""{BASE}, i AS (SELECT seq_id, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY seq_id ORDER BY pos) > {K} THEN 1 ELSE 0 END AS new FROM ({prof('whole')}) WHERE read_cnt = 0),
          j AS (SELECT seq_id, pos, sum(new) OVER (PARTITION BY seq_id ORDER BY pos) AS island FROM i) SELECT seq_id, min(pos)::BIGINT AS beg, (max(pos) + {K})::BIGINT AS "end" FROM j GROUP BY seq_id, island""",
        "contigs": f"WITH {SEQS}, {KMERS}, {CONTIGS} SELECT seq_id, contig, beg, n_pos, size FROM ctg",
        "scaffold_sizes": f"WITH {SEQS}, {KMERS}, {CONTIGS} SELECT 'scaffold' AS kind, 'all' AS grp, sum(n_pos)::BIGINT AS size FROM ctg GROUP BY seq_id UNION ALL SELECT 'contig', 'all', size FROM ctg",
        "contig_stats": f"""WITH {SEQS}, {KMERS}, {CONTIGS}, w AS (SELECT count(*) AS n, sum(size)::BIGINT AS total, min(size) AS mn, max(size) AS mx FROM ctg), r AS (SELECT size, sum(size) OVER (ORDER BY size DESC) AS run FROM ctg)
          SELECT n, total, mn AS min, total // n AS avg, (SELECT max(size) FROM r WHERE run >= w.total // 2) AS n50, mx AS max FROM w""",
        "n_curve": curve("total"),
        "ng_curve": curve(str(GENOME)),
        "hap_blob": f"""{BASE}, p AS (SELECT 'asm1' AS assembly, * FROM ({prof('asm1')}) UNION ALL SELECT 'asm2', * FROM ({prof('asm2')})),
          i AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY assembly, seq_id ORDER BY pos) > 1 THEN 1 ELSE 0 END AS new FROM p), j AS (SELECT *, (sum(new) OVER (PARTITION BY assembly, seq_id ORDER BY pos))::BIGINT AS contig FROM i)
          SELECT assembly, seq_id, contig, count(*) FILTER (mat_cnt > 0) AS mat, count(*) FILTER (pat_cnt > 0) AS pat, count(*) AS size FROM j GROUP BY 1, 2, 3""",
        "hap_sites": f'{SITES} SELECT seq_id, contig, beg, "end", mrk, n, kept FROM kept',
        "pure_blocks": PURE,
        "phase_blocks": f"{PHASED} SELECT * FROM phased",
        "block_blob": f"{PHASED} SELECT phase AS block, row_number() OVER (ORDER BY seq_id, contig, block) - 1 AS range, mat, pat, size FROM phased",
        "phase_totals": f"{PHASED} SELECT count(*) AS n, 100.0::DOUBLE * sum(switches) / sum(markers) AS switch_pct, sum(switches)::BIGINT AS switches, sum(markers)::BIGINT AS markers FROM phased HAVING count(*) > 0",
        "block_stats": f"""{PHASED}, w AS (SELECT count(*) AS n, sum(size)::BIGINT AS total, min(size) AS mn, max(size) AS mx FROM phased), r AS (SELECT size, sum(size) OVER (ORDER BY size DESC) AS run FROM phased)
          SELECT n, total, mn AS min, total // n AS avg, (SELECT max(size) FROM r WHERE run >= w.total // 2) AS n50, mx AS max FROM w""",
    }
    q["blob_limit"] = f"SELECT greatest(max(mat), max(pat)) * 1.01::DOUBLE AS \"limit\" FROM ({q['hap_blob']})"
    for own, other in (("mat", "pat"), ("pat", "mat")):
        q[f"specific_{own}"] = f"{BASE}, {specific(own, other)} SELECT kmer, cnt FROM sp"
        q[f"inherited_{own}"] = f"{BASE}, {inherited(own, other)} SELECT kmer, cnt FROM inh"
        q[f"hapmers_{own}"] = f"{BASE}, {hap(own, other)} SELECT kmer, cnt FROM inh, t2 WHERE cnt >= thresh"
    return q


ORACLES = _queries()
