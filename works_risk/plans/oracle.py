"""The same results in plain SQL, for checking the registered queries."""

from __future__ import annotations

from works_risk.operators.classify import ROUTES
from works_risk.operators.dossier import BENIGN, CLASSIFICATION, CLOSING, EXPLANATIONS, NO_FLAGS, ROUTE
from works_risk.plans.driver_tables import PARAMS
from works_risk.schema import FEATURE_COLUMNS

STALL, REF = PARAMS.stall_before.isoformat(), PARAMS.ref_date.isoformat()


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_MONEY = "CAST({} AS DECIMAL(18,2))"
# Fixed values, written out here so that a wrong text in the engine shows: reasons, narratives and explained signals.
_REASON = {
    "flag_unparseable": "unparseable/NA- work id (kept, flagged)",
    "flag_stalled": "stalled: sanctioned before 1999-01-01, never completed",
    "flag_incomplete": "sanctioned but never completed",
    "flag_sanction_overrun": "sanctioned > 120% of recommended amount",
    "flag_zero_disbursal": "sanctioned but zero amount disbursed",
    "flag_cost_overrun": "paid out more than sanctioned amount",
    "has_duplicate_lead": "duplicate-resubmission candidate (cross-FY, same MP+amount, description sim >= 0.8)",
    "is_anomaly": "anomalous on F1-F4 features (Isolation Forest)",
}
NARRATIVE_DUPLICATE = (
    "Duplicate-claim candidate: a near-identical work description for the same MP and amount appears in a "
    "different financial year (cross-FY partner)."
)
STALLED_NO_FUNDS, STALLED_ONLY = "zero amount disbursed", "no recorded completion"
NARRATIVE_OVERRUN = "Amount paid or sanctioned exceeds the recommended/sanctioned baseline (cost or sanction overrun)."
NARRATIVE_OUTLIER = "Statistical outlier on the engineered features (F1-F4) - unusual compared with other works."
NARRATIVE_NONE = "No detection signal."
EXPLAINED = {
    "duplicate_claim": ["duplicate_resubmission"],
    "siphoned_funds": ["stalled_no_funds", "stalled"],
    "ghost_work": ["stalled_no_funds", "stalled"],
    "over_invoicing": ["cost_overrun", "sanction_overrun"],
    "statistical_anomaly": ["anomaly"],
}
_NULL_REASON = {k: f"CASE WHEN {k} THEN {lit(v)} END" for k, v in _REASON.items()}
_RULE_REASONS = "CONCAT_WS('; ', " + ", ".join(v for k, v in _NULL_REASON.items() if k.startswith("flag_")) + ")"
_REASONS = "CONCAT_WS('; ', " + ", ".join(_NULL_REASON.values()) + ")"

CTES = {
    "ord": """
SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS work_no, CAST(o_custkey AS VARCHAR) AS mp_no, fy,
  'MP' || o_custkey || '/' || fy || '/' || o_orderkey AS work_id,
  n_name AS state, c_name AS mp_name, c_mktsegment AS constituency, o_orderpriority AS work_category,
  CAST(o_orderdate AS DATE) AS recommended_date, CAST(o_totalprice AS DECIMAL(18,2)) AS recommended_amount,
  CAST(c_acctbal AS DECIMAL(18,2)) AS alloc_limit,
  CASE WHEN c_nationkey = 0 THEN CAST(c_acctbal AS DECIMAL(18,2)) ELSE 0 END AS calamity_consent
FROM (SELECT *, CASE WHEN month(o_orderdate) >= 4 THEN year(o_orderdate) || '-' || (year(o_orderdate) + 1)
        ELSE (year(o_orderdate) - 1) || '-' || year(o_orderdate) END AS fy FROM orders)
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "san": """
SELECT l_orderkey, CAST(MIN(l_shipdate) AS DATE) AS sanction_date,
  CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS sanction_amount, MAX(l_linestatus) AS work_status
FROM lineitem WHERE l_linestatus = 'F' GROUP BY l_orderkey""",
    "com": """
SELECT l_orderkey, CAST(MAX(l_shipdate) AS DATE) AS completion_date,
  CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DECIMAL(18,2)) AS amount
FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey""",
    "ex": """
SELECT l_orderkey, COUNT(l_shipdate) AS exp_pay_count,
  CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS exp_total,
  CAST(COALESCE(SUM(CASE WHEN l_linestatus <> 'F' THEN CAST(l_extendedprice AS DECIMAL(18,2)) END), 0) AS DECIMAL(18,2)) AS exp_inprogress,
  CAST(COALESCE(SUM(CASE WHEN l_linestatus = 'F' THEN CAST(l_extendedprice AS DECIMAL(18,2)) END), 0) AS DECIMAL(18,2)) AS exp_paid,
  COUNT(DISTINCT l_suppkey) AS exp_vendors
FROM lineitem WHERE l_returnflag = 'A' GROUP BY l_orderkey""",
    "m": """
SELECT work_id, mp_no, fy, work_no, mp_name, state AS mp_state, state, constituency, work_category,
  COALESCE(work_status, '') AS work_status, recommended_date, recommended_amount, sanction_date,
  COALESCE(sanction_amount, 0) AS sanction_amount, completion_date,
  COALESCE(NULLIF(amount, 0), exp_total, 0) AS amount_disbursed, COALESCE(exp_pay_count, 0) AS exp_pay_count,
  COALESCE(exp_total, 0) AS exp_total, COALESCE(exp_inprogress, 0) AS exp_inprogress, COALESCE(exp_paid, 0) AS exp_paid,
  COALESCE(exp_vendors, 0) AS exp_vendors, alloc_limit, calamity_consent, TRUE AS is_recommended,
  san.l_orderkey IS NOT NULL AS is_sanctioned, com.l_orderkey IS NOT NULL AS is_completed,
  ex.l_orderkey IS NOT NULL AS has_expenditure
FROM ord LEFT JOIN san ON san.l_orderkey = o_orderkey LEFT JOIN com ON com.l_orderkey = o_orderkey
LEFT JOIN ex ON ex.l_orderkey = o_orderkey""",
    "feat": f"""
SELECT *,
  CASE WHEN recommended_amount > 0 AND sanction_amount > 0
    THEN CAST(sanction_amount - recommended_amount AS DOUBLE) / CAST(recommended_amount AS DOUBLE) END AS f1_sanction_delta_ratio,
  CASE WHEN sanction_amount > 0 THEN CAST(amount_disbursed AS DOUBLE) / CAST(sanction_amount AS DOUBLE) END AS f2_disbursed_ratio,
  CAST(exp_vendors AS DOUBLE) AS f3_vendor_count,
  CAST(date_diff('day', recommended_date, sanction_date) AS DOUBLE) AS f4_days_rec_to_san,
  CAST(date_diff('day', sanction_date, completion_date) AS DOUBLE) AS f4_days_san_to_done,
  CAST(date_diff('day', sanction_date, DATE '{REF}') AS DOUBLE) AS f4_days_san_to_ref,
  CAST(sanction_amount AS DOUBLE) AS aux_sanction_amount, CAST(amount_disbursed AS DOUBLE) AS aux_amount_disbursed,
  CAST(exp_total AS DOUBLE) AS aux_exp_total, CAST(alloc_limit AS DOUBLE) AS aux_alloc_limit,
  CAST(exp_pay_count AS DOUBLE) AS aux_exp_pay_count
FROM m""",
    "rule": f"""
SELECT *, starts_with(upper(trim(work_id)), 'NA-') AS flag_unparseable,
  is_sanctioned AND NOT is_completed AND COALESCE(sanction_date < DATE '{STALL}', FALSE) AS flag_stalled,
  is_sanctioned AND NOT is_completed AND sanction_date IS NOT NULL AS flag_incomplete,
  recommended_amount > 0 AND sanction_amount > recommended_amount * CAST(1.20 AS DECIMAL(6,2)) AS flag_sanction_overrun,
  is_sanctioned AND amount_disbursed = 0 AS flag_zero_disbursal,
  is_sanctioned AND exp_total > sanction_amount AS flag_cost_overrun
FROM m""",
    "keyed": """
SELECT *, mp_no || '|' || CAST(CAST(round_even(CAST(recommended_amount AS DOUBLE) / 1000, 0) AS BIGINT) AS VARCHAR) AS block FROM ord""",
    "claim": """
SELECT k.work_id, k.block, k.fy, d.doc_id, trim(d.text) AS text FROM keyed k
JOIN documents d ON d.doc_id = k.o_orderkey % (SELECT COUNT(*) FROM documents)
WHERE length(trim(d.text)) > 0 AND k.block IN (SELECT block FROM keyed GROUP BY block HAVING COUNT(*) > 1)""",
    "chars": """
SELECT doc_id, string_split(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), '') AS c FROM documents""",
    "slots": """
SELECT doc_id, slot, COUNT(*) AS n FROM (
  SELECT doc_id, unnest(list_transform(range(1, len(c) - 1),
    lambda i: (unicode(c[i]) * 961 + unicode(c[i + 1]) * 31 + unicode(c[i + 2])) % 1000003 % 384)) AS slot
  FROM chars WHERE len(c) >= 3) GROUP BY doc_id, slot""",
    "sizes": "SELECT doc_id, sqrt(SUM(n * n)) AS size, COUNT(*) AS filled, SUM(n) AS total, MAX(n) AS peak FROM slots GROUP BY doc_id",
    "pairs": """
SELECT a.work_id AS work_a, b.work_id AS work_b, a.fy <> b.fy AS cross_fy, a.doc_id AS doc_a, b.doc_id AS doc_b,
  (SELECT SUM(x.n * y.n) FROM slots x JOIN slots y ON x.slot = y.slot WHERE x.doc_id = a.doc_id AND y.doc_id = b.doc_id)
    / (sa.size * sb.size) AS similarity
FROM claim a JOIN claim b ON a.block = b.block AND a.work_id < b.work_id
JOIN sizes sa ON sa.doc_id = a.doc_id JOIN sizes sb ON sb.doc_id = b.doc_id""",
    "near": "SELECT * FROM pairs WHERE similarity >= 0.8",
    "sig": """
SELECT work_id, COUNT(*) AS dup_partner_count, MAX(LEAST(similarity, 1.0)) AS dup_partner_sim_max,
  COUNT(*) FILTER (WHERE cross_fy) AS dup_partner_cross_fy
FROM (SELECT work_a AS work_id, similarity, cross_fy FROM near UNION ALL SELECT work_b, similarity, cross_fy FROM near)
GROUP BY work_id""",
    "slots2": """
SELECT doc_id, slot, COUNT(*) AS n FROM (
  SELECT doc_id, unnest(list_transform(range(1, len(c)), lambda i: (unicode(c[i]) * 31 + unicode(c[i + 1])) % 1000003 % 384)) AS slot
  FROM chars WHERE len(c) >= 2) GROUP BY doc_id, slot""",
    "sizes2": "SELECT doc_id, sqrt(SUM(n * n)) AS size FROM slots2 GROUP BY doc_id",
    "equals": """
SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, a.lang, a.source AS source_a, b.source AS source_b
FROM documents a JOIN documents b ON a.lang = b.lang AND a.n_chars = b.n_chars AND CAST(a.doc_id AS VARCHAR) < CAST(b.doc_id AS VARCHAR)
WHERE length(trim(a.text)) >= 10 AND length(trim(b.text)) >= 10""",
    "swept": """
SELECT 'tuned' AS model, e.*, (SELECT SUM(x.n * y.n) FROM slots x JOIN slots y ON x.slot = y.slot WHERE x.doc_id = doc_a AND y.doc_id = doc_b)
  / (sa.size * sb.size) AS s
FROM equals e JOIN sizes sa ON sa.doc_id = doc_a JOIN sizes sb ON sb.doc_id = doc_b
UNION ALL
SELECT 'frozen', e.*, (SELECT SUM(x.n * y.n) FROM slots2 x JOIN slots2 y ON x.slot = y.slot WHERE x.doc_id = doc_a AND y.doc_id = doc_b)
  / (sa.size * sb.size)
FROM equals e JOIN sizes2 sa ON sa.doc_id = doc_a JOIN sizes2 sb ON sb.doc_id = doc_b""",
    "judge": f"""
SELECT *, {_REASONS} AS reasons,
  CAST(LEAST(GREATEST(CASE WHEN flag_stalled THEN 35 ELSE 0 END + CASE WHEN flag_unparseable THEN 10 ELSE 0 END
    + CASE WHEN flag_sanction_overrun THEN 15 ELSE 0 END + CASE WHEN flag_zero_disbursal THEN 20 ELSE 0 END
    + CASE WHEN has_duplicate_lead THEN 25 ELSE 0 END + CASE WHEN is_anomaly THEN 20 ELSE 0 END, 0), 100) AS BIGINT) AS risk_score,
  CASE WHEN has_duplicate_lead THEN 'duplicate_claim' WHEN flag_stalled AND flag_zero_disbursal THEN 'siphoned_funds'
    WHEN flag_stalled THEN 'ghost_work' WHEN flag_cost_overrun OR flag_sanction_overrun THEN 'over_invoicing'
    ELSE 'statistical_anomaly' END AS pattern,
  list_filter([CASE WHEN has_duplicate_lead THEN 'duplicate_resubmission' END,
    CASE WHEN flag_stalled AND flag_zero_disbursal THEN 'stalled_no_funds' WHEN flag_stalled THEN 'stalled' END,
    CASE WHEN flag_zero_disbursal THEN 'zero_disbursal' END, CASE WHEN flag_cost_overrun THEN 'cost_overrun' END,
    CASE WHEN flag_sanction_overrun THEN 'sanction_overrun' END, CASE WHEN is_anomaly THEN 'anomaly' END],
    lambda s: s IS NOT NULL) AS signals
FROM (SELECT rule.*, COALESCE(dup_partner_cross_fy, 0) > 0 AS has_duplicate_lead, CAST(work_no AS BIGINT) % 20 = 3 AS is_anomaly
  FROM rule LEFT JOIN sig USING (work_id))""",
    "flags": f"""
SELECT *, reasons <> '' AS is_flagged,
  CASE WHEN reasons = '' THEN '' ELSE pattern END AS fraud_type,
  CASE pattern
    WHEN 'duplicate_claim' THEN {lit(NARRATIVE_DUPLICATE)}
    WHEN 'siphoned_funds' THEN 'Work was sanctioned (' || regexp_replace(CAST(sanction_amount AS VARCHAR), '0$', '')
      || ') but has not been completed and has {STALLED_NO_FUNDS}.'
    WHEN 'ghost_work' THEN 'Work was sanctioned (' || regexp_replace(CAST(sanction_amount AS VARCHAR), '0$', '')
      || ') but has not been completed and has {STALLED_ONLY}.'
    WHEN 'over_invoicing' THEN {lit(NARRATIVE_OVERRUN)}
    ELSE {lit(NARRATIVE_OUTLIER)} END AS narrative
FROM judge""",
    "route": "SELECT * FROM (VALUES "
    + ", ".join(
        f"({lit(t)}, {lit('|'.join(s))}, {lit('; '.join(s))}, {lit(r)}, {lit(n)}, {lit(w)})" for t, s, r, n, w in ROUTES
    )
    + ") t(route_type, statutes, statute_line, refer_to, note, route)",
    "mps": """
SELECT mp_no, mp_name, mp_state, COUNT(work_id) AS works, COUNT(*) FILTER (WHERE is_sanctioned) AS sanctioned,
  COUNT(*) FILTER (WHERE is_completed) AS completed, SUM(recommended_amount) AS recommended_total,
  SUM(sanction_amount) AS sanctioned_total, SUM(amount_disbursed) AS disbursed_total, SUM(exp_total) AS spent_total,
  MAX(alloc_limit) AS alloc_limit, COUNT(*) FILTER (WHERE flag_stalled) AS stalled,
  COUNT(*) FILTER (WHERE flag_zero_disbursal) AS zero_disbursal, COUNT(*) FILTER (WHERE has_duplicate_lead) AS dup_leads,
  COUNT(*) FILTER (WHERE is_anomaly) AS anomalies, AVG(risk_score) AS avg_risk_per_work,
  CASE WHEN MAX(alloc_limit) > 0 THEN CAST(SUM(exp_total) AS DOUBLE) / CAST(MAX(alloc_limit) AS DOUBLE) * 100 END AS spend_pct_alloc,
  3 * COUNT(*) FILTER (WHERE flag_stalled) + 4 * COUNT(*) FILTER (WHERE has_duplicate_lead)
    + 2 * COUNT(*) FILTER (WHERE is_anomaly) + 2 * COUNT(*) FILTER (WHERE flag_zero_disbursal) AS cumulative_risk_points
FROM flags WHERE mp_no IS NOT NULL GROUP BY mp_no, mp_name, mp_state""",
    "raw": """
SELECT work_id,
  'Work category: ' || work_category || '; WORK: WS/' || work_id || '-Order ' || work_no || '; State: ' || state
    || '; Recommended date: ' || strftime(recommended_date, '%d-%b-%Y') || '; RECOMMENDED AMOUNT   ( ₹ ): ' || recommended_amount AS raw_rec,
  'Work category: ' || work_category || '; Work: WS/' || work_id || '-Order ' || work_no || '; State: ' || state
    || '; Sanction Date: ' || strftime(san.sanction_date, '%d-%b-%Y') || '; Sanction Amount ( ₹ ): ' || san.sanction_amount
    || '; Work Status: ' || san.work_status AS raw_san,
  'Work: WS/' || work_id || '-Order ' || work_no || '; State: ' || state || '; Completion Date: '
    || strftime(completion_date, '%d-%b-%Y') || '; Amount Disbursed ( ₹ ): ' || amount AS raw_com,
  'State: ' || state || '; Work: Order ' || work_no || '; Work ID: WS/' || work_id || '; Expenditure Date: '
    || strftime(p.paid_on, '%d-%b-%Y') || '; Payment Status: ' || p.status || '; Fund Disbursed Amount ( ₹ ): ' || p.amt AS raw_exp
FROM ord LEFT JOIN san ON san.l_orderkey = o_orderkey LEFT JOIN com ON com.l_orderkey = o_orderkey
LEFT JOIN (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY paid_on, amt, status) AS rn FROM (
  SELECT l_orderkey, CAST(l_shipdate AS DATE) AS paid_on, CAST(l_extendedprice AS DECIMAL(18,2)) AS amt,
    CASE WHEN l_linestatus = 'F' THEN 'Payment Success' ELSE 'Payment In-Progress' END AS status
  FROM lineitem WHERE l_returnflag = 'A')) WHERE rn = 1) p ON p.l_orderkey = o_orderkey""",
    "doss": f"""
SELECT work_id, risk_score, reasons,
  trim(regexp_replace(work_id, '[^A-Za-z0-9._-]', '_', 'g'), '_') || '.md' AS file_name,
  CONCAT_WS(chr(10), '# Work ' || work_id, '', '- **Risk score:** `' || risk_score || '/100`  ',
    '- **Suspected pattern:** `' || pattern || '`  ', '- **Flags:** ' || COALESCE(NULLIF(reasons, ''), {lit(NO_FLAGS)}), '',
    '## Flag reasoning', '', '> ' || reasons, '', {lit(CLASSIFICATION)}, '',
    '- Signals: `' || COALESCE(NULLIF(array_to_string(signals, ', '), ''), 'none') || '`', '- Narrative: ' || narrative, '',
    {lit(ROUTE)}, '', '- Route: **' || route || '**',
    CASE WHEN statute_line <> '' THEN '- Statutory areas to assess: ' || statute_line END,
    '- Refer to: ' || refer_to, '- Note: ' || note, '',
    '## Raw Recommended row', '', COALESCE(raw_rec, '_missing_'), '', '## Raw Sanctioned row', '', COALESCE(raw_san, '_missing_'), '',
    '## Raw Completed row', '', COALESCE(raw_com, '_missing_'), '', '## Raw Expenditure row', '', COALESCE(raw_exp, '_missing_'), '',
    {", ".join(lit(x) for x in EXPLANATIONS)},
    {", ".join(f"CASE WHEN {c} THEN CONCAT_WS(chr(10), " + ", ".join(lit(x) for x in t) + ") END" for c, t in BENIGN.items())},
    {", ".join(lit(x) for x in CLOSING)}) AS dossier_md
FROM flags JOIN route ON route_type = pattern JOIN raw USING (work_id) WHERE is_flagged""",
    "vec": "SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, list_transform(CAST(embedding AS DOUBLE[]), lambda x: sign(x) * sqrt(abs(x))) AS h FROM embeddings",
    "vpairs": """
SELECT a.label, a.vec_id AS work_a, b.vec_id AS work_b, list_cosine_similarity(a.v, b.v) AS s_all, list_cosine_similarity(a.h, b.h) AS s_half
FROM vec a JOIN vec b ON a.label = b.label AND a.vec_id < b.vec_id""",
    "npairs": """
SELECT a.vec_id AS pair_a, b.vec_id AS pair_b, CASE WHEN a.label = b.label THEN 'MATCH' ELSE 'NOT_MATCH' END AS expected,
  CAST(a.label = b.label AS INT) AS label, list_cosine_similarity(a.v, b.v) AS after, list_cosine_similarity(a.h, b.h) AS before
FROM vec a JOIN vec b ON b.vec_id = a.vec_id + 1""",
    "models": """
SELECT 'after' AS model, pair_a, expected, label, after AS cosine FROM npairs
UNION ALL SELECT 'before', pair_a, expected, label, before FROM npairs""",
}

NEEDS = {
    "m": ["ord", "san", "com", "ex"],
    "feat": ["m"],
    "rule": ["m"],
    "keyed": ["ord"],
    "claim": ["keyed"],
    "slots": ["chars"],
    "sizes": ["slots"],
    "pairs": ["claim", "sizes"],
    "near": ["pairs"],
    "sig": ["near"],
    "slots2": ["chars"],
    "sizes2": ["slots2"],
    "swept": ["equals", "sizes", "sizes2"],
    "judge": ["rule", "sig"],
    "flags": ["judge"],
    "mps": ["flags"],
    "raw": ["ord", "san", "com"],
    "doss": ["flags", "route", "raw"],
    "vpairs": ["vec"],
    "npairs": ["vec"],
    "models": ["npairs"],
}
# Read more than once, so worth computing once.
STORED = {"slots", "sizes", "slots2", "sizes2", "near", "flags", "chars", "claim"}


def query(body: str, *needs: str) -> str:
    """``body`` with the named common tables, and what they need, in front."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for name in needs:
        add(name)
    if not order:
        return body
    tables = ",\n".join(f"{n} AS {'MATERIALIZED ' if n in STORED else ''}({CTES[n]})" for n in order)
    return f"WITH {tables}\n{body}"


_DAY = "COALESCE(CAST({0} AS VARCHAR), NULL) AS {0}"
_DBL = "CAST({0} AS DOUBLE) AS {0}"
_MASTER = (
    "work_id, mp_no, fy, work_no, mp_name, mp_state, state, constituency, work_category, work_status, "
    + ", ".join(_DAY.format(c) for c in ("recommended_date", "sanction_date", "completion_date"))
    + ", "
    + ", ".join(
        _DBL.format(c)
        for c in (
            "recommended_amount",
            "sanction_amount",
            "amount_disbursed",
            "exp_total",
            "exp_inprogress",
            "exp_paid",
            "alloc_limit",
            "calamity_consent",
        )
    )
    + ", exp_pay_count, exp_vendors, is_recommended, is_sanctioned, is_completed, has_expenditure"
)
_TOTALS = "recommended_total, sanctioned_total, disbursed_total, spent_total, alloc_limit".split(", ")
_EXPLAIN = "CASE pattern " + " ".join(f"WHEN '{p}' THEN [{', '.join(lit(s) for s in e)}]" for p, e in EXPLAINED.items()) + " END"
_ANY_FLAG = "flag_stalled OR flag_sanction_overrun OR flag_unparseable OR flag_zero_disbursal OR flag_cost_overrun"
_MEDIANS = ", ".join(f"MEDIAN({c}) AS md_{c}" for c in FEATURE_COLUMNS)
_PRESENT = " + ".join(f"CAST({c} IS NOT NULL AS INT)" for c in FEATURE_COLUMNS)


def _ranks(value: str) -> str:
    return f"RANK() OVER (PARTITION BY model ORDER BY {value}) + (COUNT(*) OVER (PARTITION BY model, {value}) - 1) / 2.0"


_JOB = query(
    "SELECT work_id, "
    + ", ".join(_DBL.format(c) for c in ("recommended_amount", "sanction_amount", "amount_disbursed", "exp_total", "alloc_limit", "calamity_consent"))
    + """, exp_pay_count, exp_vendors, flag_unparseable, flag_stalled, flag_incomplete, flag_sanction_overrun, flag_zero_disbursal, flag_cost_overrun,
  COALESCE(dup_partner_count, 0) AS dup_partner_count, round(COALESCE(dup_partner_sim_max, 0), 4) AS dup_partner_sim_max,
  COALESCE(dup_partner_cross_fy, 0) AS dup_partner_cross_fy, COALESCE(dup_partner_cross_fy, 0) > 0 AS has_duplicate_lead
FROM rule LEFT JOIN sig USING (work_id)""",
    "rule",
    "sig",
)

_RATE = """
SELECT event_id AS seq, user_id AS key, recent, recent <= 3 AS allowed FROM (
  SELECT event_id, user_id, COUNT(*) OVER (PARTITION BY user_id ORDER BY ts
    RANGE BETWEEN INTERVAL '21599.999999' SECOND PRECEDING AND CURRENT ROW) AS recent FROM events)"""

ORACLE = {
    "clean_ids": query(
        """
SELECT o_orderkey AS row, work_id, mp_no, fy, work_no, CASE WHEN na THEN '' ELSE work_category END AS work_title,
  CASE WHEN NOT na AND fy LIKE '20%' THEN work_id ELSE '' END AS recent_id, mp_name, na AS flag_unparseable
FROM (SELECT o_orderkey, na, mp_name, work_category,
  CASE WHEN na THEN 'NA-' || work_no || '-' || split_part(work_category, ' ', 1) ELSE work_id END AS work_id,
  CASE WHEN na THEN work_no ELSE mp_no END AS mp_no, CASE WHEN na THEN '' ELSE fy END AS fy,
  CASE WHEN na THEN '' ELSE work_no END AS work_no
  FROM (SELECT *, o_orderkey % 500 = 0 AS na FROM ord))""",
        "ord",
    ),
    "money_dates": """
SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS amount,
  CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS DOUBLE) AS digits_only, CAST(0 AS DOUBLE) AS no_number,
  CASE WHEN o_orderstatus IN ('F', 'O') THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) ELSE '' END AS day
FROM orders""",
    "text_norm": """
SELECT doc_id, md5(t) AS text_hash, length(t) AS chars, length(trim(text)) > 0 AS usable, length(trim(text)) >= 10 AS long_enough,
  source || '_' || lang || '__' || doc_id AS file_name, CASE WHEN lang = 'en' THEN CAST(n_chars AS DOUBLE) ELSE 0 END AS number
FROM (SELECT *, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS t FROM documents)""",
    "id_union": query("SELECT work_id FROM ord", "ord"),
    "stage_ids": query(
        """
SELECT work_id FROM ord WHERE o_orderkey % 10 <> 0 OR o_orderkey IN (SELECT l_orderkey FROM lineitem
  WHERE l_linestatus = 'F' OR l_returnflag IN ('R', 'A'))""",
        "ord",
    ),
    "stage_master": query(
        """
SELECT work_id, mp_no, fy, work_no,
  CASE WHEN rec OR is_sanctioned OR is_completed THEN mp_name ELSE '' END AS mp_name,
  CASE WHEN rec OR is_sanctioned OR is_completed THEN state ELSE '' END AS state, CASE WHEN rec THEN work_category ELSE '' END AS work_category,
  work_status, CASE WHEN rec THEN CAST(recommended_amount AS DOUBLE) ELSE 0 END AS recommended_amount, CAST(sanction_amount AS DOUBLE) AS sanction_amount,
  CAST(amount_disbursed AS DOUBLE) AS amount_disbursed, CAST(exp_total AS DOUBLE) AS exp_total, exp_pay_count, exp_vendors, rec AS is_recommended,
  is_sanctioned, is_completed, has_expenditure
FROM (SELECT *, CAST(work_no AS BIGINT) % 10 <> 0 AS rec FROM m) WHERE rec OR is_sanctioned OR is_completed OR has_expenditure""",
        "m",
    ),
    "unparseable_flags": query(
        """
SELECT CASE WHEN na THEN ' na-' || work_no ELSE work_id END AS work_id, na AS flag_unparseable, reasons,
  CAST(LEAST(CASE WHEN flag_stalled THEN 35 ELSE 0 END + CASE WHEN na THEN 10 ELSE 0 END + CASE WHEN flag_sanction_overrun THEN 15 ELSE 0 END
    + CASE WHEN flag_zero_disbursal THEN 20 ELSE 0 END, 100) AS BIGINT) AS risk_score, reasons <> '' AS is_flagged,
  CASE WHEN reasons = '' THEN '' ELSE pattern END AS fraud_type,
  CAST(CASE WHEN reasons = '' THEN 0 WHEN pattern = 'siphoned_funds' THEN 2 WHEN pattern = 'ghost_work' THEN 3 WHEN pattern = 'over_invoicing' THEN 4 ELSE 5 END AS BIGINT) AS fraud_priority,
  CASE WHEN reasons = '' THEN '[]' ELSE CONCAT_WS(',', CASE WHEN flag_stalled AND flag_zero_disbursal THEN 'stalled_no_funds' WHEN flag_stalled THEN 'stalled' END,
    CASE WHEN flag_zero_disbursal THEN 'zero_disbursal' END, CASE WHEN flag_cost_overrun THEN 'cost_overrun' END,
    CASE WHEN flag_sanction_overrun THEN 'sanction_overrun' END) END AS fraud_signals
FROM (SELECT *, CASE WHEN flag_stalled AND flag_zero_disbursal THEN 'siphoned_funds' WHEN flag_stalled THEN 'ghost_work'
    WHEN flag_cost_overrun OR flag_sanction_overrun THEN 'over_invoicing' ELSE 'statistical_anomaly' END AS pattern,
    """
        + _RULE_REASONS.replace("WHEN flag_unparseable", "WHEN na")
        + """ AS reasons
  FROM (SELECT *, CAST(work_no AS BIGINT) % 500 = 0 AS na FROM rule))""",
        "rule",
    ),
    "ordered_dedupe": """
SELECT user_id, MIN(event_id) AS first_id, arg_min(event_type, event_id) AS first_type, arg_min(value, event_id) AS first_value,
  MAX(event_id) AS last_id, arg_max(event_type, event_id) AS last_type, arg_max(value, event_id) AS last_value
FROM events GROUP BY user_id""",
    "expenditure_agg": query(
        "SELECT CAST(l_orderkey AS VARCHAR) AS work_no, exp_pay_count, CAST(exp_total AS DOUBLE) AS exp_total, exp_vendors FROM ex", "ex"
    ),
    "payment_split": query(
        "SELECT CAST(l_orderkey AS VARCHAR) AS work_no, CAST(exp_total AS DOUBLE) AS exp_total, "
        "CAST(exp_inprogress AS DOUBLE) AS exp_inprogress, CAST(exp_paid AS DOUBLE) AS exp_paid FROM ex",
        "ex",
    ),
    "master": query(f"SELECT {_MASTER} FROM m", "m"),
    "features": query(
        "SELECT work_id, round(f1_sanction_delta_ratio, 6) AS f1_sanction_delta_ratio, round(f2_disbursed_ratio, 6) AS f2_disbursed_ratio, "
        + ", ".join(FEATURE_COLUMNS[2:])
        + " FROM feat",
        "feat",
    ),
    "rule_flags": query(
        f"""SELECT work_id, flag_unparseable, flag_stalled, flag_incomplete, flag_sanction_overrun, flag_zero_disbursal, flag_cost_overrun,
  {_RULE_REASONS} AS reasons FROM rule""",
        "rule",
    ),
    "risk": query("SELECT work_id, reasons, risk_score, is_flagged FROM flags", "flags"),
    "classify": query(
        f"""
SELECT work_id, fraud_type, CAST(CASE fraud_type WHEN '' THEN 0 WHEN 'duplicate_claim' THEN 1 WHEN 'siphoned_funds' THEN 2
  WHEN 'ghost_work' THEN 3 WHEN 'over_invoicing' THEN 4 ELSE 5 END AS BIGINT) AS fraud_priority,
  CASE WHEN is_flagged THEN COALESCE(array_to_string(signals, ','), '') ELSE '[]' END AS fraud_signals,
  CASE WHEN is_flagged THEN narrative ELSE {lit(NARRATIVE_NONE)} END AS fraud_narrative,
  COALESCE(array_to_string(list_filter(signals, lambda s: NOT list_contains({_EXPLAIN}, s)), ','), '') AS corroboration
FROM flags""",
        "flags",
    ),
    "routes": query(
        """SELECT work_id, fraud_type, statutes, refer_to, note, route FROM flags
JOIN route ON route_type = CASE WHEN fraud_type = '' THEN 'statistical_anomaly' ELSE fraud_type END""",
        "flags",
        "route",
    ),
    "missing_routes": query(
        "SELECT COUNT(*) AS missing FROM (SELECT DISTINCT fraud_type FROM flags WHERE fraud_type <> '') "
        "WHERE fraud_type NOT IN (SELECT route_type FROM route)",
        "flags",
        "route",
    ),
    "summary": query(
        f"""
SELECT COUNT(*) AS total_works, COUNT(*) FILTER (WHERE is_flagged) AS flagged,
  COUNT(*) FILTER (WHERE is_flagged AND regexp_matches(reasons, '(?i)stalled|overrun|unparseable|zero disbursal')) AS with_any_rule,
  COUNT(*) FILTER (WHERE is_flagged AND ({_ANY_FLAG})) AS with_any_flag,
  COUNT(*) FILTER (WHERE is_flagged AND has_duplicate_lead) AS duplicate_leads, COUNT(*) FILTER (WHERE is_anomaly) AS anomalies,
  COUNT(*) FILTER (WHERE flag_stalled) AS stalled, COUNT(*) FILTER (WHERE flag_zero_disbursal) AS zero_disbursal,
  COUNT(*) FILTER (WHERE flag_sanction_overrun) AS sanction_overrun, CAST(MAX(risk_score) AS DOUBLE) AS highest_risk
FROM flags""",
        "flags",
    ),
    "load_summary": query(
        "SELECT COUNT(*) AS works, COUNT(*) FILTER (WHERE is_flagged) AS flagged, 'driver tables' AS source FROM flags", "flags"
    ),
    "pattern_counts": query("SELECT fraud_type, COUNT(*) AS works FROM flags GROUP BY fraud_type", "flags"),
    "mp_aggregate": query(
        "SELECT mp_no, mp_name, mp_state, works, sanctioned, completed, stalled, zero_disbursal, dup_leads, anomalies, cumulative_risk_points, "
        + ", ".join(_DBL.format(c) for c in _TOTALS)
        + ", round(avg_risk_per_work, 4) AS avg_risk_per_work, round(spend_pct_alloc, 4) AS spend_pct_alloc FROM mps",
        "mps",
    ),
    "mp_rank": query(
        """SELECT mp_no, mp_name, cumulative_risk_points,
  ROW_NUMBER() OVER (ORDER BY cumulative_risk_points DESC, mp_no, mp_name, mp_state) AS risk_rank FROM mps""",
        "mps",
    ),
    "top_offenders": query(
        """SELECT mp_no, mp_name, works, stalled, zero_disbursal, dup_leads, cumulative_risk_points FROM mps
ORDER BY cumulative_risk_points DESC, mp_no, mp_name, mp_state LIMIT 20""",
        "mps",
    ),
    "mp_points": query("SELECT work_id, risk_score, cumulative_risk_points FROM flags JOIN mps USING (mp_no, mp_name, mp_state)", "mps"),
    "mp_delay": query(
        """SELECT mp_no, mp_name, mp_state, round(AVG(date_diff('day', recommended_date, sanction_date)), 4) AS avg_days_to_sanction,
  round(AVG(date_diff('day', sanction_date, completion_date)), 4) AS avg_days_to_complete,
  COUNT(*) FILTER (WHERE flag_cost_overrun) AS cost_overruns, COUNT(*) FILTER (WHERE flag_sanction_overrun) AS sanction_overruns
FROM flags GROUP BY mp_no, mp_name, mp_state""",
        "flags",
    ),
    "roster_complete": query(
        """SELECT c_name AS mp_name, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DOUBLE) AS alloc_limit, COALESCE(works, 0) AS works,
  COALESCE(flagged, 0) AS flagged FROM customer LEFT JOIN (SELECT mp_name, COUNT(*) AS works, COUNT(*) FILTER (WHERE is_flagged) AS flagged
  FROM flags GROUP BY mp_name) ON mp_name = c_name""",
        "flags",
    ),
    "works_page": query(
        """SELECT work_id, mp_name, state, fraud_type, risk_score, COUNT(*) OVER () AS total FROM flags
WHERE is_flagged AND risk_score >= 20 AND contains(lower(mp_name), 'customer#0000') AND contains(lower(state), 'nation_1')
ORDER BY risk_score DESC, work_id LIMIT 50 OFFSET 50""",
        "flags",
    ),
    "deep_page": query(
        """SELECT work_id, mp_name, state, fraud_type, risk_score, (SELECT COUNT(*) FROM flags) AS total FROM flags
ORDER BY risk_score DESC, work_id LIMIT 50 OFFSET (SELECT (GREATEST(COUNT(*) // 50, 1) - 1) * 50 FROM flags)""",
        "flags",
    ),
    "work_lookup": query(
        "SELECT work_id, risk_score, dossier_md AS evidence FROM doss ORDER BY risk_score DESC, work_id LIMIT 1", "doss"
    ),
    "block_pairs": query(
        "SELECT label, work_a, work_b, round(s_all, 4) AS similarity FROM vpairs WHERE s_all >= 0.2", "vpairs"
    ),
    "dup_signals": query(
        """SELECT work_id, COALESCE(dup_partner_count, 0) AS dup_partner_count, round(COALESCE(dup_partner_sim_max, 0), 4) AS dup_partner_sim_max,
  COALESCE(dup_partner_cross_fy, 0) AS dup_partner_cross_fy, COALESCE(dup_partner_cross_fy, 0) > 0 AS has_duplicate_lead
FROM ord LEFT JOIN sig USING (work_id)""",
        "ord",
        "sig",
    ),
    "sweep_signals": query(
        """SELECT work_id, COALESCE(dup_partner_count, 0) AS dup_partner_count, round(COALESCE(dup_partner_sim_max, 0), 4) AS dup_partner_sim_max,
  COALESCE(dup_partner_cross_fy, 0) AS dup_partner_cross_fy, COALESCE(dup_partner_cross_fy, 0) > 0 AS has_duplicate_lead
FROM ord LEFT JOIN sig USING (work_id)""",
        "ord",
        "sig",
    ),
    "prebuilt_detect": _JOB,
    "sweep": query(
        """SELECT model, round(LEAST(s, 1.0), 4) AS similarity, CAST(doc_a AS VARCHAR) AS work_a, CAST(doc_b AS VARCHAR) AS work_b,
  source_a AS work_status_a, source_b AS work_status_b, 'Member ' || lang AS mp_name FROM swept WHERE s >= 0.8""",
        "swept",
    ),
    "sweep_counts": query(
        """SELECT model, COUNT(*) AS pairs, COUNT(DISTINCT (LEAST(ta, tb), GREATEST(ta, tb), lang)) FILTER (WHERE ta <> tb) AS texts
FROM swept JOIN (SELECT doc_id AS da, md5(trim(text)) AS ta FROM documents) ON da = doc_a
JOIN (SELECT doc_id AS db, md5(trim(text)) AS tb FROM documents) ON db = doc_b WHERE s >= 0.8 GROUP BY model""",
        "swept",
    ),
    "exclusive_pairs": query(
        "SELECT work_a, work_b, round(s_all, 4) AS similarity FROM vpairs WHERE s_all >= 0.2 AND NOT s_half >= 0.2", "vpairs"
    ),
    "model_counts": query(
        """SELECT tuned_pairs, frozen_pairs, round((frozen_pairs - tuned_pairs) / CAST(frozen_pairs AS DOUBLE) * 100, 4) AS reduction_pct
FROM (SELECT COUNT(*) FILTER (WHERE s_all >= 0.2) AS tuned_pairs, COUNT(*) FILTER (WHERE s_half >= 0.2) AS frozen_pairs FROM vpairs)""",
        "vpairs",
    ),
    "top_pairs": query(
        "SELECT work_a, work_b, round(s_all, 4) AS similarity FROM vpairs WHERE s_all >= 0.2 ORDER BY s_all DESC, work_a, work_b LIMIT 10",
        "vpairs",
    ),
    "knn": query(
        """
SELECT label, id, round(s, 4) AS score, place, hit_label FROM (
  SELECT c.label, vec_id AS id, list_cosine_similarity(c.v, vec.v) AS s, vec.label AS hit_label,
    ROW_NUMBER() OVER (PARTITION BY c.label ORDER BY list_cosine_similarity(c.v, vec.v) DESC, vec_id) AS place
  FROM vec JOIN (SELECT label, list(x ORDER BY dim) AS v FROM (
    SELECT label, dim, AVG(x) AS x FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM vec) GROUP BY label, dim)
    GROUP BY label) c ON TRUE) WHERE place <= 5""",
        "vec",
    ),
    "knn_cells": query(
        """
SELECT query, id, round(s, 4) AS score, place FROM (
  SELECT a.vec_id AS query, b.vec_id AS id, list_cosine_similarity(a.v, b.v) AS s,
    ROW_NUMBER() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.v, b.v) DESC, b.vec_id) AS place
  FROM vec a JOIN vec b ON a.vec_id % 100 = 0) WHERE place <= 5""",
        "vec",
    ),
    "anchor_topn": query(
        """SELECT work_id, COALESCE(filled, 0) AS slots, round(COALESCE(total / size, 0), 3) AS weight FROM (
  SELECT work_id, d.doc_id FROM flags JOIN documents d ON d.doc_id = CAST(work_no AS BIGINT) % (SELECT COUNT(*) FROM documents)
  WHERE is_flagged AND length(trim(text)) > 0 ORDER BY risk_score DESC, work_id LIMIT 200) LEFT JOIN sizes USING (doc_id)""",
        "flags",
        "sizes",
    ),
    "embed": query(
        """SELECT doc_id, COALESCE(filled, 0) AS slots, CASE WHEN size IS NULL THEN 0.0 ELSE 1.0 END AS length,
  round(COALESCE(total / size, 0), 3) AS weight, round(COALESCE(peak / size, 0), 4) AS peak, COALESCE(peak_slot, 0) AS peak_slot
FROM documents LEFT JOIN sizes USING (doc_id)
LEFT JOIN (SELECT s.doc_id, MIN(s.slot) AS peak_slot FROM slots s JOIN sizes z ON z.doc_id = s.doc_id AND z.peak = s.n GROUP BY s.doc_id) USING (doc_id)""",
        "slots",
        "sizes",
    ),
    "token_jaccard": query(
        """
SELECT work_a, work_b, round(LEAST(similarity, 1.0), 4) AS similarity,
  round(len(list_intersect(a.t, b.t)) / CAST(len(list_distinct(a.t || b.t)) AS DOUBLE), 4) AS jaccard,
  len(list_intersect(a.t, b.t)) / CAST(len(list_distinct(a.t || b.t)) AS DOUBLE) < 0.3 AS cross_vocabulary
FROM near JOIN tok a ON a.doc_id = doc_a JOIN tok b ON b.doc_id = doc_b""",
        "near",
    ).replace(
        "near AS MATERIALIZED",
        "tok AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS t FROM documents),\nnear AS MATERIALIZED",
    ),
    "group_stats": query(
        """SELECT COUNT(*) AS groups, COUNT(*) FILTER (WHERE n >= 2) AS shared_groups,
  CAST(COALESCE(SUM(n) FILTER (WHERE n >= 2), 0) AS BIGINT) AS rows_in_shared_groups, MAX(n) AS largest_group
FROM (SELECT block, COUNT(*) AS n FROM keyed GROUP BY block)""",
        "keyed",
    ),
    "eval_pairs": query(
        f"""
SELECT model, round(AVG(cosine), 4) AS mean, round(MIN(cosine), 4) AS lowest, round(MAX(cosine), 4) AS highest,
  round(AVG(cosine) FILTER (WHERE expected = 'MATCH'), 4) AS match_mean,
  round(AVG(cosine) FILTER (WHERE expected = 'NOT_MATCH'), 4) AS nonmatch_mean,
  round(AVG(cosine) FILTER (WHERE expected = 'MATCH') - AVG(cosine) FILTER (WHERE expected = 'NOT_MATCH'), 4) AS separation,
  round(AVG(CAST(CAST(cosine >= 0.5 AS INT) = label AS INT)), 4) AS accuracy,
  round(corr(cosine, label), 4) AS pearson, round(corr(rank_c, rank_l), 4) AS spearman,
  round(AVG(CAST((cosine > 0.6 AND expected = 'MATCH') OR (cosine < 0.6 AND expected = 'NOT_MATCH') AS INT)), 4) AS right_verdicts
FROM (SELECT *, {_ranks("cosine")} AS rank_c, {_ranks("label")} AS rank_l FROM models) GROUP BY model""",
        "models",
    ),
    "pair_scores": query(
        "SELECT pair_a, pair_b, expected, round(before, 4) AS before, round(after, 4) AS after FROM npairs", "npairs"
    ),
    "precision_at_k": query(
        """
SELECT COUNT(*) AS queries, round(AVG(CAST(hit AS INT)), 4) AS precision FROM (
  SELECT q.pair_a, BOOL_OR(r.id = q.pair_b AND r.place <= 20) AS hit
  FROM (SELECT pair_a, pair_b FROM npairs WHERE label = 1 ORDER BY md5('42|' || pair_a || '|' || pair_b) LIMIT 300) q
  JOIN (SELECT a.vec_id AS query, c.vec_id AS id,
      ROW_NUMBER() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.v, c.v) DESC, c.vec_id) AS place
    FROM vec a JOIN vec c ON c.vec_id IN (SELECT pair_b FROM npairs)
    WHERE a.vec_id IN (SELECT pair_a FROM npairs WHERE label = 1)) r ON r.query = q.pair_a
  GROUP BY q.pair_a)""",
        "npairs",
    ),
    "best_row": """
SELECT event_type, arg_max(event_id, (value, -event_id)) AS event_id, MAX(value) AS value FROM events GROUP BY event_type""",
    "latest_verdicts": "SELECT user_id AS work_id, arg_max(event_type, (ts, event_id)) AS verdict FROM events GROUP BY user_id",
    "impute": query(
        f"SELECT work_id, {_PRESENT} AS n_features, "
        + ", ".join(f"round(COALESCE({c}, md_{c}), 6) AS {c}" for c in FEATURE_COLUMNS)
        + f" FROM feat JOIN (SELECT {_MEDIANS} FROM feat) ON TRUE",
        "feat",
    ),
    "score_quantile": query(
        """
SELECT work_id, round((hi - size) / (hi - lo), 4) AS score, paid < q50 AS below_median, size < q05 AS below_cut,
  round(q50, 4) AS median_paid, round(q05, 4) AS cut_size
FROM (SELECT work_id, CAST(exp_paid AS DOUBLE) AS paid, CAST(sanction_amount AS DOUBLE) AS size FROM m),
  (SELECT quantile_cont(CAST(exp_paid AS DOUBLE), 0.5) AS q50, quantile_cont(CAST(sanction_amount AS DOUBLE), 0.05) AS q05,
    CAST(MIN(sanction_amount) AS DOUBLE) AS lo, CAST(MAX(sanction_amount) AS DOUBLE) AS hi FROM m)""",
        "m",
    ),
    "dossier": query(
        """SELECT work_id, file_name, dossier_md,
  '- [' || work_id || '](' || file_name || ') — risk ' || risk_score || '/100 — ' || reasons AS index_line FROM doss""",
        "doss",
    ),
    "dossier_top": query(
        """SELECT work_id, '- [' || work_id || '](' || file_name || ') — risk ' || risk_score || '/100 — ' || reasons AS index_line
FROM doss ORDER BY risk_score DESC, work_id LIMIT 50""",
        "doss",
    ),
    "dossier_sections": query(
        """
SELECT work_id, '- **Risk score:** `' || risk_score || '/100`  ' || chr(10) || '- **Suspected pattern:** `' || pattern || '`  ' || chr(10)
    || '- **Flags:** ' || reasons AS header,
  '> ' || reasons AS reasoning,
  '- Signals: `' || COALESCE(NULLIF(array_to_string(signals, ', '), ''), 'none') || '`' || chr(10) || '- Narrative: ' || narrative AS classification,
  CONCAT_WS(chr(10), '- Route: **' || route || '**', CASE WHEN statute_line <> '' THEN '- Statutory areas to assess: ' || statute_line END,
    '- Refer to: ' || refer_to, '- Note: ' || note) AS legal,
  COALESCE(raw_exp, '_missing_') AS last_source,
  'Recommended=' || COALESCE(raw_rec, '_missing_') || '|Sanctioned=' || COALESCE(raw_san, '_missing_')
    || '|Completed=' || COALESCE(raw_com, '_missing_') || '|Expenditure=' || COALESCE(raw_exp, '_missing_') AS raw_sources
FROM flags JOIN route ON route_type = pattern JOIN raw USING (work_id) WHERE is_flagged""",
        "doss",
    ),
    "json_records": query(
        """SELECT CAST(json_object('work_id', work_id, 'mp_no', mp_no, 'work_status', NULLIF(work_status, ''), 'exp_pay_count', exp_pay_count,
  'ratio', round(CASE WHEN recommended_amount > 0 THEN CAST(sanction_amount AS DOUBLE) / CAST(recommended_amount AS DOUBLE) END, 2),
  'weight', CASE WHEN is_sanctioned THEN CAST(0.5 AS DOUBLE) END, 'is_sanctioned', is_sanctioned) AS VARCHAR) AS record FROM m""",
        "m",
    ),
    "rate_window": _RATE,
    "rate_stream": _RATE,
    "stream_window": """
SELECT user_id AS key, strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(s + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end,
  COUNT(*) AS requests
FROM (SELECT user_id, date_trunc('hour', ts) - INTERVAL 1 HOUR * back AS s FROM events, range(0, 6) r(back)) GROUP BY user_id, s""",
    "stream_ingest": _JOB,
    "batch_job": _JOB,
    "load_losses": query(
        """
SELECT role, COUNT(*) AS rows, COUNT(*) FILTER (o_orderkey % 50 = 7) AS malformed,
  COUNT(*) FILTER (o_orderkey % 70 = 3 AND o_orderkey % 50 <> 7) AS unreadable_amounts, COUNT(*) FILTER (o_orderkey % 50 <> 7) AS kept
FROM (SELECT 'recommended' AS role, o_orderkey FROM ord
  UNION ALL SELECT 'sanctioned', l_orderkey FROM san JOIN ord ON o_orderkey = l_orderkey
  UNION ALL SELECT 'completed', l_orderkey FROM com JOIN ord ON o_orderkey = l_orderkey
  UNION ALL SELECT 'expenditure', l_orderkey FROM lineitem JOIN ord ON o_orderkey = l_orderkey WHERE l_returnflag = 'A') GROUP BY role""",
        "ord", "san", "com",
    ),
    "chambers": _JOB.replace(
        "SELECT work_id, CAST(recommended_amount",
        "SELECT CASE WHEN CAST(mp_no AS BIGINT) % 2 = 0 THEN 'ls' ELSE 'rs' END AS chamber, COUNT(*) OVER (PARTITION BY mp_no) AS member_works, work_id, CAST(recommended_amount",
    ),
    "prebuilt_sources": """
SELECT vec_id, len(embedding) AS dims, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 3) AS length
FROM embeddings""",
}
