"""DuckDB SQL for the edge queries; label values are written out, not looked up."""

from __future__ import annotations

from netvigil.plans.file_oracles import _fill, _rows
from netvigil.plans.sample_oracles import EV, _md5
from netvigil.plans.score_oracles import COUNTS, FLOWS, GROUPED, AUC, LABELLED, ORACLES as SCORES, SWEEP, _best, _ratio, _roc
from netvigil.sources import fixtures

# --- fixed values: what each profile makes of each text -----------------------------------------
#     text,      closed, open, named, botnet, small, strict
LABEL_VALUES = """
(0, /* ddos */      1, NULL, 1,    NULL, NULL, NULL),
(1, /* botnet */    1, NULL, NULL, 1,    NULL, NULL),
(2, /* yes */       1, 1,    1,    1,    1,    1),
(3, /* no */        1, 0,    0,    0,    0,    0),
(4, /* 2 */         1, 2,    1,    2,    NULL, 2),
(5, /* -1 */        1, -1,   0,    -1,   NULL, -1),
(6, /* 0.5 */       1, 0,    0,    0,    NULL, NULL),
(7, /* inf */       1, NULL, NULL, NULL, NULL, NULL),
(8, /* empty */     1, NULL, NULL, NULL, NULL, NULL),
(9, /* ' Normal' */ 1, 0,    0,    0,    0,    0),
(10, /* BENIGN */   0, 0,    0,    0,    0,    0),
(11, /* n/a */      1, NULL, NULL, NULL, NULL, NULL),
(12, /* NULL */     1, NULL, NULL, NULL, NULL, NULL),
(13, /* Attack */   1, 1,    1,    1,    1,    1),
(14, /* 1.0 */      1, 1,    1,    1,    NULL, 1),
(15, /* scan */     1, NULL, 1,    NULL, NULL, NULL),
(16, /* true */     1, 1,    1,    1,    1,    1),
(17, /* 0 */        1, 0,    0,    0,    0,    0),
(18, /* 'Theft ' */ 1, NULL, 1,    NULL, NULL, NULL)"""
# -----------------------------------------------------------------------------------------------

EDGE = """edge AS (SELECT * REPLACE (CASE pkSeqID % 50 WHEN 0 THEN CAST('inf' AS DOUBLE) WHEN 1 THEN 3e7 WHEN 2 THEN -2.0
    WHEN 3 THEN NULL WHEN 4 THEN CAST('nan' AS DOUBLE) ELSE score END AS score) FROM s)"""


def _first_n(order: str, value: str, n: int) -> str:
    return f"""WITH {EV},
e AS (SELECT event_id, label, {value} FROM ev),
t AS (SELECT least({n}, min(c)) AS t FROM (SELECT count(*) AS c FROM ev GROUP BY label))
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {order}) AS rn FROM e)
WHERE rn <= (SELECT t FROM t)"""


# labelled rows, some scores changed (edge); those with a score (s); the tuned threshold; all cells at it
TUNED = f"""{LABELLED.replace(chr(10) + 's AS (', chr(10) + 's0 AS (')},
{EDGE.replace('FROM s)', 'FROM s0)')},
s AS (SELECT * FROM edge WHERE NOT isnan(score)),
{SWEEP},
best AS ({_best('youden')}),
hit AS (SELECT y, coalesce(NOT isnan(score) AND score >= (SELECT threshold FROM best), false) AS p FROM edge),
c AS (SELECT count(*) AS total, count(*) FILTER (WHERE p) AS hits, count(*) FILTER (WHERE y = 0 AND NOT p) AS tn,
  count(*) FILTER (WHERE y = 0 AND p) AS fp, count(*) FILTER (WHERE y = 1 AND NOT p) AS fn, count(*) FILTER (WHERE y = 1 AND p) AS tp
  FROM hit)"""


def _share(a: str, b: str) -> str:
    return f"round_even(CAST({a} AS DOUBLE) / CASE WHEN {a} + {b} = 0 THEN 1 ELSE {a} + {b} END, 4)"


def _side(address: str) -> str:
    return (f"SELECT {address} AS dev, pred, pkts, bytes, pkSeqID % 5000 AS seen FROM s")


ORACLES = {
    "label_profiles": f"""SELECT p_partkey, CAST(c AS INTEGER) AS closed, CAST(o AS INTEGER) AS open, CAST(n AS INTEGER) AS named,
       CAST(b AS INTEGER) AS botnet, CAST(m AS INTEGER) AS small, CAST(t AS INTEGER) AS strict
FROM part JOIN (VALUES {LABEL_VALUES}) AS v(k, c, o, n, b, m, t) ON p_partkey % 19 = k""",
    "first_n_ties": _first_n("bucket, event_id", "event_id % 10 AS bucket", 500),
    "first_n_null_order": _first_n("ord NULLS LAST, event_id",
                                   "CASE WHEN event_id % 5 >= 3 THEN event_id END AS ord", 1500),
    "sample_n": f"""WITH {EV}
SELECT event_id, label FROM ev ORDER BY {_md5('event_id')}, event_id LIMIT 300""",
    "threshold_edge": f"""WITH {LABELLED.replace(chr(10) + 's AS (', chr(10) + 's0 AS (')},
{EDGE.replace('FROM s)', 'FROM s0)')},
s AS (SELECT * FROM edge WHERE NOT isnan(score)),
{SWEEP}
{_best('youden')}""",
    "threshold_one_class": """SELECT 'youden' AS metric, CAST(0.5 AS DOUBLE) AS threshold, CAST(NULL AS DOUBLE) AS precision,
       CAST(NULL AS DOUBLE) AS recall_tpr, CAST(NULL AS DOUBLE) AS f1, CAST(NULL AS DOUBLE) AS fpr""",
    "predict_edge": f"""WITH {LABELLED},
{EDGE},
n AS (SELECT count(*) AS total, count(*) FILTER (WHERE score >= 0.5 AND NOT isnan(score)) AS hits FROM edge)
SELECT total AS total_records, hits AS anomalies_detected, total - hits AS normal_records,
       CAST(0.5 AS DOUBLE) AS threshold, true AS has_proba FROM n""",
    "predict_full": f"""WITH {TUNED},\n{GROUPED},\n{AUC},\n{_roc(True)}
SELECT total AS total_records, hits AS anomalies_detected, total - hits AS normal_records, (SELECT threshold FROM best) AS threshold,
  true AS has_proba, tn, fp, fn, tp,
  {_ratio('tp + tn', 'tn + fp + fn + tp')} AS accuracy, {_ratio('tp', 'tp + fp')} AS precision, {_ratio('tp', 'tp + fn')} AS recall_tpr,
  {_ratio('2 * tp', '2 * tp + fp + fn')} AS f1, {_ratio('fp', 'fp + tn')} AS fpr, {_ratio('tn', 'tn + fp')} AS tnr_specificity,
  {_ratio('fp + fn', 'tn + fp + fn + tp')} AS mse, tn + fp AS support_0, fn + tp AS support_1,
  {_share('tn', 'fp')} AS tn_share, {_share('fp', 'tn')} AS fp_share, {_share('fn', 'tp')} AS fn_share, {_share('tp', 'fn')} AS tp_share,
  (SELECT auc FROM auc_t) AS auc, (SELECT count(*) FROM roc) AS roc_points
FROM c""",
    "predict_summary_edge": f"""WITH {TUNED}
SELECT total AS total_records, hits AS anomalies_detected, total - hits AS normal_records, (SELECT threshold FROM best) AS threshold
FROM c""",
    "device_rollup_text": f"""WITH {LABELLED},
long AS ({_side("CASE pkSeqID % 97 WHEN 0 THEN '  ' WHEN 1 THEN 'nan' ELSE saddr END")}
         UNION ALL {_side('daddr')})
SELECT dev AS device, count(*) AS total, CAST(sum(pred) AS BIGINT) AS anomalies,
       CASE WHEN sum(pred) > 0 THEN 'RED' ELSE 'GREEN' END AS status, CAST(sum(pkts) AS BIGINT) AS pkts,
       CAST(sum(bytes) AS BIGINT) AS bytes, CAST(max(seen) AS VARCHAR) AS last_seen
FROM long WHERE trim(dev) NOT IN ('', 'nan') GROUP BY dev""",
    "roc_report": f"""WITH {LABELLED},\n{GROUPED},\n{AUC},\n{_roc(True)}
SELECT idx, threshold, fpr, tpr, (SELECT auc FROM auc_t) AS auc FROM roc""",
    "metrics_roundtrip": f"""SELECT fmt, m.* FROM ({SCORES['metrics']}) m, (VALUES ('json'), ('csv')) AS f(fmt)""",
    "json_safe": f"""WITH {LABELLED},
none AS (SELECT CAST(NULL AS DOUBLE) AS z),
p AS (SELECT proto, max(score) AS hi, min(score) AS lo, count(*) AS n, CAST(CAST(max(bytes) AS FLOAT) AS DOUBLE) AS f FROM s GROUP BY proto)
SELECT proto, hi AS top, z AS gap, z AS low, n, hi AS a0, z AS a1, z AS a2, lo AS a3, 4 AS a_size, hi AS x0, z AS x1,
  hi AS m_top, z AS m_gap, f FROM p, none""",
    "confusion_report": f"""WITH {LABELLED},\n{COUNTS}
SELECT '0,1' AS labels, tn AS n00, fp AS n01, fn AS n10, tp AS n11, {', '.join(
    f"round_even(CAST({c} AS DOUBLE) / greatest(tn + fp + fn + tp, 1), 4) AS {p}"
    for c, p in (('tn', 'p00'), ('fp', 'p01'), ('fn', 'p10'), ('tp', 'p11')))} FROM c""",
    "align_loose": f"""WITH {FLOWS}
SELECT flow_id, score, proto, CAST(0 AS INTEGER) AS spkts, category, pkts FROM flows""",
    "typed_features": f"""WITH {FLOWS}
SELECT count(*) AS n, CAST(sum(pkts) AS BIGINT) AS pkts, count(*) FILTER (WHERE pkts > 25) AS some,
  'pkts:int,score:float,some:int,ratio:float' AS numeric, 'proto,category' AS categorical FROM flows""",
    "encode_whole_table": f"""WITH {FLOWS}
SELECT 1 + count(DISTINCT proto) AS whole_width, CAST(0 AS BIGINT) AS whole_unmarked,
  1 + count(DISTINCT proto) FILTER (WHERE proto <> 'arp') AS train_width, count(*) FILTER (WHERE proto = 'arp') AS train_unmarked FROM flows""",
    "first_n_file": f"""WITH {_rows('closed')},
t AS (SELECT least(400, min(c)) AS n FROM (SELECT count(*) AS c FROM rows GROUP BY label))
SELECT flow_id, pkts, label, 'flow_id,pkts,label' AS columns FROM (
  SELECT r.flow_id, r.label, w.pkts, row_number() OVER (PARTITION BY r.label ORDER BY f, line) AS rn
  FROM rows r JOIN flows w ON r.flow_id = w.flow_id) WHERE rn <= (SELECT n FROM t)""",
    "balanced_file": f"""WITH {_rows('botnet')},
{_fill('f', 'n', 'CASE label WHEN 1 THEN 250 ELSE 750 END')}
SELECT p.flow_id, w.attack FROM pool p JOIN flows w ON p.flow_id = w.flow_id""",
    "union_labelled": f"""WITH {FLOWS}
SELECT flow_id, CAST(NULL AS BIGINT) AS event_id, attack AS label_raw FROM flows
UNION ALL SELECT NULL, event_id, CAST(label AS VARCHAR) FROM ({fixtures.LABELLED_EVENTS_SQL}) e""",
    "csv_tolerant": """SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN lang WHEN doc_id % 17 = 0 THEN 'say "' || lang || '", ok'
         WHEN doc_id % 5 = 0 THEN 'a,' || lang ELSE lang END AS lang,
       CASE WHEN doc_id % 7 <> 0 THEN source END AS source
FROM documents WHERE doc_id % 7 = 0 OR (doc_id % 11 <> 0 AND doc_id % 13 <> 0)""",
}
