"""DuckDB SQL for label, cleaning and scoring-measure queries."""

from __future__ import annotations

from netvigil.functions import vocab
from netvigil.operators.threshold import candidate_thresholds
from netvigil.sources import fixtures

NUM_RE = r"\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*"


def _case(mapping: dict, key: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN {v}" for k, v in mapping.items())
    return f"(CASE {key} {whens} END)"


def _num(x: str) -> str:
    return f"(CASE WHEN regexp_full_match({x}, '{NUM_RE}') THEN TRY_CAST(trim({x}) AS DOUBLE) END)"


def label_sql(profile: str, x: str = "attack") -> str:
    key = f"lower(trim({x}))"
    if profile == "closed":
        return f"CAST(coalesce({_case(vocab.LABELS_CLOSED, f'coalesce(lower({x}), ' + chr(39) + 'nan' + chr(39) + ')')}, 1) AS INTEGER)"
    if profile == "small":
        return f"CAST({_case(vocab.LABELS_SMALL, key)} AS INTEGER)"
    mapping = {"open": vocab.LABELS_OPEN, "strict": vocab.LABELS_OPEN,
               "named": vocab.LABELS_NAMED, "botnet": vocab.LABELS_BOTNET}[profile]
    out = f"coalesce({_case(mapping, key)}, CAST(trunc({_num(x)}) AS INTEGER))"
    if profile == "named":
        out = f"(CASE WHEN {out} IS NOT NULL THEN least(greatest({out}, 0), 1) END)"
    return f"CAST({out} AS INTEGER)"


FLOWS = f"flows AS ({fixtures.FLOWS_SQL})"
LABELLED = (f"{FLOWS},\nlab AS (SELECT *, {label_sql('open')} AS y FROM flows),\n"
            "s AS (SELECT *, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS pred FROM lab "
            "WHERE y IS NOT NULL)")
COUNTS = """c AS (SELECT count(*) FILTER (WHERE y = 0 AND pred <> 1) AS tn,
                  count(*) FILTER (WHERE y = 0 AND pred = 1) AS fp,
                  count(*) FILTER (WHERE y = 1 AND pred <> 1) AS fn,
                  count(*) FILTER (WHERE y = 1 AND pred = 1) AS tp FROM s WHERE y IN (0, 1))"""


def _ratio(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) <> 0 THEN CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) ELSE 0.0 END)"


GROUPED = """g AS (SELECT score, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg
       FROM s WHERE y IN (0, 1) AND score IS NOT NULL AND NOT isnan(score) GROUP BY score),
r AS (SELECT *, sum(pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tps,
              sum(neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fps,
              row_number() OVER (ORDER BY score DESC) - 1 AS idx, count(*) OVER () AS n FROM g),
tot AS (SELECT sum(pos) AS P, sum(neg) AS N FROM g)"""

AUC = """auc_t AS (SELECT CASE WHEN t.P > 0 AND t.N > 0
          THEN CAST(sum(CAST(r.neg AS HUGEINT) * (2 * r.tps - r.pos)) AS DOUBLE)
               / (2 * CAST(t.P AS DOUBLE) * CAST(t.N AS DOUBLE)) END AS auc,
          CAST(t.P AS BIGINT) AS n_pos, CAST(t.N AS BIGINT) AS n_neg
   FROM r, tot t GROUP BY t.P, t.N)"""


def _roc(drop: bool) -> str:
    keep = ("WHERE n <= 2 OR idx = 0 OR idx = n - 1 OR (pfps - 2 * fps + nfps) <> 0 "
            "OR (ptps - 2 * tps + ntps) <> 0") if drop else ""
    return f"""r2 AS (SELECT *, lag(tps) OVER o AS ptps, lag(fps) OVER o AS pfps,
               lead(tps) OVER o AS ntps, lead(fps) OVER o AS nfps
        FROM r WINDOW o AS (ORDER BY score DESC)),
k AS (SELECT * FROM r2 {keep}),
pts AS (SELECT row_number() OVER (ORDER BY score DESC) AS idx, score AS threshold, fps, tps FROM k
        UNION ALL SELECT 0, NULL, 0, 0),
roc AS (SELECT CAST(idx AS BIGINT) AS idx, threshold,
               CASE WHEN t.N > 0 THEN CAST(fps AS DOUBLE) / CAST(t.N AS DOUBLE) END AS fpr,
               CASE WHEN t.P > 0 THEN CAST(tps AS DOUBLE) / CAST(t.P AS DOUBLE) END AS tpr,
               CAST(fps AS BIGINT) AS fps, CAST(tps AS BIGINT) AS tps
        FROM pts, tot t)"""


def _cands() -> str:
    vals = ", ".join(f"(CAST('{repr(c)}' AS DOUBLE))" for c in candidate_thresholds())
    return f"cands AS (SELECT * FROM (VALUES {vals}) AS v(threshold))"


SWEEP = f"""{_cands()},
per AS (SELECT c.threshold,
               count(s.y) FILTER (WHERE s.score >= c.threshold AND s.y = 1) AS tp,
               count(s.y) FILTER (WHERE s.score >= c.threshold AND s.y = 0) AS fp,
               count(s.y) FILTER (WHERE s.score < c.threshold AND s.y = 1) AS fn,
               count(s.y) FILTER (WHERE s.score < c.threshold AND s.y = 0) AS tn
        FROM cands c, (SELECT * FROM s WHERE y IN (0, 1) AND score IS NOT NULL) s
        GROUP BY c.threshold),
sw AS (SELECT threshold, {_ratio('tp', 'tp + fp')} AS precision, {_ratio('tp', 'tp + fn')} AS recall_tpr,
              {_ratio('2 * tp', '2 * tp + fp + fn')} AS f1, {_ratio('fp', 'fp + tn')} AS fpr FROM per),
sw2 AS (SELECT *, recall_tpr - fpr AS youden FROM sw)"""


def _best(obj: str) -> str:
    return (f"SELECT '{obj}' AS metric, threshold, precision, recall_tpr, f1, fpr FROM sw2 "
            f"WHERE {obj} > -1 ORDER BY {obj} DESC, threshold ASC LIMIT 1")


def _label_query(profile: str) -> str:
    return (f"WITH {FLOWS}\nSELECT flow_id, y FROM (SELECT flow_id, {label_sql(profile)} AS y FROM flows) "
            "WHERE y IS NOT NULL")


_KEYWORD = " OR ".join(f"contains(lower(tunnel_parents), '{w}')" for w in vocab.KEYWORD_MALICIOUS)
_BENIGN = " OR ".join(f"contains(lower(tunnel_parents), '{w}')" for w in vocab.KEYWORD_BENIGN)

#: conn-log rows (cl) with their keyword label
CONNLOG_LABEL = f"""SELECT uid, CASE WHEN tunnel_parents IS NULL THEN 0 WHEN {_BENIGN} THEN 0
                 WHEN {_KEYWORD} THEN 1 ELSE 0 END AS attack FROM cl"""

ORACLES = {
    "label_open": _label_query("open"),
    "label_named": _label_query("named"),
    "label_closed": _label_query("closed"),
    "label_small": _label_query("small"),
    "label_botnet": _label_query("botnet"),
    "label_strict": _label_query("strict"),
    "label_keyword": f"""WITH cl AS ({fixtures.CONNLOG_SQL})
{CONNLOG_LABEL}""",
    "clean_numeric": f"""WITH {FLOWS}
SELECT flow_id, {_num('attack')} AS attack_num,
       coalesce(CASE WHEN NOT isnan({_num('attack')}) AND NOT isinf({_num('attack')}) THEN {_num('attack')} END, 0.0)
         AS attack_filled,
       coalesce({_num('state')}, 0.0) AS state_filled
FROM flows""",
    "confusion": f"""WITH {LABELLED},\n{COUNTS}
SELECT * FROM (SELECT 0 AS actual, 0 AS predicted, tn AS n FROM c UNION ALL SELECT 0, 1, fp FROM c
               UNION ALL SELECT 1, 0, fn FROM c UNION ALL SELECT 1, 1, tp FROM c)""",
    "metrics": f"""WITH {LABELLED},\n{COUNTS},\n{GROUPED},\n{AUC}
SELECT {_ratio('tp + tn', 'tn + fp + fn + tp')} AS accuracy, {_ratio('tp', 'tp + fp')} AS precision,
       {_ratio('tp', 'tp + fn')} AS recall_tpr, {_ratio('2 * tp', '2 * tp + fp + fn')} AS f1,
       {_ratio('fp', 'fp + tn')} AS fpr, {_ratio('tn', 'tn + fp')} AS tnr_specificity,
       {_ratio('fp + fn', 'tn + fp + fn + tp')} AS mse, tn + fp AS support_0, fn + tp AS support_1,
       (SELECT auc FROM auc_t) AS auc
FROM c""",
    "class_report": f"""WITH {LABELLED},\n{COUNTS},
p AS (SELECT {_ratio('tn', 'tn + fn')} AS p0, {_ratio('tn', 'tn + fp')} AS r0,
             {_ratio('2 * tn', '2 * tn + fp + fn')} AS f0, tn + fp AS s0,
             {_ratio('tp', 'tp + fp')} AS p1, {_ratio('tp', 'tp + fn')} AS r1,
             {_ratio('2 * tp', '2 * tp + fp + fn')} AS f1, tp + fn AS s1,
             {_ratio('tp + tn', 'tn + fp + fn + tp')} AS acc FROM c)
SELECT '0' AS class, p0 AS precision, r0 AS recall, f0 AS f1_score, CAST(s0 AS BIGINT) AS support FROM p
UNION ALL SELECT '1', p1, r1, f1, CAST(s1 AS BIGINT) FROM p
UNION ALL SELECT 'accuracy', NULL, NULL, acc, CAST(s0 + s1 AS BIGINT) FROM p
UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, CAST(s0 + s1 AS BIGINT) FROM p
UNION ALL SELECT 'weighted avg', {_ratio('p0 * s0 + p1 * s1', 's0 + s1')}, {_ratio('r0 * s0 + r1 * s1', 's0 + s1')},
                 {_ratio('f0 * s0 + f1 * s1', 's0 + s1')}, CAST(s0 + s1 AS BIGINT) FROM p""",
    "confusion_pct": f"""WITH {LABELLED},\n{COUNTS},
cm AS (SELECT 0 AS actual, 0 AS predicted, tn AS n FROM c UNION ALL SELECT 0, 1, fp FROM c
       UNION ALL SELECT 1, 0, fn FROM c UNION ALL SELECT 1, 1, tp FROM c)
SELECT actual, predicted, n,
       round_even(CAST(n AS DOUBLE) / CASE WHEN sum(n) OVER (PARTITION BY actual) = 0 THEN 1
                                           ELSE sum(n) OVER (PARTITION BY actual) END, 4) AS pct
FROM cm""",
    "auc": f"WITH {LABELLED},\n{GROUPED},\n{AUC}\nSELECT auc, n_pos, n_neg FROM auc_t",
    "roc_curve": f"WITH {LABELLED},\n{GROUPED},\n{_roc(True)}\nSELECT * FROM roc",
    "roc_thinned": f"""WITH {LABELLED},\n{GROUPED},\n{_roc(False)},
ok AS (SELECT * FROM roc WHERE fpr IS NOT NULL AND tpr IS NOT NULL AND fpr BETWEEN 0 AND 1
       AND tpr BETWEEN 0 AND 1)
SELECT * FROM ok WHERE (SELECT count(*) FROM ok) <= 500
   OR idx % CAST(ceil((SELECT count(*) FROM ok) / 500.0) AS BIGINT) = 0""",
    "threshold_f1": f"WITH {LABELLED},\n{SWEEP}\n{_best('f1')}",
    "threshold_youden": f"WITH {LABELLED},\n{SWEEP}\n{_best('youden')}",
    "minmax_score": f"""WITH {FLOWS}, mm AS (SELECT min(score) AS lo, max(score) AS hi FROM flows)
SELECT flow_id, (score - lo) / (hi - lo + 1e-8) AS score_mm FROM flows, mm""",
    "predict_summary": f"""WITH {LABELLED},\n{SWEEP},
best AS ({_best('youden')})
SELECT count(*) AS total_records,
       count(*) FILTER (WHERE score >= (SELECT threshold FROM best)) AS anomalies_detected,
       count(*) FILTER (WHERE NOT (score >= (SELECT threshold FROM best))) AS normal_records,
       (SELECT threshold FROM best) AS threshold
FROM flows""",
    "preview": f"""WITH {FLOWS}
SELECT flow_id, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS pred, round(score, 6) AS score
FROM flows ORDER BY ltime, pkSeqID, flow_id LIMIT 20""",
}
