"""DuckDB SQL for feature preparation and profiling queries."""

from __future__ import annotations

from netvigil.functions import vocab
from netvigil.plans.score_oracles import _num, label_sql
from netvigil.sources import fixtures

FLOWS = f"flows AS ({fixtures.FLOWS_SQL})"
FLOW_COLS = ["pkSeqID", "flow_id", "saddr", "daddr", "smac", "dmac", "proto", "state", "pkts",
             "bytes", "ltime", "category", "attack", "score"]


def _fill(expr: str) -> str:
    return f"coalesce(CASE WHEN NOT isnan({expr}) AND NOT isinf({expr}) THEN {expr} END, 0.0)"


_TEXT = {"saddr", "daddr", "smac", "dmac", "proto", "category"}
_prep_cols = ["pkSeqID", "saddr", "daddr", "smac", "dmac", "proto", "pkts", "bytes", "category",
              "score"]
_prep = ",\n       ".join(
    f"{_fill(_num(c)) if c in _TEXT else _fill(f'CAST({c} AS DOUBLE)')} AS {c}" for c in _prep_cols)

_nulls = "\n  UNION ALL ".join(
    f"SELECT '{c}' AS col_name, count(*) FILTER (WHERE {c} IS NULL) AS n_null FROM flows"
    for c in FLOW_COLS)

_summary = "\n  UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS col_name, (SELECT typeof({c}) FROM flows LIMIT 1) AS dtype, "
    f"count({c}) AS non_null FROM flows" for i, c in enumerate(FLOW_COLS))

ORACLES = {
    "clean_features": f"""WITH {FLOWS}
SELECT flow_id, coalesce(proto, '0') AS proto, coalesce(state, '0') AS state,
       coalesce(CAST(pkts AS DOUBLE), 0.0) AS pkts, coalesce(CAST(bytes AS DOUBLE), 0.0) AS bytes,
       coalesce(score, 0.0) AS score
FROM flows""",
    "prepare_numeric": f"""WITH {FLOWS}
SELECT flow_id,
       {_prep}
FROM flows""",
    "downcast": f"""WITH {FLOWS}
SELECT flow_id, CAST({_num('attack')} AS INTEGER) AS attack, category,
       CAST(pkts AS INTEGER) AS pkts, CAST(score AS FLOAT) AS score
FROM flows""",
    "align_features": f"""WITH {FLOWS}
SELECT flow_id, {_fill('CAST(pkts AS DOUBLE)')} AS pkts, {_fill('CAST(bytes AS DOUBLE)')} AS bytes,
       CAST(0.0 AS DOUBLE) AS dur, {_fill(_num('proto'))} AS proto, {_fill('score')} AS score
FROM flows""",
    "align_connlog": f"""WITH cl AS ({fixtures.CONNLOG_SQL})
SELECT uid, {_fill('CAST(id_orig_p AS DOUBLE)')} AS id_orig_p, {_fill('CAST(duration AS DOUBLE)')} AS duration,
       {_fill('CAST(orig_bytes AS DOUBLE)')} AS orig_bytes, {_fill(_num('conn_state'))} AS conn_state,
       CAST(0.0 AS DOUBLE) AS resp_bytes
FROM cl""",
    "standardise": """WITH ev AS (SELECT event_id, value, user_id FROM events),
st AS (SELECT avg(value) AS mv, stddev_pop(value) AS sv, avg(user_id) AS mu, stddev_pop(user_id) AS su
       FROM ev)
SELECT event_id,
       round((value - mv) / CASE WHEN sv > 0 THEN sv ELSE 1.0 END, 6) AS value_z,
       round((user_id - mu) / CASE WHEN su > 0 THEN su ELSE 1.0 END, 6) AS user_id_z
FROM ev, st""",
    "class_weights": f"""WITH {FLOWS},
y AS (SELECT {label_sql('open')} AS label FROM flows),
c AS (SELECT label, count(*) AS n FROM y WHERE label IS NOT NULL GROUP BY label)
SELECT label, n, CAST(sum(n) OVER () AS DOUBLE) / (count(*) OVER () * n) AS weight FROM c""",
    "null_profile": f"""WITH {FLOWS},
nn AS ({_nulls})
SELECT col_name, n_null FROM nn ORDER BY n_null DESC, col_name LIMIT 10""",
    "value_counts": f"""WITH {FLOWS}
SELECT category, count(*) AS n FROM flows GROUP BY category ORDER BY n DESC, category NULLS FIRST LIMIT 30""",
    "connlog_clean": f"""WITH cl AS ({fixtures.CONNLOG_SQL})
SELECT coalesce(CAST(id_orig_p AS DOUBLE), 0.0) AS id_orig_p, coalesce(CAST(duration AS DOUBLE), 0.0) AS duration,
       coalesce({_num('conn_state')}, 0.0) AS conn_state, coalesce(CAST(orig_bytes AS DOUBLE), 0.0) AS orig_bytes,
       CASE WHEN tunnel_parents IS NULL THEN 0 WHEN contains(lower(tunnel_parents), 'benign') THEN 0
            WHEN {" OR ".join(f"contains(lower(tunnel_parents), '{w}')" for w in vocab.KEYWORD_MALICIOUS)} THEN 1
            ELSE 0 END AS attack
FROM cl""",
    "column_summary": f"""WITH {FLOWS},
n AS (SELECT count(*) AS total FROM flows),
cols AS ({_summary})
SELECT CAST(position AS INTEGER) AS position, col_name,
       CASE dtype WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double'
                  WHEN 'INTEGER' THEN 'int' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(dtype) END AS dtype,
       non_null, (SELECT total FROM n) AS rows
FROM cols""",
}
