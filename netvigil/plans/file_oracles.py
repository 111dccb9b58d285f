"""DuckDB SQL for the queries over part files: full rankings and running sums over the flow fixture."""

from __future__ import annotations

from netvigil.plans.file_queries import PARTS
from netvigil.plans.score_oracles import label_sql
from netvigil.sources import fixtures


def _rows(profile: str, skip: int = 0, more: str = "") -> str:
    """flow_id, label and file number (from the first file kept); ``line``: place in the file, header line included."""
    return f"""flows AS ({fixtures.FLOWS_SQL}),
lines AS (SELECT flow_id, pkSeqID % {PARTS} - {skip} AS f, {label_sql(profile)} AS label,
  row_number() OVER (PARTITION BY pkSeqID % {PARTS} ORDER BY flow_id) AS line FROM flows),
rows AS (SELECT * FROM lines WHERE label IN (0, 1) AND f >= 0{more})"""


def _fill(unit: str, offer: str, need: str) -> str:
    return f"""cnt AS (SELECT {unit} AS u, label, count(*) AS n FROM rows GROUP BY ALL),
offers AS (SELECT *, {offer} AS o FROM cnt),
quota AS (SELECT u, label, greatest(0, least(o, {need} - coalesce(sum(o) OVER (
  PARTITION BY label ORDER BY u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS take FROM offers),
ranked AS (SELECT flow_id, label, f, {unit} AS u, row_number() OVER (
  PARTITION BY {unit}, label ORDER BY md5('42:' || flow_id), flow_id) AS rn FROM rows),
pool AS (SELECT r.* FROM ranked r JOIN quota q ON r.u = q.u AND r.label = q.label WHERE rn <= take)"""


def _batch(rows: str, cap: int) -> str:
    return f"""WITH {rows},
{_fill('f // 5', 'CASE WHEN floor(n * CAST(0.2 AS DOUBLE)) > 0 THEN CAST(floor(n * CAST(0.2 AS DOUBLE)) AS BIGINT) ELSE n END', str(cap))},
target AS (SELECT min(c) AS t FROM (SELECT count(*) AS c FROM pool GROUP BY label))
SELECT flow_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('43:' || flow_id), flow_id) AS r2
  FROM pool) WHERE r2 <= (SELECT t FROM target)"""


_KEY = "concat_ws('|', u, saddr, proto, category, attack)"

ORACLES = {
    "mixed_headers": f"""WITH flows AS ({fixtures.FLOWS_SQL})
SELECT flow_id, attack AS label_raw, CASE pkSeqID % 3 WHEN 0 THEN pkts END AS pkts, CASE pkSeqID % 3 WHEN 1 THEN saddr END AS saddr
FROM flows WHERE pkSeqID % 3 < 2""",
    "dedup_batches": f"""WITH flows AS ({fixtures.FLOWS_SQL}),
d AS (SELECT DISTINCT CAST((pkSeqID % {PARTS}) // 5 AS BIGINT) AS u, saddr, proto, category, attack FROM flows),
r AS (SELECT *, count(*) OVER (PARTITION BY u) AS n,
  row_number() OVER (PARTITION BY u ORDER BY md5('42:' || {_KEY}), saddr, proto, category NULLS FIRST, attack) AS rn FROM d)
SELECT u AS batch, saddr, proto, category, attack FROM r WHERE rn <= round_even(n * CAST(0.3 AS DOUBLE), 0)""",
    "shuffled_parts": f"""WITH flows AS ({fixtures.FLOWS_SQL})
SELECT flow_id, row_number() OVER (ORDER BY md5('42:' || flow_id), flow_id) AS place FROM flows""",
    "head_per_file": f"""WITH flows AS ({fixtures.FLOWS_SQL})
SELECT flow_id, attack FROM (SELECT *, row_number() OVER (PARTITION BY pkSeqID % {PARTS} ORDER BY flow_id) AS rn FROM flows)
WHERE rn <= 40""",
    "ratio_sample_by_file": f"""WITH {_rows('botnet')},
{_fill('f', 'n', 'CASE label WHEN 1 THEN 6000 ELSE 14000 END')}
SELECT flow_id, label, f AS _file_no FROM pool""",
    "holdout_by_file": f"""WITH {_rows('small', skip=5)},
{_fill('f', 'n', 'CASE label WHEN 1 THEN 4999 ELSE 5000 END')}
SELECT flow_id, label FROM pool""",
    "balance_by_batch": _batch(_rows("named"), 1500),
    "balance_by_batch_rest": _batch(_rows("named", more=" AND (label = 0 OR flow_id LIKE '%777')"), 300_000),
    "first_n_file_order": f"""WITH {_rows('open')},
sizes AS (SELECT f, count(*) + 1 AS n FROM lines GROUP BY f),
starts AS (SELECT f, coalesce(sum(n) OVER (ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM sizes),
placed AS (SELECT flow_id, label, CAST(start + line AS BIGINT) AS _pos FROM rows JOIN starts USING (f))
SELECT flow_id, label, _pos FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY _pos) AS rn FROM placed)
WHERE rn <= (SELECT least(2500, min(c)) FROM (SELECT count(*) AS c FROM rows GROUP BY label))""",
}
