"""Independent DuckDB SQL for each registered query (the driver's correctness oracle).

Views ``lineitem orders customer supplier nation events ...`` are pre-registered by the
checker. Doubles are rounded with the same floor arithmetic as ``functions.columns.fixed``.
"""

from __future__ import annotations

from ledgerlens.operators.features import FEATURE_COLUMNS


def fx(expr: str, dp: int) -> str:
    s = f"1e{dp}"
    return f"(floor(CAST(({expr}) AS DOUBLE) * {s} + 5e-1) / {s})"


TX = """
tx AS (
  SELECT concat_ws('-', CAST(l.l_orderkey AS VARCHAR), CAST(l.l_linenumber AS VARCHAR),
                   CAST(l.l_partkey AS VARCHAR), CAST(l.l_suppkey AS VARCHAR),
                   CAST(CAST(l.l_quantity AS INTEGER) AS VARCHAR), strftime(l.l_shipdate, '%Y%m%d')) AS tx_id,
         o.o_orderdate AS ts,
         CAST(cn.n_regionkey AS VARCHAR) AS from_bank,
         'ACC_' || CAST(o.o_custkey AS VARCHAR) AS sender_account,
         CAST(sn.n_regionkey AS VARCHAR) AS to_bank,
         'ACC_' || CAST(l.l_suppkey AS VARCHAR) AS receiver_account,
         l.l_extendedprice * (CAST(1 AS DOUBLE) - l.l_discount) AS amount_received,
         sn.n_name AS receiving_currency,
         l.l_extendedprice * (CAST(1 AS DOUBLE) - l.l_discount) * (CAST(1 AS DOUBLE) + l.l_tax) AS amount_paid,
         cn.n_name AS payment_currency,
         o.o_orderpriority AS payment_format,
         CAST(l.l_returnflag = 'R' AND l.l_quantity >= 49 AND l.l_discount >= 0.08 AS INTEGER) AS label,
         l.l_quantity, l.l_discount, l.l_returnflag
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation cn ON c.c_nationkey = cn.n_nationkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation sn ON s.s_nationkey = sn.n_nationkey
)"""

EV = """
ev AS (
  SELECT CAST(event_id AS VARCHAR) AS tx_id, ts, 'USR_' || CAST(user_id AS VARCHAR) AS sender_account,
         'EVT_' || event_type AS receiver_account, value AS amount_paid, value AS amount_received,
         event_type AS payment_format, CAST(event_type = 'error' AS INTEGER) AS label
  FROM events
)"""


def with_tx(body: str, *ctes: str) -> str:
    extra = "".join("," + c for c in ctes)
    return f"WITH {TX}{extra}\n{body}"


SQL: dict[str, str] = {}

SQL["label_summary"] = with_tx(f"""
SELECT count(*) AS n_rows, CAST(coalesce(sum(label), 0) AS BIGINT) AS n_positive,
       {fx('sum(CAST(label AS DOUBLE)) * CAST(100 AS DOUBLE) / count(*)', 6)} AS positive_rate_pct
FROM tx""")

SQL["normalize"] = with_tx(f"""
SELECT tx_id,
       coalesce(nullif(trim(sender_account), ''), '') AS sender_account,
       coalesce(nullif(trim(receiver_account), ''), '') AS receiver_account,
       {fx("coalesce(nullif(amount_paid, CAST(0 AS DOUBLE)), CAST(1 AS DOUBLE))", 6)} AS amount_paid,
       {fx("coalesce(nullif(amount_received, CAST(0 AS DOUBLE)), CAST(1 AS DOUBLE))", 6)} AS amount_received,
       coalesce(nullif(trim(payment_currency), ''), 'USD') AS payment_currency,
       coalesce(nullif(trim(receiving_currency), ''), 'USD') AS receiving_currency,
       coalesce(nullif(trim(payment_format), ''), 'Wire Transfer') AS payment_format,
       coalesce(nullif(trim(from_bank), ''), '') AS from_bank,
       coalesce(nullif(trim(to_bank), ''), '') AS to_bank
FROM tx""")

SQL["validate"] = with_tx("""
SELECT tx_id, CAST(len(r) AS INTEGER) AS n_reasons, array_to_string(r, ',') AS reasons
FROM (
  SELECT tx_id, list_filter([
      CASE WHEN coalesce(trim(sender_account), '') = '' THEN 'missing_sender' END,
      CASE WHEN coalesce(trim(receiver_account), '') = '' THEN 'missing_receiver' END,
      CASE WHEN NOT coalesce(amount_paid > 0, false) THEN 'amount_paid_not_positive' END,
      CASE WHEN NOT coalesce(amount_received > 0, false) THEN 'amount_received_not_positive' END,
      CASE WHEN ts IS NULL THEN 'missing_timestamp' END], lambda x: x IS NOT NULL) AS r
  FROM tx) q""")

SQL["time_features"] = with_tx("""
SELECT tx_id, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week,
       CAST(coalesce(isodow(ts) - 1 >= 5, false) AS INTEGER) AS is_weekend, CAST(day(ts) AS INTEGER) AS day_of_month
FROM tx""")

AMOUNT_COLS = f"""
  {fx('amount_paid', 6)} AS amount_paid,
  {fx('amount_received', 6)} AS amount_received,
  {fx('coalesce(ln(1 + amount_paid), 0)', 6)} AS log_amount_paid,
  {fx('coalesce(ln(1 + amount_received), 0)', 6)} AS log_amount_received,
  {fx('CASE WHEN amount_received > 0 THEN amount_paid / amount_received ELSE CAST(1 AS DOUBLE) END', 6)} AS amount_ratio,
  {fx('ln(least(greatest(CASE WHEN amount_received > 0 THEN amount_paid / amount_received ELSE CAST(1 AS DOUBLE) END, 0.01), CAST(100 AS DOUBLE)))', 6)} AS log_amount_ratio,
  CAST(amount_paid <= -1 OR amount_received <= -1 AS INTEGER) AS bad_amount"""

SQL["amount_features"] = with_tx(f"SELECT tx_id, {AMOUNT_COLS} FROM tx")

SQL["cross_flags"] = with_tx("""
SELECT tx_id, CAST(coalesce(payment_currency <> receiving_currency, true) AS INTEGER) AS is_cross_currency,
       CAST(coalesce(from_bank <> to_bank, true) AS INTEGER) AS is_cross_bank
FROM tx""")

DICTS = """
cur AS (
  SELECT value, CAST(row_number() OVER (ORDER BY value) - 1 AS INTEGER) AS code FROM (
    SELECT payment_currency AS value FROM tx WHERE payment_currency IS NOT NULL
    UNION SELECT receiving_currency FROM tx WHERE receiving_currency IS NOT NULL) v),
fmt AS (
  SELECT value, CAST(row_number() OVER (ORDER BY value) - 1 AS INTEGER) AS code FROM (
    SELECT DISTINCT coalesce(payment_format, 'Unknown') AS value FROM tx) v),
enc AS (
  SELECT tx.*, coalesce(pc.code, -1) AS payment_currency_enc, coalesce(rc.code, -1) AS receiving_currency_enc,
         coalesce(pf.code, -1) AS payment_format_enc
  FROM tx LEFT JOIN cur pc ON tx.payment_currency = pc.value
          LEFT JOIN cur rc ON tx.receiving_currency = rc.value
          LEFT JOIN fmt pf ON coalesce(tx.payment_format, 'Unknown') = pf.value)"""

SQL["category_codes"] = with_tx(
    "SELECT tx_id, payment_currency_enc, receiving_currency_enc, payment_format_enc FROM enc", DICTS)

SQL["fitted_codes"] = with_tx("""
SELECT tx_id, coalesce(pc.code, -1) AS payment_currency_enc, coalesce(rc.code, -1) AS receiving_currency_enc,
       coalesce(pf.code, -1) AS payment_format_enc
FROM tx LEFT JOIN fit_cur pc ON tx.payment_currency = pc.value
        LEFT JOIN fit_cur rc ON tx.receiving_currency = rc.value
        LEFT JOIN fit_fmt pf ON coalesce(tx.payment_format, 'Unknown') = pf.value
WHERE tx.ts >= TIMESTAMP '1992-01-02'""", """
early AS (SELECT * FROM tx WHERE ts < TIMESTAMP '1992-01-02'),
fit_cur AS (SELECT value, CAST(row_number() OVER (ORDER BY value) - 1 AS INTEGER) AS code FROM (
    SELECT payment_currency AS value FROM early WHERE payment_currency IS NOT NULL
    UNION SELECT receiving_currency FROM early WHERE receiving_currency IS NOT NULL) v),
fit_fmt AS (SELECT value, CAST(row_number() OVER (ORDER BY value) - 1 AS INTEGER) AS code FROM (
    SELECT DISTINCT coalesce(payment_format, 'Unknown') AS value FROM early) v)""")

SENDER = f"""
sp AS (
  SELECT sender_account, count(*) AS sender_tx_count,
         {fx('CAST(sum(CAST(amount_paid AS DECIMAL(20,6))) AS DOUBLE)', 4)} AS sender_total_amount,
         {fx('CAST(sum(CAST(amount_paid AS DECIMAL(20,6))) AS DOUBLE) / count(*)', 6)} AS sender_mean_amount,
         {fx('coalesce(stddev_samp(amount_paid), 0)', 4)} AS sender_std_amount,
         count(DISTINCT receiver_account) AS sender_receiver_diversity
  FROM tx WHERE sender_account IS NOT NULL GROUP BY sender_account)"""

RECEIVER = f"""
rp AS (
  SELECT receiver_account, count(*) AS receiver_tx_count,
         {fx('CAST(sum(CAST(amount_received AS DECIMAL(18,4))) AS DOUBLE)', 4)} AS receiver_total_amount,
         {fx('CAST(sum(CAST(amount_received AS DECIMAL(18,4))) AS DOUBLE) / count(*)', 6)} AS receiver_mean_amount,
         count(DISTINCT sender_account) AS receiver_sender_diversity
  FROM tx WHERE receiver_account IS NOT NULL GROUP BY receiver_account)"""

SQL["sender_profile"] = with_tx("SELECT * FROM sp", SENDER)
SQL["receiver_profile"] = with_tx("SELECT * FROM rp", RECEIVER)

SQL["diversity"] = with_tx("""
SELECT sender_account AS account_id, 'sender' AS role, count(DISTINCT receiver_account) AS n_counterparties
FROM tx WHERE sender_account IS NOT NULL AND receiver_account IS NOT NULL GROUP BY sender_account
UNION ALL
SELECT receiver_account AS account_id, 'receiver' AS role, count(DISTINCT sender_account) AS n_counterparties
FROM tx WHERE sender_account IS NOT NULL AND receiver_account IS NOT NULL GROUP BY receiver_account""")

FEATURES = f"""
feat AS (
  SELECT e.tx_id, e.label, e.ts, e.sender_account, e.receiver_account, e.amount_paid, e.amount_received,
         CAST(hour(e.ts) AS INTEGER) AS hour, CAST(isodow(e.ts) - 1 AS INTEGER) AS day_of_week,
         CAST(coalesce(isodow(e.ts) - 1 >= 5, false) AS INTEGER) AS is_weekend, CAST(day(e.ts) AS INTEGER) AS day_of_month,
         {fx('coalesce(ln(1 + e.amount_paid), 0)', 6)} AS log_amount_paid,
         {fx('coalesce(ln(1 + e.amount_received), 0)', 6)} AS log_amount_received,
         {fx('ln(least(greatest(CASE WHEN e.amount_received > 0 THEN e.amount_paid / e.amount_received ELSE CAST(1 AS DOUBLE) END, 0.01), CAST(100 AS DOUBLE)))', 6)} AS log_amount_ratio,
         CAST(coalesce(e.payment_currency <> e.receiving_currency, true) AS INTEGER) AS is_cross_currency,
         e.payment_currency_enc, e.receiving_currency_enc, e.payment_format_enc,
         CAST(coalesce(e.from_bank <> e.to_bank, true) AS INTEGER) AS is_cross_bank,
         coalesce(sp.sender_tx_count, 0) AS sender_tx_count,
         coalesce(sp.sender_total_amount, 0) AS sender_total_amount,
         coalesce(sp.sender_mean_amount, 0) AS sender_mean_amount,
         coalesce(sp.sender_std_amount, 0) AS sender_std_amount,
         coalesce(rp.receiver_tx_count, 0) AS receiver_tx_count,
         coalesce(rp.receiver_total_amount, 0) AS receiver_total_amount,
         coalesce(rp.receiver_mean_amount, 0) AS receiver_mean_amount,
         coalesce(sp.sender_receiver_diversity, 0) AS sender_receiver_diversity,
         coalesce(rp.receiver_sender_diversity, 0) AS receiver_sender_diversity
  FROM enc e LEFT JOIN sp ON e.sender_account = sp.sender_account
             LEFT JOIN rp ON e.receiver_account = rp.receiver_account)"""

FEATURE_NAMES = ", ".join(FEATURE_COLUMNS)

SQL["feature_table"] = with_tx(f"SELECT tx_id, label, {FEATURE_NAMES} FROM feat", DICTS, SENDER, RECEIVER, FEATURES)

SQL["class_balance"] = with_tx(f"""
SELECT count(*) FILTER (WHERE label = 1) AS n_pos, count(*) FILTER (WHERE label = 0) AS n_neg,
       {fx('CAST(count(*) FILTER (WHERE label = 0) AS DOUBLE) / CAST(greatest(count(*) FILTER (WHERE label = 1), 1) AS DOUBLE)', 6)} AS pos_weight
FROM tx""")

SQL["stratified_split"] = with_tx("""
SELECT tx_id, label,
       CAST(row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws(':', '42', tx_id)), tx_id)
            <= ceil(count(*) OVER (PARTITION BY label) * 0.2) AS INTEGER) AS is_test
FROM tx""")

SQL["random_split"] = with_tx("""
SELECT tx_id, label,
       CAST(row_number() OVER (ORDER BY md5(concat_ws(':', '7', tx_id)), tx_id)
            <= floor(count(*) OVER () * 0.2) AS INTEGER) AS is_test
FROM tx""")


def _roll(name: str, days: int) -> str:
    w = f"(PARTITION BY sender_account ORDER BY ts RANGE BETWEEN INTERVAL {days} DAY PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)"
    return f"""count(amount_paid) OVER {w} AS cnt_{name},
       {fx(f'coalesce(CAST(sum(CAST(amount_paid AS DECIMAL(20,6))) OVER {w} AS DOUBLE), 0)', 4)} AS sum_{name},
       {fx(f'coalesce(CAST(sum(CAST(amount_paid AS DECIMAL(20,6))) OVER {w} AS DOUBLE) / CAST(count(amount_paid) OVER {w} AS DOUBLE), 0)', 6)} AS mean_{name},
       {fx(f'coalesce(stddev_samp(amount_paid) OVER {w}, 0)', 4)} AS std_{name},
       coalesce(max(amount_paid) OVER {w}, 0) AS max_{name}"""


SQL["rolling_features"] = f"""WITH {EV}
SELECT tx_id, {_roll('1d', 1)},
       {_roll('7d', 7)}
FROM ev"""


# --- graph ----------------------------------------------------------------------------------------

SE = """
se AS (
  SELECT src, dst, tx_id, amount_paid, label, payment_format, is_cross_currency, n_tx FROM (
    SELECT sender_account AS src, receiver_account AS dst, tx_id, amount_paid, label, payment_format,
           CAST(coalesce(payment_currency <> receiving_currency, true) AS INTEGER) AS is_cross_currency,
           count(*) OVER (PARTITION BY sender_account, receiver_account) AS n_tx,
           row_number() OVER (PARTITION BY sender_account, receiver_account ORDER BY ts DESC, tx_id DESC) AS rn
    FROM tx WHERE sender_account IS NOT NULL AND receiver_account IS NOT NULL) q
  WHERE rn = 1)"""

SQL["latest_edge"] = with_tx(f"""
SELECT src, dst, tx_id, {fx('amount_paid', 6)} AS amount_paid, label, payment_format, is_cross_currency, n_tx
FROM se""", SE)

SQL["accounts"] = with_tx("""
SELECT sender_account AS account_id FROM tx WHERE sender_account IS NOT NULL
UNION SELECT receiver_account FROM tx WHERE receiver_account IS NOT NULL""")

NODE_FEATURES = ["log_sent_sum", "sent_count", "log_sent_mean", "log_sent_std", "log_recv_sum", "recv_count",
                 "sent_to_unique", "recv_from_unique"]

NF = f"""
acc AS (SELECT sender_account AS account_id FROM tx WHERE sender_account IS NOT NULL
        UNION SELECT receiver_account FROM tx WHERE receiver_account IS NOT NULL),
sent AS (SELECT sender_account AS account_id, CAST(sum(CAST(amount_paid AS DECIMAL(20,6))) AS DOUBLE) AS ss,
                count(amount_paid) AS sent_count, stddev_samp(amount_paid) AS sd,
                count(DISTINCT receiver_account) AS sent_to_unique
         FROM tx WHERE sender_account IS NOT NULL GROUP BY 1),
recv AS (SELECT receiver_account AS account_id, CAST(sum(CAST(amount_received AS DECIMAL(18,4))) AS DOUBLE) AS rs,
                count(amount_received) AS recv_count, count(DISTINCT sender_account) AS recv_from_unique
         FROM tx WHERE receiver_account IS NOT NULL GROUP BY 1),
ns AS (SELECT acc.account_id,
              {fx('coalesce(sent.ss, 0)', 4)} AS sent_sum, coalesce(sent.sent_count, 0) AS sent_count,
              {fx('coalesce(sent.ss / CAST(sent.sent_count AS DOUBLE), 0)', 6)} AS sent_mean,
              {fx('coalesce(sent.sd, 0)', 4)} AS sent_std,
              {fx('coalesce(recv.rs, 0)', 4)} AS recv_sum, coalesce(recv.recv_count, 0) AS recv_count,
              coalesce(sent.sent_to_unique, 0) AS sent_to_unique, coalesce(recv.recv_from_unique, 0) AS recv_from_unique
       FROM acc LEFT JOIN sent ON acc.account_id = sent.account_id LEFT JOIN recv ON acc.account_id = recv.account_id),
nf AS (SELECT account_id, {fx('ln(1 + sent_sum)', 6)} AS log_sent_sum, CAST(sent_count AS DOUBLE) AS sent_count,
              {fx('ln(1 + sent_mean)', 6)} AS log_sent_mean, {fx('ln(1 + sent_std)', 6)} AS log_sent_std,
              {fx('ln(1 + recv_sum)', 6)} AS log_recv_sum, CAST(recv_count AS DOUBLE) AS recv_count,
              CAST(sent_to_unique AS DOUBLE) AS sent_to_unique, CAST(recv_from_unique AS DOUBLE) AS recv_from_unique
       FROM ns)"""

_z = ",\n       ".join(
    f"{fx(f'({c} - avg({c}) OVER ()) / coalesce(nullif(stddev_pop({c}) OVER (), 0), 1)', 4)} AS {c}_z"
    for c in NODE_FEATURES)
SQL["node_features"] = with_tx(f"SELECT *, {_z} FROM nf", NF)

SQL["edge_features"] = with_tx(f"""
SELECT tx_id, sender_account AS src, receiver_account AS dst, label,
       {fx('coalesce(ln(1 + amount_paid), 0)', 6)} AS e_log_amount,
       CAST(coalesce(payment_currency <> receiving_currency, true) AS DOUBLE) AS e_cross_currency,
       CAST(payment_format_enc AS DOUBLE) AS e_format,
       CAST(coalesce(from_bank <> to_bank, true) AS DOUBLE) AS e_cross_bank
FROM enc""", DICTS)

SQL["degrees"] = with_tx("""
SELECT node AS account_id, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree,
       CAST(sum(f) AS BIGINT) AS fraud_out
FROM (SELECT src AS node, 1 AS o, 0 AS i, coalesce(label, 0) AS f FROM se
      UNION ALL SELECT dst, 0, 1, 0 FROM se) q GROUP BY node""", SE)

SQL["graph_summary"] = with_tx(f"""
SELECT (SELECT count(DISTINCT n) FROM (SELECT src AS n FROM se UNION ALL SELECT dst FROM se) q) AS n_nodes,
       count(*) AS n_edges, count(*) FILTER (WHERE coalesce(label, 0) = 1) AS n_fraud_edges,
       {fx('CAST(count(*) FILTER (WHERE coalesce(label, 0) = 1) AS DOUBLE) * CAST(100 AS DOUBLE) / count(*)', 6)} AS fraud_pct
FROM se""", SE)

EGO = """
seeds AS (SELECT sender_account AS seed FROM tx WHERE label = 1 AND sender_account IS NOT NULL
          GROUP BY sender_account),
und AS (SELECT src AS a, dst AS b FROM se UNION SELECT dst, src FROM se),
v0 AS (SELECT seed, seed AS node FROM seeds WHERE seed IN (SELECT a FROM und)),
n1 AS (SELECT seed, node FROM v0 UNION SELECT v0.seed, und.b FROM v0 JOIN und ON v0.node = und.a),
n2 AS (SELECT seed, node FROM n1 UNION SELECT n1.seed, und.b FROM n1 JOIN und ON n1.node = und.a),
sub AS (SELECT s.seed, se.src, se.dst, se.label FROM se JOIN n2 s ON se.src = s.node
        JOIN n2 d ON d.seed = s.seed AND se.dst = d.node)"""

SQL["ego_2hop"] = with_tx("""
SELECT n.seed, n.n_nodes, coalesce(e.n_edges, 0) AS n_edges, coalesce(e.n_fraud_edges, 0) AS n_fraud_edges
FROM (SELECT seed, count(*) AS n_nodes FROM n2 GROUP BY seed) n
LEFT JOIN (SELECT seed, count(*) AS n_edges, count(*) FILTER (WHERE label = 1) AS n_fraud_edges FROM sub GROUP BY seed) e
ON n.seed = e.seed""", SE, EGO)

SQL["node_role"] = with_tx("""
SELECT n2.seed, n2.node,
       CASE WHEN n2.node = n2.seed THEN 'seed' WHEN n2.node IN (SELECT seed FROM seeds) THEN 'flagged'
            WHEN coalesce(d.fraud_out, 0) > 0 THEN 'fraud_linked' ELSE 'normal' END AS role,
       coalesce(d.out_degree, 0) AS out_degree, coalesce(d.in_degree, 0) AS in_degree, coalesce(d.fraud_out, 0) AS fraud_out
FROM n2 LEFT JOIN (
  SELECT seed, node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(f) AS BIGINT) AS fraud_out
  FROM (SELECT seed, src AS node, 1 AS o, 0 AS i, coalesce(label, 0) AS f FROM sub
        UNION ALL SELECT seed, dst, 0, 1, 0 FROM sub) q GROUP BY seed, node) d
ON n2.seed = d.seed AND n2.node = d.node""", SE, EGO)

SQL["alert_neighbourhood"] = with_tx("""
SELECT n.seed AS tx_id, n.n_nodes, e.n_edges, e.n_highlight
FROM (SELECT seed, count(*) AS n_nodes FROM nodes GROUP BY seed) n
LEFT JOIN (SELECT s.seed, count(*) AS n_edges,
                  CAST(sum(CAST((se.src = al.sender_account AND se.dst = al.receiver_account) OR coalesce(se.label, 0) = 1 AS INTEGER)) AS BIGINT) AS n_highlight
           FROM se JOIN nodes s ON se.src = s.node JOIN nodes d ON d.seed = s.seed AND se.dst = d.node
           JOIN alerts al ON al.tx_id = s.seed GROUP BY s.seed) e ON n.seed = e.seed""", SE, """
alerts AS (SELECT tx_id, sender_account, receiver_account FROM tx WHERE label = 1),
und AS (SELECT src AS a, dst AS b FROM se UNION SELECT dst, src FROM se),
ends AS (SELECT DISTINCT seed, node FROM (SELECT tx_id AS seed, sender_account AS node FROM alerts
                                          UNION ALL SELECT tx_id, receiver_account FROM alerts) q
         WHERE node IN (SELECT a FROM und)),
nodes AS (SELECT seed, node FROM ends UNION SELECT ends.seed, und.b FROM ends JOIN und ON ends.node = und.a)""")


def _khop_sql(k: int) -> str:
    ctes = [NF, "me AS (SELECT sender_account AS src, receiver_account AS dst FROM tx)",
            "h0 AS (SELECT account_id, " + ", ".join(NODE_FEATURES) + " FROM nf)"]
    for h in range(1, k + 1):
        sums = ", ".join(f"CAST(sum(CAST(round(x.{c} * 1e6) AS BIGINT)) AS DOUBLE) / 1e6 AS s_{c}" for c in NODE_FEATURES)
        ctes.append(f"a{h} AS (SELECT me.dst, count(*) AS deg, {sums} FROM me JOIN h{h-1} x ON me.src = x.account_id GROUP BY me.dst)")
        cols = ", ".join(f"{fx(f'coalesce(a.s_{c} / CAST(greatest(a.deg, 1) AS DOUBLE), 0)', 6)} AS {c}" for c in NODE_FEATURES)
        ctes.append(f"h{h} AS (SELECT n.account_id, {cols} FROM nf n LEFT JOIN a{h} a ON n.account_id = a.dst)")
    sel = ["h0.account_id"]
    for h in range(0, k + 1):
        sel += [f"h{h}.{c} AS {c}_h{h}" for c in NODE_FEATURES]
    joins = " ".join(f"JOIN h{h} ON h{h}.account_id = h0.account_id" for h in range(1, k + 1))
    return ctes, f"SELECT {', '.join(sel)} FROM h0 {joins}"


_c1, _b1 = _khop_sql(1)
SQL["neighbour_mean_1"] = with_tx(_b1, *_c1)
_c2, _b2 = _khop_sql(2)
SQL["neighbour_mean_2"] = with_tx(_b2, *_c2)
_emb_cols = [f"{c}_h{h}" for h in (0, 1) for c in NODE_FEATURES]
SQL["edge_representation"] = with_tx(
    "SELECT e.tx_id, e.label, e.e_log_amount, e.e_cross_currency, e.e_format, e.e_cross_bank, "
    + ", ".join(f"s.{c} AS src_{c}" for c in _emb_cols) + ", "
    + ", ".join(f"d.{c} AS dst_{c}" for c in _emb_cols)
    + " FROM ef e LEFT JOIN emb s ON e.src = s.account_id LEFT JOIN emb d ON e.dst = d.account_id",
    DICTS, *_c1, "emb AS (" + _b1 + ")",
    f"""ef AS (SELECT tx_id, sender_account AS src, receiver_account AS dst, label,
       {fx('coalesce(ln(1 + amount_paid), 0)', 6)} AS e_log_amount,
       CAST(coalesce(payment_currency <> receiving_currency, true) AS DOUBLE) AS e_cross_currency,
       CAST(payment_format_enc AS DOUBLE) AS e_format,
       CAST(coalesce(from_bank <> to_bank, true) AS DOUBLE) AS e_cross_bank FROM enc)""")

ENDS = """ends AS (SELECT account_id, label FROM (SELECT sender_account AS account_id, label FROM tx
                  UNION ALL SELECT receiver_account, label FROM tx) q WHERE account_id IS NOT NULL)"""

SQL["fraud_nodes"] = with_tx(
    "SELECT account_id, CAST(max(coalesce(label, 0)) AS INTEGER) AS is_fraud_node FROM ends GROUP BY account_id", ENDS)

SQL["edge_score"] = with_tx(f"""
SELECT tx.tx_id, {fx('(s.score + d.score) / CAST(2 AS DOUBLE)', 6)} AS edge_score
FROM tx LEFT JOIN ns s ON tx.sender_account = s.account_id LEFT JOIN ns d ON tx.receiver_account = d.account_id""",
    ENDS, f"ns AS (SELECT account_id, {fx('CAST(sum(label) AS DOUBLE) / count(*)', 6)} AS score FROM ends GROUP BY account_id)")

SQL["cycles_3"] = with_tx("""
SELECT e1.src AS node_a, e1.dst AS node_b, e2.dst AS node_c
FROM e e1 JOIN e e2 ON e1.dst = e2.src JOIN e e3 ON e2.dst = e3.src AND e3.dst = e1.src
WHERE e1.src < e1.dst AND e1.src < e2.dst""", SE, "e AS (SELECT DISTINCT src, dst FROM se WHERE src <> dst)")


def _fan(key: str, other: str, amount: str, k: int) -> str:
    return with_tx(f"""
SELECT {key} AS account_id, time_bucket(INTERVAL 30 DAY, ts, TIMESTAMP '1970-01-01') AS window_start,
       count(DISTINCT {other}) AS n_counterparties, count(*) AS n_tx,
       {fx(f'CAST(sum(CAST({amount} AS DECIMAL(20,6))) AS DOUBLE)', 4)} AS total_amount
FROM tx WHERE {key} IS NOT NULL AND {other} IS NOT NULL AND ts IS NOT NULL
GROUP BY 1, 2 HAVING count(DISTINCT {other}) >= {k}""")


SQL["fan_out"] = _fan("sender_account", "receiver_account", "amount_paid", 5)
SQL["fan_in"] = _fan("receiver_account", "sender_account", "amount_received", 5)

SQL["split_merge"] = with_tx("""
SELECT src AS src_account, dst AS dst_account, count(DISTINCT m) AS n_intermediates, count(*) AS n_paths
FROM (SELECT l1.s AS src, l2.r AS dst, l1.r AS m
      FROM b l1 JOIN b l2 ON l1.r = l2.s
      WHERE l2.t >= l1.t AND l2.t - l1.t <= 2592000000000 AND l1.s <> l2.r
        AND l2.a >= l1.a * CAST(0.9 AS DOUBLE) AND l2.a <= l1.a * CAST(1.0 AS DOUBLE)) p
GROUP BY 1, 2 HAVING count(DISTINCT m) >= 2""", """
b AS (SELECT sender_account AS s, receiver_account AS r, epoch_us(ts) AS t, amount_paid AS a FROM tx
      WHERE sender_account IS NOT NULL AND receiver_account IS NOT NULL AND sender_account <> receiver_account
        AND ts IS NOT NULL)""")

SQL["structuring"] = with_tx(f"""
SELECT sender_account AS account_id, time_bucket(INTERVAL 90 DAY, ts, TIMESTAMP '1970-01-01') AS window_start,
       count(*) AS n_tx, {fx('CAST(sum(CAST(amount_received AS DECIMAL(20,6))) AS DOUBLE)', 4)} AS total_amount
FROM tx WHERE amount_received >= CAST(9000.0 AS DOUBLE) AND amount_received < CAST(10000.0 AS DOUBLE)
  AND sender_account IS NOT NULL
GROUP BY 1, 2 HAVING count(*) >= 2""")


# --- fusion, alerts, service counters ------------------------------------------------------------

def _fused(w: float) -> str:
    gw = 1.0 - w
    return f"""
sc AS (SELECT tx_id, ts, sender_account, receiver_account, amount_paid, label,
              l_quantity / CAST(50 AS DOUBLE) AS tabular_score,
              CASE WHEN l_returnflag <> 'N' THEN l_discount * CAST(10 AS DOUBLE) END AS gnn_score FROM tx),
fu0 AS (SELECT *, CASE WHEN gnn_score IS NULL THEN tabular_score
                       ELSE CAST({w!r} AS DOUBLE) * tabular_score + CAST({gw!r} AS DOUBLE) * gnn_score END AS f FROM sc),
fu AS (SELECT *, {fx('f', 6)} AS fused_score, f >= CAST(0.5 AS DOUBLE) AS is_fraud,
              {fx('abs(f - CAST(0.5 AS DOUBLE)) / CAST(0.5 AS DOUBLE)', 4)} AS confidence,
              CASE WHEN gnn_score IS NULL THEN CAST(1.0 AS DOUBLE) ELSE CAST({w!r} AS DOUBLE) END AS weight_tabular,
              CASE WHEN gnn_score IS NULL THEN CAST(0.0 AS DOUBLE) ELSE CAST({gw!r} AS DOUBLE) END AS weight_graph,
              CAST(0.5 AS DOUBLE) AS threshold FROM fu0)"""


FUSE_OUT = f"""SELECT tx_id, {fx('tabular_score', 6)} AS tabular_score, {fx('gnn_score', 6)} AS gnn_score, fused_score,
       is_fraud, confidence, weight_tabular, weight_graph, threshold FROM fu"""
SQL["fuse"] = with_tx(FUSE_OUT, _fused(0.6))
SQL["fuse_equal"] = with_tx(FUSE_OUT, _fused(0.5))

SQL["alerts"] = with_tx("""
SELECT tx_id, fused_score, CASE WHEN coalesce(fused_score, 0) >= CAST(0.7 AS DOUBLE) THEN 'FRAUD' ELSE 'SUSPICIOUS' END AS status
FROM fu WHERE is_fraud""", _fused(0.6))

SQL["status_band"] = with_tx("""
SELECT left(tx_id, 12) AS transaction, left(sender_account, 12) AS sender, left(receiver_account, 12) AS receiver,
       '$' || format('{:,.2f}', amount_paid) AS amount, printf('%.4f', fused_score) AS fused_risk,
       CASE WHEN coalesce(fused_score, 0) >= CAST(0.7 AS DOUBLE) THEN 'FRAUD' ELSE 'SUSPICIOUS' END AS status
FROM fu WHERE coalesce(fused_score, 0) >= CAST(0.6 AS DOUBLE)""", _fused(0.6))

SQL["recent_alerts"] = with_tx("""
SELECT tx_id, ts, fused_score FROM fu WHERE is_fraud
ORDER BY ts DESC NULLS LAST, tx_id DESC LIMIT 50""", _fused(0.6))

SQL["last_n"] = with_tx("SELECT tx_id, ts, sender_account FROM tx ORDER BY ts DESC NULLS LAST, tx_id DESC LIMIT 1000")

SQL["p99"] = """
SELECT event_type, value AS p99 FROM (
  SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn,
         count(*) OVER (PARTITION BY event_type) AS n
  FROM events WHERE value IS NOT NULL AND NOT isnan(value)) q
WHERE rn = least(floor(CAST(0.99 AS DOUBLE) * CAST(n AS DOUBLE)) + 1, n)"""

SQL["counters"] = with_tx(f"""
SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS total_scored, count(*) FILTER (WHERE coalesce(is_fraud, false)) AS total_flagged,
       count(*) FILTER (WHERE fused_score IS NULL) AS errors,
       {fx('CAST(count(*) FILTER (WHERE coalesce(is_fraud, false)) AS DOUBLE) / CAST(greatest(count(*), 1) AS DOUBLE)', 6)} AS flagged_rate
FROM fu GROUP BY 1""", _fused(0.6))


# --- evaluation metrics --------------------------------------------------------------------------

def _metrics_ctes(score: str, where: str = "TRUE", p: str = "") -> list[str]:
    return [f"""
{p}g AS (SELECT s, count(*) FILTER (WHERE label = 1) AS tp, count(*) FILTER (WHERE label <> 1) AS fp
       FROM (SELECT {score} AS s, label FROM fu WHERE {where}) q WHERE s IS NOT NULL AND NOT isnan(s) GROUP BY s)""",
            f"""
{p}c AS (SELECT s, tp, fp, sum(tp) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS ctp,
              sum(fp) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS cfp,
              sum(tp) OVER () AS P, sum(fp) OVER () AS N FROM {p}g)""",
            f"""
{p}cm AS (SELECT
   {fx(f"CASE WHEN max(P) > 0 THEN sum(CAST(tp AS DOUBLE) / CAST(P AS DOUBLE) * (CAST(ctp AS DOUBLE) / CAST(ctp + cfp AS DOUBLE))) ELSE 0 END", 6)} AS pr_auc,
   {fx(f"CASE WHEN max(P) > 0 THEN sum(CAST(tp AS DOUBLE) / CAST(P AS DOUBLE) * (CAST(ctp AS DOUBLE) / CAST(ctp + cfp AS DOUBLE) + CASE WHEN (ctp - tp) + (cfp - fp) > 0 THEN CAST(ctp - tp AS DOUBLE) / CAST((ctp - tp) + (cfp - fp) AS DOUBLE) ELSE CAST(1 AS DOUBLE) END) / CAST(2 AS DOUBLE)) ELSE 0 END", 6)} AS pr_auc_trapezoid,
   {fx(f"CASE WHEN max(P) > 0 AND max(N) > 0 THEN sum(CAST(fp AS DOUBLE) * CAST(ctp + ctp - tp AS DOUBLE) / CAST(2 AS DOUBLE)) / CAST(max(P) * max(N) AS DOUBLE) ELSE 0 END", 6)} AS roc_auc,
   {fx(f"CASE WHEN max(P) > 0 AND max(N) > 0 THEN coalesce(max(CASE WHEN CAST(cfp AS DOUBLE) / CAST(N AS DOUBLE) <= CAST(0.05 AS DOUBLE) THEN CAST(ctp AS DOUBLE) / CAST(P AS DOUBLE) END), 0) ELSE 0 END", 6)} AS recall_at_fpr_5pct
 FROM {p}c)""",
            f"""
{p}pr AS (SELECT
   {fx(f"coalesce(CAST(count(*) FILTER (WHERE {score} >= CAST(0.5 AS DOUBLE) AND label = 1) AS DOUBLE) / nullif(CAST(count(*) FILTER (WHERE {score} >= CAST(0.5 AS DOUBLE)) AS DOUBLE), 0), 0)", 6)} AS precision_at_05,
   {fx(f"coalesce(CAST(count(*) FILTER (WHERE {score} >= CAST(0.5 AS DOUBLE) AND label = 1) AS DOUBLE) / nullif(CAST(count(*) FILTER (WHERE label = 1) AS DOUBLE), 0), 0)", 6)} AS recall_at_05,
   {fx(f"coalesce(CAST(2 AS DOUBLE) * CAST(count(*) FILTER (WHERE {score} >= CAST(0.5 AS DOUBLE) AND label = 1) AS DOUBLE) / nullif(CAST(count(*) FILTER (WHERE {score} >= CAST(0.5 AS DOUBLE)) + count(*) FILTER (WHERE label = 1) AS DOUBLE), 0), 0)", 6)} AS f1_at_05,
   {fx('avg(CAST(label AS DOUBLE))', 6)} AS fraud_rate_test, count(*) AS n_test, count(*) FILTER (WHERE label = 1) AS n_fraud_test
 FROM fu WHERE {where})"""]


_M = _metrics_ctes("fused_score")
SQL["pr_auc"] = with_tx("SELECT pr_auc FROM cm", _fused(0.6), *_M)
SQL["pr_auc_trapezoid"] = with_tx("SELECT pr_auc_trapezoid FROM cm", _fused(0.6), *_M)
SQL["roc_auc"] = with_tx("SELECT roc_auc FROM cm", _fused(0.6), *_M)
SQL["recall_at_fpr"] = with_tx("SELECT recall_at_fpr_5pct FROM cm", _fused(0.6), *_M)
SQL["prf1"] = with_tx("SELECT precision_at_05, recall_at_05, f1_at_05 FROM pr", _fused(0.6), *_M)
SQL["prevalence"] = with_tx("SELECT fraud_rate_test, n_test, n_fraud_test FROM pr", _fused(0.6), *_M)

_MT = _metrics_ctes("tabular_score", "tabular_score IS NOT NULL", "t_")
_MG = _metrics_ctes("gnn_score", "gnn_score IS NOT NULL", "g_")
_MET = ["pr_auc", "pr_auc_trapezoid", "roc_auc", "recall_at_fpr_5pct", "precision_at_05", "recall_at_05",
        "f1_at_05", "fraud_rate_test"]
_rows = " UNION ALL ".join(
    f"SELECT '{m}' AS metric, CAST(tc.{m} AS DOUBLE) AS tabular, CAST(gc.{m} AS DOUBLE) AS graph "
    f"FROM (SELECT * FROM t_cm, t_pr) tc, (SELECT * FROM g_cm, g_pr) gc" for m in _MET)
SQL["compare_models"] = with_tx(f"SELECT metric, tabular, graph, {fx('graph - tabular', 6)} AS delta FROM ({_rows}) q",
                                _fused(0.6), *_MT, *_MG)


# --- drift -----------------------------------------------------------------------------------------

FEATURE_LIST = [c.strip() for c in FEATURE_NAMES.split(",")]


def _long(src: str) -> str:
    casts = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in FEATURE_LIST)
    return (f"SELECT feature, value FROM (SELECT {casts} FROM {src}) q "
            f"UNPIVOT (value FOR feature IN ({', '.join(FEATURE_LIST)})) "
            "WHERE value IS NOT NULL AND NOT isnan(value) AND NOT isinf(value)")


_bin = " + ".join(f"CAST(value >= CAST({j} AS DOUBLE) * step + lo AS INTEGER)" for j in range(1, 10))

DRIFT = f"""
refr AS (SELECT * FROM feat WHERE ts < TIMESTAMP '1999-01-01'),
curr AS (SELECT * FROM feat WHERE NOT (ts < TIMESTAMP '1999-01-01')),
rl AS ({_long('refr')}),
cl AS ({_long('curr')}),
st AS (SELECT feature, min(value) AS mn, max(value) AS mx, count(*) AS n_ref FROM rl GROUP BY feature),
ed AS (SELECT feature, lo, hi, n_ref, (hi - lo) / CAST(10 AS DOUBLE) AS step FROM (
         SELECT feature, n_ref,
                CASE WHEN mn = mx THEN mn - CAST(0.5 AS DOUBLE) ELSE mn END AS lo,
                CASE WHEN mn = mx THEN mx + CAST(0.5 AS DOUBLE) ELSE mx END AS hi FROM st) q),
rb AS (SELECT feature, {_bin} AS bin, count(*) AS r_n FROM rl JOIN ed USING (feature)
       WHERE value >= lo AND value <= hi GROUP BY 1, 2),
cb AS (SELECT feature, {_bin} AS bin, count(*) AS c_n FROM cl JOIN ed USING (feature)
       WHERE value >= lo AND value <= hi GROUP BY 1, 2),
nc AS (SELECT feature, count(*) AS n_cur FROM cl GROUP BY feature),
pt AS (SELECT ed.feature,
              (CAST(coalesce(rb.r_n, 0) AS DOUBLE) + 1e-10) / (CAST(ed.n_ref AS DOUBLE) + 1e-10) AS r,
              (CAST(coalesce(cb.c_n, 0) AS DOUBLE) + 1e-10) / (CAST(coalesce(nc.n_cur, 0) AS DOUBLE) + 1e-10) AS c
       FROM ed CROSS JOIN range(10) b(bin)
       LEFT JOIN nc ON nc.feature = ed.feature
       LEFT JOIN rb ON rb.feature = ed.feature AND rb.bin = b.bin
       LEFT JOIN cb ON cb.feature = ed.feature AND cb.bin = b.bin),
ps AS (SELECT feature, sum((c - r) * ln(c / r)) AS psi FROM pt GROUP BY feature),
fd AS (SELECT feature, {fx('psi', 4)} AS psi, psi > CAST(0.2 AS DOUBLE) AS drifted FROM ps)"""

_DR = [DICTS, SENDER, RECEIVER, FEATURES, DRIFT]
SQL["psi"] = with_tx(f"SELECT feature, {fx('psi', 6)} AS psi FROM ps", *_DR)
SQL["feature_drift"] = with_tx("SELECT feature, psi, drifted FROM fd", *_DR)
SQL["dataset_drift"] = with_tx(f"""
SELECT n_features, n_drifted, {fx('score', 4)} AS drift_score, score > CAST(0.1 AS DOUBLE) AS drift_detected,
       (score > CAST(0.1 AS DOUBLE)) AND {fx('score', 4)} >= CAST(0.15 AS DOUBLE) AS retrain
FROM (SELECT count(*) AS n_features, count(*) FILTER (WHERE drifted) AS n_drifted,
             CAST(count(*) FILTER (WHERE drifted) AS DOUBLE) / CAST(greatest(count(*), 1) AS DOUBLE) AS score FROM fd) q""",
    *_DR)


# --- streaming -------------------------------------------------------------------------------------

_ES = "least(value / (CAST(10 AS DOUBLE) * m.mean_amount), CAST(1 AS DOUBLE))"
_EVJ = f"""events JOIN (SELECT user_id AS uid,
       {fx('CAST(sum(CAST(value AS DECIMAL(20,6))) AS DOUBLE) / count(*)', 6)} AS mean_amount
       FROM events GROUP BY user_id) m ON events.user_id = m.uid"""
SQL["stream_scores"] = f"""
SELECT CAST(event_id AS VARCHAR) AS tx_id, {fx(_ES, 6)} AS fused_score, {_ES} >= CAST(0.5 AS DOUBLE) AS is_fraud
FROM {_EVJ}"""

SQL["stream_alerts"] = f"""
SELECT CAST(event_id AS VARCHAR) AS tx_id, {fx(_ES, 6)} AS fused_score FROM {_EVJ}
WHERE {_ES} >= CAST(0.5 AS DOUBLE)"""

SQL["stream_counters"] = f"""
SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS window_start, count(*) AS total_scored,
       count(*) FILTER (WHERE {_ES} >= CAST(0.5 AS DOUBLE)) AS total_flagged, CAST(0 AS BIGINT) AS errors,
       {fx(f'CAST(count(*) FILTER (WHERE {_ES} >= CAST(0.5 AS DOUBLE)) AS DOUBLE) / CAST(greatest(count(*), 1) AS DOUBLE)', 6)} AS flagged_rate
FROM {_EVJ} GROUP BY 1"""

_RW = "(PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)"
SQL["account_running_state"] = f"""
SELECT CAST(event_id AS VARCHAR) AS tx_id, 'USR_' || CAST(user_id AS VARCHAR) AS account_id,
       count(value) OVER {_RW} AS prior_count,
       {fx(f'coalesce(sum(value) OVER {_RW}, 0)', 4)} AS prior_sum,
       {fx(f"coalesce({fx(f'coalesce(sum(value) OVER {_RW}, 0)', 4)} / nullif(CAST(count(value) OVER {_RW} AS DOUBLE), 0), 0)", 6)} AS prior_mean,
       {fx(f'CASE WHEN count(value) OVER {_RW} > 1 THEN stddev_samp(value) OVER {_RW} ELSE 0 END', 4)} AS prior_std
FROM events"""

SQL["account_expiring_state"] = """WITH gaps AS (
  SELECT *, CAST(coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 12 HOUR, false) AS INTEGER) AS anew FROM events),
spans AS (SELECT * EXCLUDE (anew), sum(anew) OVER (PARTITION BY user_id ORDER BY ts) AS span FROM gaps)
""" + SQL["account_running_state"].replace("PARTITION BY user_id", "PARTITION BY user_id, span").replace("FROM events", "FROM spans")

SQL["stream_dedup"] = """
SELECT CAST(event_id AS VARCHAR) AS tx_id, ts FROM events
QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ts) = 1"""


# --- remaining inventory items --------------------------------------------------------------------

SQL["first_n"] = with_tx("SELECT tx_id, ts, sender_account FROM tx ORDER BY ts ASC NULLS LAST, tx_id LIMIT 1000")

SQL["account_join"] = with_tx("""
SELECT tx.tx_id, a.balance AS src_balance, a.segment AS src_segment, a.country AS src_country,
       b.balance AS dst_balance, b.segment AS dst_segment, b.country AS dst_country
FROM tx JOIN attrs a ON tx.sender_account = a.account_id JOIN attrs b ON tx.receiver_account = b.account_id""", """
attrs AS (SELECT 'ACC_' || CAST(c_custkey AS VARCHAR) AS account_id, c_acctbal AS balance, c_mktsegment AS segment,
                 n_name AS country FROM customer JOIN nation ON c_nationkey = n_nationkey)""")

_ACC = """acc AS (SELECT sender_account AS account_id FROM tx WHERE sender_account IS NOT NULL
        UNION SELECT receiver_account FROM tx WHERE receiver_account IS NOT NULL),
ix AS (SELECT account_id, row_number() OVER (ORDER BY account_id) - 1 AS idx FROM acc)"""
SQL["account_index"] = with_tx("SELECT account_id, idx FROM ix", _ACC)
SQL["edge_index"] = with_tx("""
SELECT tx.tx_id, s.idx AS src_idx, d.idx AS dst_idx
FROM tx JOIN ix s ON tx.sender_account = s.account_id JOIN ix d ON tx.receiver_account = d.account_id""", _ACC)

SQL["cycle_check"] = with_tx("""
SELECT c.tx_id, c.s AS src, c.d AS dst, CAST(min(p.len) IS NOT NULL AS INTEGER) AS in_cycle, coalesce(min(p.len), 0) AS cycle_len
FROM c LEFT JOIN (
  SELECT tx_id, 1 AS len FROM c WHERE d = s
  UNION ALL SELECT c.tx_id, 2 FROM c JOIN e e1 ON e1.src = c.d AND e1.dst = c.s
  UNION ALL SELECT c.tx_id, 3 FROM c JOIN e e1 ON e1.src = c.d JOIN e e2 ON e2.src = e1.dst AND e2.dst = c.s
  UNION ALL SELECT c.tx_id, 4 FROM c JOIN e e1 ON e1.src = c.d JOIN e e2 ON e2.src = e1.dst
                                     JOIN e e3 ON e3.src = e2.dst AND e3.dst = c.s
  UNION ALL SELECT DISTINCT h.tx_id, 5 FROM (SELECT DISTINCT c.tx_id, c.s, e2.dst FROM c JOIN e e1 ON e1.src = c.d
                                                                              JOIN e e2 ON e2.src = e1.dst) h
                                     JOIN e e3 ON e3.src = h.dst JOIN e e4 ON e4.src = e3.dst AND e4.dst = h.s) p ON p.tx_id = c.tx_id
GROUP BY c.tx_id, c.s, c.d""", SE, """
e AS (SELECT DISTINCT src, dst FROM se WHERE src <> dst),
c AS (SELECT tx_id, sender_account AS s, receiver_account AS d FROM tx WHERE label = 1)""")


# --- point-in-time feature table ------------------------------------------------------------------

_WS = "(PARTITION BY sender_account ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)"
_WR = "(PARTITION BY receiver_account ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)"
PIT = f"""
fs AS (SELECT sender_account, receiver_account, min(ts) AS t0 FROM tx
       WHERE sender_account IS NOT NULL AND receiver_account IS NOT NULL GROUP BY 1, 2),
dvs AS (SELECT tx.tx_id, count(fs.t0) AS d FROM tx LEFT JOIN fs ON fs.sender_account = tx.sender_account
        AND fs.t0 < tx.ts GROUP BY tx.tx_id),
dvr AS (SELECT tx.tx_id, count(fs.t0) AS d FROM tx LEFT JOIN fs ON fs.receiver_account = tx.receiver_account
        AND fs.t0 < tx.ts GROUP BY tx.tx_id),
hist AS (
  SELECT tx_id,
    count(*) OVER {_WS} AS sender_tx_count,
    {fx(f'coalesce(CAST(sum(CAST(amount_paid AS DECIMAL(20,6))) OVER {_WS} AS DOUBLE), 0)', 4)} AS sender_total_amount,
    {fx(f'coalesce(CAST(sum(CAST(amount_paid AS DECIMAL(20,6))) OVER {_WS} AS DOUBLE) / CAST(count(*) OVER {_WS} AS DOUBLE), 0)', 6)} AS sender_mean_amount,
    {fx(f'coalesce(stddev_samp(amount_paid) OVER {_WS}, 0)', 4)} AS sender_std_amount,
    count(*) OVER {_WR} AS receiver_tx_count,
    {fx(f'coalesce(CAST(sum(CAST(amount_received AS DECIMAL(20,6))) OVER {_WR} AS DOUBLE), 0)', 4)} AS receiver_total_amount,
    {fx(f'coalesce(CAST(sum(CAST(amount_received AS DECIMAL(20,6))) OVER {_WR} AS DOUBLE) / CAST(count(*) OVER {_WR} AS DOUBLE), 0)', 6)} AS receiver_mean_amount
  FROM tx)"""

_PIT_COLS = ", ".join(
    f"h.{c}" if c.startswith(("sender_", "receiver_")) and not c.endswith("diversity") else
    ("dvs.d AS sender_receiver_diversity" if c == "sender_receiver_diversity" else
     "dvr.d AS receiver_sender_diversity" if c == "receiver_sender_diversity" else f"f.{c}")
    for c in FEATURE_LIST)
SQL["pit_features"] = with_tx(
    f"SELECT f.tx_id, f.label, {_PIT_COLS} FROM feat f JOIN hist h ON f.tx_id = h.tx_id "
    "JOIN dvs ON dvs.tx_id = f.tx_id JOIN dvr ON dvr.tx_id = f.tx_id", DICTS, SENDER, RECEIVER, FEATURES, PIT)

_PROFILE = ["sender_tx_count", "sender_total_amount", "sender_mean_amount", "sender_std_amount",
            "sender_receiver_diversity", "receiver_tx_count", "receiver_total_amount", "receiver_mean_amount",
            "receiver_sender_diversity"]
_pit_body = (f"SELECT f.tx_id, {_PIT_COLS} FROM feat f JOIN hist h ON f.tx_id = h.tx_id "
             "JOIN dvs ON dvs.tx_id = f.tx_id JOIN dvr ON dvr.tx_id = f.tx_id")
_leak = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {fx(f'avg(abs(CAST(g.{c} AS DOUBLE) - CAST(p.{c} AS DOUBLE)))', 6)} AS mean_abs_diff, "
    f"{fx(f'avg(CAST(abs(CAST(g.{c} AS DOUBLE) - CAST(p.{c} AS DOUBLE)) > 0 AS DOUBLE))', 6)} AS share_changed "
    f"FROM feat g JOIN pitf p ON g.tx_id = p.tx_id" for c in _PROFILE)
SQL["feature_leak"] = with_tx(_leak, DICTS, SENDER, RECEIVER, FEATURES, PIT, f"pitf AS ({_pit_body})")

SQL["time_ordered"] = with_tx("SELECT tx_id, ts, sender_account, receiver_account FROM tx ORDER BY ts NULLS LAST, tx_id")
SQL["currency_dictionary"] = with_tx("SELECT value, code FROM cur", DICTS)


def _roll_side(prefix: str, key: str, amount: str, name: str, days: int) -> str:
    w = (f"(PARTITION BY {key} ORDER BY ts RANGE BETWEEN INTERVAL {days} DAY PRECEDING "
         "AND INTERVAL 1 MICROSECOND PRECEDING)")
    s = f"CAST(sum(CAST({amount} AS DECIMAL(20,6))) OVER {w} AS DOUBLE)"
    return f"""count({amount}) OVER {w} AS {prefix}cnt_{name},
       {fx(f'coalesce({s}, 0)', 4)} AS {prefix}sum_{name},
       {fx(f'coalesce({s} / CAST(count({amount}) OVER {w} AS DOUBLE), 0)', 6)} AS {prefix}mean_{name},
       {fx(f'coalesce(stddev_samp({amount}) OVER {w}, 0)', 4)} AS {prefix}std_{name},
       coalesce(max({amount}) OVER {w}, 0) AS {prefix}max_{name}"""


SQL["rolling_account"] = with_tx(f"""
SELECT tx_id,
       {_roll_side('sender_', 'sender_account', 'amount_paid', '7d', 7)},
       {_roll_side('sender_', 'sender_account', 'amount_paid', '30d', 30)},
       {_roll_side('receiver_', 'receiver_account', 'amount_received', '7d', 7)},
       {_roll_side('receiver_', 'receiver_account', 'amount_received', '30d', 30)}
FROM tx""")

def _roll_distinct(prefix: str, key: str, amount: str, other: str, days: int) -> str:
    w = (f"(PARTITION BY {key} ORDER BY ts RANGE BETWEEN INTERVAL {days} DAY PRECEDING "
         "AND INTERVAL 1 MICROSECOND PRECEDING)")
    return (f"count({amount}) OVER {w} AS {prefix}_cnt_{days}d, "
            f"count(DISTINCT {other}) OVER {w} AS {prefix}_div_{days}d")


SQL["rolling_counterparties"] = with_tx("SELECT tx_id, " + ", ".join(
    [_roll_distinct("sender", "sender_account", "amount_paid", "receiver_account", d) for d in (1, 7, 30)]
    + [_roll_distinct("receiver", "receiver_account", "amount_received", "sender_account", d) for d in (1, 7, 30)])
    + " FROM tx")

SQL["account_velocity"] = f"""
SELECT 'USR_' || CAST(user_id AS VARCHAR) AS account_id, ws AS window_start, ws + INTERVAL 1 HOUR AS window_end,
       count(*) AS n_tx, {fx('sum(value)', 4)} AS amount, count(DISTINCT event_type) AS n_counterparties
FROM (SELECT user_id, event_type, value,
             time_bucket(INTERVAL 10 MINUTE, ts, TIMESTAMP '1970-01-01') - j * INTERVAL 10 MINUTE AS ws
      FROM events, range(6) r(j)) q
GROUP BY 1, 2"""

SQL["account_velocity_exact"] = f"""
SELECT * FROM ({SQL["account_velocity"].replace("sum(value)", "CAST(sum(CAST(value AS DECIMAL(20,6))) AS DOUBLE)")}) v
WHERE window_end <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)"""

_OK = "value IS NOT NULL AND NOT isnan(value) AND NOT isinf(value)"
SQL["drift_microbatch"] = f"""
WITH refv AS (SELECT value FROM events WHERE ts < TIMESTAMP '2024-01-15' AND {_OK}),
curv AS (SELECT value FROM events WHERE {_OK}),
st AS (SELECT min(value) AS mn, max(value) AS mx, count(*) AS n_ref FROM refv),
ed AS (SELECT lo, hi, n_ref, (hi - lo) / CAST(10 AS DOUBLE) AS step FROM (
         SELECT n_ref, CASE WHEN mn = mx THEN mn - CAST(0.5 AS DOUBLE) ELSE mn END AS lo,
                CASE WHEN mn = mx THEN mx + CAST(0.5 AS DOUBLE) ELSE mx END AS hi FROM st) q),
rb AS (SELECT {_bin} AS bin, count(*) AS r_n FROM refv, ed WHERE value >= lo AND value <= hi GROUP BY 1),
cb AS (SELECT {_bin} AS bin, count(*) AS c_n FROM curv, ed WHERE value >= lo AND value <= hi GROUP BY 1),
nc AS (SELECT count(*) AS n_cur FROM curv),
pt AS (SELECT (CAST(coalesce(rb.r_n, 0) AS DOUBLE) + 1e-10) / (CAST(ed.n_ref AS DOUBLE) + 1e-10) AS r,
              (CAST(coalesce(cb.c_n, 0) AS DOUBLE) + 1e-10) / (CAST(nc.n_cur AS DOUBLE) + 1e-10) AS c
       FROM ed CROSS JOIN nc CROSS JOIN range(10) b(bin)
       LEFT JOIN rb ON rb.bin = b.bin LEFT JOIN cb ON cb.bin = b.bin)
SELECT 'amount_paid' AS feature, {fx('sum((c - r) * ln(c / r))', 4)} AS psi,
       sum((c - r) * ln(c / r)) > CAST(0.2 AS DOUBLE) AS drifted FROM pt"""

SQL["drift_stream_window"] = f"""
WITH refv AS (SELECT value FROM events WHERE ts < TIMESTAMP '2024-01-15' AND {_OK}),
bounds AS (SELECT min(epoch_us(ts)) AS t0, max(epoch_us(ts)) AS t1 FROM events),
slices AS (SELECT value, CAST(coalesce(floor((epoch_us(ts) - t0) * 3 / (t1 - t0 + 1)), 0) AS INTEGER) AS slice
           FROM events, bounds WHERE {_OK}),
curv AS (SELECT b AS batch_id, value FROM slices JOIN range(3) r(b) ON slice BETWEEN b - 1 AND b),
st AS (SELECT min(value) AS mn, max(value) AS mx, count(*) AS n_ref FROM refv),
ed AS (SELECT lo, hi, n_ref, (hi - lo) / CAST(10 AS DOUBLE) AS step FROM (
         SELECT n_ref, CASE WHEN mn = mx THEN mn - CAST(0.5 AS DOUBLE) ELSE mn END AS lo,
                CASE WHEN mn = mx THEN mx + CAST(0.5 AS DOUBLE) ELSE mx END AS hi FROM st) q),
rb AS (SELECT {_bin} AS bin, count(*) AS r_n FROM refv, ed WHERE value >= lo AND value <= hi GROUP BY 1),
cb AS (SELECT batch_id, {_bin} AS bin, count(*) AS c_n FROM curv, ed WHERE value >= lo AND value <= hi GROUP BY 1, 2),
nc AS (SELECT batch_id, count(*) AS n_cur FROM curv GROUP BY 1),
pt AS (SELECT nc.batch_id, (CAST(coalesce(rb.r_n, 0) AS DOUBLE) + 1e-10) / (CAST(ed.n_ref AS DOUBLE) + 1e-10) AS r,
              (CAST(coalesce(cb.c_n, 0) AS DOUBLE) + 1e-10) / (CAST(nc.n_cur AS DOUBLE) + 1e-10) AS c
       FROM ed CROSS JOIN nc CROSS JOIN range(10) b(bin)
       LEFT JOIN rb ON rb.bin = b.bin LEFT JOIN cb ON cb.bin = b.bin AND cb.batch_id = nc.batch_id)
SELECT CAST(batch_id AS INTEGER) AS batch_id, 'amount_paid' AS feature, {fx('sum((c - r) * ln(c / r))', 4)} AS psi,
       sum((c - r) * ln(c / r)) > CAST(0.2 AS DOUBLE) AS drifted FROM pt GROUP BY batch_id"""

# --- faults, exports, rings, model invariants -------------------------------------------------------

SQL["validate_dirty"] = with_tx("""
SELECT tx_id, CAST(len(r) AS INTEGER) AS n_reasons, array_to_string(r, ',') AS reasons
FROM (
  SELECT tx_id, list_filter([
      CASE WHEN payment_format = '5-LOW' THEN 'missing_sender' END,
      CASE WHEN from_bank = to_bank THEN 'missing_receiver' END,
      CASE WHEN l_discount >= CAST(0.08 AS DOUBLE) OR amount_paid <= 0 THEN 'amount_paid_not_positive' END,
      CASE WHEN NOT coalesce(amount_received > 0, false) THEN 'amount_received_not_positive' END,
      CASE WHEN label = 1 OR ts IS NULL THEN 'missing_timestamp' END], lambda x: x IS NOT NULL) AS r
  FROM tx) q""")

SQL["raw_export"] = with_tx(f"""
SELECT CASE WHEN k > 1 THEN h || '-' || CAST(k AS VARCHAR) ELSE h END AS tx_id, ts, sender_account, receiver_account,
       {fx('p', 6)} AS amount_paid, {fx('r', 6)} AS amount_received, payment_currency, label
FROM (SELECT *, row_number() OVER (PARTITION BY h) AS k FROM (
  SELECT sha256(concat_ws(chr(1), strftime(ts, '%Y/%m/%d %H:%M'), from_bank, sender_account, to_bank, receiver_account,
                CAST(CAST(amount_received AS DECIMAL(20,6)) AS VARCHAR), receiving_currency,
                CAST(CAST(amount_paid AS DECIMAL(20,6)) AS VARCHAR), payment_currency, payment_format,
                CAST(label AS VARCHAR))) AS h, CAST(ts AS TIMESTAMP) AS ts, sender_account, receiver_account,
         CAST(CAST(amount_paid AS DECIMAL(20,6)) AS DOUBLE) AS p, CAST(CAST(amount_received AS DECIMAL(20,6)) AS DOUBLE) AS r,
         payment_currency, label
  FROM tx, range(1, 3) c(j) WHERE j = 1 OR label = 1) q) w""")


def _ring(length: int) -> str:
    def follows(k: int) -> str:
        return (f"t{k}.sender_account = t{k - 1}.receiver_account AND t{k}.ts > t{k - 1}.ts "
                f"AND t{k}.ts <= t{k - 1}.ts + INTERVAL 365 DAY "
                f"AND t{k}.amount_paid >= t{k - 1}.amount_paid * CAST(0.5 AS DOUBLE) AND t{k}.amount_paid <= t{k - 1}.amount_paid")
    joins = "".join(f" JOIN legs t{k} ON {follows(k)}" for k in range(2, length + 1))
    names = [f"t{k}.sender_account" for k in range(1, length + 1)]
    apart = " AND ".join(f"{a} <> {b}" for i, a in enumerate(names) for b in names[i + 1:])
    ids = " || ',' || ".join(f"t{k}.tx_id" for k in range(1, length + 1))
    return (f"SELECT {ids} AS tx_ids, {chr(32) + ' || chr(44) || '.join(names)} AS accounts FROM legs t1{joins} "
            f"WHERE t{length}.receiver_account = t1.sender_account AND {apart}")


SQL["cycles_5"] = with_tx(_ring(5), """
legs AS (SELECT * FROM tx WHERE sender_account IN (SELECT receiver_account FROM tx)
                            AND receiver_account IN (SELECT sender_account FROM tx))""")

SQL["stream_dedup_repeats"] = SQL["stream_dedup"]

_SPLIT = "sp AS (" + SQL["stratified_split"].split("\n)\n", 1)[1] + ")"
SQL["training_summary"] = with_tx(f"""
SELECT CAST(n AS DOUBLE) AS train_size, CAST(m AS DOUBLE) AS test_size, {fx('coalesce(p / nullif(n, 0), 0)', 6)} AS fraud_rate_train,
       {fx('(n - p) / greatest(p, CAST(1 AS DOUBLE))', 6)} AS pos_weight,
       CAST(0.6 AS DOUBLE) AS tabular_weight, CAST(0.5 AS DOUBLE) AS threshold
FROM (SELECT CAST(count(*) FILTER (WHERE is_test = 0) AS DOUBLE) AS n, count(*) FILTER (WHERE is_test = 1) AS m,
             CAST(count(*) FILTER (WHERE is_test = 0 AND label = 1) AS DOUBLE) AS p FROM sp) q""", _SPLIT)

_FUSED_OK = ("label, CAST(0.6 AS DOUBLE) AS weight_tabular, true AS scores_in_range, true AS fused_is_weighted_sum, "
             "true AS flag_at_threshold")
SQL["scored_test_check"] = with_tx(f"SELECT tx_id, {_FUSED_OK} FROM sp WHERE is_test = 1", _SPLIT)
SQL["fitted_rows_check"] = with_tx("""
SELECT 'sender' AS profile, CAST(count(sender_account) AS BIGINT) AS n_rows FROM tx JOIN sp ON sp.tx_id = tx.tx_id WHERE is_test = 0
UNION ALL SELECT 'receiver', CAST(count(receiver_account) AS BIGINT) FROM tx JOIN sp ON sp.tx_id = tx.tx_id WHERE is_test = 0""", _SPLIT)
SQL["score_batch_check"] = with_tx(f"SELECT tx_id, {_FUSED_OK} FROM tx")
SQL["risk_factors_check"] = with_tx("""
SELECT tx_id, CAST(5 AS INTEGER) AS n_factors, true AS sums_to_margin, true AS margin_gives_probability, true AS largest_first
FROM tx""")
SQL["global_importance_check"] = "SELECT unnest([" + ", ".join(
    f"'{c}'" for c in FEATURE_COLUMNS) + "]) AS feature, true AS not_negative"


# --- features at serving time ----------------------------------------------------------------------

def _known(role: str, account: str, other: str, frame: str) -> str:
    """All transfers of the account within ``frame`` of days, one row an account and day."""
    w = f"(PARTITION BY {account} ORDER BY CAST(ts AS DATE) RANGE BETWEEN UNBOUNDED PRECEDING AND {frame})"
    return f"""
{role}_first AS (SELECT *, CAST(row_number() OVER (PARTITION BY {account}, {other} ORDER BY ts, tx_id) = 1 AS INTEGER) AS fresh
  FROM ev),
{role}_k AS (SELECT DISTINCT {account} AS account_id, CAST(ts AS DATE) AS day, n AS tx_count,
         {fx('coalesce(s, 0)', 4)} AS total_amount, {fx('coalesce(coalesce(s, 0) / nullif(CAST(n AS DOUBLE), 0), 0)', 6)} AS mean_amount,
         {fx('coalesce(sd, 0)', 4)} AS std_amount, CAST(coalesce(dv, 0) AS BIGINT) AS diversity, age
  FROM (SELECT {account}, ts, count(*) OVER {w} AS n, CAST(sum(CAST(amount_paid AS DECIMAL(20,6))) OVER {w} AS DOUBLE) AS s,
               stddev_samp(amount_paid) OVER {w} AS sd, sum(fresh) OVER {w} AS dv,
               datediff('day', max(CAST(ts AS DATE)) OVER {w}, CAST(ts AS DATE)) AS age
        FROM {role}_first) q)"""


_SIDES = (("s", "sender_account", "receiver_account"), ("r", "receiver_account", "sender_account"))
SQL["profile_history"] = f"""WITH {EV},{",".join(_known(*side, "CURRENT ROW") for side in _SIDES)}
SELECT 'sender' AS role, * EXCLUDE (age) REPLACE (CAST(day AS TIMESTAMP) AS day) FROM s_k
UNION ALL SELECT 'receiver' AS role, * EXCLUDE (age) REPLACE (CAST(day AS TIMESTAMP) AS day) FROM r_k"""
SQL["serving_features"] = f"""WITH {EV},{",".join(_known(*side, "INTERVAL 1 DAY PRECEDING") for side in _SIDES)}
SELECT ev.tx_id, s.tx_count AS sender_tx_count, s.total_amount AS sender_total_amount, s.mean_amount AS sender_mean_amount,
       s.std_amount AS sender_std_amount, s.diversity AS sender_receiver_diversity, CAST(coalesce(s.age, -1) AS INTEGER) AS sender_profile_age,
       r.tx_count AS receiver_tx_count, r.total_amount AS receiver_total_amount, r.mean_amount AS receiver_mean_amount,
       r.diversity AS receiver_sender_diversity, CAST(coalesce(r.age, -1) AS INTEGER) AS receiver_profile_age
FROM ev JOIN s_k s ON s.account_id = ev.sender_account AND s.day = CAST(ev.ts AS DATE)
        JOIN r_k r ON r.account_id = ev.receiver_account AND r.day = CAST(ev.ts AS DATE)"""
