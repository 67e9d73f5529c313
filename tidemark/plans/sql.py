"""SQL shared by the oracles: the adapter tables and the derived order tables, as common table expressions for DuckDB."""

from __future__ import annotations


def _choose(index: str, *values: str) -> str:
    return f"list_extract([{', '.join(repr(v) for v in values)}], ({index} % {len(values)})::INTEGER + 1)"


_COORDINATES = "event_id AS raw_id, '{topic}' AS kafka_topic, 0 AS kafka_partition, event_id AS kafka_offset, ts AS kafka_load_dttm, user_id::VARCHAR || '-' || (k % 10)::VARCHAR AS order_id"
_ORDER = "kafka_load_dttm {d}, kafka_partition {d}, kafka_offset {d}, raw_id {d}"
_NEWEST, _OLDEST = _ORDER.format(d="DESC"), _ORDER.format(d="ASC")
_CURRENCY = _choose("event_id", "RUB", "USD", "EUR")

#: name -> (SQL, names that it reads)
PARTS: dict[str, tuple[str, tuple[str, ...]]] = {
    "ev": ("SELECT event_id, ts, user_id, value, event_type, json_extract_string(props, '$.k')::INTEGER AS k FROM events", ()),
    "created": (f"SELECT {_COORDINATES.format(topic='ecommerce.order_created.v2')}, user_id::VARCHAR AS customer_id, value::DECIMAL(12,2) AS amount, {_CURRENCY} AS currency, ts AS created_at, CASE WHEN k % 2 = 0 THEN 'web' ELSE 'mobile' END AS source_channel FROM ev WHERE event_type = 'signup'", ("ev",)),
    "paid": (f"SELECT {_COORDINATES.format(topic='ecommerce.order_paid.v1')}, event_id::VARCHAR AS payment_id, value::DECIMAL(12,2) AS paid_amount, {_CURRENCY} AS currency, ts AS paid_at FROM ev WHERE event_type = 'purchase'", ("ev",)),
    "cancelled": (f"SELECT {_COORDINATES.format(topic='ecommerce.order_cancelled.v1')}, event_id::VARCHAR AS cancellation_id, {_choose('event_id', 'customer_request', 'payment_failed', 'out_of_stock', 'fraud_rejected')} AS cancellation_reason, ts AS cancelled_at FROM ev WHERE event_type = 'error'", ("ev",)),
    "dead": (f"SELECT event_id AS id, 'ecommerce.' || {_choose('event_id', 'order_created', 'order_paid', 'order_cancelled')} || '.v1' AS kafka_topic, 0 AS kafka_partition, event_id AS kafka_offset, {_choose('event_id', 'order_created', 'order_paid', 'order_cancelled')} AS contract_name, 1 AS contract_version, 'Field ''f' || (k % 7)::VARCHAR || ''' is required' AS error_message, ts AS load_dttm FROM ev WHERE event_type = 'view'", ("ev",)),
    "runs": (f"SELECT event_id::VARCHAR AS run_id, {_choose('k', 'manual', 'scheduled', 'ci', 'airflow')} AS trigger_type, CASE WHEN k % 13 = 0 THEN 'running' WHEN k % 11 = 0 THEN 'error' WHEN k % 7 = 0 THEN 'warning' ELSE 'success' END AS status, ts AS started_at, CASE WHEN k % 13 <> 0 THEN ts + INTERVAL 90 SECOND END AS finished_at, value AS duration_seconds, CASE WHEN k % 17 = 0 THEN 'warn' ELSE 'pass' END AS freshness_status, CASE WHEN k % 11 = 0 THEN 'error' ELSE 'success' END AS build_status FROM ev WHERE event_type = 'click'", ("ev",)),
    "first_created": (f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY created_at ASC, {_OLDEST}) AS rn, count(*) OVER (PARTITION BY order_id) AS cnt, max(raw_id) OVER (PARTITION BY order_id) AS max_raw_id FROM created) WHERE rn = 1", ("created",)),
    "last_paid": (
        f"SELECT * FROM (SELECT p.*, row_number() OVER (PARTITION BY p.order_id ORDER BY p.paid_at DESC, {', '.join('p.' + c for c in _NEWEST.split(', '))}) AS rn, count(*) OVER w AS cnt, max(p.raw_id) OVER w AS max_raw_id, bool_or(p.paid_amount <> c.amount) OVER w AS f_amount, bool_or(p.currency <> c.currency) OVER w AS f_currency, bool_or(p.paid_at < c.created_at) OVER w AS f_early FROM paid p JOIN first_created c ON p.order_id = c.order_id WINDOW w AS (PARTITION BY p.order_id)) WHERE rn = 1",
        ("paid", "first_created"),
    ),
    "last_cancelled": (
        f"SELECT * FROM (SELECT x.*, row_number() OVER (PARTITION BY x.order_id ORDER BY x.cancelled_at DESC, {', '.join('x.' + c for c in _NEWEST.split(', '))}) AS rn, count(*) OVER w AS cnt, max(x.raw_id) OVER w AS max_raw_id, min(x.cancelled_at) OVER w AS first_at, bool_or(x.cancelled_at < c.created_at) OVER w AS f_early FROM cancelled x JOIN first_created c ON x.order_id = c.order_id WINDOW w AS (PARTITION BY x.order_id)) WHERE rn = 1",
        ("cancelled", "first_created"),
    ),
    "orders_all": (
        """SELECT c.order_id, c.customer_id, c.source_channel, c.amount AS order_amount, c.currency, c.created_at,
          CASE WHEN x.cancellation_id IS NOT NULL THEN 'cancelled' WHEN p.payment_id IS NOT NULL THEN 'paid' ELSE 'created' END AS status,
          p.payment_id, p.paid_amount, p.currency AS payment_currency, p.paid_at, x.cancellation_id, x.cancellation_reason, x.cancelled_at,
          coalesce(p.cnt, 0)::INTEGER AS payments_cnt, coalesce(x.cnt, 0)::INTEGER AS cancellations_cnt, (c.cnt - 1)::INTEGER AS duplicate_created_events_cnt,
          coalesce(p.cnt, 0) > 1 AS dq_multiple_payments_flg, coalesce(x.cnt, 0) > 1 AS dq_multiple_cancellations_flg,
          coalesce(p.f_amount, false) AS dq_payment_amount_mismatch_flg, coalesce(p.f_currency, false) AS dq_payment_currency_mismatch_flg,
          coalesce(p.f_early, false) AS dq_payment_before_creation_flg, coalesce(x.f_early, false) AS dq_cancellation_before_creation_flg,
          coalesce(p.paid_at > x.first_at, false) AS dq_payment_after_cancellation_flg,
          c.max_raw_id AS max_created_raw_id, coalesce(p.max_raw_id, 0) AS max_paid_raw_id, coalesce(x.max_raw_id, 0) AS max_cancelled_raw_id
        FROM first_created c LEFT JOIN last_paid p ON c.order_id = p.order_id LEFT JOIN last_cancelled x ON c.order_id = x.order_id""",
        ("first_created", "last_paid", "last_cancelled"),
    ),
    "orders_dq": ("SELECT *, (duplicate_created_events_cnt > 0 OR dq_multiple_payments_flg OR dq_multiple_cancellations_flg OR dq_payment_amount_mismatch_flg OR dq_payment_currency_mismatch_flg OR dq_payment_before_creation_flg OR dq_cancellation_before_creation_flg OR dq_payment_after_cancellation_flg) AS dq FROM orders_all", ("orders_all",)),
    "mart": (
        "SELECT created_at::DATE AS order_dt, count(*)::INTEGER AS created_orders_cnt, count(*) FILTER (WHERE status = 'paid')::INTEGER AS paid_orders_cnt, count(*) FILTER (WHERE status = 'cancelled')::INTEGER AS cancelled_orders_cnt, count(*) FILTER (WHERE status = 'created')::INTEGER AS created_status_orders_cnt, coalesce(sum(order_amount), 0)::DECIMAL(14,2) AS gross_order_amount, coalesce(sum(paid_amount) FILTER (WHERE status = 'paid'), 0)::DECIMAL(14,2) AS paid_revenue, count(*) FILTER (WHERE dq)::INTEGER AS orders_with_dq_cnt FROM orders_dq GROUP BY 1",
        ("orders_dq",),
    ),
    "lifecycle": ("SELECT order_id, 'created' AS event_type, created_at AS event_at, raw_id, kafka_load_dttm FROM created UNION ALL SELECT order_id, 'paid', paid_at, raw_id, kafka_load_dttm FROM paid UNION ALL SELECT order_id, 'cancelled', cancelled_at, raw_id, kafka_load_dttm FROM cancelled", ("created", "paid", "cancelled")),
    "orphan": ("SELECT order_id, (count(*) FILTER (WHERE event_type = 'paid'))::INTEGER AS payments_cnt, (count(*) FILTER (WHERE event_type = 'cancelled'))::INTEGER AS cancellations_cnt, min(event_at) AS first_event_at, max(event_at) AS last_event_at FROM lifecycle l WHERE event_type <> 'created' AND NOT EXISTS (SELECT 1 FROM created c WHERE c.order_id = l.order_id) GROUP BY order_id", ("lifecycle", "created")),
}


def oracle(body: str, *reads: str, **more: tuple[str, tuple[str, ...]]) -> str:
    """``body`` under the parts that it reads, directly or not, in the order of PARTS and then of ``more``."""
    parts = PARTS | more
    need: set[str] = set()

    def add(name: str) -> None:
        if name not in need:
            need.add(name)
            for n in parts[name][1]:
                add(n)

    for name in (*reads, *more):
        add(name)
    made = ",\n".join(f"{n} AS ({q})" for n, (q, _) in parts.items() if n in need)
    return f"WITH {made}\n{body}" if made else body
