-- table: stg_order_status_history
-- hint: steps were recorded out of order; durations of the funnel are negative
SELECT cast(order_id AS string) AS sample_key
FROM {stg_order_status_history}
GROUP BY order_id
HAVING min(CASE WHEN status = 'shipped' THEN changed_at END) < min(CASE WHEN status = 'paid' THEN changed_at END)
