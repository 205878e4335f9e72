-- table: stg_orders
-- hint: a clock of the source is ahead, or times were read in another zone
SELECT cast(order_id AS string) AS sample_key
FROM {stg_orders}
WHERE created_at > :as_of
GROUP BY order_id
