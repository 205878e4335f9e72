-- table: stg_order_items
-- hint: the product's topic lags behind, or its rows were set aside:
-- hint: look into the quarantine of stg_product_versions
SELECT DISTINCT concat_ws('/', i.order_item_id, i.product_id) AS sample_key
FROM {stg_order_items} AS i
LEFT ANTI JOIN {stg_product_versions} AS p ON p.product_id = i.product_id
WHERE i.is_deleted = 0
