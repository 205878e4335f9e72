"""The five change feeds, from one text: what arrives, how it is typed, and what identifies a row."""

from __future__ import annotations

from typing import NamedTuple

OPS = ("c", "u", "d", "r")

# Columns of Kafka's reader, topic prefix, names of tables and columns.
KAFKA = "key binary, value binary, topic string, partition int, offset bigint"
TOPIC_PREFIX = "cdc.public."
LAYOUT = """
orders      stg_orders             order_id=id                       customer_id=id status=text created_at=time updated_at=time
order_items stg_order_items        order_item_id=id                  order_id=id product_id=id quantity=int price_at_order=money
inventory   stg_inventory          product_id=id,warehouse_id=id32   quantity=int updated_at=time
customers   stg_customer_versions  customer_id=id,valid_from=commit  name=text address=text? segment=text?
products    stg_product_versions   product_id=id,valid_from=commit   name=text category=text price=money
"""


class Kind(NamedTuple):
    """How a value is read and judged: SQL over ``{0}``, its place in the message.

    ``wire`` is what JSON is read as, wide enough that a bad value spoils only
    itself; ``value`` what becomes of it; ``good`` when it may stay; ``gap``
    what a delete shows where its image has none.
    """

    wire: str
    value: str
    good: str
    gap: str


_INT = "try_cast({0} AS int)"
_TIME = "try_to_timestamp({0})"
_MONEY = "try_cast({0} AS decimal(10,2))"
KINDS = {
    "id": Kind("bigint", "{0}", "{0} >= 0", "0L"),
    "id32": Kind("bigint", _INT, f"{_INT} >= 0", "0"),
    "int": Kind("bigint", _INT, f"{_INT} IS NOT NULL", "0"),
    "text": Kind("string", "{0}", "{0} IS NOT NULL", "''"),
    "text?": Kind("string", "{0}", "true", "''"),
    "money": Kind("string", _MONEY, f"{_MONEY} IS NOT NULL", "cast(0 AS decimal(10,2))"),
    "time": Kind("string", _TIME, f"{_TIME} IS NOT NULL", "timestamp_seconds(0)"),
}


class Feed:
    """One line of ``LAYOUT``: table, target, what the message key holds, and the columns of its images.

    A feed whose identity has a ``commit`` time is a journal: it keeps every
    change under that time instead of only the newest version of a key.
    """

    def __init__(self, line: str):
        self.table, self.target, key, *columns = line.split()
        identity = dict(part.split("=") for part in key.split(","))
        self.identity = tuple(identity)
        self.commit_time = next((n for n, kind in identity.items() if kind == "commit"), None)
        self.key = {n: KINDS[kind] for n, kind in identity.items() if kind != "commit"}
        self.columns = {n: KINDS[kind] for n, kind in (part.split("=") for part in columns)}
        self.topic = TOPIC_PREFIX + self.table

    def __repr__(self) -> str:
        return f"Feed({self.table})"


FEEDS = tuple(map(Feed, LAYOUT.strip().splitlines()))
ORDERS, ORDER_ITEMS, INVENTORY, CUSTOMERS, PRODUCTS = FEEDS
