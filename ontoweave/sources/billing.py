"""Billing objects: identifiers, references and times of raw API rows made uniform."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import field


@dataclass(frozen=True)
class BillingObject:
    name: str
    key: str
    parent: str | None = None
    children: str | None = None


# The objects, their key columns, and the lists embedded in a parent.
OBJECTS = {
    o.name: o
    for o in [
        BillingObject("customers", "customer_id"),
        BillingObject("products", "product_id"),
        BillingObject("prices", "price_id"),
        BillingObject("coupons", "coupon_id"),
        BillingObject("promotion_codes", "promotion_code_id"),
        BillingObject("subscriptions", "subscription_id"),
        BillingObject("subscription_items", "subscription_item_id", "subscription", "items"),
        BillingObject("invoices", "invoice_id"),
        BillingObject("invoice_line_items", "line_item_id", "invoice", "lines"),
        BillingObject("charges", "charge_id"),
        BillingObject("payment_intents", "payment_intent_id"),
        BillingObject("refunds", "refund_id"),
        BillingObject("disputes", "dispute_id"),
        BillingObject("payouts", "payout_id"),
        BillingObject("balance_transactions", "balance_transaction_id"),
    ]
}
# Fields that hold another object's id, and the column each becomes.
REFERENCES = {
    "customer": "customer_id",
    "product": "product_id",
    "price": "price_id",
    "default_price": "price_id",
    "coupon": "coupon_id",
    "promotion_code": "promotion_code_id",
    "subscription": "subscription_id",
    "subscription_item": "subscription_item_id",
    "invoice": "invoice_id",
    "latest_invoice": "invoice_id",
    "charge": "charge_id",
    "latest_charge": "charge_id",
    "payment_intent": "payment_intent_id",
    "refund": "refund_id",
    "payout": "payout_id",
    "balance_transaction": "balance_transaction_id",
    "payment_method": "payment_method_id",
    "default_payment_method": "payment_method_id",
}
# Fields that hold epoch seconds.
EPOCHS = (
    "created arrival_date available_on billing_cycle_anchor cancel_at canceled_at "
    "current_period_end current_period_start due_date effectively_at ended_at expires_at "
    "period_end period_start redeem_by start_date trial_end trial_start webhooks_delivered_at"
).split()
# Which columns of an object refer to other objects.
LINKS = {
    "products": ["price_id"],
    "prices": ["product_id"],
    "promotion_codes": ["coupon_id", "customer_id"],
    "subscriptions": ["customer_id", "invoice_id"],
    "subscription_items": ["subscription_id", "price_id"],
    "invoices": ["customer_id", "subscription_id", "charge_id", "payment_intent_id"],
    "invoice_line_items": ["invoice_id", "price_id", "subscription_id", "subscription_item_id"],
    "charges": ["customer_id", "invoice_id", "payment_intent_id", "balance_transaction_id"],
    "payment_intents": ["customer_id", "invoice_id", "charge_id"],
    "refunds": ["charge_id", "payment_intent_id", "balance_transaction_id"],
    "disputes": ["charge_id", "payment_intent_id"],
    "payouts": ["balance_transaction_id"],
}


def relationships() -> list[tuple[str, str, str, str]]:
    """Declared links as (table, column, referenced table, referenced column)."""
    owner = {o.key: o.name for o in OBJECTS.values()}
    return [(t, c, owner[c], c) for t, columns in LINKS.items() for c in columns]


def _reference(value: Column, kind: T.DataType) -> Column:
    """The id in a reference, whether it came as text or as the nested object."""
    if isinstance(kind, T.StructType):
        return value["id"] if "id" in kind.names else F.lit(None).cast("string")
    if isinstance(kind, T.StringType):
        # A column of mixed shapes is read as text: either the id, or the object as JSON.
        nested = F.get_json_object(value, "$.id")
        return F.when(value.startswith("{"), nested).otherwise(F.nullif(value, F.lit("")))
    return value


def _epoch(value: Column) -> Column:
    return F.date_format(F.timestamp_seconds(value), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def normalize(df: DataFrame, object_name: str) -> DataFrame:
    """One flat table of the object: own key, ``*_id`` references, ISO times."""
    key = OBJECTS[object_name].key
    references = dict(REFERENCES)
    if object_name == "balance_transactions":
        references["source"] = "source_id"
    wanted: dict[str, Column] = {}
    for f in df.schema.fields:
        value, kind = field(f.name), f.dataType
        if f.name == "object":
            continue
        if f.name == "id":
            wanted[key] = value
        elif f.name in references and not isinstance(kind, T.BooleanType):
            target = references[f.name]
            found = _reference(value, kind)
            # Two fields may name one reference (price, default_price): the later one wins
            # where it has a value.
            wanted[target] = F.coalesce(found, wanted[target]) if target in wanted else found
        elif f.name in EPOCHS and isinstance(kind, T.NumericType):
            wanted[f.name] = _epoch(value)
        else:
            wanted[f.name] = value
    if object_name == "invoice_line_items":
        nested = _path(df.schema, "pricing", "price_details", "price")
        fallback = F.col("pricing.price_details.price") if nested else F.lit(None).cast("string")
        own = wanted.get("price_id")
        wanted["price_id"] = fallback if own is None else F.coalesce(own, fallback)
    return df.select(*[c.alias(name) for name, c in wanted.items()])


def _path(kind: T.DataType, *names: str) -> bool:
    for name in names:
        if not isinstance(kind, T.StructType) or name not in kind.names:
            return False
        kind = kind[name].dataType
    return True


def children(parents: DataFrame, object_name: str) -> DataFrame:
    """The rows of a list embedded in each parent, with the parent's id."""
    spec = OBJECTS[object_name]
    if not spec.parent:
        raise ValueError(f"{object_name} is not embedded in another object")
    return parents.select(
        F.col("id").alias(f"{spec.parent}_id"),
        F.explode(field(spec.children)["data"]).alias("child"),
    ).select(f"{spec.parent}_id", "child.*")
