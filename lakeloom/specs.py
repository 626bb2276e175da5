"""Entities as data: columns with their types and rules, keys, required columns, references and domains."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.types import StringType, StructField, StructType


@dataclass(frozen=True)
class ColumnRule:
    """How raw text becomes a typed value: kind is long, int, money, text, lower, date, timestamp or boolean."""

    name: str
    kind: str
    nullable: bool = False


@dataclass(frozen=True)
class ForeignKey:
    """live_parent: whether a soft-deleted parent counts as missing."""

    column: str
    parent: str
    live_parent: bool = True

    @property
    def check_name(self) -> str:
        return f"{self.column}_references_{self.parent}"


@dataclass(frozen=True)
class EntitySpec:
    name: str
    source_table: str
    key: str
    columns: tuple[ColumnRule, ...]
    required: tuple[str, ...]
    references: tuple[ForeignKey, ...] = ()
    domains: tuple[tuple[str, tuple[str, ...]], ...] = ()
    not_negative: tuple[str, ...] = ()

    @property
    def raw_schema(self) -> StructType:
        return StructType([StructField(c.name, StringType()) for c in self.columns])


def _columns(text: str) -> tuple[ColumnRule, ...]:
    made = []
    for part in (text + " created_at:timestamp updated_at:timestamp is_deleted:boolean").split():
        name, kind = part.split(":")
        made.append(ColumnRule(name, kind.rstrip("?"), kind.endswith("?")))
    return tuple(made)


#: Names, types and domains of the source system's tables.
ENTITIES: dict[str, EntitySpec] = {
    e.name: e
    for e in (
        EntitySpec(
            "customers", "dbo.Customers", "customer_id",
            _columns("customer_id:long first_name:text last_name:text email:lower phone:text? city:text country:text segment:text signup_date:date"),
            ("customer_id", "email", "created_at", "updated_at"),
            domains=(("country", ("CO", "MX", "CL", "PE", "AR")), ("segment", ("Regular", "Premium", "Business"))),
        ),
        EntitySpec(
            "products", "dbo.Products", "product_id",
            _columns("product_id:long sku:text product_name:text category:text unit_price:money product_description:text? product_status:lower"),
            ("product_id", "sku", "unit_price", "created_at", "updated_at"),
            domains=(("product_status", ("active", "inactive", "discontinued")),), not_negative=("unit_price",),
        ),
        EntitySpec(
            "orders", "dbo.Orders", "order_id",
            _columns("order_id:long customer_id:long order_date:timestamp sales_channel:lower order_status:lower order_total:money"),
            ("order_id", "customer_id", "order_date", "order_total", "created_at", "updated_at"),
            (ForeignKey("customer_id", "customers"),),
            (("sales_channel", ("web", "app", "store")), ("order_status", ("created", "paid", "shipped", "delivered", "cancelled"))), ("order_total",),
        ),
        EntitySpec(
            "order_items", "dbo.OrderItems", "order_item_id",
            _columns("order_item_id:long order_id:long product_id:long quantity:int unit_price:money line_total:money"),
            ("order_item_id", "order_id", "product_id", "quantity", "unit_price", "line_total"),
            (ForeignKey("order_id", "orders"), ForeignKey("product_id", "products", live_parent=False)), not_negative=("quantity", "unit_price"),
        ),
        EntitySpec(
            "payments", "dbo.Payments", "payment_id",
            _columns("payment_id:long order_id:long payment_method:lower payment_status:lower amount:money payment_date:timestamp?"),
            ("payment_id", "order_id", "amount", "payment_date", "created_at", "updated_at"),
            (ForeignKey("order_id", "orders"),),
            (("payment_method", ("credit_card", "debit_card", "pse", "cash", "wallet")), ("payment_status", ("pending", "approved", "rejected", "refunded"))), ("amount",),
        ),
        EntitySpec(
            "support_tickets", "dbo.SupportTickets", "ticket_id",
            _columns("ticket_id:long customer_id:long subject:text ticket_body:text ticket_status:lower priority:lower"),
            ("ticket_id", "customer_id", "created_at", "updated_at"),
            (ForeignKey("customer_id", "customers"),),
            (("ticket_status", ("open", "in_progress", "resolved", "closed")), ("priority", ("low", "medium", "high", "urgent"))),
        ),
    )
}
