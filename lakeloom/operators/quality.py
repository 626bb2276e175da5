"""Data quality rules as plans: single rules, and all rules of keys and nulls in one pass over each table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.config import RunContext
from lakeloom.functions.columns import differs, live
from lakeloom.operators.silver import coercion_losses
from lakeloom.specs import ENTITIES, EntitySpec, ForeignKey

COLUMNS = ["quality_run_id", "table_name", "check_name", "check_type", "failed_rows", "total_rows", "check_status", "checked_at"]
SHORT = COLUMNS[1:7]


def status(failed: Column, otherwise: str = "failed") -> Column:
    return F.when(failed == 0, "passed").otherwise(otherwise)


def _rows(table: str, checks: Sequence[tuple[str, str, Column, Column, str]]) -> Column:
    return F.inline(F.array(*[
        F.struct(
            F.lit(table).alias("table_name"), F.lit(name).alias("check_name"), F.lit(kind).alias("check_type"),
            failed.cast("bigint").alias("failed_rows"), total.cast("bigint").alias("total_rows"), status(failed, bad).alias("check_status"),
        ) for name, kind, failed, total, bad in checks
    ]))


def null_checks(df: DataFrame, table: str, columns: Sequence[str]) -> DataFrame:
    """Rows without a value in each column, deleted rows included; a failure is a warning."""
    counted = df.agg(F.count("*").alias("__n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counted.select(_rows(table, [(f"null_{c}", "null_check", F.col(c), F.col("__n"), "warning") for c in columns]))


def unique_check(df: DataFrame, table: str, keys: Sequence[str]) -> DataFrame:
    """Rows beyond the first of each key; null keys are one key."""
    counted = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("__n"), F.count("*").alias("__k"))
    failed = F.col("__n") - F.col("__k")
    return counted.select(_rows(table, [("duplicate_primary_key", "uniqueness_check", failed, F.col("__n"), "failed")]))


def referential_check(child: DataFrame, parent: DataFrame, table: str, key: ForeignKey, parent_key: str, flag: str = "is_deleted") -> DataFrame:
    """Live children without a parent, null keys among them; deleted parents count only where the rule says so.

    Children are reduced to counts per key before the join: a hot parent is one row.
    """
    parents = (parent.where(live(flag)) if key.live_parent else parent).select(F.col(parent_key).alias("__p")).distinct()
    per_key = child.where(live(flag)).groupBy(key.column).agg(F.count("*").alias("n"))
    joined = per_key.join(parents.withColumn("__hit", F.lit(1)), F.col(key.column) == F.col("__p"), "left")
    counted = joined.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("__n"), F.coalesce(F.sum(F.when(F.col("__hit").isNull(), F.col("n"))), F.lit(0)).alias("__bad")
    )
    return counted.select(_rows(table, [(key.check_name, "referential_integrity", F.col("__bad"), F.col("__n"), "failed")]))


@dataclass(frozen=True)
class KeyRules:
    """What key_checks() needs of an entity; an EntitySpec has it too."""

    key: str
    required: tuple[str, ...]
    references: tuple[ForeignKey, ...] = ()


def key_checks(tables: Mapping[str, DataFrame], rules: Mapping[str, KeyRules | EntitySpec], flag: str = "is_deleted") -> DataFrame:
    """The null, uniqueness and referential checks of all entities, as the single rules would give them.

    Each table is read once. Its keys, its references and the pattern of its nulls become rows of (entity, number), and
    one aggregate by both brings a parent's key together with the counts of its children: no joins, one shuffle, and a
    hot key or pattern is one row for each task. Keys and references are whole numbers.
    """
    names = list(rules)
    # The references to each entity, by place.
    towards = {n: [(c, k) for c in names for k in rules[c].references if k.parent == n] for n in names}
    slots = max(map(len, towards.values()), default=0)
    parts = []
    for number, name in enumerate(names):
        rule, df = rules[name], tables[name]
        # Rows without a value, as bits: bit i for the i-th required column.
        nulls = reduce(Column.__add__, [F.when(F.col(c).isNull(), 1 << i).otherwise(0) for i, c in enumerate(rule.required)], F.lit(0))
        values = {"key": F.col(rule.key).cast("bigint"), "nulls": nulls.cast("bigint")}
        values |= {f"ref{i}": F.col(k.column).cast("bigint") for i, k in enumerate(rule.references)}
        long = df.select(live(flag).alias("live"), *[v.alias(k) for k, v in values.items()]).unpivot(["live"], list(values), "what", "k")
        entity, slot = F.when(F.col("what") == "nulls", number + len(names)).otherwise(number), F.lit(-1)
        for i, k in enumerate(rule.references):
            mine = F.col("what") == f"ref{i}"
            entity, slot = F.when(mine, names.index(k.parent)).otherwise(entity), F.when(mine, towards[k.parent].index((name, k))).otherwise(slot)
        parts.append(long.select(entity.alias("entity"), "k", slot.alias("slot"), "live"))
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    own = F.col("slot") == -1
    by_key = reduce(DataFrame.unionByName, parts).groupBy("entity", "k").agg(
        one(own).alias("n"), one(own & F.col("live")).alias("alive"), *[one((F.col("slot") == i) & F.col("live")).alias(f"s{i}") for i in range(slots)]
    )
    # A null key is nobody's parent.
    found, alive = (F.col("k").isNotNull() & (F.col(c) > 0) for c in ("n", "alive"))
    widest = max(len(r.required) for r in rules.values())
    totals = [F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("keys")]
    totals += [F.sum(F.when(F.col("k").bitwiseAND(F.lit(1 << i)) != 0, F.col("n")).otherwise(0)).alias(f"c{i}") for i in range(widest)]
    for i in range(slots):
        s = F.col(f"s{i}")
        totals += [F.sum(s).alias(f"t{i}"), F.sum(F.when(~found, s).otherwise(0)).alias(f"any{i}"), F.sum(F.when(~alive, s).otherwise(0)).alias(f"live{i}")]
    counted = by_key.groupBy("entity").agg(*totals)
    # An entity without rows has results as well.
    spark = counted.sparkSession
    every = spark.range(2 * len(names)).select(F.col("id").cast("int").alias("entity"))
    counted = every.join(counted, "entity", "left").na.fill(0)
    rows = None
    for number, name in enumerate(names):
        rule = rules[name]
        checks = [("duplicate_primary_key", "uniqueness_check", F.col("n") - F.col("keys"), F.col("n"), "failed", name)]
        for i, (child, k) in enumerate(towards[name]):
            bad = F.col(f"live{i}" if k.live_parent else f"any{i}")
            checks.append((k.check_name, "referential_integrity", bad, F.col(f"t{i}"), "failed", child))
        missing = [(f"null_{c}", "null_check", F.col(f"c{i}"), F.col("n"), "warning", name) for i, c in enumerate(rule.required)]
        for at, some in ((number, checks), (number + len(names), missing)):
            here = F.when(F.col("entity") == at, _array(some))
            rows = here if rows is None else F.coalesce(rows, here)
    return counted.select(F.inline(rows))


def _array(checks: Sequence[tuple[str, str, Column, Column, str, str]]) -> Column:
    return F.array(*[
        F.struct(
            F.lit(table).alias("table_name"), F.lit(name).alias("check_name"), F.lit(kind).alias("check_type"),
            failed.cast("bigint").alias("failed_rows"), total.cast("bigint").alias("total_rows"), status(failed, bad).alias("check_status"),
        ) for name, kind, failed, total, bad, table in checks
    ])


def condition_checks(df: DataFrame, table: str, conditions: Mapping[str, tuple[str, Column]], bad_status: str = "failed") -> DataFrame:
    """Rows that meet a condition they shouldn't, for {check: (type, condition)}, in one pass."""
    names = list(conditions)
    counted = df.agg(F.count("*").alias("__n"), *[F.count_if(conditions[c][1]).alias(c) for c in names])
    return counted.select(_rows(table, [(c, conditions[c][0], F.col(c), F.col("__n"), bad_status) for c in names]))


def condition_check(df: DataFrame, table: str, name: str, bad: Column, kind: str = "consistency_check") -> DataFrame:
    return condition_checks(df, table, {name: (kind, bad)})


def domain_conditions(spec: EntitySpec) -> dict[str, tuple[str, Column]]:
    """Values outside a column's domain, and negative amounts; nulls are for the null checks."""
    out = {f"accepted_{c}": ("accepted_values", ~F.col(c).isin(*v)) for c, v in spec.domains}
    return out | {f"range_{c}": ("range_check", F.col(c) < 0) for c in spec.not_negative}


def domain_checks(df: DataFrame, spec: EntitySpec) -> list[DataFrame]:
    return [condition_checks(df, spec.name, {k: v}) for k, v in domain_conditions(spec).items()]


def coercion_checks(raw: DataFrame, spec: EntitySpec) -> DataFrame:
    """For each column that isn't text, the texts of the raw table that couldn't be read; a failure is a warning."""
    lost = coercion_losses(raw, spec)
    columns = [c for c in lost.columns if c != "__n"]
    return lost.select(_rows(spec.name, [(f"coercion_{c}", "coercion_check", F.col(c), F.col("__n"), "warning") for c in columns]))


def source_key_check(typed: DataFrame, spec: EntitySpec) -> DataFrame:
    """Rows beyond the first of each key before the latest was chosen: several versions, so a warning."""
    made = unique_check(typed, spec.name, [spec.key]).select("table_name", F.lit("duplicate_source_key").alias("check_name"), "check_type", "failed_rows", "total_rows")
    return made.withColumn("check_status", status(F.col("failed_rows"), "warning"))


def consistency_checks(orders: DataFrame, items: DataFrame, payments: DataFrame) -> DataFrame:
    """Amounts against each other: totals of orders, orders without items, payments, lines. Orders meet their items once."""
    sums = items.where(live()).groupBy("order_id").agg(F.sum("line_total").alias("__sum"), F.lit(True).alias("__any"))
    met = orders.select("order_id", "order_total").join(sums, "order_id", "left")
    zero = F.lit(0).cast("decimal(28,2)")
    of_orders = condition_checks(met, "orders", {
        "order_total_matches_items": ("consistency_check", differs(F.col("order_total"), F.coalesce("__sum", zero))),
        "order_has_items": ("consistency_check", F.col("__any").isNull()),
    })
    paid = payments.select("order_id", "amount").join(orders.select("order_id", "order_total"), "order_id")
    of_payments = condition_check(paid, "payments", "payment_matches_order_total", differs(F.col("amount"), F.col("order_total")))
    product = (F.col("quantity") * F.col("unit_price")).cast("decimal(28,2)")
    of_items = condition_check(items, "order_items", "line_total_matches_quantity", differs(F.col("line_total"), product))
    return of_orders.unionByName(of_payments).unionByName(of_items)


def order_totals(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Orders whose total isn't the sum of their live items (none: 0) within a cent."""
    sums = items.where(live()).groupBy("order_id").agg(F.sum("line_total").alias("items_total"))
    joined = orders.join(sums, "order_id", "left").withColumn("items_total", F.coalesce("items_total", F.lit(0).cast("decimal(28,2)")))
    return joined.where(differs(F.col("order_total"), F.col("items_total"))).select("order_id", "order_total", "items_total")


def orders_without_items(orders: DataFrame, items: DataFrame) -> DataFrame:
    return orders.join(items.where(live()).select("order_id").distinct(), "order_id", "left_anti").select("order_id")


def payment_mismatches(payments: DataFrame, orders: DataFrame) -> DataFrame:
    joined = payments.join(orders.select("order_id", "order_total"), "order_id")
    return joined.where(differs(F.col("amount"), F.col("order_total"))).select("payment_id", "order_id", "amount", "order_total")


def with_run(checks: DataFrame, run: RunContext) -> DataFrame:
    return checks.select(F.lit(run.run_id).alias("quality_run_id"), *SHORT, F.lit(run.at).cast("timestamp").alias("checked_at"))


def all_checks(tables: dict[str, DataFrame], run: RunContext, raw: dict[str, DataFrame] | None = None, typed: dict[str, DataFrame] | None = None) -> DataFrame:
    """The rows of a run: nulls, uniqueness and references (42 rows), domains, ranges and consistency of all entities.

    raw: the texts as loaded, for what couldn't be read; typed: the rows before the latest was chosen, for keys that
    have several.
    """
    parts = [key_checks(tables, ENTITIES), consistency_checks(tables["orders"], tables["order_items"], tables["payments"])]
    for name, spec in ENTITIES.items():
        if conditions := domain_conditions(spec):
            parts.append(condition_checks(tables[name], name, conditions))
        if raw:
            parts.append(coercion_checks(raw[name], spec))
        if typed:
            parts.append(source_key_check(typed[name], spec))
    return with_run(reduce(DataFrame.unionByName, parts), run)
