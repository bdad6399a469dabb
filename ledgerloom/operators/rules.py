"""Prioritised rules over lines: validation, evaluation, usage and account pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import iban_valid

#: Allowed field and operator pairs.
ALLOWED = {
    "description": ("contains", "not_contains", "regex"), "counterparty_name": ("contains",), "amount": ("equals", "between"),
    "currency": ("equals",), "counterparty_iban": ("equals",),
}


def problem(rule: dict) -> str | None:
    """Why a rule is refused; None if it is good."""
    conditions = [*rule.get("all", []), *rule.get("any", [])]
    if not conditions or len(rule.get("all", [])) > 12 or len(rule.get("any", [])) > 12:
        return "conditions"
    for c in conditions:
        if c["operator"] not in ALLOWED.get(c["field"], ()):
            return "operator"
        if c["operator"] == "between" and not c["value"] <= c["max"]:
            return "interval"
        if c["operator"] == "regex" and any(x in c["value"] for x in ("(?<", "(?=", "(?!", "\\1", "*+", "++")):
            return "regex"
    return None


def _matches(c: dict) -> Column:
    f, v = F.col(c["field"]), c["value"]
    if c["operator"] == "contains":
        return F.contains(F.lower(f), F.lit(v.lower()))
    if c["operator"] == "not_contains":
        return ~F.contains(F.lower(f), F.lit(v.lower()))
    if c["operator"] == "regex":
        return (F.length(f) <= 4096) & f.rlike(f"(?i){v}")
    exact = lambda x: F.lit(x).cast("decimal(18,2)")
    if c["operator"] == "between":
        return f.between(exact(v), exact(c["max"]))
    return f == (exact(v) if c["field"] == "amount" else F.lit(v))


def condition(rule: dict) -> Column:
    """A rule as one predicate."""
    parts = [_matches(c) for c in rule.get("all", [])]
    if rule.get("any"):
        parts.append(reduce(lambda a, b: a | b, [_matches(c) for c in rule["any"]]))
    if rule.get("account_id"):
        parts.append(F.col("account_id") == rule["account_id"])
    if rule.get("direction"):
        parts.append(F.signum("amount") == rule["direction"])
    return F.coalesce(reduce(lambda a, b: a & b, parts), F.lit(False))


def evaluate(lines: DataFrame, rules: list[dict]) -> DataFrame:
    """Lines with the winning rule (lowest priority, then id) and the number of rules that match. Few rules: all in one scan."""
    good = sorted((r for r in rules if r.get("active", True) and problem(r) is None), key=lambda r: (r["priority"], r["id"]))
    hits = F.filter(F.array(*[F.when(condition(r), F.lit(r["id"])) for r in good]), lambda x: x.isNotNull())
    rows = lines.withColumn("_h", hits)
    return rows.withColumn("rule_id", F.get("_h", F.lit(0))).withColumn("matching", F.size("_h")).drop("_h")


def usage(approved: DataFrame) -> DataFrame:
    """Hits and last use of each rule."""
    return approved.where("rule_id is not null").groupBy("rule_id").agg(F.count("*").alias("hits"), F.max("operation_date").alias("last_used"))


def pair_problems(pairs: DataFrame, accounts: DataFrame) -> DataFrame:
    """(restricted, problem) of account pairs that point at themselves, form chains, or have closed or missing accounts."""
    mains = pairs.select(F.col("main").alias("restricted")).distinct().withColumn("_chain", F.lit(True))
    live = accounts.where("not closed").select(F.col("account_id").alias("main"), F.lit(True).alias("_open"))
    rows = pairs.join(mains, "restricted", "left").join(live, "main", "left")
    why = F.when(F.col("restricted") == F.col("main"), "self").when(F.col("_chain"), "chain").when(F.col("_open").isNull(), "account")
    return rows.select("restricted", why.alias("problem")).where("problem is not null")


#: Most conditions of a group, and most characters of a value.
CONDITIONS, LONGEST = 12, 256


def validate_rules(conditions: DataFrame, actions: DataFrame) -> DataFrame:
    """(rule_id, problem) of rules held in tables; null where a rule is good.

    ``conditions``: rule_id, side (all, any), field, operator, value, max; ``actions``: rule_id, type, party_id, invoice_type, category_id,
    account, payment_mode, label, vat. Checked in order: some condition, at most ``CONDITIONS`` a side, allowed field and operator, value, interval,
    IBAN checksum, currency, safe pattern, shape of the action.
    """
    number = lambda c: F.when(F.col(c).rlike("^-?[0-9]{1,16}([.][0-9]{1,8})?$"), F.col(c).cast("decimal(24,8)"))
    allowed = reduce(lambda a, b: a | b, [(F.col("field") == f) & F.col("operator").isin(*ops) for f, ops in ALLOWED.items()])
    between = F.col("operator") == "between"
    unsafe = reduce(lambda a, b: a | b, [F.contains("value", F.lit(x)) for x in ("(?<", "(?=", "(?!", "\\1", "*+", "++")])
    no = lambda c: ~F.coalesce(c, F.lit(False))
    why = (
        F.when(no(allowed), 2).when(no((F.length("value") > 0) & (F.length("value") <= LONGEST)), 3).when((F.col("field") == "amount") & (number("value").isNull() | (between & number("max").isNull())), 3)
        .when(between & no(number("value") <= number("max")), 4).when((F.col("field") == "counterparty_iban") & ~iban_valid("value"), 5).when((F.col("field") == "currency") & no(F.col("value").rlike("^[A-Za-z]{3}$")), 6)
        .when((F.col("operator") == "regex") & unsafe, 7)
    )
    sides = conditions.groupBy("rule_id", "side").agg(F.count("*").alias("n"), F.min(why).alias("why"))
    per = sides.groupBy("rule_id").agg(F.max("n").alias("most"), F.min("why").alias("why"))
    present = lambda c: F.coalesce(F.col(c) > 0, F.lit(False))
    text = lambda c, p: F.coalesce(F.col(c).rlike(p), F.lit(False))
    shape = (
        F.when(F.col("type") == "invoice_search", present("party_id") & F.coalesce(F.col("invoice_type").isin("customer_invoice", "supplier_invoice"), F.lit(False))).when(F.col("type") == "category", present("category_id"))
        .when(F.col("type") == "quick_entry", present("party_id") & text("account", "(?i)^[a-z0-9_.-]{1,32}$") & text("payment_mode", "(?i)^[a-z0-9_]{1,6}$") & F.coalesce(F.length(F.trim("label")).between(1, 255), F.lit(False)) & F.coalesce(F.col("vat").between(0, 100), F.lit(False)))
        .otherwise(False)
    )
    names = F.array(*[F.lit(x) for x in ("conditions", "operator", "value", "interval", "iban", "currency", "regex", "action")])
    code = F.when(F.col("most").isNull() | (F.col("most") > CONDITIONS), 1).when(F.col("why").isNotNull(), F.col("why")).when(~F.coalesce(F.col("good"), F.lit(False)), 8)
    return actions.withColumn("good", shape).join(per, "rule_id", "left").select("rule_id", F.when(code.isNotNull(), F.element_at(names, code)).alias("problem"))
