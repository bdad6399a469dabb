"""Summaries of statements, accounts, worklists and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .matching import by_link

MONEY = "decimal(18,2)"


def statement_summary(lines: DataFrame, ledger: DataFrame) -> DataFrame:
    """Per statement: dates, lines, sum, linked, reconciled and lines with an issue."""
    g = ledger.select(F.col("ledger_id").alias("linked_ledger_id"), F.col("amount").alias("_a"), F.col("reconciled").alias("_r"))
    rows = by_link(lines, g)
    linked = F.col("linked_ledger_id").isNotNull()
    issue = linked & (F.col("_a").isNull() | (F.abs(F.col("amount") - F.col("_a")) > 0.001) | ~F.coalesce("_r", F.lit(False)))
    return rows.groupBy("statement_id").agg(
        F.min("operation_date").alias("first_date"), F.max("operation_date").alias("last_date"), F.count("*").alias("n"), F.sum("amount").cast(MONEY).alias("total"),
        F.count_if(linked).alias("linked"), F.count_if(F.col("status") == 2).alias("reconciled"), F.count_if(issue).alias("issues"))


def account_overview(accounts: DataFrame, ledger: DataFrame, lines: DataFrame) -> DataFrame:
    """Open accounts with ledger balance and pending lines, each summed before the join."""
    b = ledger.groupBy("account_id").agg(F.sum("amount").cast(MONEY).alias("balance"))
    p = lines.where("status < 2").groupBy("account_id").agg(F.count("*").alias("pending"))
    out = accounts.where("not closed").join(b, "account_id", "left").join(p, "account_id", "left")
    return out.select("account_id", "label", F.coalesce("balance", F.lit(0)).cast(MONEY).alias("balance"), F.coalesce("pending", F.lit(0)).alias("pending"))


def batch_projection(members: DataFrame, targets: DataFrame) -> DataFrame:
    """Per batch: members, sum, dates and validity (two members, exact sum, every member claimed once and reconciled)."""
    claims = members.withColumn("claims", F.count("*").over(Window.partitionBy("ledger_id")))
    agg = claims.groupBy("batch_id").agg(F.count("*").alias("n"), F.sum("amount").cast(MONEY).alias("total"), F.min("booking_date").alias("first_date"), F.max("booking_date").alias("last_date"), F.bool_and(F.col("reconciled") & (F.col("claims") == 1)).alias("members_ok"))
    out = agg.join(targets.select("batch_id", "target"), "batch_id", "left")
    return out.withColumn("is_valid", (F.col("n") >= 2) & F.col("members_ok") & F.coalesce(F.col("total") == F.col("target"), F.lit(False)))


def claim_counts(lines: DataFrame, members: DataFrame) -> DataFrame:
    """Claims on each ledger row from lines and from batch members."""
    direct = lines.where("linked_ledger_id is not null").select(F.col("linked_ledger_id").alias("ledger_id"))
    return direct.unionByName(members.select("ledger_id")).groupBy("ledger_id").agg(F.count("*").alias("claims"))


def status_counts(rows: DataFrame, state: str, states: list[str], by: list[str]) -> DataFrame:
    """One pass of conditional counts, and all."""
    return rows.groupBy(*by).agg(*[F.count_if(F.col(state) == s).alias(s) for s in states], F.count("*").alias("every"))


def listed(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Distinct values of a group in order, joined by commas."""
    return rows.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_set(value)), ",").alias(name))


def single_party(rows: DataFrame, by: str, party: str) -> DataFrame:
    """Groups whose rows all belong to one party."""
    return rows.groupBy(by).agg(F.min(party).alias("a"), F.max(party).alias("b"), F.count("*").alias("n")).where("a = b").select(by, F.col("a").alias(party), "n")


def top_descriptions(lines: DataFrame, k: int) -> DataFrame:
    """The most used descriptions of each account; ties by last use, then by text."""
    agg = lines.groupBy("account_id", "description").agg(F.count("*").alias("uses"), F.max("operation_date").alias("last_used"))
    w = Window.partitionBy("account_id").orderBy(F.desc("uses"), F.desc("last_used"), "description")
    return agg.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def candidate_metrics(lines: DataFrame, docs: DataFrame) -> DataFrame:
    """Same-day documents of the line's account and sign no larger than it: how many, and what whole percent of it they sum to (null for
    a line of nothing)."""
    size = (F.abs("amount").cast(MONEY) * 100).cast("decimal(18,0)")  # cents: whole numbers divide exactly
    key = lambda r, day: r.select("account_id", F.col(day).alias("_day"), F.signum("amount").cast("int").alias("_sign"), size.alias("_size"))
    d = key(docs, "booking_date").withColumns({"line_id": F.lit(None).cast("long"), "_n": F.lit(1), "_m": F.col("_size")})
    l = lines.select("account_id", F.col("operation_date").alias("_day"), F.signum("amount").cast("int").alias("_sign"), size.alias("_size"), F.col("line_id").cast("long").alias("line_id"), F.lit(0).alias("_n"), F.lit(0).cast("decimal(18,0)").alias("_m"))  # noqa: E741
    w = Window.partitionBy("account_id", "_day", "_sign").orderBy("_size").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    both = l.unionByName(d.select(*l.columns)).withColumns({"documents": F.sum("_n").over(w), "_sum": F.sum("_m").over(w)})
    return both.where("line_id is not null and documents > 0").select("line_id", "documents", F.call_function("div", F.col("_sum") * 100, F.nullif("_size", F.lit(0))).alias("coverage"))


def retention(audit: DataFrame, date: str, cutoff: Column) -> DataFrame:
    """Totals of an audit table, and how much of it is older than the cutoff."""
    return audit.agg(F.count("*").alias("total"), F.count_if(F.col(date) < cutoff).alias("purgeable"), F.min(date).alias("oldest"), F.max(date).alias("newest"))


def unite_generations(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """Rows of two storage generations; an old row that the new one holds is dropped."""
    return new.withColumn("generation", F.lit("staged")).unionByName(old.join(new.select(key), key, "left_anti").select(*new.columns).withColumn("generation", F.lit("legacy")))


def import_dedupe(new: DataFrame, existing: DataFrame, order: str) -> DataFrame:
    """Lines with ``hash``: imported, zero, known (hash exists) or repeated (earlier row of the import has it)."""
    known = existing.select("hash").distinct().withColumn("_k", F.lit(True))
    w = Window.partitionBy("hash").orderBy(order)
    rows = new.join(known, "hash", "left").withColumn("_n", F.row_number().over(w))
    outcome = F.when(F.col("amount") == 0, "zero").when(F.col("_k"), "known").when(F.col("_n") > 1, "repeated").otherwise("imported")
    return rows.withColumn("outcome", outcome).drop("_k", "_n")


def occurrence_dedupe(new: DataFrame, existing: DataFrame, uid: str, facts: list[str]) -> DataFrame:
    """Rows with a verified identity: new, same (equal facts) or conflict."""
    old = existing.select(uid, F.struct(*facts).alias("_old"))
    rows = new.join(old, uid, "left")
    return rows.withColumn("outcome", F.when(F.col("_old").isNull(), "new").when(F.col("_old") == F.struct(*facts), "same").otherwise("conflict")).drop("_old")


def statement_refs(statements: DataFrame) -> DataFrame:
    """``KB-yyyymmdd-TOKEN`` of at most 28 characters; repeated references get a number by id."""
    token = F.upper(F.regexp_replace("filename", "[^A-Za-z0-9]", ""))
    base = F.substring(F.concat_ws("-", F.lit("KB"), F.date_format("day", "yyyyMMdd"), token), 1, 24)
    w = Window.partitionBy("base").orderBy("statement_id")
    rows = statements.withColumn("base", base).withColumn("n", F.row_number().over(w))
    return rows.withColumn("ref", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", F.col("n").cast("string")))).drop("base", "n")


def diagnostics(lines: DataFrame, ledger: DataFrame, accounts: DataFrame) -> DataFrame:
    """One row of referential counts and an ok flag."""
    orphans = lines.where("linked_ledger_id is not null").join(ledger.select(F.col("ledger_id").alias("linked_ledger_id")), "linked_ledger_id", "left_anti").agg(F.count("*").alias("orphan_links"))
    lost = lines.join(accounts.select("account_id"), "account_id", "left_anti").agg(F.count("*").alias("orphan_accounts"))
    g = ledger.select(F.col("ledger_id").alias("linked_ledger_id"), F.col("account_id").alias("_a"))
    crossed = lines.join(g, "linked_ledger_id").where("account_id <> _a").agg(F.count("*").alias("account_mismatches"))
    parts = [x.select(F.lit(c).alias("what"), F.col(c).alias("n")) for x, c in ((orphans, "orphan_links"), (lost, "orphan_accounts"), (crossed, "account_mismatches"))]
    return parts[0].union(parts[1]).union(parts[2]).withColumn("ok", F.col("n") == 0)


def fingerprint_diff(old: DataFrame, new: DataFrame, key: str, facts: list[str]) -> DataFrame:
    """Keys that were added, removed or changed between two snapshots."""
    mark = lambda df, n: df.select(key, F.sha2(F.to_json(F.struct(*facts)), 256).alias(n))
    both = mark(old, "_o").join(mark(new, "_n"), key, "full")
    kind = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.col("_o") != F.col("_n"), "changed")
    return both.withColumn("change", kind).where("change is not null").select(key, "change")


def apply_matches(lines: DataFrame, ledger: DataFrame, matches: DataFrame) -> DataFrame:
    """Outcome of each proposed match (line_id, ledger_id, score): applied, or why not. The best score takes a ledger row."""
    l = lines.select("line_id", "account_id", "amount", "status", "linked_ledger_id")  # noqa: E741
    g = ledger.select("ledger_id", F.col("account_id").alias("_a"), F.col("amount").alias("_m"), "reconciled")
    rows = matches.join(l, "line_id", "left").join(g, "ledger_id", "left")
    fit = F.when(F.col("amount").isNull() | F.col("_m").isNull(), "missing").when(F.col("status") >= 2, "done").when(F.col("reconciled"), "reconciled").when(F.col("account_id") != F.col("_a"), "account").when(F.abs(F.col("amount") - F.col("_m")) > 0.001, "amount")
    rows = rows.withColumn("reason", fit)
    order = [F.col("reason").isNotNull(), F.desc("score")]
    mine = F.row_number().over(Window.partitionBy("line_id").orderBy(*order, "ledger_id"))
    first = rows.withColumn("_l", mine).withColumn("_g", F.row_number().over(Window.partitionBy("ledger_id").orderBy(F.col("reason").isNotNull(), F.col("_l"), F.desc("score"), "line_id")))
    late = F.when(F.col("reason").isNull() & ((F.col("_l") > 1) | (F.col("_g") > 1)), "claimed").otherwise(F.col("reason"))
    return first.select("line_id", "ledger_id", F.coalesce(late, F.lit("applied")).alias("outcome"))


def matched_lines(lines: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Lines after applied matches: status 2 and linked."""
    done = outcomes.where("outcome = 'applied'").select("line_id", F.col("ledger_id").alias("_g"))
    rows = lines.join(done, "line_id", "left")
    return rows.withColumn("status", F.when(F.col("_g").isNotNull(), 2).otherwise(F.col("status"))).withColumn("linked_ledger_id", F.coalesce("_g", "linked_ledger_id")).drop("_g").select(*lines.columns)


def undo_matches(lines: DataFrame, ids: DataFrame, historical: DataFrame) -> DataFrame:
    """Lines with the named matches cleared; lines before the opening stay."""
    open_ids = ids.select("line_id").join(historical.select("line_id"), "line_id", "left_anti").withColumn("_u", F.lit(True))
    rows = lines.join(open_ids, "line_id", "left")
    undo = F.coalesce("_u", F.lit(False))
    return rows.withColumn("status", F.when(undo, 0).otherwise(F.col("status"))).withColumn("linked_ledger_id", F.when(~undo, F.col("linked_ledger_id"))).drop("_u").select(*lines.columns)


def delete_statements(lines: DataFrame, ids: DataFrame) -> DataFrame:
    """statement_id, lines, outcome: deleted, or blocked where a line is reconciled."""
    rows = lines.join(ids.select("statement_id"), "statement_id", "left_semi").groupBy("statement_id").agg(F.count("*").alias("lines"), F.bool_or(F.col("status") == 2).alias("_b"))
    return rows.select("statement_id", "lines", F.when(F.col("_b"), "blocked").otherwise("deleted").alias("outcome"))


def materialize(lines: DataFrame, guarded: DataFrame) -> DataFrame:
    """New ledger rows of unmatched lines that no movement guards against."""
    free = lines.where("status < 2 and linked_ledger_id is null").join(guarded.select("line_id"), "line_id", "left_anti")
    return free.select((-F.col("line_id")).alias("ledger_id"), "account_id", F.col("operation_date").alias("booking_date"), "amount", F.when(F.col("amount") < 0, "DEB").otherwise("CRE").alias("operation"), F.coalesce(F.nullif("payment_reference", F.lit("")), "description").alias("label"))


def top_k(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_k") <= k).drop("_k")


def remaining_amount(parents: DataFrame, children: DataFrame, key: str, total: str, paid: str) -> DataFrame:
    """key, remaining (total less its children, 0 at least), settled."""
    sums = children.groupBy(key).agg(F.sum(paid).alias("_paid"))
    left = (F.col(total) - F.coalesce("_paid", F.lit(0))).cast(MONEY)
    return parents.join(sums, key, "left").select(key, F.greatest(left, F.lit(0).cast(MONEY)).alias("remaining"), (left <= 0).alias("settled"))


def feed_run_summary(outcomes: DataFrame, accounts: DataFrame) -> DataFrame:
    """Per entity of a feed run: accounts mapped and not, transactions imported, unchanged, in conflict and failed.
    ``outcomes``: account_id, outcome; ``accounts``: account_id, entity, mapped."""
    tx = outcomes.join(accounts.select("account_id", "entity"), "account_id").groupBy("entity").agg(
        F.count_if(F.col("outcome").isin("new", "zero")).alias("imported"), F.count_if(F.col("outcome").isin("unchanged", "described", "kept")).alias("unchanged"), F.count_if(F.col("outcome") == "review").alias("conflicts"), F.count_if(F.col("outcome") == "ambiguous").alias("failed"))
    heads = accounts.groupBy("entity").agg(F.count_if("mapped").alias("mapped"), F.count_if(~F.col("mapped")).alias("unmapped"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return heads.join(tx, "entity", "left").select("entity", "mapped", "unmapped", *[zero(c) for c in ("imported", "unchanged", "conflicts", "failed")])


def claims(lines: DataFrame, members: DataFrame) -> DataFrame:
    """Every claim on a ledger row: ledger_id, by (line or batch), id."""
    direct = lines.where("linked_ledger_id is not null").select(F.col("linked_ledger_id").alias("ledger_id"), F.lit("line").alias("by"), F.col("line_id").alias("id"))
    return direct.unionByName(members.select("ledger_id", F.lit("batch").alias("by"), F.col("batch_id").alias("id")))


def retention_split(audit: DataFrame, date: str, as_of: str, days: int = 365) -> tuple[DataFrame, DataFrame]:
    """(kept, purged) audit rows by age; ``days`` from 1 to 3650."""
    cut = F.date_sub(F.lit(as_of).cast("date"), min(3650, max(1, days)))
    old = F.coalesce(F.col(date) < cut, F.lit(False))
    return audit.where(~old), audit.where(old)


def provider_evidence(lines: DataFrame, payloads: DataFrame) -> DataFrame:
    """Lines whose stored provider payload (line_id, payload, payload_hash) does not hash to what was stored or does not tell the line's amount,
    currency and day: line_id, problem."""
    from ..functions.text import payload_text

    p = payloads.withColumns({"_amount": payload_text("payload", "amount").try_cast("decimal(24,8)"), "_currency": payload_text("payload", "currency"), "_day": payload_text("payload", "operation_date").try_cast("date")})
    rows = lines.join(p, "line_id", "left")
    same = (F.col("_amount") == F.col("amount")) & (F.col("_currency") == F.col("currency")) & (F.col("_day") == F.col("operation_date"))
    problem = F.when(F.col("payload").isNull(), "missing").when(F.sha2("payload", 256) != F.col("payload_hash"), "hash").when(~F.coalesce(same, F.lit(False)), "facts")
    return rows.select("line_id", problem.alias("problem")).where("problem is not null")


def apply_batches(proposed: DataFrame, lines: DataFrame, ledger: DataFrame, active: DataFrame) -> DataFrame:
    """Outcome of each proposed batch (line_id, ledger_id rows): line_id, members, outcome: applied, or why not (members, sum, taken, done).

    A batch needs two members at least, of its account, exactly the line's amount together, unreconciled, in no ``active`` batch
    (ledger_id), linked by no line, and in no other proposed batch of a smaller line.
    """
    linked = lines.where("linked_ledger_id is not null").select(F.col("linked_ledger_id").alias("ledger_id")).unionByName(active.select("ledger_id")).distinct().withColumn("_held", F.lit(True))
    m = proposed.distinct().withColumn("_first", F.min("line_id").over(Window.partitionBy("ledger_id")))
    m = m.join(ledger.select("ledger_id", F.col("account_id").alias("_acc"), F.col("amount").alias("_m"), "reconciled"), "ledger_id", "left").join(linked, "ledger_id", "left")
    m = m.join(lines.select("line_id", "account_id", "amount", "status"), "line_id")
    taken = F.coalesce(F.col("_held"), F.lit(False)) | F.coalesce(F.col("reconciled"), F.lit(True)) | (F.col("_first") < F.col("line_id"))
    per = m.groupBy("line_id", "amount", "status").agg(F.count("*").alias("members"), F.sum("_m").alias("total"), F.bool_or(taken).alias("taken"), F.bool_and(F.coalesce(F.col("_acc") == F.col("account_id"), F.lit(False))).alias("own"))
    outcome = F.when(F.col("status") >= 2, "done").when(F.col("members") < 2, "members").when(~F.col("own") | ~F.coalesce(F.col("total") == F.col("amount"), F.lit(False)), "sum").when(F.col("taken"), "taken").otherwise("applied")
    return per.select("line_id", "members", outcome.alias("outcome"))


def batched_ledger(ledger: DataFrame, proposed: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The ledger after applied batches: their members are reconciled."""
    done = proposed.join(outcomes.where("outcome = 'applied'").select("line_id"), "line_id", "left_semi").select("ledger_id").distinct().withColumn("_b", F.lit(True))
    return ledger.join(done, "ledger_id", "left").withColumn("reconciled", F.col("reconciled") | F.coalesce("_b", F.lit(False))).drop("_b").select(*ledger.columns)


def undo_batches(members: DataFrame, lines: DataFrame) -> DataFrame:
    """Batch members (line_id, ledger_id, active) with those of the given lines inactive; nothing is deleted."""
    undone = lines.select("line_id").distinct().withColumn("_u", F.lit(True))
    return members.join(undone, "line_id", "left").withColumn("active", F.col("active") & F.col("_u").isNull()).drop("_u").select(*members.columns)


def worklist_counts(states: DataFrame) -> DataFrame:
    """One row of counts of ``state``: pending (drafts too), draft, reconciled, review, every."""
    s = F.col("state")
    return states.agg(F.count_if(s.isin("pending", "registered")).alias("pending"), F.count_if(s == "registered").alias("draft"), F.count_if(s == "reconciled").alias("reconciled"), F.count_if(s == "review").alias("review"), F.count("*").alias("every"))


def history_summary(lines: DataFrame) -> DataFrame:
    """Reconciled lines by currency: how many, how many linked, credits and debits."""
    zero = F.lit(0).cast(MONEY)
    return lines.where("status = 2").groupBy("currency").agg(F.count("*").alias("n"), F.count("linked_ledger_id").alias("linked"), F.sum(F.greatest("amount", zero)).cast(MONEY).alias("credit"), F.sum(F.least("amount", zero)).cast(MONEY).alias("debit"))


def feed_history_range(tx: DataFrame, day: str, since: str, until: str) -> DataFrame:
    """First and last day of each account's transactions, widened to the range asked for."""
    e = tx.groupBy("account_id").agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
    return e.select("account_id", F.least("lo", F.lit(since).cast("date")).alias("first_day"), F.greatest("hi", F.lit(until).cast("date")).alias("last_day"))


def missing_connections(accounts: DataFrame, feeds: DataFrame) -> DataFrame:
    """Open accounts without a feed, by entity."""
    return accounts.where("not closed").join(feeds.select("account_id"), "account_id", "left_anti").groupBy("entity").agg(F.count("*").alias("missing"))


def feed_account_status(accounts: DataFrame, tx: DataFrame) -> DataFrame:
    """Open accounts with the balance, number and last day of their transactions (account_id, amount, day)."""
    e = tx.groupBy("account_id").agg(F.sum("amount").cast(MONEY).alias("balance"), F.count("*").alias("n"), F.max("day").alias("last_day"))
    return accounts.where("not closed").join(e, "account_id", "left").select("account_id", "label", "balance", F.coalesce("n", F.lit(0)).alias("n"), "last_day")


def repeated_identities(rows: DataFrame, key: str) -> DataFrame:
    """Keys that stand in several rows, and how many."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def hash_mismatches(rows: DataFrame, key: str, stored: Column, now: Column) -> DataFrame:
    """Keys whose stored hash does not follow from their facts any more."""
    return rows.where(~stored.eqNullSafe(now)).select(key)


def payload_summary(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Rows and total of a payload value by kind."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.coalesce(F.sum(value), F.lit(0)).alias("total"))
