"""Candidate documents, scoring and decisions.

Pairs are made by equality first (account and amount, party, reference), then narrowed by date windows, so no step is a
cross join; decisions are windows over a line's or a document's pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import text_alike
from ..functions.text import iban_norm, iban_valid, is_batch_like, normalize_text, once, reference_core, split_refs, words_ascii

#: Points of the scoring rules; learned patterns count by whether the amount is exact or part of the document's.
POINTS = {"amount": 70, "amount_pending": 40, "date": 30, "ref_payment": 120, "ref_exact": 50, "ref_client": 35, "name_partial": 35, "name_fuzzy": 25, "name_description": 25, "iban": 45}
PATTERN_POINTS = {"pattern_iban": (60, 25), "pattern_desc": (40, 15)}
IDENTITY = ("ref_payment", "ref_exact", "ref_client", "name_partial", "name_fuzzy", "iban", "pattern_iban", "pattern_desc")
SAFE_GAP, SAFE_SCORE, FUZZY = 35, 150, 72
PARTIAL = ("customer_invoice", "supplier_invoice", "tax")
CENT = "decimal(18,2)"


def unclaimed(ledger: DataFrame, lines: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Unreconciled ledger rows that no line and no active batch claims."""
    rows = ledger.where(~F.col("reconciled")).join(lines.where("linked_ledger_id is not null").select(F.col("linked_ledger_id").alias("ledger_id")), "ledger_id", "left_anti")
    return rows.join(members.select("ledger_id"), "ledger_id", "left_anti") if members is not None else rows


def by_link(lines: DataFrame, *others: DataFrame, how: str = "left") -> DataFrame:
    """``lines`` joined on linked_ledger_id to each of ``others``. Lines without a link match nothing; their keys are made different, or all of
    them, most lines, would meet in one task."""
    free = F.when(F.col("linked_ledger_id").isNull(), F.xxhash64("line_id"))
    rows = lines.withColumn("_link", F.struct(F.col("linked_ledger_id").alias("id"), free.alias("free")))
    for o in others:
        key = F.struct(F.col("linked_ledger_id").alias("id"), F.lit(None).cast("long").alias("free"))
        rows = rows.join(o.where("linked_ledger_id is not null").withColumn("_link", key).drop("linked_ledger_id"), "_link", how)
    return rows.drop("_link")


def near_amount_pairs(lines: DataFrame, docs: DataFrame, days: int, cents: int = 1) -> DataFrame:
    """Pairs on one account with amounts within ``cents`` and dates within ``days``. ``docs`` has doc_account, doc_amount, doc_date."""
    key = (F.col("amount") * 100).cast("long")
    spread = lines.withColumns({"_cents": F.explode(F.array(*[key + i for i in range(-cents, cents + 1)])), "_account": F.col("account_id")})
    other = docs.withColumns({"_cents": (F.col("doc_amount") * 100).cast("long"), "_account": F.col("doc_account")})
    return near_days(spread, other, ["_account", "_cents"], "operation_date", "doc_date", days).drop("_account", "_cents")


def _runs(date: str, days: int) -> tuple[Column, Column]:
    """The run of days that a date lies in, and the runs (one or two) that dates within ``days`` of it lie in."""
    run = lambda shift: F.floor((F.datediff(F.col(date), F.lit("1970-01-01").cast("date")) + shift) / (4 * days + 1)).cast("long")
    return run(0), F.array_distinct(F.array(run(-days), run(days)))


def near_days(left: DataFrame, right: DataFrame, on: list[str], date: str, other: str, days: int) -> DataFrame:
    """Pairs with equal ``on`` whose dates (``date`` left, ``other`` right) are within ``days``: joined on runs of days, so rows of one
    key and far dates never meet."""
    a = left.withColumn("_run", F.explode(_runs(date, days)[1]))
    b = right.withColumn("_run", _runs(other, days)[0])
    return a.join(b, [*on, "_run"]).drop("_run").where(F.abs(F.datediff(date, other)) <= days)


def open_amounts(parents: DataFrame, children: DataFrame, key: str, total: str, paid: str) -> DataFrame:
    """``parents`` with ``open_amount`` = total less the sum of their children (summed before the join)."""
    sums = children.groupBy(key).agg(F.sum(paid).alias("_paid"))
    return parents.join(sums, key, "left").withColumn("open_amount", (F.col(total) - F.coalesce("_paid", F.lit(0))).cast("decimal(18,2)")).drop("_paid")


def candidate_union(*sources: DataFrame) -> DataFrame:
    """Documents (family, doc_id, ...) of several sources; the first source that has a document wins."""
    out = None
    for i, s in enumerate(sources):
        s = s.withColumn("_rank", F.lit(i))
        out = s if out is None else out.unionByName(s)
    w = Window.partitionBy("family", "doc_id").orderBy("_rank")
    return out.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_rank")


def _known(iban: Column) -> Column:
    """A valid IBAN, else an empty text."""
    return once(iban, lambda x: F.when(iban_valid(x), x).otherwise(""))


def prepare_lines(lines: DataFrame, keywords: tuple[str, ...] = ()) -> DataFrame:
    """Lines with what scoring compares, computed once a line: ``_`` columns. ``counterparty_iban`` may be missing."""
    iban = iban_norm("counterparty_iban") if "counterparty_iban" in lines.columns else F.lit("")
    fields = ("description", "payment_reference", "counterparty_name")
    return lines.withColumns({
        "_core": reference_core("payment_reference"), "_text": normalize_text(F.concat_ws(" ", "payment_reference", "description")), "_desc": normalize_text("description"),
        "_name": F.coalesce(normalize_text("counterparty_name"), F.lit("")), "_words": words_ascii("description"), "_iban": _known(iban),
        "_batch": is_batch_like(list(keywords), *fields) if keywords else F.lit(False)})


def prepare_docs(docs: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
    """Documents with what scoring compares. ``ref_client`` and ``doc_iban`` may be missing; ``patterns`` has kind, doc_id,
    pattern_type (iban, description) and pattern_value."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in docs.columns else F.lit("")
    iban = iban_norm(text("doc_iban"))
    shown = F.regexp_replace("doc_name", "(?i)^\\s*\\(paiement\\)\\s*/\\s*", "")
    phrase = words_ascii(F.regexp_replace(shown, "^[A-Z]{1,4}[0-9]+ - ", ""))
    whole = lambda p: F.contains(F.trim(p), F.lit(" ")) & (F.length(F.trim(p)) >= 8)
    out = docs.withColumns({
        "_dcore": reference_core("doc_ref"), "_dref": F.coalesce(normalize_text("doc_ref"), F.lit("")), "_dclients": F.filter(F.transform(split_refs(text("ref_client")), normalize_text), lambda x: x != ""),
        "_dname": F.coalesce(normalize_text(shown), F.lit("")), "_dphrase": once(phrase, lambda p: F.when(whole(p), p)), "_diban": _known(iban)})
    none = F.array().cast("array<string>")
    if patterns is None:
        return out.withColumns({"_pibans": none, "_ptexts": none})
    of = lambda t, v: F.collect_set(F.when(F.col("pattern_type") == t, v))
    per = patterns.groupBy("kind", "doc_id").agg(of("iban", F.when(iban_valid("pattern_value"), F.upper("pattern_value"))).alias("_pibans"), of("description", F.nullif(normalize_text("pattern_value"), F.lit(""))).alias("_ptexts"))
    return out.join(per, ["kind", "doc_id"], "left").withColumns({c: F.coalesce(c, none) for c in ("_pibans", "_ptexts")})


def amounts() -> tuple[Column, Column]:
    """Whether a pair's amounts are equal to a cent, and whether the line may pay a part; pairs that are neither score nothing."""
    cent = F.lit("0.01").cast(CENT)
    equal = F.abs(F.abs("amount") - F.abs("doc_amount")) <= cent
    return equal, ~equal & F.col("kind").isin(*PARTIAL) & (F.abs("doc_amount") > 0) & (F.abs("amount") < F.abs("doc_amount") + cent)


def score(pairs: DataFrame, tolerance: int) -> DataFrame:
    """Pairs of prepared lines (amount, operation_date and ``prepare_lines``) and documents (kind, doc_amount, doc_date and
    ``prepare_docs``) with ``score`` and its ``details``.

    A score needs an amount: equal to a cent, or less than an invoice or tax whose identity the line names. Bank rows that are
    late lose points unless a reference names them or the line is batch-like, and no learned pattern helps them then.
    """
    native = F.col("kind") == "native_bank"
    days = F.abs(F.datediff("operation_date", "doc_date"))
    mine, other = F.col("_name"), F.col("_dname")
    both = (mine != "") & (other != "")
    named = both & (F.contains(mine, other) | F.contains(other, mine))
    unnamed = both & ~named
    fuzzy = text_alike(F.when(unnamed, mine), F.when(unnamed, other), FUZZY)
    strong = (F.col("_core") == F.col("_dcore")) & (F.length("_core") >= 8)
    exact = ~strong & (F.col("_dref") != "") & F.contains("_text", F.col("_dref"))
    client = ~strong & ~exact & F.exists("_dclients", lambda x: F.contains(F.col("_text"), x))
    described = (mine == "") & (other != "") & native & F.coalesce(F.contains("_words", F.col("_dphrase")), F.lit(False))
    rows = pairs.withColumns({"_fuzzy": fuzzy, "_strong": strong, "_exact": exact})  # the Arrow function runs once
    dated = F.coalesce(days <= tolerance, F.lit(False))
    equal, partial = amounts()
    referred = F.col("_strong") | F.col("_exact")
    stale = native & ~F.col("_batch") & F.coalesce(days > tolerance, F.lit(False)) & ~referred
    learned = ~stale & (equal | partial)
    why = {
        "amount": equal, "amount_pending": partial, "date": dated, "ref_payment": F.col("_strong"), "ref_exact": F.col("_exact"), "ref_client": client, "name_partial": named, "name_fuzzy": unnamed & F.col("_fuzzy"), "name_description": described,
        "iban": (F.col("_iban") != "") & (F.col("_iban") == F.col("_diban")), "pattern_iban": learned & (F.col("_iban") != "") & F.array_contains("_pibans", F.col("_iban")), "pattern_desc": learned & F.exists("_ptexts", lambda x: F.contains(F.col("_desc"), x)),
    }
    points = F.lit(0)
    for name, c in why.items():
        if name == "pattern_iban":  # what comes before is what lateness takes from
            points = F.greatest(F.lit(0), points - F.when(stale, F.least(F.lit(80), 20 + 2 * (days - tolerance))).otherwise(0))
        worth = F.when(equal, PATTERN_POINTS[name][0]).otherwise(PATTERN_POINTS[name][1]) if name in PATTERN_POINTS else F.lit(POINTS[name])
        points = points + F.when(c, worth).otherwise(0)
    details = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in why.items()]), lambda x: x.isNotNull())
    allowed = equal | (partial & F.arrays_overlap("details", F.array(*[F.lit(x) for x in IDENTITY])))
    out = rows.withColumns({"details": details, "_points": points}).withColumn("score", F.when(allowed, F.col("_points")).otherwise(0).cast("int"))
    has = lambda *names: F.arrays_overlap("details", F.array(*[F.lit(x) for x in names]))
    out = out.withColumns({"by_amount": has("amount"), "by_date": has("date"), "strong": has("ref_payment", "ref_exact", "iban", "pattern_iban")})
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def ranked(scored: DataFrame) -> DataFrame:
    """Positive scores in order of score, open amount and id, with the lead over the next document."""
    w = Window.partitionBy("line_id").orderBy(F.desc("score"), F.abs("doc_amount"), "doc_id")
    return scored.where("score > 0").withColumn("rank", F.row_number().over(w)).withColumn("lead", (F.col("score") - F.coalesce(F.lead("score").over(w), F.lit(0))).cast("int"))


def decided(scored: DataFrame) -> DataFrame:
    """The top document of each line with is_safe, is_unambiguous and is_mutual (no other line safely takes it)."""
    top = ranked(scored).where("rank = 1")
    safe = (F.col("score") >= SAFE_SCORE) & F.col("by_amount") & F.col("strong") & (F.col("lead") >= SAFE_GAP)
    top = top.withColumn("is_safe", safe).withColumn("is_unambiguous", F.col("lead") >= SAFE_GAP)
    rivals = F.sum(F.col("is_safe").cast("int")).over(Window.partitionBy("kind", "doc_id"))
    return top.withColumn("is_mutual", F.col("is_safe") & (rivals == 1))


def opposite_pairs(lines: DataFrame, days: int, main: Column | None = None) -> DataFrame:
    """Lines of two accounts with opposite exact amounts within ``days``; each pair once, the outflow first. ``main`` (of out_account)
    names the one account that the outflow can go to."""
    a = lines.where("amount < 0").select(F.col("line_id").alias("out_id"), F.col("account_id").alias("out_account"), F.col("operation_date").alias("out_date"), (-F.col("amount")).cast(CENT).alias("amount"))
    b = lines.where("amount > 0").select(F.col("line_id").alias("in_id"), F.col("account_id").alias("in_account"), F.col("operation_date").alias("in_date"), F.col("amount").cast(CENT).alias("amount"))
    on = ["amount"]
    if main is not None:
        a, on = a.withColumn("in_account", main.cast("long")), ["amount", "in_account"]
    return near_days(a, b, on, "out_date", "in_date", days).where("out_account <> in_account")


def mutual_unique(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Pairs whose both sides are in no other pair."""
    one = lambda c: F.count("*").over(Window.partitionBy(c))
    return pairs.withColumn("_l", one(left)).withColumn("_r", one(right)).where("_l = 1 and _r = 1").drop("_l", "_r")


def parties_by(parties: DataFrame, by: list[str]) -> DataFrame:
    """Parties (``by``, party_id) counted by what requests ask for: n different ones, and the least. Requests that join these rows meet one row
    a tier, however many parties share the key."""
    return parties.select(*by, "party_id").distinct().groupBy(*by).agg(F.count("*").alias("n"), F.min("party_id").alias("party_id"))


def resolve_tiers(requests: DataFrame, tiers: list[DataFrame]) -> DataFrame:
    """First tier with a match wins; more than one match in that tier is ambiguous. Tiers: request_id, party_id (one row or several a request),
    or what ``parties_by`` counts of them: request_id, n, party_id (one row a request)."""
    every = None
    for i, t in enumerate(tiers):
        t = (t if "n" in t.columns else parties_by(t, ["request_id"])).select("request_id", "n", "party_id", F.lit(i + 1).alias("tier"))
        every = t if every is None else every.unionByName(t)
    first = every.withColumn("_n", F.row_number().over(Window.partitionBy("request_id").orderBy("tier"))).where("_n = 1")
    out = requests.join(first, "request_id", "left")
    status = F.when(F.col("tier").isNull(), "none").when(F.col("n") > 1, "ambiguous").otherwise("unique")
    return out.select("request_id", status.alias("status"), F.when(status == "unique", F.col("party_id")).alias("party_id"), "tier")


def write_offs(pairs: DataFrame, most: str, percent: str) -> DataFrame:
    """Invoice shortfalls small enough to write off: pairs with open_amount and paid; adds ``shortfall``."""
    d = "decimal(18,2)"
    gap = (F.col("open_amount") - F.abs("paid")).cast(d)
    return pairs.withColumn("shortfall", gap).where((F.col("shortfall") > 0) & (F.col("shortfall") <= F.lit(most).cast(d)) & (F.col("shortfall") * 100 <= F.col("open_amount") * F.lit(percent).cast("decimal(5,2)")))


def affected_peers(changed: DataFrame, lines: DataFrame, days: int = 31) -> DataFrame:
    """Lines to score again: the same reference core, or the same amount within ``days`` of a changed line."""
    c = changed.select(F.col("line_id").alias("of"), F.col("amount").alias("of_amount"), F.col("operation_date").alias("of_date"), reference_core("payment_reference").alias("of_core"))
    mine = lines.withColumn("core", reference_core("payment_reference"))
    by_core = mine.join(c.where("length(of_core) >= 8").select("of_core").distinct(), F.col("core") == F.col("of_core"), "left_semi").select("line_id")
    by_amount = near_days(mine, c.select(F.col("of_amount").alias("amount"), "of_date"), ["amount"], "operation_date", "of_date", days).select("line_id")
    return by_core.union(by_amount).distinct()


def existing_movement(lines: DataFrame, ledger: DataFrame, days: int) -> DataFrame:
    """Lines for which a ledger movement of the same account and exact amount lies within ``days``."""
    l = ledger.select(F.col("account_id").alias("_a"), F.col("amount").alias("_m"), F.col("booking_date").alias("_d"), F.explode(_runs("booking_date", days)[1]).alias("_r"))  # noqa: E741
    near = (F.col("account_id") == F.col("_a")) & (F.col("amount") == F.col("_m")) & (F.col("_run") == F.col("_r")) & (F.abs(F.datediff("operation_date", "_d")) <= days)
    return lines.withColumn("_run", _runs("operation_date", days)[0]).join(l, near, "left_semi").drop("_run")


def wrong_account(lines: DataFrame, ledger: DataFrame, days: int) -> DataFrame:
    """Ledger rows of other accounts with a line's exact amount within ``days``, where its own account has none."""
    alone = lines.join(existing_movement(lines, ledger, days).select("line_id"), "line_id", "left_anti")
    other = ledger.select("ledger_id", "amount", F.col("account_id").alias("ledger_account"), "booking_date")
    return near_days(alone, other, ["amount"], "operation_date", "booking_date", days).where("ledger_account <> account_id")


def planned_payments(lines: DataFrame, obligations: DataFrame, before: int, after: int) -> DataFrame:
    """Outflows that equal one open obligation of the account due from ``before`` days earlier to ``after`` days later:
    line_id, status (unique, ambiguous) and obligation_id."""
    o = obligations.select("obligation_id", "account_id", F.col("remaining").alias("_r"), "due_date")
    shift = F.datediff("operation_date", "due_date")
    out = lines.where("amount < 0").withColumn("_r", -F.col("amount"))
    pairs = near_days(out, o, ["account_id", "_r"], "operation_date", "due_date", max(before, after)).where((shift >= -before) & (shift <= after))
    n = pairs.groupBy("line_id").agg(F.count("*").alias("n"), F.min("obligation_id").alias("obligation_id"))
    return n.select("line_id", F.when(F.col("n") == 1, "unique").otherwise("ambiguous").alias("status"), F.when(F.col("n") == 1, F.col("obligation_id")).alias("obligation_id"))


def interval_join(points: DataFrame, spans: DataFrame, on: list[str], date: str) -> DataFrame:
    """Equal keys, and ``date`` from ``starts`` to ``ends``."""
    return points.join(spans, on).where(F.col(date).between(F.col("starts"), F.col("ends")))


def candidate_order(score_col: Column, kind: Column) -> list[Column]:
    rank = F.when(kind.isin("native_bank", "payment"), 0).when(kind.endswith("_linked"), 1).otherwise(2)
    return [score_col.desc(), rank, F.col("doc_ref")]
