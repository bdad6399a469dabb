"""Columns of unknown delimited files: headings, roles by alias, by name, by content and by learned headings.

Everything is per file in one job: cells are profiled by aggregation, a file's columns (a handful) are one array, and the roles
are decided by expressions over it in a fixed order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import text_similarity
from ..functions.text import extract_strong_reference, header_key
from ..functions.values import parse_date, parse_number
from .records import numbered
from .statements import file_lines, profile_cells

MONEY = "decimal(18,2)"
#: Headings by field, the surest first; callers may pass their own.
ALIASES = {
    "operation_date": ["data_mov", "data_movimento", "booking_date", "operation_date", "data_operacao"],
    "value_date": ["data_valor", "value_date", "valuta"],
    "description": ["descricao", "description", "historico", "narrative"],
    "debit": ["debito", "debit", "saidas"],
    "credit": ["credito", "credit", "entradas"],
    "amount": ["montante", "amount", "importancia"],
    "running_balance": ["saldo", "balance", "saldo_contabilistico"],
    "currency": ["moeda", "currency", "divisa"],
    "counterparty_iban": ["iban", "nib"],
    "payment_reference": ["referencia", "reference"],
}
FIELDS = ("operation_date", "value_date", "debit", "credit", "running_balance", "amount", "description", "currency", "counterparty_iban", "payment_reference", "counterparty_name")
#: Words of headings by role.
ROLES = {
    "date": "date|data|valor_data|valuta|booking|operation|movimento|posting|settlement|effective|processing|fecha",
    "debit": "debit|debito|saida|saidas|withdraw|pagamento|debito_direto|outgoing|expense",
    "credit": "credit|credito|entrada|recebimento|deposit|incoming|receipt",
    "amount": "amount|valor|montante|quantia|movimento|importe|total|value",
    "balance": "saldo|balance|running_balance|contabilistico|disponivel|controlo|controle|opening|ending|final",
    "description": "descricao|description|detalhe|historico|memo|narrative|remittance|details|descr|label|purpose|texto",
    "currency": "currency|moeda|divisa|devise|ccy|curr",
    "reference": "referencia|reference|ref|transacao|documento|id|codigo|code|transaction_id|operation_id",
    "iban": "iban|nib|conta|account|beneficiary_account|debtor_account|creditor_account",
}


def cells(files: DataFrame, separator: str) -> DataFrame:
    """(file, rank, column, cell) of every line."""
    return file_lines(files).select("file", "rank", F.posexplode(F.split("line", f"[{separator}]")).alias("column", "cell"))


def _strings(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def guess_header_row(files: DataFrame, separator: str, aliases: dict[str, list[str]] = ALIASES, scan: int = 80, least: int = 8) -> DataFrame:
    """(file, header_row): the heading among the first ``scan`` rows; -1 where no row scores ``least``.

    A row scores 12 for each field that one of its cells names, 2 for each text, -3 for each number and -2 for each date, 8 and 2
    where the next row has dates with numbers, and text. Rows of dates with numbers are data; of equal rows the first wins.
    """
    c = cells(files, separator).where((F.col("rank") <= scan) & (F.trim("cell") != "")).withColumns({"v": parse_number("cell"), "d": parse_date("cell")})
    letters = F.col("v").isNull() & F.col("d").isNull() & F.col("cell").rlike("\\p{L}")
    rows = c.groupBy("file", "rank").agg(F.count("*").alias("n"), F.count("v").alias("numbers"), F.count("d").alias("dates"), F.count_if(letters).alias("texts"), F.collect_list(header_key("cell")).alias("keys"))
    named = lambda words: F.exists("keys", lambda k: (k != "") & F.exists(_strings(words), lambda a: F.contains(k, a) | F.contains(a, k)))
    alias = reduce(lambda a, b: a + b, [named(w).cast("int") for w in aliases.values()])
    w = Window.partitionBy("file").orderBy("rank")
    follows = F.lead("rank").over(w) == F.col("rank") + 1
    after = lambda x: F.coalesce(F.when(follows, F.lead(x).over(w)), F.lit(0))
    rows = rows.withColumns({"alias": alias, "next_dates": after("dates"), "next_numbers": after("numbers"), "next_texts": after("texts")})
    score = (
        F.col("alias") * 12 + F.col("texts") * 2 - F.col("numbers") * 3 - F.col("dates") * 2
        + F.when((F.col("next_dates") > 0) & (F.col("next_numbers") > 0), 8).otherwise(0) + F.when(F.col("next_texts") > 0, 2).otherwise(0)
        - F.when((F.col("alias") == 0) & (F.col("numbers") == 0) & (F.col("texts") <= 2), 8).otherwise(0)
    )
    may = (F.col("n") >= 2) & ~((F.col("dates") > 0) & (F.col("numbers") > 0)) & (F.col("rank") < scan) & (score >= least)
    best = rows.groupBy("file").agg(F.max(F.when(may, F.struct(score.alias("s"), (-F.col("rank")).alias("r")))).alias("b"))
    names = files.select("file").distinct() if "line" in files.columns else files.select("file")
    return names.join(best, "file", "left").select("file", F.coalesce(-F.col("b.r"), F.lit(-1)).cast("int").alias("header_row"))


def headings(files: DataFrame, separator: str, header: DataFrame) -> DataFrame:
    """(file, column, key) of the heading rows that were found."""
    rows = cells(files, separator).join(header, "file").where("rank = header_row")
    return rows.select("file", "column", header_key("cell").alias("key")).where("key <> ''")


def map_by_alias(heads: DataFrame, aliases: dict[str, list[str]] = ALIASES) -> DataFrame:
    """(file, field, column): a heading that is an alias (the surest), else the first that holds one or is held in one."""
    rows = []
    for field, words in aliases.items():
        same = F.min(F.when(F.col("key").isin(words), F.struct(F.array_position(_strings(words), F.col("key")).alias("p"), "column")))
        near = F.min(F.when(F.exists(_strings(words), lambda a: F.contains(F.col("key"), a) | F.contains(a, F.col("key"))), F.col("column")))
        rows.append(F.struct(F.lit(field).alias("field"), F.coalesce(same["column"], near).alias("column")))
    one = heads.groupBy("file").agg(F.array(*rows).alias("a"))
    return one.select("file", F.explode("a").alias("m")).where("m.column is not null").select("file", "m.field", "m.column")


def column_facts(files: DataFrame, separator: str, header: DataFrame, rows: int = 220) -> DataFrame:
    """(file, cols): heading key and profile of every column over the first data rows after the heading."""
    data = cells(files, separator).join(header, "file")
    inside = data.where((F.col("rank") > F.col("header_row")) & (F.col("rank") <= F.col("header_row") + rows))
    facts = profile_cells(inside.select("file", "column", "cell")).join(headings(files, separator, header), ["file", "column"], "full")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("filled", "numeric", "dates", "text", "negative", "positive", "zero", "non_zero", "mean_length")]
    return facts.select("file", F.struct("column", F.coalesce("key", F.lit("")).alias("key"), *zero).alias("c")).groupBy("file").agg(F.array_sort(F.collect_list("c")).alias("cols"))


def _first(condition, *taken: str) -> Column:
    """The first column for which ``condition`` holds and that no field of ``taken`` has; -1 if there is none."""
    free = lambda c: reduce(lambda a, b: a & b, [c["column"] != F.col(t) for t in taken], F.lit(True))
    return F.coalesce(F.get(F.filter("cols", lambda c: condition(c) & free(c)), F.lit(0))["column"], F.lit(-1))


def _wide(facts: DataFrame, mapping: DataFrame) -> DataFrame:
    per = mapping.groupBy("file").agg(*(F.max(F.when(F.col("field") == f, F.col("column"))).alias(f) for f in FIELDS))
    return facts.join(per, "file", "left").select("file", "cols", *(F.coalesce(f, F.lit(-1)).alias(f) for f in FIELDS))


def _long(wide: DataFrame) -> DataFrame:
    rows = wide.select("file", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("column")) for f in FIELDS))).alias("m"))
    return rows.where("m.column >= 0").select("file", "m.field", "m.column")


def map_by_header_pattern(facts: DataFrame, mapping: DataFrame) -> DataFrame:
    """``mapping`` (file, field, column) with fields that it lacks found by the words of the headings, in a fixed order."""
    is_ = lambda role: lambda c: c["key"].rlike(f"(^|_)({ROLES[role]})($|_)")
    steps = {
        "operation_date": (is_("date"),), "value_date": (is_("date"), "operation_date"), "debit": (is_("debit"),), "credit": (is_("credit"),), "running_balance": (is_("balance"),),
        "amount": (lambda c: is_("amount")(c) & ~is_("date")(c), "debit", "credit", "running_balance"), "description": (is_("description"),), "currency": (is_("currency"),), "counterparty_iban": (is_("iban"),),
        "payment_reference": (is_("reference"), "description"), "counterparty_name": (lambda c: is_("description")(c) | is_("reference")(c), "description", "payment_reference"),
    }
    wide = _wide(facts, mapping)
    for field, (condition, *taken) in steps.items():
        wide = wide.withColumn(field, F.when(F.col(field) < 0, _first(condition, *taken)).otherwise(F.col(field)))
    return _long(wide)


def map_by_profile(facts: DataFrame, mapping: DataFrame) -> DataFrame:
    """``mapping`` corrected by what the columns hold: dates, text, signed amounts, one-signed debits and credits, balances."""
    part = lambda c, x: c[x] / F.greatest(c["filled"], F.lit(1))
    of = lambda field: F.get(F.filter("cols", lambda c: c["column"] == F.col(field)), F.lit(0))
    sound = lambda field, test: F.coalesce(test(of(field)), F.lit(False))
    best = lambda may, score: F.coalesce(F.get(F.array_sort(F.transform(F.filter("cols", may), lambda c: F.struct((-score(c)).alias("s"), c["column"].alias("column")))), F.lit(0))["column"], F.lit(-1))
    free = lambda *fields: lambda c: reduce(lambda a, b: a & b, [c["column"] != F.col(f) for f in fields])
    numbers = lambda c, share, dates: (c["numeric"] >= 3) & (part(c, "numeric") >= share) & (part(c, "dates") < dates) & (c["text"] == 0)

    dated = lambda c: (c["dates"] >= 3) & (part(c, "dates") >= 0.55)
    date_score = lambda c: c["dates"] * 100 + part(c, "dates") * 10 + c["column"] * 0.01
    healthy_date = lambda c: (c["dates"] >= 3) & (part(c, "dates") >= 0.45)
    wide = _wide(facts, mapping)
    found = best(dated, date_score)
    wide = wide.withColumn("operation_date", F.when(~sound("operation_date", healthy_date) & (found >= 0), found).otherwise(F.col("operation_date")))
    other = best(lambda c: dated(c) & free("operation_date")(c), date_score)
    wide = wide.withColumn("value_date", F.when(sound("value_date", healthy_date), F.col("value_date")).when(other >= 0, other).when(F.col("operation_date") >= 0, F.col("operation_date")).otherwise(F.col("value_date")))
    told = best(lambda c: (c["text"] >= 3) & (part(c, "text") >= 0.35), lambda c: c["text"] * 4.0 + c["mean_length"] - c["numeric"] * 2.0 - c["dates"] * 2.0)
    wide = wide.withColumn("description", F.when(~sound("description", lambda c: (c["text"] >= 2) & (part(c, "text") >= 0.25)) & (told >= 0), told).otherwise(F.col("description")))

    open_ = free("operation_date", "value_date", "description")
    may = lambda c: open_(c) & (c["non_zero"] >= 2) & numbers(c, 0.60, 0.40)
    any_negative = F.exists("cols", lambda c: may(c) & (c["negative"] > 0))
    some = lambda c, x: F.when(c[x] > 0, 3.0).otherwise(0.0)
    amount = best(lambda c: may(c) & (~any_negative | (c["negative"] > 0)), lambda c: c["non_zero"] * 4.0 + F.least(c["negative"], c["positive"]) * 6.0 + some(c, "negative") + some(c, "positive") - c["zero"] + c["column"] * 0.05)
    wide = wide.withColumn("amount", F.when(sound("amount", lambda c: (c["non_zero"] >= 2) & numbers(c, 0.55, 0.40)), F.col("amount")).otherwise(amount))
    zeros = lambda c: c["zero"] >= F.greatest(F.lit(1), F.floor(c["filled"] * 0.15))
    one_sign = lambda here, there: lambda c: open_(c) & numbers(c, 0.55, 0.40) & (c[here] >= 2) & (c[there] == 0) & zeros(c)
    weight = lambda here: lambda c: c[here] * 3.0 + c["non_zero"] * 1.5
    for field, here, there in (("debit", "negative", "positive"), ("credit", "positive", "negative")):
        fits = one_sign(here, there)
        wide = wide.withColumn(field, F.when(sound(field, fits), F.col(field)).otherwise(best(fits, weight(here))))
    wide = wide.withColumn("credit", F.when((F.col("credit") >= 0) & (F.col("credit") == F.col("debit")), -1).otherwise(F.col("credit")))
    rest = free("operation_date", "value_date", "description", "amount", "debit", "credit")
    up = lambda c: F.when(c["positive"] >= c["negative"], 1.0).otherwise(0.0)
    balance = best(lambda c: rest(c) & (c["non_zero"] >= 2) & numbers(c, 0.55, 0.35), lambda c: c["filled"] * 2.0 + c["non_zero"] + c["column"] * 0.10 + up(c))
    wide = wide.withColumn("running_balance", F.when(sound("running_balance", lambda c: numbers(c, 0.55, 0.35)), F.col("running_balance")).when(balance >= 0, balance).otherwise(F.col("running_balance")))
    return _long(wide)


def map_columns(files: DataFrame, separator: str, aliases: dict[str, list[str]] = ALIASES) -> DataFrame:
    """(file, field, column) by alias, then heading words, then content."""
    header = guess_header_row(files, separator, aliases)
    facts = column_facts(files, separator, header)
    return map_by_profile(facts, map_by_header_pattern(facts, map_by_alias(headings(files, separator, header), aliases)))


#: Bins of the hashed heading vectors.
BINS = 128


def _vectors(keys: DataFrame) -> DataFrame:
    """(key, bin, x): unit vectors of a heading's words (weight 3) and three-letter runs."""
    padded = F.concat(F.lit("^"), "key", F.lit("$"))
    words = F.transform(F.array_remove(F.split("key", "_+"), ""), lambda w: F.struct(F.concat(F.lit("tok:"), w).alias("t"), F.lit(3.0).alias("n")))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(padded) - 2)), lambda i: F.struct(F.concat(F.lit("gram:"), F.substring(padded, i, F.lit(3))).alias("t"), F.lit(1.0).alias("n")))
    each = keys.select("key", F.explode(F.concat(words, runs)).alias("f")).select("key", (F.crc32("f.t") % BINS).alias("bin"), "f.n").groupBy("key", "bin").agg(F.sum("n").alias("n"))
    size = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("key")))
    return each.select("key", "bin", (F.col("n") / size).alias("x"))


def map_by_learned_header(heads: DataFrame, mapping: DataFrame, examples: DataFrame, accept: float = 0.72, lead: float = 0.15) -> DataFrame:
    """``mapping`` with fields that it lacks proposed by approved headings (field, key): the vote of the three nearest hashed vectors,
    with a likeness of ``accept`` and ``lead`` over other fields; two columns as close for one field are left open.

    Headings and examples meet where they share a bin, so nothing is a cross join; the nearest are among those by construction.
    """
    clear = examples.select("field", "key").distinct().withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n = 1").drop("n")
    open_ = heads.join(mapping.select("file", "column"), ["file", "column"], "left_anti")
    mine, theirs = _vectors(open_.select("key").distinct()), _vectors(clear.select("key").distinct()).select(F.col("key").alias("example"), "bin", F.col("x").alias("y"))
    near = mine.join(theirs, "bin").groupBy("key", "example").agg(F.sum(F.col("x") * F.col("y")).alias("cosine")).join(clear.withColumnRenamed("key", "example"), "example")
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("cosine"), "example"))
    votes = near.withColumn("k", rank).where("k <= 3").groupBy("key", "field").agg(F.count("*").alias("v"), F.min("k").alias("k"))
    won = votes.groupBy("key").agg(F.max_by("field", F.struct("v", -F.col("k"))).alias("won"))
    held = F.contains("key", F.col("example")) | F.contains("example", F.col("key"))
    like = F.when(F.col("key") == F.col("example"), 1.0).when(held, 0.9).otherwise(text_similarity("key", "example") / 100)
    sure = near.withColumn("like", like).join(won, "key").groupBy("key", "won").agg(F.max(F.when(F.col("field") == F.col("won"), F.col("like"))).alias("own"), F.coalesce(F.max(F.when(F.col("field") != F.col("won"), F.col("like"))), F.lit(0.0)).alias("rival"))
    good = sure.where((F.col("own") >= accept) & ((F.col("own") - F.col("rival") >= lead) | (F.col("own") == 1.0))).select("key", F.col("won").alias("field"), "own")
    asked = open_.join(good, "key").join(mapping.select("file", "field"), ["file", "field"], "left_anti")
    w = Window.partitionBy("file", "field").orderBy(F.desc("own"), "column")
    best = asked.withColumns({"k": F.row_number().over(w), "gap": F.col("own") - F.coalesce(F.lead("own").over(w), F.lit(-1.0))}).where((F.col("k") == 1) & (F.col("gap") >= lead))
    return mapping.unionByName(best.select("file", "field", "column"))


def header_examples(heads: DataFrame, approved: DataFrame, known: DataFrame) -> DataFrame:
    """``known`` (field, key) with the headings of approved mappings (file, field, column) added, each once."""
    return known.select("field", "key").unionByName(heads.join(approved, ["file", "column"]).select("field", "key")).distinct()


def best_profile(files: DataFrame, profiles: DataFrame) -> DataFrame:
    """(file, profile_id) of the saved layout to use: the same fingerprint, else the same signature; the account's own before a
    general one, then the newest. ``files``: file, account_id, fingerprint, signature; ``profiles``: profile_id, account_id (null:
    general), fingerprint, signature, saved."""
    p = profiles.select("profile_id", F.col("account_id").alias("owner"), F.col("fingerprint").alias("f"), F.col("signature").alias("s"), "saved")
    same = files.join(p, F.col("fingerprint") == F.col("f")).withColumn("tier", F.lit(0))
    near = files.join(p, F.col("signature") == F.col("s")).withColumn("tier", F.lit(1))
    may = same.unionByName(near).where(F.col("owner").isNull() | (F.col("owner") == F.col("account_id")))
    w = Window.partitionBy("file").orderBy("tier", F.col("owner").isNull(), F.desc("saved"), F.desc("profile_id"))
    return may.withColumn("k", F.row_number().over(w)).where("k = 1").select("file", "profile_id")


def mapping_quality(preview: DataFrame, huge: str = "100000000000") -> DataFrame:
    """(file, verdict) of mapped lines (file, raw_amount, raw_date, operation_date, amount, description): why a mapping is refused, or ok."""
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    n = preview.groupBy("file").agg(
        F.count("*").alias("n"), F.count("amount").alias("amounts"), count(F.trim("description") != "").alias("told"), F.count("operation_date").alias("dated"), count(F.abs("amount") >= F.lit(huge).cast("decimal(24,2)")).alias("huge"),
        count(F.col("raw_amount").rlike("\\p{L}")).alias("wordy"), count(parse_date("raw_date").isNotNull()).alias("valid"))
    share = lambda c: F.col(c) / F.col("n")
    verdict = (
        F.when(F.col("n") < 3, "few_lines").when(share("wordy") >= 0.35, "amount_is_text").when(share("valid") < 0.30, "date_is_text").when(share("amounts") < 0.60, "few_amounts").when(share("told") < 0.40, "few_descriptions")
        .when(F.col("dated") == 0, "no_dates").when(F.col("huge") > 0, "huge_amounts").otherwise("ok")
    )
    return n.select("file", verdict.alias("verdict"))


def _line(c: dict[str, Column]) -> dict[str, Column]:
    """Facts of a line from its cells (absent fields are null)."""
    none = F.lit(None).cast("string")
    cell = lambda f: c.get(f, none)
    debit, credit = parse_number(cell("debit")), parse_number(cell("credit"))
    split = F.when(debit.isNotNull() | credit.isNotNull(), F.abs(F.coalesce(credit, F.lit(0))) - F.abs(F.coalesce(debit, F.lit(0))))
    day, other = parse_date(cell("operation_date")), parse_date(cell("value_date"))
    return {"operation_date": F.coalesce(day, other), "value_date": F.coalesce(other, day), "amount": F.coalesce(split, parse_number(cell("amount"))).cast(MONEY), "description": F.coalesce(F.trim(cell("description")), F.lit("")), "running_balance": parse_number(cell("running_balance")).cast(MONEY)}


def parse_tabulated(files: DataFrame, separator: str) -> DataFrame:
    """Exports of eight columns and more: dates in 1 and 2, text in 3, debit, credit and balance in 5 to 7. A file counts where, among
    its first 25 such rows, five or more exist and 70 percent have both dates and a debit or credit. The reference is the text's
    strong reference, else the text."""
    c = file_lines(files).withColumn("c", F.split("line", f"[{separator}]")).where("size(c) >= 8")
    cell = lambda i: F.trim(F.get("c", F.lit(i)))
    good = parse_date(cell(1)).isNotNull() & parse_date(cell(2)).isNotNull() & (parse_number(cell(5)).isNotNull() | parse_number(cell(6)).isNotNull())
    first = c.withColumns({"good": good, "k": F.row_number().over(Window.partitionBy("file").orderBy("rank"))})  # the 25 first of a file are cut off before they are dealt
    known = first.where("k <= 25").groupBy("file").agg(F.count("*").alias("n"), F.count_if("good").alias("hits")).where((F.col("n") >= 5) & (F.col("hits") >= 0.7 * F.col("n")))
    facts = _line({"operation_date": cell(1), "value_date": cell(2), "description": cell(3), "debit": cell(5), "credit": cell(6), "running_balance": cell(7)})
    rows = c.join(known.select("file"), "file", "left_semi").select("file", "rank", *[x for x in ("block",) if x in c.columns], *(v.alias(k) for k, v in facts.items())).where("operation_date is not null and amount is not null")
    ref = F.coalesce(F.nullif(extract_strong_reference("description"), F.lit("")), F.col("description"))
    return numbered(rows).withColumn("reference", ref).drop("block")


def parse_csv_aliased(files: DataFrame, separator: str, aliases: dict[str, list[str]] = ALIASES) -> DataFrame:
    """Delimited files with a heading: columns by alias, with the usual places (date, value date, -, text, amount) for what is missing."""
    header = guess_header_row(files, separator, aliases)
    named = map_by_alias(headings(files, separator, header), aliases)
    places = {"operation_date": 0, "value_date": 1, "description": 3}
    per = named.groupBy("file").agg(*(F.max(F.when(F.col("field") == f, F.col("column"))).alias(f"_{f}") for f in FIELDS))
    rows = file_lines(files).join(header, "file").where("rank > header_row").join(per, "file", "left").withColumn("c", F.split("line", f"[{separator}]"))
    lacks = F.coalesce("_amount", "_debit", "_credit").isNull()
    at = {f: F.coalesce(f"_{f}", F.lit(places.get(f))) for f in FIELDS} | {"amount": F.coalesce("_amount", F.when(lacks, F.lit(4)))}
    facts = _line({f: F.trim(F.get("c", i)) for f, i in at.items()})
    return rows.select("file", "rank", *(v.alias(k) for k, v in facts.items())).where("operation_date is not null and amount is not null")
