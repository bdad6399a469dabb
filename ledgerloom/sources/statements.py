"""Parsers of statement files.

Every parser is a function of a table, so a whole directory is read in one job: of (file, content) with whole files
(``read_files``), or of the lines or movements of files read in splits (``records.read_lines``, ``records.read_movements``), where a
large file is work for many tasks. A line's rank is its place in its file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import extract_iban, extract_strong_reference, header_key, iban_norm, once
from ..functions.values import line_uid, parse_date, parse_number, short_date
from .records import carried, numbered

MONEY = "decimal(18,2)"
_PARTY = "struct<Nm: string>"
_ACCOUNT = "struct<Id: struct<IBAN: string>>"
_DAY = "struct<Dt: string, DtTm: string>"
#: What is read of an ISO 20022 entry; of several transaction details the first counts.
CAMT = f"""Amt struct<_VALUE: string, _Ccy: string>, CdtDbtInd string, BookgDt {_DAY}, ValDt {_DAY}, AcctSvcrRef string, NtryRef string, AddtlNtryInf string,
 NtryDtls struct<TxDtls: array<struct<Refs: struct<EndToEndId: string>, RltdPties: struct<Dbtr: {_PARTY}, Cdtr: {_PARTY}, DbtrAcct: {_ACCOUNT}, CdtrAcct: {_ACCOUNT}>, RmtInf: struct<Ustrd: array<string>>>>>"""


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, content) of the text files under ``path``."""
    return decode_text(spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content"))


def decode_text(files: DataFrame) -> DataFrame:
    """Bytes as text: UTF-8 and UTF-16 by mark, UTF-16 by zero bytes, UTF-8 where valid, else Latin-1."""
    head, size = F.hex(F.substring("content", 1, 3)), F.octet_length("content")
    raw = F.hex("content")
    odd = F.length(F.regexp_replace(F.substring(raw, 1, 4000), "(..)(00)", "$1"))
    zeros = (F.least(F.length(raw), F.lit(4000)) - odd) / 2 >= F.least(size, F.lit(2000)) * 0.2
    plain = F.decode("content", "ISO-8859-1")
    utf8 = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    text = (
        F.when(head.startswith("EFBBBF"), F.substring("content", 4, 1 << 30).cast("string"))
        .when(head.startswith("FFFE") | head.startswith("FEFF"), F.decode("content", "UTF-16"))
        .when(zeros, F.decode("content", "UTF-16LE"))
        .otherwise(F.coalesce(utf8, plain))
    )
    return files.withColumn("content", text)


def file_lines(files: DataFrame, most: int | None = None) -> DataFrame:
    """(file, rank, line) with the line's place in its file, from 0; lines that were read as such stay. With ``most`` the first lines only:
    what follows them is not cut into lines."""
    if "line" in files.columns:
        return files if most is None else files.where(F.col("rank") < most)
    lines = F.split("content", "\\r?\\n") if most is None else F.slice(F.split("content", "\\r?\\n", most + 1), 1, most)
    return files.select("file", F.posexplode(lines).alias("rank", "line"))


def parse_camt(files: DataFrame, currency: str = "EUR") -> DataFrame:
    """ISO 20022 account statements: one line an entry of any statement of the file, whatever namespace prefix it has.

    Debits are negative; the other side of a debit is the creditor, of a credit the debtor.
    """
    bare = lambda c: F.regexp_replace(c, "<(/?)[\\w.-]+:", "<$1")
    if "piece" in files.columns:  # an entry ends where the next mark is a closing tag; an opening tag with attributes is no mark
        ends = files.where(F.col("piece").rlike("</([\\w.-]+:)?$"))
        after = lambda x: F.when(x.rlike("<Ntry\\s"), F.regexp_replace(x, "(?s)^.*<Ntry\\s[^>]*>", "")).otherwise(x)
        inner = F.substring_index(once(bare(F.regexp_replace("piece", "</([\\w.-]+:)?$", "")), after), "<Ntry>", -1)
        entries = numbered(ends).select("file", "rank", F.concat(F.lit("<Ntry>"), inner, F.lit("</Ntry>")).alias("x"))
    else:
        entries = files.select("file", F.posexplode(F.regexp_extract_all(bare("content"), F.lit("(?s)<Ntry(?:\\s[^>]*)?>.*?</Ntry>"), 0)).alias("rank", "x"))
    rows = entries.select("file", "rank", F.from_xml("x", CAMT, {"ignoreNamespace": "true"}).alias("e")).withColumn("t", F.get("e.NtryDtls.TxDtls", F.lit(0)))
    debit = F.upper("e.CdtDbtInd") == "DBIT"
    amount = F.abs(F.col("e.Amt._VALUE").cast(MONEY))
    raw = lambda c: F.coalesce(F.nullif(F.col(f"e.{c}.Dt"), F.lit("")), F.col(f"e.{c}.DtTm"))
    day = lambda c: parse_date(F.substring(raw(c), 1, 10))
    side = lambda c: F.coalesce(F.when(debit, F.col(f"t.RltdPties.Cdtr{c}")).otherwise(F.col(f"t.RltdPties.Dbtr{c}")), F.lit(""))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    told = F.trim(F.concat_ws(" ", text("e.AddtlNtryInf"), F.get("t.RmtInf.Ustrd", F.lit(0))))
    paid = F.coalesce(F.nullif(F.col("t.Refs.EndToEndId"), F.lit("")), text("e.AcctSvcrRef"))
    out = rows.select(
        "file", "rank", day("BookgDt").alias("operation_date"), F.coalesce(day("ValDt"), day("BookgDt")).alias("value_date"), F.when(debit, -amount).otherwise(amount).cast(MONEY).alias("amount"),
        F.upper(F.coalesce(F.nullif(F.col("e.Amt._Ccy"), F.lit("")), F.lit(currency))).alias("currency"), side(".Nm").alias("counterparty_name"), iban_norm(side("Acct.Id.IBAN")).alias("counterparty_iban"),
        told.alias("description"), paid.alias("payment_reference"), text("e.NtryRef").alias("reference"), raw("BookgDt").alias("_raw"))
    return out.withColumn("line_uid", line_uid("rank", "_raw", "amount", "payment_reference", "reference")).drop("_raw")


def parse_ofx(files: DataFrame) -> DataFrame:
    """OFX transaction blocks; blocks without a readable amount are left out."""
    if "piece" in files.columns:
        closed = files.where((F.col("rank") > 0) & F.contains("piece", F.lit("</STMTTRN>")))
        blocks = numbered(closed).select("file", "rank", F.substring_index("piece", "</STMTTRN>", 1).alias("b"))
    else:
        blocks = files.select("file", F.posexplode(F.regexp_extract_all("content", F.lit("(?s)<STMTTRN>(.*?)</STMTTRN>"), 1)).alias("rank", "b"))
    tag = lambda t: F.trim(F.regexp_extract("b", f"<{t}>([^<\\r\\n]*)", 1))
    rows = blocks.select("file", "rank", F.to_date(F.substring(tag("DTPOSTED"), 1, 8), "yyyyMMdd").alias("operation_date"), F.when(tag("TRNAMT").rlike("^-?[0-9]+([.][0-9]+)?$"), tag("TRNAMT").cast(MONEY)).alias("amount"), tag("FITID").alias("reference"), F.trim(F.concat_ws(" ", tag("MEMO"), tag("NAME"))).alias("description"))
    return rows.where("amount is not null")


def _pieces(files: DataFrame, mark: str) -> DataFrame:
    """(file, rank, piece) of a file cut before every line that starts with ``mark``; pieces that were read as such get their mark again."""
    if "piece" in files.columns:
        return files.withColumn("piece", F.when(F.col("rank") > 0, F.concat(F.lit(mark), "piece")).otherwise(F.col("piece")))
    return files.select("file", F.posexplode(F.split("content", f"\\r?\\n(?={mark})")).alias("rank", "piece"))


def _moves(files: DataFrame, mark: str) -> DataFrame:
    """The pieces that start with ``mark``, without it, counted from 0."""
    rows = numbered(_pieces(files, mark).where(F.col("piece").startswith(mark)))
    return rows.withColumn("piece", F.substring("piece", len(mark) + 1, 1 << 30))


def parse_mt940(files: DataFrame) -> DataFrame:
    """Tagged statements: each :61: opens a movement, :86: lines after it are its text; RC is negative and RD positive."""
    moves = _moves(files, ":61:")
    tags = F.split("piece", "\\r?\\n(?=:[0-9]{2}[A-Z]?:)")
    texts = F.transform(F.filter(tags, lambda t: t.startswith(":86:")), lambda t: F.regexp_replace(F.substring(t, 5, 1 << 30), "\\r?\\n", " "))
    rows = moves.select("file", "rank", F.regexp_replace(F.get(tags, F.lit(0)), "\\r?\\n", " ").alias("m"), F.array_max(texts).alias("description"))
    pattern = "^([0-9]{6})([0-9]{4})?(RC|RD|C|D)[A-Z]?([0-9]+),([0-9]{0,2})[A-Z][A-Z0-9]{3}([^/]*)(//(.*))?"
    part = lambda i: F.regexp_extract("m", pattern, i)
    value = short_date(part(1))
    entry = F.when(part(2) != "", F.try_to_timestamp(F.concat(F.year(value).cast("string"), part(2)), F.lit("yyyyMMdd")).cast("date"))
    apart = F.datediff(entry, value)
    booked = F.when(apart > 180, F.add_months(entry, -12)).when(apart < -180, F.add_months(entry, 12)).otherwise(F.coalesce(entry, value))
    amount = F.concat_ws(".", part(4), F.rpad(part(5), 2, "0")).cast(MONEY)
    signed = F.when(part(3).isin("D", "RC"), -amount).otherwise(amount)
    return rows.select("file", "rank", booked.alias("operation_date"), value.alias("value_date"), signed.cast(MONEY).alias("amount"), F.trim(part(6)).alias("reference"), "description")


def parse_norma43(files: DataFrame, currency: str = "EUR") -> DataFrame:
    """Fixed-width records of all three variants: 11 sets the currency (978 is EUR), 22 opens a movement (dates at 10 and 16, sign
    at 27, cents at 28, reference at 42, text from 52), 23 continues its text, 24 overrides its currency (at 4), 33 and 88 close it.

    The IBAN is the last one in the text; without a reference the strong reference of the text stands in.
    """
    money = lambda c: F.when(c == "978", "EUR").otherwise(c)
    lines = F.split("piece", "\\r?\\n")
    heads = F.filter(F.transform(F.filter(lines, lambda x: x.startswith("11")), lambda x: F.regexp_extract(x, "(978|[A-Z]{3})\\s*[0-9]*\\s*$", 1)), lambda x: x != "")
    told = carried(_pieces(files, "22"), "rank", F.try_element_at(heads, F.lit(-1)), inclusive=False)  # a register 11 counts for the movements after it
    rows = numbered(told.where(F.col("piece").startswith("22"))).withColumn("lines", lines)
    shut = F.array_position(F.transform("lines", lambda x: x.rlike("^(33|88)")), F.lit(True))
    own = F.when(shut > 0, F.slice("lines", F.lit(1), (shut - 1).cast("int"))).otherwise(F.col("lines"))
    part = lambda code: F.filter(F.transform(F.filter(own, lambda x: x.startswith(code)), lambda x: F.struct(F.trim(F.regexp_replace(F.substring(x, 5, 200), "\\s+", " ")).alias("t"))), lambda x: x["t"] != "")
    rows = rows.select("file", "rank", F.get("lines", F.lit(0)).alias("m"), F.col("carried").alias("head"), part("23").alias("more"), part("24").alias("override"))
    at = lambda i, n: F.substring("m", i + 1, n)
    cents = (at(28, 14).cast("decimal(14,0)") / 100).cast(MONEY)
    words = F.transform("more", lambda x: x["t"])
    rows = rows.withColumn("description", F.concat_ws(" ", F.nullif(F.trim(F.regexp_replace(at(52, 200), "\\s+", " ")), F.lit("")), words))
    ibans = F.filter(F.transform(words, extract_iban), lambda x: x != "")
    own = F.element_at(F.transform("override", lambda x: F.substring(x["t"], 1, 3)), -1)
    override = F.when(F.size("override") > 0, own)
    ref = F.coalesce(F.nullif(F.trim(at(42, 10)), F.lit("")), extract_strong_reference("description"))
    iban = F.coalesce(F.nullif(extract_iban("description"), F.lit("")), F.when(F.size(ibans) > 0, F.element_at(ibans, -1)), F.lit(""))
    booked = short_date(at(10, 6))
    out = rows.select(
        "file", "rank", booked.alias("operation_date"), F.coalesce(short_date(at(16, 6)), booked).alias("value_date"), F.when(at(27, 1) == "1", -cents).otherwise(cents).cast(MONEY).alias("amount"),
        money(F.coalesce(override, "head", F.lit(currency))).alias("currency"), ref.alias("reference"), iban.alias("counterparty_iban"), "description")
    return out.where("operation_date is not null and amount is not null")


def parse_mapped(files: DataFrame, mapping: dict[str, int], separator: str = ";") -> DataFrame:
    """Delimited rows with named columns (date, value, description, debit, credit, amount, balance); headings and empty rows go."""
    cells = file_lines(files).withColumn("c", F.split("line", f"[{separator}]"))
    cell = lambda k: F.trim(F.get("c", F.lit(mapping[k]))) if k in mapping else F.lit(None).cast("string")
    debit, credit, amount = parse_number(cell("debit")), parse_number(cell("credit")), parse_number(cell("amount"))
    either = debit.isNotNull() | credit.isNotNull()
    value = F.when(either, F.coalesce(F.abs(credit), F.lit(0)) - F.coalesce(F.abs(debit), F.lit(0))).otherwise(amount)
    day, other = parse_date(cell("date")), parse_date(cell("value"))
    rows = cells.select("file", "rank", F.coalesce(day, other).alias("operation_date"), F.coalesce(other, day).alias("value_date"), value.cast(MONEY).alias("amount"), cell("description").alias("description"), parse_number(cell("balance")).cast(MONEY).alias("running_balance"))
    return rows.where("operation_date is not null and amount is not null and (amount <> 0 or coalesce(description, '') <> '')")


def detect_format(files: DataFrame, sample: int = 200) -> DataFrame:
    """(file, format) of every file from its first lines: a cascade of signatures, the surest first; for formats whose lines have no mark
    the file's name may tell."""
    lines = file_lines(files, sample).where("trim(line) <> ''")
    hits = lambda p: F.count_if(F.col("line").rlike(p))
    table = lambda d: F.count_if((F.size(F.split("line", f"[{d}]")) >= 8) & parse_date(F.get(F.split("line", f"[{d}]"), F.lit(1))).isNotNull())
    record = lambda codes: f"^({codes})\\s*[0-9A-Z]{{6,}}"  # noqa: E731  a day of the month at the start of a line is no record
    n = lines.groupBy("file").agg(
        hits("<(\\p{Alnum}+:)?(Document|BkToCstmrStmt|Ntry)\\b").alias("camt"), hits("<(OFX|STMTTRN)>").alias("ofx"), hits("^:61:").alias("t61"), hits("^:(20|25|28|60[FM]?|61|86)").alias("tags"),
        hits(record("11|22|23|24|33|88")).alias("n43"), hits(record("24")).alias("r24"), F.count_if(F.col("line").rlike(record("11")) & F.col("line").rlike("978\\s*[0-9]*\\s*$")).alias("r978"), hits("^[0-9]{8} .* [0-9]+[.,][0-9]{2}[CD] [0-9]+[.,][0-9]{2}[CD]$").alias("bit"), hits("^03.*[+-][0-9]{18}").alias("cons"),
        hits("^5[0-9]{12}").alias("nib"), hits("^EMC(13|23)").alias("emc"), table(";,").alias("sheet"), table("\t").alias("tsv"), hits(";").alias("semi"), hits("\t").alias("tab"), hits(",").alias("comma"))
    records = F.col("n43") >= 3
    name = F.lower(F.element_at(F.split("file", "/"), -1))
    told = lambda *words: F.array_contains(F.array(*(F.contains(name, F.lit(x)) for x in words)), True)
    kind = (
        F.when(F.col("camt") > 0, "camt053").when(F.col("ofx") > 0, "ofx").when((F.col("t61") > 0) & (F.col("tags") >= 3), "mt940")
        .when(records & ((F.col("r24") > 0) | told("registo 24", "registo24")), "norma43_r24").when(records & ((F.col("r978") > 0) | told("978")), "norma43_978").when(records, "norma43")
        .when((F.col("bit") >= 2) | told("bit reconcilia", "bit_recon"), "bit_recon").when((F.col("cons") >= 2) | told("consolidado"), "consolidated")
        .when((F.col("nib") >= 2) | told("composto com nib", "composto_nib", "nib_composto"), "nib_compound").when((F.col("emc") >= 2) | name.rlike("(^|[^a-z])emc([^a-z]|$)"), "emc")
        .when(F.col("sheet") >= 3, "tabulated").when(F.col("tsv") >= 3, "tabulated_tsv").when(F.col("tab") >= 2, "tsv").when((F.col("semi") >= 2) | (F.col("comma") >= 2), "csv").otherwise("unknown")
    )
    return n.select("file", kind.alias("format"))


def detect_delimiter(files: DataFrame) -> DataFrame:
    """(file, delimiter): most consistent number of fields over the first ten lines, then lines and total."""
    lines = file_lines(files).where("trim(line) <> ''")
    w = Window.partitionBy("file").orderBy("rank")
    first = lines.withColumn("k", F.row_number().over(w)).where("k <= 10")
    each = first.withColumn("d", F.explode(F.array(*[F.lit(x) for x in (";", ",", "\t", "|")]))).withColumn("f", F.length("line") - F.length(F.replace("line", F.col("d"), F.lit(""))))
    per = each.where("f > 0").groupBy("file", "d", "f").agg(F.count("*").alias("same"))
    score = per.groupBy("file", "d").agg((F.max(F.struct("same", "f"))["f"] * 100 + F.sum("same") * 10 + F.sum(F.col("same") * F.col("f"))).alias("score"))
    return score.groupBy("file").agg(F.max_by("d", F.struct("score", "d")).alias("delimiter"))


def explode_evidence(statements: DataFrame) -> DataFrame:
    """Statement evidence (statement_id, account_id, direction, lines array of line_id, day, amount) to rows, oldest first; a statement
    with repeated ids or falling dates is refused, and the last statement wins for a line."""
    oldest = F.when(F.col("direction") == "DESC", F.reverse("lines")).otherwise(F.col("lines"))
    ids = F.transform("lines", lambda y: y["line_id"])
    once = statements.where(F.size(F.array_distinct(ids)) == F.size("lines"))  # judged once a statement, before it is cut into rows
    flat = once.select("statement_id", "account_id", F.posexplode(oldest).alias("pos", "x")).select("statement_id", "account_id", (F.col("pos") + 1).alias("sequence"), "x.*")
    falls = F.lag("day").over(Window.partitionBy("statement_id").orderBy("sequence")) > F.col("day")
    judged = flat.withColumn("_f", F.coalesce(falls, F.lit(False))).withColumn("_bad", F.bool_or("_f").over(Window.partitionBy("statement_id")))
    good = judged.where("not _bad")
    last = F.row_number().over(Window.partitionBy("account_id", "line_id").orderBy(F.desc("statement_id")))
    return good.withColumn("_k", last).where("_k = 1").select("statement_id", "account_id", "sequence", "line_id", "day", "amount")


def profile_cells(cells: DataFrame) -> DataFrame:
    """Per (file, column) of cells (file, column, cell): filled, numeric, dates, text, negative, positive, zero and other cells, mean length."""
    c = cells.where("trim(cell) <> ''").withColumn("cell", F.trim("cell")).withColumns({"v": parse_number("cell"), "d": parse_date("cell")})
    return c.groupBy("file", "column").agg(
        F.count("*").alias("filled"), F.count("v").alias("numeric"), F.count("d").alias("dates"), F.count_if(F.col("cell").rlike("\\p{L}")).alias("text"), F.count_if(F.col("v") < 0).alias("negative"), F.count_if(F.col("v") > 0).alias("positive"),
        F.count_if(F.col("v") == 0).alias("zero"), F.count_if(F.col("v") != 0).alias("non_zero"), F.avg(F.length("cell")).alias("mean_length"))


def profile_columns(files: DataFrame, separator: str, rows: int = 220) -> DataFrame:
    """``profile_cells`` of the first data rows after the heading."""
    return profile_cells(file_lines(files, rows + 1).where("rank >= 1").select("file", F.posexplode(F.split("line", f"[{separator}]")).alias("column", "cell")))


def layout_fingerprint(files: DataFrame, separator: str) -> DataFrame:
    """(file, fingerprint) of the heading and the widths of the first five rows."""
    lines = file_lines(files).where("rank < 6").withColumn("w", F.size(F.split("line", f"[{separator}]")))
    head = F.max(F.when(F.col("rank") == 0, header_key("line")))
    widths = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") > 0, F.struct("rank", "w")))), lambda x: x["w"].cast("string")), ",")
    return lines.groupBy("file").agg(head.alias("h"), widths.alias("s")).select("file", F.sha2(F.concat_ws("|", "h", "s"), 256).alias("fingerprint"))


def joined(rows: DataFrame, by: list[str], order: str, text: Column, head: str = "", tail: str = "", between: str = "\n") -> DataFrame:
    """(file, content): a group's texts in order as one file."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text.alias("t")))), lambda x: x["t"]), between)
    return rows.groupBy(*by).agg(body.alias("b")).select(F.concat_ws("-", *by).alias("file"), F.concat(F.lit(head), F.col("b"), F.lit(tail)).alias("content"))


def _movements(files: DataFrame, pattern: str, groups: int) -> DataFrame:
    """Lines of a file that fit a whole-line pattern: file, rank among them, and the groups g1..gn."""
    rows = numbered(file_lines(files).where(F.col("line").rlike(pattern)))
    return rows.select("file", "rank", *[F.regexp_extract("line", pattern, i).alias(f"g{i}") for i in range(1, groups + 1)])


def parse_nib_compound(files: DataFrame) -> DataFrame:
    """5 + two short dates, text at 13-42, operation code at 43-45, cents and a last sign."""
    m = _movements(files, "^5([0-9]{6})([0-9]{6})(.{30})(.{3}).*?([+-])([0-9]+)$", 6)
    cents = (F.col("g6").cast("decimal(18,0)") / 100).cast(MONEY)
    return m.select("file", "rank", short_date("g1").alias("operation_date"), short_date("g2").alias("value_date"), F.when(F.col("g5") == "-", -cents).otherwise(cents).cast(MONEY).alias("amount"), F.trim("g3").alias("description"), F.trim("g4").alias("operation"))


def parse_consolidated(files: DataFrame) -> DataFrame:
    """03 lines: blocks of 18 signed digits in cents; of three or more the last is the balance and the one before the movement."""
    rows = file_lines(files).where("line like '03%'")
    blocks = F.regexp_extract_all("line", F.lit("([+-])([0-9]{18})"), 0)
    value = lambda b: (F.substring(b, 2, 18).cast("decimal(18,0)") / 100 * F.when(F.substring(b, 1, 1) == "-", -1).otherwise(1)).cast(MONEY)
    rows = numbered(rows.withColumn("b", blocks).where("size(b) > 0"))
    n = F.size("b")
    movement = F.when(n >= 3, F.element_at("b", -2)).otherwise(F.element_at("b", -1))
    days = F.regexp_extract_all(F.substring("line", 11, 200), F.lit("  ([0-9]{8})"), 1)
    day = lambda i: F.try_to_timestamp(F.get(days, F.lit(i)), F.lit("yyyyMMdd")).cast("date")
    return rows.select("file", "rank", day(0).alias("operation_date"), F.coalesce(day(1), day(0)).alias("value_date"), value(movement).alias("amount"), F.when(n >= 3, value(F.element_at("b", -1))).alias("running_balance"))


def parse_bit_recon(files: DataFrame) -> DataFrame:
    """Lines of date, text, amount with C or D, and balance with C or D."""
    m = _movements(files, "^([0-9]{8}) (.*?) ([0-9]+[.,][0-9]{2})([CD]) ([0-9]+[.,][0-9]{2})([CD])$", 6)
    value = lambda a, s: (F.translate(a, ",", ".").cast(MONEY) * F.when(F.col(s) == "D", -1).otherwise(1)).cast(MONEY)
    return m.select("file", "rank", F.try_to_timestamp("g1", F.lit("yyyyMMdd")).cast("date").alias("operation_date"), value("g3", "g4").alias("amount"), value("g5", "g6").alias("running_balance"), F.trim("g2").alias("description"))


def parse_emc(files: DataFrame) -> DataFrame:
    """EMC13 sets the currency; EMC23 is a movement with a pair of signs (any D is a debit), 16 digits of cents and a text."""
    rows = file_lines(files).where("line rlike '^EMC(13|23)'")
    told = carried(rows, "rank", F.when(F.col("line").startswith("EMC13"), F.substring("line", 6, 3)))
    rows = numbered(told.withColumnRenamed("carried", "currency").where("line like 'EMC23%'"))
    cents = (F.substring("line", 16, 16).cast("decimal(16,0)") / 100).cast(MONEY)
    debit = F.contains(F.substring("line", 14, 2), F.lit("D"))
    return rows.select("file", "rank", F.try_to_timestamp(F.substring("line", 6, 8), F.lit("yyyyMMdd")).cast("date").alias("operation_date"), F.when(debit, -cents).otherwise(cents).cast(MONEY).alias("amount"), "currency", F.trim(F.substring("line", 32, 200)).alias("description"))


def normalize_lines(lines: DataFrame, currency: str) -> DataFrame:
    """Missing dates from each other, missing currency, direction from the sign, and a rank-based identity."""
    day, value = F.coalesce("operation_date", "value_date"), F.coalesce("value_date", "operation_date")
    out = lines.withColumns({"operation_date": day, "value_date": value, "currency": F.coalesce(F.nullif("currency", F.lit("")), F.lit(currency))})
    return out.withColumn("direction", F.signum("amount").cast("int")).withColumn("line_uid", F.sha1(F.concat_ws("|", F.col("rank").cast("string"), F.col("operation_date").cast("string"), F.col("amount").cast("string"), "description")))


def repair_balance(lines: DataFrame) -> DataFrame:
    """Where a large amount stands beside a text that is only a much smaller decimal, that decimal is the amount and the amount
    was the balance."""
    other = F.when(F.col("description").rlike("^-?[0-9]{1,5}([.,][0-9]{1,2})$"), parse_number("description").cast(MONEY))
    wrong = (F.abs("amount") >= 100) & (F.abs(other) <= 10000) & (F.abs(other) * 5 <= F.abs("amount"))
    wrong = F.coalesce(wrong, F.lit(False))
    return lines.select("*", wrong.alias("_w"), other.alias("_o")).withColumns({
        "running_balance": F.when(F.col("_w"), F.col("amount")), "amount": F.when(F.col("_w"), F.col("_o")).otherwise(F.col("amount")).cast(MONEY),
        "description": F.when(F.col("_w"), "").otherwise(F.col("description"))}).drop("_w", "_o")
