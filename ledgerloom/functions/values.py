"""Numbers, dates and identities as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c, fold, normalize_text, once

AMOUNT = "decimal(24,8)"


def parse_number(s: Column | str) -> Column:
    """Localised amount: brackets or a minus before or after are negative; the last of comma and point is the decimal mark;
    one mark alone, repeated or before three digits with a thousands group, groups thousands. Null where it is no number."""

    def plain(body: Column) -> Column:
        comma, dot = F.length(body) - F.locate(",", F.reverse(body)), F.length(body) - F.locate(".", F.reverse(body))
        both = F.contains(body, F.lit(",")) & F.contains(body, F.lit("."))
        many = body.rlike("^[0-9]{1,3}(,[0-9]{3}){2,}$|^[0-9]{1,3}(\\.[0-9]{3}){2,}$")
        return (
            F.when(both & (comma > dot), F.translate(body, ",.", "."))
            .when(both, F.replace(body, F.lit(","), F.lit("")))
            .when(many, F.regexp_replace(body, "[,.]", ""))
            .otherwise(F.replace(body, F.lit(","), F.lit(".")))
        )

    def signed(t: Column) -> Column:
        value = once(once(F.regexp_replace(t, "^[(+-]+|[)+-]+$", ""), plain), lambda p: F.when(p.rlike("^[0-9]+(\\.[0-9]+)?$|^\\.[0-9]+$"), p.cast(AMOUNT)))
        negative = t.rlike("^\\(.*\\)$|^-|-$")
        return once(value, lambda v: F.when(negative, -v).otherwise(v).cast(AMOUNT))

    bare = lambda x: F.when(x.rlike("^[\\d.,-]*+$"), x).otherwise(F.trim(F.regexp_replace(x, "(?i)\\b(EUR|USD|GBP)\\b|[€$£\\s]", "")))
    return once(once(_c(s), bare), signed)


def parse_cents(digits: Column | str, sign: Column | str) -> Column:
    """Implied cents: D, 1 and - are debits."""
    value = (_c(digits).cast("decimal(20,0)") / 100).cast(AMOUNT)
    return F.when(_c(sign).isin("D", "1", "-"), -value).otherwise(value).cast(AMOUNT)


def exact_decimal(s: Column | str) -> Column:
    """Strict decimal of up to 16 and 8 digits; null otherwise; minus zero is zero."""
    return F.when(_c(s).rlike("^-?[0-9]{1,16}(\\.[0-9]{1,8})?$"), _c(s).cast(AMOUNT))


def expand_year(yy: Column | str, as_of: str, ahead: int = 50) -> Column:
    """Four-digit year within ``ahead`` years after ``as_of``."""
    now = F.year(F.lit(as_of).cast("date"))
    year = now - now % 100 + _c(yy).cast("int")
    return F.when(year > now + ahead, year - 100).otherwise(year).cast("int")


def short_date(yymmdd: Column | str, pivot: int = 70) -> Column:
    """Six digits of a fixed-width format; years from ``pivot`` on are of the last century."""
    d = _c(yymmdd)
    century = F.when(F.substring(d, 1, 2).cast("int") >= pivot, "19").otherwise("20")
    return F.try_to_timestamp(F.concat(century, d), F.lit("yyyyMMdd")).cast("date")


#: Short names of months.
_MONTHS = ["jan", "fev", "mar", "abr", "mai", "jun", "jul", "ago", "set", "out", "nov", "dez"]


def parse_date(s: Column | str) -> Column:
    """Day-first dates, ISO dates, eight digits, Excel serials and named months; null where nothing fits."""

    def read(t: Column) -> Column:
        n = F.length(t)
        day = lambda y, m, d: F.concat_ws("-", *[F.substring(t, at, size) for at, size in ((y, 4), (m, 2), (d, 2))]).try_cast("date")
        short = F.concat(F.lit("20"), F.concat_ws("-", *[F.substring(t, at, 2) for at in (7, 4, 1)])).try_cast("date")
        serial = F.when(t.cast("int").between(20000, 90000), F.date_add(F.lit("1899-12-30").cast("date"), t.cast("int")))
        name = F.lower(fold(F.regexp_extract(t, "^[0-9]{1,2}[ -]([A-Za-z]{3})[a-z]*[ -][0-9]{4}$", 1)))
        month = F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), name)
        named = once(month, lambda m: F.when(m > 0, F.concat_ws("-", F.regexp_extract(t, "([0-9]{4})$", 1), m.cast("string"), F.regexp_extract(t, "^([0-9]{1,2})", 1)).try_cast("date")))
        return (  # the shape tells which form a text can have; a text is brought to ISO order and read once
            F.when((n == 10) & t.rlike("^[0-9]{2}([-/.])[0-9]{2}\\1[0-9]{4}$"), day(7, 4, 1)).when((n == 10) & t.rlike("^[0-9]{4}([-/])[0-9]{2}\\1[0-9]{2}$"), day(1, 6, 9))
            .when((n == 8) & t.rlike("^[0-9]{8}$"), F.coalesce(day(1, 5, 7), day(5, 3, 1))).when((n == 8) & t.rlike("^[0-9]{2}([-/])[0-9]{2}\\1[0-9]{2}$"), short)
            .when(t.rlike("^[0-9]{5}$"), serial).when(t.rlike("^[0-9]{1,2}[ -][A-Za-z]"), named)
        )

    first, last = (F.lit(d).cast("date") for d in ("1900-01-01", "2200-01-01"))
    return once(once(F.trim(_c(s)), read), lambda d: F.when(d.between(first, last), d))


def day_distance(a: Column | str, b: Column | str) -> Column:
    return F.abs(F.datediff(_c(a), _c(b)))


def canonical_amount(a: Column | str) -> Column:
    """Amount as text with two places."""
    return _c(a).cast("decimal(24,2)").cast("string")


def line_hash(entity: Column | str, account: Column | str, date: Column | str, amount: Column | str, *texts: Column | str) -> Column:
    """SHA-256 of the facts that make a statement line the same line: payment reference, bank reference, operation type and
    description follow the amount (statements of an earlier generation have only the first and the last)."""
    parts = [_c(entity).cast("string"), _c(account).cast("string"), _c(date).cast("string"), canonical_amount(amount), *[normalize_text(t) for t in texts]]
    return F.sha2(F.concat_ws("|", *parts), 256)


def feed_line_hash(entity: Column | str, account: Column | str, uid: Column | str) -> Column:
    """A feed line is the same line where its identity is."""
    return F.sha2(F.concat_ws("|", _c(entity).cast("string"), _c(account).cast("string"), _c(uid)), 256)


def forced_hash(hash_: Column | str, number: Column | str) -> Column:
    """The hash of an approved duplicate: of the line's hash and its number among the approved."""
    return F.sha2(F.concat_ws("|", _c(hash_), F.lit("approved"), _c(number).cast("string")), 256)


def occurrence_hash(file_hash: Column | str, sheet_row: Column | str, hash_: Column | str) -> Column:
    """The hash of a verified spreadsheet's row: the file, the row in it and the line's hash."""
    return F.sha2(F.concat_ws("|", _c(file_hash), _c(sheet_row).cast("string"), _c(hash_)), 256)


def line_uid(rank: Column | str, *facts: Column | str) -> Column:
    return F.sha1(F.concat_ws("|", _c(rank).cast("string"), *[_c(f).cast("string") for f in facts]))


def feed_uid(workspace: str, account: Column | str, tx: Column | str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(workspace), _c(account).cast("string"), _c(tx).cast("string")), 256)


def financial_hash(amount: Column | str, date: Column | str, currency: Column | str) -> Column:
    return F.sha2(F.concat_ws("|", canonical_amount(amount), _c(date).cast("string"), _c(currency)), 256)


def decimal_add(a: Column | str, b: Column | str) -> Column:
    return (_c(a).cast(AMOUNT) + _c(b).cast(AMOUNT)).cast(AMOUNT)


def decimal_sub(a: Column | str, b: Column | str) -> Column:
    return (_c(a).cast(AMOUNT) - _c(b).cast(AMOUNT)).cast(AMOUNT)


def decimal_mul(a: Column | str, b: Column | str) -> Column:
    """Exact product to eight places."""
    return (_c(a).cast("decimal(19,4)") * _c(b).cast("decimal(18,4)")).cast("decimal(38,8)")


def decimal_cmp(a: Column | str, b: Column | str) -> Column:
    """-1, 0 or 1."""
    return F.signum(decimal_sub(a, b)).cast("int")


def decimal_abs(a: Column | str) -> Column:
    return F.abs(_c(a).cast(AMOUNT))


def decimal_neg(a: Column | str) -> Column:
    return (-_c(a).cast(AMOUNT)).cast(AMOUNT)
