"""Queries of the bank feed."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import summaries as A
from ..sources.erp import shared_path
from ..streaming import feed as N
from . import views as W
from .registry import query

M = W.MONEY


@query("""with f as (select c_custkey as feed_id, 'PT' || lpad(cast(case when c_custkey <= 30 then c_custkey else c_custkey % 40 end as varchar(10)), 2, '0') as iban from customer), n as (select *, count(*) over (partition by iban) as c from f),
 a as (select n_nationkey + 1 as account_id, 'PT' || lpad(cast(n_nationkey + 1 as varchar(10)), 2, '0') as iban, n_nationkey % 9 = 8 as closed from nation)
 select feed_id, case when account_id is null then 'unavailable' when c > 1 or closed then 'mapping_review' else 'mapped' end as state, case when not (c > 1 or closed) then account_id end as account_id from n left join a using (iban)""", base=False)
def n1_map_accounts(spark, sf_dir):
    """Every customer is a feed account."""
    iban = lambda c: F.concat(F.lit("PT"), F.lpad(c.cast("string"), 2, "0"))
    k = F.col("c_custkey")
    feed = W.table(spark, sf_dir, "customer").select(k.alias("feed_id"), iban(F.when(k <= 30, k).otherwise(k % 40)).alias("iban"), F.lit("EUR").alias("currency"))
    accounts = W.table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).alias("account_id"), iban(F.col("n_nationkey") + 1).alias("iban"), F.lit("EUR").alias("currency"), (F.col("n_nationkey") % 9 == 8).alias("closed"))
    return N.map_accounts(feed, accounts)


@query("select event_id, case when event_id % 10 = 0 then 'pending' when event_id % 11 = 0 then 'amount' when event_id % 13 = 0 then 'date' end as problem from events", base=False)
def n2_validate(spark, sf_dir):
    k = F.col("event_id")
    tx = W.table(spark, sf_dir, "events").select("event_id", (k % 10 == 0).alias("pending"), F.when(k % 11 == 0, "1e5").otherwise(F.col("value").cast(M).cast("string")).alias("amount_text"), F.when(k % 13 == 0, "2024-02-31").otherwise(F.col("ts").cast("date").cast("string")).alias("date_text"))
    return N.validate(tx).select("event_id", "problem")


def _tx(spark, sf_dir):
    return W.table(spark, sf_dir, "events").select(F.col("event_id").alias("tx_id"), (F.col("user_id") % 25 + 1).alias("account_id"), F.col("value").cast(M).alias("amount"), F.col("ts").cast("date").alias("day"), F.col("event_type").alias("description"), F.lit(1).alias("version"))


@query("select event_id as tx_id, cast(value as decimal(18,2)) as amount, event_type || case when event_id % 30 = 0 then '' when event_id % 3 = 0 and event_id % 2 = 0 and event_id % 20 <> 0 then ' (new)' else '' end as description, case when event_id % 3 = 2 then 'kept' when event_id % 3 = 1 then 'new' when event_id % 20 = 0 then 'review' when event_id % 2 = 0 and event_id % 30 <> 0 then 'described' else 'unchanged' end as outcome, case when event_id % 60 = 0 then cast(cast(value as decimal(18,2)) + 1 as decimal(18,2)) end as conflict_amount from events", base=False)
def n3_upsert(spark, sf_dir):
    """A third is only known, a third only arrives; of the rest every 20th changes its amount and other even ones their text."""
    tx = _tx(spark, sf_dir)
    k = F.col("tx_id")
    money, text = k % 20 == 0, (k % 2 == 0) & (k % 30 != 0) & (k % 20 != 0) & (k % 3 == 0)
    new = tx.where("tx_id % 3 <> 2").withColumn("amount", F.when(money & (k % 3 == 0), F.col("amount") + 1).otherwise(F.col("amount")).cast(M)).withColumn("description", F.when(text, F.concat("description", F.lit(" (new)"))).otherwise(F.col("description"))).withColumn("version", F.lit(2))
    return N.upsert(tx.where("tx_id % 3 <> 1"), new).select("tx_id", "amount", "description", "outcome", F.col("conflict.amount").alias("conflict_amount"))


@query("""with e as (select event_id as k, cast(value as decimal(18,2)) as amount from events)
 select k as tx_id, case when k % 6 = 5 or k % 6 = 4 then null when k % 6 = 2 then k + 1000000000 else k end as known_id, case when k % 6 = 5 then 'ambiguous' when k % 6 = 4 then (case when k % 5 = 0 or amount = 0 then 'zero' else 'new' end) when k % 6 = 3 then 'review' when k % 6 = 1 then 'described' else 'unchanged' end as outcome,
  k % 6 = 4 and k % 5 <> 0 and amount <> 0 as staged from e""", base=False)
def n3_identities(spark, sf_dir):
    """Known by id, by a current or previous external id, by two that disagree, or not at all; amounts and texts change for some."""
    t = W.table(spark, sf_dir, "events").select(F.col("event_id").alias("k"), F.col("value").cast(M).alias("amount"), F.col("ts").cast("date").alias("day"), F.col("event_type").alias("description"))
    k = F.col("k")
    m, x = k % 6, k.cast("string")
    state = t.where(m != 4).select(F.when(m == 2, k + 1000000000).otherwise(k).alias("tx_id"), F.concat(F.lit("x"), x).alias("external"), "amount", "day", "description")
    twin = t.where(m == 5).select((k + 2000000000).alias("tx_id"), F.concat(F.lit("y"), x).alias("external"), "amount", "day", "description")
    batch = t.select(k.alias("tx_id"), F.when(m == 5, F.concat(F.lit("y"), x)).when(m == 0, "").otherwise(F.concat(F.lit("new"), x)).alias("external"), F.when(m == 2, F.concat(F.lit("x"), x)).otherwise("").alias("previous"),
                     F.when(m == 3, F.col("amount") + 1).when((m == 4) & (k % 5 == 0), 0).otherwise(F.col("amount")).cast(M).alias("amount"), "day", F.when(m == 1, F.concat("description", F.lit("!"))).otherwise(F.col("description")).alias("description"))
    s = state.unionByName(twin)
    return N.outcomes(s, N.identified(s, batch))


@query("select event_id as tx_id, case when event_id % 4 = 0 then 'kept' when event_id % 4 = 1 then 'new' else 'described' end as outcome, case when event_id % 4 = 0 then event_type else event_type || ' 2' end as description from events", base=False)
def n3_upsert_stream(spark, sf_dir):
    """Landed pages applied one after the other, and a restart that finds nothing new; a quarter is only known, a quarter only arrives."""
    tx = _tx(spark, sf_dir)
    path = shared_path(spark, "upsert")
    new = tx.where("tx_id % 4 <> 0").withColumns({"description": F.concat("description", F.lit(" 2")), "version": F.lit(2)})
    new.write.parquet(f"{path}/landed")
    start = tx.where("tx_id % 4 <> 1").withColumn("outcome", F.lit("kept"))
    for _ in range(2):
        out = N.upsert_stream(spark.readStream.schema(new.schema).parquet(f"{path}/landed"), path, start)
    return out.select("tx_id", "outcome", "description")


#: Collections of ten transactions a page, an account's in one run; of every fifth account the last page fails, every seventh gets a cursor again.
PAGES = """e as (select user_id as account_id, event_id, ts, row_number() over (partition by user_id order by event_id) - 1 as k, count(*) over (partition by user_id) as n from events),
 p as (select account_id, k // 10 as page, (max(n) - 1) // 10 as last from e group by 1, 2)"""


def feed_pages(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("account_id")
    e = W.table(spark, sf_dir, "events").select(F.col("user_id").cast("bigint").alias("account_id"), F.col("event_id").alias("tx_id"), F.col("value").cast(M).alias("amount"), F.col("ts").cast("date").alias("day"), F.col("event_type").alias("description"))
    e = e.withColumns({"k": F.row_number().over(w.orderBy("tx_id")) - 1, "n": F.count("*").over(w)})
    tx = F.struct(F.col("tx_id").cast("bigint").alias("tx_id"), "amount", "day", "description", F.lit(1).alias("version"))
    p = e.withColumns({"page": F.floor(F.col("k") / 10), "last": F.floor((F.col("n") - 1) / 10)}).groupBy("account_id", "page").agg(F.first("last").alias("last"), F.collect_list(tx).alias("data"))
    name = lambda k: F.concat(F.lit("c"), k.cast("string"))
    again = (F.col("account_id") % 7 == 0) & (F.col("page") == F.col("last")) & (F.col("last") > 0)
    p = p.withColumns({"cursor": F.when(F.col("page") > 0, name(F.col("page"))), "next_cursor": F.when(again, name(F.col("page"))).when(F.col("page") < F.col("last"), name(F.col("page") + 1))})
    return p.where("account_id % 5 <> 0 or page < last or last = 0").drop("last")


@query(f"""with {PAGES} select account_id, count(*) as pages, case when account_id % 7 = 0 and max(last) > 0 and account_id % 5 <> 0 then 'repeated_cursor' when account_id % 5 = 0 and max(last) > 0 then 'cut' else 'complete' end as state,
  case when (account_id % 7 = 0 or account_id % 5 = 0) and max(last) > 0 then case when account_id % 2 = 0 then timestamp '2024-01-01 00:00:00' end else timestamp '2024-02-01 00:00:00' end as watermark
 from p where account_id % 5 <> 0 or page < last or last = 0 group by account_id""", base=False)
def n4_watermarks(spark, sf_dir):
    """Cursors and watermarks of a collection; every second account has collected before."""
    pages = feed_pages(spark, sf_dir)
    marks = pages.select("account_id").distinct().where("account_id % 2 = 0").withColumn("watermark", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return N.judged_runs(pages, marks, "2024-02-01 00:00:00").select("account_id", "pages", "state", F.col("watermark").cast("timestamp_ntz").alias("watermark"))


@query(f"""with {PAGES} select event_id as tx_id, account_id, cast(value as decimal(18,2)) as amount, 'new' as outcome from e join events using (event_id) join (select account_id, max(last) as last from p group by 1) using (account_id) where last = 0 or (account_id % 5 <> 0 and account_id % 7 <> 0)""", base=False)
def n4_collect_feed(spark, sf_dir):
    """What a collection that is tried again leaves in the feed: the transactions of accounts whose pages all came."""
    path, pages = shared_path(spark, "collect"), feed_pages(spark, sf_dir)
    for _ in range(2):
        N.collect_feed(spark, path, pages, "2024-02-01 00:00:00", "run-1")
    return N.feed_state(spark, path).snapshot().select("tx_id", "account_id", "amount", "outcome")


@query("select event_id, case when event_id % 9 = 0 or ts < timestamp '2024-01-18 12:00:00' then 'stale' else 'ready' end as state from events", base=False)
def n6_freshness(spark, sf_dir):
    e = W.table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 9 != 0, F.col("ts")).alias("at"))
    return N.freshness(e, "at", "2024-01-20 00:00:00").select("event_id", "state")


@query("select event_id, user_id from events", base=False)
def n4_stream_deduplicated(spark, sf_dir):
    """The events as a stream, each once within the 48 hours that are read again."""
    schema = W.table(spark, sf_dir, "events").select("event_id", "user_id", "ts").schema
    stream = N.read_landed(spark, f"{sf_dir}/events.parquet", schema).withColumn("at", F.col("ts").cast("timestamp"))
    twice = stream.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return N.run_once(N.deduplicated(twice, "event_id", "at").select("event_id", "user_id"), shared_path(spark, "feed"))


@query("""select event_id, case when hour(ts) >= 18 then date_trunc('day', ts) + interval 18 hour when hour(ts) >= 7 then date_trunc('day', ts) + interval 7 hour else date_trunc('day', ts) - interval 6 hour end as slot from events""", base=False)
def n5_collection_slot(spark, sf_dir):
    return W.table(spark, sf_dir, "events").select("event_id", N.slot(F.col("ts"), [7, 18]).alias("slot"))


@query("select entity, count(*) as missing from accounts where not closed and account_id not in (select user_id % 20 + 1 from events) group by 1")
def n7_missing_connections(spark, sf_dir):
    fed = W.table(spark, sf_dir, "events").select((F.col("user_id") % 20 + 1).alias("account_id"))
    return A.missing_connections(W.accounts(spark, sf_dir), fed)


@query("select account_id, label, cast(sum(cast(value as decimal(18,2))) as decimal(18,2)) as balance, count(event_id) as n, max(cast(ts as date)) as last_day from accounts left join events on user_id % 20 + 1 = account_id where not closed group by 1, 2")
def n8_feed_account_status(spark, sf_dir):
    e = W.table(spark, sf_dir, "events").select((F.col("user_id") % 20 + 1).alias("account_id"), F.col("value").cast(M).alias("amount"), F.col("ts").cast("date").alias("day"))
    return A.feed_account_status(W.accounts(spark, sf_dir), e)
