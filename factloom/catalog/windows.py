"""Time-ordered operators and accounts trends (inventory D14, F18, H1-H11, I1, I2, I4, K3, K9)."""
from __future__ import annotations

from pyspark.sql import functions as F

from factloom.catalog import derived
from factloom.catalog import sql as S
from factloom.catalog.registry import query, table
from factloom.functions import dates, fixed, money
from factloom.operators import accounts, evidence, joins, ordered, refresh
from factloom.sources import sampling

HOUR = F.date_trunc("hour", "ts")


def _events(spark, sf):
    return table(spark, sf, "events").withColumn("hour", HOUR)


@query("d14_failed_host_breaker", """
WITH e AS (SELECT user_id, event_id, event_type = 'error' OR event_type = 'view' AS failed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position FROM events),
g AS (SELECT *, max(CASE WHEN NOT failed THEN position ELSE 0 END) OVER (PARTITION BY user_id ORDER BY position) AS good FROM e),
t AS (SELECT user_id, min(position) AS trip FROM g WHERE position - good >= 3 GROUP BY 1)
SELECT event_id, position, position - good AS streak, coalesce(position > trip, false) AS skipped FROM g LEFT JOIN t USING (user_id)""")
def _(spark, sf):
    e = _events(spark, sf).select("user_id", "event_id", "event_type", "ts", "hour")
    tripped = ordered.breaker(e, ["user_id"], ["ts", "event_id"], "hour", F.col("event_type").isin("error", "view"), fixed.BREAKER_FAILURES)
    return tripped.select("event_id", "position", "streak", "skipped")


@query("h7_breaker_summary", """
WITH e AS (SELECT user_id, event_type = 'error' AS failed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position FROM events),
g AS (SELECT *, max(CASE WHEN NOT failed THEN position ELSE 0 END) OVER (PARTITION BY user_id ORDER BY position) AS good FROM e),
t AS (SELECT user_id, min(position) AS trip FROM g WHERE position - good >= 3 GROUP BY 1)
SELECT user_id, count(*) AS requests, count(*) FILTER (WHERE coalesce(position > trip, false)) AS skipped FROM g LEFT JOIN t USING (user_id) GROUP BY 1""")
def _(spark, sf):
    e = _events(spark, sf).select("user_id", "event_id", "event_type", "ts", "hour")
    tripped = ordered.breaker(e, ["user_id"], ["ts", "event_id"], "hour", F.col("event_type") == "error", fixed.BREAKER_FAILURES)
    return tripped.groupBy("user_id").agg(F.count(F.lit(1)).alias("requests"), F.count_if("skipped").alias("skipped"))


@query("h1_latest_snapshot", """
SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1""")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    return ordered.latest(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("h2_consecutive_changes", """
WITH p AS (SELECT o_custkey, o_orderkey, o_orderstatus AS s, o_orderpriority AS q, lag(o_orderstatus) OVER w AS ps, lag(o_orderpriority) OVER w AS pq FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT o_custkey, o_orderkey, 'o_orderstatus' AS field, ps AS old, s AS new FROM p WHERE ps IS NOT NULL AND ps <> s UNION ALL
SELECT o_custkey, o_orderkey, 'o_orderpriority', pq, q FROM p WHERE pq IS NOT NULL AND pq <> q""")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority").withColumn("year", F.year("o_orderdate"))
    return refresh.consecutive_changes(o, "o_custkey", ["o_orderdate", "o_orderkey"], "year", ["o_orderstatus", "o_orderpriority"]).drop("o_orderdate")


def _snapshots(spark, sf):
    """An earlier and a later claim table of every company, differing by rule."""
    c = derived.companies(spark, sf)
    key, words = F.col("c_custkey"), derived.words

    def claim(field, old, new, kind=F.lit("a"), new_kind=F.lit("a"), period=F.lit("FY2023"), new_period=F.lit("FY2023")):
        return F.struct(
            F.lit(field).alias("field"), old.cast("string").alias("old"), new.cast("string").alias("new"), kind.alias("ok"), new_kind.alias("nk"), period.alias("op"), new_period.alias("np"),
        )

    rows = F.array(
        claim("legal_name", F.col("legal_name"), F.when(key % 3 == 0, words(F.col("legal_name"), " NY")).otherwise(words(" ", F.col("legal_name"), "  "))),
        claim("official_website", words("https://www.a", key, ".no/"), F.when(key % 4 == 0, words("https://b", key, ".no")).otherwise(words("a", key, ".no")), F.lit("a"), F.when(key % 8 == 0, "b").otherwise("a")),
        claim("annual_accounts_latest", words("Revenue: ", key), F.when(key % 5 == 0, words("Revenue: 9", key)).otherwise(words("Revenue: ", key)), new_period=F.when(key % 5 == 1, "FY2024").otherwise("FY2023")),
        claim("employee_count", F.col("employees"), F.when(key % 2 == 0, F.col("employees") + 1).otherwise(F.col("employees"))),
        claim("operating_status", F.when(key % 6 != 0, "Active"), F.lit("Bankrupt")),
        claim("leader", words("Kari ", key, " (Daglig leder)"), F.when(key % 7 == 0, words("Ola ", key, " (Daglig leder)")).otherwise(words("Kari ", key, " (Daglig leder)"))),
        claim("workplace", words(F.col("legal_name"), " (BERGEN)"), words(F.col("legal_name"), F.when(key % 9 == 0, " AVD").otherwise(""), ", Kai 1, 5003 BERGEN")),
        claim("hiring_signal", words("Careers page: https://www.x", key, ".no/en/jobb"), F.when(key % 10 == 0, words("Open role: Selger ", key)).otherwise(words("Careers page: https://x", key, ".no/jobb/"))),
    )
    long = c.select("org_number", F.explode(rows).alias("_c")).select("org_number", "_c.*")
    old = long.filter("old IS NOT NULL").select("org_number", "field", F.col("old").alias("value"), F.col("ok").alias("source_class"), F.col("op").alias("reporting_period"))
    new = long.select("org_number", "field", F.col("new").alias("value"), F.col("nk").alias("source_class"), F.col("np").alias("reporting_period"))
    return old, new


@query("h2_material_changes", f"""
WITH {S.COMPANIES}
SELECT org_number, 'legal_name' AS field, 'changed' AS kind, legal_name AS old, legal_name || ' NY' AS new FROM companies WHERE c_custkey % 3 = 0 UNION ALL
SELECT org_number, 'official_website', 'changed', 'https://www.a' || c_custkey || '.no/', 'https://b' || c_custkey || '.no' FROM companies WHERE c_custkey % 4 = 0 AND c_custkey % 8 <> 0 UNION ALL
SELECT org_number, 'annual_accounts_latest', 'changed', 'Revenue: ' || c_custkey, 'Revenue: 9' || c_custkey FROM companies WHERE c_custkey % 5 = 0 UNION ALL
SELECT org_number, 'annual_accounts_latest', 'period', 'FY2023', 'FY2024' FROM companies WHERE c_custkey % 5 = 1 UNION ALL
SELECT org_number, 'employee_count', 'changed', CAST(employees AS VARCHAR), CAST(employees + 1 AS VARCHAR) FROM companies WHERE c_custkey % 2 = 0 UNION ALL
SELECT org_number, 'operating_status', 'changed', 'Active', 'Bankrupt' FROM companies WHERE c_custkey % 6 <> 0 UNION ALL
SELECT org_number, 'leader', 'added', NULL, 'Ola ' || c_custkey || ' (Daglig leder)' FROM companies WHERE c_custkey % 7 = 0 UNION ALL
SELECT org_number, 'leader', 'removed', 'Kari ' || c_custkey || ' (Daglig leder)', NULL FROM companies WHERE c_custkey % 7 = 0 UNION ALL
SELECT org_number, 'workplace', 'added', NULL, legal_name || ' AVD' FROM companies WHERE c_custkey % 9 = 0 UNION ALL
SELECT org_number, 'workplace', 'removed', legal_name, NULL FROM companies WHERE c_custkey % 9 = 0 UNION ALL
SELECT org_number, 'hiring_signal', 'added', NULL, 'Open role: Selger ' || c_custkey FROM companies WHERE c_custkey % 10 = 0 UNION ALL
SELECT org_number, 'hiring_signal', 'removed', 'Careers page: https://www.x' || c_custkey || '.no/en/jobb', NULL FROM companies WHERE c_custkey % 10 = 0""")
def _(spark, sf):
    return refresh.material_changes(*_snapshots(spark, sf))


@query("h2_change_texts", f"""
WITH {S.COMPANIES}
SELECT org_number, 'leadership.leaders: [''Kari ' || c_custkey || ' (Daglig leder)''] -> [''Ola ' || c_custkey || ' (Daglig leder)'']' AS text FROM companies WHERE c_custkey % 7 = 0 UNION ALL
SELECT org_number, 'leadership.workplaces: [''' || legal_name || '''] -> [''' || legal_name || ' AVD'']' FROM companies WHERE c_custkey % 9 = 0 UNION ALL
SELECT org_number, 'hiring_signal added: [''Open role: Selger ' || c_custkey || ''']' FROM companies WHERE c_custkey % 10 = 0 UNION ALL
SELECT org_number, 'hiring_signal removed: [''Careers page: https://www.x' || c_custkey || '.no/en/jobb'']' FROM companies WHERE c_custkey % 10 = 0 UNION ALL
SELECT org_number, 'legal_name: ''' || legal_name || ''' -> ''' || legal_name || ' NY''' FROM companies WHERE c_custkey % 3 = 0 UNION ALL
SELECT org_number, 'official_site: ''https://www.a' || c_custkey || '.no/'' -> ''https://b' || c_custkey || '.no''' FROM companies WHERE c_custkey % 4 = 0 AND c_custkey % 8 <> 0 UNION ALL
SELECT org_number, 'annual_accounts.latest: ''Revenue: ' || c_custkey || ''' -> ''Revenue: 9' || c_custkey || '''' FROM companies WHERE c_custkey % 5 = 0 UNION ALL
SELECT org_number, 'employee_count: ''' || employees || ''' -> ''' || (employees + 1) || '''' FROM companies WHERE c_custkey % 2 = 0 UNION ALL
SELECT org_number, 'operating_status: ''Active'' -> ''Bankrupt''' FROM companies WHERE c_custkey % 6 <> 0 UNION ALL
SELECT org_number, 'annual_accounts.latest reporting_period: ''FY2023'' -> ''FY2024''' FROM companies WHERE c_custkey % 5 = 1""")
def _(spark, sf):
    old, new = _snapshots(spark, sf)
    return refresh.change_texts(refresh.material_changes(old, new), old, new)


@query("k7_changes_in_words", f"""
WITH {S.COMPANIES}
SELECT org_number, 'renamed from ' || legal_name AS said FROM companies WHERE c_custkey % 3 = 0 UNION ALL
SELECT org_number, 'website now b' || c_custkey || '.no' FROM companies WHERE c_custkey % 4 = 0 AND c_custkey % 8 <> 0 UNION ALL
SELECT org_number, 'a new annual filing' FROM companies WHERE c_custkey % 5 IN (0, 1) UNION ALL
SELECT org_number, 'employees ' || employees || ' -> ' || (employees + 1) FROM companies WHERE c_custkey % 2 = 0 UNION ALL
SELECT org_number, 'registry status Active -> Bankrupt' FROM companies WHERE c_custkey % 6 <> 0""")
def _(spark, sf):
    changes = refresh.material_changes(*_snapshots(spark, sf)).filter("field NOT IN ('leader', 'workplace', 'hiring_signal')")
    return changes.select("org_number", refresh.change_in_words(changes).alias("said"))


@query("h4_year_pairs", """
WITH y AS (SELECT l_suppkey, CAST(year(l_shipdate) AS INT) AS period, CAST(round(sum(CAST(l_extendedprice AS DECIMAL(18,2)))) AS BIGINT) AS amount, CASE WHEN l_suppkey % 5 = 0 AND year(l_shipdate) % 2 = 0 THEN 'EUR' ELSE 'NOK' END AS currency FROM lineitem GROUP BY ALL),
p AS (SELECT *, lag(amount) OVER w AS b, lag(period) OVER w AS bp, lag(currency) OVER w AS bc FROM y WINDOW w AS (PARTITION BY l_suppkey ORDER BY period))
SELECT l_suppkey, period, amount, CASE WHEN bc = currency THEN b END AS before, CASE WHEN bc = currency THEN bp END AS before_period FROM p""")
def _(spark, sf):
    return _paired(spark, sf).select("l_suppkey", "period", "amount", "before", "before_period")


def _yearly(spark, sf):
    year = F.year("l_shipdate")
    sums = table(spark, sf, "lineitem").groupBy("l_suppkey", year.alias("period")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("_a"))
    return sums.select(
        "l_suppkey", "period", F.round("_a").cast("bigint").alias("amount"),
        F.when((F.col("l_suppkey") % 5 == 0) & (F.col("period") % 2 == 0), "EUR").otherwise("NOK").alias("currency"),
    )


def _paired(spark, sf):
    figures = _yearly(spark, sf).withColumn("decade", F.floor(F.col("period") / 10))
    return accounts.year_pairs(figures, ["l_suppkey"], "period", "amount", "currency", "decade")


_YEARLY = """
y AS (SELECT l_suppkey, CAST(year(l_shipdate) AS INT) AS period, CAST(round(sum(CAST(l_extendedprice AS DECIMAL(18,2)))) AS BIGINT) AS amount,
  CASE WHEN l_suppkey % 5 = 0 AND year(l_shipdate) % 2 = 0 THEN 'EUR' ELSE 'NOK' END AS currency FROM lineitem GROUP BY ALL),
p AS (SELECT l_suppkey, period, amount, CASE WHEN lag(currency) OVER w = currency THEN lag(amount) OVER w END AS b FROM y WINDOW w AS (PARTITION BY l_suppkey ORDER BY period))"""


@query("h5_revenue_change", f"""
WITH {_YEARLY} SELECT l_suppkey, period, round((amount - b) / abs(b) * 100, 6) AS change FROM p WHERE b IS NOT NULL""")
def _(spark, sf):
    paired = _paired(spark, sf).filter("before IS NOT NULL")
    return paired.select("l_suppkey", "period", F.round(money.percent_change(F.col("amount"), F.col("before")), 6).alias("change"))


@query("k3_trend_classes", f"""
WITH {_YEARLY}, r AS (SELECT *, (amount - b) / abs(b) * 100 AS pct, amount - 20000000 * (period % 3) AS n, b - 20000000 * ((period - 1) % 3) AS pn FROM p)
SELECT l_suppkey, period, CASE WHEN b IS NULL OR b = 0 THEN 'stated' WHEN abs(pct) <= 0.05 THEN 'flat' WHEN abs(pct) > 300 THEN CASE WHEN pct > 0 THEN 'rose_from' ELSE 'fell_from' END WHEN pct > 0 THEN 'grew' ELSE 'fell' END AS revenue,
  CASE WHEN pn IS NULL THEN 'stated' WHEN pn < 0 AND n >= 0 THEN 'turned_round' WHEN n < 0 AND pn >= 0 THEN 'into_loss' WHEN pn <> 0 AND abs(n - pn) / abs(pn) <= 0.005 THEN 'same' WHEN n >= 0 THEN CASE WHEN n > pn THEN 'up' ELSE 'down' END
    WHEN abs(n) < abs(pn) THEN 'smaller_loss' ELSE 'larger_loss' END AS result,
  CASE WHEN n < 0 THEN 'negative' WHEN pn IS NULL THEN 'stated' WHEN pn < 0 THEN 'turned_positive' WHEN pn <> 0 AND abs(n - pn) / abs(pn) <= 0.005 THEN 'held' WHEN n > pn THEN 'rose' ELSE 'fell' END AS equity FROM r""")
def _(spark, sf):
    p = _paired(spark, sf)
    n = F.col("amount") - 20000000 * (F.col("period") % 3)
    pn = F.col("before") - 20000000 * ((F.col("period") - 1) % 3)
    return p.select(
        "l_suppkey", "period", accounts.revenue_trend(F.col("amount"), F.col("before")).alias("revenue"), accounts.result_trend(n, pn).alias("result"),
        accounts.equity_trend(n, pn).alias("equity"),
    )


@query("k9_revenue_signals", f"""
WITH {_YEARLY}, t AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY period DESC) AS r FROM p)
SELECT l_suppkey, 'Revenue ' || CASE WHEN amount > b THEN 'up ' ELSE 'down ' END || printf('%.0f', abs((amount - b) / abs(b) * 100)) || '% in FY' || period || '.' AS signal
FROM t WHERE r = 1 AND abs((amount - b) / abs(b) * 100) BETWEEN 25 AND 300""")
def _(spark, sf):
    pair = accounts.newest_pair(_yearly(spark, sf), ["l_suppkey"], "period", "amount", "currency")
    pct = money.percent_change(F.col("now"), F.col("before"))
    rows = pair.withColumn("_p", pct).filter(F.abs("_p").between(25, 300))
    return rows.select("l_suppkey", F.concat(
        F.lit("Revenue "), F.when(F.col("_p") > 0, "up ").otherwise("down "), F.format_number(F.abs("_p"), 0), F.lit("% in FY"), F.col("period").cast("string"), F.lit(".")).alias("signal"))


@query("h6_budget_admission", """
WITH e AS (SELECT event_id // 1000 AS chunk, event_id, CAST(value AS DECIMAL(18,2)) AS cost FROM events),
s AS (SELECT *, coalesce(sum(cost) OVER (PARTITION BY chunk ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM e)
SELECT event_id, CASE WHEN spent < 20000 THEN 'admitted' ELSE 'blocked' END AS decision, spent >= 18000 AS degrade FROM s""")
def _(spark, sf):
    e = table(spark, sf, "events").select(F.floor(F.col("event_id") / 1000).alias("chunk"), "event_id", F.col("value").cast("decimal(18,2)").alias("cost"), F.floor(F.col("event_id") / 50).alias("block"))
    return ordered.admit_within_budget(e, ["chunk"], ["event_id"], "block", F.col("cost"), 20000, 0.9).select("event_id", "decision", "degrade")


@query("h8_input_chunks", """
SELECT chunk, count(*) AS inputs, min(c_custkey) AS first, max(c_custkey) AS last FROM (SELECT c_custkey, CAST((row_number() OVER (ORDER BY c_custkey) - 1) // 100 AS BIGINT) AS chunk FROM customer) GROUP BY chunk""")
def _(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.floor(F.col("c_custkey") / 64).alias("block"))
    chunks = ordered.chunk_numbers(c, ["c_custkey"], "block", fixed.CHUNK_SIZE)
    return chunks.groupBy("chunk").agg(F.count(F.lit(1)).alias("inputs"), F.min("c_custkey").alias("first"), F.max("c_custkey").alias("last"))


@query("h9_latest_dated", """
WITH c AS (SELECT user_id, event_id, strftime(ts, '%Y-%m-%d') AS day FROM events WHERE ts < TIMESTAMP '2024-01-20')
SELECT user_id, max(day) AS day, arg_max(event_id, day || lpad(CAST(1000000000 - event_id AS VARCHAR), 12, '0')) AS event_id FROM c GROUP BY 1""")
def _(spark, sf):
    value = F.concat(F.lit("Note 2023-12-31 of "), F.date_format("ts", "yyyy-MM-dd"))
    c = table(spark, sf, "events").select("user_id", "event_id", dates.latest_in_text(value).alias("day")).filter("day < '2024-01-20'")
    newest = c.withColumn("_o", -F.col("event_id")).groupBy("user_id").agg(F.max_by(F.struct("day", "event_id"), F.struct("day", "_o")).alias("_n"))
    return newest.select("user_id", "_n.day", "_n.event_id")


@query("h10_carried_forward", """
WITH e AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'not_available' ELSE 'available' END AS state, value FROM events),
k AS (SELECT *, max(CASE WHEN state <> 'failed' THEN event_id END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known FROM e)
SELECT k.event_id, CASE WHEN k.state = 'available' THEN k.value WHEN k.state = 'failed' AND p.state = 'available' THEN p.value END AS published,
  CASE WHEN k.state = 'failed' AND p.state = 'available' THEN 'available' ELSE k.state END AS published_state FROM k LEFT JOIN e p ON p.event_id = k.known""")
def _(spark, sf):
    kind = F.col("event_type")
    e = _events(spark, sf).select("user_id", "event_id", "ts", "hour", "value", F.when(kind == "error", "failed").when(kind == "signup", "not_available").otherwise("available").alias("state"))
    return refresh.carry_failed_reads(e, "user_id", ["ts", "event_id"], "hour", "state", "value").select("event_id", "published", "published_state")


@query("h11_recent_changes", """
SELECT o_custkey, o_orderkey, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3""")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return ordered.top_k(o, ["o_custkey"], [F.col("o_orderdate").desc(), "o_orderkey"], 3, "rank").drop("o_orderdate")


@query("f18_previous_snapshot", """
WITH m AS (SELECT o_custkey, max(o_orderdate) AS moment FROM orders GROUP BY 1), e AS (SELECT o.o_custkey, m.moment, o.o_orderdate, o.o_orderkey, row_number() OVER (PARTITION BY o.o_custkey ORDER BY o.o_orderdate DESC, o.o_orderkey DESC) AS r
  FROM orders o JOIN m USING (o_custkey) WHERE o.o_orderdate < m.moment)
SELECT m.o_custkey, m.moment, e.o_orderdate, e.o_orderkey FROM m LEFT JOIN e ON e.o_custkey = m.o_custkey AND e.r = 1""")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    moments = o.groupBy("o_custkey").agg(F.max("o_orderdate").alias("moment"))
    return joins.latest_before(o, moments, "o_custkey", "o_orderdate", "moment", ["o_orderkey"])


@query("i1_seeded_sample", """
SELECT c_custkey FROM (SELECT c_custkey FROM customer ORDER BY md5('42:' || c_custkey), c_custkey LIMIT 50) ORDER BY 1""")
def _(spark, sf):
    return sampling.seeded_keys(table(spark, sf, "customer"), "c_custkey", 50, 42)


@query("i2_top_per_group", """
SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 5""")
def _(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id", "value")
    return ordered.top_k(e, ["user_id", "event_type"], [F.col("value").desc(), "event_id"], 5).drop("value")


@query("i4_claim_order", """
WITH o AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END, event_id) AS place FROM events) SELECT * FROM o""")
def _(spark, sf):
    rank = evidence.field_rank(F.col("event_type"), ["view", "click", "purchase"])
    e = table(spark, sf, "events").select("user_id", "event_id", rank.cast("bigint").alias("rank")).withColumn("block", F.col("rank") * 10**9 + F.floor(F.col("event_id") / 100))
    return ordered.row_numbers(e, ["user_id"], ["rank", "event_id"], "block", "place").select("user_id", "event_id", "place")


@query("h12_quantile_segments", """
SELECT event_id, row_number() OVER (ORDER BY value, event_id) AS place FROM events""")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", "value")
    return ordered.row_numbers(ordered.quantile_segments(e, "value", 1000, "segment"), [], ["value", "event_id"], "segment", "place").select("event_id", "place")
