"""Queries of campaign measurement and of the response streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from leadweave.functions.normalize import address_norm, name_norm
from leadweave.operators import measure as M
from leadweave.operators.scoring import match_segment, score_breakdown
from leadweave.plans import leads as LP
from leadweave.plans.registry import name_norm as sql_name
from leadweave.plans.registry import query
from leadweave.plans.resolution import WHOLE
from leadweave.sources.adapter import MAIL_DATE, WINDOW_DAYS, table
from leadweave.sources.shared import shared_folder
from leadweave.streaming import responses as X

KEYWORDS = ["the", "thing", "einer", "les", "ention"]
_TEXT = r"""trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<nav\b.*?</nav\s*>|<footer\b.*?</footer\s*>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g'))"""


@query(
    rf"""WITH t AS (SELECT page_id, {_TEXT} AS x FROM pages) SELECT page_id, sha256(substr(x, 1, 4000)) AS excerpt_sha, concat_ws(',', {', '.join(f"CASE WHEN regexp_matches(x, '(?i)(^|[^\\p{{L}}\\p{{Nd}}]){k}($|[^\\p{{L}}\\p{{Nd}}])') THEN '{k}' END" for k in KEYWORDS)}) AS keywords FROM t"""
)
def e1_page_features(spark, d):
    return M.page_features(table(spark, d, "pages"), KEYWORDS).select("page_id", F.sha2("excerpt", 256).alias("excerpt_sha"), F.array_join("keywords", ",").alias("keywords"))


@query("SELECT count(*) FILTER (page_id % 5 < 2) AS fetched, count(*) FILTER (page_id % 5 = 2) AS robots_blocked, count(*) FILTER (page_id % 5 = 3) AS error, count(*) FILTER (page_id % 5 = 4) AS no_website FROM pages")
def e2_prefetch_summary(spark, d):
    k = F.col("page_id") % 5
    return M.prefetch_summary(table(spark, d, "pages").withColumn("fetch_status", F.when(k < 2, "fetched").when(k == 2, "robots_blocked").when(k == 3, "error").otherwise("no_website")))


@query("SELECT status, tier, count(*) AS leads FROM leads WHERE status <> 'duplicate' GROUP BY 1, 2", ("leads",))
def w1_export_review(spark, d):
    """Written as CSV and read back: the summary sheet."""
    sheets = M.review_tables(LP.leads(spark, d), score_breakdown(LP.scored(spark, d)), table(spark, d, "signals"))
    folder = f"{shared_folder(spark)}/review-{uuid.uuid4().hex}"
    M.export_review(sheets, folder)
    return spark.read.schema("status string, tier string, leads bigint").csv(f"{folder}/summary", header=True)


def _edits(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").where("c_custkey % 3 = 0").select(
        F.concat(F.lit("fx_"), F.lpad((k + F.when(k % 30 == 0, 10_000_000).otherwise(0)).cast("string"), 8, "0")).alias("lead_id"),
        F.when(k % 4 == 0, " Yes ").when(k % 4 == 1, "").when(k % 4 == 2, "maybe").otherwise("HOLD").alias("status_text"), F.when(k % 5 == 0, "dealer 3").when(k % 5 == 1, "D4").when(k % 5 == 2, "nobody").otherwise(" ").alias("dealer_text"),
    )


_EDITS = """ed AS (SELECT concat('fx_', lpad(CAST(k + CASE WHEN k % 30 = 0 THEN 10000000 ELSE 0 END AS STRING), 8, '0')) AS lead_id, CASE k % 4 WHEN 0 THEN 'approved' WHEN 3 THEN 'hold' END AS ns, CASE k % 4 WHEN 2 THEN 'maybe' END AS bad, CASE k % 5 WHEN 0 THEN 'd3' WHEN 1 THEN 'd4' END AS nd, CASE k % 5 WHEN 2 THEN 'nobody' END AS badd FROM (SELECT c_custkey AS k FROM customer WHERE c_custkey % 3 = 0) c)"""


@query(f"+{_EDITS} SELECT l.lead_id, coalesce(ns, status) AS status, coalesce(nd, dealer_id) AS dealer_id, CASE WHEN nd IS DISTINCT FROM dealer_id AND nd IS NOT NULL THEN 'override' ELSE assignment END AS assignment FROM leads l LEFT JOIN ed USING (lead_id)", ("leads",))
def w2_import_review(spark, d):
    return M.import_review(table(spark, d, "leads"), _edits(spark, d), table(spark, d, "dealers"))[0].select("lead_id", "status", "dealer_id", "assignment")


@query(f"""+{_EDITS}, m AS (SELECT ed.*, status, dealer_id FROM ed LEFT JOIN leads USING (lead_id)), log AS (SELECT unnest([CASE WHEN status IS NULL THEN 'unknown lead' END, CASE WHEN status IS NOT NULL AND bad IS NOT NULL THEN 'unknown status' END, CASE WHEN status IS NOT NULL AND badd IS NOT NULL THEN 'unknown dealer' END,
  CASE WHEN ns <> status THEN 'status' END, CASE WHEN status IS NOT NULL AND nd IS NOT NULL AND nd IS DISTINCT FROM dealer_id THEN 'dealer' END]) AS change FROM m) SELECT change, count(*) AS n FROM log WHERE change IS NOT NULL GROUP BY 1""", ("leads",))
def w2_review_log(spark, d):
    return M.import_review(table(spark, d, "leads"), _edits(spark, d), table(spark, d, "dealers"))[1].groupBy("change").agg(F.count("*").alias("n"))


def _codes(spark, d):
    ls = table(spark, d, "leads")
    have = ls.where("k % 10 = 0").select("campaign_id", "lead_id", F.concat(F.lit("OLD"), "lead_id").alias("code"))
    return M.assign_tracking_codes(ls, have, "https://go.example")


@query("SELECT count(*) AS leads, count(*) AS codes, count(*) FILTER (k % 10 = 0) AS kept, count(*) FILTER (k % 10 <> 0) AS well_formed FROM leads", ("leads",))
def t1_assign_tracking_codes(spark, d):
    c = _codes(spark, d)
    return c.agg(F.count("*").alias("leads"), F.countDistinct("code").alias("codes"), F.count_if(F.col("code").startswith("OLD")).alias("kept"), F.count_if(F.col("code").rlike(f"^[{M.CODE_LETTERS}]{{6}}$")).alias("well_formed"))


_DESIGN = [[("wave1", 0.5), ("wave2", 0.3), ("holdout", 0.2)], [("A", 0.5), ("B", 0.5)]]
_COHORT = """c1 AS (SELECT lead_id, coalesce(tier, '-') AS t, coalesce(dealer_id, '-') AS dd, row_number() OVER (PARTITION BY coalesce(tier, '-'), coalesce(dealer_id, '-') ORDER BY sha256('s' || lead_id), lead_id) AS p, count(*) OVER (PARTITION BY coalesce(tier, '-'), coalesce(dealer_id, '-')) AS n FROM leads),
c2 AS (SELECT *, CASE WHEN p <= round(n * 0.5::DOUBLE) THEN 'wave1' WHEN p <= round(n * 0.8::DOUBLE) THEN 'wave2' ELSE 'holdout' END AS w FROM c1),
c3 AS (SELECT *, row_number() OVER (PARTITION BY t, dd, w ORDER BY sha256('s' || lead_id), lead_id) AS q, count(*) OVER (PARTITION BY t, dd, w) AS m FROM c2),
cohorts AS (SELECT lead_id, w || '/' || CASE WHEN q <= round(m * 0.5::DOUBLE) THEN 'A' ELSE 'B' END AS cohort FROM c3)"""


def _cohorts(spark, d):
    return M.assign_cohorts(table(spark, d, "leads"), _DESIGN, "s")


@query(f"+{_COHORT} SELECT lead_id, cohort FROM cohorts", ("leads",))
def h1_assign_cohorts(spark, d):
    return _cohorts(spark, d)


@query(f"+{_COHORT} SELECT CASE WHEN status = 'suppressed' THEN 'suppressed' WHEN status <> 'approved' THEN 'not approved' WHEN cohort LIKE '%holdout%' THEN 'holdout' WHEN cohort NOT LIKE 'wave1%' THEN 'other wave' ELSE 'mailed' END AS reason, count(*) AS leads FROM leads JOIN cohorts USING (lead_id) GROUP BY 1", ("leads",))
def h2_mailing_manifest(spark, d):
    return M.mailing_manifest(table(spark, d, "leads"), _codes(spark, d), _cohorts(spark, d), "wave1")[1]


def _matches(spark, d):
    s = table(spark, d, "sales").select("sale_id", name_norm(F.col("customer_name")).alias("name_norm"), F.col("sale_zip").alias("zip5"), address_norm(F.col("sale_address")).alias("address_norm"), "sale_date", "promo_code")
    ls = table(spark, d, "leads").select("lead_id", F.concat(F.lit("lift-"), F.lpad(F.col("k").cast("string"), 6, "0")).alias("offer_code"), name_norm(F.col("name")).alias("name_norm"), F.col("postcode").alias("zip5"), address_norm(F.col("address")).alias("address_norm"))
    return M.matchback(s, ls, MAIL_DATE, WINDOW_DAYS, whole=WHOLE)


_ADDR = r"nullif(trim(regexp_replace(regexp_replace(regexp_replace(lower({c}), '\s+', ' ', 'g'), '[^\p{{L}}\p{{Nd}} ]', '', 'g'), ' +', ' ', 'g')), '')"
_MATCH = f"""sl AS (SELECT sale_id, {sql_name('customer_name')} AS nn, sale_zip AS z, {_ADDR.format(c='sale_address')} AS ad, promo_code, sale_date FROM sales WHERE sale_date BETWEEN DATE '{MAIL_DATE}' AND DATE '{MAIL_DATE}' + {WINDOW_DAYS}),
ll AS (SELECT lead_id, 'LIFT-' || lpad(CAST(k AS STRING), 6, '0') AS oc, {sql_name('name')} AS ln, postcode AS lz, {_ADDR.format(c='address')} AS la FROM leads),
fz AS (SELECT a.nn, a.z, arg_min(b.lead_id, (-jaro_winkler_similarity(a.nn, b.ln), b.lead_id)) AS lead_id FROM (SELECT DISTINCT nn, z FROM sl) a JOIN (SELECT ln, lz, min(lead_id) AS lead_id FROM ll GROUP BY 1, 2) b ON z = lz AND nn <> ln AND jaro_winkler_similarity(a.nn, b.ln) >= 0.90 GROUP BY 1, 2),
allm AS (SELECT sale_id, 0 AS t, lead_id FROM sl JOIN ll ON promo_code = oc UNION ALL SELECT sale_id, 1, lead_id FROM sl JOIN ll ON nn = ln AND z = lz UNION ALL SELECT sale_id, 1, lead_id FROM sl JOIN ll ON ad = la UNION ALL SELECT sale_id, 2, lead_id FROM sl JOIN fz USING (nn, z)),
matches AS (SELECT sale_id, lead_id, CASE t WHEN 0 THEN 'exact' WHEN 1 THEN 'strong' ELSE 'fuzzy' END AS tier, t = 2 AS needs_review FROM allm QUALIFY row_number() OVER (PARTITION BY sale_id ORDER BY t, lead_id) = 1)"""


@query(f"+{_MATCH} SELECT sale_id, tier, needs_review FROM matches", ("sales", "leads"))
def b1_matchback(spark, d):
    return _matches(spark, d).select("sale_id", "tier", "needs_review")


@query(f"""+{_MATCH} SELECT m.sale_id, CASE WHEN tier = 'exact' OR EXISTS (SELECT 1 FROM outcomes o WHERE o.lead_id = m.lead_id AND outcome = 'won') THEN 'direct' WHEN (SELECT min(ts) FROM responses r WHERE r.lead_id = m.lead_id) < s.sale_date + INTERVAL 1 DAY THEN 'assisted' ELSE 'influenced' END AS credit FROM matches m JOIN sl s USING (sale_id)""", ("sales", "leads", "responses", "outcomes"))
def b2_credit(spark, d):
    return M.credit(_matches(spark, d), table(spark, d, "sales"), table(spark, d, "responses"), table(spark, d, "outcomes")).select("sale_id", "credit")


_REPORT = f"""{_MATCH}, {_COHORT}, report AS (SELECT cohort, count(*) AS leads, count(n) AS buyers, CAST(coalesce(sum(exact), 0) AS BIGINT) AS exact, CAST(coalesce(sum(strong), 0) AS BIGINT) AS strong, CAST(coalesce(sum(fuzzy), 0) AS BIGINT) AS fuzzy FROM cohorts LEFT JOIN (SELECT lead_id, count(*) AS n, count(*) FILTER (tier = 'exact') AS exact, count(*) FILTER (tier = 'strong') AS strong, count(*) FILTER (tier = 'fuzzy') AS fuzzy FROM matches GROUP BY 1) b USING (lead_id) GROUP BY 1)"""


@query(f"+{_REPORT} SELECT cohort, leads, buyers, exact, strong, fuzzy, round(buyers / leads, 6) AS rate FROM report", ("sales", "leads"))
def b3_cohort_report(spark, d):
    return M.cohort_report(_matches(spark, d), _cohorts(spark, d)).select("cohort", "leads", "buyers", "exact", "strong", "fuzzy", F.round("rate", 6).alias("rate"))


@query(f"""+{_REPORT}, s AS (SELECT sum(leads) FILTER (cohort NOT LIKE '%holdout%') AS n, sum(buyers) FILTER (cohort NOT LIKE '%holdout%') AS b, sum(leads) FILTER (cohort LIKE '%holdout%') AS hn, sum(buyers) FILTER (cohort LIKE '%holdout%') AS hb FROM report), p AS (SELECT n, hn, b / n AS p, hb / hn AS q FROM s)
  SELECT round(p - q, 6) AS lift, round(p - q - 1.959963984540054::DOUBLE * sqrt(p * (1 - p) / n + q * (1 - q) / hn), 6) AS low, round(p - q + 1.959963984540054::DOUBLE * sqrt(p * (1 - p) / n + q * (1 - q) / hn), 6) AS high FROM p""", ("sales", "leads"))
def b4_lift(spark, d):
    return M.lift(M.cohort_report(_matches(spark, d), _cohorts(spark, d))).select(*(F.round(c, 6).alias(c) for c in ("lift", "low", "high")))


@query(f"""+{LP._SEG}, wide AS (SELECT l.campaign_id, l.dealer_id, segment, l.tier, r.lead_id IS NOT NULL AS responded, coalesce(c, 0) AS contacted, coalesce(q, 0) AS quoted, coalesce(w, 0) AS won, coalesce(u, 0) AS units, rev, 55.0::DOUBLE + 5 * (k % 3) AS cost
  FROM leads l LEFT JOIN seg USING (lead_id) LEFT JOIN (SELECT DISTINCT lead_id FROM responses) r USING (lead_id)
  LEFT JOIN (SELECT lead_id, max(CASE outcome WHEN 'contacted' THEN 1 ELSE 0 END) AS c, max(CASE outcome WHEN 'quoted' THEN 1 ELSE 0 END) AS q, max(CASE outcome WHEN 'won' THEN 1 ELSE 0 END) AS w, count(*) AS u, sum(value) AS rev FROM outcomes GROUP BY 1) o USING (lead_id)),
  sums AS (SELECT campaign_id, dealer_id, segment, tier, count(*) AS mailed, count(*) FILTER (responded) AS responded, CAST(sum(contacted) AS BIGINT) AS contacted, CAST(sum(quoted) AS BIGINT) AS quoted, CAST(sum(won) AS BIGINT) AS won, CAST(sum(units) AS BIGINT) AS units,
    round(coalesce(sum(rev), 0), 2) AS revenue, round(sum(cost), 2) AS cost, CAST(grouping(campaign_id, dealer_id, segment, tier) AS INTEGER) AS level FROM wide GROUP BY ROLLUP (campaign_id, dealer_id, segment, tier))
  SELECT *, round(CASE WHEN responded > 0 THEN cost / responded END, 4) AS cost_per_response, round(CASE WHEN won > 0 THEN cost / won END, 4) AS cost_per_win, round(CASE WHEN cost > 0 THEN revenue / cost END, 4) AS revenue_per_cost FROM sums""", ("leads", "responses", "outcomes"))
def b5_campaign_funnel(spark, d):
    o = table(spark, d, "outcomes")
    ls = LP.leads(spark, d)
    ls = ls.join(match_segment(ls, LP.segments(spark)).select("lead_id", "segment"), "lead_id", "left")
    costs = ls.select("lead_id", (F.lit(55.0) + 5 * (F.col("k") % 3)).alias("amount"))
    return M.campaign_funnel(ls, table(spark, d, "responses"), o, o.select("lead_id", F.col("value").alias("amount")), costs)


@query(f"""+{_REPORT.replace("SELECT cohort, count(*) AS leads", "SELECT campaign_id, cohort, count(*) AS leads").replace("FROM cohorts LEFT JOIN", "FROM (SELECT cohorts.*, 'c' || k % 5 AS campaign_id FROM cohorts JOIN leads USING (lead_id)) cohorts LEFT JOIN").replace("b USING (lead_id) GROUP BY 1)", "b USING (lead_id) GROUP BY ALL)")},
  s AS (SELECT campaign_id, sum(leads) FILTER (cohort NOT LIKE '%holdout%') AS n, sum(buyers) FILTER (cohort NOT LIKE '%holdout%') AS b, sum(leads) FILTER (cohort LIKE '%holdout%') AS hn, sum(buyers) FILTER (cohort LIKE '%holdout%') AS hb FROM report GROUP BY 1),
  e AS (SELECT campaign_id, n, hn, b / n AS p, hb / hn AS q, n * hn / (n + hn) AS w FROM s), v AS (SELECT *, p - q AS d, p * (1 - p) / n + q * (1 - q) / hn AS var FROM e),
  u AS (SELECT campaign_id, d, var FROM v UNION ALL SELECT NULL, sum(w * d) / sum(w), sum(w * w * var) / (sum(w) * sum(w)) FROM v)
  SELECT campaign_id, round(d, 6) AS lift, round(d - 1.959963984540054::DOUBLE * sqrt(var), 6) AS low, round(d + 1.959963984540054::DOUBLE * sqrt(var), 6) AS high FROM u""", ("sales", "leads"))
def b4_lift_by_campaign(spark, d):
    """Leads of five mailings by key; each mailing's difference and the pooled one."""
    mailings = _cohorts(spark, d).join(table(spark, d, "leads").select("lead_id", F.concat(F.lit("c"), (F.col("k") % 5).cast("string")).alias("campaign_id")), "lead_id")
    report = M.cohort_report(_matches(spark, d), mailings, ("campaign_id",))
    return M.lift_by_campaign(report).select("campaign_id", *(F.round(c, 6).alias(c) for c in ("lift", "low", "high")))


@query(f"""+{LP._SEG}, wide AS (SELECT 'c' || l.k % 4 AS campaign_id, l.dealer_id, segment, l.tier, 'card ' || l.k % 3 AS creative, r.lead_id IS NOT NULL AS responded, coalesce(c, 0) AS contacted, coalesce(q, 0) AS quoted, coalesce(w, 0) AS won, coalesce(u, 0) AS units, rev, 55.0::DOUBLE + 5 * (k % 3) AS cost
  FROM leads l LEFT JOIN seg USING (lead_id) LEFT JOIN (SELECT DISTINCT lead_id FROM responses) r USING (lead_id)
  LEFT JOIN (SELECT lead_id, max(CASE outcome WHEN 'contacted' THEN 1 ELSE 0 END) AS c, max(CASE outcome WHEN 'quoted' THEN 1 ELSE 0 END) AS q, max(CASE outcome WHEN 'won' THEN 1 ELSE 0 END) AS w, count(*) AS u, sum(value) AS rev FROM outcomes GROUP BY 1) o USING (lead_id)),
  sums AS (SELECT campaign_id, dealer_id, segment, tier, creative, count(*) AS mailed, count(*) FILTER (responded) AS responded, CAST(sum(contacted) AS BIGINT) AS contacted, CAST(sum(quoted) AS BIGINT) AS quoted, CAST(sum(won) AS BIGINT) AS won, CAST(sum(units) AS BIGINT) AS units,
    round(coalesce(sum(rev), 0), 2) AS revenue, round(sum(cost), 2) AS cost, CAST(grouping(campaign_id, dealer_id, segment, tier, creative) AS INTEGER) AS level FROM wide
    GROUP BY GROUPING SETS ((), (campaign_id), (dealer_id), (segment), (tier), (creative), (campaign_id, dealer_id), (campaign_id, segment), (campaign_id, tier), (campaign_id, creative)))
  SELECT *, round(CASE WHEN responded > 0 THEN cost / responded END, 4) AS cost_per_response, round(CASE WHEN won > 0 THEN cost / won END, 4) AS cost_per_win, round(CASE WHEN cost > 0 THEN revenue / cost END, 4) AS revenue_per_cost FROM sums""", ("leads", "responses", "outcomes"))
def b5_funnel_by_dimension(spark, d):
    """Four mailings and three creatives by key; every dimension alone, within its campaign, and all."""
    o = table(spark, d, "outcomes")
    ls = LP.leads(spark, d)
    ls = ls.join(match_segment(ls, LP.segments(spark)).select("lead_id", "segment"), "lead_id", "left")
    by = lambda word, n: F.concat(F.lit(word), (F.col("k") % n).cast("string"))
    ls = ls.withColumns({"campaign_id": by("c", 4), "creative": by("card ", 3)})
    costs = ls.select("lead_id", (F.lit(55.0) + 5 * (F.col("k") % 3)).alias("amount"))
    return M.campaign_funnel(ls, table(spark, d, "responses"), o, o.select("lead_id", F.col("value").alias("amount")), costs, M.DIMENSIONS)


@query("""+a AS (SELECT lead_id, min(ts) AS ts FROM responses GROUP BY 1), f AS (SELECT a.lead_id, min(outcome_ts) AS contact FROM a JOIN outcomes o ON o.lead_id = a.lead_id AND outcome_ts >= ts GROUP BY 1)
  SELECT dealer_id, count(*) AS responded, round(count(contact) / count(*), 6) AS share, round(quantile_cont(epoch_us(contact) - epoch_us(ts), 0.5) / 3600000000.0::DOUBLE, 4) AS median_hours FROM leads JOIN a USING (lead_id) LEFT JOIN f USING (lead_id) WHERE dealer_id IS NOT NULL GROUP BY 1""", ("leads", "responses", "outcomes"))
def b6_time_to_first_contact(spark, d):
    out = M.time_to_first_contact(table(spark, d, "leads"), table(spark, d, "responses"), table(spark, d, "outcomes"))
    return out.select("dealer_id", "responded", F.round("share", 6).alias("share"), F.round("median_hours", 4).alias("median_hours"))


@query(f"""+pe AS (SELECT sale_id AS permit_id, {_ADDR.format(c='sale_address')} AS ad, sale_zip AS z, sale_date FROM sales), le AS (SELECT lead_id, {_ADDR.format(c='address')} AS la, postcode AS lz FROM leads)
  SELECT lead_id, permit_id, 'permit' AS type, strftime(sale_date, '%Y-%m-%d') AS date_text FROM pe JOIN le ON ad = la AND z = lz""", ("sales", "leads"))
def b7_permits_to_signals(spark, d):
    p = table(spark, d, "sales").select(F.col("sale_id").alias("permit_id"), address_norm(F.col("sale_address")).alias("address_norm"), F.col("sale_zip").alias("zip5"), F.col("sale_date").alias("issued"), F.lit("Permit").alias("text"))
    ls = table(spark, d, "leads").select("lead_id", address_norm(F.col("address")).alias("address_norm"), F.col("postcode").alias("zip5"))
    return M.permits_to_signals(p, ls).select("lead_id", "permit_id", "type", "date_text")


@query()
def b8_fit_weights(spark, d):
    won = F.col("total") + F.col("k") % 20 >= 60
    return M.fit_weights(LP.scored(spark, d).withColumn("won", won))


def _stream(spark, d, only: str | None = None):
    """events as a file stream of the responses, or of the outcomes."""
    base = spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).option("pathGlobFilter", "*.parquet")
    path = f"{d}/events.parquet"
    files = base.parquet(path) if spark.read.parquet(path).inputFiles()[0].rsplit("/", 2)[-2] == "events.parquet" else base.option("pathGlobFilter", "events.parquet").parquet(d)
    lead = F.concat(F.lit("fx_"), F.lpad(F.col("user_id").cast("string"), 8, "0"))
    if only == "outcomes":
        return files.where("event_type = 'purchase'").select(F.col("event_id").alias("outcome_id"), lead.alias("lead_id"), F.col("ts").cast("timestamp").alias("outcome_ts"))
    kind = F.when(F.col("event_type") == "view", "visit").when(F.col("event_type") == "click", "scan").when(F.col("event_type") == "signup", "form").when(F.col("event_type") == "purchase", "redemption").otherwise("call")
    return files.select("event_id", lead.alias("lead_id"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("response_type"))


def _to_table(df, name):
    return X.run_to_table(df, name, f"{shared_folder(df.sparkSession)}/stream-{uuid.uuid4().hex}")


@query("SELECT event_id, lead_id, dealer_id FROM responses JOIN leads USING (lead_id)", ("responses", "leads"))
def x1_response_stream(spark, d):
    return _to_table(X.response_stream(_stream(spark, d), table(spark, d, "leads")), "responses").select("event_id", "lead_id", "dealer_id")


@query("""SELECT date_trunc('hour', ts) AS window_start, dealer_id, response_type, count(*) AS responses FROM responses JOIN leads USING (lead_id) WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM responses) - INTERVAL 2 HOUR GROUP BY ALL""", ("responses", "leads"))
def x2_response_counts(spark, d):
    """Windows that the watermark has closed; the last hours stay open."""
    return _to_table(X.response_counts(X.response_stream(_stream(spark, d), table(spark, d, "leads"))), "counts").select("window_start", "dealer_id", "response_type", "responses")


@query("""+w AS (SELECT least((SELECT max(ts) FROM responses), (SELECT max(outcome_ts) FROM outcomes)) - INTERVAL 2 HOUR AS mark) SELECT event_id, lead_id FROM responses r, w WHERE NOT EXISTS (SELECT 1 FROM outcomes o WHERE o.lead_id = r.lead_id AND outcome_ts >= ts AND outcome_ts <= ts + INTERVAL 24 HOUR) AND ts + INTERVAL 24 HOUR < mark""", ("responses", "outcomes"))
def x3_unanswered_alerts(spark, d):
    return _to_table(X.unanswered_alerts(_stream(spark, d), _stream(spark, d, "outcomes")), "alerts").select("event_id", "lead_id")
