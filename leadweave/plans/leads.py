"""Queries of scoring, research and lead lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadweave.functions.normalize import name_norm as norm
from leadweave.operators import lists as L
from leadweave.operators import research as V
from leadweave.operators import scoring as C
from leadweave.plans.registry import distance_m, name_norm, query
from leadweave.sources.adapter import AS_OF_MONTH, table

SEGMENTS = [
    (0, "Builders", ["BUILDING", "furniture"], ["roofing", "steel"], 25),
    (1, "Movers", ["automobile"], ["logistics", "storage"], None),
    (2, "Makers", ["machinery"], ["glass", "signs"], 60),
]
PROFILE_MIN = 40


def segments(spark):
    return spark.createDataFrame(SEGMENTS, "pos int, segment string, categories array<string>, keywords array<string>, min_employees int")


def leads(spark, d):
    return table(spark, d, "leads").withColumns({"hierarchy": F.array(F.lit("services"), F.lower("region"), F.col("leaf")), "name_norm": norm(F.col("name"))})


_SEG = """segs AS (SELECT * FROM (VALUES (0, 'Builders', 25), (1, 'Movers', NULL), (2, 'Makers', 60)) t(pos, segment, segment_min)),
cats AS (SELECT * FROM (VALUES (0, 'building'), (0, 'furniture'), (1, 'automobile'), (2, 'machinery')) t(pos, c)),
words AS (SELECT * FROM (VALUES (0, 'roofing'), (0, 'steel'), (1, 'logistics'), (1, 'storage'), (2, 'glass'), (2, 'signs')) t(pos, w)),
seg AS (SELECT lead_id, CASE kind WHEN 0 THEN 'taxonomy' ELSE 'keyword' END AS match, segment, segment_min FROM (
  SELECT lead_id, 0 AS kind, pos FROM leads JOIN cats ON c IN (leaf, 'services', lower(region)) UNION ALL SELECT lead_id, 1, pos FROM leads JOIN words ON contains(lower(name), w)
) JOIN segs USING (pos) QUALIFY row_number() OVER (PARTITION BY lead_id ORDER BY kind, pos) = 1)"""
_MONTH = r"CASE WHEN regexp_matches(date_text, '^\d{4}-(0[1-9]|1[0-2])(-\d{2})?$') THEN CAST(substr(date_text, 1, 4) AS INTEGER) * 12 + CAST(substr(date_text, 6, 2) AS INTEGER) END"
_QUAL = f"coalesce(type IN ('permit', 'hiring', 'expansion', 'news', 'funding', 'contract') AND {AS_OF_MONTH} - ({_MONTH}) BETWEEN 0 AND 11, false)"
_SIG = f"sig AS (SELECT lead_id, count(*) FILTER ({_QUAL}) AS n_signals FROM signals GROUP BY 1)"
_FACTS = """facts AS (SELECT lead_id, CASE WHEN ok AND lv IN ('high', 'medium', 'low', 'unknown') THEN lv END AS level, CASE WHEN ok THEN CAST(json_extract_string(j, '$.employeeEstimate.value') AS INTEGER) END AS employees,
  CASE WHEN ok THEN CAST(json_extract_string(j, '$.llmAdjustment') AS INTEGER) END AS adjustment FROM (
  SELECT lead_id, json_valid(document) AS ok, lower(json_extract_string(j, '$.facilityFit.level')) AS lv, j FROM (SELECT *, CASE WHEN json_valid(document) THEN document ELSE '{}' END AS j FROM research)))"""
_FEAT = f"""{_SEG}, {_SIG}, {_FACTS}, feat AS (
  SELECT l.*, match, segment, coalesce(segment_min, {PROFILE_MIN}) AS min_employees, level, employees, adjustment, coalesce(n_signals, 0) AS n_signals,
    {distance_m('l.lat', 'l.lon', 'branch_lat', 'branch_lon')} / 1609.344::DOUBLE AS branch_miles
  FROM leads l LEFT JOIN seg USING (lead_id) LEFT JOIN facts USING (lead_id) LEFT JOIN sig USING (lead_id) LEFT JOIN branches b ON b.branch_id = l.branch_id AND b.dealer_id = l.dealer_id
), vals AS (SELECT *,
  CASE match WHEN 'taxonomy' THEN 1.0::DOUBLE WHEN 'keyword' THEN 0.8::DOUBLE ELSE 0.2::DOUBLE END AS v_segment,
  CASE WHEN employees IS NULL THEN 0.5::DOUBLE WHEN employees >= min_employees THEN 1.0::DOUBLE WHEN employees * 2 >= min_employees THEN 0.5::DOUBLE ELSE 0.1::DOUBLE END AS v_size,
  CASE level WHEN 'high' THEN 1.0::DOUBLE WHEN 'medium' THEN 0.75::DOUBLE WHEN 'low' THEN 0.5::DOUBLE ELSE 0.4::DOUBLE END AS v_facility,
  CASE n_signals WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END AS v_signals,
  CASE WHEN branch_miles IS NULL THEN 0.0::DOUBLE WHEN branch_miles <= 25 THEN 1.0::DOUBLE WHEN branch_miles <= 50 THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END AS v_proximity,
  0.7::DOUBLE * confidence + 0.0::DOUBLE AS v_confidence FROM feat
), summed AS (SELECT *, CAST(round((v_segment * 0.25::DOUBLE + v_size * 0.15::DOUBLE + v_facility * 0.2::DOUBLE + v_signals * 0.25::DOUBLE + v_proximity * 0.05::DOUBLE + v_confidence * 0.1::DOUBLE) * 100.0::DOUBLE) AS INTEGER) AS base,
  greatest(-15, least(15, coalesce(adjustment, 0))) AS adjust FROM vals
), freed AS (SELECT *, greatest(0, least(100, base + adjust)) AS free FROM summed),
scored AS (SELECT *, CASE WHEN n_signals = 0 THEN least(free, 79) ELSE free END AS total, CASE WHEN n_signals = 0 AND free > 79 THEN free END AS capped_from,
  CASE WHEN total >= 80 THEN 'A' WHEN total >= 65 THEN 'B' ELSE 'C' END AS grade FROM freed)"""
_T = ("leads", "branches", "research", "signals")


def scored(spark, d):
    out = C.extract_features(leads(spark, d), table(spark, d, "branches"), table(spark, d, "research"), table(spark, d, "signals"), segments(spark), AS_OF_MONTH, PROFILE_MIN)
    return C.score(C.score_features(out))


@query(f"+{_SEG} SELECT lead_id, match, segment, segment_min FROM seg", ("leads",))
def c1_match_segment(spark, d):
    return C.match_segment(leads(spark, d), segments(spark))


@query(f"+{_SIG} SELECT * FROM sig", ("signals",))
def c2_qualifying_signals(spark, d):
    return C.qualifying_signals(table(spark, d, "signals"), AS_OF_MONTH)


@query(f"+{_FEAT} SELECT lead_id, segment, min_employees, level, employees, adjustment, n_signals, round(branch_miles, 4) AS branch_miles FROM feat", _T)
def c3_extract_features(spark, d):
    return scored(spark, d).select("lead_id", "segment", "min_employees", "level", "employees", "adjustment", "n_signals", F.round("branch_miles", 4).alias("branch_miles"))


@query(f"+{_FEAT} SELECT lead_id, v_segment, v_size, v_facility, v_signals, v_proximity, round(v_confidence, 6) AS v_confidence FROM vals", _T)
def c4_score_features(spark, d):
    return scored(spark, d).select("lead_id", "v_segment", "v_size", "v_facility", "v_signals", "v_proximity", F.round("v_confidence", 6).alias("v_confidence"))


@query(f"+{_FEAT} SELECT lead_id, base, adjust, total, grade, capped_from FROM scored", _T)
def c5_score(spark, d):
    return scored(spark, d).select("lead_id", "base", "adjust", "total", "grade", "capped_from")


@query(
    f"""+{_FEAT} SELECT lead_id, pos, feature, round(v, 4) AS value, weight, round(v * weight * 100.0::DOUBLE, 4) AS contribution FROM (
    SELECT lead_id, unnest([0, 1, 2, 3, 4, 5]) AS pos, unnest(['segment', 'size', 'facility', 'signals', 'proximity', 'confidence']) AS feature, unnest([v_segment, v_size, v_facility, v_signals, v_proximity, v_confidence]) AS v, unnest([0.25::DOUBLE, 0.15::DOUBLE, 0.2::DOUBLE, 0.25::DOUBLE, 0.05::DOUBLE, 0.1::DOUBLE]) AS weight FROM scored)""",
    _T,
)
def c6_score_breakdown(spark, d):
    return C.score_breakdown(scored(spark, d))


_CAMPAIGN_JSON = """SELECT concat('c', CAST(c_custkey AS STRING)) AS campaign_id, CASE c_custkey % 5 WHEN 0 THEN '{"segment":0.5,"signals":0.5}' WHEN 1 THEN '{"segment":0.7}' WHEN 2 THEN '{"magic":1.0}' WHEN 3 THEN '{"size":1.5}' END AS override_json,
  CASE WHEN c_custkey % 2 = 0 THEN '{"segment":0.1,"size":0.2,"facility":0.3,"signals":0.2,"proximity":0.1,"confidence":0.1}' END AS profile_json FROM customer"""


@query(f"""WITH c AS ({_CAMPAIGN_JSON}), p AS (SELECT *, coalesce(override_json, profile_json) AS j FROM c) SELECT campaign_id,
  CASE WHEN j LIKE '%magic%' THEN 'unknown key' WHEN j LIKE '%1.5%' THEN 'value outside 0 to 1' WHEN j LIKE '%0.7%' THEN 'sum is not 1' END AS error,
  CASE WHEN j IS NULL THEN 0.25::DOUBLE WHEN j LIKE '%0.5%' THEN 0.5::DOUBLE WHEN j LIKE '%0.3%' THEN 0.1::DOUBLE END AS w_segment,
  CASE WHEN j IS NULL THEN 0.1::DOUBLE WHEN j LIKE '%0.5%' THEN 0.0::DOUBLE WHEN j LIKE '%0.3%' THEN 0.1::DOUBLE END AS w_confidence FROM p""")
def c7_resolve_weights(spark, d):
    return C.resolve_weights(_campaigns(spark, d)).select("campaign_id", "error", "w_segment", "w_confidence")


def _campaigns(spark, d):
    return spark.sql(_CAMPAIGN_JSON.replace("FROM customer", "FROM {customer}").replace('{"', '{{"').replace('}\'', '}}\'').replace("{{customer}}", "{customer}"), customer=table(spark, d, "customer"))


@query(f"+{_FEAT} SELECT lead_id, total, grade FROM scored WHERE status NOT IN ('duplicate', 'suppressed') AND (score IS DISTINCT FROM total OR tier IS DISTINCT FROM grade)", _T)
def c8_score_campaign(spark, d):
    return C.score_campaign(scored(spark, d)).select("lead_id", "total", "grade")


@query(f"""+{_FEAT}, live AS (SELECT *, status NOT IN ('duplicate', 'suppressed') AS live FROM scored) SELECT count(*) FILTER (live) AS scored, count(*) FILTER (status = 'suppressed') AS skipped,
  count(*) FILTER (live AND (score IS DISTINCT FROM total OR tier IS DISTINCT FROM grade)) AS changed, count(*) FILTER (live AND grade = 'A') AS tier_a, count(*) FILTER (live AND grade = 'B') AS tier_b, count(*) FILTER (live AND grade = 'C') AS tier_c FROM live""", _T)
def p3_score_leads(spark, d):
    return C.score_summary(scored(spark, d))


@query(f"""+{_FEAT}, weighed AS (SELECT v.*, k % 10 + 1 AS n, CASE WHEN k % 10 = 3 THEN [0.1, 0.2, 0.3, 0.2, 0.1, 0.1]::DOUBLE[] WHEN k % 10 IN (4, 9) THEN [0.5, 0, 0, 0.5, 0, 0]::DOUBLE[] WHEN k % 10 = 8 THEN [0.25, 0.15, 0.2, 0.25, 0.05, 0.1]::DOUBLE[] END AS w FROM vals v),
  based AS (SELECT *, CAST(round((v_segment * w[1] + v_size * w[2] + v_facility * w[3] + v_signals * w[4] + v_proximity * w[5] + v_confidence * w[6]) * 100.0::DOUBLE) AS INTEGER) + greatest(-15, least(15, coalesce(adjustment, 0))) AS b FROM weighed),
  own AS (SELECT *, least(greatest(0, least(100, b)), CASE n_signals WHEN 0 THEN 79 ELSE 100 END) AS t FROM based), ranked AS (SELECT *, CASE WHEN t >= 80 THEN 'A' WHEN t >= 65 THEN 'B' ELSE 'C' END AS g2, w IS NOT NULL AND status NOT IN ('duplicate', 'suppressed') AS live FROM own),
  told AS (SELECT *, live AND (score IS DISTINCT FROM t OR tier IS DISTINCT FROM g2) AS differs FROM ranked)
  SELECT 'c' || n AS campaign_id, CASE n % 5 WHEN 1 THEN 'sum is not 1' WHEN 2 THEN 'unknown key' WHEN 3 THEN 'value outside 0 to 1' END AS error, count(*) FILTER (live) AS scored, count(*) FILTER (w IS NOT NULL AND status = 'suppressed') AS skipped, count(*) FILTER (differs) AS changed,
  count(*) FILTER (live AND g2 = 'A') AS tier_a, count(*) FILTER (live AND g2 = 'B') AS tier_b, count(*) FILTER (live AND g2 = 'C') AS tier_c, 6 * count(*) FILTER (differs) AS breakdown_rows FROM told GROUP BY n""", _T)
def p3_score_campaigns(spark, d):
    """Weights of each campaign -> features -> values -> scores -> rows that change with their breakdown -> a summary per campaign."""
    own = leads(spark, d).withColumn("campaign_id", F.concat(F.lit("c"), (F.col("k") % 10 + 1).cast("string")))
    weights = C.resolve_weights(_campaigns(spark, d).join(own.select("campaign_id").distinct(), "campaign_id", "left_semi"))
    features = C.extract_features(own, table(spark, d, "branches"), table(spark, d, "research"), table(spark, d, "signals"), segments(spark), AS_OF_MONTH, PROFILE_MIN)
    out = C.score_leads(features, weights)
    changed = C.score_campaign(out)
    parts = C.score_breakdown(changed).join(changed.select("lead_id", "campaign_id"), "lead_id").groupBy("campaign_id").agg(F.count("*").alias("breakdown_rows"))
    return weights.select("campaign_id", "error").join(C.score_summary(out, "campaign_id"), "campaign_id", "left").join(parts, "campaign_id", "left").na.fill(0)


@query(f"""SELECT lead_id, upper(substr(type, 1, 1)) || substr(type, 2) || ': ' || text || ' (' || date_text || ')' AS top_signal FROM signals
  QUALIFY row_number() OVER (PARTITION BY lead_id ORDER BY {_QUAL} DESC, {_MONTH} DESC NULLS LAST, type, event_id) = 1""", ("signals",))
def c9_top_signal(spark, d):
    return C.top_signal(table(spark, d, "signals"), AS_OF_MONTH)


_DOCS = """SELECT 'c1' AS campaign_id, concat('fx_', lpad(CAST(c_custkey AS STRING), 8, '0')) AS lead_id, CASE CASE WHEN c_custkey % 6 < 2 THEN c_custkey % 6 ELSE c_custkey % 18 END
  WHEN 0 THEN '{"status":"researched","summary":"A good site","rationale":"Fits the profile","facilityFit":{"level":"high"},"signals":[{"type":"hiring","text":"ten jobs","url":"https://a.example","date":"2024-01"},{"type":"news","text":"some news","url":"https://b.example","date":"2023-12-05"}]}'
  WHEN 1 THEN '{"status":"no_signal","summary":"Quiet these days","rationale":"Nothing was found","facilityFit":{"level":"low"},"signals":[]}'
  WHEN 2 THEN '{"status":"researched","summary":"short","rationale":"Fits the profile","facilityFit":{"level":"odd"},"signals":[]}'
  WHEN 3 THEN '{"status":"no_signal","summary":"A good site","rationale":"Fits the profile","facilityFit":{"level":"low"},"signals":[{"type":"hiring","text":"ten jobs","url":"https://a.example","date":"2024-01"}]}'
  WHEN 4 THEN '{"status":"researched","summary":"A good site","rationale":"Fits the profile","facilityFit":{"level":"low","mood":"fine"},"llmAdjustment":20,"mood":"fine"}'
  WHEN 8 THEN '{"status":"researched","summary":"A good site","rationale":"Fits the profile","llmAdjustment":"lots"}'
  WHEN 9 THEN '{"status":"researched","summary":"A good site","rationale":"Fits the profile","llmAdjustment":3.7}'
  WHEN 10 THEN '{"status":"researched","summary":"A good site","rationale":"Fits the profile","signals":"none"}'
  WHEN 11 THEN '{"status":"researched","summary":"A good site","rationale":"Fits the profile","contactRoles":[1,{"a":2},"owner"]}'
  WHEN 14 THEN '{"status":"researched","summary":"A good site","rationale":"Fits the profile","signals":[{"type":"hiring","text":"ten jobs","url":"https://a.example","date":"2024-01"},{"type":"news","text":"some news","url":"https://b.example","date":"May","mood":1}]}'
  WHEN 15 THEN '[1]'
  WHEN 16 THEN '{"status":"researched","summary":"A good site","rationale":true,"facilityFit":null,"employeeEstimate":{"value":0}}'
  WHEN 17 THEN '{"status":"researched","summary":"A good site","rationale":"Fits the profile","summary":"A better site"}'
  ELSE '{"summary":"A good site","rationale":"Fits the profile","facilityFit":{"level":"low"},"signals":[{"type":"hiring","text":"ten jobs","url":"ftp://a","date":"2024-1"}]}' END AS document FROM customer"""


def _docs(spark, d):
    text = _DOCS.replace("{", "{{").replace("}", "}}").replace("FROM customer", "FROM {customer}")
    return spark.sql(text, customer=table(spark, d, "customer"))


@query(f"""WITH d AS ({_DOCS}), p AS (SELECT * FROM (VALUES (2, '/facilityFit/level', 'not one of the values'), (2, '/summary', 'too short'), (3, '/signals', 'must be empty without a signal'), (4, '/facilityFit/mood', 'unknown key'), (4, '/mood', 'unknown key'), (4, '/llmAdjustment', 'outside -15 to 15'),
  (5, '/status', 'required'), (5, '/signals', 'must be empty without a signal'), (5, '/signals/0/url', 'not a web address'), (5, '/signals/0/date', 'not YYYY-MM or YYYY-MM-DD'), (8, '/llmAdjustment', 'not a whole number'), (9, '/llmAdjustment', 'not a whole number'),
  (10, '/signals', 'not a list'), (11, '/contactRoles/0', 'not a text'), (11, '/contactRoles/1', 'not a text'), (14, '/signals/1/date', 'not YYYY-MM or YYYY-MM-DD'), (14, '/signals/1/mood', 'unknown key'), (15, '', 'not a JSON object'),
  (16, '/rationale', 'not a text'), (16, '/facilityFit', 'not an object'), (16, '/employeeEstimate/value', 'below 1'), (17, '', 'not a JSON object')) t(r, pointer, problem))
  SELECT lead_id, pointer, problem FROM d JOIN p ON CAST(substr(lead_id, 4) AS INTEGER) % 6 >= 2 AND CAST(substr(lead_id, 4) AS INTEGER) % 18 = r""")
def v1_validate_research(spark, d):
    return V.validate_research(_docs(spark, d))[1].select("lead_id", "pointer", "problem")


@query(f"""+docs AS ({_DOCS}), saved AS (SELECT docs.* FROM docs JOIN leads USING (lead_id) WHERE CAST(substr(lead_id, 4) AS INTEGER) % 6 < 2 AND status <> 'duplicate')
  SELECT lead_id, count(*) AS n_signals, count(*) FILTER (date_text = '2024-01') AS of_january FROM (
  SELECT lead_id, date_text FROM signals WHERE lead_id NOT IN (SELECT lead_id FROM saved)
  UNION ALL SELECT lead_id, unnest(['2024-01', '2023-12-05']) FROM saved WHERE CAST(substr(lead_id, 4) AS INTEGER) % 6 = 0) x GROUP BY 1""", ("leads", "signals"))
def v2_save_research(spark, d):
    valid, _ = V.validate_research(_docs(spark, d))
    old = table(spark, d, "signals").select(F.lit("c1").alias("campaign_id"), "lead_id", F.col("event_id").cast("int").alias("pos"), "type", "text", "date_text")
    research = table(spark, d, "research").select(F.lit("c1").alias("campaign_id"), "lead_id", "document")
    _, now, _ = V.save_research(valid, table(spark, d, "leads"), research, old)
    return now.groupBy("lead_id").agg(F.count("*").alias("n_signals"), F.count_if(F.col("date_text") == "2024-01").alias("of_january"))


@query(f"""+docs AS ({_DOCS}) SELECT lead_id, CASE WHEN status IS NULL THEN 'unknown lead' ELSE 'duplicate lead' END AS error FROM docs LEFT JOIN leads USING (lead_id) WHERE CAST(substr(lead_id, 4) AS INTEGER) % 6 < 2 AND (status IS NULL OR status = 'duplicate')""", ("leads",))
def p4_save_research_refused(spark, d):
    valid, _ = V.validate_research(_docs(spark, d))
    none = table(spark, d, "signals").select(F.lit("c1").alias("campaign_id"), "lead_id", F.lit(0).alias("pos"), "type", "text", "date_text")
    return V.save_research(valid, table(spark, d, "leads"), table(spark, d, "research").select(F.lit("c1").alias("campaign_id"), "lead_id", "document"), none)[2].select("lead_id", "error")


@query(f"""+docs AS ({_DOCS}), saved AS (SELECT docs.* FROM docs JOIN leads USING (lead_id) WHERE CAST(substr(lead_id, 4) AS INTEGER) % 6 < 2 AND status <> 'duplicate'),
  research2 AS (SELECT lead_id, document FROM research WHERE lead_id NOT IN (SELECT lead_id FROM saved) UNION ALL SELECT lead_id, document FROM saved),
  signals2 AS (SELECT lead_id, type, date_text FROM signals WHERE lead_id NOT IN (SELECT lead_id FROM saved) UNION ALL SELECT lead_id, unnest(['hiring', 'news']), unnest(['2024-01', '2023-12-05']) FROM saved WHERE CAST(substr(lead_id, 4) AS INTEGER) % 6 = 0),
  {_FEAT.replace("FROM research", "FROM research2").replace("FROM signals", "FROM signals2")} SELECT lead_id, total, grade FROM scored WHERE status NOT IN ('duplicate', 'suppressed') AND (score IS DISTINCT FROM total OR tier IS DISTINCT FROM grade)""", _T)
def p4_save_and_score(spark, d):
    """Documents -> valid ones saved with their signals -> leads scored with what is now known: the rows that change."""
    valid, _ = V.validate_research(_docs(spark, d))
    old = table(spark, d, "signals").select(F.lit("c1").alias("campaign_id"), "lead_id", F.col("event_id").cast("int").alias("pos"), "type", "text", "date_text")
    research, now, _ = V.save_research(valid, table(spark, d, "leads"), table(spark, d, "research").select(F.lit("c1").alias("campaign_id"), "lead_id", "document"), old)
    features = C.extract_features(leads(spark, d), table(spark, d, "branches"), research, now, segments(spark), AS_OF_MONTH, PROFILE_MIN)
    return C.score_campaign(C.score(C.score_features(features))).select("lead_id", "total", "grade")


@query("SELECT lead_id, score FROM leads WHERE status IN ('candidate', 'approved') AND tier IN ('A', 'B') AND score >= 70 AND research_status IN ('saved', 'no_signal')", ("leads",))
def f4_filter_leads(spark, d):
    return L.filter_leads(leads(spark, d), ["candidate", "approved"], ["A", "B"], None, 70, ["saved", "no_signal"]).select("lead_id", "score")


@query("SELECT lead_id, score FROM leads WHERE status <> 'duplicate' ORDER BY score DESC NULLS LAST, lead_id LIMIT 25 OFFSET 50", ("leads",))
def l1_list_leads(spark, d):
    return L.list_leads(leads(spark, d), "score_desc", 25, 50)[0].select("lead_id", "score")


@query(f"SELECT lead_id, {name_norm('name')} AS name_norm FROM leads WHERE status <> 'duplicate' ORDER BY 2, 1 LIMIT 100", ("leads",))
def l1_list_leads_by_name(spark, d):
    return L.list_leads(leads(spark, d), "name_asc", 100)[0].select("lead_id", "name_norm")


@query("""SELECT l.lead_id, dealer_name, document IS NOT NULL AS researched, coalesce(n, 0) AS n_signals, first_date FROM leads l LEFT JOIN dealers USING (dealer_id) LEFT JOIN research USING (lead_id)
  LEFT JOIN (SELECT lead_id, count(*) AS n, min(date_text) AS first_date FROM signals GROUP BY 1) s USING (lead_id)""", ("leads", "dealers", "research", "signals"))
def l2_lead_detail(spark, d):
    out = L.lead_detail(leads(spark, d), table(spark, d, "dealers"), table(spark, d, "research"), table(spark, d, "signals"))
    return out.select("lead_id", "dealer_name", F.col("document").isNotNull().alias("researched"), F.coalesce(F.size("signals"), F.lit(0)).cast("bigint").alias("n_signals"), F.get("signals", F.lit(0))["date_text"].alias("first_date"))


_UPD = """SELECT o_orderkey AS seq, concat('fx_', lpad(CAST(o_custkey + (CASE WHEN o_orderkey % 31 = 0 THEN 10000000 ELSE 0 END) AS STRING), 8, '0')) AS lead_id,
  CASE o_orderkey % 5 WHEN 0 THEN 'approved' WHEN 1 THEN 'hold' WHEN 2 THEN 'odd' END AS new_status,
  CASE WHEN o_orderkey % 5 = 3 THEN concat('d', CAST(o_orderkey % 14 AS STRING)) END AS new_dealer FROM orders"""
_UPDATED = f"""upd AS ({_UPD}), latest AS (SELECT * FROM upd QUALIFY row_number() OVER (PARTITION BY lead_id ORDER BY seq DESC) = 1),
checked AS (SELECT u.*, l.status, CASE WHEN l.status IS NULL THEN 'unknown lead' WHEN new_status IS NULL AND new_dealer IS NULL THEN 'nothing to change' WHEN new_status = 'odd' THEN 'unknown status'
  WHEN l.status = 'suppressed' AND new_status <> 'suppressed' THEN 'lead is suppressed' WHEN new_dealer IS NOT NULL AND new_dealer NOT IN (SELECT dealer_id FROM dealers) THEN 'unknown dealer' END AS error FROM latest u LEFT JOIN leads l USING (lead_id))"""


def _updates(spark, d):
    return spark.sql(_UPD.replace("FROM orders", "FROM {orders}"), orders=table(spark, d, "orders"))


def _updated(spark, d):
    return L.apply_updates(leads(spark, d), _updates(spark, d), table(spark, d, "branches"), table(spark, d, "dealers"))


@query(f"""+{_UPDATED}, near AS (SELECT l.lead_id, b.branch_id FROM checked c JOIN leads l USING (lead_id) JOIN branches b ON b.dealer_id = c.new_dealer WHERE error IS NULL
  QUALIFY row_number() OVER (PARTITION BY l.lead_id ORDER BY {distance_m('lat', 'lon', 'branch_lat', 'branch_lon')}, b.branch_id) = 1)
  SELECT l.lead_id, coalesce(c.new_status, l.status) AS status, coalesce(c.new_dealer, l.dealer_id) AS dealer_id, CASE WHEN c.new_dealer IS NOT NULL THEN n.branch_id ELSE l.branch_id END AS branch_id,
  CASE WHEN c.new_dealer IS NOT NULL THEN 'override' ELSE l.assignment END AS assignment FROM leads l LEFT JOIN (SELECT * FROM checked WHERE error IS NULL) c USING (lead_id) LEFT JOIN near n USING (lead_id)""", ("leads", "branches", "dealers"))
def l3_apply_updates(spark, d):
    return _updated(spark, d)[0].select("lead_id", "status", "dealer_id", "branch_id", "assignment")


@query(f"+{_UPDATED} SELECT lead_id, error FROM checked WHERE error IS NOT NULL", ("leads", "dealers"))
def l3_update_errors(spark, d):
    return _updated(spark, d)[1]


@query("""SELECT facet, value, count(*) AS leads FROM (SELECT unnest(['status', 'tier', 'dealer']) AS facet, unnest([status, tier, dealer_id]) AS value FROM leads WHERE status <> 'duplicate') x WHERE value IS NOT NULL GROUP BY 1, 2""", ("leads",))
def l4_campaign_counts(spark, d):
    return L.campaign_counts(leads(spark, d)).select("facet", "value", "leads")


@query("SELECT c.campaign_id, coalesce(n, 0) AS leads FROM (SELECT concat('c', CAST(n_nationkey AS STRING)) AS campaign_id FROM nation) c LEFT JOIN (SELECT campaign_id, count(*) AS n FROM leads GROUP BY 1) x USING (campaign_id)", ("leads",))
def l5_list_campaigns(spark, d):
    campaigns = table(spark, d, "nation").select(F.concat(F.lit("c"), F.col("n_nationkey").cast("string")).alias("campaign_id"), F.col("n_regionkey").alias("created"))
    return L.list_campaigns(campaigns, leads(spark, d)).select("campaign_id", "leads")


@query("""SELECT dealer_id, dealer_name, (SELECT count(*) FROM branches b WHERE b.dealer_id = d.dealer_id) AS branches, (SELECT count(*) FROM territories t WHERE t.dealer_id = d.dealer_id) AS territories FROM dealers d""", ("dealers", "branches", "territories"))
def l6_list_dealers(spark, d):
    return L.list_dealers(*(table(spark, d, t) for t in ("dealers", "branches", "territories")))


@query("""SELECT 'dealers' AS list, count(*) AS rows FROM dealers UNION ALL SELECT 'branches', count(*) FROM branches UNION ALL SELECT 'territories', count(*) FROM territories UNION ALL SELECT 'suppression', count(*) FROM suppression""", ("dealers", "branches", "territories", "suppression"))
def l7_list_counts(spark, d):
    return L.list_counts({t: table(spark, d, t) for t in ("dealers", "branches", "territories", "suppression")})


@query("SELECT site_id, confidence FROM leads WHERE status = 'candidate' ORDER BY confidence DESC, site_id LIMIT 10", ("leads",))
def l9_sample_candidates(spark, d):
    return L.sample_candidates(leads(spark, d)).select("site_id", "confidence")


@query("SELECT leaf, count(*) AS places, arg_min('services|' || lower(region) || '|' || leaf, site_id) AS hierarchy FROM leads WHERE leaf LIKE '%il%' OR lower(region) LIKE '%il%' OR 'services' LIKE '%il%' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50", ("leads",))
def l10_category_counts(spark, d):
    return L.category_counts(leads(spark, d), "il").withColumn("hierarchy", F.array_join("hierarchy", "|"))


# Codes and titles to look up.
NAICS = [("23", "Construction"), ("2381", "Foundation, Structure, and Building Exterior Contractors"), ("238160", "Roofing Contractors"), ("23816", "Roofing Contractors"), ("238210", "Electrical Contractors"),
         ("31-33", "Manufacturing"), ("332312", "Fabricated Structural Metal Manufacturing"), ("3272", "Glass and Glass Product Manufacturing"), ("493110", "General Warehousing and Storage"), ("49311", "General Warehousing and Storage"),
         ("4931", "Warehousing and Storage"), ("339950", "Sign Manufacturing"), ("4841", "General Freight Trucking"), ("488510", "Freight Transportation Arrangement"), ("541614", "Logistics Consulting Services")]
_NAICS_SQL = "naics AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{t}')" for c, t in NAICS) + ") t(code, title))"
_SHARED = "(SELECT count(*) FROM range(1, least(length(q), length(t)) + 1) r(i) WHERE substr(q, 1, CAST(i AS INTEGER)) = substr(t, 1, CAST(i AS INTEGER)))"


@query(rf"""WITH {_NAICS_SQL}, asked AS (SELECT p_partkey AS query_id, CASE p_partkey % 4 WHEN 0 THEN 'roofers and contractor' WHEN 1 THEN 'glass manufacturer' WHEN 2 THEN 'general warehouse storage' ELSE p_type || ' structural metals' END AS query FROM part),
  codes AS (SELECT * FROM naics QUALIFY row_number() OVER (PARTITION BY lower(title) ORDER BY length(code) DESC, code) = 1),
  tt AS (SELECT code, title, len(w) AS size, unnest(w) AS t, generate_subscripts(w, 1) AS pos FROM (SELECT code, title, list_filter(regexp_split_to_array(lower(title), '[^\p{{L}}\p{{Nd}}]+'), lambda x: x <> '') AS w FROM codes)),
  qq AS (SELECT DISTINCT query_id, unnest(regexp_split_to_array(lower(query), '[^\p{{L}}\p{{Nd}}]+')) AS q FROM asked),
  tq AS (SELECT DISTINCT q, t FROM qq, tt WHERE substr(q, 1, 4) = substr(t, 1, 4) AND length(q) >= 4 AND length(t) >= 4), sh AS (SELECT q, t, {_SHARED} AS shared FROM tq),
  best AS (SELECT query_id, code, title, size, pos, max(shared) AS shared FROM qq JOIN sh USING (q) JOIN tt USING (t) WHERE (shared = least(length(q), length(t)) AND shared >= 4) OR shared >= 6 GROUP BY ALL),
  ranked AS (SELECT query_id, code, title, size, count(*) AS matched, sum(shared) AS prefix FROM best GROUP BY ALL)
  SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, code, title FROM ranked WINDOW w AS (PARTITION BY query_id ORDER BY matched DESC, matched / size DESC, prefix DESC, length(code), code) QUALIFY row_number() OVER w <= 10""")
def l11_rank_naics(spark, d):
    k = F.col("p_partkey") % 4
    asked = table(spark, d, "part").select(F.col("p_partkey").alias("query_id"), F.when(k == 0, "roofers and contractor").when(k == 1, "glass manufacturer").when(k == 2, "general warehouse storage").otherwise(F.concat("p_type", F.lit(" structural metals"))).alias("query"))
    return L.rank_naics(asked, spark.createDataFrame(NAICS, "code string, title string"))


@query("SELECT campaign_id, lead_id, name, status, dealer_id, branch_id, assignment, suppress_reason FROM leads", ("leads",))
def l12_routed_leads(spark, d):
    return L.routed_leads(leads(spark, d))
