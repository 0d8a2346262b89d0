"""Domain tables derived from the driver's tables by integer arithmetic that any SQL engine repeats.

Each is one SQL text in the dialect that Spark and DuckDB share; `{name}` stands for a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AS_OF_MONTH = 2024 * 12 + 1
MAIL_DATE, WINDOW_DAYS = "1996-01-01", 365


def _case(value: str, words: list[str]) -> str:
    return f"CASE {value} " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(words)) + " END"


_WORD = _case("g % 8", ["Acme", "Bayou", "Coastal", "Delta", "Evergreen", "Frontier", "The Gulf", "Harbor & Sons"])
_WORD2 = _case("CAST(floor(g / 8) AS BIGINT) % 9", ["Logistics", "Steel", "Roofing", "Signs", "Electric", "Storage", "Marine", "Glass", "Farms"])

SQL = {
    "sites": f"""
      SELECT k, g, concat('fx_', lpad(CAST(k AS STRING), 8, '0')) AS site_id,
        concat({_WORD}, ' ', {_WORD2}, ' ', CAST(g AS STRING), CASE WHEN k % 3 = 0 THEN ' LLC' WHEN k % 3 = 1 THEN ', Inc.' WHEN g % 5 = 0 THEN 'b' ELSE '' END) AS name,
        29.5E0 + CAST(g * 37 % 1000 AS DOUBLE) / 1000E0 + CAST(k % 3 AS DOUBLE) * 0.0005E0 AS lat,
        -95.8E0 + CAST(g * 61 % 1000 AS DOUBLE) / 1000E0 AS lon,
        0.4E0 + CAST(k * 7919 % 600 AS DOUBLE) / 1000E0 AS confidence,
        lpad(CAST(77000 + g % 600 AS STRING), 5, '0') AS postcode,
        CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN concat('facebook.com/p', CAST(k AS STRING)) ELSE concat('https://www.co', CAST(g AS STRING), '.example/x') END AS website,
        concat(CAST(100 + g % 900 AS STRING), ' Main St., Suite #', CAST(k % 7 AS STRING)) AS address,
        lower(c_mktsegment) AS leaf, r_name AS region, CAST(k * 31 % 11 AS INT) AS hue
      FROM (SELECT c_custkey AS k, CAST(floor(c_custkey / 3) AS BIGINT) AS g, c_mktsegment, c_nationkey FROM {{customer}}) c
      JOIN {{nation}} n ON n.n_nationkey = c.c_nationkey JOIN {{region}} r ON r.r_regionkey = n.n_regionkey""",
    "counties": """
      SELECT concat('48', lpad(CAST(2 * n_nationkey + 1 AS STRING), 3, '0')) AS geoid, concat('County ', n_name) AS name, '48' AS statefp,
        -95.8E0 + CAST(n_nationkey % 5 AS DOUBLE) * 0.2E0 + 0.00013E0 AS xmin, -95.8E0 + CAST(n_nationkey % 5 + 1 AS DOUBLE) * 0.2E0 + 0.00013E0 AS xmax,
        29.5E0 + CAST(floor(n_nationkey / 5) AS DOUBLE) * 0.2E0 + 0.00013E0 AS ymin, 29.5E0 + CAST(floor(n_nationkey / 5) + 1 AS DOUBLE) * 0.2E0 + 0.00013E0 AS ymax
      FROM {nation}""",
    "branches": """
      SELECT concat('b', CAST(s_suppkey AS STRING)) AS branch_id, concat('d', CAST(s_suppkey % 12 AS STRING)) AS dealer_id,
        29.5E0 + CAST(s_suppkey * 53 % 1000 AS DOUBLE) / 1000E0 AS branch_lat, -95.8E0 + CAST(s_suppkey * 71 % 1000 AS DOUBLE) / 1000E0 AS branch_lon FROM {supplier}""",
    "dealers": """SELECT DISTINCT concat('d', CAST(s_suppkey % 12 AS STRING)) AS dealer_id, concat('Dealer ', CAST(s_suppkey % 12 AS STRING)) AS dealer_name FROM {supplier}""",
    "territories": """
      SELECT concat('d', CAST(s_suppkey % 12 AS STRING)) AS dealer_id, concat('b', CAST(s_suppkey AS STRING)) AS branch_id, 'county' AS level,
        concat('48', lpad(CAST(2 * (s_suppkey % 20) + 1 AS STRING), 3, '0')) AS code, CAST(1 + s_suppkey % 2 AS INT) AS priority FROM {supplier} WHERE s_suppkey <= 60
      UNION ALL
      SELECT concat('d', CAST(s_suppkey % 12 AS STRING)), CASE WHEN s_suppkey % 9 = 0 THEN 'gone' ELSE concat('b', CAST(s_suppkey AS STRING)) END, 'zip',
        CAST(77000 + s_suppkey * 7 % 600 AS STRING), CAST(1 + s_suppkey % 3 AS INT) FROM {supplier}""",
    "suppression": """
      SELECT concat('s', lpad(CAST(k AS STRING), 8, '0')) AS rule_id, concat(name, ' Corp') AS company_name,
        CASE WHEN k % 100 = 0 THEN concat('co', CAST(g AS STRING), '.example') END AS rule_domain,
        CASE WHEN k % 3 <> 0 THEN postcode END AS rule_zip,
        CASE k % 5 WHEN 0 THEN 'customer' WHEN 1 THEN 'dnc' WHEN 2 THEN 'dealer' WHEN 3 THEN 'competitor' ELSE 'other' END AS reason
      FROM {sites} WHERE k % 50 = 0 OR k % 49 = 0""",
    "research": """
      SELECT concat('fx_', lpad(CAST(c_custkey AS STRING), 8, '0')) AS lead_id,
        CASE WHEN c_custkey % 30 = 0 THEN '{{broken' ELSE concat('{{"facilityFit":{{"level":"', CASE c_custkey % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' WHEN 3 THEN 'unknown' ELSE 'odd' END,
          '"}},"employeeEstimate":{{"value":', CAST(c_custkey % 120 AS STRING), '}},"llmAdjustment":', CAST(c_custkey % 41 - 20 AS STRING), '}}') END AS document
      FROM {customer} WHERE c_custkey % 2 = 0""",
    "signals": """
      SELECT concat('fx_', lpad(CAST(user_id AS STRING), 8, '0')) AS lead_id, event_id,
        CASE event_type WHEN 'purchase' THEN 'contract' WHEN 'signup' THEN 'expansion' WHEN 'click' THEN 'hiring' WHEN 'view' THEN 'registry' ELSE 'other' END AS type,
        concat('Seen at ', CAST(event_id AS STRING)) AS text,
        CASE WHEN event_id % 13 = 0 THEN 'soon' ELSE concat(CAST(CAST(floor((24289 - event_id % 18 + 2 * (CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END) - 1) / 12) AS BIGINT) AS STRING), '-',
          lpad(CAST((24289 - event_id % 18 + 2 * (CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END) - 1) % 12 + 1 AS STRING), 2, '0'), CASE WHEN event_id % 3 = 0 THEN '-15' ELSE '' END) END AS date_text
      FROM {events}""",
    "cbp": """
      SELECT naics, county_fips, band, label, CAST(sum(n) AS BIGINT) AS estab FROM (
        SELECT CASE WHEN l_partkey % 3 = 0 THEN '4931' WHEN l_partkey % 3 = 1 THEN '49311' ELSE '238210' END AS naics, concat('48', lpad(CAST(2 * s_nationkey + 1 AS STRING), 3, '0')) AS county_fips,
          CASE WHEN p_size <= 10 THEN '212' WHEN p_size <= 20 THEN '220' WHEN p_size <= 30 THEN '230' WHEN p_size <= 40 THEN '241' ELSE '254' END AS band,
          CASE WHEN p_size <= 10 THEN 'Establishments with less than 5 employees' WHEN p_size <= 20 THEN 'Establishments with 5 to 9 employees' WHEN p_size <= 30 THEN 'Establishments with 10 to 19 employees'
            WHEN p_size <= 40 THEN 'Establishments with 20 to 49 employees' ELSE 'Establishments with 50 employees or more' END AS label, 1 AS n
        FROM {lineitem} JOIN {part} ON p_partkey = l_partkey JOIN {supplier} ON s_suppkey = l_suppkey
        WHERE (p_size * 31 + s_nationkey) % 17 <> 0 AND NOT (s_nationkey = 3 AND l_partkey % 3 = 0)
        UNION ALL
        SELECT CASE WHEN l_partkey % 3 = 0 THEN '4931' WHEN l_partkey % 3 = 1 THEN '49311' ELSE '238210' END, concat('48', lpad(CAST(2 * s_nationkey + 1 AS STRING), 3, '0')), '001', 'All establishments', 1
        FROM {lineitem} JOIN {supplier} ON s_suppkey = l_suppkey WHERE NOT (s_nationkey = 3 AND l_partkey % 3 = 0)
        UNION ALL
        SELECT CASE WHEN l_partkey % 3 = 0 THEN '4931' WHEN l_partkey % 3 = 1 THEN '49311' ELSE '238210' END, concat('48', lpad(CAST(2 * s_nationkey + 1 AS STRING), 3, '0')), '263', 'Establishments with 60 to 99 employees', 1
        FROM {lineitem} JOIN {part} ON p_partkey = l_partkey JOIN {supplier} ON s_suppkey = l_suppkey WHERE p_size > 47 AND NOT (s_nationkey = 3 AND l_partkey % 3 = 0)
      ) x GROUP BY naics, county_fips, band, label""",
    "sales": """
      SELECT o_orderkey AS sale_id, CASE WHEN o_orderkey % 9 = 0 THEN concat(name, 's') ELSE name END AS customer_name,
        CASE WHEN o_orderkey % 4 = 3 THEN '77999' ELSE postcode END AS sale_zip, CASE WHEN o_orderkey % 6 = 0 THEN address ELSE concat(CAST(o_orderkey AS STRING), ' Other Rd') END AS sale_address,
        CAST(o_orderdate AS DATE) AS sale_date, CASE WHEN o_orderkey % 40 = 0 THEN upper(concat('LIFT-', lpad(CAST(k AS STRING), 6, '0'))) END AS promo_code, o_totalprice AS amount
      FROM {orders} JOIN {sites} s ON s.k = o_custkey""",
    "leads": """
      SELECT 'c1' AS campaign_id, site_id AS lead_id, site_id, k, g, name, lat, lon, confidence, postcode, website, address, leaf, region,
        CASE WHEN k % 23 = 0 THEN 'duplicate' WHEN k % 19 = 0 THEN 'suppressed' WHEN k % 11 = 0 THEN 'approved' WHEN k % 13 = 0 THEN 'rejected' ELSE 'candidate' END AS status,
        CASE WHEN k % 19 = 0 THEN 'approved' END AS pre_status, CASE WHEN k % 19 = 0 THEN 'dnc' END AS suppress_reason,
        CASE WHEN k % 29 = 0 THEN 'override' WHEN k % 2 = 0 THEN 'auto' ELSE 'gap' END AS assignment,
        CASE WHEN k % 29 = 0 OR k % 2 = 0 THEN concat('d', CAST(k % 12 AS STRING)) END AS dealer_id, CASE WHEN k % 29 = 0 OR k % 2 = 0 THEN concat('b', CAST(k % 12 + 12 AS STRING)) END AS branch_id,
        CASE WHEN k % 7 = 0 THEN NULL ELSE CAST(k * 37 % 101 AS INT) END AS score,
        CASE WHEN k % 7 = 0 THEN NULL WHEN k * 37 % 101 >= 80 THEN 'A' WHEN k * 37 % 101 >= 65 THEN 'B' ELSE 'C' END AS tier,
        CASE WHEN k % 2 = 0 AND k % 10 = 0 THEN 'no_signal' WHEN k % 2 = 0 THEN 'saved' ELSE 'none' END AS research_status,
        concat('48', lpad(CAST(2 * (g % 25) + 1 AS STRING), 3, '0')) AS county_fips
      FROM {sites}""",
    "responses": """
      SELECT event_id, concat('fx_', lpad(CAST(user_id AS STRING), 8, '0')) AS lead_id, ts,
        CASE event_type WHEN 'view' THEN 'visit' WHEN 'click' THEN 'scan' WHEN 'signup' THEN 'form' WHEN 'purchase' THEN 'redemption' ELSE 'call' END AS response_type FROM {events}""",
    "outcomes": """
      SELECT event_id AS outcome_id, concat('fx_', lpad(CAST(user_id AS STRING), 8, '0')) AS lead_id, ts AS outcome_ts,
        CASE event_id % 4 WHEN 0 THEN 'won' WHEN 1 THEN 'quoted' WHEN 2 THEN 'contacted' ELSE 'lost' END AS outcome, value FROM {events} WHERE event_type = 'purchase'""",
}

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")


def _used(text: str) -> list[str]:
    return [n for n in (*BASE, *SQL) if "{" + n + "}" in text]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain table, or one of the driver's, as a lazy DataFrame."""
    if name not in SQL:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(SQL[name], **{n: table(spark, sf_dir, n) for n in _used(SQL[name])})


def with_tables(query: str, *names: str) -> str:
    """SQL for DuckDB with the domain tables in front of a query, `WITH` left out of it."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in SQL and name not in order:
            for n in _used(SQL[name]):
                add(n)
            order.append(name)

    for n in names:
        add(n)
    ctes = [f"{n} AS ({SQL[n].format(**{m: m for m in (*BASE, *SQL)})})" for n in order]
    return "WITH RECURSIVE " + ", ".join(ctes) + (", " if query.lstrip().startswith("+") else " ") + query.lstrip().removeprefix("+")
