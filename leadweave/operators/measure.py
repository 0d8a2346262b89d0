"""Campaign measurement: codes, cohorts, mailing, matchback, credit, lift, funnels; page features and review edits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadweave.functions.binding import let
from leadweave.operators.blocks import split_blocks
from leadweave.operators.nearest import nearest_names
from leadweave.operators.ranks import grouped_median, with_place
from leadweave.operators.routing import sized
from leadweave.sources.shared import written

CODE_LETTERS = "23456789ABCDEFGHJKLMNPQRSTUVWXYZ"
ROUNDS = 20


# Elements whose ends close what is open inside them, those of them that hold no text of a page's own, and named characters.
CONTAINERS = ("article", "aside", "blockquote", "body", "details", "dialog", "div", "fieldset", "figure", "footer", "form", "header", "html", "li", "main", "nav", "ol", "section", "table", "td", "th", "tr", "ul")
UNREAD = ("nav", "footer")
NAMED = (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&"))
# A comment, script or style sheet that isn't closed goes on to the end of the page.
_RAW = r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\z)"
_CONTAINER = rf"(?i)</?(?:{'|'.join(CONTAINERS)})(?=[\s/>])[^>]*>"
_ENTITY = rf"&(?:{'|'.join(n for n, _ in NAMED)}|#[0-9]{{1,7}}|#[xX][0-9a-fA-F]{{1,6}});"


def outside_blocks(html: Column) -> Column:
    """The parts of html that are in no nav or footer, joined by blanks.

    The tags of containers are events in order. The elements open after each are kept as a string of names, the
    innermost first: an end closes its element and all inside it, an end of nothing open is passed over, and what is never closed goes on to
    the end of what it is in. So nested and unclosed blocks end where a browser ends them.
    """
    tags = F.regexp_extract_all(html, F.lit(f"({_CONTAINER})"), F.lit(1))
    name = lambda tag: F.concat(F.lit("<"), F.lower(F.regexp_extract(tag, r"^</?([A-Za-z]+)", 1)), F.lit(">"))

    def follow(state: Column, tag: Column) -> Column:
        at = F.locate("</", tag)
        found = F.instr(state["open"], name(tag))
        inside = F.when(at != 1, F.concat(name(tag), state["open"])).when(found > 0, F.substr(state["open"], found + F.length(name(tag)))).otherwise(state["open"])
        return let(inside, lambda now: F.struct(now.alias("open"), F.concat(state["seen"], F.when(now.rlike(f"<(?:{'|'.join(UNREAD)})>"), "0").otherwise("1")).alias("seen")))

    # A digit for each part: 1 outside, 0 inside; the part before the first tag is outside.
    seen = F.aggregate(tags, F.struct(F.lit("").alias("open"), F.lit("1").alias("seen")), follow, lambda s: F.split(s["seen"], "(?!^)(?!$)"))
    parts = F.zip_with(F.split(html, _CONTAINER, -1), seen, lambda part, visible: F.when(visible == "1", part).otherwise(""))
    return F.when(html.rlike(f"(?i)<(?:{'|'.join(UNREAD)})\\b"), F.array_join(parts, " ")).otherwise(html)


def decoded(text: Column) -> Column:
    """text with named and numeric characters put in, each once; numbers of no character are U+FFFD."""

    def one(entity: Column) -> Column:
        number = F.when(entity.rlike("^&#[xX]"), F.conv(F.regexp_extract(entity, "([0-9a-fA-F]+);$", 1), 16, 10)).otherwise(F.regexp_extract(entity, "([0-9]+);$", 1)).try_cast("int")
        proper = lambda n: F.when((n > 0) & (n < 0x110000) & ~n.between(0xD800, 0xDFFF), n).otherwise(0xFFFD)
        named = F.lit(None).cast("string")
        for word, value in NAMED:
            named = F.when(entity == f"&{word};", value).otherwise(named)
        return F.when(entity.startswith("&#"), let(number, lambda n: F.decode(F.unhex(F.lpad(F.hex(proper(n)), 8, "0")), "UTF-32"))).otherwise(named)

    found = F.transform(F.regexp_extract_all(text, F.lit(f"({_ENTITY})"), F.lit(1)), one)
    put = F.zip_with(F.split(text, _ENTITY, -1), F.concat(found, F.array(F.lit(""))), lambda a, b: F.concat(a, b))
    return F.when(text.contains("&"), F.array_join(put, "")).otherwise(text)


def visible_text(html: Column) -> Column:
    """What a reader of the page sees outside nav and footer, white space as single blanks; null is empty."""
    raw = F.regexp_replace(F.coalesce(html, F.lit("")), _RAW, " ")
    text = let(raw, lambda h: F.regexp_replace(outside_blocks(h), r"(?s)<[^>]*>", " "))
    return F.trim(F.regexp_replace(let(text, decoded), r"[\s\x{A0}]+", " "))


def page_features(pages: DataFrame, keywords: list[str], html: str = "html") -> DataFrame:
    """page_id, visible text up to 4000 characters, and the distinct keywords in it as whole words in any case."""
    out = pages.withColumn("_text", visible_text(F.col(html)))
    hits = F.array_compact(F.array(*(F.when(F.col("_text").rlike(rf"(?iu)(?<![\p{{L}}\p{{Nd}}])\Q{k}\E(?![\p{{L}}\p{{Nd}}])"), F.lit(k)) for k in keywords)))
    return out.select("page_id", F.substring("_text", 1, 4000).alias("excerpt"), hits.alias("keywords"), F.size(hits).alias("keyword_count"))


def prefetch_summary(pages: DataFrame) -> DataFrame:
    """Counts of fetched, robots-blocked, failed and absent websites."""
    return pages.agg(*(F.count_if(F.col("fetch_status") == s).alias(s) for s in ("fetched", "robots_blocked", "error", "no_website")))


def review_tables(leads: DataFrame, breakdown: DataFrame, signals: DataFrame) -> dict[str, DataFrame]:
    """The review workbook's sheets as tables: leads, evidence, summary."""
    sheet = leads.where("status <> 'duplicate'").select("lead_id", "name", "status", "score", "tier", "dealer_id")
    evidence = breakdown.join(sheet.select("lead_id"), "lead_id", "left_semi").select("lead_id", F.lit("score").alias("kind"), F.concat_ws(": ", "feature", F.col("contribution").cast("string")).alias("text")).unionByName(
        signals.join(sheet.select("lead_id"), "lead_id", "left_semi").select("lead_id", F.lit("signal").alias("kind"), "text")
    )
    summary = sheet.groupBy("status", "tier").agg(F.count("*").alias("leads"))
    return {"leads": sheet, "evidence": evidence, "summary": summary}


def export_review(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")


# What reviewers write for a status.
STATUS_WORDS = {
    "approve": "approved", "approved": "approved", "yes": "approved", "y": "approved", "ok": "approved", "reject": "rejected", "rejected": "rejected", "no": "rejected", "n": "rejected",
    "hold": "hold", "wait": "hold", "review": "review", "candidate": "candidate",
}


def import_review(leads: DataFrame, edits: DataFrame, dealers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(leads, log): edits (lead_id, status_text, dealer_text) by lead; blank leaves as it is; a dealer by id or name.

    The log has a row per change, and one per edit that can't be read or whose lead is unknown. Of two
    edits of a lead that differ the first by alphabet holds, and the log names both.
    """
    words = F.create_map(*(F.lit(x) for pair in STATUS_WORDS.items() for x in pair))
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    by_text = sized(dealers.select(F.explode(F.array_distinct(F.array(F.lower("dealer_id"), F.lower("dealer_name")))).alias("_d"), F.col("dealer_id").alias("_dealer")))
    read = edits.select("lead_id", blank("status_text").alias("_s"), F.lower(blank("dealer_text")).alias("_d")).join(by_text, "_d", "left").withColumn("_status", F.element_at(words, F.lower("_s")))
    met = read.join(leads.select("lead_id", "status", "dealer_id"), "lead_id", "left")
    say = lambda cond, what, old, new: F.when(cond, F.struct(F.lit(what).alias("change"), old.alias("old"), new.alias("new")))
    c, none = F.col, F.lit(None).cast("string")
    known = c("status").isNotNull()
    log = met.select("lead_id", F.inline(F.array_compact(F.array(
        say(~known, "unknown lead", none, none), say(known & c("_s").isNotNull() & c("_status").isNull(), "unknown status", none, c("_s")), say(known & c("_d").isNotNull() & c("_dealer").isNull(), "unknown dealer", none, c("_d")),
        say(known & c("_status").isNotNull() & (c("_status") != c("status")), "status", c("status"), c("_status")), say(known & c("_dealer").isNotNull() & ~c("_dealer").eqNullSafe(c("dealer_id")), "dealer", c("dealer_id"), c("_dealer")),
    ))))
    change = read.groupBy("lead_id").agg(*(f(x).alias(f"{y}{x}") for x in ("_status", "_dealer") for f, y in ((F.min, ""), (F.max, "_max"))))
    two = change.select("lead_id", F.inline(F.array_compact(F.array(*(say(c(x) < c(f"_max{x}"), f"two edits of a {y}", c(x), c(f"_max{x}")) for x, y in (("_status", "status"), ("_dealer", "dealer")))))))
    log = log.unionByName(two)
    out = leads.join(change, "lead_id", "left")
    new = {"status": F.coalesce("_status", "status"), "dealer_id": F.coalesce("_dealer", "dealer_id"), "assignment": F.when(c("_dealer").isNotNull() & ~c("_dealer").eqNullSafe(c("dealer_id")), "override").otherwise(c("assignment"))}
    return out.select(*(new[x].alias(x) if x in new else F.col(x) for x in leads.columns)), log


def _code(campaign: Column, lead: Column, attempt: Column, seed: str) -> Column:
    h = F.xxhash64(F.lit(seed), campaign, lead, attempt)
    return F.concat(*(F.substring(F.lit(CODE_LETTERS), (F.shiftrightunsigned(h, 5 * i).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for i in range(6)))


def assign_tracking_codes(leads: DataFrame, codes: DataFrame, base_url: str, prefix: str = "LIFT", seed: str = "codes") -> DataFrame:
    """codes and a new one for every lead without: six letters from a seeded hash, tried again while it is taken."""
    from leadweave.sources.shared import written

    new = leads.select("campaign_id", "lead_id").distinct().join(codes, ["campaign_id", "lead_id"], "left_anti").withColumn("attempt", F.lit(0))
    taken = codes.select("campaign_id", "lead_id", "code")
    for _ in range(ROUNDS):
        made = new.withColumn("code", _code(F.col("campaign_id"), F.col("lead_id"), F.col("attempt"), seed))
        order = Window.partitionBy("code").orderBy("campaign_id", "lead_id")
        ranked = made.withColumn("_rn", F.row_number().over(order)).join(taken.select("code", F.lit(True).alias("_taken")).distinct(), "code", "left")
        ranked = written(ranked, "codes")
        good = (F.col("_rn") == 1) & F.col("_taken").isNull()
        taken = taken.unionByName(ranked.where(good).select("campaign_id", "lead_id", "code"))
        new = ranked.where(~good).select("campaign_id", "lead_id", (F.col("attempt") + 1).alias("attempt"))
        if new.isEmpty():
            break
    else:
        raise RuntimeError("the space of codes is full")
    url = F.replace(F.lit(base_url), F.lit("{code}"), F.col("code")) if "{code}" in base_url else F.concat(F.lit(base_url), F.lit("?code="), "code")
    return taken.withColumns({"url": url, "offer_code": F.concat(F.lit(f"{prefix}-"), "code")})


def assign_cohorts(leads: DataFrame, designs: list[list[tuple[str, float]]], seed: str) -> DataFrame:
    """(lead_id, cohort): by strata of tier and dealer, in the order of a seeded digest, split in proportion; designs nest into a path."""
    base = leads.select("lead_id", F.coalesce("tier", F.lit("-")).alias("tier"), F.coalesce("dealer_id", F.lit("-")).alias("dealer_id")).withColumn("cohort", F.lit(""))
    for design in designs:
        total = sum(share for _, share in design)
        base = with_place(base, ["tier", "dealer_id", "cohort"], [F.sha2(F.concat(F.lit(seed), "lead_id"), 256), F.col("lead_id")], "_p", "_n")
        name, reached = F.lit(design[-1][0]), 0.0
        chosen = None
        for label, share in design[:-1]:
            reached += share / total
            inside = F.col("_p") <= F.round(F.col("_n") * reached)
            chosen = F.when(inside, label) if chosen is None else chosen.when(inside, label)
        name = chosen.otherwise(name) if chosen is not None else name
        base = base.withColumn("cohort", F.concat_ws("/", F.nullif("cohort", F.lit("")), name)).drop("_p", "_n")
    return base.select("lead_id", "cohort")


def mailing_manifest(leads: DataFrame, codes: DataFrame, cohorts: DataFrame, wave: str) -> tuple[DataFrame, DataFrame]:
    """(rows to mail, counts by reason): approved leads of the wave, without suppressed, held out and later ones."""
    met = leads.join(cohorts, "lead_id", "left").join(codes.select("lead_id", "code"), "lead_id", "left")
    reason = (
        F.when(F.col("status") == "suppressed", "suppressed").when(F.col("status") != "approved", "not approved").when(F.coalesce(F.col("cohort").contains("holdout"), F.lit(False)), "holdout")
        .when(~F.coalesce(F.col("cohort").startswith(wave), F.lit(False)), "other wave").when(F.col("code").isNull(), "no code").otherwise("mailed")
    )
    marked = met.withColumn("reason", reason)
    return marked.where("reason = 'mailed'").select("lead_id", "name", "address", "postcode", "code", "cohort"), marked.groupBy("reason").agg(F.count("*").alias("leads"))


def matchback(sales: DataFrame, leads: DataFrame, mail_date: str, days: int, threshold: float = 0.90, whole: bool = False) -> DataFrame:
    """(sale_id, lead_id, tier, needs_review): a sale in the window by code, else by name and ZIP or by address, else by similar name in the ZIP.

    sales: sale_id, name_norm, zip5, address_norm, sale_date, promo_code; leads: lead_id, offer_code, name_norm, zip5, address_norm.
    """
    live = sales.where(F.col("sale_date").between(F.lit(mail_date).cast("date"), F.date_add(F.lit(mail_date).cast("date"), days)))
    own = leads.select("lead_id", "offer_code", F.col("name_norm").alias("ln"), F.col("zip5").alias("lz"), F.col("address_norm").alias("la"))
    # Each rule reads them again; their names and addresses are normalised once.
    live, own = written(live.select("sale_id", "name_norm", "zip5", "address_norm", "promo_code"), "sales"), written(own, "leads")
    # Of leads that share a key the first by id is taken, so a popular name or address makes no pairs.
    first_of = lambda keys: own.dropna(subset=keys).groupBy(*keys).agg(F.min("lead_id").alias("lead_id"))
    exact = live.join(own.withColumn("oc", F.upper("offer_code")).dropna(subset=["oc"]).groupBy("oc").agg(F.min("lead_id").alias("lead_id")), F.upper("promo_code") == F.col("oc")).select("sale_id", F.lit(0).alias("t"), "lead_id")
    strong = live.where("name_norm <> ''").join(first_of(["ln", "lz"]), F.expr("name_norm = ln and zip5 = lz")).select("sale_id", F.lit(1).alias("t"), "lead_id")
    placed = live.join(first_of(["la"]), F.expr("address_norm = la")).select("sale_id", F.lit(1).alias("t"), "lead_id")
    found = exact.unionByName(strong).unionByName(placed).groupBy("sale_id").agg(F.min(F.struct("t", "lead_id")).alias("m"))
    found = written(found, "matches")
    # Only sales without such a match are compared by similarity; distinct names of a ZIP once.
    rest = live.where("name_norm <> '' and zip5 is not null").join(found, "sale_id", "left_anti")
    a = rest.select("name_norm", "zip5").distinct()
    b = own.where("ln <> '' and lz is not null").groupBy("ln", F.col("lz").alias("zip5")).agg(F.min("lead_id").alias("lead_id"))
    left, right, block = split_blocks(a, b, ["zip5"])
    best = nearest_names(left, right, block, threshold, whole)
    fuzzy = rest.join(best, ["name_norm", "zip5"]).groupBy("sale_id").agg(F.min(F.struct(F.lit(2).alias("t"), "lead_id")).alias("m"))
    first = found.unionByName(fuzzy).groupBy("sale_id").agg(F.min("m").alias("m"))
    return first.select("sale_id", F.col("m.lead_id").alias("lead_id"), F.element_at(F.array(*map(F.lit, ("exact", "strong", "fuzzy"))), F.col("m.t") + 1).alias("tier"), (F.col("m.t") == 2).alias("needs_review"))


def credit(matches: DataFrame, sales: DataFrame, responses: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(sale_id, lead_id, credit): direct by code or a won outcome of any date, assisted by a response up to the day of the sale, else influenced."""
    dated = matches.join(sales.select("sale_id", "sale_date"), "sale_id")
    won = outcomes.where("outcome = 'won'").select("lead_id").distinct().withColumn("won", F.lit(True))
    before = dated.join(responses.groupBy("lead_id").agg(F.min("ts").alias("first_ts")), "lead_id", "left").join(won, "lead_id", "left")
    kind = F.when((F.col("tier") == "exact") | F.col("won"), "direct").when(F.col("first_ts") < F.date_add("sale_date", 1), "assisted").otherwise("influenced")
    return before.select("sale_id", "lead_id", kind.alias("credit"))


def cohort_report(matches: DataFrame, cohorts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Per cohort, and per columns `by` of cohorts: leads, matched purchases by tier, rate, purchases that need a review."""
    bought = matches.groupBy("lead_id").agg(F.count("*").alias("n"), *(F.count_if(F.col("tier") == t).alias(t) for t in ("exact", "strong", "fuzzy")), F.count_if("needs_review").alias("review"))
    met = cohorts.join(bought, "lead_id", "left").na.fill(0, ["n", "exact", "strong", "fuzzy", "review"])
    out = met.groupBy(*by, "cohort").agg(F.count("*").alias("leads"), F.count_if(F.col("n") > 0).alias("buyers"), *(F.sum(c).alias(c) for c in ("exact", "strong", "fuzzy", "review")))
    return out.withColumn("rate", F.col("buyers") / F.col("leads"))


def lift(report: DataFrame, z: float = 1.959963984540054) -> DataFrame:
    """Sale-rate difference of mailed and held-out leads over all rows, with its normal interval."""
    held = F.col("cohort").contains("holdout")
    s = report.agg(*(F.sum(F.when(held if h else ~held, F.col(c))).alias(f"{c}_{n}") for h, n in ((False, "mailed"), (True, "held")) for c in ("leads", "buyers")))
    p, q = F.col("buyers_mailed") / F.col("leads_mailed"), F.col("buyers_held") / F.col("leads_held")
    error = F.sqrt(p * (1 - p) / F.col("leads_mailed") + q * (1 - q) / F.col("leads_held"))
    return s.select(p.alias("rate_mailed"), q.alias("rate_held"), (p - q).alias("lift"), (p - q - z * error).alias("low"), (p - q + z * error).alias("high"))


def lift_by_campaign(report: DataFrame, z: float = 1.959963984540054) -> DataFrame:
    """A row per campaign and one for all (null campaign): rates of mailed and held-out leads, their difference and its normal interval.

    report: (campaign_id, cohort, leads, buyers). The row for all pools the campaigns' own differences by the
    weights of Mantel and Haenszel (mailed times held, over both), with the variance of such a sum; so a
    campaign with much mail and few sales doesn't pass for an effect of the mail. A campaign without mailed or
    without held-out leads has no difference and isn't pooled; without any, the pooled row has none either.
    """
    held = F.coalesce(F.col("cohort").contains("holdout"), F.lit(False))
    s = report.groupBy("campaign_id").agg(*(F.coalesce(F.sum(F.when(held if h else ~held, F.col(c))), F.lit(0)).alias(f"{c}_{n}") for h, n in ((False, "mailed"), (True, "held")) for c in ("leads", "buyers")))
    n1, n0, both = F.col("leads_mailed"), F.col("leads_held"), (F.col("leads_mailed") > 0) & (F.col("leads_held") > 0)
    p, q = F.when(n1 > 0, F.col("buyers_mailed") / n1), F.when(n0 > 0, F.col("buyers_held") / n0)
    var = F.when(both, p * (1 - p) / n1 + q * (1 - q) / n0)
    each = s.select("campaign_id", "leads_mailed", "leads_held", p.alias("rate_mailed"), q.alias("rate_held"), (p - q).alias("lift"), var.alias("var"), F.when(both, n1 * n0 / (n1 + n0)).alias("w"))
    w = F.col("w")
    # One row: sums over campaigns, with the rates weighted alike.
    share = lambda c: F.try_divide(F.sum(w * F.col(c)), F.sum(w))
    pooled = each.agg(
        F.lit(None).cast("string").alias("campaign_id"), F.sum("leads_mailed").alias("leads_mailed"), F.sum("leads_held").alias("leads_held"), share("rate_mailed").alias("rate_mailed"), share("rate_held").alias("rate_held"), share("lift").alias("lift"),
        F.try_divide(F.sum(w * w * F.col("var")), F.sum(w) * F.sum(w)).alias("var"),
    )
    error = z * F.sqrt("var")
    return each.drop("w").withColumn("pooled", F.lit(False)).unionByName(pooled.withColumn("pooled", F.lit(True))).withColumns({"low": F.col("lift") - error, "high": F.col("lift") + error}).drop("var")


#: What a funnel is broken down by; each alone, each within its campaign, and all.
DIMENSIONS = ("campaign_id", "dealer_id", "segment", "tier", "creative")


def campaign_funnel(leads: DataFrame, responses: DataFrame, outcomes: DataFrame, revenue: DataFrame, costs: DataFrame, dimensions: tuple[str, ...] = ()) -> DataFrame:
    """Leads mailed, responded, contacted, quoted, won, units, revenue and cost by campaign, dealer, segment and tier, with all sums over these.

    With `dimensions`, columns of leads, by grouping sets instead of that rollup: the first of them (the campaign), each other
    alone and within it, and all, so that a dealer or a creative is seen across campaigns; `level` has a bit for each that is summed over.
    revenue and costs are (lead_id, amount) rows; units are rows of revenue. A ratio is null where there is nothing to divide by.
    """
    r = responses.select("lead_id").distinct().withColumn("responded", F.lit(1))
    o = outcomes.groupBy("lead_id").agg(*(F.max(F.when(F.col("outcome") == s, 1).otherwise(0)).alias(s) for s in ("contacted", "quoted", "won")))
    m = revenue.groupBy("lead_id").agg(F.sum("amount").alias("revenue"), F.count("*").alias("units"))
    c = costs.groupBy("lead_id").agg(F.sum("amount").alias("cost"))
    wide = leads.join(r, "lead_id", "left").join(o, "lead_id", "left").join(m, "lead_id", "left").join(c, "lead_id", "left")
    if dimensions:
        top, *others = dimensions
        sets = [[], [F.col(top)], *([F.col(o)] for o in others), *([F.col(top), F.col(o)] for o in others)]
        grouped = wide.groupingSets(sets, *dimensions)
    else:
        grouped = wide.rollup("campaign_id", "dealer_id", "segment", "tier")
    out = grouped.agg(
        F.count("*").alias("mailed"), *(F.sum(F.coalesce(c, F.lit(0))).cast("bigint").alias(c) for c in ("responded", "contacted", "quoted", "won", "units")),
        *(F.round(F.coalesce(F.sum(c), F.lit(0.0)), 2).alias(c) for c in ("revenue", "cost")), F.grouping_id().cast("int").alias("level"),
    )
    ratio = lambda a, b: F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)), 4)
    return out.withColumns({"cost_per_response": ratio("cost", "responded"), "cost_per_win": ratio("cost", "won"), "revenue_per_cost": ratio("revenue", "cost")})


def time_to_first_contact(leads: DataFrame, responses: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Per dealer: responded leads, share with an outcome after the response, median hours to the first one."""
    asked = responses.groupBy("lead_id").agg(F.min("ts").alias("ts"))
    after = asked.join(outcomes, "lead_id").where("outcome_ts >= ts").groupBy("lead_id").agg(F.min("outcome_ts").alias("contact"))
    met = leads.where("dealer_id is not null").select("lead_id", "dealer_id").join(asked, "lead_id").join(after, "lead_id", "left")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    hours = (micros("contact") - micros("ts")) / 3_600_000_000.0
    met = written(met.select("dealer_id", "contact", hours.alias("hours")), "contacts")
    share = met.groupBy("dealer_id").agg(F.count("*").alias("responded"), (F.count("contact") / F.count("*")).alias("share"))
    return share.join(grouped_median(met, ["dealer_id"], "hours", "median_hours"), "dealer_id")


def permits_to_signals(permits: DataFrame, leads: DataFrame) -> DataFrame:
    """Permits (permit_id, address_norm, zip5, issued, text) as signals of the leads at their address."""
    met = permits.where("address_norm is not null").join(leads.select("lead_id", "address_norm", "zip5"), ["address_norm", "zip5"])
    return met.select("lead_id", F.lit("permit").alias("type"), "text", F.date_format("issued", "yyyy-MM-dd").alias("date_text"), "permit_id")


def _newton(batches: Iterator[pd.DataFrame], k: int, penalty: float) -> Iterator[pd.DataFrame]:
    """The next coefficients of each segment from its sums; a step that made the loss greater is halved instead."""
    at = np.triu_indices(k)
    for t in batches:
        out = []
        for r in t.itertuples(index=False):
            r = r._asdict()
            beta, step, scale = np.array(r["beta"], float), np.array(r["step"], float), np.concatenate(([0.0], np.nan_to_num(np.array(r["scale"], float))))
            loss = r["loss_sum"] / r["n"] + penalty / 2 * float((scale * beta**2).sum())
            if loss > r["loss"] + 1e-15 and np.abs(step).max() > 1e-12:
                step = step / 2
                out.append((r["segment"], beta - step, step, r["loss"], r["rounds"] + 1, False))
                continue
            h = np.zeros((k, k))
            h[at] = np.array(r["h"], float) / r["n"]
            h = h + np.triu(h, 1).T + np.diag(penalty * scale)
            g = np.array(r["g"], float) / r["n"] + penalty * scale * beta
            alive = np.concatenate(([True], scale[1:] > 0))  # a feature that doesn't vary has no weight
            new = np.zeros(k)
            new[alive] = -np.linalg.lstsq(h[np.ix_(alive, alive)], g[alive], rcond=None)[0]
            out.append((r["segment"], beta + new, new, loss, r["rounds"] + 1, bool(np.abs(new).max() < 1e-10)))
        yield pd.DataFrame(out, columns=["segment", "beta", "step", "loss", "rounds", "done"])


def fit_coefficients(labelled: DataFrame, features: list[str], label: str = "won", least: int = 100, penalty: float = 0.01, max_rounds: int = 60) -> DataFrame:
    """(segment, beta): ridge logistic regressions of all segments at once; beta is the intercept and a coefficient per feature.

    The mean loss and half of penalty times the squared coefficients in units of the features' deviations
    is made least, by Newton's steps. A round is one aggregate over all rows: for each segment the sums of the
    gradient and of the products of features, which tasks add up before the shuffle; a small table of coefficients comes
    back. Segments need `least` labels and both outcomes; rows with a null label or feature don't count; a null segment is one.
    """
    spark = labelled.sparkSession
    y, k = F.col(label).cast("double"), len(features) + 1
    rows = labelled.where(F.col(label).isNotNull()).select("segment", y.alias("y"), *(F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features, 1))).dropna(subset=[f"x{i}" for i in range(1, k)])
    rows = written(rows, "labels")
    spread = F.array(*(F.var_samp(f"x{i}") for i in range(1, k))).alias("scale")
    known = rows.groupBy("segment").agg(F.count("*").alias("n"), F.min("y").alias("low"), F.max("y").alias("high"), spread).where((F.col("n") >= least) & (F.col("low") < F.col("high")))
    zeros = F.array(*[F.lit(0.0)] * k)
    known = written(known.select("segment", "n", "scale"), "segments")
    state = known.select("segment", zeros.alias("beta"), zeros.alias("step"), F.lit(float("inf")).alias("loss"), F.lit(0).alias("rounds"), F.lit(False).alias("done"))
    x = [F.lit(1.0), *(F.col(f"x{i}") for i in range(1, k))]
    schema = "segment string, beta array<double>, step array<double>, loss double, rounds int, done boolean"
    for _ in range(max_rounds):
        state = written(state, "coefficients")
        if not state.where("not done").limit(1).count():
            break
        now = state.where("not done").select(F.col("segment").alias("_s"), *(F.col("beta")[i].alias(f"b{i}") for i in range(k)))
        z = sum((F.col(f"b{i}") * x[i] for i in range(1, k)), F.col("b0"))
        met = rows.join(now, F.col("segment").eqNullSafe(F.col("_s"))).withColumn("z", z).withColumn("p", 1 / (1 + F.exp(-F.col("z"))))
        weight = F.col("p") * (1 - F.col("p"))
        loss = F.greatest("z", F.lit(0.0)) - F.col("y") * F.col("z") + F.log1p(F.exp(-F.abs("z")))
        sums = met.groupBy("segment").agg(
            F.sum(loss).alias("loss_sum"), F.array(*(F.sum((F.col("p") - F.col("y")) * x[i]) for i in range(k))).alias("g"), F.array(*(F.sum(weight * x[i] * x[j]) for i in range(k) for j in range(i, k))).alias("h")
        ).withColumnRenamed("segment", "_s")
        same = F.col("segment").eqNullSafe(F.col("_s"))
        wide = state.join(sums, same).drop("_s").join(known.withColumnRenamed("segment", "_s"), same).drop("_s", "done")
        state = wide.mapInPandas(lambda batches: _newton(batches, k, penalty), schema).unionByName(state.where("done"))
    else:
        raise RuntimeError(f"coefficients did not settle in {max_rounds} rounds")
    return state.select("segment", "beta")


def fit_weights(labelled: DataFrame, label: str = "won", least: int = 100) -> DataFrame:
    """(segment, feature, weight): logistic regression of all segments with `least` labels or more, shares of positive coefficients."""
    from leadweave.operators.scoring import FEATURES

    fitted = fit_coefficients(labelled, [f"v_{f}" for f in FEATURES], label, least)
    positive = F.transform(F.slice("beta", 2, len(FEATURES)), lambda b: F.greatest(b, F.lit(0.0)))
    total = F.aggregate("positive", F.lit(0.0), lambda t, b: t + b)
    shares = fitted.select("segment", positive.alias("positive")).withColumn("total", total)
    return shares.select("segment", F.posexplode("positive").alias("pos", "b"), "total").select("segment", F.get(F.array(*map(F.lit, FEATURES)), F.col("pos")).alias("feature"), F.when(F.col("total") > 0, F.col("b") / F.col("total")).otherwise(0.0).alias("weight"))
