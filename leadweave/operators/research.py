"""Validation and saving of research documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadweave.functions.binding import let

# Fixed values of the document's rules.
STATUSES = ("researched", "no_signal")
LEVELS = ("high", "medium", "low", "unknown")
SIGNAL_TYPES = ("permit", "hiring", "expansion", "news", "funding", "contract", "registry", "other")
URL, DATE, URL_LENGTH = r"^https?://[^\s]+$", r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$", 2000
SCHEMA = (
    "status string, summary string, segment string, facilityFit struct<level:string,evidence:string,url:string>, employeeEstimate struct<value:int,source:string,note:string>,"
    " signals array<struct<type:string,text:string,url:string,date:string>>, suggestedAngle string, personalLine string, contactRoles array<string>, llmAdjustment int,"
    " rationale string, sources array<string>, cautions array<string>"
)

#: A rule: (a variant that is there, its JSON pointer) -> array<struct<pointer, problem>>.
Rule = Callable[[Column, Column], Column]


def _one(at: Column, problem: str) -> Column:
    return F.array(F.struct(at.alias("pointer"), F.lit(problem).alias("problem")))


def _none() -> Column:
    return F.expr("cast(array() as array<struct<pointer:string,problem:string>>)")


def _where(broken: Column, at: Column, problem: str) -> Column:
    return F.when(F.coalesce(broken, F.lit(False)), _one(at, problem)).otherwise(_none())


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def one_of(*values: str) -> Rule:
    def rule(v: Column, at: Column) -> Column:
        known = (_kind(v) == "STRING") & F.try_variant_get(v, "$", "string").isin(*values)
        return _where(~known, at, "not one of the values")

    return rule


def text(least: int = 0, most: int = 1 << 30, pattern: str | None = None, shape: str = "") -> Rule:
    def rule(v: Column, at: Column) -> Column:
        def body(s: Column) -> Column:
            found = [_where(F.length(s) < least, at, "too short"), _where(F.length(s) > most, at, "too long")]
            return F.concat(*found, *([_where(~s.rlike(pattern), at, shape)] if pattern else []))

        return F.when(_kind(v) != "STRING", _one(at, "not a text")).otherwise(let(F.try_variant_get(v, "$", "string"), body))

    return rule


def whole_number(least: int, most: int | None, problem: str) -> Rule:
    """A number without a fraction; 3.0 is one."""

    def rule(v: Column, at: Column) -> Column:
        number = F.when(_kind(v).rlike("^(BIGINT|DECIMAL|DOUBLE)"), F.try_variant_get(v, "$", "double"))
        outside = lambda n: (n < least) | (n > most) if most is not None else n < least
        return let(number, lambda n: F.when(n.isNull() | (n != F.floor(n)), _one(at, "not a whole number")).otherwise(_where(outside(n), at, problem)))

    return rule


def list_of(item: Rule, most: int) -> Rule:
    def rule(v: Column, at: Column) -> Column:
        def body(items: Column) -> Column:
            each = F.transform(items, lambda x, i: item(x, F.concat(at, F.lit("/"), i.cast("string"))))
            return F.concat(_where(F.size(items) > most, at, "too many"), F.flatten(each))

        return F.when(~_kind(v).startswith("ARRAY"), _one(at, "not a list")).otherwise(let(F.try_variant_get(v, "$", "array<variant>"), body))

    return rule


def _optional(rule: Rule, at: Column, required: bool) -> Callable[[Column], Column]:
    return lambda v: F.when(v.isNull(), _one(at, "required") if required else _none()).otherwise(rule(v, at))


def members(required: tuple[str, ...], rules: dict[str, Rule]) -> Rule:
    """An object with these members and no others, each by its rule if it is there."""

    def rule(v: Column, at: Column) -> Column:
        def body(m: Column) -> Column:
            other = F.filter(F.map_keys(m), lambda k: ~k.isin(*rules))
            escaped = lambda k: F.replace(F.replace(k, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
            found = [F.transform(other, lambda k: F.struct(F.concat(at, F.lit("/"), escaped(k)).alias("pointer"), F.lit("unknown key").alias("problem")))]
            for name, own in rules.items():
                inner = F.concat(at, F.lit(f"/{name}"))
                found.append(let(F.try_element_at(m, F.lit(name)), _optional(own, inner, name in required)))
            return F.concat(*found)

        return F.when(~_kind(v).startswith("OBJECT"), _one(at, "not an object")).otherwise(let(F.try_variant_get(v, "$", "map<string,variant>"), body))

    return rule


_url = text(most=URL_LENGTH, pattern=URL, shape="not a web address")
_signal = members(("type", "text", "url", "date"), {"type": one_of(*SIGNAL_TYPES), "text": text(5, 240), "url": _url, "date": text(pattern=DATE, shape="not YYYY-MM or YYYY-MM-DD")})
DOCUMENT = members(
    ("status", "summary", "rationale"),
    {
        "status": one_of(*STATUSES),
        "summary": text(10, 600),
        "segment": text(most=80),
        "facilityFit": members(("level",), {"level": one_of(*LEVELS), "evidence": text(most=300), "url": _url}),
        "employeeEstimate": members(("value",), {"value": whole_number(1, None, "below 1"), "source": _url, "note": text(most=200)}),
        "signals": list_of(_signal, 10),
        "suggestedAngle": text(most=240),
        "personalLine": text(most=180),
        "contactRoles": list_of(text(most=60), 5),
        "llmAdjustment": whole_number(-15, 15, "outside -15 to 15"),
        "rationale": text(10, 600),
        "sources": list_of(_url, 10),
        "cautions": list_of(text(most=200), 5),
    },
)


def problems(document: Column) -> Column:
    """array<struct<pointer, problem>> of every rule that a document breaks, by JSON pointer; empty if it is valid.

    The document is walked as a VARIANT, so each value is judged by the type that it has: nothing is read
    as null because it is of another. A document that isn't JSON, has a key twice or is no object has one
    problem, as has a null one. Without the status `researched` the list of signals has to be empty.
    """

    def body(v: Column) -> Column:
        status = F.try_variant_get(v, "$.status", "variant")
        quiet = status.isNull() | ((_kind(status) == "STRING") & (F.try_variant_get(status, "$", "string") == "no_signal"))
        some = F.size(F.try_variant_get(v, "$.signals", "array<variant>")) > 0
        found = F.concat(DOCUMENT(v, F.lit("")), _where(quiet & some, F.lit("/signals"), "must be empty without a signal"))
        return F.when(v.isNull() | ~_kind(v).startswith("OBJECT"), _one(F.lit(""), "not a JSON object")).otherwise(found)

    return let(F.try_parse_json(document), body)


def validate_research(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid documents, a row per problem of the others with its JSON pointer)."""
    checked = docs.withColumn("_problems", problems(F.col("document")))
    return checked.where(F.size("_problems") == 0).drop("_problems"), checked.select("campaign_id", "lead_id", F.inline("_problems"))


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    return current.join(incoming.select(keys).distinct(), keys, "left_anti").unionByName(incoming)


def save_research(valid: DataFrame, leads: DataFrame, research: DataFrame, signals: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(research, signals, refused) after saving: a document replaces the lead's, and all of its signals.

    Documents of unknown or duplicate leads are refused.
    """
    met = valid.join(leads.select("campaign_id", "lead_id", "status"), ["campaign_id", "lead_id"], "left")
    error = F.when(F.col("status").isNull(), "unknown lead").when(F.col("status") == "duplicate", "duplicate lead")
    refused = met.withColumn("error", error).where("error is not null").select("campaign_id", "lead_id", "error")
    good = met.where(error.isNull()).select("campaign_id", "lead_id", "document")
    doc = F.from_json("document", SCHEMA)
    new = good.select("campaign_id", "lead_id", F.posexplode(doc["signals"]).alias("pos", "s")).select("campaign_id", "lead_id", F.col("pos").cast("int").alias("pos"), "s.type", "s.text", F.col("s.date").alias("date_text"))
    kept = signals.join(good.select("campaign_id", "lead_id"), ["campaign_id", "lead_id"], "left_anti")
    return upsert(research, good, ["campaign_id", "lead_id"]), kept.unionByName(new), refused
