r"""Secrets in texts: known forms, and multipart credentials linked within a scope.

Known forms stand alone: assignments, access identifiers and long hexadecimal runs. Weak candidates
are runs of 20 or more letters, digits and `+/_-` with a capital, a small letter and a digit, which
alone say nothing; `=` only ends one, so the name before it is no part of it, and a run that begins with a slash
or follows a dot is a path. A scope is a paragraph (blank lines part them, however lines end). A weak candidate is reported as a
`secret` only if an access identifier or an endpoint (a URL, or a host of three labels or more)
lies within `reach` characters of it in the same scope; then the identifiers and endpoints within reach
of a weak candidate are reported too, as `access_part` and `endpoint`. Runs and URLs have no greatest length
(a URL scheme counts up to 13 characters). The interval join sorts the starts and ends of a scope's
parts once and carries the last end of each kind along; so a scope with thousands of parts makes no pairs,
and parts of any length meet.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: (kind, expression, group whose length counts, least length)
KNOWN = (
    ("assign", r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)
# Possessive, so a run of any length is one match and none is tried twice; the look-aheads stop at the first character they seek.
WEAK = r"(?<![A-Za-z0-9+/_.-])(?=[a-z0-9+/_-]*+[A-Z])(?=[A-Z0-9+/_-]*+[a-z])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+_-][A-Za-z0-9+/_-]{19,}+={0,2}"
# A host name has at most 127 labels of 63 characters.
ENDPOINT = r"[A-Za-z][A-Za-z0-9+.-]{1,12}://[^\s\"'<>]++|(?<![A-Za-z0-9@.-])[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){1,125}\.[A-Za-z]{2,63}(?![A-Za-z0-9.-])"
#: Two ends of lines; CR and LF together are one, so atomic.
BREAK = r"(?>\r\n|\r|\n)[\x20\t]*(?>\r\n|\r|\n)\s*"
#: Access keys, roles and users of one cloud, account numbers of telephony, client numbers and service accounts of another.
IDENTIFIER = r"(?<![A-Z0-9])(?:AKIA|ASIA|AIDA|AROA|AGPA)[A-Z0-9]{12,}+|(?<![A-Za-z0-9])(?:AC|SK)[0-9a-f]{32}(?![A-Za-z0-9])|(?<![A-Za-z0-9-])\d{6,21}-[a-z0-9]{32}(?=\.apps\.)|(?<![A-Za-z0-9.-])[a-z0-9-]{3,63}+@[a-z0-9-]{3,63}+(?=\.iam\.)"
_SPAN = "array<struct<start:int,end:int>>"


def _ends(lengths: Column) -> Column:
    """Sums of an array of numbers from its start to each element.

    By blocks of about the root of its size: an element adds what its block has before it to what the
    blocks before hold, so the work grows with the size to the power 1.5 and no array is built up step by step.
    """
    size = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(lengths))).cast("int"))
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)
    upto = lambda given, n: total(F.slice(given, F.lit(1), n))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(lengths) - 1), size)
    blocks = F.transform(starts, lambda at: F.slice(lengths, at + 1, size))
    sums = F.transform(blocks, total)
    given = F.array(F.struct(blocks.alias("blocks"), sums.alias("sums")))
    each = F.transform(given, lambda g: F.flatten(F.transform(g["blocks"], lambda block, i: F.transform(F.array(upto(g["sums"], i)), lambda before: F.transform(block, lambda _, j: before + upto(block, j + 1)))[0])))
    return F.when(F.size(lengths) > 0, F.element_at(each, 1)).otherwise(F.expr("cast(array() as array<int>)"))


def spans(text: Column, pattern: str, group: int = 0, least: int = 0) -> Column:
    """Leftmost matches that don't overlap, as (start, end) in code points; those with a short group are dropped.

    Ends are sums of the lengths of what lies between matches and of the matches, from the left.
    """
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    inner = F.transform(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(group + 1)), F.length) if group else F.transform(found, F.length)
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    given = F.array(F.struct(F.transform(found, F.length).alias("sizes"), inner.alias("keys"), gaps.alias("gaps")))
    steps = F.transform(given, lambda g: F.struct(g["sizes"].alias("sizes"), g["keys"].alias("keys"), _ends(F.zip_with(F.slice(g["gaps"], F.lit(1), F.size(g["sizes"])), g["sizes"], lambda a, b: a + b)).alias("ends")))
    every = F.transform(
        steps, lambda g: F.filter(F.transform(g["sizes"], lambda size, i: F.struct((F.get(g["ends"], i) - size).alias("start"), F.get(g["ends"], i).alias("end"), F.get(g["keys"], i).alias("key"))), lambda s: s["key"] >= least)
    )
    kept = F.transform(F.element_at(every, 1), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return F.when(F.size(found) > 0, kept).otherwise(F.expr(f"cast(array() as {_SPAN})"))


def _joined(kinds: list[tuple[str, Column]]) -> Column:
    """kind:start:end by start, then kind in the order given, joined by commas."""

    def named(spans_of: Column, order: int, name: str) -> Column:
        return F.transform(spans_of, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("kind"), s["end"].alias("end"), F.lit(name).alias("name")))

    all_of = F.concat(*(named(c, i, k) for i, (k, c) in enumerate(kinds)))
    return F.array_join(F.transform(F.array_sort(all_of), lambda s: F.concat_ws(":", s["name"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of_kind(kind: str) -> Column:
    more = F.coalesce("more", F.expr("cast(array() as array<struct<kind:string,start:int,end:int>>)"))
    return F.transform(F.filter(more, lambda s: s["kind"] == kind), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))


def linked_parts(df: DataFrame, reach: int = 200, text_col: str = "_text", keys: tuple[str, ...] = ("_id", "_hash")) -> DataFrame:
    """(keys..., kind, start, end) of weak secrets with a complementary part in reach, and of those parts."""
    kinds = ("secret", WEAK), ("access_part", IDENTIFIER), ("endpoint", ENDPOINT), ("break", BREAK)
    # Only texts with a weak candidate can have any: one scan in the row decides.
    some = df.where(F.col(text_col).rlike(WEAK) & (F.col(text_col).rlike(IDENTIFIER) | F.col(text_col).rlike(ENDPOINT)))
    parts = None
    for kind, pattern in kinds:
        one = some.select(*keys, F.lit(kind).alias("kind"), F.inline(spans(F.col(text_col), pattern)))
        parts = one if parts is None else parts.unionByName(one)
    so_far = Window.unboundedPreceding, Window.currentRow
    broken = F.col("kind") == "break"
    # The scope is where the last break before a part starts.
    in_text = Window.partitionBy(*keys).orderBy("start", broken).rowsBetween(*so_far)
    scoped = parts.dropDuplicates([*keys, "kind", "start"]).withColumn("scope", F.coalesce(F.max(F.when(broken, F.col("start"))).over(in_text), F.lit(-1))).where(~broken)
    # A part is told at its start and asks at its end + reach, where all that begin in time have been told:
    # one is within reach if the last end among them isn't too far back.
    told = F.array(F.struct(F.col("start").alias("at"), F.lit(False).alias("asks")), F.struct((F.col("end") + reach).alias("at"), F.lit(True).alias("asks")))
    in_scope = Window.partitionBy(*keys, "scope").orderBy("at", "asks").rowsBetween(*so_far)
    weak = F.col("kind") == "secret"
    last = lambda which: F.max(F.when(~F.col("asks") & which, F.col("end"))).over(in_scope)
    met = scoped.select(*keys, "scope", "kind", "start", "end", F.inline(told)).withColumns({"_weak": last(weak), "_other": last(~weak)})
    return met.where(F.col("asks") & (F.when(weak, F.col("_other")).otherwise(F.col("_weak")) >= F.col("start") - reach)).select(*keys, "kind", "start", "end")


def find_secrets(df: DataFrame, reach: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans, n_linked) of every row of df.

    Spans are kind:start:end in code points, end exclusive, sorted by start, then kind as listed:
    assign, access, hex, then the linked secret, access_part, endpoint. A null text counts as empty:
    no spans and the hash of the empty string. Repeated rows come back each with the same result,
    a null id too; an empty table gives no rows; a text has no limit; other columns are ignored, whatever
    their names. Of spans with one start the kind listed first comes first.
    """
    base = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).withColumn("_hash", F.xxhash64("_text"))
    found = {k: F.when(F.col("_text").rlike(p), spans(F.col("_text"), p, g, n)).otherwise(F.expr(f"cast(array() as {_SPAN})")) for k, p, g, n in KNOWN}
    rows = base.select("_id", "_hash", *(c.alias(k) for k, c in found.items()))
    linked = linked_parts(base, reach).groupBy("_id", "_hash").agg(F.collect_set(F.struct("kind", "start", "end")).alias("more")).toDF("_of", "_at", "more")  # of one text
    met = rows.join(linked, F.expr("_id <=> _of and _hash = _at"), "left")
    own = [(k, F.col(k)) for k, _, _, _ in KNOWN]
    more = [(k, _of_kind(k)) for k in ("secret", "access_part", "endpoint")]
    return met.select(
        F.col("_id").alias(id_col), *(F.size(k).cast("bigint").alias(f"n_{k}") for k, _ in own),
        F.sha2(_joined(own), 256).alias("base_sha256"), _joined(own + more).alias("spans"), F.coalesce(F.size("more"), F.lit(0)).cast("bigint").alias("n_linked"),
    )
