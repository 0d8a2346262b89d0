"""Normalising columns: names, web domains, ZIP codes, addresses, digests. Native expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadweave.functions.binding import let

# Fixed values of the name and domain rules.
LEGAL_SUFFIXES = ("inc", "incorporated", "llc", "ltd", "co", "corp", "corporation", "company", "lp", "llp", "pllc")
SECOND_LEVEL = ("co.uk", "com.au", "co.nz", "com.br")
GENERIC_HOSTS = (
    "facebook.com", "instagram.com", "linkedin.com", "yelp.com", "google.com",
    "business.site", "wixsite.com", "godaddysites.com", "squarespace.com", "sites.google.com",
)


def name_norm(name: Column) -> Column:
    """Lower case, `&` as and, letters and digits only, leading `the` and trailing legal forms dropped; '' if nothing is left."""
    # Groups repeat possessively: else the matcher recurses once a repetition, and a long name ends the JVM.
    plain = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "&", " and ")
    plain = F.regexp_replace(plain, r"[^\p{L}\p{Nd}\s]", "")
    plain = F.trim(F.regexp_replace(plain, r"\s+", " "))
    plain = F.regexp_replace(plain, "^(?:the(?: |$))++", "")
    return F.trim(F.regexp_replace(plain, f"(?:(?:^| )(?:{'|'.join(LEGAL_SUFFIXES)})(?= |$))++$", ""))


def domain_key(url: Column) -> Column:
    """Registrable domain of a website, null if it isn't one or is a host that many businesses share."""

    def of_url(raw: Column) -> Column:
        scheme = F.when(raw.contains("://"), F.lower(F.substring_index(raw, "://", 1)))
        rest = F.when(raw.contains("://"), F.regexp_extract(raw, r"^.*?://(.*)$", 1)).otherwise(raw)
        no_port = F.regexp_replace(F.regexp_extract(rest, r"^([^/?#]*)", 1), r":[^:]*$", "")
        wrong = (scheme.isNotNull() & ~scheme.isin("http", "https")) | (scheme.isNull() & raw.contains(":") & ~raw.contains("/"))
        return F.when(~wrong, F.lower(F.regexp_extract(no_port, r"([^@]*)$", 1)))

    def of_host(host: Column) -> Column:
        bare = F.regexp_replace(host, r"^www\.", "")
        shaped = host.contains(".") & host.rlike(r"^[a-z0-9-]++(?:\.[a-z0-9-]++)++$")
        return F.when(shaped & ~bare.isin(*GENERIC_HOSTS), let(F.split(bare, r"\."), of_labels))

    def of_labels(labels: Column) -> Column:
        n, two = F.size(labels), F.array_join(F.slice(labels, -2, 2), ".")
        three = F.array_join(F.slice(labels, F.greatest(-n, F.lit(-3)), 3), ".")
        return F.when(n >= 2, let(F.when(two.isin(*SECOND_LEVEL), F.when(n >= 3, three)).otherwise(two), lambda key: F.when(~key.isin(*GENERIC_HOSTS), key)))

    return let(let(F.trim(url), of_url), of_host)


def zip5(code: Column) -> Column:
    return F.nullif(F.substring(F.trim(code), 1, 5), F.lit(""))


def address_norm(address: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.lower(address), r"\s+", " "), r"[^\p{L}\p{Nd} ]", "")
    return F.nullif(F.trim(F.regexp_replace(plain, " +", " ")), F.lit(""))


def row_digest(prefix: str, *cols: Column) -> Column:
    """prefix and the first 16 hex digits of SHA-256 of the fields joined by U+001F, null as empty."""
    joined = F.concat_ws("\x1f", *(F.coalesce(c.cast("string"), F.lit("")) for c in cols))
    return F.concat(F.lit(prefix), F.substring(F.sha2(joined, 256), 1, 16))


def with_name_norm(df: DataFrame, col: str, out: str = "name_norm") -> DataFrame:
    return df.withColumn(out, name_norm(F.col(col)))


def with_domain_key(df: DataFrame, url_col: str, out: str = "domain_key") -> DataFrame:
    return df.withColumn(out, domain_key(F.col(url_col)))


def with_zip5(df: DataFrame, col: str, out: str = "zip5") -> DataFrame:
    return df.withColumn(out, zip5(F.col(col)))


def with_address_norm(df: DataFrame, col: str, out: str = "address_norm") -> DataFrame:
    return df.withColumn(out, address_norm(F.col(col)))


def with_row_digest(df: DataFrame, prefix: str, cols: list[str], out: str = "digest") -> DataFrame:
    return df.withColumn(out, row_digest(prefix, *(F.col(c) for c in cols)))
