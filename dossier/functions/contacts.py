"""E-mail addresses, web addresses and phone numbers of text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMAIL = r"[a-z0-9][a-z0-9._%+-]*@(?:[a-z0-9-]+\.)+[a-z]{2,}"
PHONE = r"\+[0-9][0-9 ()/.-]{6,20}[0-9]"
# Mailboxes of a role, free mail hosts, query parameters of trackers, suffixes of two labels.
ROLES = ["info", "office", "contact", "kontakt", "sales", "prodaja", "admin", "support", "marketing"]
FREE = ["gmail.com", "yahoo.com", "hotmail.com", "outlook.com"]
TRACKING = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "utm_name", "gclid", "gbraid", "wbraid", "dclid", "fbclid", "msclkid", "yclid", "twclid", "igshid", "ttclid",
    "mc_cid", "mc_eid", "ref", "referrer", "source", "_ga", "_gl", "sthash", "hl", "lang",
]
TWO_LABELS = [
    "co.rs", "org.rs", "edu.rs", "ac.rs", "gov.rs", "in.rs", "co.uk", "org.uk", "me.uk", "com.tr", "com.hr", "com.ba", "com.mk", "com.au", "co.at", "or.at", "com.de", "co.nz", "com.br",
]
AD_MEDIUM = "ban+er|banner|display|cpc|ppc|popup"


def emails(c: Column) -> Column:
    """Addresses in lower case, in order of position, each once."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(f"({EMAIL})"), 1))
    return F.when(F.contains(c, F.lit("@")), found).when(c.isNotNull(), F.array().cast("array<string>"))  # the pattern is not tried without an @


def email_is_role(c: Column) -> Column:
    return F.split_part(c, F.lit("@"), F.lit(1)).isin(ROLES)


def email_is_free(c: Column) -> Column:
    return F.split_part(c, F.lit("@"), F.lit(2)).isin(FREE)


def email_rejection(c: Column) -> Column:
    """Why an address is no contact, or null."""
    host = F.split_part(c, F.lit("@"), F.lit(2))
    return F.when(host.rlike(r"\.(png|jpe?g|gif|svg|webp)$"), "asset-name").when(host.rlike(r"^(example\.(com|org|net)|domain\.com)$"), "placeholder").when(F.length(c) > 254, "too-long")


def phones(c: Column) -> Column:
    """Numbers in international form as + and digits, each once; the length of E.164 holds."""
    found = F.transform(F.regexp_extract_all(c, F.lit(f"({PHONE})"), 1), lambda x: F.concat(F.lit("+"), F.regexp_replace(x, "[^0-9]", "")))
    return F.array_distinct(F.filter(found, lambda x: F.length(x).between(9, 16)))


def host(c: Column) -> Column:
    """Lower-case host without www., port or user; empty when there is none."""
    at = F.regexp_extract(F.lower(c), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(at, r"^www\.|\.$", "")


def registrable_domain(c: Column) -> Column:
    """The last two labels of a host, three below a suffix of two labels."""
    labels = F.split(c, r"\.")
    last = lambda n: F.array_join(F.slice(labels, -F.least(F.size(labels), F.lit(n)), n), ".")
    return F.when(c == "", "").when(last(2).isin(TWO_LABELS), last(3)).otherwise(last(2))


def port(c: Column) -> Column:
    """A colon and the port, empty where there is none or it is the scheme's own."""
    found = F.regexp_extract(c, r"^[^:/]*:?//(?:[^/?#@]*@)?[^/?#:]*:([0-9]+)", 1)
    return F.when(found.isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), found))


def query_pairs(c: Column) -> Column:
    """key=value pairs of a web address's query, in their order."""
    return F.filter(F.split(F.regexp_extract(c, r"\?([^#]*)", 1), "&"), lambda x: x != "")


def _key(pair: Column) -> Column:
    return F.split_part(pair, F.lit("="), F.lit(1))


def canonical_url(c: Column) -> Column:
    """https, host as in host(), a port that isn't the scheme's own, path without a last slash, query without trackers by key, equal keys in their order, no fragment."""
    path = F.regexp_replace(F.regexp_extract(c, r"^[^:/]*:?//[^/?#]*([^?#]*)", 1), "/+$", "")
    placed = F.transform(F.filter(query_pairs(c), lambda x: ~F.lower(_key(x)).isin(TRACKING)), lambda x, i: F.struct(_key(x).alias("k"), i.alias("i"), x.alias("x")))
    query = F.array_join(F.transform(F.array_sort(placed), lambda s: s["x"]), "&")
    return F.concat(F.lit("https://"), host(c), port(c), path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def same_site(a: Column, b: Column) -> Column:
    """Whether two hosts are one, or of one registrable domain."""
    return (a == b) | ((registrable_domain(a) == registrable_domain(b)) & (registrable_domain(a) != ""))


def brand_label(c: Column) -> Column:
    """First label of a host's registrable domain."""
    return F.split_part(registrable_domain(c), F.lit("."), F.lit(1))


def is_ad_link(c: Column) -> Column:
    """Whether the first utm_medium or utm_campaign of a web address names an advert."""
    first = lambda key: F.try_element_at(F.filter(query_pairs(c), lambda x: _key(x) == key), F.lit(1))
    return F.coalesce(*[F.when(F.substring_index(first(k), "=", -1).rlike(f"(?i){AD_MEDIUM}"), True) for k in ("utm_medium", "utm_campaign")], F.lit(False))
