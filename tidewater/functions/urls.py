"""URL functions. URLs are absolute; what cannot be parsed comes back trimmed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parameters that only track.
TRACKING = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "ref", "referrer", "source", "fbclid", "gclid", "msclkid",
    "mc_cid", "mc_eid", "_ga", "_gl", "igshid", "spm", "yclid",
)
_PARTS = r"^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def canonical_url(url: Column) -> Column:
    """The key of a page: https, lower-case host without www., no fragment, no tracking parameters, parameters in order, no slash at the end of the path."""
    raw = F.trim(F.coalesce(url, F.lit("")))
    part = lambda i: F.regexp_extract(raw, _PARTS, i)
    scheme = F.lower(part(1))
    host = F.regexp_replace(F.lower(part(2)), r"^www\.", "")
    host = F.regexp_replace(host, r":(?:80|443)$", "")
    path = F.when(part(3) == "", F.lit("/")).otherwise(part(3))
    path = F.when((path != "/") & path.endswith("/"), F.regexp_replace(path, "/$", "")).otherwise(path)
    pairs = F.filter(F.split(part(4), "&"), lambda p: (F.length(p) > 0) & ~F.element_at(F.split(p, "="), 1).isin(*TRACKING))
    named = F.transform(pairs, lambda p: F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))))
    # parameters of one name stay in their order
    ordered = F.array_sort(F.transform(named, lambda p, i: F.struct(F.element_at(F.split(p, "="), 1).alias("k"), i.alias("i"), p.alias("p"))))
    query = F.array_join(F.transform(ordered, lambda s: s["p"]), "&")
    whole = F.concat(F.when(scheme == "http", F.lit("https")).otherwise(scheme), F.lit("://"), host, path, F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)))
    return F.when(raw.rlike(_PARTS) & (host != ""), whole).otherwise(raw)


def normal_domain(name: Column) -> Column:
    """Lower case, without scheme, path, user, port, www. and a last dot."""
    out = F.regexp_replace(F.lower(F.trim(F.coalesce(name, F.lit("")))), r"^[a-z][a-z0-9+.-]*://", "")
    out = F.regexp_replace(out, r"[/?#].*$", "")
    for pattern in (r"^.*@", r":\d+$", r"^www\.", r"\.$"):
        out = F.regexp_replace(out, pattern, "")
    return out


def domain_of(url: Column) -> Column:
    return normal_domain(url)


def same_site(url: Column, domain: Column) -> Column:
    """Whether the URL is on the domain or a subdomain of it."""
    host, own = domain_of(url), normal_domain(domain)
    return (host == own) | host.endswith(F.concat(F.lit("."), own))


def resolve_url(href: Column, base: Column) -> Column:
    """An absolute http(s) URL for a link on a page, else null. Absolute, scheme-relative, root-relative, query-only and plain relative links."""
    link = F.trim(F.coalesce(href, F.lit("")))
    origin = F.regexp_extract(base, r"^([a-zA-Z]+://[^/?#]+)", 1)
    path = F.regexp_extract(base, r"^[a-zA-Z]+://[^/?#]+([^?#]*)", 1)
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_replace(path, "[^/]*$", ""))
    dotted = F.regexp_replace(F.concat(folder, link), r"/\./", "/")
    for _ in range(8):  # each turn takes one step up
        dotted = F.regexp_replace(dotted, r"^((?:/[^/?#]+)*?)/(?!\.\.)[^/?#]+/\.\./", "$1/")
    return (
        F.when(F.length(link) == 0, F.lit(None))
        .when(link.rlike(r"(?i)^(?:mailto:|tel:|javascript:|data:|#)"), F.lit(None))
        .when(link.rlike(r"(?i)^https?://[^/?#]+$"), F.concat(link, F.lit("/")))
        .when(link.rlike(r"(?i)^https?://"), link)
        .when(link.startswith("//"), F.concat(F.regexp_extract(base, "^([a-zA-Z]+:)", 1), link))
        .when(link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.lit(None))
        .when(origin == "", F.lit(None))
        .when(link.startswith("/"), F.concat(origin, link))
        .when(link.startswith("?"), F.concat(origin, F.when(path == "", F.lit("/")).otherwise(path), link))
        .otherwise(F.concat(origin, dotted))
    )


def job_url(url: Column) -> Column:
    """A job page's key: lower case, no fragment, no tracking parameters, no slash at the end."""
    raw = F.coalesce(url, F.lit(""))
    parts = [F.regexp_extract(raw, _PARTS, i) for i in range(1, 5)]
    #: The parameters that are left out.
    names = ("utm_source", "utm_medium", "utm_campaign", "ref", "fbclid")
    kept = F.filter(F.split(parts[3], "&"), lambda p: (F.length(p) > 0) & ~F.element_at(F.split(p, "="), 1).isin(*names))
    query = F.array_join(kept, "&")
    path = F.when(parts[2] == "", F.lit("/")).otherwise(parts[2])
    whole = F.concat(parts[0], F.lit("://"), parts[1], path, F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)))
    return F.lower(F.when(raw.rlike(_PARTS), F.regexp_replace(whole, "/$", "")).otherwise(raw))


def source_type(url: Column, domain: Column) -> Column:
    """PDF, GOVERNMENT, FACULTY, UNIVERSITY, INSTITUTIONAL, AGGREGATOR or OTHER, by what the URL and the institution's domain tell."""
    host = domain_of(url)
    own = normal_domain(domain)
    inside = own.isNotNull() & (own != "") & same_site(url, domain)
    return (
        F.when(url.rlike(r"(?i)\.pdf(?:\?|$)"), "PDF")
        .when(host.rlike(r"\.(?:gov|gov\.[a-z]{2}|gouv\.[a-z]{2}|go\.[a-z]{2}|govt\.nz)$"), "GOVERNMENT")
        .when(inside & (url.rlike(r"(?i)/(?:faculty|dept|department|school|college|research-?groups?)/") | (host != own)), "FACULTY")
        .when(inside, "UNIVERSITY")
        .when(host.rlike(r"\.(?:edu|ac\.[a-z]{2}|edu\.[a-z]{2})$"), "INSTITUTIONAL")
        .when(host.rlike("scholarship|studyabroad|opportunit|aggregat"), "AGGREGATOR")
        .otherwise("OTHER")
    )
