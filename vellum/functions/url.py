"""URL expressions. A URL is taken apart by one pattern: scheme, host, path, query."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
TRACKING_PARAMETERS = ("gclid", "gbraid", "wbraid", "dclid", "fbclid", "msclkid", "yclid", "twclid", "ttclid", "igshid", "li_fat_id", "rdt_cid", "_ga", "_gl", "mc_cid", "mc_eid", "mkt_tok", "_hsenc", "_hsmi", "vero_id", "vero_conv", "oly_anon_id", "oly_enc_id", "ef_id", "s_kwcid", "rel")
LANGUAGE_CODES = ("ar", "cs", "da", "de", "en", "es", "fi", "fr", "hu", "id", "it", "ja", "ko", "ms", "nl", "no", "pl", "ro", "ru", "sv", "th", "tr", "vi")
LANGUAGE_PARAMETERS = ("lang", "language", "hl")
TWO_PART_SUFFIXES = ("co.uk", "com.au", "co.nz", "co.jp", "com.br", "co.in")

PATTERN = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, PATTERN, group)


def scheme(url: Column) -> Column:
    return part(url, 1)


def host(url: Column) -> Column:
    return F.lower(part(url, 2))


def path(url: Column) -> Column:
    return part(url, 3)


def query(url: Column) -> Column:
    return part(url, 4)


def parameter_name(pair: Column) -> Column:
    return F.lower(F.regexp_extract(pair, "^([^=]*)", 1))


def keep_parameters(text: Column, keep) -> Column:
    """The query string with those pairs for which keep(name) holds."""
    return F.array_join(F.filter(F.split(text, "&"), lambda p: (p != "") & keep(parameter_name(p))), "&")


def build(url: Column, new_path: Column, new_query: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), part(url, 2), new_path, F.when(new_query != "", F.concat(F.lit("?"), new_query)).otherwise(F.lit("")))


def normalize(url: Column) -> Column:
    """No fragment, no tracking parameters, no slash at the end of a path."""
    kept = keep_parameters(query(url), lambda n: ~n.startswith("utm_") & ~n.isin(*TRACKING_PARAMETERS))
    made = build(url, path(url), kept)
    return F.when(made.endswith("/") & (F.length(path(url)) > 1), F.substring(made, F.lit(1), F.length(made) - 1)).otherwise(made)


def canonicalize(url: Column) -> Column:
    """Without bare language segments and display-language parameters; regional tags and ?locale= stay."""
    kept = F.filter(F.split(path(url), "/"), lambda s: (s != "") & ~F.lower(s).isin(*LANGUAGE_CODES))
    return build(url, F.concat(F.lit("/"), F.array_join(kept, "/")), keep_parameters(query(url), lambda n: ~n.isin(*LANGUAGE_PARAMETERS)))


def canonical_rank(url: Column) -> Column:
    """(looks_locale, path length): the smaller, the more canonical."""
    way = F.when(path(url) == "", "/").otherwise(path(url))
    locale = way.rlike(r"(?i)^/[a-z]{2}([-_][a-z]{2})?(/|$)") | (host(url).rlike(r"^[a-z]{2}([-_][a-z]{2})?\.") & ~host(url).startswith("www."))
    return F.struct(locale.cast("int").alias("looks_locale"), F.length(way).alias("path_length"))


def normalize_domain(domain: Column) -> Column:
    """Lower case, without scheme, path, port and www."""
    out = F.regexp_replace(F.lower(F.trim(domain)), r"^.*?://", "")
    out = F.regexp_replace(out, r"[/:].*$", "")
    return F.regexp_replace(out, r"^www\.", "")


def base_domain(domain: Column) -> Column:
    """The last two labels, or three after a two-part suffix (no public-suffix list is at hand)."""
    labels = F.split(normalize_domain(domain), r"\.")
    last = lambda n: F.array_join(F.slice(labels, -n, n), ".")
    return F.when(F.size(labels) <= 2, F.array_join(labels, ".")).when(last(2).isin(*TWO_PART_SUFFIXES), last(3)).otherwise(last(2))


def domain_slug(domain: Column) -> Column:
    return F.lower(F.element_at(F.split(base_domain(domain), r"\."), 1))


def domain_name(domain: Column) -> Column:
    return F.initcap(F.translate(domain_slug(domain), "-_", "  "))


def locale_key(url: Column) -> Column:
    """(canonical, had_signal, is_english) of a URL's language marks."""
    segments = F.filter(F.split(path(url), "/"), lambda s: s != "")
    marks = F.filter(segments, lambda s: F.lower(s).isin(*LANGUAGE_CODES))
    return F.struct(canonicalize(url).alias("canonical"), (F.size(marks) > 0).alias("had_signal"), F.exists(marks, lambda s: F.lower(s) == "en").alias("is_english"))


def under_domain(name: Column, domains: Column) -> Column:
    """Whether a host is one of the domains or below one."""
    return F.exists(domains, lambda d: (name == d) | name.endswith(F.concat(F.lit("."), d)))


def candidates(base: Column, paths: tuple[str, ...]) -> Column:
    """URLs made of a site's base and well-known paths."""
    return F.transform(F.array(*map(F.lit, paths)), lambda p: F.concat(F.regexp_replace(base, "/+$", ""), p))
