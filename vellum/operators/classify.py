"""Document types, languages, regions and tiers by ordered rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import policies as p
from vellum.operators import automaton as a

# Keywords of document types, in the order in which types are tried.
TYPE_WORDS = {
    "privacy_policy": ("personal information", "personal data", "data collection", "data processing", "data sharing", "data retention", "privacy rights", "your rights", "data protection", "information we collect", "we collect information", "data subject rights", "privacy choices", "opt-out", "data minimization", "purpose limitation", "données personnelles", "datos personales", "dati personali", "personenbezogene daten"),
    "terms_of_service": ("terms of service", "terms and conditions", "user agreement", "service agreement", "acceptance of terms", "by using our service", "governing law", "jurisdiction", "applicable law", "dispute resolution", "arbitration", "binding arbitration", "limitation of liability", "liabilities limited", "no warranties", "indemnification", "indemnify", "hold harmless", "termination", "account suspension", "service discontinuation", "conditions générales", "términos y condiciones", "condizioni generali", "allgemeine geschäftsbedingungen"),
    "cookie_policy": ("cookie policy", "cookies we use", "cookie consent", "tracking technologies", "third-party cookies", "first-party cookies", "web beacons", "pixel tags", "tracking pixels", "analytics cookies", "functional cookies", "advertising cookies", "cookie preferences", "cookie settings", "manage cookies", "politique de cookies", "política de cookies", "cookie-richtlinie"),
    "copyright_policy": ("copyright", "copyright infringement", "dmca", "takedown notice", "intellectual property", "content ownership", "user content license", "fair use", "copyright protection", "copyright claims"),
    "data_processing_agreement": ("data processing agreement", "dpa", "data processor", "data controller", "sub-processor", "data processing activities", "processing purposes", "data security measures"),
    "gdpr_policy": ("gdpr", "general data protection regulation", "data protection officer", "dpo", "data protection impact assessment", "eu data protection", "european data protection", "article 17", "right to erasure"),
}
CORE_TYPES = ("privacy_policy", "terms_of_service", "cookie_policy", "data_processing_agreement")


def by_words(text: Column, types: dict[str, tuple[str, ...]] = TYPE_WORDS, head: int = 2000, least: int = 3, fallback: str = "other") -> Column:
    """The type with most of its words in the beginning of a text, the first among equals, if there are enough."""
    low = F.lower(F.substring(F.coalesce(text, F.lit("")), 1, head))
    hits = []
    for words in types.values():
        n = F.lit(0)
        for w in words:
            n = n + low.contains(w).cast("int")
        hits.append(n)
    best = F.greatest(*hits) if len(hits) > 1 else hits[0]
    out = F.when(best < least, fallback)
    for name, n in zip(types, hits):
        out = out.when(n == best, name)
    return out.otherwise(fallback)


def language(text: Column, words: dict[str, tuple[str, ...]], head: int = 1000, least: int = 3) -> Column:
    """The language most of whose common words stand in the beginning of a text; null without enough."""
    tokens = F.split(F.lower(F.substring(F.coalesce(text, F.lit("")), 1, head)), r"[^\p{L}]+")

    def count(own: tuple[str, ...]) -> Column:
        return F.size(F.filter(tokens, lambda t: t.isin(*own)))

    hits = [count(w) for w in words.values()]
    best = F.greatest(*hits)
    out = F.when(best < least, F.lit(None).cast("string"))
    for name, n in zip(words, hits):
        out = out.when(n == best, name)
    return out


def regions(text: Column, marks: dict[str, str], head: int = 3000) -> Column:
    """Regions whose pattern a text's beginning has, in the order given; global without any."""
    low = F.lower(F.substring(F.coalesce(text, F.lit("")), 1, head))
    found = F.array_compact(F.array(*[F.when(low.rlike(p), F.lit(r)) for r, p in marks.items()]))
    return F.when(F.size(found) == 0, F.array(F.lit("global"))).otherwise(found)


def visible(doc_type: Column, tier: Column) -> Column:
    """Free users see core types only."""
    return (tier != "free") | doc_type.isin(*CORE_TYPES)


def substantive(text: Column, words: tuple[str, ...], shortest: int = 300, head: int = 2000, least: int = 3) -> Column:
    """Whether a text has the length and enough of the words that a policy's body has."""
    low = F.lower(F.substring(F.coalesce(text, F.lit("")), 1, head))
    hits = F.lit(0)
    for w in words:
        hits = hits + low.contains(w).cast("int")
    return (F.length(F.coalesce(text, F.lit(""))) >= shortest) & (hits >= least)


def signs(text: Column, address: Column, title: Column, description: Column) -> Column:
    """What the cascades below look at: hits of all word lists in a document's text, address and metadata."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    lists = {f"type:{k}": w for k, w in TYPE_WORDS.items()} | {"mark": p.LEGAL_MARKS, "structure": p.STRUCTURE, "menu": p.NAVIGATION, "region": tuple(p.region_words()), "english": p.ENGLISH_SIGNS}
    lists |= {f"foreign:{k}": w for k, w in p.FOREIGN_SIGNS.items()}
    paths = {f"head:{k}": w for k, w in p.URL_HEADS.items()} | {"land": tuple(p.REGION_PATHS)}
    metadata = {f"title:{k}": w for k, w in p.TITLE_WORDS.items()} | {"region": p.REGION_META}
    about = F.concat(low(title), F.lit(" "), low(description))
    return F.struct(a.scan(low(text), lists).alias("text"), a.scan(low(address), paths).alias("url"), a.scan(about, metadata).alias("about"))


def _first(hits: Column, prefix: str, types, keep=lambda h: F.lit(True)) -> Column:
    """The first type with a hit in its list; null without one."""
    def has(t: str) -> Column:
        return F.exists(hits, lambda h: (h["list"] == f"{prefix}:{t}") & keep(h))

    return F.coalesce(*[F.when(has(t), F.lit(t)) for t in types])


def document_type(found: Column, text: Column, address: Column, score: Column, head: int = 2000, least: int = 3) -> Column:
    """(type, is_policy, stage) by the first stage that decides; found: signs(), score: the text's policy score, 0 to 1.

    url: a type's path part, in a text with a legal mark or over 500 characters. about: a type's whole words in title or
    description, over 300 characters, and a policy's path or a long text with a score. words: the type with most words in
    the beginning, at least three, in a text with a policy's structure. short, menu: no policy. Else undecided, with a
    null type, for a provider to judge.
    """
    n = F.length(F.coalesce(text, F.lit("")))
    path = F.regexp_extract(F.lower(F.coalesce(address, F.lit(""))), "^[^?#]*", 0)
    by_url = F.when(a.any_of(found["text"], "mark") | (n > 500), _first(found["url"], "head", p.URL_HEADS))
    trusted = path.rlike(p.POLICY_PATH) | (n > 2000) & (F.coalesce(score, F.lit(0.0)) > 0.4)
    by_about = F.when((n > 300) & trusted, _first(found["about"], "title", p.TITLE_WORDS, lambda h: h["whole"] > 0))
    counts = [F.size(a.of(found["text"], f"type:{t}", head)) for t in TYPE_WORDS]
    best = F.greatest(*counts)
    by_words = F.when((best >= least) & (n > 500) & a.any_of(found["text"], "structure", head), F.coalesce(*[F.when(c == best, F.lit(t)) for t, c in zip(TYPE_WORDS, counts)]))
    stages = [("url", by_url), ("about", by_about), ("words", by_words)]
    out = lambda t, ok, stage: F.struct(t.cast("string").alias("type"), F.lit(ok).alias("is_policy"), F.lit(stage).alias("stage"))
    decided = [F.when(t.isNotNull(), out(t, True, stage)) for stage, t in stages]
    none = [F.when(n < 200, out(F.lit("other"), False, "short")), F.when(a.any_of(found["text"], "menu", 500) & (n < 1000), out(F.lit("other"), False, "menu"))]
    return F.coalesce(*decided, *none, out(F.lit(None), None, "undecided").cast("struct<type:string,is_policy:boolean,stage:string>"))


def document_regions(found: Column, text: Column, head: int = 3000) -> Column:
    """(regions, confidence): by the address, else the metadata, else frameworks, phrases and jurisdictions in the beginning, else global."""
    lands = F.create_map(*[x for k, v in p.REGION_PATHS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    words = F.create_map(*[x for k, v in p.region_words().items() for x in (F.lit(k), F.array(*map(F.lit, v)) if v else F.expr("cast(array() as array<string>)"))])
    codes = lambda hits, table: F.flatten(F.transform(hits, lambda h: table[h["word"]]))
    by_url = F.array_distinct(codes(a.of(found["url"], "land"), lands))
    start = F.substring(F.lower(F.coalesce(text, F.lit(""))), 1, head)
    ruled = F.flatten(F.array(*[F.when(start.rlike(f"(?d){pattern}"), F.array(*map(F.lit, own))).otherwise(F.expr("cast(array() as array<string>)")) for pattern, own in p.JURISDICTIONS.items()]))
    by_text = F.array_distinct(F.concat(codes(a.of(found["text"], "region", head), words), ruled))
    out = lambda r, c: F.struct(r.alias("regions"), F.lit(c).alias("confidence"))
    return F.when(F.size(by_url) > 0, out(by_url, 0.80)).when(a.any_of(found["about"], "region"), out(F.array(F.lit("EU")), 0.75)).when(F.size(by_text) > 0, out(by_text, 0.85)).otherwise(out(F.array(F.lit("global")), 0.70))


def document_locale(found: Column, address: Column, og: Column, html_lang: Column, alternates: Column) -> Column:
    """(locale, confidence): by Open Graph, the page's language, its first alternate, its address, then by signs in the beginning.

    Null where nothing decides, for a provider to judge; its fallback is en-US at 0.5.
    """
    given = [(og, 0.95), (html_lang, 0.85), (F.get(alternates, F.lit(0)), 0.75)]
    low = F.lower(F.coalesce(address, F.lit("")))
    by_url = F.coalesce(*[F.when(low.rlike(pattern), F.lit(x)) for pattern, x in p.LOCALE_PATHS.items()])
    english = F.when(F.size(a.of(found["text"], "english", 1000)) >= 3, F.lit("en-US"))
    foreign = F.coalesce(*[F.when(F.size(a.of(found["text"], f"foreign:{k}", 1000)) >= 2, F.lit(k)) for k in p.FOREIGN_SIGNS])
    steps = [*((F.when(c != "", c), x) for c, x in given), (by_url, 0.80), (english, 0.70), (foreign, 0.70)]
    return F.coalesce(*[F.when(c.isNotNull(), F.struct(c.alias("locale"), F.lit(x).alias("confidence"))) for c, x in steps])


def with_signs(docs: DataFrame, text: str = "text", address: str = "url", title: str = "title", description: str = "description") -> DataFrame:
    """docs with signs, computed once for all cascades."""
    return docs.withColumn("signs", signs(F.col(text), F.col(address), F.col(title), F.col(description)))
