"""What tells a policy's type, region and locale. Operators take them as parameters."""

# Beginnings of path parts by document type, in the order in which types are tried.
URL_HEADS = {
    "privacy_policy": ("/privacy", "/data-protection", "/data_protection", "/datenschutz", "/politique-de-confidentialite", "/politica-de-privacidad", "/informativa-sulla-privacy", "/privacidad"),
    "terms_of_service": ("/term", "/tos", "/nutzungsbedingungen", "/conditions-d-utilisation", "/terminos-de-servicio", "/condizioni-di-servizio", "/user-agreement", "/service-agreement"),
    "cookie_policy": ("/cookie", "/politique-de-cookies", "/politica-de-cookies"),
    "copyright_policy": ("/copyright", "/dmca", "/intellectual-property", "/ip-policy"),
    "data_processing_agreement": ("/dpa", "/data-processing", "/processing-agreement"),
    "gdpr_policy": ("/gdpr", "/eu-privacy", "/european-privacy"),
    "security_policy": ("/security", "/trust", "/safety-and-security", "/vulnerability", "/responsible-disclosure", "/responsible_disclosure"),
    "community_guidelines": ("/safety", "/community", "/content-policy", "/transparency", "/rule", "/guideline"),
    "children_privacy_policy": ("/children-privacy", "/children_privacy", "/childrens-privacy", "/childrens_privacy", "/children's-privacy", "/children's_privacy", "/children-s-privacy", "/children-s_privacy", "/kids-privacy", "/kids_privacy", "/child-privacy", "/child_privacy", "/coppa"),
}
# Words of titles and descriptions by document type.
TITLE_WORDS = {
    "privacy_policy": ("privacy policy", "privacy notice", "privacy statement", "data protection", "data privacy", "privacy rights", "datenschutz", "datenschutzerklärung", "politique de confidentialité", "política de privacidad", "informativa sulla privacy", "privacy shield", "gdpr compliance"),
    "terms_of_service": ("terms of service", "terms and conditions", "terms of use", "user agreement", "service agreement", "terms & conditions", "tos", "conditions of use", "nutzungsbedingungen", "conditions d'utilisation", "términos de servicio", "términos y condiciones", "condizioni di servizio", "user terms", "service terms"),
    "cookie_policy": ("cookie policy", "cookie notice", "cookie statement", "cookie consent", "cookie settings", "cookie preferences", "cookies policy", "cookie richtlinie", "politique de cookies", "política de cookies", "cookie banner", "cookie management"),
    "copyright_policy": ("copyright", "copyright policy", "copyright notice", "dmca", "dmca policy", "digital millennium copyright act", "intellectual property", "ip policy", "content rights", "copyright infringement", "copyright protection"),
    "data_processing_agreement": ("data processing agreement", "dpa", "data processing addendum", "processing agreement", "data processor agreement"),
    "gdpr_policy": ("gdpr", "gdpr policy", "eu privacy", "european privacy", "general data protection regulation"),
    "security_policy": ("security practices", "security policy", "information security", "trust center", "security overview", "data security", "security and compliance"),
    "community_guidelines": ("safety policy", "community guidelines", "content policy", "acceptable use", "community standards", "platform rules", "transparency center", "transparency report", "safety center", "enforcement", "appeals"),
    "children_privacy_policy": ("children's privacy", "children privacy", "child privacy", "kids privacy", "coppa", "privacy for children"),
}
LEGAL_MARKS = ("effective date", "last updated", "governing law", "jurisdiction", "dispute", "liability", "indemnification")
STRUCTURE = ("effective", "last updated", "publish date", "published:", "last revised")
NAVIGATION = ("home", "about", "contact", "menu", "navigation", "search")
POLICY_PATH = r"legal|privacy|terms|polic|guideline|safety|trust|transparency|compliance"

# Regions of path parts, frameworks, phrases and jurisdictions, and the code of each region.
REGION_PATHS = {
    "/eu/": ("EU",), "/europe/": ("EU",), "/uk/": ("UK",), "/gb/": ("UK",), "/us/": ("US",), "/usa/": ("US",), "/ca/": ("Canada",), "/canada/": ("Canada",), "/au/": ("Australia",),
    "/australia/": ("Australia",), "/br/": ("Brazil",), "/brazil/": ("Brazil",), "/kr/": ("South Korea",), "/korea/": ("South Korea",), "/jp/": ("Asia",), "/asia/": ("Asia",),
}
FRAMEWORKS = {
    "gdpr": ("EU",), "eprivacy": ("EU",), "dsa": ("EU",), "dma": ("EU",), "ccpa": ("US",), "cpra": ("US",), "vcdpa": ("US",), "ctdpa": ("US",), "cpa": ("US",), "ucpa": ("US",), "fdcpa": ("US",), "glba": ("US",), "hipaa": ("US",),
    "pipeda": ("Canada",), "casl": ("Canada",), "lgpd": ("Brazil",), "pdpl_argentina": ("Other",), "pdpa": ("Asia", "South Korea"), "appi": ("Asia",), "pipl": ("Asia",), "pdp_thailand": (), "privacy_act_australia": ("Australia",), "popia_south_africa": (),
    "pdpl_uae": ("Other",), "popia_israel": ("Israel",), "iso 27001": ("global",), "iso 27701": ("global",), "soc 2": ("global",),
}
REGION_PHRASES = {
    "US": ("for california residents", "for california users", "california privacy", "california consumer privacy act", "for nevada residents", "for virginia residents", "for colorado residents", "for utah residents", "for connecticut residents", "for us residents", "for united states residents"),
    "EU": ("for users in the eu", "for european users", "for eu residents", "for european residents", "european economic area", "eea residents"),
    "UK": ("for uk residents", "for united kingdom residents", "for british residents", "for england residents", "for wales residents", "for scotland residents", "for northern ireland residents"),
    "Canada": ("for canadian users", "for users in canada", "for canadian residents"),
    "Australia": ("for australian users", "for users in australia", "for australian residents"),
    "Brazil": ("for users in brazil", "for brazilian users", "for brazilian residents"),
    "Asia": ("for japanese users", "for users in japan"),
}
#: Other countries: a people and its land, as "for ... users" and "for users in ...".
COUNTRIES = (("german", "germany", "EU"), ("french", "france", "EU"), ("spanish", "spain", "EU"), ("italian", "italy", "EU"), ("mexican", "mexico", "Other"), ("argentinian", "argentina", "Other"), ("singapore", "singapore", "Asia"), ("south korean", "south korea", "South Korea"), ("chinese", "china", "Asia"), ("indian", "india", "Asia"))
JURISDICTIONS = {
    r"governed by the laws of (?:the )?[^,\.]+": ("UK", "US", "Canada"),
    r"jurisdiction.*(?:england|wales|united kingdom)": ("UK",),
    r"jurisdiction.*(?:california|new york|united states)": ("US",),
    r"jurisdiction.*(?:ontario|british columbia|canada)": ("Canada",),
}
REGION_META = ("eu", "european union", "gdpr")


def region_words() -> dict[str, tuple[str, ...]]:
    """Frameworks, then phrases, each with the codes it stands for, in the order in which they are tried."""
    phrases = {p: (code,) for code, own in REGION_PHRASES.items() for p in own}
    lands = {p: (code,) for people, land, code in COUNTRIES for p in (f"for {people} users", f"for users in {land}")}
    return {**FRAMEWORKS, **phrases, **lands}


# Locales of path parts, signs of English and of other languages.
LOCALE_PATHS = {
    r"/en[-_]?us?/": "en-US", r"/en[-_]?gb?/": "en-GB", r"/en[-_]?ca?/": "en-CA", r"/en/": "en-US", r"/fr[-_]?fr?/": "fr-FR", r"/de[-_]?de?/": "de-DE", r"/es[-_]?es?/": "es-ES",
    r"/it[-_]?it?/": "it-IT", r"/pt[-_]?br?/": "pt-BR", r"/ja[-_]?jp?/": "ja-JP", r"/zh[-_]?cn?/": "zh-CN", r"/ko[-_]?kr?/": "ko-KR",
}
ENGLISH_SIGNS = ("privacy policy", "terms of service", "effective date", "last updated", "we collect", "personal information", "data protection", "your rights", "governing law", "jurisdiction", "dispute resolution")
FOREIGN_SIGNS = {
    "fr-FR": ("politique de confidentialité", "conditions d'utilisation", "données personnelles"),
    "de-DE": ("datenschutzerklärung", "nutzungsbedingungen", "personenbezogene daten"),
    "es-ES": ("política de privacidad", "términos de servicio", "datos personales"),
    "it-IT": ("informativa sulla privacy", "termini di servizio", "dati personali"),
}

# Weights of path parts in a URL's score.
PATH_WEIGHTS = {
    "/privacy": 5.0, "/terms": 4.5, "/tos": 5.0, "/dpa": 5.0, "/data-processing-addendum": 5.0, "/gdpr": 4.5, "/ccpa": 4.5, "/addendum": 4.5, "/legal": 4.0, "/policy": 4.0, "/policies": 4.0, "/agreement": 3.5,
    "/compliance": 3.5, "/cookie": 4.0, "/data-processing": 4.0, "/subprocessors": 4.0, "/security": 3.0, "/disclaimer": 3.0, "/company": 3.0, "/vendors": 3.0, "/suppliers": 3.0, "/transparency": 3.5,
    "/company/legal": 4.5, "/company/privacy": 4.5, "/company/terms": 4.5, "/company/tos": 4.5, "/about/legal": 4.5, "/about/privacy": 4.5, "/about/terms": 4.5, "/about/tos": 4.5, "/support/legal": 4.0,
    "/support/privacy": 4.0, "/support/terms": 4.0, "/help/legal": 4.0, "/help/privacy": 4.0, "/help/terms": 4.0, "/policies/privacy": 4.5, "/policies/terms": 4.5, "/policies/cookies": 4.5, "/legal/policies": 4.0,
    "/legal/policies/privacy": 4.5, "/legal/policies/terms": 4.5, "/legal/policies/cookies": 4.5, "/policy/privacy": 4.5, "/policy/terms": 4.5, "/policy/cookies": 4.5, "/policy/cookie": 4.5,
    "/policy/terms-of-service": 4.5, "/policy/terms-of-use": 4.5, "/policy/data": 4.0, "/policy/gdpr": 4.5, "/policy/ccpa": 4.5, "/policy/community": 4.0, "/policy/safety": 4.0, "/policy/copyright": 4.0,
}
HEX_PATH, HEX_WEIGHT = r"/[a-f0-9-]{32,}", 2.0
GLOSSARY_PATH, GLOSSARY_WEIGHT = r"/[^/]+/terms/(?!service|use|conditions|sale|payment|payments|business|general|user|website|privacy|cookie|cookies|policy|of-|and-)[^/]+", 8.5
REDIRECT_PARAMETERS = ("return_to", "returnto", "return", "redirect", "redirect_to", "redirect_uri", "redir", "next", "url", "continue", "dest", "destination", "goto", "go", "ref_url", "callback", "came_from", "origin")
