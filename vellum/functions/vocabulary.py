"""Word lists, patterns and weights of the policy domain. Operators take them as parameters."""

LEGAL_INDICATORS = (
    "terms of service", "privacy policy", "cookie policy", "data protection", "personal information", "third parties", "we collect", "your rights", "lawful basis", "consent",
    "legitimate interest", "data controller", "data processor", "retention period", "delete your data", "opt out", "agreement", "binding", "governing law", "jurisdiction",
    "liability", "disclaimer", "limitation of liability", "indemnification", "intellectual property", "copyright", "trademark", "infringement", "compliance", "regulatory",
    "gdpr", "ccpa", "hipaa", "coppa", "data processing addendum", "dpa", "subprocessor", "subprocessors", "sub-processor", "sub-processors",
    "vendor", "suppliers", "third party service provider", "service provider", "data transfer", "international transfer", "adequacy decision", "standard contractual clauses", "scc", "binding corporate rules",
    "bcr", "data subject rights", "data security", "data breach", "processing activities", "personal data", "special categories", "sensitive data", "transparency report",
)

LEGAL_PHRASES = (
    r"by using (?:this|our) (?:service|website|platform)",
    r"you agree to (?:these|our) terms",
    r"we (?:collect|process|use) your (?:personal )?(?:data|information)",
    r"this policy (?:describes|explains) how we",
    r"we may (?:update|modify|change) this policy",
    r"your (?:privacy|data|personal information) is important",
    r"we are committed to protecting your privacy",
    r"cookies (?:are|help us)",
    r"you have the right to",
    r"data retention period",
    r"lawful basis for processing",
    r"data processing addendum",
    r"this addendum (?:forms|supplements|amends)",
    r"subprocessor(?:s)? (?:list|agreement)",
    r"we (?:engage|use) (?:third.party|sub.?processor)",
    r"processing (?:activities|operations|purposes)",
    r"data subject (?:rights|requests)",
    r"cross.border (?:transfer|data transfer)",
    r"adequacy decision",
    r"standard contractual clauses",
    r"security (?:measures|safeguards|controls)",
    r"data (?:breach|incident) (?:notification|response)",
    r"controller (?:and|to) processor",
    r"processor (?:instructions|obligations)",
)

QUICK_CHECK = r"\b(?:privacy|terms|policy|agreement|legal|gdpr|ccpa|cookie|data protection|liability|disclaimer|jurisdiction|compliance|consent|rights)\b"
TITLE_KEYWORDS = ("terms", "privacy", "policy", "cookie", "legal", "agreement", "data", "gdpr")

URL_PHRASES = {
    r"privacy-policy": 8.0,
    r"\bprivacy\s+policy\b": 8.0,
    r"\bprivacy\s+notice\b": 7.0,
    r"terms-of-service": 8.0,
    r"\bterms\s+of\s+service\b": 8.0,
    r"\bterms\s+of\s+use\b": 7.5,
    r"\bterms\s+and\s+conditions\b": 7.5,
    r"cookie-policy": 7.0,
    r"\bcookie\s+policy\b": 7.0,
    r"data-processing-addendum": 8.0,
    r"\bdata\s+processing\s+addendum\b": 8.0,
    r"subprocessors": 6.0,
    r"gdpr": 6.0,
    r"ccpa": 6.0,
}
URL_KEYWORDS = {
    "privacy": 5.0, "dpa": 5.0, "privacy-policy": 5.0, "terms-of-service": 5.0, "terms-and-conditions": 5.0, "terms-of-use": 5.0, "terms": 4.0, "addendum": 4.5, "cookie-policy": 4.5, "gdpr": 4.5, "ccpa": 4.5,
    "hipaa": 4.5, "coppa": 4.5, "pipeda": 4.5, "policy": 4.0, "cookie": 4.0, "cookies": 4.0, "subprocessors": 4.0, "legal": 3.5, "agreement": 3.5, "conditions": 3.5, "compliance": 3.5, "processor": 3.5,
    "subprocessor": 3.5, "protection": 3.5, "dmca": 3.5, "transparency": 3.5, "disclaimer": 3.0, "security": 3.0, "safety": 3.0, "copyright": 3.0, "consent": 3.0, "license": 3.0, "data": 2.5, "processing": 2.5,
    "notice": 2.5, "rights": 2.5, "rules": 2.5, "trust": 2.0, "partners": 2.0, "vendor": 2.5, "suppliers": 2.5, "associate": 2.0, "report": 2.0, "company": 1.0, "contact": -1.0, "news": -1.0,
}
AUTH_PATH = r"(?:^|/)(?:log[-_]?in|log[-_]?out|sign[-_]?in|sign[-_]?out|sign[-_]?up|signon|register|oauth2?|openid|sso|saml|authorize|authentication)(?:/|$)"
GALLERY_PATH = r"^/(?:templates?|universe|marketplace|gallery|showcase|examples?)(?:/|$)"
STRONG_PATH = r"(?:^|/)(?:privacy|terms|tos|legal|cookies?|gdpr|ccpa|dpa|data-processing(?:-addendum)?|sub-?processors?|site-policy|policies|policy|eula|acceptable-use|community-guidelines)(?:[-_/]|$)"
