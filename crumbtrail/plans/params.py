"""Parameter tables: lists, weights and bands. All can be replaced by the caller's own tables."""

from __future__ import annotations

# Criterion weights, outcome weights, grade bands, CMP signatures, cookie-name
# patterns, double-negative patterns and public-sector and two-label suffixes that results depend on.
WEIGHTS = {"c1": 0.30, "c2": 0.20, "c3": 0.10, "c4": 0.15, "c5": 0.15, "c6": 0.10}
LEGACY_WEIGHTS = {"c1": 0.25, "c2": 0.20, "c3": 0.15, "c4": 0.15, "c5": 0.15, "c6": 0.10}
OUTCOME_WEIGHTS = {"trackers": 0.35, "third_parties": 0.20, "cookies": 0.10, "honesty": 0.35}
GRADES = [(90, "A"), (75, "B"), (60, "C"), (40, "D"), (0, "F")]
CMP_SIGNATURES = [
    ("OneTrust", ["onetrust", "optanon", "cookie-consent-banner"]),
    ("Cookiebot", ["cookiebot", "CookieConsent", "Cybot"]),
    ("Quantcast", ["quantcast", "__cmpLocator", "cmp2.js"]),
    ("TrustArc", ["trustarc", "truste", "consent-manager"]),
    ("Didomi", ["didomi"]),
    ("Usercentrics", ["usercentrics"]),
    ("Sourcepoint", ["sourcepoint", "privacy-mgmt", "sp_message", "sp_choice_type"]),
]
HEURISTICS = [
    (r"^_ga$|^_ga_", "Google", "Analytics"),
    (r"^_gid$", "Google", "Analytics"),
    (r"^_gat", "Google", "Analytics"),
    (r"^__utm", "Google", "Analytics"),
    (r"_fbp|_fbc|fbp", "Meta", "Social"),
    (r"^_hjid|^_hj", "Hotjar", "Analytics"),
    (r"^_tt_", "TikTok", "Social"),
    (r"^li_|^bcookie|^lidc", "LinkedIn", "Social"),
    (r"^IDE$|^test_cookie$|^DSID$", "Google", "Advertising"),
    (r"^NID$|^APISID$|^SAPISID$|^SID$|^SSID$|^HSID$", "Google", "Functional"),
    (r"^_pin_|^_pinterest_", "Pinterest", "Social"),
    (r"^amp_", "Amplitude", "Analytics"),
    (r"^mp_", "Mixpanel", "Analytics"),
]
DOUBLE_NEGATIVES = [
    r"don'?t\s+(not|reject|refuse|decline)",
    r"nicht\s+(ablehnen|verweigern)",
    r"ne\s+pas\s+(refuser|rejeter)",
    r"I\s+do\s+not\s+want\s+to\s+not",
]
TWO_LABEL_SUFFIXES = [
    "co.uk", "org.uk", "ac.uk", "gov.uk", "me.uk", "com.au", "net.au", "org.au", "com.br", "co.jp", "ac.jp", "or.jp",
    "ne.jp", "co.kr", "co.in", "co.za", "com.tr", "com.mx", "co.nz", "com.ar", "com.cn", "com.tw", "co.il", "com.sg",
    "com.hk", "co.th", "com.ua", "com.pk", "com.my", "com.ng", "com.eg", "com.vn", "com.ph", "com.co", "com.pe",
]
GOV_SUFFIXES = [
    ".gov", ".gov.uk", ".gov.au", ".gov.tr", ".gov.br", ".gov.in", ".gob.es", ".gob.mx", ".gouv.fr", ".governo.it",
    ".bund.de", ".govt.nz", ".gov.ie", ".gov.pl", ".gov.gr", ".gov.pt", ".gov.ro", ".gov.bg", ".gov.cz", ".gov.hu",
    ".gov.sk", ".gov.si", ".gov.lt", ".gov.lv", ".gov.ee", ".gov.hr", ".gov.mt", ".gov.cy",
]

# Our own small lists.
TRACKERS = [
    ("doubleclick.net", "Google", "Advertising"),
    ("google-analytics.com", "Google", "Analytics"),
    ("facebook.net", "Meta", "Social"),
    ("criteo.com", "Criteo", "Advertising"),
    ("hotjar.com", "Hotjar", "Analytics"),
    ("tiktok.com", "TikTok", "Social"),
]
EASYPRIVACY = ["scorecardresearch.com", "hotjar.com", "stats.newsroom.co.uk"]
EASYLIST = ["adnxs.com", "taboola.com"]
ENTITIES = [("doubleclick.net", 1), ("google-analytics.com", 1), ("gstatic.com", 1), ("facebook.net", 2), ("criteo.com", 3)]
# Labels of buttons by what they do: an example with the common ones of each language. Which action a label
# stands for. A full list is a parameter: the path in VOCABULARY_SETTING, see sources.readers.read_vocabulary. Terms are
# compared in lower case, without accents.
#: The session setting that names a vocabulary file; without it the example counts.
VOCABULARY_SETTING = "crumbtrail.vocabulary"
VOCABULARY = [
    ("reject", "exact", [
        "reject", "reject all", "decline", "decline all", "refuse", "refuse all", "deny", "disagree", "i do not accept", "tout refuser", "refuser",
        "alle ablehnen", "ablehnen", "alles afwijzen", "weigeren", "rechazar todo", "rechazar", "rifiuta", "rifiuta tutto", "recusar", "rejeitar tudo",
        "odrzuć wszystkie", "respinge", "odmítnout", "avvisa alla", "afvis alle", "avslå", "hylkää kaikki", "απόρριψη", "elutasítás", "odmietnuť",
        "zavrni", "odbij sve", "отказ", "atmesti", "noraidīt", "keeldu", "hafna", "diúltaigh", "irrifjuta", "reddet", "tümünü reddet",
    ]),
    ("reject", "contains", [
        "reject all", "reject optional", "refuse all", "necessary only", "only necessary", "necessary cookies only", "only essential", "essential only",
        "essential cookies only", "continue without accepting", "nur notwendige", "continuer sans accepter", "alleen noodzakelijke", "solo necesarias",
        "solo cookie necessari", "apenas necessarios", "tylko niezbedne", "doar esentiale", "pouze nezbytne", "endast nodvandiga", "kun nodvendige",
        "vain valttamattomat", "μονο τα απαραιτητα", "csak a szukseges", "iba nevyhnutne", "samo nujni", "samo nuzni", "само необходимите", "tik butini",
        "tikai nepieciesamas", "ainult vajalikud", "an samþykkis", "riachtanacha amhain", "essenzjali biss", "yalnizca gerekli", "sadece gerekli",
    ]),
    ("accept", "exact", [
        "accept", "i accept", "accept all", "accept cookies", "i accept cookies", "allow all", "agree", "i agree", "tout accepter", "accepter",
        "j'accepte", "alle akzeptieren", "akzeptieren", "zustimmen", "alle accepteren", "accepteren", "aceptar todo", "aceptar", "accetta", "accetta tutto",
        "aceitar", "zaakceptuj wszystkie", "accepta", "prijmout vse", "godkann alla", "godta alle", "hyvaksy kaikki", "αποδοχη", "elfogadom", "prijat vsetko",
        "sprejmi vse", "prihvati sve", "приемам", "sutinku", "piekritu", "noustun", "samþykkja", "glac leis", "accetta kollox", "kabul et",
    ]),
    ("accept", "contains", ["accept", "agree", "allow all", "akzeptieren", "accepter", "aceptar", "accetta", "kabul"]),
    ("settings", "exact", ["settings", "manage", "options", "einstellungen", "parametres", "preferencias", "vis muligheder", "preferenze", "ayarlar"]),
    ("settings", "contains", [
        "manage", "preferences", "customi", "settings", "einstellungen", "options", "instellingen", "gerir", "configur", "ustawienia", "nastaveni",
        "installningar", "innstillinger", "asetukset", "προβολη επιλογων", "beallitas", "nastavenia", "nastavitve", "postavke", "настройки", "nustatymai",
        "parvaldit", "seaded", "stillingar", "socruithe", "settings tal-cookies", "ayarlari", "ayarları",
    ]),
    ("dismiss", "exact", ["ok", "okay", "continue", "got it", "i understand", "understood", "close", "dismiss", "later", "not now", "remind me later", "lean ar aghaidh", "schliessen", "fermer", "cerrar", "chiudi"]),
    ("dismiss", "contains", []),
]
# Words and phrases that the rules look for.
NECESSARY = [
    "necessary", "essential", "required", "strictly necessary", "erforderlich", "notwendig", "unbedingt erforderlich", "necessaire", "nécessaire",
    "strictement necessaire", "strictement nécessaire", "noodzakelijk", "strikt noodzakelijk", "necesario", "estrictamente necesario", "necessario",
    "strettamente necessario", "necessarios", "necessários", "essenciais", "niezbedne", "niezbędne", "konieczne", "esentiale", "esențiale", "nezbytne",
    "nezbytné", "nodvandiga", "nödvändiga", "nodvendige", "nødvendige", "valttamattomat", "välttämättömät", "aparaitita", "απαραίτητα", "szukseges",
    "szükséges", "nevyhnutne", "nevyhnutné", "nujni", "nuzni", "необходимите", "butini", "nepieciesamas", "nepieciešamās", "vajalikud", "naudsynlegar",
    "nauðsynlegar", "riachtanacha", "essenzjali", "gerekli", "zorunlu",
]
CONFIRM = [
    "confirm choices", "save choices", "apply choices", "confirm selection", "confirm selections", "save preferences", "apply preferences", "save settings",
    "apply settings", "secimleri onayla", "seçimleri onayla",
]
BANNER_WORDS = [
    "cookie", "cookies", "consent", "gdpr", "data protection", "datenschutz", "cerez", "çerez", "gizlilik", "slapuk", "sikdat", "sīkdat", "kupsis", "küpsis",
    "koku", "vafrakaka", "fianan", "fianán", "cookie-uri", "piškot", "kolac", "kolači", "бисквит",
]
BANNER_PHRASES = [
    "privacy choices", "your privacy choices", "privacy preferences", "manage privacy preferences", "manage privacy choices", "we value your privacy",
    "cookie choices", "cookie preferences", "cookie settings", "cerez tercihleri", "çerez tercihleri", "gizlilik tercihleri", "nastaveni cookies",
    "nastavení cookies", "cookie-instellingen", "configuracion de cookies", "configuración de cookies", "impostazioni cookie", "configuracoes de cookies",
    "configurações de cookies",
]
BANNER_HINTS = ["cookie", "consent", "gdpr", "cmp", "tcf", "onetrust", "didomi", "trustarc", "cookiebot", "sourcepoint", "privacy-mgmt", "sp_message", "sp_choice_type"]
PURPOSES = [
    "analytics", "advertising", "personalization", "marketing", "functional", "preferences", "statistics", "targeting", "analyse", "werbung",
    "personalisierung", "analytique", "publicite", "publicité", "personnalisation", "analitica", "analítica", "personalizacao", "personalização",
    "statistiques", "estatisticas", "estatísticas",
]
VENDORS = ["google", "facebook", "meta", "analytics", "advertisement"]
PRIVACY_LINKS = [
    "privacy policy", "privacy notice", "data protection", "datenschutz", "datenschutzerklaerung", "datenschutzerklärung", "politique de confidentialite",
    "politique de confidentialité", "privacybeleid", "privacyverklaring", "politica de privacidad", "política de privacidad", "informativa sulla privacy",
    "gizlilik politikasi", "gizlilik politikası", "politica de privacidade", "polityka prywatnosci", "polityka prywatności", "setari de confidentialitate",
    "nastaveni ochrany soukromi", "nastavení ochrany soukromí",
]
GUILT = [
    "keep the site free", "support our journalist", "help us improve", "you'll miss out", "you will miss out", "miss personalized", "enjoy a better experience",
    "support free journalism", "we need your support", "without your support", "fund our work", "keep this site running", "best experience", "optimal experience",
    "unterstutzen sie uns", "unterstützen sie uns", "helfen sie uns", "kostenlos halten", "bessere erfahrung", "optimale erfahrung", "soutenez-nous", "aidez-nous",
    "meilleure experience", "meilleure expérience", "garder le site gratuit", "experience optimale", "expérience optimale", "steun ons", "help ons", "beste ervaring",
]
TCF = ["__tcfapi", "__cmp", "__tcfapiLocator", "tcfapi"]
WALL_WORDS = ["wall", "blocker", "overlay", "modal", "blocking"]
HIDDEN_CLASSES = ["hidden", "sr-only", "visually-hidden", "d-none", "invisible"]
FALLBACK_TRACKERS = [
    ("doubleclick.net", "Google", "Advertising"), ("googlesyndication.com", "Google", "Advertising"), ("googleadservices.com", "Google", "Advertising"),
    ("googleads.g.doubleclick.net", "Google", "Advertising"), ("adnxs.com", "Xandr/Microsoft", "Advertising"), ("criteo.com", "Criteo", "Advertising"),
    ("criteo.net", "Criteo", "Advertising"), ("amazon-adsystem.com", "Amazon", "Advertising"), ("adsrvr.org", "The Trade Desk", "Advertising"),
    ("rubiconproject.com", "Rubicon Project", "Advertising"), ("pubmatic.com", "PubMatic", "Advertising"), ("casalemedia.com", "Casale Media", "Advertising"),
    ("openx.net", "OpenX", "Advertising"), ("taboola.com", "Taboola", "Advertising"), ("outbrain.com", "Outbrain", "Advertising"),
    ("google-analytics.com", "Google", "Analytics"), ("googletagmanager.com", "Google", "Analytics"), ("hotjar.com", "Hotjar", "Analytics"),
    ("hotjar.io", "Hotjar", "Analytics"), ("mouseflow.com", "Mouseflow", "Analytics"), ("newrelic.com", "New Relic", "Analytics"),
    ("segment.io", "Segment", "Analytics"), ("segment.com", "Segment", "Analytics"), ("amplitude.com", "Amplitude", "Analytics"),
    ("mixpanel.com", "Mixpanel", "Analytics"), ("clarity.ms", "Microsoft", "Analytics"), ("scorecardresearch.com", "comScore", "Analytics"),
    ("chartbeat.com", "Chartbeat", "Analytics"), ("chartbeat.net", "Chartbeat", "Analytics"), ("facebook.net", "Meta", "Social"),
    ("facebook.com", "Meta", "Social"), ("fbcdn.net", "Meta", "Social"), ("connect.facebook.net", "Meta", "Social"), ("twitter.com", "X/Twitter", "Social"),
    ("platform.twitter.com", "X/Twitter", "Social"), ("linkedin.com", "LinkedIn", "Social"), ("snap.licdn.com", "LinkedIn", "Social"),
    ("tiktok.com", "TikTok", "Social"), ("demdex.net", "Adobe", "Fingerprinting"), ("omtrdc.net", "Adobe", "Fingerprinting"),
    ("krxd.net", "Salesforce/Krux", "Fingerprinting"), ("bluekai.com", "Oracle", "Fingerprinting"), ("exelator.com", "Nielsen", "Fingerprinting"),
    ("quantserve.com", "Quantcast", "Fingerprinting"),
]
#: Stands in for a secret in queries whose results are compared. A release takes a secret of its own.
TEST_SECRET = "not-a-secret"
EPSILONS = [0.1, 0.5, 1.0, 2.0, 5.0, 10.0]


def values(rows: list[tuple], names: str) -> str:
    """A VALUES table that Spark and DuckDB both read."""
    q = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    body = ", ".join("(" + ", ".join(map(q, r)) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({names})"


def vocabulary_rows() -> list[tuple]:
    order = {"reject": 0, "accept": 1, "settings": 2, "dismiss": 3}
    return [(a, k, order[a], w) for a, k, words in VOCABULARY for w in words]
