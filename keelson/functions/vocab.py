"""Word lists, enums, tables and formats the results depend on."""

# Whitespace stripped from both ends of a text (ASCII and Unicode spaces).
WHITESPACE = " \t\n\r\x0b\x0c\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
# The same set as a regular-expression class.
WS = "[\\t-\\r \u00a0\u1680\u2000-\u200a\u2028-\u2029\u202f\u205f\u3000\ufeff]"

# --- mail providers (fixed lists, one per rule set) ---
FREE_MAIL_FULL = (
    "gmail.com", "googlemail.com", "hotmail.com", "outlook.com", "live.com", "icloud.com",
    "me.com", "yahoo.com", "yahoo.fr", "proton.me", "protonmail.com", "aol.com", "gmx.com",
    "gmx.fr", "orange.fr", "wanadoo.fr", "free.fr", "laposte.net",
)
FREE_MAIL_SHORT = (
    "aol.com", "gmail.com", "googlemail.com", "hotmail.com", "icloud.com", "live.com",
    "mail.com", "outlook.com", "proton.me", "protonmail.com", "yahoo.com",
)

# --- evidence scoring terms (fixed lists) ---
SECTOR_TERMS = (
    "yacht", "yachting", "superyacht", "charter", "marina", "maritime", "naval", "vessel",
)
EXECUTIVE_TERMS = (
    "chief executive", "ceo", "founder", "owner", "chairman", "managing director",
    "entrepreneur", "investor", "family office", "dirigeant", "fondateur", "investisseur",
)
OFF_TOPIC_TERMS = (
    "drummer", "musician", "percussion", "cymbal", "discography", "album", "chess", "gameknot",
)
TRUSTED_TYPES = ("official_registry", "company_website", "linkedin")
EVIDENCE_WEIGHTS = {
    "email": 55, "exact_name": 35, "all_tokens": 22, "company": 15, "own_domain": 25,
    "country": 4, "city": 4, "sector": 8, "executive": 4, "off_topic": -20, "trusted": 5,
}
SIGNALS = {
    "email": "email exact",
    "exact_name": "nom exact",
    "all_tokens": "nom complet",
    "company": "entreprise",
    "own_domain": "domaine email professionnel",
    "country": "pays",
    "city": "ville",
    "sector": "proximité yachting",
    "executive": "profil économique documenté",
}
RELEVANCE_THRESHOLD = 20

# --- search-hit ranking terms (fixed lists) ---
HIT_SECTOR = ("yacht", "yachting", "maritime", "charter", "vessel")
HIT_BUSINESS = (
    "logistics", "logistica", "trasporti", "transport", "fleet", "chairman", "board member",
    "managing director", " srl", " ltd",
)
HIT_ROLE = (
    "ceo", "founder", "director", "owner", "president", "board member", "company", "entrepreneur",
)
HIT_MUSIC = ("drummer", "musician", "discography", "album", "music", "percussion")
HIT_MEDIA_HOSTS = ("youtube.", "youtu.be", "spotify.", "facebook.", "instagram.", "tiktok.")
HIT_FILE_SUFFIXES = (".jpg", ".jpeg", ".png", ".gif", ".svg", ".webp", ".pdf")
HIT_ENGINE_HOST = "search.brave.com"
HIT_ENGINE_DOMAIN = ".brave.com"

# --- line extraction (fixed lists) ---
ROLE_LINE_TERMS = (
    "ceo", "chief executive", "founder", "owner", "chairman", "president", "director",
    "entrepreneur", "investor", "amministratore", "fondatore", "presidente", "dirigeant",
    "fondateur", "gérant", "gerant", "yacht", "broker",
)
HEADLINE_SKIP = ("cookie", "javascript")
STATEMENT_SKIP = ("cookie", "javascript", "your cart", "we noticed that you are using")
FIELD_PREFIXES = {
    "metier": "Métier:",
    "entreprise": "Entreprise:",
    "missions": "Missions:",
    "location": "Location:",
    "about": "About:",
    "company_url": "EntrepriseUrl:",
}

# --- profile selection (fixed lists) ---
SENIORITY_TIERS = (
    (3, ("chief executive", "ceo", "founder", "owner", "chairman", "president", "presidente",
         "amministratore unico", "fondateur", "fondatore")),
    (2, ("managing director", "general manager", "director", "administrateur", "amministratore",
         "dirigeant", "gérant", "gerant", "vice president", "vice-president", "partner",
         "entrepreneur", "investor", "investisseur")),
    (1, ("head of", "senior", "responsable", "manager")),
)
SECTOR_BONUS = 2

# --- source types, full rule set (fixed markers, tested in this order) ---
PROFILE_DOMAIN = "linkedin.com"
MARITIME_HOSTS = ("marinetraffic", "vesselfinder", "equasis", "fleetmon")
PEP_HOSTS = ("opensanctions.org", "everypolitician.org")
SANCTION_HOSTS = (
    "ofac.treasury.gov", "sanctionssearch.ofac.treas.gov", "un.org", "europa.eu", "gov.uk",
)
REGISTRY_HOSTS = ("companieshouse.gov.uk", "societe.com", "infogreffe", "opencorporates")
COURT_HOSTS = ("court", "justice", "tribunal")
NEWS_HOSTS = ("reuters", "bloomberg", "ft.com", "forbes", "apnews", "bbc.")
OFFSHORE_HOST = "offshoreleaks.icij.org"
REDIRECTOR_DOMAIN = "duckduckgo.com"
REDIRECTOR_PARAM = "uddg"

SOURCE_TYPES = (
    "official_registry", "company_website", "linkedin", "sanctions_db", "pep_db", "news",
    "court_record", "maritime_db", "other",
)

# --- enums of the report (fixed values; the last item of each pair is the fallback) ---
SCREENING_STATES = ("clear", "possible_homonym", "hit", "not_enough_data")
REPORT_ENUMS = {
    ("identity_resolution", "status"): (
        ("confirmed", "probable", "ambiguous", "unresolved"), "unresolved"),
    ("risk_screening", "sanctions", "status"): (SCREENING_STATES, "not_enough_data"),
    ("risk_screening", "pep", "status"): (SCREENING_STATES, "not_enough_data"),
    ("risk_screening", "watchlists", "status"): (SCREENING_STATES, "not_enough_data"),
    ("risk_screening", "offshore_leaks", "status"): (SCREENING_STATES, "not_enough_data"),
    ("maritime_screening", "status"): (
        ("none_found", "possible_link", "confirmed_link", "non_determinable"), "non_determinable"),
    ("economic_coherence", "level"): (
        ("low", "medium", "high", "undetermined"), "undetermined"),
    ("kyc_assessment", "overall_risk"): (
        ("low", "medium", "high", "undetermined"), "undetermined"),
    ("kyc_assessment", "recommended_review"): (
        ("standard", "enhanced_due_diligence", "manual_review", "insufficient_data"),
        "insufficient_data"),
}
ADVERSE_CATEGORIES = ("fiscal", "civil", "commercial", "regulatory", "criminal", "reputational")
ADVERSE_STATUS = (
    "allegation", "complaint", "lawsuit", "proceeding", "judgment", "conviction",
    "administrative_action", "media_report",
)
CONFIDENCE_LEVELS = ("high", "medium", "low")

# --- adverse-media provider values (fixed map) ---
ADVERSE_CATEGORY_MAP = {
    "financial_crime": "criminal", "fraud": "criminal", "money_laundering": "criminal",
    "corruption": "criminal", "bribery": "criminal", "terrorism": "criminal",
    "organized_crime": "criminal", "sanctions": "regulatory",
    "regulatory_enforcement": "regulatory", "regulatory": "regulatory", "litigation": "civil",
    "tax": "fiscal", "fiscal": "fiscal", "environmental": "reputational",
    "reputational": "reputational", "other": "reputational",
}
NON_ADVERSE_ROLES = ("victim", "plaintiff", "complainant", "witness", "bystander", "unrelated")

# --- report sentences (fixed texts) ---
TEXT = {
    "no_relevant": "Aucune source publique attribuable avec suffisamment de confiance.",
    "no_grounded": "No model claim matched a crawled source URL.",
    "no_input": "Required identity inputs are missing.",
    "confirmed": "Email exact et nom reliés à au moins une source publique collectée.",
    "probable": "Nom relié à plusieurs sources professionnelles convergentes.",
    "ambiguous": "Nom trouvé, mais les attributs disponibles ne suffisent pas à exclure un homonyme.",
    "unresolved": "Domaine professionnel trouvé, sans rattachement public robuste à la personne.",
    "priority_head": " Candidat priorisé pour revue selon ",
    "priority_tail": "; ces indices ne confirment pas seuls l’identité.",
    "match_detail": "Correspondance textuelle à vérifier manuellement: ",
    "economic": "Présence professionnelle publique cohérente; ne constitue pas une preuve de source des fonds.",
    "sources_tail": " source(s) publique(s) attribuables collectée(s).",
    "screening_match": "Correspondance sanctions/PEP textuelle uniquement; homonyme possible à vérifier.",
    "screening_none": "Contrôles sanctions/PEP non conclusifs sans registre officiel exhaustif intégré.",
    "note_head": "Indices d’attribution : ",
    "client": "Client potentiel : ",
    "line_confirmed": ". Identité reliée à une source publique par l’email fourni.",
    "line_probable": ". Profil professionnel probable, confirmé par plusieurs indices publics convergents.",
    "line_ambiguous": ". L’attribution du profil public à la bonne personne reste ambiguë et non confirmée.",
    "line_unresolved": ". Identité publique non résolue avec les données disponibles.",
    "no_fields": "Métier, entreprise et localisation non établis par une source publique suffisamment attribuable.",
    "rel_sector": "Lien yachting ou maritime repéré dans les sources, mais attribution à confirmer avant qualification commerciale.",
    "rel_economic": "Activité dirigeante ou entrepreneuriale repérée. Aucun lien yachting confirmé.",
    "rel_none": "Aucun lien yachting ni indicateur public robuste de capacité économique établi à ce stade.",
    "sum_hit": "Correspondance sanctions ou PEP détectée ; contrôle renforcé obligatoire.",
    "sum_homonym": "Homonyme sanctions ou PEP possible, non confirmé ; contrôle renforcé recommandé.",
}

# --- labels of the summary's sentences, and ends of the search strings (fixed texts) ---
LABELS = {
    "metier": "Métier", "statement": "Activité indiquée", "company": "Entreprise",
    "mission": "Rôle et missions majeures : ", "place": "Localisation",
}
SEARCH_ENDS = {
    "profile": " site:linkedin.com/in", "executive": " CEO founder director entrepreneur company",
    "sector": " yacht yachting charter maritime",
}

# --- short report sentences (fixed texts) ---
SHORT_TEXT = {
    "no_input": "Nom complet ou email manquant.",
    "email": "Adresse email exacte présente dans un résultat public.",
    "name": "Nom complet exact présent dans les résultats collectés.",
    "own_domain": "Source concordante trouvée sur le domaine professionnel de l’email.",
    "rationale": "Attribution textuelle uniquement; confirmation humaine requise avant décision KYC.",
    "collected": " source(s) publique(s) collectée(s).",
    "screening": "Contrôles sanctions/PEP non conclusifs sans registre officiel intégré.",
    "none": "Aucune source publique suffisamment robuste trouvée.",
}
SHORT_NOTE = 500

# --- leads ---
LEAD_STATUSES = ("NEW", "CONTACTED", "QUALIFIED", "CONVERTED", "LOST")
ATTEMPT_STATUSES = ("pending", "running", "completed", "insufficient_data", "failed", "cancelled")
ACTIVE_STATUSES = ("pending", "running")
TEST_ID_PREFIX = "TEST-"
TEST_EMAIL = "test@example.com"
TEST_NAME = "Test Client"
UNKNOWN_CONTACT = "Unknown Contact"
NOT_AVAILABLE = "N/A"
METRES_TO_FEET = 3.28084
UUID_PATTERN = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
SECRET_PATTERN = r"(?i)\b(api[_ -]?key|authorization|token|secret)\b\s*[:=]\s*(?:bearer\s+)?\S+"
STALE_ERROR = "STALE_WORKER_RECOVERY"
STALE_MESSAGE = "Worker stopped before completing the KYC job."

# lengths of a ranked hit's title and content; window, title and snippet of a result body's hit
HIT_TITLE, HIT_CONTENT = 300, 800
BODY_WINDOW, BODY_TITLE, BODY_SNIPPET = 2500, 240, 500
