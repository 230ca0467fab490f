"""Word lists, host lists, limits and patterns whose exact content decides the results.

Patterns are Java regular expressions. `(?iuU)` makes case folding, \\w, \\s and \\b follow Unicode."""

# --- fixed values: states and limits --------------------------------------------------------
STATES = ["available", "not_available", "blocked", "not_applicable", "ambiguous", "failed"]
NAME_THRESHOLD = 90
SHORT_NAME_CHARS = 12
SPAN_NAME_THRESHOLD = 80
BRAND_THRESHOLD = 60
WORD_COVERAGE = 0.6
MAX_OWN_ORGANISATIONS = 4
MAX_CLAIM_CHARS = 500
TOP_K = {
    "role_ads": 15, "careers_claims": 2, "careers_links": 2, "info_links": 2, "news_links": 2, "news_items": 10,
    "feed_entries": 5, "social_links": 8, "ads_per_entity": 5, "name_matches": 12, "update_events": 3,
    "former_names": 3, "sitemap_urls": 6, "signals": 6, "ats_pages": 3, "feeds_per_site": 1,
    "name_guesses": 4, "site_candidates": 3, "filings_with_figures": 2,
}
BREAKER_FAILURES = 3
CHUNK_SIZE = 100
BUDGET = {"requests": 2000, "spend_usd": 10.0, "seconds": 2700, "degrade_at": 0.9}
FEED_WINDOW_DAYS = 30
FEED_PAGE_CAP = 80

# --- fixed values: URLs -------------------------------------------------------------------
TRACKING_PARAMS = ["gclid", "fbclid", "msclkid", "mc_cid", "mc_eid", "ref", "ref_src"]
PAGE_TRACKING_PARAM = r"(?i)^(utm_\w+|gclid|fbclid|mc_\w+|ref|source|src|trk|link_source\w*)$"
LANGUAGE_SEGMENT = r"(?i)^[a-z]{2}([-_][a-z]{2})?$"
LANGUAGE_NAMES = ["no", "nb", "nn", "en", "se", "sv", "da", "dk", "de", "fi", "nor", "eng", "norsk", "english"]
NON_PAGE_EXTENSIONS = [
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".jpg", ".jpeg", ".png", ".gif", ".svg", ".zip",
    ".mp4", ".mp3",
]
DIRECTORY_SEGMENTS = [
    "company", "companies", "bedrift", "bedrifter", "selskap", "selskaper", "firma", "foretak", "virksomhet", "enhet",
    "enheter", "mester", "mestere", "owner", "profile", "directory", "search", "sok", "katalog",
]
HOME_TLDS = ["no", "as", "io", "ai", "co", "me", "tv", "cc", "eu", "nu", "to", "gg"]
INTERNAL_SUFFIXES = [".local", ".localhost", ".internal", ".lan", ".home.arpa", ".intranet", ".corp"]
# Address blocks that are not globally reachable (IANA special-purpose registry).
PRIVATE_IPV4 = [
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24",
    "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4",
]
AGGREGATOR_HOSTS = [
    "spotify.com", "soundcloud.com", "instagram.com", "youtube.com", "youtu.be", "tiktok.com", "twitter.com", "x.com",
    "forvalt.no", "areg.no", "listings.no", "lei.report", "datalog.co.uk", "smartmeny.no", "nordlei.org", "norgelei.no",
    "restaurantmeny.no", "mintmedias.no", "founditapp.org", "proff.no", "purehelp.no", "gulesider.no", "180.no",
    "facebook.com", "linkedin.com", "wikipedia.org", "rosa.no", "regnskapstall.no", "regnskapsbasen.no",
    "firmadatabasen.no", "opencompanydatabase.com", "biztrac.no", "io.no", "21st.ai", "virksomhet.brreg.no",
    "sgregister.dibk.no", "generate.no", "1881.no", "prospeo.io", "northdata.com", "merinfo.no", "byndle.no",
    "nyeselskaper.no", "allebedrifter.no", "1850.no", "flowfirma.no", "haandverkerportalen.no", "mittanbud.no",
    "eiendomssjekk.no", "fagfolkguiden.no", "firmview.no", "vexter.no", "agama.no", "elinnweb.no", "elinn.no",
    "thehub.io", "stipendportalen.no", "finanstilsynet.no", "arbeidsplassen.nav.no",
]
ATS_HOSTS = [
    "greenhouse.io", "lever.co", "workable.com", "teamtailor.com", "myworkdayjobs.com", "recman.no", "jobylon.com",
    "webcruiter.no", "webcruiter.com", "easycruit.com", "hr-manager.net", "hrmanager.no", "varbi.com", "emply.com",
    "emply.net", "homerun.co", "personio.de", "personio.com", "bamboohr.com", "smartrecruiters.com", "ashbyhq.com",
    "recruitee.com", "breezy.hr",
]
PRESS_RELEASE_HOSTS = [
    "eurolandir.com", "newsweb.oslobors.no", "newsweb.no", "globenewswire.com", "cision.com", "news.cision.com",
    "mynewsdesk.com", "prnewswire.com", "businesswire.com", "ntbinfo.no", "kommunikasjon.ntb.no", "notified.com",
]
SOCIAL_HOSTS = ["linkedin.com", "facebook.com", "instagram.com", "twitter.com", "x.com", "youtube.com", "tiktok.com"]
MANAGER_HOSTS = ["obos.no", "usbl.no", "vibbo.no", "vbbl.no"]
AUDITED_MANAGER_HOSTS = ["obos.no", "usbl.no", "vibbo.no", "vbbl.no", "nobl.no"]
MAILBOX_HOSTS = [
    "gmail.com", "googlemail.com", "hotmail.com", "hotmail.no", "outlook.com", "outlook.no", "live.com", "live.no",
    "icloud.com", "me.com", "mac.com", "yahoo.com", "yahoo.no", "online.no", "frisurf.no", "broadpark.no",
    "getmail.no", "start.no", "c2i.net", "lyse.net", "tele2.no", "telenor.com", "telenor.no", "msn.com",
    "protonmail.com", "proton.me", "bbhosted.com", "altibox.no", "webmail.no", "chello.no", "combitel.no",
    "kolumbus.no", "sensewave.com", "bredband.no", "hotmail.co.uk", "mail.com", "aol.com", "powertech.no",
    "hotmail.se", "hotmail.dk", "yahoo.se", "gmx.com", "gmx.net", "mail.ru", "yandex.com", "no.pwc.com",
]
MAIL_SUBDOMAINS = ["mail", "post", "smtp", "epost", "mx"]

# --- fixed values: names ------------------------------------------------------------------
REGISTER_FORMS = ["AS", "ASA", "ANS", "DA", "SA", "KS", "NUF", "ENK", "BA", "SF", "IKS"]
EMPLOYER_FORMS = ["AS", "ASA", "ANS", "DA", "SA", "ENK", "NUF", "BA", "KS", "IKS", "STIFTELSE"]
EMPLOYER_COMMON = [
    "NORGE", "NORWAY", "HOLDING", "GRUPPEN", "GROUP", "EIENDOM", "INVEST", "SERVICE", "DRIFT", "KOMMUNE", "THE", "OG",
]
SITE_FORMS = ["as", "asa", "ans", "da", "sa", "ks", "nuf", "enk", "ba", "sf", "iks", "stiftelse", "a/s"]
SITE_COMMON = ["norge", "norway", "holding", "invest", "eiendom", "group", "gruppen", "and", "og", "the"]
ACCOUNT_FORMS = ["as", "asa", "ans", "da", "sa", "enk", "nuf", "ba", "ks", "iks"]
ACCOUNT_COMMON = [
    "holding", "gruppen", "group", "norge", "norway", "invest", "eiendom", "service", "services", "partner", "partners",
    "company", "limited", "scandinavia", "nordic", "international", "solutions", "systems",
]
GROUP_OWNER_FORMS = ["as", "asa", "sa", "ans", "da", "ba", "enk", "nuf", "norge", "norway"]
SISTER_WORDS = [
    "eiendom", "property", "properties", "bostad", "holding", "invest", "capital", "subsea", "offshore", "shipping",
    "maritime", "entreprenor", "utvikling", "forvaltning",
]
COOP_WORDS = [
    "sameiet", "sameie", "boligsameie", "boligsameiet", "borettslag", "brl", "andelslag", "eierseksjonssameie", "as", "sa",
]
COOP_TERMS = ["borettslag", "boligsameie", "sameiet", "brl"]
COOP_MAIL_TERMS = ["borettslag", "boligsameie", "sameie", "brl", "bolig"]
AUDITED_COOP_TERMS = ["borettslag", "boligsameie", "sameiet", " bbl"]
FORM_WORDS = ["as", "asa", "sa", "ans", "da", "ba", "enk", "nuf", "norge", "norway", "norsk"]
STRICT_FORM_WORDS = ["as", "asa", "sa", "ans", "da", "ba", "enk", "nuf"]
FOREIGN_FORM_WORDS = ["ab", "a", "s", "aps", "bv", "b", "v", "gmbh", "ltd", "oy", "ks", "iks", "sf", "inc", "llc", "ag", "sa"]
GROUP_WORDS = ["group", "gruppen", "konsern", "konsernet", "holding"]
COVERAGE_COMMON = [
    "og", "and", "co", "holding", "invest", "investering", "eiendom", "eiendomsutvikling", "eiendomsdrift", "bygg",
    "entreprenør", "entreprenor", "service", "tjenester", "consult", "consulting", "konsulent", "advokat",
    "advokatfirma", "advokatfirmaet", "regnskap", "group", "gruppen", "norge", "norway", "drift", "utleie",
    "forvaltning", "bil", "maskin", "maskinservice", "transport",
]
HOLDING_WORDS = [
    "invest", "investering", "investment", "investments", "holding", "holdings", "eiendom", "eiendommer",
    "eiendomsselskap", "property", "properties", "kapital", "capital", "finans", "forvaltning", "management",
]
FOREIGN_FORM = r"(?iuU)(?:^|[\W_])(?:ltd|limited|gmbh|ab|oy|oyj|aps|a[-_.]s|inc|llc|bv|plc|srl|sarl|spa|ag|corp|pty)(?:$|[\W_])"
GROUP_IN_ACCOUNT = r"(?iu)gruppen|group|konsern|holding"
ID_ACCOUNT = r"(?U)^(?:uc[\w-]{15,}|\d+|profilephpid\d+)$"
ACCOUNT_TAIL = r"(?:as|asa|no|norge|norway)$"
LEGAL_FORM_TAIL = r"(?iuU)\s+(as|asa|ans|da|sa|ks|nuf|enk|ba|sf|iks)$"
ORG_WEIGHTS = [3, 2, 7, 6, 5, 4, 3, 2]

# --- fixed values: social platforms -------------------------------------------------------
PLATFORM_RESERVED = {
    "facebook.com": [
        "sharer", "sharer.php", "share", "share.php", "dialog", "plugins", "tr", "events", "groups", "watch", "hashtag",
        "photo", "photos", "photo.php", "permalink.php", "story.php", "login", "login.php", "policies", "help", "home",
        "marketplace", "gaming", "stories", "reel", "reels", "video", "videos", "public", "l.php", "flx", "ads",
        "privacy", "terms", "cookies", "legal", "settings", "business", "about", "recover", "checkpoint", "r.php",
    ],
    "instagram.com": ["p", "reel", "reels", "explore", "stories", "tv", "accounts", "direct", "about", "legal", "web"],
    "twitter.com": [
        "intent", "share", "home", "search", "hashtag", "i", "explore", "login", "settings", "privacy", "tos", "widgets.js",
    ],
    "x.com": ["intent", "share", "home", "search", "hashtag", "i", "explore", "login", "settings", "privacy", "tos"],
    "tiktok.com": ["discover", "tag", "video", "explore", "foryou", "login", "legal", "about"],
}
HANDLE = r"(?U)^[\w.\-%]{2,100}$"
NESTED_ACCOUNTS = ["company", "school", "showcase", "channel", "c", "user", "pages", "p", "people"]
PLATFORM_LABELS = [
    ("linkedin.com", "LinkedIn"), ("facebook.com", "Facebook"), ("instagram.com", "Instagram"), ("x.com", "X"),
    ("twitter.com", "X"), ("youtube.com", "YouTube"), ("tiktok.com", "TikTok"),
]
SOCIAL_NOT_PROFILE = r"(?iuU)/(?:sharer|share|shareArticle|intent|dialog|plugins|widgets|embed)\b|[?&]u=|[?&]url="
SCRIPT_SOCIAL = (
    r"""(?iuU)https?:(?:\\?/){2}(?:[\w-]+\.)*(?:linkedin|facebook|instagram|twitter|x|youtube|tiktok)"""
    r"""\.com(?:\\?/)(?:[^\s"'<>)\\]|\\/)+"""
)

# --- fixed values: markup -----------------------------------------------------------------
SCRIPT_STYLE = r"(?is)<(script|style)\b[^>]*>.*?</\1>"
SCRIPT_STYLE_NOSCRIPT = r"(?is)<(script|style|noscript)[^>]*>.*?</\1>"
TAG = r"<[^>]+>"
ANCHOR = r"(?is)<a\b([^>]*)>(.*?)</a>"
HREF = r"""(?iuU)\bhref\s*=\s*["']([^"']+)["']"""
TITLE = r"(?is)<title\b[^>]*>(.*?)</title>"
H1 = r"(?is)<h1\b[^>]*>(.*?)</h1>"
HEADING_1_4 = r"(?is)<h[1-4]\b[^>]*>(.*?)</h[1-4]>"
BLOCK_START = (
    r"""(?iuU)<(?:article|li)\b|<div\b[^>]*\bclass\s*=\s*["'][^"']*\b"""
    r"""(?:news|nyhet\w*|post|article|card|teaser|entry|story|blog)\b[^"']*["']"""
)
TIME_TAG = r"""(?is)<time\b[^>]*\bdatetime\s*=\s*["']([^"']+)["']"""
NEARBY_HEADING = r"(?is)<(?:h[1-4]|a)\b[^>]*>(.*?)</(?:h[1-4]|a)>"
NEARBY_CHARS = 400
FRAMEWORK_MARKER = (
    r"""(?i)__NEXT_DATA__|id=["']__nuxt["']|id=["']root["']|id=["']app["']|ng-version|data-reactroot|"""
    r"""window\.__INITIAL_STATE__|<app-root|data-server-rendered|id=["']___gatsby["']"""
)
SHELL_CHARS = 60
PARKED_PAGE = (
    r"(?iuU)\.(?:com|no|net|org)\s+(?:is\s+)?for sale|domain (?:name )?(?:is )?for sale|domen\w* (?:er )?til salgs|"
    r"hugedomains|parkert domene|parkert hos|parked (?:at|by|free|domain)|domain parking|"
    r"hosted by one\.com|kjøp (?:dette )?domenet|buy this domain|this domain (?:may be|is) (?:for sale|available)|"
    r"sedo domain"
)
WORDPRESS = r"(?i)/wp-content/|/wp-includes/|<meta[^>]+generator[^>]+WordPress"
POST_LIST_PATH = "/wp-json/wp/v2/posts?per_page=6&_fields=date,title,link"
SITE_NAME = [
    r"""(?iuU)<meta\b[^>]*\bproperty\s*=\s*["']og:site_name["'][^>]*\bcontent\s*=\s*["']([^"']*)["']""",
    r"""(?iuU)<meta\b[^>]*\bcontent\s*=\s*["']([^"']*)["'][^>]*\bproperty\s*=\s*["']og:site_name["']""",
]
APP_NAME = (
    r"""(?iuU)<meta\b[^>]*\bname\s*=\s*["'](?:application-name|apple-mobile-web-app-title)["']"""
    r"""[^>]*\bcontent\s*=\s*["']([^"']*)["']"""
)
CANONICAL = [
    r"""(?iuU)<link\b[^>]*\brel\s*=\s*["']canonical["'][^>]*\bhref\s*=\s*["']([^"']*)["']""",
    r"""(?iuU)<link\b[^>]*\bhref\s*=\s*["']([^"']*)["'][^>]*\brel\s*=\s*["']canonical["']""",
]
DESCRIPTION = [
    r"""(?iuU)<meta\s[^>]*name\s*=\s*["']description["'][^>]*content\s*=\s*"([^"]*)\"""",
    r"""(?iuU)<meta\s[^>]*content\s*=\s*"([^"]*)"[^>]*name\s*=\s*["']description["']""",
    r"""(?iuU)<meta\s[^>]*property\s*=\s*["']og:description["'][^>]*content\s*=\s*"([^"]*)\"""",
    r"""(?iuU)<meta\s[^>]*content\s*=\s*"([^"]*)"[^>]*property\s*=\s*["']og:description["']""",
]
JUNK_DESCRIPTION = (
    r"(?iuU)cookie|informasjonskaps|javascript|just another wordpress|lorem ipsum|under (construction|utvikling)|"
    r"kommer snart|coming soon|domain (is )?for sale|domenet|parkert|page not found|side ikke funnet|"
    r"^(velkommen|welcome)( til| to)? [^.]{0,40}\.?$|^(hjem|home|forside)$|"
    r"\b(?:is|er) an? (?:\w+ ){0,2}(?:template|mal)\b|\b(?:framer|webflow|wix|squarespace|elementor) template|"
    r"\{\{|\}\}|\boption\.\w|:\w+=|=>|\bfunction\s*\("
)
DESCRIPTION_CHARS = (40, 300)
TITLE_SEPARATOR = r"(?U)\s+[|–—·:-]\s+"
PAGE_NAME = r"(?iuU)^(?:hjem|home|forside|ny\s+forside|hjemmeside|startside|velkommen|welcome)$"
OWNER_PATH = (
    r"(?iuU)^/?(?:[a-z]{2}(?:-[a-z]{2})?(?:/|$))?"
    r"(?:(?:kontakt|contact|om-?oss|om|about|about-us|firma|selskapet|company|impressum)[\w-]*/?"
    r"|(?:home|hjem|forside|startside)/?|(?:index|default)\.(?:html?|php|aspx?))?$"
)
STATED_NUMBER = (
    r"(?iuU)org(?:anisasjons)?\.?\s*-?\s*(?:nr|nummer|no)?\.?\s*:?\s*(?:NO\s*)?(\d{3})[\s. ]?(\d{3})[\s. ]?(\d{3})"
)
LABELLED_NUMBER = r"(?iuU)org(?:anisasjons)?\.?\s*nr\.?\s*:?\s*(\d[\d\s]{9,12}\d)"
SPACED_NUMBER = r"(?U)(?<!\d)(\d{3})[ . ]?(\d{3})[ . ]?(\d{3})(?!\d)"
PHONE = r"(?U)(?<!\d)(?:\+?47[ .\-]?)?((?:\d[ .\-]?){7}\d)(?!\d)"
SPAN_CHARS = 200

# --- fixed values: JSON-LD ----------------------------------------------------------------
JSON_LD = r"""(?is)<script\b[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>"""
JOB_TYPES = ["JobPosting"]
ARTICLE_TYPES = ["NewsArticle", "Article", "BlogPosting", "PressRelease"]
EVENT_TYPES = ["Event", "BusinessEvent", "EducationEvent", "ExhibitionEvent"]
NOT_ORGANISATION_TYPES = JOB_TYPES + ARTICLE_TYPES + EVENT_TYPES + [
    "WebPage", "AboutPage", "ContactPage", "CollectionPage", "FAQPage", "BreadcrumbList", "ItemList", "Product", "Person",
]

# --- fixed values: careers ----------------------------------------------------------------
CAREERS_PREFIX, JOB_AD_PREFIX, ROLE_PREFIX = "Careers page", "Job ad", "Open role"
CAREERS_LINK_TEXT = (
    r"(?iuU)^(?:(?:job\s*)?(?:careers?|karriere|jobs?|jobb|stillinger|vacancies|job\s+vacancies|open\s+positions)"
    r"|ledige\s+stillinger|ledige\s+jobber|jobb(?:e)?\s+(?:hos|i|med|for)\s+\S+(?:\s+\S+)?"
    r"|work\s+(?:with|at|for)\s+\S+(?:\s+\S+)?|join\s+(?:us|our\s+team|the\s+team)"
    r"|jobb\s*(?:&|og)\s*karriere|karriere\s*(?:&|og)\s*jobb|kom\s+og\s+jobb\s+(?:hos|for)\s+\S+)$"
)
CAREERS_HEADING = (
    r"(?iuU)careers?|karriere|\bjobs?\b|jobb|ledige\s+stillinger|stillinger|vacanc|open\s+positions|"
    r"work\s+(with|at|for)|join\s+(us|our)"
)
CAREERS_PATH = (
    r"(?i)/(careers?|karriere|jobs?|jobb|jobber|stillinger|ledige-stillinger|jobbe-hos-oss|jobb-hos-oss|vacancies|"
    r"job-vacancies)(/|$|\?)"
)
CAREERS_HOST = r"(?i)^(careers?|karriere|jobs?|jobb)\."
JOB_DETAIL = (
    r"(?iuU)/[\w-]*(stilling|position|vacanc|ledig|opening|annonse|apply)[\w-]*/[^/?#]+"
    r"|/(jobs?|jobb|jobber|careers?|karriere)/\d{4,}[^/?#]*"
    r"|[?&](jobid|job_id|adid|positionid|id)=\d+|/\d{5,}(?=[-_/?#.]|$)"
)
JOB_BOARD_AD = (
    r"(?iU)finn\.no/job/(?:[a-z]+/)?ad(?:\.html\?finnkode=|/)\d+"
    r"|arbeidsplassen\.nav\.no/stillinger/stilling/[0-9a-f-]{36}"
    r"|jobbnorge\.no/(?:ledige-stillinger/stilling|vacancies/job|en/available-jobs/job)/\d+"
)
BACK_OFFICE_PATH = r"(?i)/(dashboard|admin|login|logon|sign[_-]?in|sign[_-]?up|auth|account|settings|embed)(/|$|\?)"
NOT_A_ROLE_PATH = (
    r"(?i)/(people|employees|ansatte|team|departments|avdelinger|locations|lokasjoner|blog|posts|news|nyheter|stories|"
    r"events)(/|$)"
)
NO_OPENINGS = (
    r"(?iuU)ingen\s+(ledige|åpne)\s+(stillinger|jobber)|ingen\s+ledige|har\s+ingen\s+\w*\s*stillinger|"
    r"(?:no|don'?t\s+have|do\s+not\s+have|have\s+no|currently\s+no)\s+(?:any\s+)?(?:open|current|available)?\s*"
    r"(?:positions|vacancies|openings|jobs)|no\s+vacancies|there\s+are\s+no\s+(?:open\s+)?(?:positions|vacancies|openings)|"
    r"not\s+(?:currently\s+)?(?:hiring|recruiting)"
)
NAV_LINK_TEXT = (
    r"(?iuU)^(se\s+alle|vis\s+alle|view\s+all|see\s+(all|available|open|our)|all\s+(jobs|positions)|read\s+more|les\s+mer|"
    r"apply(\s+now)?|søk(\s+nå)?|søk\s+her|send\s+(inn\s+)?søknad|open\s+application|åpen\s+søknad|more|mer|next|neste|"
    r"previous|forrige|back|tilbake|home|hjem|careers?|karriere|jobs?|jobb|stillinger|ledige\s+stillinger|"
    r"contact|kontakt|about|om\s+oss|login|logg\s+inn)\b"
)
BOILERPLATE_TEXT = (
    r"(?iu)vilkår|personvern|privacy|cookie|terms|informasjonskapsl|tilgjengelighet|accessibility|"
    r"sitemap|nettkart|kontakt|contact|facebook|linkedin|instagram|youtube|twitter"
)
GENERIC_LINK_TEXT = (
    r"(?iuU)^(les\s+mer|read\s+more|se\s+(stilling(en)?|annonsen?|mer)|mer\s+info(rmasjon)?|more\s+info|søk(\s+her|\s+nå)?|"
    r"apply(\s+(now|here))?|vis\s+stilling|til\s+annonsen|les\s+om(\s+stillingen)?)\b|finn\.no$"
)
AD_SECTION = (
    r"(?iuU)^(vi\s+(kan\s+)?tilbyr?|vi\s+søker|arbeidsoppgaver|ansvar(sområder)?|kvalifikasjoner|ønskede\s+kvalifikasjoner|"
    r"personlige\s+egenskaper|om\s+(oss|stillingen|selskapet)|hvem\s+er\s+vi|søknad(sfrist)?|kontakt(person)?|"
    r"we\s+offer|responsibilities|qualifications|about\s+(us|the\s+role)|how\s+to\s+apply|om\s+arbeidsgiver(en)?|"
    r"(send\s+(en\s+|inn\s+)?)?åpen\s+søknad|open\s+application|vil\s+du\s+vite\s+mer|søk(e)?\s+på\s+stillingen)\b|:$"
)
HEADING_INSIDE = r"(?is)<(h[1-6]|strong|b)\b[^>]*>(.*?)</\1>"
HEADING_BEFORE = r"(?is)<(h[1-6])\b[^>]*>(.*?)</\1>"
CARD_SPLIT = r"(?i)<(?:br|/?p|/?div|/?span|/?h[1-6]|/?li)\b[^>]*>"
LOOKBACK_CHARS = 1500
ERROR_PAGE = r"(?iuU)\b404\b|not\s+found|finner\s+ikke|finnes\s+ikke|page\s+(?:does\s+not|doesn.t)\s+exist|ikke\s+funnet"
ROLE_TITLE_CHARS = (4, 110)
MIN_ROLE_LINKS = 2
INFO_TEXT = (
    r"(?iuU)^(?:kontakt(?:\s+oss)?|contact(?:\s+us)?|om\s+oss|about(?:\s+us)?|om\s+\S+(?:\s+\S+)?|about\s+\S+(?:\s+\S+)?|"
    r"selskapet|the\s+company)$"
)
INFO_PATH = r"(?i)/(kontakt(?:-oss)?|contact(?:-us)?|om-oss|about(?:-us)?|selskapet)(?:/|$)"
OPEN_APPLICATION = (
    r"(?iuU)(?:\b|/)(?:[åa]pen|generell|spontan)[\s_-]+s(?:ø|o|oe)knad|open[\s_-]+application|unsolicited|"
    r"spontaneous[\s_-]+application"
)
GENERIC_HIRING = ["careers", "career", "jobs", "job openings", "ledige stillinger"]

# --- fixed values: news -------------------------------------------------------------------
MONTH_NAMES = (
    "september|february|november|december|desember|januar|january|februar|october|oktober|august|april|march|mars|"
    "juni|june|juli|july|sept|jan|feb|mar|apr|mai|may|jun|jul|aug|sep|okt|oct|nov|des|dec"
)
MONTH_BY_PREFIX = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "mai": 5, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "okt": 10,
    "oct": 10, "nov": 11, "des": 12, "dec": 12,
}
FIRST_YEAR = 2000
DAYS_AHEAD = 30
NEWS_TITLE_CHARS = (8, 200)
NEWS_LINK_TEXT = (
    r"(?iuU)^(?:news|nyheter|aktuelt|siste\s+nytt|nytt|presse|press|pressemeldinger|press\s+releases?|newsroom|media|"
    r"blogg?|nyhetsarkiv|nyhetsrom|aktuelle\s+saker|artikler|insights|innsikt|fagartikler)$"
)
NEWS_PATH = r"(?i)/(?:news|nyheter|aktuelt|presse|pressemeldinger|newsroom|blogg?|nyhetsarkiv|artikler|insights)(?:/|$)"
SECTION_LABEL = (
    r"(?iuU)^(press\s*room|presserom|press\s+releases?|pressemeldinger?|news(room)?|nyheter|aktuelt|blogg?|"
    r"share\s+and\s+analyst\s+information|investor\s+relations|read\s+more|les\s+mer|se\s+alle|view\s+all|all\s+news|"
    r"latest\s+news|siste\s+nytt|financial\s+(calendar|reports?)|reports?|downloads?|events?|arrangementer)$"
)
NAV_TITLE = (
    r"(?iuU)^(?:hjem|home|forside|kontakt(?:\s+oss)?|contact(?:\s+us)?|om(?:\s+\S+){1,3}|about(?:\s+\S+){0,3}|personvern\w*|"
    r"privacy(?:\s+policy)?|cookies?(?:\s*-?\s*(?:policy|erklæring|innstillinger))?|vilkår\w*|salgsbetingelser|"
    r"terms(?:\s+\w+)*|faq|logg\s+inn|login|log\s+in|min\s+side|my\s+page|meld\s+skade|ledige\s+stillinger|karriere|"
    r"careers?|jobs?|jobb(?:\s+hos\s+oss)?|priser|prices|produkter|products|tjenester|services|butikk(?:er)?|nettbutikk|"
    r"shop|handlekurv|cart|søk|search)$"
)
NOT_A_POST_PATH = (
    r"(?iuU)/(?:kontakt|contact|personvern|privacy|cookie|vilkar|terms|career)[\w-]*(?:/|$|\.|\?)"
    r"|/(?:om-oss|about|about-us|karriere|jobb|jobs?|jobb-hos-oss|ledige-stillinger|stillinger|login|logg-inn|"
    r"min-side|my-page|produkt|produkter|products?|collections?|shop|nettbutikk|butikk|handlekurv|cart|checkout|"
    r"kategori|category|categories|tag|tags|search|sok|page|"
    r"prosjekt|prosjekter|projects?|referanser|referanse|references?|cases?|portfolio)(?:/|$|\.|\?)"
)
PLACEHOLDER_TITLE = (
    r"(?iuU)^\s*(?:hello\s+world|hei,?\s+verden|hallo,?\s+verden|welcome\s+to\s+(?:flatsome|wordpress|your\s+(?:site|blog))|"
    r"a\s+simple\s+blog\s+post|just\s+another\s+post|sample\s+(?:post|page)|eksempelside|blog\s+post\s+title|"
    r"slider?\s+(?:one|two|three|four|\d)|post\s+(?:one|two|three|\d))\b"
)
LEADING_DATE = r"(?U)^\s*(?:\d{4}-\d{2}-\d{2}|\d{1,2}\.\s?\d{1,2}\.\s?\d{2,4})\s*[-:|]?\s*"
SPAM_HEADLINE = (
    r"(?iuU)[^\W_]+_[^\W_]+|\b(?:porn\w*|xxx|casino\w*|viagra|cialis|escorts?|hentai|onlyfans|camgirls?)\b"
)
NOT_A_POST_LINK = (
    r"(?iuU)/(?:tjenester|tjeneste|services?|produkter|produkt|products?|feedback|thank-?you|takk|"
    r"referansar|referanser|referanse|author|forfatter)(?:/|$|\?)"
    r"|[?&]author=|/blogg?(?:-\d+)?/?$|/post-(?:one|two|three|four|five|six|\d+)/?$"
)
LOREM_WORDS = [
    "lorem", "ipsum", "dolor", "amet", "consectetur", "adipiscing", "elit", "commodo", "nulla", "facilisi", "vehicula",
    "tristique", "magna", "purus", "gravida", "ultricies", "hendrerit", "viverra", "justo", "sapien", "urna", "neque",
    "massa", "quis", "blandit", "aliquam", "tempor", "pellentesque", "vestibulum",
]
CAR_AD = (
    r"(?iuU)^(?:audi|bmw|citro[eë]n|cupra|dacia|fiat|ford|honda|hyundai|jaguar|jeep|kia|land\s+rover|lexus|mazda|"
    r"mercedes(?:-benz)?|mg|mini|mitsubishi|nissan|opel|peugeot|polestar|porsche|renault|seat|skoda|subaru|"
    r"suzuki|tesla|toyota|volkswagen|vw|volvo|byd)\b(?=.*\d)"
)
NOT_A_HEADLINE = (
    r"(?iuU)^(?:protected|private|beskyttet|privat)\s*:|^(?:relaterte|related|siste|latest|flere|more)\s+"
    r"(?:artikler|articles|nyheter|news|innlegg|posts)$|^(?:blogg?|nyheter|news|aktuelt|artikler|articles)\s+[-–|]\s+"
)
COMPANY_NAME_ONLY = r"(?iuU)^[^\s()]+(?:\s+[^\s()]+){0,5}\s+(?:as|asa|sa|ans|da|ab|a/s|aps|gmbh|ltd|llc|inc)\.?$"
HEADLINE_FORM_TAIL = r"(?iuU)\s+(?:as|asa|ans|da|sa|ks|nuf|enk|ba|sf|iks)$"
FEED_ITEM = r"(?is)<(?:item|entry)\b[^>]*>(.*?)</(?:item|entry)>"
FEED_LINK = r"""(?is)<link\b[^>]*?\bhref\s*=\s*["']([^"']+)["'][^>]*>|<link\b[^>]*>\s*([^<\s][^<]*?)\s*</link>"""
FEED_DATE = r"(?is)<(?:pubDate|published|updated|dc:date)\b[^>]*>(.*?)</(?:pubDate|published|updated|dc:date)>"
FEED_DECLARATION = r"""(?iuU)<link\b[^>]*\btype\s*=\s*["']application/(?:rss|atom)\+xml["'][^>]*>"""
PRODUCT_FEED_PATH = r"(?i)/(?:collections?|products?|produkt|produkter|shop|butikk)(?:/|$)"
FREE_LINE_CHARS = 300

# --- fixed values: frontier ---------------------------------------------------------------
SITEMAP_WORDS = [
    "about", "om-oss", "contact", "kontakt", "team", "leadership", "ledelse", "location", "career", "jobs", "job",
    "news", "press", "investor", "aktuelt", "nyheter", "karriere", "jobb", "ledige", "stilling", "rekruttering",
]
CAREERS_SITEMAP_WORDS = ["career", "karriere", "jobs", "jobb", "ledig", "stilling", "vacanc"]
NEWS_SITEMAP_WORDS = ["news", "nyheter", "aktuelt", "press", "blog", "artikler"]

# --- fixed values: registry and summary wording -------------------------------------------
METRICS = [
    ("revenue", "$.resultatregnskapResultat.driftsresultat.driftsinntekter.sumDriftsinntekter"),
    ("operating_result", "$.resultatregnskapResultat.driftsresultat.driftsresultat"),
    ("profit_before_tax", "$.resultatregnskapResultat.ordinaertResultatFoerSkattekostnad"),
    ("annual_result", "$.resultatregnskapResultat.aarsresultat"),
    ("total_assets", "$.eiendeler.sumEiendeler"),
    ("total_equity", "$.egenkapitalGjeld.egenkapital.sumEgenkapital"),
    ("total_debt", "$.egenkapitalGjeld.gjeldOversikt.sumGjeld"),
]
CLAIM_FIELDS = [
    "legal_name", "public_brand", "annual_accounts_latest", "official_website", "industry", "employee_count",
    "legal_form", "operating_status", "founded_date", "business_description", "site_description",
    "annual_accounts_history", "revenue", "operating_result", "profit_before_tax", "annual_result", "total_assets",
    "total_equity", "total_debt", "annual_report_pdf", "leader", "workplace", "company_profile", "hiring_signal",
    "dated_activity",
]
ENTITY_URL = "https://data.brreg.no/enhetsregisteret/api/enheter/"
REPORT_COPY_URL = "https://data.brreg.no/regnskapsregisteret/regnskap/aarsregnskap/kopi/"
PUBLIC_AD_URL = "https://arbeidsplassen.nav.no/stillinger/stilling/"
REGISTER_NAME = "Brønnøysundregistrene"
LEGAL_FORM_TEXT = {
    "AS": "limited company (AS)", "ASA": "public limited company (ASA)", "ENK": "sole proprietorship (ENK)",
    "NUF": "Norwegian-registered foreign entity (NUF)", "SA": "cooperative (SA)", "BRL": "housing cooperative (BRL)",
    "ANS": "general partnership (ANS)", "DA": "shared-liability partnership (DA)", "STI": "foundation (STI)",
    "ESEK": "owner-section condominium (ESEK)", "FLI": "association (FLI)", "VPFO": "securities fund (VPFO)",
    "SAM": "jointly owned property (SAM)", "IKS": "inter-municipal company (IKS)", "KS": "limited partnership (KS)",
    "PRE": "shipping partnership (PRE)", "PK": "pension fund (PK)", "SPA": "savings bank (SPA)",
    "ANNA": "other legal entity (ANNA)", "SÆR": "entity under special legislation (SÆR)",
    "BBL": "housing building cooperative (BBL)", "GFS": "mutual insurance company (GFS)",
    "BA": "limited-liability cooperative (BA)", "SF": "state enterprise (SF)", "KIRK": "Church of Norway body (KIRK)",
}
ROLE_TEXT = {
    "daglig leder": "managing director", "styrets leder": "chair of the board", "styremedlem": "board member",
    "nestleder": "deputy chair", "varamedlem": "deputy board member", "revisor": "auditor",
    "regnskapsfører": "accountant", "forretningsfører": "business manager",
    "deltaker med delt ansvar": "partner (shared liability)", "deltaker med fullt ansvar": "partner (full liability)",
    "innehaver": "owner", "komplementar": "general partner", "kontaktperson": "contact person",
    "norsk representant for utenlandsk enhet": "Norwegian representative", "bestyrende reder": "managing owner",
}
ADVISER_ROLES = ["revisor", "regnskapsfører", "varamedlem", "kontaktperson"]
BOARD_ROLES = ["styrets leder", "styremedlem", "nestleder", "varamedlem"]
PART_LABELS = {
    "what_it_does": "What it does", "money": "Money", "people_and_presence": "People and presence",
    "what_changed": "What changed", "signals": "Key signals", "unknown": "What remains unknown",
}
