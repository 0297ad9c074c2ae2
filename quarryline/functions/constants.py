"""Fixed values that results depend on."""

#: Words that the index leaves out.
STOPWORDS = tuple(
    """
    a about above after again against all am an and any are aren't as at be because been before being below between both
    but by can't cannot could couldn't did didn't do does doesn't doing don't down during each few for from further had
    hadn't has hasn't have haven't having he he'd he'll he's her here here's hers herself him himself his how how's i i'd
    i'll i'm i've if in into is isn't it it's its itself let's me more most mustn't my myself no nor not of off on once
    only or other ought our ours ourselves out over own same shan't she she'd she'll she's should shouldn't so some such
    than that that's the their theirs them themselves then there there's these they they'd they'll they're they've this
    those through to too under until up very was wasn't we we'd we'll we're we've were weren't what what's when when's
    where where's which while who who's whom why why's with won't would wouldn't you you'd you'll you're you've your yours
    yourself yourselves
    """.split()
)
#: Characters stripped from both ends of a token; the embedder strips more.
TOKEN_TRIM = ".,!?:;\"'()[]{}"
EMBED_TRIM = TOKEN_TRIM + "<>-"

#: BM25.
K1, B = 1.2, 0.75
#: Reciprocal rank fusion.
RRF_K = 60

TECHNICAL_KEYWORDS = (
    "docs", "doc", "guide", "guides", "api", "apis", "reference", "manual", "tutorial", "tutorials", "architecture",
    "getting-started", "quickstart", "sdk", "spec", "specification", "developer", "learn", "overview",
)
NEGATIVE_SEGMENTS = (
    "login", "signup", "signin", "cart", "checkout", "privacy", "terms", "tag", "tags", "category", "categories",
    "author", "authors", "feed", "rss", "wp-content",
)
GENERIC_ANCHORS = ("click here", "read more", "next", "previous", "prev", "link", "here", "more")
RICH_EXTENSIONS = (".md", ".rst", ".html", ".json")
MEDIA_EXTENSIONS = (
    ".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp", ".ico", ".bmp", ".tiff", ".tif", ".avif", ".heic",
    ".mp4", ".webm", ".mkv", ".avi", ".mov", ".wmv", ".flv", ".m4v",
    ".mp3", ".wav", ".ogg", ".m4a", ".flac", ".aac", ".opus", ".wma",
    ".ttf", ".woff", ".woff2", ".eot", ".otf",
)
TRACKING_PARAMS = ("fbclid", "gclid", "ref", "_hsenc", "_hsmi", "mc_cid", "mc_eid")
TRACKING_PREFIX = "utm_"
ALLOWED_PORTS = ("", "80", "443", "8080", "8443")
MAX_URL = 2048
MAX_SEGMENTS = 10
MAX_SEGMENT_REPEATS = 3

#: Seconds: the default TTL, the least and the most.
TTL_DEFAULT, TTL_MIN, TTL_MAX = 604_800, 300, 2_592_000
#: Yield below which a page counts against its subtree, and how many in a row prune it.
LOW_YIELD, LOW_YIELD_RUN, HUB_LINKS = 0.02, 3, 8
#: Requests a minute by tier.
QUOTAS = {"free": 600, "pro": 3_000, "enterprise": 12_000}
