"""URL functions on built-in column expressions.

Null in, null out.  Text that is no URL keeps flowing: parts that cannot be found are empty strings.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_URL = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*):(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"

# Query parameters that carry tracking only.
TRACKING_PREFIXES = ("utm_", "mtm_")
TRACKING_KEYS = (
    "fbclid gclid gclsrc dclid gbraid wbraid gad_source msclkid yclid igshid igsh ttclid twclid mibextid "
    "mc_eid mc_cid mc_tc mkt_tok _hsenc _hsmi __hssc __hstc __hsfp hsCtaTracking _ga _gl _openstat srsltid "
    "fb_source fb_ref itm_campaign itm_medium itm_source vero_id vero_conv __twitter_impression spm scm"
).split()
# Parameters that carry tracking on one family of hosts.
HOST_TRACKING = {
    r"^(?:[a-z0-9-]+\.)*mercadoli(?:vre|bre)\.com(?:\.[a-z]{2})?$": ["pdp_filters", "sid"],
    r"^(?:[a-z0-9-]+\.)*olx\.com\.br$": ["rec", "custom_tag", "gallery_id", "tab_id", "is_fallback", "page", "lis"],
}
# Link wrappers as (host, path prefix, parameters that may hold the target).
WRAPPERS = [
    (r"^(?:l|lm|m)\.(?:facebook|messenger|instagram)\.com$", "/l.php", ["u"]),
    (r"^(?:www\.)?google\.[a-z.]+$", "/url", ["q", "url"]),
    (r"^(?:www\.)?youtube\.com$", "/redirect", ["q", "url"]),
    (r"^out\.reddit\.com$", "", ["url"]),
    (r"^steamcommunity\.com$", "/linkfilter/", ["url"]),
    (r"^away\.vk\.com$", "/away.php", ["to"]),
    (r"^t\.umblr\.com$", "/redirect", ["z"]),
    (r"^(?:www\.)?linkedin\.com$", "/redir/redirect", ["url"]),
    (r"^disq\.us$", "/url", ["url"]),
]
# Wiki projects whose titles fold, and parameters of views that are no article.
WIKI_PROJECTS = "wikibooks|wikinews|wikipedia|wikiquote|wikisource|wikiversity|wikivoyage|wiktionary"
WIKI_VIEW_KEYS = ["action", "veaction", "oldid", "diff", "curid", "diffonly", "undo", "undoafter"]
_VIDEO_HOST = r"(?:[a-z0-9-]+\.)*(?:youtube\.com|youtube-nocookie\.com)(?:\.[a-z]{2,})?"
_VIDEO = rf"(?i)^https?://(?:(?:www\.)?youtu\.be/([A-Za-z0-9_-]+)|{_VIDEO_HOST}/(?:watch\?(?:[^#]*?&)?v=([A-Za-z0-9_-]+)|(?:embed|shorts|v|live)/([A-Za-z0-9_-]+)))"
_WIKI_HOST = rf"^https?://([a-z]{{2,3}}(?:-[a-z0-9]+)*|simple)(?:\.m)?\.({WIKI_PROJECTS})\.org"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once: as a lambda's variable it is not copied into every
    place that mentions it, which keeps nested rewrites small."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def with_scheme(url: Column) -> Column:
    """Trimmed, with ``http://`` where no scheme is given."""
    raw = F.regexp_replace(url, r"(?U)^\s+|\s+$", "")
    return F.when(raw.contains("://"), raw).otherwise(F.concat(F.lit("http://"), raw))


def part(url: Column, name: str) -> Column:
    return F.regexp_extract(url, _URL, {"scheme": 1, "netloc": 2, "path": 3, "query": 4}[name])


def host_of(url: Column) -> Column:
    """Lower-case host without user and port."""
    return F.lower(F.regexp_extract(with_scheme(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))


def unquote(text: Column) -> Column:
    """Percent-decoded, a plus left as it is; text that cannot be decoded stays."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def quote(text: Column, safe: str = "") -> Column:
    """Percent-encoded but for letters, digits, ``_.-~`` and ``safe``."""
    out = F.url_encode(text)
    for a, b in [("+", "%20"), ("*", "%2A"), ("%7E", "~")]:
        out = F.replace(out, F.lit(a), F.lit(b))
    for c in safe:
        if not c.isalnum() and c not in "_.-~":
            out = F.replace(out, F.lit(f"%{ord(c):02X}"), F.lit(c))
    return out


def is_tracking(key: Column) -> Column:
    prefixed = reduce(lambda a, b: a | b, [key.startswith(p) for p in TRACKING_PREFIXES])
    return key.isin(*TRACKING_KEYS) | prefixed


def host_tracking(host: Column, key: Column) -> Column:
    """Whether ``key`` is tracking on this host alone; the first rule that fits the host decides."""
    rule = F.lit(False)
    for pattern, keys in reversed(HOST_TRACKING.items()):
        rule = F.when(host.rlike(pattern), key.isin(*keys)).otherwise(rule)
    return rule


def is_amp(key: Column, value: Column) -> Column:
    value = F.lower(value)
    return ((key == "amp") & value.isin("", "1", "true", "amp")) | ((key == "output") & (value == "amp"))


def strip_amp_path(path: Column) -> Column:
    kept = F.array_join(F.filter(F.split(path, "/"), lambda x: x != "amp"), "/")
    rooted = F.when(path.startswith("/") & ~kept.startswith("/"), F.concat(F.lit("/"), kept)).otherwise(kept)
    return F.when(path.contains("/amp"), F.when(rooted == "", "/").otherwise(rooted)).otherwise(path)


def video_id(url: Column) -> Column:
    """The video's id, or null."""
    found = F.coalesce(*[F.nullif(F.regexp_extract(url, _VIDEO, i), F.lit("")) for i in (1, 2, 3)])
    return found


def canonical_video(url: Column) -> Column:
    return let(url, _canonical_video)


def _canonical_video(url: Column) -> Column:
    others = F.filter(F.split(part(url, "query"), "&"), lambda x: (x != "") & ~x.startswith("v="))
    watch = F.concat(F.lit("https://youtube.com/watch?v="), F.array_join(F.concat(F.array(video_id(url)), others), "&"))
    query = part(url, "query")
    hosted = F.concat(F.lit("https://youtube.com"), part(url, "path"), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(url.rlike(_VIDEO), watch).when(host_of(url).rlike(f"^{_VIDEO_HOST}$"), hosted).otherwise(url)


def query_value(query: Column, name: str) -> Column:
    """The first ``name=value`` of a query string, percent-decoded, or null."""
    hits = F.filter(F.split(query, "&"), lambda x: x.startswith(f"{name}="))
    return unquote(F.substr(F.get(hits, F.lit(0)), F.lit(len(name) + 2)))


def canonical_wiki(url: Column) -> Column:
    return let(url, _canonical_wiki)


def _canonical_wiki(url: Column) -> Column:
    at_title = rf"(?is){_WIKI_HOST}/wiki/(.+)"
    at_index = rf"(?i){_WIKI_HOST}/w/index\.php"
    pairs = F.filter(F.split(part(url, "query"), "&"), lambda x: x.contains("="))
    keys = F.transform(pairs, lambda x: F.coalesce(F.try_url_decode(F.substring_index(x, "=", 1)), F.substring_index(x, "=", 1)))
    values = F.filter(pairs, lambda x: ~x.endswith("="))
    named = F.get(F.filter(values, lambda x: x.startswith("title=")), F.lit(0))
    index_title = F.coalesce(F.try_url_decode(F.substr(named, F.lit(7))), F.lit(""))
    plain = ~F.arrays_overlap(keys, F.array(*map(F.lit, WIKI_VIEW_KEYS)))
    page_title = unquote(F.substring_index(F.substring_index(F.regexp_extract(url, at_title, 3), "#", 1), "?", 1))

    def folded(pattern: str, title: Column) -> Column:
        title = F.replace(title, F.lit(" "), F.lit("_"))
        title = F.concat(F.upper(F.substring(title, 1, 1)), F.substr(title, F.lit(2)))
        lang, project = (F.lower(F.regexp_extract(url, pattern, i)) for i in (1, 2))
        return F.concat(F.lit("https://"), lang, F.lit("."), project, F.lit(".org/wiki/"), quote(title, "/:@!$&'()*+,;="))

    return (
        F.when(url.rlike(at_title), folded(at_title, page_title))
        .when(url.rlike(at_index) & plain & (index_title != ""), folded(at_index, index_title))
        .otherwise(url)
    )


def wrapped_target(url: Column) -> Column:
    """The address a link wrapper points to, or null; the first wrapper that fits decides."""
    parts = F.struct(host_of(url).alias("host"), part(url, "path").alias("path"), part(url, "query").alias("query"))
    return let(parts, lambda p: _wrapped_target(p["host"], p["path"], p["query"]))


def _wrapped_target(host: Column, path: Column, query: Column) -> Column:
    out = F.lit(None).cast("string")
    for pattern, prefix, names in reversed(WRAPPERS):
        targets = [query_value(query, n) for n in names]
        first = F.coalesce(*[F.when(t.rlike("^https?://"), t) for t in targets])
        out = F.when(host.rlike(pattern) & path.startswith(prefix), first).otherwise(out)
    return out


def unwrap(url: Column, depth: int = 3) -> Column:
    for _ in range(depth):
        url = let(url, lambda u: F.coalesce(wrapped_target(u), u))
    return url


def canonical_query(host: Column, query: Column) -> Column:
    """Tracking and AMP parameters dropped, the rest sorted by decoded key, equal keys in their order."""
    tokens = F.filter(F.split(query, "&"), lambda x: x != "")
    triples = F.transform(
        tokens,
        lambda x, i: F.struct(
            unquote(F.substring_index(x, "=", 1)).alias("key"),
            i.alias("place"),
            F.when(x.contains("="), F.substr(x, F.length(F.substring_index(x, "=", 1)) + 2)).alias("value"),
        ),
    )
    kept = F.filter(
        triples,
        lambda t: ~(
            is_tracking(t["key"]) | host_tracking(host, t["key"]) | is_amp(t["key"], unquote(F.coalesce(t["value"], F.lit(""))))
        ),
    )
    written = F.transform(F.array_sort(kept), lambda t: F.concat(quote(t["key"]), F.coalesce(F.concat(F.lit("="), t["value"]), F.lit(""))))
    return F.array_join(written, "&")


def normalize_url(url: Column) -> Column:
    """One canonical address per page: wrappers undone, video and wiki forms folded, scheme and host in
    lower case, default port, fragment, closing slash, AMP marks and tracking dropped, keys sorted."""
    return F.when(url == "", url).otherwise(let(canonical_wiki(canonical_video(unwrap(with_scheme(url)))), _normal_form))


def _normal_form(raw: Column) -> Column:
    scheme, netloc, host = F.lower(part(raw, "scheme")), part(raw, "netloc"), host_of(raw)
    user = F.regexp_extract(netloc, r"^(.*@)", 1)
    port = F.regexp_extract(netloc, r":(\d+)$", 1)
    standard = ((scheme == "http") & (port.try_cast("int") == 80)) | ((scheme == "https") & (port.try_cast("int") == 443))
    port = F.when((port == "") | standard, "").otherwise(F.concat(F.lit(":"), port.try_cast("int").cast("string")))
    path = strip_amp_path(part(raw, "path"))
    bare = F.rtrim(path, F.lit("/"))
    path = F.when((path != "/") & path.endswith("/"), F.when(bare == "", "/").otherwise(bare)).otherwise(path)
    query = canonical_query(host, part(raw, "query"))
    return F.concat(scheme, F.lit("://"), user, host, port, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def is_variable_segment(segment: Column) -> Column:
    """Whether a path segment names one item rather than a kind of page."""
    return segment.rlike(r"(?U)\d") | (F.length(segment) > 24)


ATTRIBUTION = ["_pos", "_sid", "_ss", "_psq", "_fid", "_v", "pr_prod_strat", "pr_rec_id", "pr_ref_pid", "pr_rec_pid", "pr_seq", "variant_source"]


def clean_product_url(path: Column, origin: Column, attribution: list[str] = ATTRIBUTION) -> Column:
    """A product's absolute address without attribution parameters and fragment (URL16)."""
    absolute = F.when(path.rlike("^https?://"), path).when(path.startswith("//"), F.concat(F.lit("https:"), path)).otherwise(F.concat(origin, F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))))
    bare = F.substring_index(absolute, "#", 1)
    kept = F.array_join(F.filter(F.split(part(bare, "query"), "&"), lambda t: (t != "") & ~F.substring_index(t, "=", 1).isin(*attribution)), "&")
    return F.concat(F.substring_index(bare, "?", 1), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def clean_image_url(src: Column) -> Column:
    """An image's address without the size a delivery network appends (URL17)."""
    absolute = F.when(src.startswith("//"), F.concat(F.lit("https:"), src)).otherwise(src)
    sized = F.regexp_replace(absolute, r"(?i)(\.(?:jpe?g|png|webp|avif))_[^/]*$", "$1")
    return F.nullif(F.regexp_replace(F.trim(sized), r"(?i)\._[A-Z0-9_,.-]+_\.(jpe?g|png|webp)$", ".$1"), F.lit(""))


def shopping_search_url(url: Column) -> Column:
    """The search form of an outdated shopping address, other addresses unchanged (URL18)."""
    query = part(url, "query")
    q = query_value(F.replace(query, F.lit("+"), F.lit("%20")), "q")
    extra = [F.when(query_value(query, k) != "", F.concat(F.lit(f"{k}="), F.url_encode(query_value(query, k)))) for k in ("gl", "hl")]
    written = F.concat(part(url, "scheme"), F.lit("://"), part(url, "netloc"), F.lit("/search?"), F.concat_ws("&", F.concat(F.lit("q="), F.url_encode(q)), F.lit("udm=28"), *extra))
    return F.when(part(url, "path").startswith("/shopping") & (q != ""), written).otherwise(url)


CHANNEL_TABS = ["videos", "streams", "shorts", "playlists", "live", "featured", "community", "releases", "podcasts"]


def channel_listing_url(url: Column) -> Column:
    """A channel's address on its video tab, unless it names a tab (URL21)."""
    path = part(url, "path")
    last = F.lower(F.element_at(F.concat(F.array(F.lit("")), F.filter(F.split(path, "/"), lambda s: s != "")), -1))
    tab = F.when(last.isin(*CHANNEL_TABS), path).otherwise(F.concat(F.rtrim(path, F.lit("/")), F.lit("/videos")))
    return F.concat(part(url, "scheme"), F.lit("://"), part(url, "netloc"), tab)


_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def fold_accents(text: Column) -> Column:
    """Lower-case ASCII words of a text, accents of Latin letters dropped (TXT22)."""
    return F.regexp_extract_all(F.regexp_replace(F.translate(F.lower(text), _ACCENTED, _PLAIN), r"[^\x00-\x7F]", ""), F.lit("[a-z0-9]+"), F.lit(0))


def strip_html(html: Column) -> Column:
    """Text of a fragment: line breaks kept, other tags as blanks, blanks collapsed (TXT26)."""
    broken = F.regexp_replace(html, r"(?i)<br\s*/?>", "\n")
    bare = F.regexp_replace(F.regexp_replace(broken, r"<[^>]+>", " "), r"[ \t]+", " ")
    return F.trim(F.regexp_replace(bare, r" ?\n ?", "\n"))
