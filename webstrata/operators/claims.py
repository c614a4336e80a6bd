"""Which source claims an address, and as what kind of page (CLS16, CLS17).

Every claim is a column of the page's kind, null where the source does not claim the address; the first source
in the fixed order that claims it takes it.  Hosts that are known beside the built-in ones are parameters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webstrata.functions.urls import host_of, part, query_value, unquote, video_id
from webstrata.functions.values import pii, pmcid
from webstrata.operators.routing import SERVICES, forge_claim
from webstrata.operators.tasks import task_claim

# First path parts that are a forge's or code host's own pages, and host labels of forges.
FORGE_PAGES = "users groups dashboard explore help api admin search projects - s topics public assets uploads favicon.ico robots.txt sitemap.xml".split()
FORGE_LABELS = "gitlab git forge scm code vcs repo dev".split()
CODE_HOST_PAGES = (
    "about apps codespaces collections contact customer-stories dashboard enterprise events explore features issues join login marketplace new nonprofit notifications orgs organizations pricing "
    "pulls readme resources search security settings site solutions sponsors stars team topics trending users watching"
).split()
_HOSTS = {name: hosts for name, hosts, _ in SERVICES}


def _segments(url: Column) -> Column:
    return F.filter(F.split(part(url, "path"), "/"), lambda s: s != "")


def _on(host: Column, domain: str) -> Column:
    return (host == domain) | host.endswith(f".{domain}")


def video_claim(url: Column) -> Column:
    """video, search, playlist, channel or other; null off the video hosts."""
    path = F.regexp_replace(part(url, "path"), "/+$", "")
    kind = (
        F.when(video_id(url).isNotNull(), "video")
        .when((path == "/results") & (query_value(part(url, "query"), "search_query") != ""), "search")
        .when((path == "/playlist") & (query_value(part(url, "query"), "list") != ""), "playlist")
        .when(part(url, "path").rlike(r"(?i)^/(?:@[^/]+|channel/[^/]+|c/[^/]+|user/[^/]+)(?:/|$)"), "channel")
        .otherwise("other")
    )
    return F.when(host_of(url).rlike(_HOSTS["youtube"]), kind)


def repository_claim(url: Column) -> Column:
    parts = _segments(url)
    return F.when(host_of(url).rlike(_HOSTS["github"]) & (F.size(parts) == 2) & ~F.lower(F.get(parts, F.lit(0))).isin(*CODE_HOST_PAGES), "repository")


def paper_kind(url: Column) -> Column:
    """doi, pii, pmid, pmcid or arxiv of the closed set of scholarly hosts."""
    host, path, parts = F.regexp_replace(host_of(url), r"^www\.", ""), part(url, "path"), _segments(url)
    return F.when(
        url.rlike("(?i)^https?://"),
        F.when(host.isin("doi.org", "dx.doi.org") & path.rlike(r"10\.\d{4,9}/\S"), "doi")
        .when(host.isin("sciencedirect.com", "linkinghub.elsevier.com") & pii(path).isNotNull(), "pii")
        .when((host == "pubmed.ncbi.nlm.nih.gov") & F.get(parts, F.lit(0)).rlike(r"^\d+$"), "pmid")
        .when(host.isin("ncbi.nlm.nih.gov", "pmc.ncbi.nlm.nih.gov", "europepmc.org") & pmcid(path).isNotNull(), "pmcid")
        .when((host == "arxiv.org") & (F.size(parts) >= 2) & F.get(parts, F.lit(0)).isin("abs", "pdf"), "arxiv"),
    )


def shopping_claim(url: Column) -> Column:
    path = part(url, "path")
    tab = (path == "/search") & F.array_contains(F.split(part(url, "query"), "&"), "udm=28")
    return F.when(host_of(url).rlike(_HOSTS["google_shopping"]) & (path.startswith("/shopping") | tab), "shopping")


def store_claim(url: Column) -> Column:
    """product, collection or search of a store's page shapes, on any host (ADP09)."""
    parts = _segments(url)
    a, b, c, n = F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.get(parts, F.lit(2)), F.size(parts)
    collection = ((n == 2) & (a == "collections") & ~b.endswith(".json")) | ((n == 3) & (a == "collections") & (c == "products.json")) | ((n == 1) & (a == "products.json"))
    searched = ((n == 2) & (a == "search") & (b == "suggest.json")) | ((n == 1) & (a == "search") & (query_value(part(url, "query"), "q") != ""))
    return F.when((n == 2) & (a == "products"), "product").when(collection, "collection").when(searched, "search")


def is_store_candidate(url: Column) -> Column:
    """Whether an unknown host is worth asking if it is a store: a product or collection page for readers."""
    parts = _segments(url)
    a, b = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    shape = (F.size(parts) == 2) & (((a == "products") & ~b.rlike(r"\.(?:js|json)$")) | ((a == "collections") & ~b.endswith(".json")))
    return F.coalesce(shape, F.lit(False))


def forge_kind(url: Column) -> Column:
    """issue, merge_request or project of a forge's page shapes, on any host (ADP14)."""
    c = forge_claim(url)
    return F.when(~F.lower(F.substring_index(c["project"], "/", 1)).isin(*FORGE_PAGES), c["kind"])


def is_forge_candidate(url: Column) -> Column:
    """Whether an unknown host is worth asking if it is a forge: any issue or request, projects only where a
    label of the host sounds like one."""
    hinted = F.exists(F.split(host_of(url), r"\."), lambda x: x.isin(*FORGE_LABELS) | x.startswith("gitlab"))
    kind = forge_kind(url)
    return F.coalesce(kind.isin("issue", "merge_request") | ((kind == "project") & hinted), F.lit(False))


def claim(url: Column, trackers: tuple[str, ...] = ("phabricator.wikimedia.org",), stores: tuple[str, ...] = (), forges: tuple[str, ...] = ("gitlab.com",), wiki_access: bool = False) -> Column:
    """(service, kind) of an address, or null.  ``wiki_access``: whether there is access to the wikis' article
    service; ``stores`` are registered domains' hosts known to be stores."""
    host, path, parts = host_of(url), part(url, "path"), _segments(url)
    low = F.lower(path)
    bare = F.regexp_replace(low, "/+$", "")
    wiki = F.when(host.rlike(_HOSTS["wikimedia"]) & path.rlike(r"^/(?:wiki/.|w/index\.php)"), "article") if wiki_access else F.lit(None).cast("string")
    item = F.when(low.startswith("/s/") | (low == "/s"), F.when(query_value(part(url, "query"), "k") != "", "search"))
    asin = path.rlike(r"/(?:dp|gp/product|gp/aw/d|product)/[A-Z0-9]{10}(?:/|$)")
    app = F.when((F.get(parts, F.lit(0)) == "app") & F.get(parts, F.lit(1)).rlike(r"^\d+$"), "app").when((F.get(parts, F.lit(0)) == "search") & (F.trim(query_value(part(url, "query"), "term")) != ""), "search")
    market = F.when(host.startswith("produto.") | low.contains("/p/mlb") | low.contains("/up/mlb") | low.rlike(r"/mlb-?\d+"), "product").otherwise("search")
    claims = [
        ("youtube", video_claim(url)),
        ("wikimedia", wiki),
        ("github", repository_claim(url)),
        ("scholar", paper_kind(url)),
        ("google_shopping", shopping_claim(url)),
        ("realestate", F.when(_on(host, "vivareal.com.br"), F.when(low.contains("/imovel/"), "detail").otherwise("list"))),
        ("olx", F.when(_on(host, "olx.com.br"), F.when(F.array_contains(F.split(low, "/"), "imoveis"), "realestate").when(F.array_contains(F.split(low, "/"), "autos-e-pecas"), "vehicles"))),
        ("mercadolivre", F.when(_on(host, "mercadolivre.com.br"), market)),
        ("aliexpress", F.when(_on(host, "aliexpress.com") | _on(host, "aliexpress.com.br"), F.when(path.rlike(r"(?i)/item/\d+\.html"), "product").otherwise("search"))),
        ("shopee", F.when(_on(host, "shopee.com.br") & path.rlike(r"-i\.\d+\.\d+"), "product")),
        ("petlove", F.when(_on(host, "petlove.com.br"), F.when(bare == "/busca", "search").when((bare != "/p") & bare.endswith("/p"), "product"))),
        ("amazon", F.when(F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r"^m\.", "").isin("amazon.com", "amazon.com.br"), F.when(asin, "product").otherwise(item))),
        ("steam", F.when(host == "store.steampowered.com", app)),
        ("npm", F.when(host.rlike(_HOSTS["npm"]) & unquote(path).rlike(r"^/package/(?:@[^/]+/)?[^/@]+(?:/v/[^/]+)?/?$"), "package")),
        ("phabricator", F.when(host.isin(*trackers), task_claim(url)["kind"])),
        ("shopify", F.when(_on(host, "myshopify.com") | (host.isin(*stores) if stores else F.lit(False)), store_claim(url))),
        ("gitlab", F.when(host.isin(*forges), forge_kind(url))),
    ]
    return F.coalesce(*[F.when(kind.isNotNull(), F.struct(F.lit(name).alias("service"), kind.alias("kind"))) for name, kind in claims])
