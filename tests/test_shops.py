import json

import pytest
from pyspark.sql import functions as F

from webstrata.functions import dom as D
from webstrata.operators import shops as S
from webstrata.operators import tasks as K
from webstrata.plans import shops


def one(spark, kind, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} STRING" for k in values))
    return (S.parse_pages(df, kind) if isinstance(kind, str) else kind(df)).first().found


def linked(*objects):
    return "<html>" + "".join(f'<script type="application/ld+json">{json.dumps(o)}</script>' for o in objects) + "</html>"


def test_selectors():
    t = D.build("<div class='a b'><ul><li>one<li>two <b>x</b></ul><p id=q data-z='1,2'>hi<br>you</p><table><tr><th>K:<td>v<tr><th>L<td>w</table><script>no</script></div>")
    assert [n.text() for n in D.select(t, "li")] == ["one", "two x"]
    assert D.read_field(t, ".none || .a #q", "text") == "hi you" and D.read_field(t, "[data-z*=2]", "@data-z") == "1,2"
    assert D.read_field(t, "tr", "pairs th|td") == '{"K": "v", "L": "w"}' and D.read_field(t, "li", "texts") == "one\ntwo x"
    assert [n.tag for n in D.select(t, "p:not(#z), ul b")] == ["b", "p"] and D.read_field(t, "p:not(#q)", "present") is None
    assert "no" not in t.text().split() and D.build("<p>" * 5000 + "deep").text() == "deep" and D.build("</x><").text() == "<"


def test_market(spark):
    product = {"@type": "Product", "name": " A ", "sku": "MLB77", "brand": {"name": "B"}, "offers": {"url": "https://x.test/MLB-1234-a", "price": 12.5, "priceCurrency": "BRL", "availability": "https://schema.org/InStock"}}
    got = one(spark, "market_listing", html=linked({"@graph": [product, {"@type": "Product", "name": "no url"}]}))
    assert (got.outcome, len(got["items"])) == ("ok", 1)
    item = got["items"][0]
    assert (item.title, item.id, item.price, item.in_stock, item.brand) == ("A", "MLB1234", 12.5, True, "B")
    card = "<div class=poly-card><a class=poly-component__title href='{}'>T {}</a><div class=poly-price__current><span class=andes-money-amount><span class=andes-money-amount__fraction>1.299</span><span class=andes-money-amount__cents>90</span></span></div><s class='andes-money-amount andes-money-amount--previous'><span class=andes-money-amount__fraction>1.500</span></s><p class=poly-component__shipping-v2>Frete GRÁTIS</p></div>"
    got = one(spark, "market_listing", html="<body>" + card.format("https://click1.mercadolivre.com.br/ad", "ad") + card.format("https://p.test/MLB-9#x", "b") + "</body>")
    assert [(i.title, i.url, i.id, i.price, i.list_price, i.free_shipping) for i in got["items"]] == [("T b", "https://p.test/MLB-9", "MLB9", 1299.9, 1500.0, True)]
    assert one(spark, "market_listing", html="<body>nothing</body>").outcome == "parse_failed"
    group = {"@type": "ProductGroup", "brand": "G", "hasVariant": [{"@type": "Product", "name": "v1", "productID": "MLB1", "offers": {"price": 1}}, {"@type": "Product", "name": "v2", "productID": "MLB2", "offers": {"price": 2}}]}
    page = linked(group).replace("</html>", "<div class=ui-pdp-subtitle>Novo | +5 mil vendidos</div><table><tr class=andes-table__row><th>Cor<td>Azul</table></html>")
    for url, want in (("https://x.test/p/MLB2", "v2"), ("https://x.test/p/MLB3", "v1")):
        got = one(spark, "market_product", html=page, url=url)
        assert (got.outcome, got.item.title, got.item.brand, got.item.sold, got.specs, got.n_variants) == ("ok", want, "G", 5000, {"Cor": "Azul"}, 2)
    assert one(spark, "market_product", html="<link rel=canonical href='https://lista.mercadolivre.com.br/x'>", url="https://x.test").outcome == "not_found"
    assert one(spark, "market_product", html=None, url=None).outcome == "parse_failed"


def test_listing_keyword(spark):
    cases = [("https://lista.mercadolivre.com.br/notebook-gamer_Desde_49", "notebook gamer"), ("https://www.mercadolivre.com.br/ofertas", None), ("https://www.x.test/?a=1&q=red+chair", "red chair"), ("https://www.x.test/?as_word=%20a%20", "a"), ("https://lista.mercadolivre.com.br/", None), (None, None)]
    df = spark.createDataFrame(cases, "u STRING, want STRING")
    assert [r.got for r in df.select(S.listing_keyword(F.col("u")).alias("got")).collect()] == [w for _, w in cases]


def test_store(spark):
    card = '<div data-component-type="s-search-result" data-asin="{}"><h2>Brand</h2><h2 aria-label="x"><a><span>Title {}</span></a></h2><span class="a-price a-text-price"><span class=a-offscreen>{}</span></span><span class=a-price><span class=a-offscreen></span><span class=a-price-symbol>{}</span><span class=a-price-whole>{}</span><span class=a-price-fraction>50</span></span><i class=a-icon-alt>4,8 de 5 estrelas</i><a aria-label="8.399 classificações">8</a><img class=s-image src="https://m.test/81a._AC_SL1500_.jpg"></div>'
    br = one(spark, "store_listing", html=card.format("B1", "1", "R$ 100,00", "R$", "79,") * 2 + card.format("", "2", "", "R$", "1,"), url="https://www.amazon.com.br/s?k=x")
    assert [(i.id, i.title, i.price, i.list_price, i.rating, i.ratings, i.image, i.url, i.currency) for i in br["items"]] == [("B1", "Title 1", 79.5, 100.0, 4.8, 8399, "https://m.test/81a.jpg", "https://www.amazon.com.br/dp/B1", "BRL")]
    us = one(spark, "store_listing", html=card.format("B1", "1", "BRL 2,000.00", "$", "1,299."), url="https://www.amazon.com/s?k=x")
    assert [(i.price, i.list_price, i.currency) for i in us["items"]] == [(1299.5, None, "USD")]
    assert one(spark, "store_listing", html="<div class=s-main-slot></div>", url="https://www.amazon.com/s?k=x").outcome == "no_results"
    assert one(spark, "store_listing", html="<p>robot</p>", url="https://www.amazon.com/s?k=x").outcome == "parse_failed"
    page = "<span id=productTitle> A thing </span><div id=corePrice_feature_div><span class=a-price><span class=a-offscreen>R$ 10,00</span></span></div><a id=bylineInfo>Marca: Foo Loja</a><div id=availability><span>Indisponível.</span></div><ul id=feature-bullets><li><span class=a-list-item>one</span><li><span class=a-list-item>two</span></ul><table class=prodDetTable><tr><th>Peso<td>2 kg</table>"
    got = one(spark, "store_product", html=page, url="https://www.amazon.com.br/slug/dp/B0CFPL6CFY/ref=x")
    assert (got.outcome, got.item.title, got.item.id, got.item.price, got.item.brand, got.item.in_stock, got.features, got.specs) == ("ok", "A thing", "B0CFPL6CFY", 10.0, "Foo", False, ["one", "two"], {"Peso": "2 kg"})
    assert one(spark, "store_product", html="<p>", url="https://www.amazon.com/dp/B0CFPL6CFY").outcome == "parse_failed"


def test_bazaar(spark):
    card = "<div class='x card-out-wrapper y'><a href='//pt.aliexpress.com/item/{0}.html?a=1' title='t'><img src='//ae.aliexpress-media.com/a.jpg_480x480.jpg'><h3>Item {0}</h3></a><div><span style='decimal_point'>R$</span><span style='x decimal_point'>39</span><span style='decimal_point'>,</span><span style='decimal_point'>44</span><span style='line-through'>R$50,00</span><span>4.9</span><span>2 mil+ vendidos</span><span>-20%</span></div></div>"
    got = one(spark, "bazaar_listing", html=card.format(11) + card.format(11) + card.format(12), url="https://pt.aliexpress.com/w")
    assert [(i.id, i.title, i.price, i.list_price, i.rating, i.sold, i.discount) for i in got["items"]] == [(n, f"Item {n}", 39.44, 50.0, 4.9, 2000, 20) for n in ("11", "12")]
    assert got["items"][0].url == "https://pt.aliexpress.com/item/11.html?a=1" and got["items"][0].image == "https://ae.aliexpress-media.com/a.jpg"
    assert [one(spark, "bazaar_listing", html=h, url="https://a.test").outcome for h in ("<div class=search-item></div>", "<p>")] == ["no_results", "parse_failed"]
    reviews = json.dumps({"data": {"productEvaluationStatistic": {"evarageStar": 4.7, "totalNum": 9, "fiveStarNum": 8}, "evaViewList": [{"buyerFeedback": " good ", "buyerEval": 100}, {"buyerFeedback": ""}]}})
    got = one(spark, "bazaar_product", html="<meta property='og:title' content='A'><h1>AliExpress</h1>", url="https://a.test/item/5.html", reviews=reviews)
    assert (got.outcome, got.item.title, got.item.id, got.item.rating, got.item.ratings, got.histogram) == ("ok", "A", "5", 4.7, 9, {5: 8}) and [(r.text, r.stars) for r in got.reviews] == [("good", 5.0)]
    assert one(spark, "bazaar_product", html="", url="https://a.test/store", reviews="{bad").outcome == "parse_failed"


def test_pets(spark):
    product = {"@type": "Product", "name": "P", "url": "/p", "sku": "s", "offers": {"url": "/o", "price": "22.50", "availability": "InStock"}}
    got = one(spark, "pet_listing", html=linked({"@type": "ItemList", "description": "Catálogo completo com 69 produtos disponíveis.", "itemListElement": [product, {"@type": "Thing"}]}))
    assert (got.outcome, got.total, [(i.title, i.price) for i in got["items"]]) == ("ok", 69, [("P", 22.5)])
    assert [one(spark, "pet_listing", html=h).outcome for h in (linked({"@type": "ItemList", "itemListElement": []}), "<p>")] == ["no_results", "parse_failed"]
    group = {"@type": "ProductGroup", "name": "G", "productGroupID": 7, "hasVariant": [product, {**product, "offers": {"price": "30"}}], "aggregateRating": {"ratingValue": 4.798175, "reviewCount": 3}, "review": [{"author": {"name": "Ana"}, "reviewRating": {"ratingValue": 5}, "description": "<b>ok</b>  yes"}]}
    crumbs = {"@type": "BreadcrumbList", "itemListElement": [{"item": {"name": "Home"}}, {"name": "Cats"}, {"name": "Food"}]}
    page = linked(group, crumbs).replace("</html>", "<div class=bottom-ctas-bar__single-price>R$17,90 R$16,11</div><div class=properties__list><span class=properties__list__name>TIPO</span><span class=properties__list__value>X</span></div></html>")
    got = one(spark, "pet_product", html=page, url="https://a.test/p")
    assert (got.outcome, got.item.id, got.item.price, got.price_max, got.item.in_stock, got.item.rating, got.item.ratings, got.category, got.item.list_price, got.specs, got.n_variants) == ("ok", "7", 22.5, 30.0, True, 4.8, 3, "Cats > Food", 17.9, {"TIPO": "X"}, 2)
    assert [(r.author, r.rating, r.text) for r in got.reviews] == [("Ana", 5.0, "ok yes")]
    single = one(spark, "pet_product", html=linked(product), url="u")
    assert (single.item.price, single.n_variants, single.price_max) == (22.5, 0, None) and one(spark, "pet_product", html=None, url="u").outcome == "parse_failed"


def spread_and_once(spark, folder, name):
    """A file's parts are spread over all cores, and each page's linked data is taken out in one place of the plan."""
    df = shops.queries()[name](spark, folder)
    assert str(df._jdf.queryExecution().optimizedPlan()).count("ld\\+json") <= 1, name
    assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism, name


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("parts"))
    parts = spark.range(40).selectExpr("id AS p_partkey", "concat('n ', id) AS p_name", "'Brand#1' AS p_brand", "CAST(id AS INT) AS p_size")
    parts.coalesce(1).write.parquet(f"{folder}/part.parquet")
    return folder


def test_pet_items_reads_each_page_once(spark, parts):
    spread_and_once(spark, parts, "pet_items")


def test_market_items_reads_each_page_once(spark, parts):
    spread_and_once(spark, parts, "market_items")


def test_store_items_look_up_elements(spark, parts, monkeypatch):
    """Fields look at the elements that a page has for them, not at all for each selector."""
    calls = []
    fits = D._fits
    monkeypatch.setattr(D, "_fits", lambda *a: calls.append(1) or fits(*a))
    page = "<span id=productTitle>T</span>" + "<div class=x><b>y</b></div>" * 100 + "<div id=availability>z</div>"
    assert S.STORE_PAGE.read(page) == {"parsed": True, "items": [{"title": "T", "stock": "z", "anchor": "true"}]}
    assert len(calls) < 20
    spread_and_once(spark, parts, "store_items")


TASK = """<meta property="og:title" content="T12 Fix it"><div class=phui-header-subheader><span class=phui-tag-view>Closed, Resolved</span></div>
<div class=phui-curtain-panel><div class=phui-curtain-panel-header>Authored By</div><div class=phui-curtain-panel-body><a class=phui-link-person href=/p/ana>ana</a></div></div>
<div class=phui-curtain-panel><div class=phui-curtain-panel-header>Assigned To</div><div class=phui-curtain-panel-body><i class=phui-curtain-object-ref-list-view-empty>None</i></div></div>
<div class=phui-curtain-panel><div class=phui-curtain-panel-header>Project Tags</div><div class=phui-curtain-panel-body><li class=phabricator-handle-tag-list-item><a class=phui-tag-view href=/tag/x><span class=phui-tag-core>X</span></a></li></div></div>
<div class=phui-property-list-text-content><div class=phabricator-remarkup><p>See <a href=/T1>T1</a></p><ul><li>a</li></ul></div></div>
<dl class=phui-property-list-properties><dt>Mentioned In</dt><dd><a class="phui-handle handle-status-closed" href=/T3>T3: c</a></dd><dt>Text</dt><dd>plain</dd></dl>
<div class=phui-timeline-shell>status change</div>
<div class=phui-timeline-shell><a class=phabricator-anchor-view id=9></a><a class="phui-handle phui-link-person">bo</a><span class=print-only>Jan 1</span><div data-sigil="transaction-comment"><div class=phabricator-remarkup><p>Yes</p></div></div></div>"""


def test_tasks(spark):
    got = one(spark, K.task_pages, html=TASK)
    assert (got.outcome, got.id, got.title, got.status, got.priority) == ("ok", 12, "Fix it", "Resolved", None)
    b = got.body
    assert (b.author, b.assignee, [(t.name, t.url) for t in b.tags], b.description) == ("ana", None, [("X", "/tag/x")], "See [T1](/T1)\n\n- a")
    assert [(c.id, c.author, c["at"], c.text) for c in b.comments] == [("9", "bo", "Jan 1", "Yes")]
    assert [(r.label, r.title, r.url, r.closed) for r in b.related] == [("Mentioned In", "T3: c", "/T3", True)]
    assert [one(spark, K.task_pages, html=h).outcome for h in ("<title> Login </title>", "<p>odd</p>", None)] == ["login_required", "parse_failed", "parse_failed"]
    item = "<li class=phui-oi><a class=phui-oi-link href='{}' title='T5: Do'>x</a><span class=phui-oi-attribute>· Open</span><i class=phui-source-fragment>snip</i></li>"
    got = one(spark, K.task_lists, html="<ul class=phui-oi-list-view>" + item.format("/T5") * 2 + item.format("/D9") + "</ul>")
    assert [tuple(i) for i in got["items"]] == [(5, "Do", "Open", "snip")]
    assert [one(spark, K.task_lists, html=h).outcome for h in ("<ul class=phui-oi-list-view></ul>", "you shall NOT pass", "")] == ["no_results", "login_required", "parse_failed"]
    df = spark.createDataFrame([("https://p.test/T12",), ("https://p.test/maniphest/?q=1",), ("https://p.test/D1",)], "u STRING")
    assert [r.c and tuple(r.c) for r in df.select(K.task_claim(F.col("u")).alias("c")).collect()] == [("task", "12"), ("search", "https://p.test/maniphest/?q=1"), None]
