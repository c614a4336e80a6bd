import gzip
import random

from tests.llm.data import FETCH, fetch_rows, odd_fetches
from webstrata.llm import chrome as C
from webstrata.llm import linekinds as K
from webstrata.llm import pages as P

MENU = ["Home", "About us", "Contact", "Help", "Press"]
WORDS = "river patch cable garden window letter number winter summer market bridge paper stone glass light".split()


def sentence(rng):
    return "The " + " ".join(rng.choice(WORDS) for _ in range(9)) + " was seen."


def site(n=60, seed=1):
    rng = random.Random(seed)
    rows, truth = [], set()
    for i in range(n):
        host = f"https://{'ab'[i % 2]}.test/{i}"
        body = [sentence(rng) for _ in range(4)]
        menu = rng.sample(MENU, 3)
        html = ["<html><head><title>x</title><style>p{}</style></head><body>", '<ul class="m">', *[f"<li>{m}</li>" for m in menu], "</ul>", "<main>", *[f"<p>{s}</p>" for s in body], "</main>", "<footer>", "<p>All rights reserved.</p>", "</footer>", "<script>var a='<p>';", "x()</script></body></html>"]
        truth |= {("html_gz", i, k) for k, line in enumerate(html, 1) if line.startswith("<li>") or "reserved" in line}
        md = ["# Page about it", "", " | ".join(menu), "", *body, "", "All rights reserved."]
        truth |= {("markdown", i, 3), ("markdown", i, len(md))}
        rows.append((i, host, "t", "\n".join(md), "\n".join(html), "en", 200))
    return fetch_rows(rows), truth


def test_chrome_is_found(spark):
    rows, truth = site()
    got = C.chrome_lines(spark.createDataFrame(rows + rows[:3], FETCH)).collect()
    assert len(got) == len(set(got))
    assert {(r.field, r.fetch_id, r.line_no) for r in got} == truth


def test_page_of_recurring_wording_keeps_its_best_branch(spark):
    rows, truth = site()
    error = "<html><body>\n<div class=e>\n<p>The page you asked for is not here.</p>\n</div>\n</body></html>"
    rows += fetch_rows([(500 + i, f"https://a.test/e{i}", None, None, error, None, 404) for i in range(20)])
    got = C.chrome_lines(spark.createDataFrame(rows, FETCH)).collect()
    assert not {(r.fetch_id, r.line_no) for r in got if r.field == "html_gz" and r.fetch_id >= 500}


NODES = "fetch_id LONG, host STRING, nodes ARRAY<STRUCT<path: LONG, style: LONG, pieces: ARRAY<STRUCT<line_no: INT, wording: LONG, size: INT, again: BOOLEAN>>>>"
LAYOUTS = "path LONG, chain ARRAY<LONG>"


def test_repeated_cells_and_redelivered_fetches_count_once(spark):
    cells = "".join(f"<td>{w}</td>" for w in ["Yes"] * 9)
    page = "<html><body><div class=t>\n" + cells + "{}</div></body></html>"
    rows = fetch_rows([(i, "https://a.test", None, None, page.format(f"<td>unique text of page {'abc'[i]}</td>"), None, 200) for i in range(3)])
    pages = P.html_pages(spark.createDataFrame(rows * 2, FETCH))
    tree = C.style_tree(pages.dropDuplicates(["fetch_id"]), pages.selectExpr("inline(layouts)").dropDuplicates(["path"])).collect()
    assert [r.m for r in tree] == [3]
    unique = len("unique text of page a")
    assert abs(tree[0].importance - unique / (unique + 3)) < 1e-9


def brute_tree(pages, chains):
    """Importance and least branch importance of each (host, path), one host, by direct recursion."""
    from math import log

    from webstrata.llm.chrome import PRIOR_PAGES, STYLE_DECAY

    styles, words, sizes = {}, {}, {}
    for nodes in pages:
        for path, style, pieces in nodes:
            styles.setdefault(path, []).append(style)
            for wording, size in pieces:
                words.setdefault(path, {}).setdefault(wording, []).append(size)
    a, content, mass = {}, {}, {}
    for path, seen in styles.items():
        m, counts = len(seen), [seen.count(x) for x in set(seen)]
        entropy = -sum(n / m * log(n / m, m) for n in counts) if m > 1 else 1.0
        a[path] = (1 - STYLE_DECAY ** len(counts)) * entropy
        found = words.get(path, {})
        mass[path] = sum(map(sum, found.values()))
        if mass[path]:
            content[path] = sum(sum(z) * (1 - log(len(z), max(m, 2))) for z in found.values()) / mass[path]

    def branch(at):
        """(text below, importance of the branch)."""
        parts = [(mass[at], content[at])] if mass[at] else []
        parts += [branch(p) for p in styles if len(chains[p]) > 1 and chains[p][-2] == at]
        total = sum(m for m, _ in parts)
        inner = sum(m * c for m, c in parts if m) / total if total else 0.0
        return total, 1 - (1 - inner) * (1 - a[at])

    assert PRIOR_PAGES > 0  # one host: its own values and those over all hosts are the same
    return {p: (1 - (1 - content[p]) * (1 - a[p]), min(branch(x)[1] for x in chains[p])) for p in content}


def test_tree_against_recursion(spark):
    rng = random.Random(5)
    chains = {1: [1], 2: [1, 2], 3: [1, 3], 4: [1, 3, 4], 5: [1, 3, 5], 6: [1, 3, 4, 6]}
    pages = []
    for _ in range(30):
        nodes = [(1, 1, [])]
        for p in (2, 3, 4, 5, 6):
            if p in (3, 4) or rng.random() < 0.8:
                nodes.append((p, rng.randrange(3), [] if p == 3 else [(w, 5 + w) for w in rng.sample(range(12 if p < 6 else 3), 2)]))
        pages.append(nodes)
    rows = [(i, "h", [(p, s, [(1, w, z, False) for w, z in x]) for p, s, x in nodes]) for i, nodes in enumerate(pages)]
    tree = C.style_tree(spark.createDataFrame(rows, NODES), spark.createDataFrame(list(chains.items()), LAYOUTS))
    got = {r.path: (r.importance, r.branch) for r in tree.collect()}
    want = brute_tree(pages, chains)
    assert got.keys() == want.keys()
    for p in want:
        assert abs(got[p][0] - want[p][0]) < 1e-9 and abs(got[p][1] - want[p][1]) < 1e-9, p


def test_low_branch_takes_unique_text_along(spark):
    rng = random.Random(7)
    rows = []
    for i in range(80):
        foot = "".join(f"<p>{t} of this site, in the words its owners chose for every page.</p>" for t in ("The terms", "The rights", "The contacts", "The makers"))
        html = f"<html><body>\n<main><h1>{sentence(rng)}</h1><p>{sentence(rng)}</p></main>\n<footer>{foot}\n<div class=latest>\n{sentence(rng)[:25]}</div></footer></body></html>"
        rows.append((i, "https://a.test", None, None, html, None, 200))
    got = {(r.fetch_id, r.line_no) for r in C.chrome_lines(spark.createDataFrame(fetch_rows(rows), FETCH)).collect()}
    assert got == {(i, k) for i in range(80) for k in (3, 5)}


def test_main_bodies(spark):
    rows, _ = site(30)
    got = {r.fetch_id: r.main_body for r in C.main_bodies(spark.createDataFrame(rows, FETCH)).collect()}
    assert all("reserved" not in t and "was seen." in t and " | " not in t for t in got.values())


def test_read_html():
    html = '<html><head><title>no</title></head>\n<body class="x"><!-- no\nno --><div id="a1">one &amp; two\nthree<br>four</div><p>five<style>no</style><div class=b><h2>x</h2><p>y</p><p>z</p></div></body>'
    found, children, parents = P.read_html(html)
    assert [(line, text) for line, _, _, text in found] == [(3, "one & two"), (4, "three"), (4, "four"), (4, "five"), (4, "x"), (4, "y"), (4, "z")]
    assert children == {"body": ["div[id=a0]", "p", "div[class=b]"], "body/div[id=a0]": [], "body/div[class=b]": ["h2", "p"]}
    assert parents == {"body": None, "body/div[id=a0]": "body", "body/div[class=b]": "body"}
    assert P.read_html("") == ([], {"body": []}, {"body": None})


def test_wording_masks_names_and_numbers():
    assert P.wording("Notes on the Porum KR13") == P.wording("Notes on the Rubal ZZ7")
    assert P.wording("Page 12") == P.wording("Page 7") and P.wording("Home") != P.wording("Help")
    assert P.wording("Contact") == P.wording("Ｃ​ontаct")
    notice = "We and our partners keep small files on this device to run the site. " * 6
    assert P.wording(notice) == P.wording(notice.replace("partners", "pаrtners")) and P.wording(f"{notice} by Alim 7") == P.wording(f"{notice} by Borun 12")
    assert P.read_line(" | ".join(["one of many menu entries"] * 30))[1][1:] == ["one of many menu entries"] * 30


def test_odd_pages(spark):
    df = odd_fetches(spark)
    assert {r.fetch_id for r in C.chrome_lines(df).collect()} <= {4, 5, 6}
    assert {r.fetch_id: r.main_body is None for r in C.main_bodies(df).collect()} == {None: True, 1: True, 2: False, 3: False, 4: False, 5: False, 6: False}
    assert K.unreadable_records(df).where("fetch_id = 4").count() == 0
    assert {r.fetch_id: r.n_lines for r in K.label_shares(df).collect()}[2] == 0
    stats = {r.fetch_id: r for r in K.text_statistics(df).collect()}
    assert stats[1].words is None and stats[2].words == 0 and stats[4].words == 4000 * 7
    empty = df.limit(0)
    assert C.chrome_lines(empty).count() == K.unreadable_records(empty).count() == K.label_shares(empty).count() == 0


KINDS = {
    "list": "\n".join(f"* {a} {b}" for a in WORDS[:5] for b in WORDS[:5]),
    "table": "\n".join(f"| {w} | {i * 37}.50 | {i} kg |" for i, w in enumerate(WORDS)),
    "junk": "\n".join("".join(random.Random(i).choices("ABCDEFGHabcdefgh0123456789+/", k=64)) for i in range(12)),
    "prose": "\n\n".join(" ".join(sentence(random.Random(i + j)) for j in range(4)) for i in range(5)),
}


def test_kinds(spark):
    rows, _ = site(40)
    extra = fetch_rows([(100 + i, "https://a.test/k", None, t, None, None, 200) for i, t in enumerate(KINDS.values())])
    got = {r.fetch_id: r.kind for r in K.unreadable_records(spark.createDataFrame(rows + extra + extra, FETCH)).collect()}
    assert got == {100: "list", 101: "table", 102: "junk"}


def test_kinds_under_prose_chrome(spark):
    rows, _ = site(40)
    notice = "We use cookies and similar means to keep this site running, and by reading on you agree to all of it. " * 4
    rows = [(*r[:3], f"{notice}\n\n{r[3]}", gzip.compress(gzip.decompress(r[4]).replace(b"<main>", f"<aside>\n<p>{notice}</p>\n</aside>\n<main>".encode())), *r[5:]) for r in rows]
    short = {k: "\n".join(KINDS[k].split("\n")[:4]) for k in ("list", "table", "junk")}
    extra = fetch_rows([(100 + i, "https://a.test/k", None, f"{notice}\n\n{t}", None, None, 200) for i, t in enumerate(short.values())])
    got = {r.fetch_id: r.kind for r in K.unreadable_records(spark.createDataFrame(rows + extra, FETCH)).collect()}
    assert got == {100: "list", 101: "table", 102: "junk"}


def test_best_path_against_brute_force():
    from itertools import product

    model = K.LineModel()
    rng = random.Random(3)
    for _ in range(20):
        codes = [rng.getrandbits(16) for _ in range(4)]

        def score(path):
            s = model.start[path[0]] + model.emit(codes[0])[path[0]]
            return s + sum(model.moves[a][b] + model.emit(c)[b] for a, b, c in zip(path, path[1:], codes[1:]))

        best = max(score(p) for p in product(range(4), repeat=4))
        assert abs(score(model.states(codes)) - best) < 1e-9
