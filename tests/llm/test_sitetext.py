import math
import time
from collections import Counter, defaultdict

import pytest

from traitloom.llm import sitetext

CASES = [
    (None, ""),
    ("", ""),
    ("just  text &amp; more", "just text & more"),
    ("<p>One<p>Two <b>bold<br>line</b><p><i>left open<p>Three", "One\nTwo bold line\nleft open\nThree"),
    ("<script>var a='<p>x</p>';</script><style>p{}</style><p>a&nbsp;b&#8217;s &lt;p&gt;</p><!-- <p>no</p> -->", "a b’s <p>"),
    ("<html><head><title>T</title></head><body><nav>menu</nav><header>top</header><p>body</p><footer>foot</footer>", "body"),
    ("<body><p>lead</p><article><header><h1>Title</h1></header><p>one</p><aside>side</aside><div class='share-bar'>share</div><p>two</p><section id=comments><article class=comment>hi</article></section></article><p>tail</p>", "Title\none\ntwo"),
    ("<main><div class='cookie-notice'>accept</div><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></main>junk", "a\nb\nc\nd"),
    ("<div id=wrap><div class=sidebar>x</div><div class='post-content has-sidebar'>the text<div>more</div></div></div>", "the text\nmore"),
    ("<article><p title=\"a > b\">x</p><form>f</form><div hidden>h</div><p>y", "x\ny"),
    ("<p>unclosed comment <!-- <p>gone", "unclosed comment"),
    ("<ul><li><a href='/a'>x</a></li></ul><p>a < b and c > d</p>", "x\na < b and c > d"),
    ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
    ("<p>one <a title=\"left open>two</a> three</p>", "one two three"),
    ("<p>one<a href='x", "one"),
    ("<ul><li>a<ul><li>b<div>c</ul><li>d</ul>e", "a\nb\nc\nd\ne"),
    ("<i><div>x</i>y</div>z", "xy\nz"),
]


@pytest.mark.parametrize("html, text", CASES)
def test_extract(html, text):
    assert sitetext.extract(html, set())[0] == text


HOSTILE = ["<a ", '<a x="', "<!--", "<title>", "<p title='", "<div>", "<div></p>", "<b><hr>", "<ul><b><li>", "<article>", "<i></b>", "<a b=c", "< a"]


@pytest.mark.parametrize("piece", HOSTILE)
def test_time_grows_with_the_page(piece):
    page = piece * (300_000 // len(piece))
    start = time.perf_counter()
    sitetext.subtrees(page)
    sitetext.extract(page, {1})
    assert time.perf_counter() - start < 8


def page(n, host, body):
    return (n, f"https://{host}/p/{n}", body)


def site(n):
    menu = "".join(f"<li><a href='/{n}/{k}'>entry {chr(97 + (n * 7 + k) % 26)}{n % 5}</a></li>" for k in range(4 + n % 2))
    banner = f"<div class=x>Seen {n} times <span>every day</span></div>"
    return f"<html><body><div class=y1><ul>{menu}</ul></div>{banner}<div class=y><p>own words of page {chr(97 + n)} {'and more ' * 20}</p></div>"


def test_templates_are_found_per_host(spark):
    body = lambda n: site(n) + f"<div class=z>tail {chr(97 + n % 2)}</div>"
    rows = [page(n, "a.example", body(n)) for n in range(20)] + [page(100 + n, "b.example", body(n)) for n in range(3)]
    rows += [(200, None, "<p>no url</p>"), (201, "https://a.example/", None), (0, "https://a.example/p/0", body(0))]
    article = "<article><p>a passage quoted by all</p><div class=x>Brought to you</div><p>own</p><p>{'long text ' * 30}</p></article>"
    rows += [page(300 + n, "c.example", article.replace("own", f"own {'w' * (n + 1)} {'long text ' * 9}")) for n in range(8)]
    rows += [page(400 + n, "d.example", "<div><p>one page many times</p><p>and again</p></div>") for n in range(30)]
    pages = spark.createDataFrame([(*r, "old", 1) for r in rows], "page_id long, url string, html string, text string, _deleted int")
    out = sitetext.main_text(pages)
    assert sorted(out.columns) == ["_deleted", "html", "page_id", "text", "url"]
    got = {}
    for r in out.collect():
        got.setdefault(r.page_id, []).append(r)
    assert len(got) == len(rows) - 1 and len(got[0]) == 2 and got[0][0] == got[0][1]
    for n in range(20):  # no name says what the menu, the banner and the tail are: counts alone delete them
        assert got[n][0].text == f"own words of page {chr(97 + n)} {'and more ' * 20}".strip()
        assert got[n][0]._deleted.by_count > 30 and got[n][0]._deleted.by_name == 0
        assert "Seen" in sitetext.extract(body(n), set())[0]
    assert got[102][0].text.startswith("entry") and got[102][0].text.endswith("tail a")  # three pages show no template
    assert got[303][0].text.startswith("a passage quoted by all\nown wwww") and "Brought" not in got[303][0].text
    assert got[200][0].text == "no url" and got[201][0].text == ""
    assert {got[n][0].text for n in range(400, 430)} == {"one page many times\nand again"}  # copies of one page are no site
    assert sitetext.main_text(pages.limit(0)).count() == 0


def test_counts_are_those_of_brute_force(spark):
    rows = [page(n, f"{'ab'[n % 3 == 0]}.example", site(n % 23)) for n in range(60)] + [(90, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    on, bits, sizes = Counter(), defaultdict(set), Counter()
    for _, url, html in rows:
        name = url.split("/")[2] if url else ""
        sizes[name] += 1
        content, keys, lists = sitetext.subtrees(html)
        for key in [(name, k, False) for k in keys] + [(name, k, True) for k in lists]:
            on[key] += 1
            bits[key].add(content)
    least = sitetext.LEAST_PAGES
    want = {(*k, n, len(bits[k]), sizes[k[0]]) for k, n in on.items() if n >= least}
    got = {(r.host, r.key, r.listed, r.on, r.contents, r.pages) for r in sitetext.subtree_counts(pages).collect()}
    assert got == want and any(k[2] for k in got)
    kept = defaultdict(set)
    for host, key, listed, n, contents, size in want:
        need = max(least, math.sqrt(size))
        if n >= (max(need, sitetext.LIST_SHARE * size) if listed else need) and contents >= min(need, sitetext.CONTENTS):
            kept[host].add(key)
    assert {r.host: set(r.templates) for r in sitetext.site_templates(pages).collect()} == kept and len(kept) == 2


def test_site_templates_on_the_tables(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    hosts = {r.host for r in pages.groupBy(sitetext.host(pages.url).alias("host")).count().where(f"count >= {sitetext.LEAST_PAGES}").collect()}
    found = {r.host for r in sitetext.site_templates(pages).collect()}
    assert found <= hosts and len(found) >= 0.8 * len(hosts)


@pytest.mark.parametrize("markup", [
    '<h2 id="related-work">kept</h2>', '<h2 id="social-history">kept</h2>', '<section id="comment-on-the-law"><p>kept</p></section>', '<p class="notice-period">kept</p>',
    '<div class="market-share"><p>kept</p></div>', '<figure class="banner-year"><figcaption>kept</figcaption></figure>', '<ul><li class="share">kept</li></ul>', '<div class="has-sidebar"><p>kept</p></div>',
])
def test_names_inside_an_article_that_keep_their_text(markup):
    assert sitetext.extract(f"<body><article><p>before</p>{markup}</article></body>", set())[0] == "before\nkept"


@pytest.mark.parametrize("markup", [
    '<div class="share-buttons"><p>gone</p></div>', '<div class="ad"><p>gone</p></div>', '<section id="related-posts"><p>gone</p></section>', '<div class="cookieNotice"><p>gone</p></div>', '<div class="x comment-list"><p>gone</p></div>',
    '<div id="ad-slot-3"><p>gone</p></div>', '<form><p>gone</p></form>',
])
def test_names_inside_an_article_that_go(markup):
    assert sitetext.extract(f"<body><article><p>before</p>{markup}</article></body>", set())[0] == "before"


@pytest.mark.parametrize("body", ["<article><p>kept</p></article>", '<div class="content"><p>kept</p></div>', "<main><p>kept</p></main>"])
def test_a_form_around_the_page(body):
    page = f'<body><form id="page"><nav><a href="/">home</a></nav>{body}<input value="x"><button>go</button></form></body>'
    assert sitetext.extract(page, set())[0] == "kept"


def test_nested_forms_take_linear_time():
    begin = time.time()
    assert sitetext.extract("<form>" * 60_000 + "<article><p>kept</p></article>", set())[0] == "kept"
    sitetext.extract("<form><p>x</p>" * 40_000, set())
    assert time.time() - begin < 20


def test_counts_decide_the_text_on_the_tables(spark):
    """Every host of these tables has templates: without them the menus, adverts and footers stay on nearly every page, and
    with them the text is what the markup's names give where it is marked as well as here."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    templates = {r.host: set(r.templates) for r in sitetext.site_templates(pages).collect()}
    rows = pages.select(sitetext.host(pages.url).alias("host"), "html").collect()
    counted = [r for r in rows if templates.get(r.host)]
    assert len(counted) > 0.9 * len(rows)
    changed = 0
    for r in counted:
        text = sitetext.extract(r.html, templates[r.host])[0]
        changed += text != sitetext.extract(r.html, set(), by_count=True)[0]
        assert text == sitetext.extract(r.html, set())[0]
    assert changed > 0.9 * len(counted)


def test_places_are_counted_whatever_they_say(spark):
    """An advert, a footer and comments that say something else on every page go by their place; a place on too few pages
    of a counted host, and a name on no counted place, stay."""
    def one(n):
        odd = "<div class='promo'>once</div>" if n == 7 else ""
        own = "".join(chr(97 + (n * 7 + k) % 26) for k in range(n + 3))
        return f"<body><ul class=top><li>home</li><li>news</li></ul><div class='ad box-{n}'>buy {own}</div><p>{own} and much more of its own {own}</p>{odd}<div id=comments><p>{own} says hello</p></div><form><input> search</form><footer>{own}</footer></body>"

    pages = spark.createDataFrame([page(n, "a.example", one(n)) for n in range(12)], "page_id long, url string, html string")
    for r in sitetext.main_text(pages).collect():
        own = "".join(chr(97 + (r.page_id * 7 + k) % 26) for k in range(r.page_id + 3))
        assert r.text == f"{own} and much more of its own {own}" + ("\nonce" if r.page_id == 7 else "")
