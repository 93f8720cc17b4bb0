import hashlib
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuscle.llm import chat, html_extract, urls

T = chat.ChatTemplate()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "sy\nstem<|"]), st.text(alphabet=list("<|>s/[INST]\\n \n👍_imendx"), max_size=40)), max_size=6))
def test_template_round_trip(turns):
    text, mask = T.render(turns)
    assert T.read(text) == turns
    assert [T.unescape(text[a:b]) for a, b in mask] == [t for r, t in turns if r == "assistant"]


def test_control_strings_never_stay_bare():
    for c in T.control:
        assert c not in T.escape(f"a{c}b{c}{c}")
        assert T.unescape(T.escape(c)) == c


CONVERSATIONS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "a <|im_end|> b"), (1, 2, "user", None), (1, 2, "assistant", "tie"), (2, 5, "assistant", ""),
    (3, None, "user", "first"), (3, 0, "assistant", "x"), (3, 0, "assistant", "x"), (None, 0, "user", "lost"), (4, 0, None, "no role"),
    *[(9, i, ("user", "assistant")[i % 2], f"turn {i} \\ [INST]") for i in range(70)],
]


def digest(turns):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


def test_table_to_conversations(spark):
    df = spark.createDataFrame(CONVERSATIONS, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_table(df)).collect()}
    by: dict = {}
    for c, t, r, x in sorted(CONVERSATIONS, key=lambda r: (r[0] or -1, -1 if r[1] is None else r[1], r[2] or "")):
        by.setdefault(c, []).append((r or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        learned = "".join(t for r, t in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["turns_sha256"] == digest(turns)
        assert got[c]["loss_chars"] == len(learned) and got[c]["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest()
        assert got[c]["formatted_chars"] == len(T.render(turns)[0])
    empty = spark.createDataFrame([], df.schema)
    assert chat.read_back(chat.format_table(empty)).count() == 0


def test_best_branch_of_a_tree(spark):
    rows = [
        ("t", "r", None, "user", "question", 1.0), ("t", "a", "r", "assistant", "weak", 0.1), ("t", "b", "r", "assistant", "good", 0.9),
        ("t", "c", "b", "user", "thanks", 0.5), ("t", "d", "a", "user", "hm", 0.9), ("u", "x", "gone", "user", "orphan", None),
        ("v", "p", "q", "user", "cycle", 1.0), ("v", "q", "p", "user", "cycle", 1.0),
    ]
    df = spark.createDataFrame(rows, "tree string, id string, up string, role string, text string, score double")
    nodes = chat.reply_nodes(df, "tree", "id", "up", "role", "text", "score")
    one = {r["conv_id"]: T.read(r["formatted"]) for r in chat.format_conversations(nodes).collect()}
    assert one == {"t": [("user", "question"), ("assistant", "good"), ("user", "thanks")], "u": [("user", "orphan")]}
    assert chat.format_conversations(nodes, per_tree=5).where("conv_id = 't'").count() == 2


URLS = [
    None, "", "no scheme", "HTTP://Example.NET/en/x?q#f", "https://a.example.net/en", "https://b.net/", "http://b.net", "http://example.com/de/1", "http://www.example.com/de/?x",
    "http://notexample.com/de/1", "http://x.org/fr/1", "http://org/fr/", "ftp://casino-win.example.org/en?x=1&y=2", "http://u:p@h.net:80/a", "//net/", "http://ex.net?/en/",
]
RULES = [urls.Rule("net/", False), urls.Rule("example.net/en/", True), urls.Rule("example.com/de/", False), urls.Rule("org/fr/", True)]


def slow_url(u):
    if not u or "://" not in u:
        return "", "", None
    rest = u.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:cut].lower(), rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    best = None
    for r in RULES:
        h, p = r.pattern.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(r.pattern) > len(best.pattern)):
            best = r
    return host, path, best


def some_urls():
    good = [f"https://{w}.site{i % 9}.example.com/en/{i}" for i in range(150) for w in ("blog", "www")]
    return good + [f"http://{w}-{i % 5}.example.com/p{i}?a=1&b={i}" for i in range(60) for w in ("cheap-pills", "casino")]


def test_url_rules_and_model(spark):
    model = urls.train(urls.label_by_words(spark.createDataFrame([(u,) for u in some_urls()], "url string")))
    df = spark.createDataFrame([(i, u, "clash", 1.0) for i, u in enumerate(URLS)], "page_id long, url string, host string, depth double")
    for r in urls.filter_urls(df, RULES, model).collect():
        host, path, rule = slow_url(r["url"])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule and rule.pattern)
        if rule:
            assert r["verdict"] == ("allow" if rule.allow else "block")
        assert r["depth"] == 1.0
    fresh = [f"https://news.site{i % 9}.example.com/en/9{i}" for i in range(40)] + [f"http://cheap-pills-{i % 5}.example.com/q{i}?a=2&b=3" for i in range(40)]
    judged = urls.filter_urls(spark.createDataFrame([(u,) for u in fresh], "url string"), [], model).collect()
    assert sum((r["verdict"] == "block") == ("pills" in r["url"]) for r in judged) >= 76


def test_url_model_of_one_class_and_empty(spark):
    model = urls.train(urls.label_by_words(spark.createDataFrame([("http://a.b/",)], "url string")))
    df = spark.createDataFrame([(None,), ("http://c.net/",)], "url string")
    assert [r["verdict"] for r in urls.filter_urls(df, RULES, model).orderBy("url").collect()] == ["allow", "block"]
    assert urls.train(df.limit(0).selectExpr("url", "0.0 label")).prior == 0.0
    assert urls.filter_urls(df.limit(0), RULES, model).count() == 0


def test_suffix_rates_count_every_row(spark):
    rows = [(f"http://{'casino' if i % 5 == 0 else 'blog'}.h{i}.org/{k}", float(i % 5 == 0)) for i in range(400) for k in range(3)]
    model = urls.train(spark.createDataFrame(rows, "url string, label double"), rows=60)
    rates = {r["suffix"]: r["rate"] for r in model.suffix_rates.collect()}
    assert model.prior == 0.2 and set(rates) >= {f"h{i}.org" for i in range(400)}
    assert all(rates[f"h{i}.org"] == pytest.approx(((i % 5 == 0) * 3 + 0.2) / 4) for i in range(400)) and rates["org"] == pytest.approx((240 + 0.2) / 1201)
    df = spark.createDataFrame([(u,) for u, _ in rows] + [(None,), ("x",), ("http://new.net/",)], "url string")
    broadcast = {r["url"]: r["p"] for r in model.score(df, out="p").collect()}
    model.small = False
    salted = model.score(df, out="p").collect()
    assert len(salted) == len(rows) + 3 and {r["url"]: r["p"] for r in salted} == broadcast


def test_path_entropy_of_the_whole_path(spark):
    paths = ["/" + "a" * 1999 + "b" * 2000, "/é😀?", ""]
    got = urls.with_lexical(spark.createDataFrame([(i, f"http://h.org{p}") for i, p in enumerate(paths)], "i int, url string")).orderBy("i").collect()

    def slow(t):
        return -sum(t.count(c) / len(t) * math.log2(t.count(c) / len(t)) for c in set(t))

    assert [r["path_entropy"] for r in got] == pytest.approx([slow(paths[0]), slow("/é😀"), 0.0])


PAGE = (
    '<!DOCTYPE html><html><head><title>t</title><script>var a="</p>";</script></head><body class="has-sidebar"><nav><ul><li><a href=x>Home</a></li></ul></nav>'
    '<div class="cookie-notice">We use cookies</div><article class="post"><h1>Head &amp; more</h1><p><b>Bold<br>text<p>Second\n  para &lt;x&gt; &#233;</p>'
    '<div class="ad">Buy</div><aside>aside</aside><ul><li>one<li>two</ul><form><input>Send</form><div id="comments"><p>nice post</p></div></article>'
    '<div class="sidebar">side</div><footer>foot</footer></body></html><p unclosed="'
)


@pytest.mark.parametrize(
    "html, text",
    [
        (PAGE, "Head & more\nBold text\nSecond para <x> é\none\ntwo"), (None, ""), ("", ""), ("plain", "plain"), ("a < b and c > d &am", "a < b and c > d &am"),
        ("<p>a<p>b</p></p>c", "a\nb\nc"), ("<div>x<!-- no --> y</div", "x y"), ("<main><p>m</p></main><p>out</p>", "m"), ("<script>x", ""), ("</p></div>", ""),
        ("<p>t</p><style>p{}</style><p>u</p>", "t\nu"), ("<ul><li><a>l</a></li></ul><p>k <a>z</a></p>", "k z"), ("<article><header><h1>T</h1></header><p>p</article>", "T\np"),
    ],
)
def test_extract_one(html, text):
    assert html_extract.extract(html) == text


@pytest.mark.parametrize(
    "html, text",
    [
        ('<p class="a"">Hello</p><p>rest</p>', "Hello\nrest"), ("<p title=it's>Hello</p><p>rest</p>", "Hello\nrest"), ('<p>a <a title="5" tall">b</a></p><p>rest</p>', "a b\nrest"),
        ('<p title="5 tall>Hello</p><p>rest</p>', "Hello\nrest"), ('<p>x</p><p title="a>b">y</p><p alt=\'c>d\' id = "e>f">z</p>', "x\ny\nz"), ('<p a=x"y>k</p><p>rest</p>', "k\nrest"),
        ('<p title="5>a</p><p id="b>rest</p>', 'rest'), ("<div class=it's-nav>n</div><p>rest</p>", "rest"), ("<p>a</é><p>rest</p>", "a\nrest"), ('<p>a</p><i x=">"<p>rest</p>', 'a\nrest'),
        *[(f"<p>a</p><{t} id=x><p>rest</p>", "a\nrest") for t in ("svg", "math", "select", "object", "template", "noscript")],
        ("<p>a</p><svg><p>no</p></svg><p>b</p><svg><p>rest</p>", "a\nb\nrest"), ("<p>a</p><style><p>no</p>", "a"),
    ],
)
def test_no_rest_of_a_page_is_lost(html, text):
    assert html_extract.extract(html) == text


def test_unclosed_elements_are_linear():
    import time

    began = time.time()
    html_extract.extract("<svg><p>x " * 50_000)
    html_extract.extract("<i x=\">\" " * 50_000)
    assert time.time() - began < 20


def test_style_tree_removes_templates(spark):
    rows = [
        (i, f"https://h{i % 2}.example.org/{i}", f"<html><body><div class='top'>Same on every page</div><div class='c'><p>own text {i}</p><p>{'more ' * (i % 4)}{i}</p></div><div class='b'>Always</div></body></html>", "x")
        for i in range(40)
    ] + [(99, None, None, "x"), (99, None, None, "x"), (98, "https://alone.org/", "<div class='top'>Same on every page</div>", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = html_extract.extract_main_text(df)
    got = {r["page_id"]: r["text"] for r in out.collect()}
    assert out.columns == ["page_id", "url", "text"] and out.count() == len(rows)
    assert got[7] == "own text 7\nmore more more 7" and got[98] == "Same on every page" and got[99] == ""
    assert html_extract.extract_main_text(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [2, 3, 7])
def test_style_tree_judges_hosts_of_few_pages(spark, n):
    rows = [(i, f"https://few.org/{i}", f"<html><body><div class='top'>Same on every page</div><div class='c'><p>own text {i}</p></div><div>Always</div></body></html>") for i in range(n)]
    out = html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r["page_id"]: r["text"] for r in out.collect()} == {i: f"own text {i}" for i in range(n)}


def test_long_page_is_linear():
    import time

    began = time.time()
    html_extract.extract("<a \"" * 200_000)
    html_extract.extract("<p>x " * 100_000 + "<div>" * 3000)
    assert time.time() - began < 20


def slow_importance(pages, gamma=html_extract.GAMMA):
    """host -> {node: (pages, importance)} by walking every page again for every node."""
    out = {}
    for host in {h for h, _ in pages}:
        parsed = [html_extract.parse(t or "") for h, t in pages if h == host]
        looks, found = {}, {}
        for node in {x for _, styles in parsed for x in styles}:
            seen = [styles[node] for _, styles in parsed if node in styles]
            looks[node] = len(seen), -sum(seen.count(s) / len(seen) * math.log(seen.count(s) / len(seen), len(seen)) for s in set(seen)) if len(seen) > 1 else 0.0
        for node in {b.paths[-1] for blocks, _ in parsed for b in blocks if b.paths}:
            texts = [t for blocks, _ in parsed for t in {b.text for b in blocks if b.paths and b.paths[-1] == node}]
            over = {x for blocks, _ in parsed for b in blocks if b.paths and b.paths[-1] == node for x in b.paths}
            n = looks[node][0]
            if n == 1:
                found[node] = 1, 1.0
                continue
            spread = sum(math.log(texts.count(t)) / math.log(n) for t in texts) / len(texts)
            found[node] = n, gamma * (1 - spread) + (1 - gamma) * max(looks[x][1] for x in over)
        out[host] = found
    return out


def varied_pages():
    rows = []
    for i in range(30):
        body = "".join(f"<p>{'text ' * (j + 1)}{i}.{j}</p>" + ("<ul><li>x<li>y</ul>" if (i + j) % 4 == 0 else "") for j in range(i % 7 + 1))
        rows.append((f"h{i % 3}", f"<div class='m z a b c'><i>menu {i % 5}</i></div><div class='k'><h1>{i}</h1>{body}</div><div>notice</div>"))
    return [*rows, ("", None), ("", ""), ("one", "<p>alone</p>"), rows[0], rows[0]]


def test_importance_as_a_slow_version_gives_it(spark):
    rows = varied_pages()
    got = html_extract.importance(html_extract.tree_counts(spark.createDataFrame(rows, "host string, html string").repartition(3))).collect()
    want = {(h, node): v for h, found in slow_importance(rows).items() for node, v in found.items()}
    assert {(r["host"], r["node"]) for r in got} == set(want)
    for r in got:
        pages, worth = want[r["host"], r["node"]]
        assert r["pages"] == pages and r["importance"] == pytest.approx(worth, abs=1e-9)


def test_the_tree_alone_tells_menus_from_articles(spark):
    rows = [(i, "http://s.org/", f"<ul class=nav><li>go {i % 4}</ul><div><p>{i} a</p>" + "<p>more and more %d</p>" % i * (i % 9) + f"</div><span>tail {i % 3}</span>") for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for r in html_extract.extract_main_text(df, roles=False).collect():
        assert r["text"].startswith(f"{r['page_id']} a") and "go" not in r["text"]


@pytest.mark.parametrize("hot", [1, 10**6])
def test_hot_join(spark, hot):
    from corpuscle.llm.common import hot_join

    rows = spark.createDataFrame([(k, i) for i in range(60) for k in (1, 1, 1, 2, None, 9)], "k long, i long")
    table = spark.createDataFrame([(1, 180, "a", 0), (2, 60, None, 5), (3, 7, "c", 1)], "k long, n long, x string, y long")
    got = sorted(map(tuple, hot_join(rows, table, "k", "n", 400, hot).collect()), key=str)
    assert got == sorted([(k, i, *{1: ("a", 0), 2: (None, 5)}.get(k, (None, None))) for i in range(60) for k in (1, 1, 1, 2, None, 9)], key=str)


def test_the_tree_alone_decides_on_hosts_of_many_pages(spark):
    """Names say the opposite of what the pages do: the "article" repeats, the "sidebar" is what each page says."""

    def page(i):
        body = " ".join(f"word{i}x{j}" for j in range(40))
        return f"<html><body><div class='x1'>Home Products About</div><article>Buy our goods today</article><div class='sidebar'><p>{body}</p><p>second {body}</p></div></body></html>"

    def texts(n, **options):
        pages = spark.createDataFrame([(i, f"http://many.example/{i}", page(i)) for i in range(n)], "page_id long, url string, html string")
        return {r["page_id"]: r["text"] for r in html_extract.extract_main_text(pages, **options).collect()}

    want = {i: "\n".join(p for p in (" ".join(f"word{i}x{j}" for j in range(40)), "second " + " ".join(f"word{i}x{j}" for j in range(40)))) for i in range(20)}
    assert texts(20) == want
    assert texts(20, tree_pages=21) != want
    assert texts(4) == texts(4, tree_pages=5) != {i: want[i] for i in range(4)}
