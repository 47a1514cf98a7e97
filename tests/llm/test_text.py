from collections import Counter

import numpy as np
import pytest

from geoframe.llm import extract, mixing, quality, queries, toxicity, url_filter


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


@pytest.mark.parametrize(("module", "label", "least"), [(quality, "quality", 0.9), (toxicity, "toxic", 0.9)])
def test_classifiers_on_held_out_rows(spark, module, label, least):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    scored = module.classify(docs, labels).toPandas()
    assert len(scored) == docs.count() and scored.score.between(0, 1).all()
    both = scored.merge(labels.toPandas(), on="doc_id")
    both = both[both.held_out]
    assert (both.predicted == both[label]).mean() >= least


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifiers_edges(spark, module):
    label = "quality" if module is quality else "toxic"
    schema = "stats string, doc_id long, text string, score int, label string"
    rows = [("", 1, None, 0, ""), ("", 2, "", 0, ""), ("", None, "x" * 300_000, 0, ""), ("", 3, "a b", 0, ""), ("", 3, "a b", 0, "")]
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 0), (2, 1)], f"doc_id long, {label} int")
    got = module.classify(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert module.classify(docs.limit(0), labels.limit(0)).collect() == []
    keep = module.keep_good if module is quality else module.keep_civil
    assert keep(docs, labels).columns == docs.columns


def test_statistics_of_slices_agree():
    texts = [b"Some Words here!!\nSome Words here!!\n", b"", b"a|b | c %%% d", "é ß".encode(), b"   "]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    whole = quality.statistics(data, offsets)
    for i, t in enumerate(texts):
        np.testing.assert_allclose(whole[i], quality.statistics(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0])


def test_statistics_dont_depend_on_neighbours():
    texts = [b"", b"Hello World!!! ABC|", b"", b"|x", b"||", b"\n", b"x"]
    alone = {t: quality.statistics(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts}
    rng = np.random.default_rng(0)
    for _ in range(300):
        row = [texts[i] for i in rng.integers(0, len(texts), int(rng.integers(1, 6)))]
        got = quality.statistics(np.frombuffer(b"".join(row), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in row])]))
        for t, g in zip(row, got, strict=True):
            np.testing.assert_array_equal(g, alone[t])


def test_discriminant_against_plain_gaussians():
    rng = np.random.default_rng(3)
    x = {y: rng.normal(size=(n, 4)) @ rng.normal(size=(4, 4)) + 2 * y for y, n in ((0, 300), (1, 120))}
    model = quality.Discriminant({y: (len(v), v.sum(0), v.T @ v) for y, v in x.items()}, shrink=0.2, ridge=1e-2)
    n = {y: len(v) for y, v in x.items()}
    own = {y: np.cov(v.T, bias=True) for y, v in x.items()}
    pooled = sum(n[y] * own[y] for y in x) / sum(n.values())
    diagonal = np.diag(np.diag(pooled))
    asked = rng.normal(size=(50, 4)) * 3
    density = {}
    for y in x:
        c = 0.8 * own[y] + 0.1 * pooled + 0.1 * diagonal + 1e-2 * diagonal
        d = asked - x[y].mean(0)
        density[y] = np.log(n[y] / sum(n.values())) - np.linalg.slogdet(c)[1] / 2 - (d * np.linalg.solve(c, d.T).T).sum(1) / 2
    np.testing.assert_allclose(model.scores(asked), 1 / (1 + np.exp(np.clip(density[0] - density[1], -60, 60))), rtol=1e-8)


def test_quality_query_against_one_pass(spark, sf):
    """The query's scores are those of one model over all labelled rows outside the fold, fitted here in one piece."""
    import zlib

    docs, labels = table(spark, sf, "documents").toPandas(), table(spark, sf, "labels").toPandas()
    fold = {d: zlib.crc32(str(d).encode()) % 5 == 0 for d in docs.doc_id}
    truth = {r.doc_id: int(r.quality) for r in labels.itertuples() if r.quality in (0, 1)}
    stats = {d: quality.statistics(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())]))[0] for d, t in zip(docs.doc_id, docs.text, strict=True)}
    taught = {y: np.stack([stats[d] for d in docs.doc_id if truth.get(d) == y and not fold[d]]) for y in (0, 1)}
    model = quality.Discriminant({y: (len(v), v.sum(0), v.T @ v) for y, v in taught.items()})
    got = queries.op1_quality_classifier(spark, sf).toPandas()
    assert sorted(got.doc_id) == sorted(docs.doc_id) and all(got.held_out == got.doc_id.map(fold))
    np.testing.assert_allclose(got.score, model.scores(np.stack([stats[d] for d in got.doc_id])), atol=1e-7)
    assert (got.predicted == (got.score >= 0.3)).all()


def test_toxic_dictionary_finds_what_toxic_texts_share():
    plain = [f"the quiet garden number {i} has word{i} and stone{i}".encode() for i in range(200)]
    toxic = [f"you are a grumpelwort{i % 3} number {i} in garden{i * 7}".encode() for i in range(60)]
    model = toxicity.train(toxic, plain, 0.2)
    assert b"grumpel" in model.toxic and b"grumpel" not in model.ordinary
    scores = model.scores([b"some grumpelwort9 here", b"some garden here", b""])
    assert scores[0] > 0.5 > scores[1] and scores[2] < 0.5


def test_toxicity_recall_and_precision():
    """Planted words in two thirds of the toxic rows and in no other; a third of the toxic labels is noise, which costs some clean texts."""
    rng = np.random.default_rng(4)
    syllables = ["ba", "den", "ki", "lor", "mu", "sta", "ver", "tion", "ou", "re"]
    word = lambda: "".join(syllables[i] for i in rng.integers(0, 10, int(rng.integers(1, 5))))
    planted = ["zwiffelhund", "quagmartic", "xenobrute", "jabbelwock"]

    def text(bad):
        words = [word() for _ in range(int(rng.integers(60, 200)))]
        for _ in range(5 if bad else 0):
            words.insert(int(rng.integers(0, len(words))), planted[int(rng.integers(0, 4))])
        return " ".join(words).encode()

    model = toxicity.train([text(i % 3 > 0) for i in range(300)], [text(False) for _ in range(900)], 0.25)
    bad, good = model.scores([text(True) for _ in range(200)]) >= 0.5, model.scores([text(False) for _ in range(200)]) >= 0.5
    assert bad.mean() >= 0.95 and good.mean() <= 0.05


def test_toxicity_held_out_recall_and_precision(spark):
    """Of the held-out rows whose label isn't noise (their text has a word that a tenth of the toxic rows and no other row have)."""
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    both = toxicity.classify(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").join(docs.select("doc_id", "text"), "doc_id").filter("toxic is not null").toPandas()
    words = [set(t.lower().split()) if t else set() for t in both.text]
    count = [Counter(w for ws, y in zip(words, both.toxic, strict=True) if y == k for w in ws) for k in (0, 1)]
    telling = {w for w, n in count[1].items() if n >= 0.1 * both.toxic.sum() and not count[0][w]}
    planted = np.array([bool(ws & telling) for ws in words])
    held = both.held_out.to_numpy()
    assert len(telling) >= 8 and both.predicted[held & planted].mean() >= 0.9
    assert both.predicted[held & (both.toxic == 0)].mean() <= 0.015
    found = both[held & (both.predicted == 1)]
    assert found.toxic.mean() >= 0.85


def test_toxicity_scores_against_window_by_window():
    """The arrays' scores are those of compressing each window by itself."""
    plain = [f"the quiet garden number {i} has word{i} and stone{i}".encode() for i in range(100)]
    toxic = [f"you are a grumpelwort{i % 3} number {i} in garden{i * 7}".encode() for i in range(40)]
    model = toxicity.train(toxic, plain, 0.3)
    texts = [b"", b"A grumpelwort1", b"one two three four GRUMPELWORT2 six seven", b"x" * 3000, toxic[0], plain[0]]
    one, two = (toxicity._compressor(d + toxicity.ANCHOR) for d in (model.ordinary + toxicity.FILLER * len(model.toxic), model.ordinary + model.toxic))
    for t, got in zip(texts, model.scores(texts), strict=True):
        words = t.lower().split()
        found = []
        for pair in dict.fromkeys(tuple(words[i : i + 2]) for i in range(0, len(words), 2)):
            w = toxicity.ANCHOR + b" " + b" ".join(pair) + b" " + toxicity.ANCHOR
            found.append(len(one.compress(w)) - len(two.compress(w)))
        x = [1.0]
        for level in toxicity.LEVELS:
            hits = sum(d >= level for d in found)
            x += [np.log1p(hits), np.log1p(1000 * hits / max(1, len(found)))]
        assert abs(1 / (1 + np.exp(-np.dot(x, model.weights))) - got) < 1e-9


def judge(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:]
        path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    best = None
    for r in rules:
        if host and (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path) and (best is None or (len(r.host) + len(r.path), len(r.host)) > (len(best.host) + len(best.path), len(best.host))):
            best = r
    return host, path, best and best.host + best.path, best.verdict if best else "allow"


def test_url_filter(spark, sf):
    rules = [*queries.URL_RULES, url_filter.Rule("block", "b.org", "/x"), url_filter.Rule("allow", "a.b.org", "/")]
    urls = [None, "", "no scheme", "http://", "https://EXAMPLE.org/es/1?x=/de/", "http://example.org/en/1#a", "ftp://x.example.org/en/12", "http://org", "http://org/", "http://notexample.org/es/", "http://a.com/fr", "http://a.com/de/", "a://b://c.com/de/", "http://a.b.org/x", "http://z.a.b.org/x\ny?", "http://b.org/x", "http://com?/de/", "http://É.org/"]
    rows = [(i, u, "h", "r") for i, u in enumerate(urls)] + [(3, "http://", "h", "r")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    got = sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in url_filter.filter_urls(df, rules).collect())
    assert got == sorted((i, *((x or "") for x in judge(u, rules))) for i, u, _, _ in rows)
    pages = table(spark, sf, "pages")
    got = sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in queries.op8_url_filter(spark, sf).collect())
    assert got == sorted((r.page_id, *((x or "") for x in judge(r.url, queries.URL_RULES))) for r in pages.collect())
    assert url_filter.filter_urls(df.limit(0), rules).collect() == []
    assert {r.verdict for r in url_filter.filter_urls(df, []).collect()} == {"allow"}


def test_url_filter_over_many_rules_and_levels(spark):
    """Some hundred rules against thousands of hosts: the second level holds what the first lets through."""
    rng = np.random.default_rng(6)
    name = lambda n: ".".join("".join(chr(97 + c) for c in rng.integers(0, 4, 2)) for _ in range(n))
    rules = [url_filter.Rule(str(rng.choice(["allow", "block"])), name(int(rng.integers(1, 4))), str(rng.choice(["/", "/a", "/a/b/"]))) for _ in range(300)]
    rules = list({(r.host, r.path): r for r in rules}.values())
    urls = [f"http://{name(int(rng.integers(1, 5)))}{rng.choice(['', '/', '/a/b/c', '/z?x'])}" for _ in range(3000)]
    df = spark.createDataFrame([(i, u, 5) for i, u in enumerate(urls)], "page_id long, url string, _hit int").repartition(3)
    got = url_filter.filter_urls(df, rules)
    assert got.columns == ["page_id", "url", "_hit", "host", "path", "rule", "verdict"]
    assert sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in got.collect()) == sorted((i, *((x or "") for x in judge(u, rules))) for i, u in enumerate(urls))


def test_rules_as_a_table_in_segments(spark, monkeypatch):
    """A level may have 2,048 bits: the rules are dealt into several segments."""
    rng = np.random.default_rng(8)
    name = lambda n: ".".join("".join(chr(97 + c) for c in rng.integers(0, 4, 2)) for _ in range(n))
    rules = [url_filter.Rule(str(rng.choice(["allow", "block"])), name(int(rng.integers(1, 4))), str(rng.choice(["/", "/a"]))) for _ in range(700)]
    rules = list({(r.host, r.path): r for r in rules}.values())
    urls = [f"http://{name(int(rng.integers(1, 5)))}{rng.choice(['', '/', '/a/b'])}" for _ in range(800)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    table_of = spark.createDataFrame([(r.verdict, r.host, r.path, 1) for r in rules] + [(None, "a", "/", 1), ("block", None, "/", 1)], "verdict string, host string, path string, extra int")
    want = sorted((i, *((x or "") for x in judge(u, rules))) for i, u in enumerate(urls))
    monkeypatch.setattr(url_filter, "MAX_BITS", 2048)
    got = url_filter.filter_urls(df, table_of)
    assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    assert sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in got.collect()) == want
    assert {r.verdict for r in url_filter.filter_urls(df, table_of.limit(0)).collect()} == {"allow"}


def test_a_million_rules(spark):
    table_of = spark.range(1_000_000).selectExpr("if(id % 2 = 0, 'block', 'allow') AS verdict", "concat('h', id, '.com') AS host", "'/' AS path")
    df = spark.range(2_000).selectExpr("id AS page_id", "concat('http://x.h', id * 997, '.com/y') AS url")
    got = url_filter.filter_urls(df, table_of)
    wrong = got.filter("rule IS DISTINCT FROM if(page_id * 997 < 1000000, concat('h', page_id * 997, '.com/'), null) OR verdict <> if(page_id * 997 < 1000000 AND page_id % 2 = 0, 'block', 'allow')")
    assert wrong.count() == 0 and got.filter("rule is not null").count() == 1004


def test_cascade_is_exact_over_its_keys(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "FIRST_LEVEL_ERROR", 0.3)
    monkeypatch.setattr(url_filter, "LATER_LEVEL_ERROR", 0.4)
    listed = spark.range(0, 300).selectExpr("concat('k', id) AS key")
    universe = spark.range(0, 3000).selectExpr("concat('k', id) AS key")
    cascade = url_filter.build_cascade(listed, universe)
    assert len(cascade.levels) > 2
    held = universe.filter(cascade.holds(universe["key"])).collect()
    assert {r.key for r in held} == {f"k{i}" for i in range(300)}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><header><a href="/">Site</a></header>
<nav><ul><li>Home<li>News {n}</ul></nav><div class="cookie-notice">We use cookies {n}</div><div class="share">Tell friends</div><div>Same on every page</div>
<article><h1>Title &amp; {n}</h1><p>First <b>bold {n}
 words</b> here.<br>More.<p>Second&nbsp;{n}<ul><li>one {n}</li><li>two</li></ul><form><input value="x">Search {n}</form>
<div class="comments"><p>Reader {n} says hi</p></div><script>if (a < b) "<p>no</p>"</script></article>
<aside>Also read {n}</aside><footer>&copy; {n}</footer></body></html>"""


def test_main_text(spark):
    rows = [(i, f"http://Host.example/{i}", PAGE.format(n=i)) for i in range(8)]
    rows += [(20, "http://b.example/", "plain text <p>para"), (21, None, "<p>x<p>y"), (22, "http://c.example/", None), (23, "http://c.example/", ""), (0, rows[0][1], rows[0][2]), (24, "http://d.example/", "<div>" * 300 + "deep" + "<p>" + "w " * 50_000), (25, "http://e.example", "<p>a</p><!-- open")]
    df = spark.createDataFrame([(*r, "z", "z") for r in rows], "page_id long, url string, html string, host string, fixed string").repartition(3)
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in extract.main_text(df).collect()), key=str)

    def want(i):
        return f"Title & {i}\nFirst bold {i} words here. More.\nSecond {i}\none {i}\ntwo"

    texts = {i: want(i) for i in range(8)} | {20: "plain text\npara", 21: "x\ny", 22: "", 23: "", 24: "deep\n" + " ".join("w" * 50_000), 25: "a"}
    assert got == sorted(((i, u, texts[i], len(texts[i])) for i, u, _ in rows), key=str)
    assert extract.main_text(df.limit(0)).collect() == []


def test_template_by_alignment(spark):
    """Without marks of an article the slots that stay the same over a host's pages are left out."""
    pages = [(i, f"http://h.example/{i}", f"<body><div>Welcome</div>{'<div class=x>Extra</div>' if i % 2 else ''}<div class=k>Text {i} of the page<p>More {i * i}</div><div class=z>Imprint</div></body>") for i in range(9)]
    got = {r.page_id: r.text for r in extract.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Text {i} of the page\nMore {i * i}" for i in range(9)}


def test_blocks_below_any_depth(spark):
    deep = "<div>" * 80 + "inner" + "<nav>menu</nav>" + "</div>" * 80
    pages = [(1, "http://h.example/", f"<div><article>{deep}<p>after</p></article><p>outside</p></div>"), (2, "http://i.example/", "<div>" * 20_000 + "<aside>no</aside>yes" + "</div>" * 20_000 + "<p>end")]
    got = {r.page_id: r.text for r in extract.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {1: "inner\nafter", 2: "yes\nend"}


def test_template_after_many_runs(spark):
    pages = [(i, f"http://h.example/{i}", "<body>" + "".join(f"<h2>Head {i} {k}</h2><p>Text {i} {k}</p>" for k in range(150 + i % 2)) + "<div>Imprint</div></body>") for i in range(6)]
    for r in extract.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect():
        assert "Imprint" not in r.text and r.text.count("\n") == 2 * (150 + r.page_id % 2) - 1


def _unmarked(n, links=5):
    rng = np.random.default_rng(n)
    words = lambda k: " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, int(rng.integers(2, 9)))) for _ in range(k))
    title, ad, foot = words(6), words(9), words(7)
    paragraphs = [words(int(rng.integers(3, 60))) for _ in range(int(rng.integers(1, 9)))]
    menu = "".join(f"<div class=q><a href=/{k}>{words(1)}</a></div>" for k in range(links))
    page = f"<body><div class=xa>{menu}</div><div class=xb>{ad}</div><div class=xc><div class=xd>{title}</div>{''.join(f'<p>{p}</p>' for p in paragraphs)}</div><div class=xe>{foot}</div></body>"
    return page, "\n".join([title, *paragraphs])


def test_varying_menus_and_adverts_without_marks(spark, monkeypatch):
    """No class or element says what is what, and every slot varies: the host's weights tell the article."""
    pages = [(i, f"http://h.example/{i}", _unmarked(i)[0]) for i in range(30)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in extract.main_text(df).collect()} == {i: _unmarked(i)[1] for i in range(30)}


def test_text_comes_from_the_wrapper(spark, sf):
    """Without the wrappers' decisions no page has a text, and each page is that of a plain reading of its article."""
    import html
    import re

    pages = table(spark, sf, "pages")
    got = {r.page_id: r.text for r in queries.op9_main_text(spark, sf).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = re.split(r"</?(?:p|h1|div|ul|li)\b[^>]*>", article)
        plain = [" ".join(html.unescape(re.sub(r"</?(?:b|i|a|em|strong)\b[^>]*>", "", re.sub(r"<br\s*/?>", " ", b))).split()) for b in blocks]
        assert got[r.page_id] == "\n".join(p for p in plain if p)
    assert extract.content(extract.parse(pages.first().html), frozenset()) == ""


def test_menu_below_five_hundred_elements(spark):
    deep = lambda inner: "<div>" * 500 + inner + "</div>" * 500
    pages = [(i, f"http://h.example/{i}", f"<article>{deep(f'<nav>menu {i}</nav><p>deep {i}</p>')}<p>first {i}</p><p>last {i}</p></article>") for i in range(2)]
    got = {r.page_id: r.text for r in extract.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {i: f"deep {i}\nfirst {i}\nlast {i}" for i in range(2)}


def test_told_and_joined_wrappers_agree(spark, sf, monkeypatch):
    told = sorted(tuple(r) for r in queries.op9_main_text(spark, sf).collect())
    monkeypatch.setattr(extract, "TOLD_BYTES", -1)
    assert sorted(tuple(r) for r in queries.op9_main_text(spark, sf).collect()) == told


def test_tree_matching():
    t = extract.read_tree
    a, b = t("r(a(x,y),b,c)"), t("r(a(y),d,c)")
    assert extract.write_tree(a) == "r(a(x,y),b,c)" and extract.matching(a, b) == 4
    u = extract.unite(a, b)
    assert extract.write_tree(u) == "r(a(x,y),b,d,c)"
    assert extract.slots_of(b, u) == [0, 1, 3, 5, 6]


def test_mixing_hits_targets(spark):
    rng = np.random.default_rng(0)
    rows = [(i, "word " * int(rng.integers(1, 30)) + rng.choice(["gardening", "astronomy", "economics"]), ["s0", "s1", None][int(rng.choice(3, p=[0.6, 0.3, 0.1]))], str(rng.choice(["en", "de"])), "x") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, topic string").repartition(4)
    targets = {"source": {"s0": 0.4, "s1": 0.4, None: 0.2}, "lang": {"en": 0.7, "de": 0.3}}
    drawn = mixing.sample(docs, targets).toPandas()
    total = drawn._tokens.sum()
    share = drawn.assign(source=drawn.source.fillna("-")).groupby("source")._tokens.sum() / total
    assert abs(share["s0"] - 0.4) < 0.03 and abs(share["-"] - 0.2) < 0.03
    assert abs(drawn[drawn.lang == "en"]._tokens.sum() / total - 0.7) < 0.03
    _, cells = mixing.calibrated(docs, targets)
    c = cells.toPandas()
    c["fit"] = c.tokens * c.weight
    assert abs(c[c.lang == "en"].fit.sum() / c.fit.sum() - 0.7) < 1e-6 and abs(c.probability.max() - 1) < 1e-12


def test_mixing_small_and_large_fits_agree(spark, monkeypatch):
    rows = [(i, "some words " * (i % 5), f"s{i % 3}", f"l{i % 2}") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    fit = lambda: {(r.source, r.lang, r.topic): r.probability for r in mixing.calibrated(docs)[1].collect()}
    small = fit()
    monkeypatch.setattr(mixing, "CELLS", 0)
    monkeypatch.setattr(mixing, "ROUNDS", 8)
    large = fit()
    assert all(abs(large.get(k, 0.0) - v) < 1e-3 for k, v in small.items())


def test_mixing_edges(spark):
    schema = "doc_id long, text string, source string, lang string, probability int"
    docs = spark.createDataFrame([(1, None, None, None, 1), (None, "a b", "s", None, 1), (2, "gardening", "s", "en", 1)], schema)
    assert mixing.sample(docs).count() <= 3
    assert mixing.sample(docs.limit(0)).collect() == []


def test_mixing_keeps_clashing_columns(spark):
    names = "_topic int, _tokens string, _both int, _u int, _s int, _l int, _t int, _probability string, _cell_source int, `a.b` int, topic string, tokens int"
    rows = [(i, "gardening words " * (i % 9), f"s{i % 3}", "en", 7, "k", 1, 2, 3, 4, 5, "p", 6, 8, "t", 9) for i in range(200)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, source string, lang string, {names}")
    kept = mixing.drawn(docs)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    got = kept.collect()
    assert 0 < len(got) < 200 and all(tuple(r)[4:] == rows[0][4:] for r in got)
    full = mixing.sample(docs).first()
    assert full["__topic"] in range(8) and full["__tokens"] >= 0 and 0 <= full["__probability"] <= 1


def test_mixing_says_when_targets_contradict():
    with pytest.warns(UserWarning, match="miss their targets"):
        mixing.rake(np.array([1.0, 1.0, 0.0, 0.0]), [np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])], [np.array([0.5, 0.5]), np.array([0.5, 0.5])])


def _stray_corpus(spark, stray):
    rows = [(i, "word " * (1 + i % 7) + ["gardening", "astronomy", "economics"][i % 3], f"s{min(i % 10, 2)}", ["en", "de"][i % 4 == 0]) for i in range(3000)]
    return spark.createDataFrame(rows + [(9000, "three short words", "s0", None)] * stray, "doc_id long, text string, source string, lang string")


def test_mixing_keeps_its_budget_with_a_stray_row(spark):
    for stray in (0, 1):
        _, cells = mixing.calibrated(_stray_corpus(spark, stray))
        c = cells.toPandas()
        assert abs((c.tokens * c.probability).sum() / c.tokens.sum() - mixing.BUDGET) < 1e-6 and c.probability.max() <= 1
    assert c[c.lang.isna()].probability.tolist() == [1.0]
    told = mixing.report(cells).toPandas()
    assert abs(told.kept - mixing.BUDGET).max() < 1e-6
    short = told[(told.axis == "lang") & told.value.isna()].iloc[0]
    assert short.expected < short.wanted and abs(short.missed - (short.wanted - short.expected)) < 1e-12
    drawn = mixing.sample(_stray_corpus(spark, 1)).toPandas()
    assert abs(drawn._tokens.sum() / c.tokens.sum() - mixing.BUDGET) < 0.05


def test_mixing_caps_agree_small_and_large(spark, monkeypatch):
    fit = lambda: {(r.source, r.lang, r.topic): r.probability for r in mixing.calibrated(_stray_corpus(spark, 1))[1].collect()}
    monkeypatch.setattr(mixing, "ROUNDS", 6)
    small = fit()
    monkeypatch.setattr(mixing, "CELLS", 0)
    large = fit()
    assert small.keys() == large.keys() and all(abs(large[k] - v) < 1e-6 for k, v in small.items())


def test_capped_rake_holds_feasible_targets():
    rng = np.random.default_rng(3)
    sums = rng.integers(1, 100, 24).astype(float)
    axes = [np.repeat(np.arange(2), 12), np.tile(np.repeat(np.arange(3), 4), 2), np.tile(np.arange(4), 6)]
    p = np.minimum(1, rng.random(24) * 1.6)  # sums that some probabilities reach
    wanted = [np.bincount(at, weights=sums * p) for at in axes]
    got = mixing.capped(sums, axes, wanted)
    assert got.max() <= 1 and got.min() >= 0
    for at, w in zip(axes, wanted, strict=True):
        np.testing.assert_allclose(np.bincount(at, weights=sums * got), w, rtol=1e-5)


def test_rake_against_plain_loops():
    rng = np.random.default_rng(2)
    w = rng.random(24)
    axes = [np.repeat(np.arange(2), 12), np.tile(np.repeat(np.arange(3), 4), 2), np.tile(np.arange(4), 6)]
    targets = [np.array([0.3, 0.7]), np.array([0.2, 0.3, 0.5]), np.full(4, 0.25)]
    fit = mixing.rake(w, axes, targets)
    for at, t in zip(axes, targets, strict=True):
        np.testing.assert_allclose(np.bincount(at, weights=fit), t, atol=1e-8)


def test_topics_and_tokens():
    texts = [b"gardening gardening astronomy", b"", b"a b c"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    topic, tokens = mixing.topics_and_tokens(data, np.array([0, 29, 29, 34]))
    assert tokens.tolist() == [3, 0, 3] and topic[1] == 0 and topic[2] == 0


def test_quality_of_rows_with_other_kinds_of_ids(spark):
    rows = [(i if i % 7 else None, f"Some plain text number {i}." if i % 2 else "!!! buy || now !!!") for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id int, quality int")
    want = {(r.doc_id, round(r.score, 9)) for r in quality.classify(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()}
    got = quality.classify(spark.createDataFrame(rows, "doc_id int, text string"), labels)
    assert dict(got.dtypes)["doc_id"] == "bigint" and {(r.doc_id, round(r.score, 9)) for r in got.collect()} == want and got.count() == 40
