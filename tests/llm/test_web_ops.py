"""Corpus operators on pages, urls and vectors."""

import hashlib
import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from wirelake.llm import ann, html_text, url_filter, warc
from wirelake.llm.queries import ALLOW, BLOCK

PAGES = [
    (1, "https://www.Example.com/en/a?x=1#f", "<html>" + "payload " * 30),
    (2, "http://b.example.net/es/b", "<html>" + "payload " * 30),
    (3, None, None),
    (4, "http://user@host.org:80", "short"),
    (5, "http://host.org/", "short"),
    (6, "no scheme", "ünï" * 50),
    (7, "http://b.example.net/es/b", "ünï" * 50),
    (7, "http://b.example.net/es/b", "ünï" * 50),
    (None, "http://x.org/\r\nEvil: 1", "<html>" + "payload " * 30),
    (8, "http://long.org/p", "z" * 3_000_000),
]


def frame(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit("clash"), "rule": F.lit(1), "text": F.lit("t"), "first": F.lit(0)}).repartition(3)


def test_warc_round_trip(spark):
    got = warc.round_trip(frame(spark), warc.WarcParams(block_lines=2, parts=2)).collect()
    assert len(got) == len(PAGES)
    first = {}
    for i, _, h in PAGES:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, i), i)
    want = []
    for i, _, h in PAGES:
        data = (h or "").encode()
        f = first.get(h)
        revisit = f is not None and f != i
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", f if revisit else None))
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


def test_warc_lookup_and_empty(spark):
    from wirelake.llm.storage import Scratch

    scratch = Scratch(spark, "test")
    p = warc.WarcParams(block_lines=2, parts=3)
    pages = frame(spark)
    index = warc.build_index(warc.write(pages, scratch, p), scratch, p)
    assert index.firsts == sorted(index.firsts)
    keys = spark.createDataFrame([("net,example,b)/es/b", 7), ("net,example,b)/es/b", 99), ("com,nowhere)/", 1)], "surt string, page_id long")
    assert [r["page_id"] for r in warc.lookup(keys, index, p).collect()] == [7, 7]
    assert warc.round_trip(frame(spark).limit(0), p).count() == 0


def test_surt(spark):
    urls = ["https://User@WWW.Example.com:8080/A?b=C#d", "http://a.org", "http://a.org?q", None, "plain/x"]
    got = [r[0] for r in spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "k int, url string").orderBy("k").select(warc.surt(F.col("url"))).collect()]
    assert got == ["com,example,www)/A?b=C", "org,a)/", "org,a)?q", "", "plain)/x"]


HTML = [
    ("<html><head><title>T</title><script>var a='</p>';</script></head><body><header>Site</header><nav><a href=/>Home</a></nav><article><header><h1>Head&amp;line</h1></header><p>First  para,\n with <b>bold</b>&nbsp;text.<p>Second&#233;<br>third</p><div class='ad'>Buy</div><section class=comments><p>Nice!</p></section></article><aside>More</aside><footer>&copy;</footer>", "Head&line\nFirst para, with bold text.\nSecondé\nthird"),
    ("<body><div id=top-menu><ul><li><a>One</a></ul></div><div class=content><p>A long sentence, with commas, and more of it.</p><p>Another sentence here, quite long too.</p></div><div class='cookie-notice'>We use cookies, ok?</div><form>Mail <input></form></body>", "A long sentence, with commas, and more of it.\nAnother sentence here, quite long too."),
    (None, ""),
    ("", ""),
    ("<article><p>unclosed <i>it", "unclosed it"),
    ("<article><p title=\"a>b\">x</p><!-- <p>no</p> --><p hidden>gone</p><p style='display:none'>gone</p></article>", "x"),
    ("<article>" + "<p>word, </p>" * 20_000 + "</article>", "\n".join(["word,"] * 20_000)),
]


def test_html(spark):
    rows = [(k, "u", h) for k, (h, _) in enumerate(HTML)] + [(None, None, HTML[0][0])]
    got = html_text.extract(frame(spark, rows)).collect()
    by = {r["page_id"]: r for r in got}
    for k, (_, want) in enumerate(HTML):
        assert by[k]["text"] == want and by[k]["n_chars"] == len(want)
    assert by[None]["text"] == HTML[0][1] and len(got) == len(rows)


def test_html_threshold_holds_beside_and_within_articles():
    prose = "A long sentence, with commas, and more of it, goes on here; another follows, and it is long, too. " * 6
    body = "<body><article><h1>Title</h1>" + f"<p>{prose}</p>" * 3 + "<h2>Part</h2>" + f"<p>{prose}</p>" * 2 + "<div><h4>More</h4><ul><li><span>Buy</span></li><li>Ok</li><li>Go</li></ul></div></article></body>"
    lines = html_text.main_text(body).split("\n")
    assert lines == ["Title", *[prose.strip()] * 3, "Part", *[prose.strip()] * 2]
    beside = f"<body><article><p>See this.</p></article><div><h1>Title</h1><p>{prose}</p><p>{prose}</p></div></body>"
    assert html_text.main_text(beside).split("\n")[-3:] == ["Title", prose.strip(), prose.strip()]


def test_class_names_are_hints_as_wholes():
    prose = "Text of an article, with marks; and more, and so on, until it is long enough to be one. " * 3
    page = f'<article><h1 class="post-header">Head</h1><p class="side-effects">{prose}</p><p>{prose}</p></article><div class="cookie-banner"><p>{prose}</p></div><div id="Comments">{prose}</div>'
    assert html_text.main_text(page).split("\n") == ["Head", prose.strip(), prose.strip()]
    assert html_text.main_text(f"<nav>{prose}</nav>") == ""


def test_deep_markup_takes_linear_time():
    began = time.time()
    for page in ("<div>" * 200_000, "<p><table>" + "<div><li>" * 60_000, "<b><span>" * 60_000 + "</i></em>" * 50_000):
        assert html_text.main_text(page + "text, and more. " * 20).startswith("text,")
    assert time.time() - began < 20


def some_page(rng):
    """A page and its texts as (path as labels, level of a heading, text, letters in links, marked, inside an article), from a plain recursive description."""
    texts = []

    def element(depth, path, marked, inside):
        tag = rng.choice(["div", "div", "section", "article", "aside", "ul"])
        cls = rng.choice(["", "", "body", "two words", "sidebar"]) if tag in ("div", "section") else ""
        own = path + (tag + "".join("." + x for x in sorted(cls.split())),)
        marked, inside = marked or tag == "aside" or cls == "sidebar", inside or tag == "article"
        out = f'<{tag} class="{cls}">' if cls else f"<{tag}>"
        for _ in range(rng.randrange(1, 4)):
            if depth < 3 and rng.random() < 0.4:
                out += element(depth + 1, own, marked, inside)
                continue
            leaf = rng.choice(["p", "p", "p", "h2", "h4", "blockquote"])
            text = " ".join(rng.choice(["word", "long-word,", "end.", "x"]) for _ in range(rng.choice([1, 3, 12, 60])))
            linked = rng.random() < 0.2
            out += f"<{leaf}>" + (f"<a href=/>{text}</a>" if linked else text) + f"</{leaf}>"
            texts.append((own + (leaf,), int(leaf[1]) if leaf[0] == "h" else 0, text, len(text) if linked else 0, marked, inside))
        return out + f"</{tag}>"

    page = "<html><body>" + "".join(element(0, ("html", "body"), False, False) for _ in range(rng.randrange(1, 5))) + "</body></html>"
    return page, texts


def plain_stats(texts):
    rows = [t for t in texts if not t[1]]
    rows = texts if all(t[4] for t in rows) else rows
    out = {}
    for t in rows:
        # Marks of an element part a path from one of the same name without.
        s = out.setdefault((t[0], t[4]), [0, 0, 0, 0])
        for k, v in enumerate((1, len(t[2]), sum(c in ",." for c in t[2]), t[3])):
            s[k] += v
    return out


def plain_text(texts, table, p):
    own = plain_stats(texts)
    paths = list(own)
    common = max((k for k in range(1, 9) if len({q[0][:k] for q in paths}) == 1 and all(len(q[0]) >= k for q in paths)), default=0) if len(paths) > 1 else 0
    ratio = {}
    for q in paths:
        n, letters, marks, _ = own[q]
        length, mark = table.get(q[0], (0, 0))
        w = p.prior if q[0] in table else 0
        ratio[q] = (letters + w * length) / (n + w), (marks + w * mark) / (n + w) + 1

    def kin(a, b):
        best = 0.0
        for i in range(1, 4):
            for j in range(1, 4):
                x, y = a[0][:-i], b[0][:-j]
                if not best and x and x == y and len(x) > common:
                    best = 1 / (i + j - 1)
        return best

    value = {}
    for k, q in enumerate(paths):
        near = [(kin(paths[j], q), paths[j]) for j in (k - 1, k + 1) if 0 <= j < len(paths)]
        size = lambda c: (ratio[q][c] + sum(w * ratio[x][c] for w, x in near)) / (1 + sum(w for w, _ in near))  # noqa: B023, E731
        value[q] = size(0) * size(1)
    inside = {(t[0], t[4]) for t in texts if t[5]}
    free = [q for q in paths if own[q][3] <= p.links * own[q][1]]
    weigh = lambda q: p.hint if q[1] else p.inside if q in inside else 1
    if all(q[1] for q in free):
        stay = {q for q in free if value[q] * p.hint >= p.share * max(value[x] for x in free)}
    else:
        best, level = max(value[q] * weigh(q) for q in free), max(value[q] * min(1, weigh(q)) for q in free)
        stay = {q for q in free if value[q] * weigh(q) >= p.share * (best if q[1] else level)}
    out, under = [], 0
    for t in reversed(texts):
        ok = (t[0], t[4]) in stay
        if t[1] and not t[4]:
            ok = t[3] <= p.links * len(t[2]) and (ok or t[1] < under)
            under = min(under, t[1])
        elif not t[1]:
            under = 7 if ok else under
        if ok:
            out.append(t[2])
    return "\n".join(reversed(out))


@pytest.mark.parametrize("p", [html_text.RatioParams(), html_text.RatioParams(hint=1.0, inside=1.0), html_text.RatioParams(share=0.15, prior=3)])
def test_main_text_against_plain_ratios(spark, p):
    rng = random.Random(4)
    pages = [some_page(rng) for _ in range(150)]
    seen = {}
    for _, texts in pages:
        for (path, _), (n, letters, marks, _) in plain_stats(texts).items():
            s = seen.setdefault(path, [0, 0, 0, 0])
            for k, v in enumerate((1, n, letters, marks)):
                s[k] += v
    table = {path: (s[2] / s[1], s[3] / s[1]) for path, s in seen.items() if s[0] >= 2}
    rows = [(k, "u", page) for k, (page, _) in enumerate(pages)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(frame(spark, rows), p).collect()}
    assert got == {k: plain_text(texts, table, p) for k, (_, texts) in enumerate(pages)}
    assert len(set(got.values())) > 100
    assert [html_text.main_text(page, p) for page, _ in pages] == [plain_text(texts, {}, p) for _, texts in pages]


@pytest.mark.parametrize("known", [0, 3, 12])
def test_ratios_of_paths_beyond_those_broadcast(spark, known):
    rng = random.Random(9)
    pages = [some_page(rng)[0] for _ in range(120)]
    rows = [(k, "u", pages[k % 120]) for k in range(130)] + [(k, "u", pages[7]) for k in range(130, 230)] + [(None, None, None), (230, "u", "")]
    texts = lambda p: sorted((str(r["page_id"]), r["text"]) for r in html_text.extract(frame(spark, rows), p).collect())
    got = texts(html_text.RatioParams(hint=1.0, inside=1.0))
    assert texts(html_text.RatioParams(hint=1.0, inside=1.0, known=known)) == got
    alone = [html_text.main_text(x, html_text.RatioParams(hint=1.0, inside=1.0)) for x in pages]
    assert sum(dict(got)[str(k)] != alone[k] for k in range(120)) > 5


def test_ratios_of_paths_on_few_of_many_pages(spark):
    prose = "A long sentence, with commas, and more of it, goes on here; another follows. " * 8
    pair = [f'<body><div class="one"><p>{x}</p></div><div><div class="two"><p>{prose}</p></div></div></body>' for x in ("Short.", prose * 2)]
    rows = [(k, "u", f"<p>Page {k}.</p>") for k in range(6998)] + [(7000 + k, "u", x) for k, x in enumerate(pair)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(frame(spark, rows)).where("page_id >= 7000").collect()}
    assert got == {7000: f"Short.\n{prose.strip()}", 7001: f"{prose * 2}".strip() + f"\n{prose.strip()}"}
    assert html_text.main_text(pair[0]) == prose.strip()


def test_ratios_overrule_markup():
    prose = "A long sentence, with commas, and more of it, goes on here; another follows, and it is long, too. " * 6
    page = f'<body><div class="sidebar"><p>{prose}</p><p>{prose}</p></div><div><p>Short.</p></div></body>'
    assert html_text.main_text(page).split("\n") == [prose.strip()] * 2


def test_markup_hardly_matters_where_pages_are_many(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    with_lists = {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()}
    without = {r["page_id"]: r["text"] for r in html_text.extract(pages, html_text.RatioParams(hint=1.0, inside=1.0)).collect()}
    assert sum(with_lists[k] != without[k] for k in with_lists) < 0.05 * len(with_lists)


def rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = lambda t, marks: t[: min([t.find(m) for m in marks if m in t], default=len(t))]
    host = cut(rest, "/?#")
    path = cut(rest[len(host) :], "?#")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = []
    for r in (*ALLOW, *BLOCK):
        h, _, p = r.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append(r)
    return host, path, max(fits, key=len, default=None)


def test_url_rules(spark):
    hosts = ["example.com", "www.example.com", "a.www.EXAMPLE.com", "notexample.com", "x.net", "net", "x.org", "spam123.org", "com"]
    urls = [f"http{s}://{h}{p}{q}" for s in ("", "s") for h in hosts for p in ("", "/", "/en/1", "/es/2", "/fr/3", "/de/x.html") for q in ("", "?a=1&b", "#f", "?u=http://example.com/en/")]
    urls += [None, "", "www.example.com/en/", "http://", "x://y://z", urls[0]]
    got = url_filter.judge(frame(spark, [(k, u, None) for k, u in enumerate(urls)]), ALLOW, BLOCK, url_filter.UrlParams(rounds=3, depth=2)).collect()
    assert len(got) == len(urls)
    for r in got:
        host, path, want = rule(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, want)
        assert r["verdict"] in ("allow", "block")
        if want:
            assert r["verdict"] == ("allow" if want in ALLOW else "block")
    assert url_filter.judge(frame(spark, []), ALLOW, BLOCK).count() == 0
    assert {r["verdict"] for r in url_filter.judge(frame(spark, [(1, "http://a.org/", None)]), ALLOW, BLOCK).collect()} == {"allow"}


def test_url_columns_that_clash(spark):
    rows = [(k, f"http://{h}/{p}/{k}", 1.0, "p", [0.5], "r", 3) for k in range(30) for h, p in (("a.net", "es"), ("b.com", "x"), ("c.org", "y"))]
    df = spark.createDataFrame(rows, "page_id long, url string, prediction double, probability string, _features array<double>, rawPrediction string, _url_length int")
    got = url_filter.judge(df, ALLOW, BLOCK, url_filter.UrlParams(rounds=2, depth=2))
    assert set(df.columns) <= set(got.columns) and {(r["prediction"], r["_url_length"], r["rawPrediction"]) for r in got.collect()} == {(1.0, 3, "r")}


def test_url_trees_against_a_walk(spark):
    """The score is the sigmoid of twice the weighted sum of the trees' leaves, read from the trees as they are printed."""
    rows = [(f"http://{'x9' * (k % 5 + 1) if k % 3 else 'plain'}.test/{'a/' * (k % 7)}{k}", int(k % 3 > 0 and k % 5 < 3)) for k in range(300)]
    df = spark.createDataFrame(rows, "url string, label int").withColumns({"host": url_filter.host_of(F.col("url")), "path": url_filter.path_of(F.col("url"))})
    model = url_filter.fit(df, url_filter.UrlParams(rounds=3, depth=2))

    def walk(lines, x):
        at = 0
        while not (m := re.match(r" *Predict: (\S+)", lines[at])):
            depth, f, op, limit = re.match(r"( *)If \(feature (\d+) (<=|>) (\S+)\)", lines[at]).groups()
            if (x[int(f)] <= float(limit)) == (op == "<="):
                at += 1
            else:
                at = next(k for k in range(at + 1, len(lines)) if lines[k].startswith(f"{depth}Else")) + 1
        return float(m[1])

    for r in model.trees.transform(url_filter._vector(df, model.suffixes)).limit(60).collect():
        total = sum(w * walk(t.toDebugString.splitlines()[1:], r["_features"].toArray()) for t, w in zip(model.trees.trees, model.trees.treeWeights))
        assert math.isclose(r["probability"][1], 1 / (1 + math.exp(-2 * total)), rel_tol=1e-6)


def test_url_trees_learn(spark):
    rows = [(f"http://{'x9' * (k % 5 + 1) if k % 2 else 'plain'}.test/{k}", k % 2) for k in range(300)]
    df = spark.createDataFrame(rows, "url string, label int")
    df = df.withColumns({"host": url_filter.host_of(F.col("url")), "path": url_filter.path_of(F.col("url"))})
    model = url_filter.fit(df, url_filter.UrlParams(rounds=3, depth=2))
    out = model.trees.transform(url_filter._vector(df, model.suffixes))
    assert out.where("prediction = label").count() == 300


def vectors(n=600, d=16):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(6, d))
    return (centers[rng.integers(0, 6, n)] + 0.5 * rng.normal(size=(n, d))).astype(np.float32)


def test_url_rare_label_is_learned(spark):
    """Three blocked urls among 3000, and a sample of 200."""
    rows = [(f"http://a{k}.good.org/x{k}", f"a{k}.good.org", "/x", 0) for k in range(3000)] + [(f"http://b{k}.bad.biz/y{k}", f"b{k}.bad.biz", "/y", 1) for k in range(3)]
    df = spark.createDataFrame(rows, "url string, host string, path string, label int")
    model = url_filter.fit(df, url_filter.UrlParams(sample=200))
    assert model.trees is not None and model.suffixes == {"org": 1 / 3002, "biz": 4 / 5}


def test_ann(spark):
    x = vectors()
    x[100:300] = x[100]  # one very common vector
    rows = [(k, [float(v) for v in e], 0) for k, e in enumerate(x)]
    bad = [(9000, None, 0), (9020, [0.0] * 16, 0), (9040, [float("nan")] * 16, 0), (9060, [1.0] * 3, 0), (9080, [None] * 16, 0), (None, rows[0][1], 0), (0, rows[0][1], 0)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, rank int").repartition(3)
    p = ann.AnnParams(list_size=20, sublist=60, query_block=4, shard_lists=3)
    got = ann.neighbours(df, 20, p).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(by) == list(range(0, 600, 20))
    y, hits = x.astype(np.float64), 0
    for q, found in by.items():
        score = np.zeros(len(y))
        for c in range(y.shape[1]):
            score += y[q, c] * y[:, c]
        want = [k for k in np.lexsort((np.arange(len(y)), -score)) if k != q][:20]
        assert [f[0] for f in sorted(found)] == list(range(1, 21))
        assert all(score[v] == s for _, v, s in found)
        assert sorted(found) == [(i + 1, v, s) for i, (v, s) in enumerate(sorted(((v, s) for _, v, s in found), key=lambda t: (-t[1], t[0])))]
        hits += len({f[1] for f in found} & set(want))
    assert hits / (20 * len(by)) >= 0.9


def test_ann_reads_all_lists_within_the_ratio(spark):
    x = np.random.default_rng(4).normal(size=(2400, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[7] *= 100  # beside it all distances are nearly equal
    df = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "vec_id long, embedding array<float>")
    found = {}
    for r in ann.neighbours(df, 20, ann.AnnParams(list_size=4)).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    score = x.astype(np.float64) @ x.astype(np.float64).T
    np.fill_diagonal(score, -np.inf)
    assert found == {q: set(np.argsort(-score[q])[:20].tolist()) for q in range(0, 2400, 20)}


def test_ann_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 1.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.neighbours(df).orderBy("rank").collect()]
    assert got == [(0, 1, 2, 1.0), (0, 2, 1, 0.5)]
    assert ann.neighbours(df.limit(0)).count() == 0


@pytest.mark.parametrize("k", [1, 5, 40])
def test_graph_finds_near_centroids(k):
    x = vectors(400).astype(np.float64)
    norm = float(np.sqrt((x * x).sum(1)).max())
    g = ann.fit_graph(x, 400 * k, norm, ann.AnnParams(list_size=400, centroids=k))
    q = np.hstack((x[:50], np.zeros((50, 1))))
    ids, _ = g.search(q, 16)
    full = ((q[:, None] - g.points[None]) ** 2).sum(2).argmin(1)
    assert (ids[:, 0] == full).mean() >= 0.95
