"""Line rules, decontamination, URL rules, HTML text and mixing."""

import random
import re

import numpy as np
import pytest

from areascope.llm import catalog as C
from areascope.llm import decontaminate as D
from areascope.llm import html_text as H
from areascope.llm import mixing as M
from areascope.llm import quality_rules as Q
from areascope.llm import url_rules as U

from . import brute


def test_line_rules(spark, docs_of, clash):
    def prose(k):
        return " ".join(f"Line {k} has word{i}x{k} of plain prose, and it ends as prose{i}x{k} does." for i in range(6))

    good = prose(0)
    rows = [(1, good), (2, None), (3, ""), (4, "home | about | news | contact | login | help\n" + good),
            (5, "Copyright (c) 2020. All rights reserved.\n" + good), (6, "a b c d e f g h " * 10),
            (7, " ".join(f"SHOUT{i}!!" for i in range(30))), (8, "\n".join([good, prose(1), "Again.", prose(2), "Again."])), (None, good)]
    out = {r["doc_id"]: r for r in Q.judge_lines(clash(docs_of(rows)), ["doc_id"]).collect()}
    assert out[1]["kept"] and not out[2]["kept"] and not out[3]["kept"] and out[2]["n_words"] == 0
    assert out[4]["kept"] and out[4]["n_bad_lines"] == 1 and "home" not in out[4]["clean_text"]
    assert out[5]["kept"] and "Copyright" not in out[5]["clean_text"]
    assert out[6]["base_failed"] and out[6]["n_repeat_words"] == 80
    assert not out[7]["kept"] and out[8]["n_dup_lines"] == 1 and out[8]["kept"]
    assert Q.judge_lines(docs_of([]), ["doc_id"]).count() == 0
    kept = Q.clean_documents(docs_of(rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"] and kept.count() == 5


def test_repeated_words_against_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        words = [rng.choice("ab") if rng.random() < 0.7 else str(rng.random()) for _ in range(rng.randrange(60))]
        wins = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
        hit = {j for i, w in enumerate(wins) if wins.count(w) > 1 for j in range(i, i + 8)}
        assert Q.repeated_words(words, 8) == len(hit)


ITEMS = [(1, "The quick brown fox jumps over the lazy dog while seven wizards watch from a hill far away"), (2, "Short item, é!"),
         (3, None), (4, ""), (5, "short ITEM é"), (6, "x y z " * 6)]


def decontam_docs():
    rng = random.Random(2)
    w = ITEMS[0][1].split()
    texts = [None, "", "short item é", "a SHORT item É b", " ".join(w), "lead " + "-".join(w[2:16]).upper() + " tail " * 300,
             " ".join(w[:12]), "x y z " * 9, "word " * 500 + " ".join(w)]
    texts += [" ".join(rng.choice(w) for _ in range(200)) for _ in range(5)]
    return [(i, t) for i, t in enumerate(texts)] + [(None, " ".join(w)), (4, " ".join(w))]


@pytest.mark.parametrize("max_set", [100_000, 0])
def test_decontamination(spark, docs_of, clash, max_set):
    rows = decontam_docs()
    bench = spark.createDataFrame(ITEMS + ITEMS[:1], "item_id long, text string")
    out = D.judge(clash(docs_of(rows)).select("doc_id", "text"), clash(bench), max_set=max_set).collect()
    got = [(r["doc_id"], r["n_words"], r["n_hit"], list(r["items"]), r["contaminated"]) for r in out]
    assert sorted(map(str, got)) == sorted(str((d, *brute.contamination(t, ITEMS))) for d, t in rows)


def test_decontamination_empty_and_cleaning(spark, docs_of):
    rows = decontam_docs()
    none = spark.createDataFrame([], "item_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert D.judge(docs_of(rows).select("doc_id", "text"), none).filter("contaminated").count() == 0
    assert D.judge(docs_of([]).select("doc_id", "text"), bench).count() == 0
    kept = D.clean_documents(docs_of(rows), bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(
        d for d, t in rows if not brute.contamination(t, ITEMS)[3])
    left = {r["doc_id"]: r["text"] for r in D.remove_spans(docs_of([(1, "before short item é after")]), bench).collect()}
    assert left == {1: "before after"}


@pytest.mark.parametrize("max_set", [100_000, 0])
def test_decontamination_items_without_id(spark, docs_of, max_set):
    bench = spark.createDataFrame([(None, "one two three"), (None, "six seven"), (2, "six seven"), (None, None)], "item_id long, text string")
    docs = docs_of([(1, "one two three"), (2, "six seven"), (3, "one three")])
    out = {r["doc_id"]: r for r in D.judge(docs.select("doc_id", "text"), bench, max_set=max_set).collect()}
    assert [(out[d]["n_hit"], out[d]["n_items"], list(out[d]["items"])) for d in (1, 2, 3)] == [(3, 1, []), (2, 2, ["2"]), (0, 0, [])]
    assert [r["doc_id"] for r in D.clean_documents(docs, bench, max_set=max_set).collect()] == [3]


def test_decontamination_without_id_equals_sql(spark, docs_of, tmp_path):
    import duckdb

    from areascope.llm.oracle import ORACLE
    docs = docs_of([(1, "one two three"), (2, "six seven"), (3, "one three")])
    bench = spark.createDataFrame([(None, "one two three"), (None, "six seven"), (2, "six seven")], "item_id long, text string")
    con = duckdb.connect()
    for name, df in (("documents", docs), ("benchmark", bench)):
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    res = con.execute(ORACLE["op6_decontaminate"])
    cols = [c[0] for c in res.description]
    assert sorted(res.fetchall()) == sorted(tuple(r) for r in C.op6_decontaminate(spark, str(tmp_path)).select(cols).collect())


def test_decontamination_is_native(spark, docs_of):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    plan = D.judge(docs_of(decontam_docs()).select("doc_id", "text"), bench)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_url_rules(spark, clash):
    rng = random.Random(4)
    labels = ["com", "net", "example", "www", "a", "b", "a-b", "ab"]
    rules = [(".".join(rng.choice(labels) for _ in range(rng.randrange(1, 4))), rng.choice(["/", "", "/e", "/en/", "/en/x"]),
              rng.choice(["allow", "block"])) for _ in range(30)]
    rules = list({(h, p): (h, p, v) for h, p, v in rules}.values())
    urls = [None, "", "no host", "http://", "://x", "HTTP://WWW.Example.COM?q", "http://a.com#f", "http://É.com/en/x"]
    urls += [f"http://{'.'.join(rng.choice(labels) for _ in range(rng.randrange(1, 5)))}{rng.choice(['', '/', '/en/', '/en/x?y', '/e#z'])}"
             for _ in range(300)] + ["http://www.example.com/en/x"] * 200
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for ranges in (1, 7):
        out = U.judge(clash(pages), spark.createDataFrame(rules, "host string, path string, verdict string"), ["page_id"],
                      ranges=ranges).collect()
        assert len(out) == len(urls)
        for r in out:
            url = urls[r["page_id"]] or ""
            m = re.search(r"://([^/?#]*)([^?#]*)", url)
            host, path = (m[1].translate(brute.LOW), m[2]) if m else ("", "")
            fits = [x for x in rules if (host == x[0] or host.endswith("." + x[0])) and path.startswith(x[1])]
            best = max(fits, key=lambda x: (len(x[0] + x[1]), len(x[0]), x[1]), default=None)
            assert (r["host"], r["path"]) == (host, path)
            assert (r["rule"], r["verdict"]) == ((best[0] + best[1], best[2]) if best else (None, "allow")), (url, r)
    empty = spark.createDataFrame([], "page_id long, url string")
    assert U.judge(empty, spark.createDataFrame(C.URL_RULES, "host string, path string, verdict string"), ["page_id"]).count() == 0
    no_rules = spark.createDataFrame([], "host string, path string, verdict string")
    assert U.judge(pages, no_rules, ["page_id"]).filter("verdict = 'allow' and rule is null").count() == len(urls)


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- c --><div class="ad">Buy this</div>
<div class="cookie-notice">We use cookies</div><article><header><h1>Head &lt;line&gt;</h1></header><p><b>First para&shy;graph
with   space<br>and a break.<p>Second &eacute;&#233;, of the and to it in that.</p><form><p>Name</p><input></form>
<aside>Side</aside><p>Be.</p></article><section id="comments"><p>Nice post, the best of the web!</p></section>
<footer>&copy; site</footer></body></html>"""


def test_html_blocks():
    assert H.main_blocks(PAGE) == ["Head <line>", "First para­graph with space and a break.", "Second éé, of the and to it in that.",
                                   "Be."]
    assert H.main_blocks(None) == [] and H.main_blocks("") == [] and H.main_blocks("<p") == []
    assert H.main_blocks("<p>Only a short one.") == ["Only a short one."]
    long = "It was the best of the times and it was the worst of all of them for us. " * 4
    page = f"<div><a href='/'>Home</a> <a href='/n'>News</a></div><div>{long}</div><p>So it went.</p><div>{long}</div><p><a href='#'>Next</a></p>"
    assert H.main_blocks(page) == [long.strip(), "So it went.", long.strip()]
    assert H.main_blocks("<article><p>cut &amp; off &am") == ["cut & off &am"]
    assert H.main_blocks('<article><p class="x>broken</p><p>fine</p></article>')[-1] == "fine"
    assert len(H.main_blocks("<article>" + "<p>word</p>" * 30_000)) == 30_000


LAKE = "It was a lake of the old kind and it was in the hills."


@pytest.mark.parametrize("attribute", [
    'class="card overflow-hidden"', 'class="site-main has-sidebar"', 'class="post no-comments"', 'id="search-result"', 'data-id="ad-7"',
    'title="a hidden lake"', "data-x='class=\"ad\"'", 'class="hidden md:block"'])
def test_html_layout_names(attribute):
    for page in ("<article {}><p>{}</p></article>", "<main {}><p>{}</p></main>", "<article><div {}><p>{}</p></div></article>",
                 "<body><div {}><p>{}</p></div></body>"):
        assert H.main_blocks(page.format(attribute, LAKE)) == [LAKE], page


@pytest.mark.parametrize("attribute", [
    'class="sidebar"', 'class="box ad"', 'class="site-footer"', 'class="cookie-notice"', 'class="ad-slot-2"', "id=comments",
    'role="search"', 'class="is-hidden"', 'class="x" id="related-posts"'])
def test_html_refused_names(attribute):
    assert H.main_blocks(f"<article><p>{LAKE}</p><div {attribute}><p>{LAKE} No.</p></div></article>") == [LAKE]
    assert H.main_blocks(f"<div {attribute}><article {attribute}><p>{LAKE}</p></article></div>") == [LAKE]
    for hidden in ("hidden", 'aria-hidden="true"', 'style="display: none"'):
        assert H.main_blocks(f"<article><p>{LAKE}</p><div {hidden}><p>{LAKE} No.</p></div></article>") == [LAKE]


@pytest.mark.parametrize("attribute", [
    'class="user-comments"', 'class="commentlist"', 'class="comment-thread"', 'id="disqus_thread"', 'class="adsbygoogle"',
    'class="google-ads"', 'class="dfp-ad"', 'class="AdBox"', 'class="cookiebar"', 'class="left-sidebar"', 'class="sidebar-left"',
    'class="topnav"'])
def test_html_refused_as_a_part(attribute):
    for page in ("<article><p>{0}</p></article><div {1}><p>{0} No. {0}</p></div>", "<div><p>{0} {0} {0} {0}</p></div><div {1}><p>{0} No. {0}</p></div>"):
        assert "No." not in " ".join(H.main_blocks(page.format(LAKE, attribute)))


@pytest.mark.parametrize("attribute", ['class="elementor-widget"', 'class="nav-open"', 'id="history-of-advertising"', 'class="blockquote-footer"'])
def test_html_names_that_say_nothing(attribute):
    assert H.main_blocks(f"<article><p>{LAKE}</p><div {attribute}><p>{LAKE} Yes.</p></div></article>") == [LAKE, LAKE + " Yes."]


def test_html_links_inside_articles():
    page = (f"<article><h2><a href='#'>A linked heading</a></h2><p>{LAKE}</p><p>Read <a href='/r'>the full report of the council</a> here.</p>"
            "<ul><li><a href='/a'>The lake</a> is deep</li><li><a href='/b'>The hill</a></li></ul>"
            f"<p>So <math><mi>x</mi><annotation>x_tex</annotation></math> it is.</p><ul><li><a href='/c'>Next</a></li><li><a href='/d'>Last</a></li></ul>"
            f"<div><a href='/e'>tag</a> <a href='/f'>tag</a></div><p>{LAKE}</p></article>")
    assert H.main_blocks(page) == ["A linked heading", LAKE, "Read the full report of the council here.", "The lake is deep", "The hill",
                                   "So x it is.", LAKE]


def test_html_edges_of_pages_without_article():
    long = "It was the best of the times and it was the worst of all of them for us. " * 4
    code = "for i in range(10): total[i] = left[i] * right[i] # rows; " * 6
    page = (f"<div><a href='/'>Home</a></div><div><h1>The title</h1><p>{long}</p><h2>Code</h2><pre><code>{code}</code></pre><p>{long}</p>"
            "<p>So it went.</p><p>© 2020 Press</p></div><h3>More</h3><ul><li><a href='/x'>One</a></li><li><a href='/y'>Two</a></li></ul>")
    assert H.main_blocks(page) == ["The title", long.strip(), "Code", code.strip(), long.strip(), "So it went."]


def test_html_comments_made_of_articles():
    page = '<main><article><p>{0}</p></article><div id="comments"><article class="comment"><p>{0} No.</p></article></div></main>'
    assert H.main_blocks(page.format(LAKE)) == [LAKE]


OTHER = {
    "ru": "Озеро лежит высоко в горах, и вода в нём холодная даже летом. Рыбаки приходят сюда рано утром и уходят вечером.",
    "pl": "Jezioro leży wysoko w górach, a woda jest tam zimna nawet latem. Rybacy przychodzą wcześnie rano i wracają wieczorem.",
    "fi": "Järvi sijaitsee korkealla vuoristossa, ja vesi pysyy kylmänä kesälläkin. Kalastajat saapuvat aikaisin aamulla sinne.",
    "el": "Η λίμνη βρίσκεται ψηλά στα βουνά και το νερό είναι κρύο ακόμη και το καλοκαίρι. Οι ψαράδες έρχονται νωρίς το πρωί.",
    "zh": "这座湖位于高山之中,即使在夏天湖水也很冷。渔民们清晨来到这里,傍晚才回家。湖边有一座古老的村庄。",
}


@pytest.mark.parametrize("tongue", OTHER)
def test_html_other_languages(tongue):
    one, short = OTHER[tongue], OTHER[tongue][:20].strip()
    long = [f"{one} {one} {k}" for k in range(3)]
    menu = "".join(f'<li><a href="/{k}">{one}</a></li>' for k in range(4))
    page = (f"<body><ul>{menu}</ul><div><p>{long[0]}</p><p>{short}</p><p>{long[1]}</p><div>{long[2]}</div><p>{one}</p></div>"
            f'<div class="sidebar"><p>{long[0]}</p></div><footer>{long[1]}</footer></body>')
    assert H.main_blocks(page) == [long[0], short, long[1], long[2], one]
    english = "It was the best of the times and it was the worst of all of them for us. " * 4
    both = f"<div><p>{english}</p><p>{long[0]}</p><p>{long[1]}</p><p>{english}</p></div>"
    assert H.main_blocks(both) == [english.strip(), long[0], long[1], english.strip()]


def test_html_lists_of_words_stay_out():
    english = "It was the best of the times and it was the worst of all of them for us. " * 4
    page = f"<div><p>{english}</p><p>{english}</p><div>{'lakes rivers boats maps ' * 20}</div><p>{english}</p></div>"
    assert H.main_blocks(page) == [english.strip()] * 3


def test_html_rows(spark, clash):
    pages = clash(spark.createDataFrame([(1, "u", PAGE), (2, None, None), (None, "v", "")], "page_id long, url string, html string"))
    out = {r["page_id"]: r for r in H.extract(pages, ["page_id", "url"]).collect()}
    assert out[1]["n_blocks"] == 4 and out[1]["n_chars"] == len(out[1]["text"]) and out[2]["text"] == "" == out[None]["text"]
    assert H.extract(pages.limit(0), ["page_id", "url"]).count() == 0


def test_mix(spark, docs_of, clash):
    rng = random.Random(6)
    rows = [(i, "w " * rng.randrange(0, 60), "en", rng.choice([None, "a", "b", "b", "b", "c", "é"])) for i in range(900)]
    rows += [(None, "w w", "en", "a"), (5000, None, "en", "zero"), rows[3]]
    docs = clash(docs_of(rows)).drop("size").withColumnRenamed("base", "other")
    out = M.mix(docs, M.word_size(), block_rows=50).collect()
    again = M.mix(docs.repartition(7), M.word_size(), block_rows=50).collect()
    assert sorted(map(str, out)) == sorted(map(str, again)) and len(out) == len(rows)
    names = sorted({r[3] for r in rows if r[3] is not None}) + [None]
    size = {s: sum(len(r[1].split()) for r in rows if r[3] == s and r[1]) for s in names}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, target, open_ = 1.5 * sum(size.values()), {}, set(names)
    while True:  # reshare the excess until none is above
        rate = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * rate >= 2 * size[s]}
        if not over:
            break
        for s in over:
            target[s] = 2 * size[s]
            left -= target[s]
        open_ -= over
        if not open_:
            break
    target.update({s: weight[s] * rate for s in open_})
    for s in names:
        mine = [r for r in out if r["source"] == s]
        assert all(abs(r["target"] - target[s]) < 1e-6 and r["source_size"] == size[s] for r in mine)
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - target[s]) <= 60
    assert M.mix(docs_of([]), M.word_size()).count() == 0
    copies = M.copies_of(docs, block_rows=50)
    assert copies.count() == sum(r["copies"] for r in out)


def test_pivot_keeps_words_and_expectations():
    p, size = np.array([0.3, 0.7, 0.5, 0.2, 0.9, 1.0, 0.0]), np.array([5.0, 4.0, 4.0, 2.0, 1.0, 3.0, 9.0])
    total = np.zeros(len(p))
    for seed in range(4000):
        out, hold, rest = M.pivot(p, size, np.random.default_rng(seed))
        full = out.copy()
        if hold >= 0:
            full[hold] = rest
        assert abs(full @ size - p @ size) < 1e-9 and set(out) <= {0.0, 1.0}
        total += full
    assert np.allclose(total / 4000, p, atol=0.04)


def test_pivot_of_one_fraction():
    size = np.array([50.0, 20.0, 9.0, 4.0, 3.0, 1.0])
    for b in (0.0, 0.2, 0.5, 0.85, 1.0):
        total = np.zeros(len(size))
        for seed in range(4000):
            out, hold, rest = M.pivot_shared(b, size, np.random.default_rng(seed))
            full = out.copy()
            if hold >= 0:
                full[hold] = rest
            assert abs(full @ size - b * size.sum()) < 1e-6 and set(out) <= {0.0, 1.0}
            total += full
        assert np.allclose(total / 4000, b, atol=0.04)
    # one long document among short ones: the open one is short on average, the long one when pairs meet in turn
    size = np.append(5000.0, np.arange(400.0, 200, -4))
    shared = np.mean([size[M.pivot_shared(0.4, size, np.random.default_rng(s))[1]] for s in range(200)])
    pairs = np.mean([size[M.pivot(np.full(len(size), 0.4), size, np.random.default_rng(s))[1]] for s in range(200)])
    assert shared < 300 and 4 * shared < pairs
    assert M.pivot_shared(0.3, np.array([7.0]), np.random.default_rng(0))[1:] == (0, 0.3)


def test_mix_of_equal_rows(spark, docs_of):
    """A third of the rows have neither id nor text, another third are one document again and again."""
    rows = spark.range(9000).selectExpr(
        "case when id % 3 = 2 then id when id % 3 = 1 then -1L end as doc_id",
        "case when id % 3 = 2 then repeat('w ', cast(id % 40 as int)) when id % 3 = 1 then 'one two three' end as text",
        "case when id % 3 = 0 then null when id % 2 = 0 then 'a' else 'b' end as source")
    out = M.mix(rows, M.word_size(), block_rows=300)
    got = out.collect()
    assert len(got) == 9000 and sorted(map(str, got)) == sorted(map(str, M.mix(rows.repartition(5), M.word_size(), block_rows=300).collect()))
    for s in ("a", "b"):
        mine = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) < 39 and all(r["taken"] <= 2 * r["size"] for r in mine)
    assert all(r["taken"] == 0 and r["target"] == 0 for r in got if r["source"] is None)


@pytest.mark.parametrize("sf, misses", [("0.01", lambda miss, target: miss < 500), ("0.1", lambda miss, target: miss < 0.02 * target)])
def test_mix_targets_met(spark, sf, misses):
    """Totals of every source against the targets: within a short document, within 2 % where sources are larger."""
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
    sums = {}
    for r in M.mix(docs, M.word_size()).collect():
        target, taken = sums.get(r["source"], (r["target"], 0))
        sums[r["source"]] = (target, taken + r["taken"])
    assert all(misses(abs(taken - target), target) for target, taken in sums.values()), sums


@pytest.mark.parametrize("line, kept", [
    ("The mill was powered by water from the upper lake, which the monks had dammed for their own use", True),
    ("She liked to read more than anything else that her brother could think of in the long winter", True),
    ("He spoke of terms of usefulness and the readmore of old printers", True),  # no whole phrase
    ("In 1998 the sign © was carved into the door by mistake, and nobody ever took it off again", True),
    ("Powered by Example Press", False),
    ("Click here to read more", False),
    ("  © 2020 Example Press, a company of many names and places", False),
    ("All rights reserved. Privacy policy. Terms of use.", False),
    ("", True),
])
def test_boilerplate_needs_a_share_of_its_line(line, kept):
    assert (Q.line_verdict(line, max(4, len(line.split())), Q.LineRules()) != "boilerplate") == kept
