import numpy as np
from pyspark.sql import functions as F

from folioscope.llm import html_extraction as H
from folioscope.llm.html_extraction import content_paths, folded, main_texts, slots, stream
from folioscope.llm.neighbours import nearest_neighbours

SCHEMA = "vec_id long, embedding array<float>, part string"


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(6)
    vectors = rng.standard_normal((1500, 32)).astype(np.float32) * rng.uniform(0.5, 2, (1500, 1)).astype(np.float32)
    vectors[100:400] = vectors[100]
    rows = [(i, v.tolist(), None) for i, v in enumerate(vectors)]
    found = nearest_neighbours(spark.createDataFrame(rows, SCHEMA), F.col("id") % 20 == 0, part=400).toPandas()
    exact, hit, total = vectors.astype(float), 0, 0
    for query, own in found.groupby("query_id"):
        scores = exact @ exact[query]
        scores[query] = -np.inf
        order = np.lexsort((np.arange(len(scores)), -scores))[:20]
        assert own["rank"].tolist() == list(range(1, 21))
        assert np.allclose(own.sort_values("rank").score, scores[own.sort_values("rank").vec_id], rtol=1e-12)
        hit, total = hit + len(set(order) & set(own.vec_id)), total + 20
    assert found.query_id.nunique() == 75 and hit / total >= 0.9


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], "x"), (20, [0.0, 2.0], "x"), (1, [1.0, 1.0], "x"), (1, [1.0, 1.0], "x"), (2, None, "x"), (3, [0.0, 0.0], "x"),
            (4, [nan, 1.0], "x"), (5, [inf, 1.0], "x"), (6, [None, 1.0], "x"), (None, [1.0, 1.0], "x"), (40, [0.0, 0.0], "x"), (7, [1.0], "x")]
    frame = spark.createDataFrame(rows, SCHEMA)
    found = [tuple(r) for r in nearest_neighbours(frame, F.col("id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert found == [(0, 1, 1, 1.0), (0, 2, 1, 1.0), (0, 3, 7, 1.0), (0, 4, 20, 0.0),
                     (20, 1, 1, 2.0), (20, 2, 1, 2.0), (20, 3, 0, 0.0), (20, 4, 7, 0.0)]
    assert nearest_neighbours(frame.limit(0), F.col("id") % 20 == 0).collect() == []


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a>Home</a></li></ul></nav>
<div class="ad">Buy</div><article><h1>Head &amp; more</h1><p>One <b>two</b><br>three<p>Four&nbsp;five</p><!-- x --><p> </p>
<div class="comments"><p>Nice</p></div></article><footer>&copy; me</footer></body>"""


def test_slots_and_wrappers():
    found = [t for _, t in slots(PAGE)]
    assert found == ["T", "Home", "Buy", "Head & more", "One two three", "Four five", "Nice", "© me"]
    a, b = [("x", False, False), ("y", False, False)], [("x", True, False), ("z", False, False), ("y", False, False)]
    assert folded(a, b) == [("x", True, False), ("z", False, True), ("y", False, False)]
    assert {p for p in content_paths(stream(slots(PAGE)))} == {"html/body/article/h1", "html/body/article/p"}


def test_main_texts(spark):
    plain = '<body><div id="menu">m</div><div><p>Only text</p></div></body>'
    rows = [(1, "https://a.org/x", PAGE, "w"), (2, "https://a.org/y", PAGE, "w"), (3, "http://b.org", plain, "w"), (4, None, plain, None),
            (5, "https://a.org/z", None, "w"), (6, "bad url", "", "w"), (7, "https://a.org/c", "<article><p>cut <b>off", "w"),
            (8, "https://a.org/l", "<article>" + "<p>word</p>" * 20000, "w")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, wrapper string")
    found = {r.page_id: r.text for r in main_texts(pages).collect()}
    main = "Head & more\n\nOne two three\n\nFour five"
    assert found[1] == found[2] == main and found[3] == found[4] == "Only text"
    assert found[5] == found[6] == "" and found[7] == "cut off" and found[8].count("word") == 20000
    assert main_texts(pages.limit(0)).collect() == [] and main_texts(pages).columns == ["page_id", "url", "wrapper", "text"]


def test_rows_that_share_an_id_and_other_lengths(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [0.0, 1.0]), (2, [3.0, 0.0, 4.0]), (3, [2.0]), (20, [1.0, 1.0, 1.0]),
            (20, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (None, [9.0, 9.0]), (40, [0.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    sound = [(i, v + [0.0] * (3 - len(v))) for i, v in rows
             if i is not None and v and any(v) and all(x == x for x in v)]
    found = sorted((r.query_id, r["rank"], r.vec_id, r.score)
                   for r in nearest_neighbours(frame, F.col("id") % 20 == 0, k=20).collect())
    expected = []
    for a, (i, v) in enumerate(sound):
        if i % 20 == 0:
            scores = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), j) for b, (j, w) in enumerate(sound) if a != b)
            expected += [(i, r, j, -s) for r, (s, j) in enumerate(scores, 1)]
    assert found == sorted(expected)


def soup(i, body, extra=""):
    """A page whose furniture no element or name gives away."""
    return (f'<html><body><div id="p{i}" class="c{i}"><div>Our shop</div><div>Call us</div>{extra}<div>{body}</div>'
            f'<div>All rights reserved</div></div></body></html>')


def brute_force_template(pages):
    """Texts at a path that every page with the path has, over all pages at once."""
    by_path = {}
    for found in {tuple(slots(p)) for p in pages}:
        for path in {p for p, _ in found}:
            by_path.setdefault(path, []).append({t for q, t in found if q == path})
    return {p: set.intersection(*held) for p, held in by_path.items() if len(held) >= H.TEMPLATE_PAGES}


def test_wrapper_finds_the_template_that_rules_miss(spark):
    bodies = {i: f"<p>Story {i}</p><p>It was {'very ' * (i % 5)}long</p><p>{'Same end' if i % 2 else 'Other'}</p>" for i in range(70)}
    pages = {i: soup(i, b, "<ul><li>Only here</li></ul>" if i == 3 else "") for i, b in bodies.items()}
    rows = [(i, "https://s.org/" + str(i), h) for i, h in pages.items()] + [(100 + i, "https://s.org/c", pages[0]) for i in range(9)]
    rows += [(200, "https://two.org/a", soup(1, "<p>A</p>")), (201, "https://two.org/b", soup(2, "<p>B</p>"))]
    rows += [(300 + i, "https://same.org/", soup(i, "<p>Equal</p>", f'<div class="menu">{i}</div>')) for i in range(5)]
    rows += [(400, "https://s.org/m", "<main><p>Our shop</p></main>")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    found = {r.page_id: r.text for r in main_texts(frame).collect()}
    known = brute_force_template(pages.values())
    assert set().union(*known.values()) == {"Our shop", "Call us", "All rights reserved"}
    for i, page in pages.items():
        assert found[i] == "\n\n".join(t for p, t in slots(page) if t not in known.get(p, ()))
    assert "Only here" in found[3] and all(found[100 + i] == found[0] for i in range(9))
    assert found[200].split("\n\n") == ["Our shop", "Call us", "A", "All rights reserved"]  # too few pages to tell
    assert all("Equal" in found[300 + i] for i in range(5))  # nothing but template: it stays
    assert found[400] == "Our shop"  # inside the main element


def test_ids_of_one_page_are_no_part_of_a_wrapper(spark):
    rows = [(f"h{i % 2}", f'<article id="post-of-{"abcdefgh"[i % 8]}{i}" class="post-{i}"><p>Text {i}</p></article>') for i in range(300)]
    found = H.wrappers(spark.createDataFrame(rows, "host string, html string")).collect()
    assert {(r.host, r.wrapper) for r in found} == {("h0", "article.post-#/p\t"), ("h1", "article.post-#/p\t")}
    assert slots('<p id="sidebar-7">x</p>') == [("p.sidebar-#", "x")]


def test_comments_and_scripts_leave_no_blank():
    assert slots("<p>wo<!-- c -->rd and<script>x()</script> more</p>") == [("p", "word and more")]
