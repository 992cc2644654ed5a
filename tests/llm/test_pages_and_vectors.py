"""Page and vector operators, the registered queries and the pipeline, against plain counterparts."""

import os

import brute
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from barledger.llm import html_diff, queries, rpforest, urlglob

PAGES = "page_id long, url string, html string, host string, row string, text string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "x", "x") for i, u, h in rows], PAGES)


# -- main text ---------------------------------------------------------------------------------------


def main_text(source):
    page = html_diff.parse(source)
    return "\n".join(x for x, k in zip(page.lines, page.kept) if k)


@pytest.mark.parametrize("source, want", [
    ("", ""),
    ("plain  text &amp; more", "plain text & more"),
    ("<article><h1>Title</h1><p>One<br>two<p><b>three</article><footer>no</footer>", "Title\nOne\ntwo\nthree"),
    ("<body><header>site</header><nav>menu</nav><main><p>a &lt;b&gt; &eacute;&nbsp;c</p><aside>side</aside></main>", "a <b> é c"),
    ("<div class='cookie-notice'>we bake</div><div class='content'>text</div><div id=sidebar>links</div>", "text"),
    ("<article>one<section class='comments'><article>mine</article></section><form>search <input></form>two</article>", "one\ntwo"),
    ("<script>var t='</p>';</script><style>p{}</style><p>kept<!-- gone <p> --></p><p>cut &am", "kept\ncut &am"),
    ("<p title='a > b'>x</p><p hidden>secret</p></div></section><p>y</p><scr", "x\ny"),
    ("<article><div class='has-ads-free'>fine</div><div class='ad'>buy</div></article>", "fine"),
    ("<table><tr><td>a</td><td>b</td></tr></table>", "a\nb"),
    ("<article style='overflow:hidden' data-hidden=false data-id='comments' title='id=menu hidden'>text</article>", "text"),
    ("<p HIDDEN>a</p><p aria-hidden = true>b</p><p data-x=1 id=comments>c</p><p title='x>d</p><p>e</p>", "d\ne"),
    ("<article>one <svg viewBox='0 0 1 1'/> two<svg><text>no</text></svg></article>", "one\ntwo"),
    ("<article><p>before</p><section id=discussion><h2>Discussion</h2><p>our findings</p></section><p>after</p></article>", "before\nDiscussion\nour findings\nafter"),
    ("<article><div class='header'><h1>Title</h1></div><h2 id='related' class='comments'>Related work</h2><p>text</p><div id=menu><p>soup</p></div></article>", "Title\nRelated work\ntext\nsoup"),
    ("<article><p>text</p><section id=related><h3><a href=/x>More</a></h3><ul><li><a href=/y>one</a><li><a href=/z>two</a></ul></section></article>", "text"),
    ("<article><p>text</p><div class=discussion><div class=comment-body>I agree</div><div class=comment-body>me too</div></div></article>", "text"),
    ("<article><p>text</p><div id=notice>Get our letter <form><input></form></div><section class=comments><p>nice</p></section><div id=related>open", "text\nopen"),
    ("<div id=discussion>outside</div><main><p>text</p></main>", "text"),
    ("<article>if <math><mi>x</mi><mo>=</mo><mn>1</mn><mspace/><annotation>x=1</annotation></math> then</article>", "if x=1 then"),
])
def test_structure(source, want):
    assert main_text(source) == want


def test_closing_tags_without_their_element_are_cheap():
    assert main_text("<div>" * 20000 + "text" + "</span></em>" * 20000) == "text"


@given(st.lists(st.integers(0, 4), max_size=12), st.lists(st.integers(0, 4), max_size=12))
@settings(max_examples=200, deadline=None)
def test_common_lines_are_a_longest_subsequence(a, b):
    places = html_diff.common_lines(np.array(a, dtype=np.int64), np.array(b, dtype=np.int64))
    assert places == sorted(set(places)) and len(places) == brute.lcs_length(a, b)
    rest = iter(b)
    assert all(any(x == a[i] for x in rest) for i in places)


def test_shared_lines_go_only_without_marked_text(spark):
    frame = "<div>Welcome to the site</div><p>{}</p><div>All rights reserved</div>"
    rows = [(i, f"http://a.example/x/{i}", frame.format(f"text number {i}")) for i in range(40)]
    rows += [(100, "http://b.example/1", "<article><p>same line</p><p>own</p></article>"), (101, "http://b.example/2", "<article><p>same line</p><p>other</p></article>")]
    rows += [(200, "http://c.example/1", "<p>copy one</p><p>copy two</p>"), (201, "http://c.example/2", "<p>copy one</p><p>copy two</p>")]
    found = {r.page_id: r.text for r in html_diff.extract(pages(spark, rows)).collect()}
    assert all(found[i] == f"text number {i}" for i in range(40))
    assert found[100] == "same line\nown" and found[200] == found[201] == "copy one\ncopy two"


def test_copies_and_templates_of_unmarked_pages(spark):
    def body(*lines):
        return "".join(f"<div>{x}</div>" for x in lines)

    frame = [f"frame {k}" for k in range(40)]
    menu = "<nav>" + body(*(f"menu {k}" for k in range(40))) + "</nav>"
    rows = [(i, f"http://a.example/{i}", body(*frame[:20], *(f"own {i} {k}" for k in range(3)), *frame[20:])) for i in range(6)]
    rows += [(100 + i, f"http://b.example/{100 + i}", body("site name", f"text {max(0, min(i - 2, 4))}", "imprint")) for i in range(9)]  # 0 0 0 1 2 3 4 4 4
    rows += [(200 + i, f"http://c.example/{i}", menu + body("site name", f"text {i}")) for i in range(2)]
    rows += [(300 + i, f"http://d.example/{i}", body(*frame[:9], f"version {i}") if i < 2 else body("other", str(i))) for i in range(4)]
    found = {r.page_id: r.text for r in html_diff.extract(pages(spark, rows)).collect()}
    assert all(found[i] == f"own {i} 0\nown {i} 1\nown {i} 2" for i in range(6))
    assert [found[100 + i] for i in range(9)] == [f"text {max(0, min(i - 2, 4))}" for i in range(9)]
    assert found[200] == "text 0" and found[201] == "text 1"
    assert found[300].startswith("frame 0\n") and found[301].endswith("frame 8\nversion 1") and found[302] == "2"


def test_template_within_marked_text(spark):
    notice = "<div class='x1'><p>We bake pies</p><p>Read on</p></div>"
    links = "<ul><li><a href=/a>Start</a></li><li><a href=/b>News</a> | <a href=/c>More</a></li></ul>"
    frame = "<main>{}<div class='body'><p>licence</p><p>text {}</p><ul><li>point</li><li>item {}</li></ul></div><p><a href=/t>To top</a></p>{}</main>"
    rows = [(i, f"http://a.example/{i}", frame.format(notice, min(i, 6), min(i, 6), links)) for i in range(9)]  # three copies at the end
    rows += [(100 + i, f"http://b.example/{100 + i}", f"<article><div>part one</div><div>part two</div><div>part three</div><div>part four</div><div>part five</div><div>v{i}</div></article>") for i in range(2)]
    rows += [(200 + i, f"http://c.example/{200 + i}", "<article><div>whole</div></article>" if i == 1 else f"<article><div>whole</div><p>more {i}</p></article>") for i in range(3)]
    found = {r.page_id: r.text for r in html_diff.extract(pages(spark, rows)).collect()}
    assert all(found[i] == f"licence\ntext {min(i, 6)}\npoint\nitem {min(i, 6)}" for i in range(9))
    assert found[100].startswith("part one\n") and found[100].endswith("\nv0")
    assert found[201] == "whole"


def test_page_hard_rows(spark):
    rows = [(1, None, None), (2, "", ""), (3, "http://a.example", "<p>x</p>"), (3, "http://a.example", "<p>x</p>"), (None, "no scheme", "<p>y</p>"),
            (4, "http://a.example/long", "<article>" + "<p>word word</p>" * 20000), (5, "http://a.example/deep", "<div>" * 3000 + "deep")]
    frame = pages(spark, rows)
    found = html_diff.extract(frame).collect()
    assert sorted((r.page_id or 0, r.text) for r in found if r.page_id != 4) == [(0, "y"), (1, ""), (2, ""), (3, "x"), (3, "x"), (5, "deep")]
    assert next(r.text for r in found if r.page_id == 4).count("\n") == 19999
    assert html_diff.extract(frame.where("false")).count() == 0


# -- URL rules ---------------------------------------------------------------------------------------

GLOBS = st.lists(st.sampled_from(["a", "b", "/", ".", "*", "**", "?"]), max_size=7).map("".join)


@given(st.lists(GLOBS, min_size=1, max_size=30), st.lists(st.text("ab/.", max_size=12), min_size=1, max_size=12))
@settings(max_examples=150, deadline=None)
def test_automaton_matches_plain_globs(globs, urls):
    hits = urlglob.Automaton([urlglob.glob_steps(g) for g in globs]).match([u.encode() for u in urls])
    for i, u in enumerate(urls):
        for k, g in enumerate(globs):
            assert hits[i, k] == brute.glob_fits(g, u), (g, u)


def test_url_hard_rows(spark):
    rows = [(1, None, None), (2, "no scheme net/", None), (3, "http://NET/x", None), (4, "https://Sub.Example.NET/en/1?x#y", None), (5, "http://example.net/EN/", None),
            (6, "http://evil.com/a.net/x", None), (7, "http://net?x", None), (8, "http://spam-farm.example.info", None), (9, "http://x.org/" + "y" * 50000 + "é", None), (9, "http://x.org/fr/", None)]
    found = [(r.page_id, r.host, r.rule, r.verdict) for r in urlglob.judge(pages(spark, rows)).collect()]
    assert found == [
        (1, "", None, "allow"), (2, "", None, "allow"), (3, "net", "net/", "block"), (4, "sub.example.net", "example.net/en/", "allow"), (5, "example.net", "net/", "block"),
        (6, "evil.com", None, "allow"), (7, "net", None, "allow"), (8, "spam-farm.example.info", None, "block"), (9, "x.org", None, "allow"), (9, "x.org", "org/fr/", "allow")]
    assert urlglob.judge(pages(spark, rows).where("false")).count() == 0


# -- vectors -----------------------------------------------------------------------------------------


def clusters(n, seed=1, dimensions=24):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        centre = rng.standard_normal(dimensions)
        out += [(centre + rng.standard_normal(dimensions) * s, k % 3) for s in (0, 0.05, 0.2, 0.3)]
    return out


def test_links_against_all_pairs(spark):
    rows = [(i, v.astype("float32").tolist(), lab) for i, (v, lab) in enumerate(clusters(600))]
    rows += [(5000 + i, rows[i][1], rows[i][2]) for i in range(40)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    found = rpforest.near_duplicates(frame).toPandas().set_index("vec_id").sort_index()
    links, component = brute.vector_links(rows, 0.93)
    assert found.n_links.sum() >= 0.95 * sum(links.values()) and all(found.n_links[i] <= links[i] for i in links)
    assert (found.component_id == [component[i] for i in found.index]).mean() > 0.95


def test_large_leaves_are_tiled(spark, monkeypatch):
    monkeypatch.setattr(rpforest, "TILE", 20)
    rng = np.random.default_rng(4)
    centre = rng.standard_normal(16)
    rows = [(i, (centre + rng.standard_normal(16) * 0.1).astype("float32").tolist(), 1) for i in range(150)]
    found = rpforest.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).toPandas().set_index("vec_id")
    links, component = brute.vector_links(rows, 0.93)
    assert all(found.n_links[i] == links[i] and found.component_id[i] == component[i] for i in links)


def test_vector_hard_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [0.0, 0.0], 1), (7, [nan, 1.0], 1),
            (8, [inf, 1.0], 1), (9, [None, 1.0], 1), (10, [], 1), (None, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (11, [1.0, 0.0, 0.0], 1), (12, [1.0, 0.01, 0.0], 1)]
    frame = spark.createDataFrame([(*r, "x", "x") for r in rows], "vec_id long, embedding array<float>, label int, cid string, vector string")
    found = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in rpforest.near_duplicates(frame).collect())
    alone = [(i, 0, i, True) for i in range(3, 11)]
    assert found == [(0, 3, 1, False), (1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), *alone, (11, 1, 11, True), (12, 1, 11, False)]
    assert rpforest.near_duplicates(frame.where("false")).count() == 0


# -- registered queries ------------------------------------------------------------------------------

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": "page_id url text n_chars", "op2": "doc_id held_out lang_pred score", "op3": "doc_id held_out score predicted", "op4": "doc_id fingerprint component_id",
    "op5": "page_id host path rule verdict", "op6": "doc_id n_assign n_access n_hex base_sha256 spans", "op7": "vec_id n_links component_id kept",
    "op8": "doc_id size source_size target taken", "op9": "doc_id piece start length ids_crc32 sequence_id offset",
    "op10": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
}


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_runs_over_its_table(spark, name):
    found = queries.QUERIES[name](spark, SF_DIR)
    assert found.columns == COLUMNS[name.split("_")[0]].split()
    if name in queries.ORACLES:
        from oracle_compare import compare, duck

        verdict, _ = compare(spark, duck(SF_DIR), name, queries.QUERIES[name], queries.ORACLES[name], SF_DIR)
        assert verdict.startswith("ok"), verdict
    else:
        kind = {"op1": "pages", "op7": "embeddings"}.get(name.split("_")[0], "documents")
        rows = spark.read.parquet(f"{SF_DIR}/{kind}.parquet").count()
        assert found.count() >= rows if name.startswith("op9") else found.count() == rows


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")
def test_pipeline_stages(spark):
    import corpus_pipeline
    from barledger.llm.common import settle
    from barledger.llm import mixing, simhash

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = settle(stage(spark, docs, SF_DIR))
        if name != "packing":
            assert out.columns == docs.columns
        kept[name] = (docs.toPandas(), out.toPandas())
        docs = out
    before, after = kept["near_duplicates"]
    fps = {i: brute.fingerprint(t) for i, t in zip(before.doc_id, before.text)}
    want = {min(c) for c in brute.classes(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= simhash.MAX_BITS)}
    assert set(after.doc_id) == want and len(after) == len(want)
    before, after = kept["secrets"]
    assert len(before) == len(after) and not any(brute.base_secrets(t) for t in after.text)
    before, after = kept["mixture"]
    sizes = before.text.str.split().str.len().groupby(before.source).sum().to_dict()
    want = brute.targets(sizes, mixing.WEIGHTS, mixing.MAX_EPOCHS)
    got = after.text.str.split().str.len().groupby(after.source).sum().to_dict()
    assert all(abs(got.get(s, 0) - want[s]) <= 1 for s in want)
    before, after = kept["packing"]
    assert after.drop_duplicates(["doc_id"]).shape[0] == before.doc_id.nunique()
    assert after.groupby("sequence_id").length.sum().max() <= 1024
