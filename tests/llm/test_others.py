"""Pages, tokens, vectors, conversations and the pipeline against brute force, and on odd rows."""

import hashlib
import html
import json
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from larder.llm import chat, forest, pieces, queries, wrappers


@pytest.fixture(scope="module")
def reference():
    return pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=queries.MODEL)


@pytest.fixture(scope="module")
def codec():
    return pieces.Codec(pieces.load(queries.MODEL))


# Tokens


TEXTS = ["", " ", "  a", "hello  world ", "a\nb\tc", "\xa0x ﬁ ①", "a▁b", "x\0y", "日本😀", "<s> </s>", "a" * 1000, "ab" * 700 + " x", " " * 300, "ä" * 257]


def test_ids_equal_the_reference(codec, reference):
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice("abcdehilnorstu  \n.éß日▁0<>x") for _ in range(rng.randint(1, 400))) for _ in range(200)]
    for text, mine in zip(texts, codec.encode(texts)):
        assert np.frombuffer(mine, "<i4").tolist() == reference.encode(text)
        assert codec.decode(mine) == text.replace("▁", " ")


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=80))
def test_any_text_comes_back(codec, reference, text):
    mine = codec.encode([text])[0]
    assert codec.decode(mine) == text.replace("▁", " ")
    assert np.frombuffer(mine, "<i4").tolist() == reference.encode(text)


def test_ranges_hold_every_occurrence():
    model = pieces.Model(["", "▁a", "ab", "abc", "b"], np.array([0, -1.0, -2, -3, -4]), 0, 0, True)
    search = pieces.Searcher(model)
    line = "abcab ab▁abb".replace("▁", " ")
    text = np.array([ord(c) + 1 for c in line], "u4")
    order = search.suffix_array(text)
    first, end = search.ranges(text, order)
    for i, a, b in zip(search.ids, first, end):
        name = model.texts[i].replace("▁", " ")
        assert sorted(order[a:b].tolist()) == [k for k in range(len(line)) if line.startswith(name, k)]


def test_tokens_of_odd_rows(spark, odd, none, reference):
    model = pieces.load(queries.MODEL)
    coded = pieces.encode(odd, model)
    rows = coded.collect()
    texts = defaultdict(list)
    for r in odd.collect():
        texts[r.doc_id].append(r.text)
    assert len(rows) == odd.count() and pieces.encode(none, model).count() == 0
    assert all(r.round_trip is None if r.doc_id == 2 else r.round_trip for r in rows)
    for r in rows:
        assert r.token_ids in [reference.encode(t or "") for t in texts[r.doc_id]]
    back = sorted((r.doc_id or 0, r.text) for r in pieces.decode(coded, model).collect())
    assert back == sorted((k or 0, t or "") for k, own in texts.items() for t in own)


def test_all_documents_come_back(spark, reference):
    docs = {r.doc_id: r.text for r in queries.table(spark, SMALL, "documents").collect()}
    for r in queries.QUERIES["op7_sentencepiece"](spark, SMALL).collect():
        want = np.array(reference.encode(docs[r.doc_id]), "<i4")
        assert r.round_trip and (r.n_tokens, r.ids_sha256) == (len(want), hashlib.sha256(want.tobytes()).hexdigest())


def test_the_query_returns_the_ids(spark, codec):
    docs = {r.doc_id: r.text for r in queries.table(spark, SMALL, "documents").collect()}
    for r in queries.QUERIES["op7_sentencepiece"](spark, SMALL).collect():
        data = np.array(r.token_ids, "<i4").tobytes()
        assert (r.n_tokens, r.ids_sha256) == (len(r.token_ids), hashlib.sha256(data).hexdigest()) and codec.decode(data) == docs[r.doc_id]


# Pages


def test_article_texts(spark):
    pages = {r.page_id: r.html for r in queries.table(spark, SMALL, "pages").collect()}
    for r in queries.QUERIES["op4_wrappers"](spark, SMALL).collect():
        article = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        blocks = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in re.split(r"</?(?:p|h1)>", article))
        want = "\n".join(b for b in blocks if b)
        assert (r.text, r.n_chars) == (want, len(want))


@pytest.mark.parametrize(("page", "want"), [
    ("", ""), ("<", "<"), ("<p>a<p>b", "a\nb"), ("<script>x", ""), ("<!-- x", ""), ("a &lt;b&gt; &#233;", "a <b> é"),
    ("<div class=sidebar>no</div><div><p>yes &amp; no</p></div>", "yes & no"),
    ("<article><p>x</p><div class='comments'><p>c</p></div><form>f</form></article><p>out</p>", "x"),
    ("<body><header>h</header><main><header><h1>T</h1></header>tx<b>t</b>z<br>q</main><aside>s</aside>", "T\ntxtz q"),
    ("<p>a\n  b</p><div id='cookie-notice'>c</div><p hidden>d</p>", "a b"), ("<textarea>x</textarea>y<p>z<![CDATA[q<r]]>", "y\nzq<r"),
    ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a\nb\nc\nd"), ("<p>" + "w " * 50_000, ("w " * 50_000).strip()),
])
def test_parts_of_a_page(page, want):
    assert wrappers.main_text(page, None) == want


@pytest.mark.parametrize("page, want", [
    ("<p>&<b>lt;</b> x</p>", "&lt; x"),
    ("<p>&#65<i>5</i></p>", "A5"),
    ("<article><h2 id='share-price'>Share price</h2><p>It rose.</p><section id='search'><p>How search works</p></section></article>", "Share price\nIt rose.\nHow search works"),
    ("<article><p class='notice-of-motion'>Moved.</p><div class='ad-slot'>Buy</div><ul class='social share-links'><li>Send</li></ul></article>", "Moved."),
])
def test_references_by_token_and_names_in_articles(page, want):
    assert wrappers.main_text(page, None) == want


def test_wrapper_of_a_host():
    def page(i):
        items = "".join(f"<li>item {i}{k}</li>" for k in range(2 + i % 3))
        extra = "<div><i>only here</i></div>" if i == 3 else ""
        return f"<body><div class=top>My site</div><div class=x><p>Story {i} goes on and on</p>{extra}<ul>{items}</ul><p>Write to us</p></div><div class=y>k{i}</div></body>"

    found = wrappers.infer([page(i) for i in range(6)] + [page(0)])
    assert ")+" in found["expression"] and "?" in found["expression"] and " . " in found["expression"]
    assert found["place"] == "/body/div.x" and ["/body/div.top", "My site"] in found["fixed"]
    assert wrappers.main_text(page(7), found) == "Story 7 goes on and on\nitem 70\nitem 71\nitem 72"
    same = wrappers.infer([page(1)] * 8)
    assert same["fixed"] == []  # copies of one page tell nothing


def test_a_long_page_hides_no_template_text():
    def page(i, blocks):
        body = "".join(f"<p>part {i} {k}</p><h2>head {i} {k}</h2><ul class=c{k % 3}><li>x{i}{k}</li></ul>" for k in range(blocks))
        return f"<body><div class=top>My site</div><div class=x>{body}</div><div class=foot>Write to us</div></body>"

    pages = [page(i, 3) for i in range(6)] + [page(6, 2500), page(7, 2600)]
    assert max(len(wrappers.folded(wrappers.parse(p)[0])) for p in pages) ** 2 > 16_000_000
    assert ["/body/div.top", "My site"] in wrappers.infer(pages)["fixed"]
    assert ["/body/div.foot", "Write to us"] in wrappers.infer(pages)["fixed"]


def test_odd_pages(spark):
    rows = [(1, "http://a.example/x", None), (2, None, "<p>x"), (3, "no url", "<p>y"), (None, "http://a.example/", "<p>z"), (1, "http://a.example/x", ""),
            (4, "HTTP://A.example:80/q", "<p>z"), (4, "HTTP://A.example:80/q", "<p>z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'h' AS host", "'w' AS wrapper", "1 AS row_key")
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in wrappers.extracted(pages).collect())
    assert got == [(0, "z", 1), (1, "", 0), (1, "", 0), (2, "x", 1), (3, "y", 1), (4, "z", 1), (4, "z", 1)]
    assert wrappers.extracted(pages.limit(0)).count() == 0


def test_template_texts_are_counted_over_all_pages(spark):
    def page(i, foot="Write to us", extra=""):
        return f"<body><div class=x><p>Story {i} goes on</p><div><p>{foot}</p><p>Small print</p></div>{extra}</div></body>"

    copies = [page(0)] * 200  # copies of one page fill any sample of rows
    pages = [page(i, extra="<p class=z>odd</p>" if i == 7 else "") for i in range(1, 30)]
    rows = [(i, f"http://a.example/{i}", p) for i, p in enumerate(copies + pages + [page(99, "An odd foot")])]
    got = {r.page_id: r.text for r in wrappers.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == "Story 0 goes on" and got[206] == "Story 7 goes on\nodd" and got[210] == "Story 11 goes on"
    assert got[229] == "Story 99 goes on\nAn odd foot"


def shop_page(i, n=None):
    """No article element, and class names that no list has."""
    story = [f"Paragraph {k} of story {i} goes on for a while." for k in range(n or 2 + i % 3)]
    teasers = "".join(f"<div class=q7><p>Teaser {i} {k}</p></div>" for k in range(2))
    body = (f"<body><div class=k1><p>My site</p><ul><li>Home<li>About</ul></div><div class=k2>{teasers}</div>"
            f"<div class=k3><h1>Story {i}</h1><p>By staff</p>{''.join(f'<p>{s}</p>' for s in story)}<p>All rights reserved</p></div><div class=k4>Imprint</div></body>")
    return body, "\n".join([f"Story {i}", *story])


def test_pages_without_article_and_known_names(spark, monkeypatch):
    pages = [shop_page(i) for i in range(30)] + [shop_page(30, 400)]
    rows = [(i, f"http://shop.example/{i}", html) for i, (html, _) in enumerate(pages)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in wrappers.extracted(table).collect()}
    assert got == {i: want for i, (_, want) in enumerate(pages)}
    found = wrappers.infer([html for html, _ in pages[:8]])
    assert found["place"] == "/body/div.k3" and [wrappers.main_text(html, found) for html, _ in pages] == [want for _, want in pages]
    monkeypatch.setattr(wrappers, "aligned", lambda one, two: [])
    blind = wrappers.infer([html for html, _ in pages[:8]])
    assert all(wrappers.main_text(html, blind) != want for html, want in pages)


def test_a_slot_is_content_though_its_text_is_common():
    def page(i):
        mood = "calm" if i % 10 else "stormy"  # nine of ten pages agree, at a place where pages differ
        return f"<body><article><h1>Report {i}</h1><p>Mood</p><div class=m><p>{mood}</p></div><p>Written {i}</p></article></body>"

    marks = {wrappers.mark_of("/body/article/p", "Mood"), wrappers.mark_of("/body/article/div.m/p", "calm")}
    found = wrappers.infer([page(i) for i in range(3, 11)], marks) | {"marks": marks}
    assert wrappers.main_text(page(25), found) == "Report 25\ncalm\nWritten 25"
    assert wrappers.main_text(page(20), found) == "Report 20\nstormy\nWritten 20"


def test_a_group_that_stands_once_is_matched_with_its_repeats():
    def page(i, n):
        return "<body><div class=x><ul>" + "".join(f"<li>item {i} {k}</li>" for k in range(n)) + "<li>more</li></ul><p>Body</p></div></body>"

    found = wrappers.infer([page(i, 1 + i % 4) for i in range(8)])
    assert any(k[0] == "(" and n == 8 for k, _, n in found["nodes"])
    once = wrappers.folded(wrappers.parse(page(9, 0))[0], found["groups"])
    assert [k for k, _ in once if k[0] == "("] == ["(<li #/body/div.x/ul/li </li)+"]
    assert wrappers.main_text(page(9, 2), found) == "item 9 0\nitem 9 1"


def test_a_wrapper_is_inferred_from_all_unlike_pages(spark):
    def page(host, i):
        mood = "calm" if i % 8 else "stormy"  # five of forty pages differ: less than 0.9 agree, so it is a slot
        rare = f"<ul><li>a{i}</li><li>b{i}</li></ul>" if i in (3, 31) else ""
        body = f"<div class=k1><p>{'part ' * 40}{i}</p>{rare}</div>" if i < 30 else f"<div class=k2><p>{'other ' * 40}{i}</p>{rare}</div>"
        return f"<body><div class=k0>Site {host}</div><div class=all>{body}<div class=m{'' if i < 20 else ' id=n%d' % i}><p>{mood}</p></div></div></body>"

    rows = [(100 * h + i, f"http://h{h}.example/{i}", page(h, i)) for h in range(12) for i in range(40)]
    table = spark.createDataFrame(rows + rows[:40], "page_id long, url string, html string")
    found = {r.host: json.loads(r.wrapper) for r in wrappers.host_wrappers(table).collect()}
    assert len(found) == 12
    for wrapper in found.values():
        assert wrapper["count"] == 40 and wrapper["place"] == "/body/div.all"  # neither of the two bodies holds 0.7
        pages = {k: n for k, _, n in wrapper["nodes"]}
        assert pages["<body"] == 40 and pages["#/body/div.all/div.k2/p"] == 10
        assert not any(".n2" in k for k in pages)  # what a single page has matches no other page
    one = wrappers.infer([page(0, i) for i in range(40)])
    assert one["place"] == "/body/div.all" and one["count"] == 40
    got = {r.page_id: r.text for r in wrappers.extracted(table).collect()}
    assert all(got[100 * h + i].startswith(("part", "other")) and "Site" not in got[100 * h + i] for h in range(12) for i in range(40))
    assert all(got[100 * h + i].endswith("calm" if i % 8 else "stormy") for h in range(12) for i in range(40))


def test_a_very_long_page_is_read_whole(spark):
    body = "".join(f"<p>part {k}</p><h2>head {k}</h2><div class=c{k % 7}>x{k}</div>" for k in range(5000))
    html_ = f"<body><div class=top>My site</div><div class=x>{body}</div></body>"
    rows = [(1, "http://a.example/1", html_), (2, "http://a.example/2", html_.replace("part 17<", "part y<")), (3, "http://a.example/3", "<p>short</p>")]
    got = {r.page_id: r.text for r in wrappers.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "short" and got[1].count("\n") >= 14_999 - 1 and "part y" in got[2] and "x4999" in got[2]


# Vectors


def brute(rows, every=100, k=10):
    ids, data = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    for i in ids[ids % every == 0]:
        gaps = np.sqrt(((data - data[ids == i][0]) ** 2).sum(1))
        yield i, [(int(v), g) for g, v in sorted((g, v) for g, v in zip(gaps.tolist(), ids.tolist()) if v != i)[:k]]


def test_recall_and_scores(spark):
    rows = [(r.vec_id, r.embedding) for r in queries.table(spark, SMALL, "embeddings").collect()]
    got = defaultdict(list)
    for r in queries.QUERIES["op8_forest"](spark, SMALL).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    shares = []
    for key, want in brute(rows):
        own = sorted(got[key])
        assert [o[0] for o in own] == list(range(1, len(own) + 1)) and [(o[2], o[1]) for o in own] == sorted((o[2], o[1]) for o in own)
        assert all(abs(o[2] - float(np.linalg.norm(np.array(dict(rows)[key], float) - np.array(dict(rows)[o[1]], float)))) < 1e-9 for o in own)
        shares.append(len({o[1] for o in own} & {w[0] for w in want}) / len(want))
    assert np.mean(shares) >= 0.9


def test_recall_of_a_deep_forest(spark):
    rng = np.random.default_rng(7)
    centers = rng.standard_normal((30, 16))
    rows = [(i, (centers[i % 30] + rng.standard_normal(16) * 0.5).tolist()) for i in range(3000)]
    found = forest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), leaf=16, sample=1000).collect()
    got = defaultdict(set)
    for r in found:
        got[r.query_id].add(r.vec_id)
    assert np.mean([len(got[k] & {v for v, _ in want}) / 10 for k, want in brute(rows)]) >= 0.9


def test_recall_holds_as_the_table_grows(spark):
    rows = list(enumerate(np.random.default_rng(7).standard_normal((20_000, 64)).tolist()))
    got = defaultdict(set)
    for r in forest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=500).collect():
        got[r.query_id].add(r.vec_id)
    assert np.mean([len(got[k] & {v for v, _ in want}) / 10 for k, want in brute(rows, 500)]) >= 0.93


def test_odd_and_equal_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 2.0]) for i in range(0, 230)] + [(1000, None), (1100, [0.0, 0.0]), (1200, [nan, 1.0]), (1300, [inf, 1.0]), (1400, [None, 1.0]), (1500, [1.0, 2.0, 3.0]),
                                                       (1600, [9.0, 9.0]), (1601, [9.0, 8.5]), (100, [1.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS leaf", "2 AS v")
    chunk, forest.CHUNK = forest.CHUNK, 50
    try:
        got = defaultdict(list)
        for r in forest.nearest(frame).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.vec_id, round(r.score, 6)))
    finally:
        forest.CHUNK = chunk
    assert set(got) == {0, 100, 200, 1600}
    assert got[0] == [(i, 0.0) for i in range(1, 11)] and got[100] == [(i, 0.0) for i in range(10)]
    assert got[1600][0] == (1601, 0.5) and [v for v, _ in got[1600][1:]] == list(range(9))
    assert forest.nearest(frame.limit(0)).count() == 0
    few = forest.nearest(frame.filter("vec_id IN (100, 7, 8)")).collect()
    assert sorted((r["rank"], r.vec_id) for r in few) == [(1, 7), (2, 8)]


# Conversations


def least_cost(roles):
    best = {chat.START: 0}
    for role in roles:
        after = {}
        for p, c in best.items():
            for q in (chat.SYSTEM, chat.USER, chat.ASSISTANT):
                if (p, q) in chat.BETWEEN:
                    after[q] = min(after.get(q, 99999), c + 3 * len(chat.BETWEEN[p, q]) + 2 * (q != role))
                if p == q:
                    after[q] = min(after.get(q, 99999), c + 1 + 2 * (q != role))
        best = after
    return min(c + 3 * len(chat.AT_END[s]) for s, c in best.items())


def test_repairs_are_legal_and_cheapest(spark):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", None, " User"]), rng.choice(["x", "<|im_end|>", None, ""])) for c in [*range(40), None] for t in range(rng.randint(1, 7))]
    rows += [(99, t, rng.choice(["user", "assistant"]), f"z{t % 7}") for t in range(400)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS part", "2 AS seq", "'s' AS said")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = chat.repaired(frame).collect()
        again = chat.repaired(frame.repartition(3)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(map(str, got)) == sorted(map(str, again))
    parts = defaultdict(list)
    for r in got:
        parts[r.conv_id].append(r)
    for conv in parts:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: r[1])
        own = sorted(parts[conv], key=lambda r: r.position)
        assert [r.position for r in own] == list(range(len(turns)))
        assert sum(r.units for r in own) == least_cost([chat.STATE.get((r[2] or "").strip().lower(), 0) for r in turns])
        text = "".join(r.rendered for r in own)
        roles = [p.split("\n")[0] for p in text.split(chat.OPENED)[1:]]
        assert text.count(chat.CLOSED) == len(roles) and text.endswith(chat.CLOSED + "\n")
        talk = roles[1:] if roles[0] == "system" else roles
        assert talk == ["user", "assistant"] * (len(talk) // 2) and talk
    assert chat.repaired(frame.limit(0)).count() == 0


def test_a_block_costs_what_its_turns_cost():
    turns = [(chat.USER, 1), (chat.USER, 2), (chat.ASSISTANT, 3), (0, 4)]
    left, right, whole = chat.transfer(turns[:2]), chat.transfer(turns[2:]), chat.transfer(turns)
    assert all(whole[p][q] == min(left[p][k] + right[k][q] for k in range(4)) or whole[p][q] >= chat.FAR for p in range(4) for q in range(4))


# The pipeline


def test_pipeline_stages(spark, reference):
    docs = queries.table(spark, SMALL, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept, columns = docs, docs.columns
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, SMALL)
        if name != "tokens":
            assert kept.columns == columns
            kept = spark.createDataFrame(kept.collect(), docs.schema)
        counts.append(kept.count())
    assert counts == sorted(counts, reverse=True) and counts[1] > counts[2] > counts[3] == counts[4] == counts[5] > counts[0] // 2
    rows = kept.collect()
    assert all(r.round_trip for r in rows) and len({r.doc_id for r in rows}) == len(rows)
    plain = [r for r in rows if not re.search(r"\d|@", texts[r.doc_id])]
    assert plain and all(r.token_ids == reference.encode(texts[r.doc_id]) for r in plain)


def test_pipeline_runs_through(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 0
