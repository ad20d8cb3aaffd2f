"""Pages and conversations."""

import collections
import functools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonaril.llm import chat_hmm, site_tree


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>T</title>{head}</head><body>{body}</body></html>"


def test_main_text_of_one_page():
    h = page('<header>Top</header><nav><ul><li>Home<li>More</ul></nav><main><div class="cookie-notice">We use</div><aside>side</aside><article><h1>A &amp; B</h1><p>One <b>bold</b>&nbsp;two<p>Three\n  four<form>f</form><div class="ad">buy</div><script>var x="<p>no</p>";</script><section id="comments"><p>me too</p></section><p>Four&#8217;s</p></article></main><footer>&copy; x</footer>')
    assert site_tree.extract(h, set()) == "A & B One bold two Three four Four’s"
    for h in (None, "", "<", "<p", page(""), "<nav>only</nav>"):
        assert site_tree.extract(h, set()) in ("", "<", "<p")
    assert site_tree.extract("<p>plain &lt;tag&gt;<p>next", set()) == "plain <tag> next"


def test_site_tree_removes_what_all_pages_share(spark):
    rows = [(i, f"http://h.example/{i}", page(f"<div class='strip2x'><p>Same words on every page</p></div><div class='story'><p>Own text {i} {i * i}</p></div>")) for i in range(40)]
    rows += [(100, None, None), (101, "http://h.example/x", ""), (102, "//other/1", page("<div class='strip2x'><p>Same words on every page</p></div>"))]
    got = {r.page_id: r for r in site_tree.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows) and all(got[i].text == f"Own text {i} {i * i}" for i in range(40))
    assert got[100].text == "" and got[100].n_chars == 0 and got[102].text == "Same words on every page"
    low = site_tree.unimportant(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.host for r in low} == {"h.example"}
    assert site_tree.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_copies_of_a_page_keep_their_text(spark):
    strip = "<div class='strip2x'><p>Same words on every page</p></div>"
    html = [page(f"{strip}<div class='story'><p>Own text {i} {i * i}</p></div>") for i in range(30)]
    marked = [page(f"<article><p>Head {i}</p><div class='story'><p>Own text {i} {i * i}</p></div></article>") for i in range(30)]
    rows = [(1000 * k + i, f"http://{h}.example/{i}", pages[max(i - 999, 0)]) for k, (h, pages) in enumerate((("h", html), ("m", marked))) for i in range(1029)]
    rows += [(5000 + i, f"http://only.example/{i}", html[7]) for i in range(1000)]
    got = {r.page_id: r.text for r in site_tree.main_texts(spark.createDataFrame([(i + 10000 * k, u, h) for k, (i, u, h) in enumerate(rows)], "page_id long, url string, html string").repartition(5)).collect()}
    assert len(got) == len(rows)
    for k, (i, u, _) in enumerate(rows):
        t, n = got[i + 10000 * k], 7 if "only" in u else max(int(u.rpartition("/")[2]) - 999, 0)
        own = f"Own text {n} {n * n}"
        assert t == (own if "//h." in u else f"Head {n} {own}" if "//m." in u else f"Same words on every page {own}")


def test_malformed_declarations_lose_no_text(spark):
    for odd in ("<![if !IE]>", "<![foo[x]]>", "<!ENTITY % a 'b'>", "<!-", "<![", "<!DOCTYPE [<!ELEMENT"):
        assert "two" in site_tree.extract(f"<p>one {odd}> two<p>three", set()) and site_tree.extract(f"<p>one<p>two{odd}", set()).startswith("one two")
    rows = [(1, "http://a/1", page("<article><p>" + "word " * 200_000 + "</article>"), 5)] * 2 + [(2, None, page("<article><p>x</article>"), 6)]
    got = site_tree.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string, N_chars int"))
    assert sorted((r.page_id, r.n_chars) for r in got.collect()) == [(1, 999_999)] * 2 + [(2, 1)]


def plain_text(n):
    """All letters under a node."""
    parts = [c if isinstance(c, str) else plain_text(c) for c in n.children] if n.tag not in site_tree.RAW else []
    return "".join("".join(parts).split())


def plain_tree(pages):
    """Unimportant paths of each host, said plainly: paths as tuples, styles and contents as they are."""
    low = {}
    for host in {site_tree.host_of(u) for _, u, _ in pages}:
        styles, contents = collections.defaultdict(list), collections.defaultdict(list)
        for html in {h or "" for _, u, h in pages if site_tree.host_of(u) == host}:
            parts = collections.defaultdict(list)
            todo = [((), site_tree.parse(html))]
            while todo:
                path, n = todo.pop(0)
                if path and n.tag not in site_tree.RAW:
                    parts[path].insert(0, n)  # the last first, as the operator takes them
                todo += [((*path, c.sign), c) for c in n.children if not isinstance(c, str)]
            for path, ns in parts.items():
                style = []
                for n in ns:
                    signs = [c.strip() and "#text" if isinstance(c, str) else c.sign for c in n.children]
                    signs = [x for x in signs if x]
                    style += [x for i, x in enumerate(signs) if not i or x != signs[i - 1]]
                styles[path].append(tuple(style))
                contents[path].append([plain_text(n) for n in ns])
        for path in styles:
            count = lambda xs: [xs.count(x) for i, x in enumerate(xs) if x not in xs[:i]]
            importance = 0.5 * site_tree.log_entropy(count(styles[path])) + 0.5 * site_tree.log_entropy(count(contents[path]))
            if len(styles[path]) >= site_tree.LEAST_PAGES and importance < site_tree.THRESHOLD:
                low.setdefault(host, set()).add(path)
    return low


def test_trees_against_plain_ones(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(4))
    blocks = [lambda: "<div class='story'><p>" + " ".join(word() for _ in range(9)) + "</p></div>", lambda: "<div class='strip'><ul><li>Home<li>News</ul></div>", lambda: f"<div id='b{rng.randrange(3)}'><span>{rng.randrange(2)}</span></div>", lambda: "<p>Plain line</p>", lambda: f"<section><h2>{word()}</h2>Same</section>"]
    pages = [(i, f"http://{'abc'[i % 3]}.example/{i}", page("".join(rng.choice(blocks)() for _ in range(rng.randrange(2, 6))))) for i in range(60)]
    pages += [(100 + i, *pages[i][1:]) for i in range(6)]
    got = {r.host: set(r.paths) for r in site_tree.unimportant(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    fold = lambda path: functools.reduce(lambda p, sign: site_tree._then(p, site_tree._id(sign)), path, 0)
    want = {h: {fold(p) for p in ps} for h, ps in plain_tree(pages).items()}
    assert got == want and all(want.values())


@pytest.mark.parametrize("html", ["<div>" * 100_000 + "deep", "<span>" * 60_000 + "</b>" * 60_000 + "<p>deep", "<article>" * 40_000 + "deep" + "</article>" * 40_000, "<ul>" * 30_000 + "<li>" * 30_000 + "deep", "<p><b>" * 30_000 + "deep"])
def test_deep_and_unclosed_pages_take_no_longer(html):
    """Time grows with the page, whatever its depth."""
    began = time.perf_counter()
    features = site_tree.page_features(site_tree.parse(html))
    assert features and site_tree.extract(html, set()) == "deep"
    assert time.perf_counter() - began < 20


def test_contents_do_not_depend_on_markup():
    one, two, other = (site_tree.parse(h) for h in ("<div>ab <b>c</b>d é</div>", "<div>a<i>b cd</i> <u></u>é</div>", "<div>ab cd e</div>"))
    for r in (one, two, other):
        site_tree.note_contents(r)
    assert one.content == two.content != other.content


def test_entropy_of_grouped_counts():
    assert site_tree.log_entropy([5]) == 0 and abs(site_tree.log_entropy([1] * 8) - 1) < 1e-12


TURNS = [("user", "How do I do it?"), ("assistant", "Like this:\nfirst a,\nthen b."), ("user", "And then?"), ("assistant", "Nothing more.")]


def conversations(spark, n=12):
    rows = [(c, t, *TURNS[t]) for c in range(n) for t in range(4)] + [(50, t, *TURNS[t % 4]) for t in range(400)]
    rows += [(60, 0, None, None), (None, 0, "user", "no id?"), (61, None, "user", "no turn?"), (0, 0, "user", "How do I do it?")]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_transcripts_come_back(spark):
    df = conversations(spark)
    got = chat_hmm.format_chats(df).toPandas()
    for c in [*range(1, 12), 50]:
        g = got[got.conv_id == c].sort_values(["part", "seq"])
        want = TURNS if c != 50 else TURNS * 100
        assert list(zip(g.role, g.content, strict=True)) == want
    assert list(got[got.conv_id == 50].groupby("part").size()) == [64] * 6 + [16]
    assert got.rendered[got.conv_id == 1].iloc[0].startswith("<|im_start|>") and (got.conv_id == 60).sum() == 0
    assert chat_hmm.format_chats(df.limit(0)).count() == 0


def plain_path(hmm, lines):
    """Viterbi said plainly, line by line."""
    best = None
    for line in lines:
        m, rest = chat_hmm.split_marker(line)
        e = hmm.emit[m * 24 + chat_hmm.feature(rest)]
        if best is None:
            best = [(hmm.start[s] + e[s], [s]) for s in range(8)]
        else:
            best = [max(((v + hmm.trans[p[-1], s] + e[s], [*p, s]) for v, p in best), key=lambda x: x[0]) for s in range(8)]
    return max(best, key=lambda x: x[0])[1]


@pytest.mark.parametrize("fan", [64, 3])
def test_parts_decode_as_the_whole(spark, fan):
    every = chat_hmm.marked_lines(conversations(spark))
    hmm = chat_hmm.fit(every)
    # most turns without a name
    lines = every.filter("conv_id = 50").withColumn("line", F.when(F.col("turn") % 3 == 0, F.col("line")).otherwise(F.regexp_replace("line", r"^(###? *\w+:\n|\w+: |\[\w+\] |<\|\w+\|>)", "")))
    parts = chat_hmm.transcripts(lines, 8)
    assert parts.count() == 50
    text = [x for r in parts.orderBy("part").collect() for x in r.text.split("\n")]
    whole = [chat_hmm.ROLES[s // 2] for s in plain_path(hmm, text) if s % 2 == 0]
    got = chat_hmm.parse(parts, hmm, fan).filter("NOT continued").orderBy("part", "seq")
    assert [r.role for r in got.collect()] == whole


def test_roles_of_unseen_transcripts(spark):
    """Turns without a name, of conversations that taught nothing: what the lines look like tells the roles."""
    rng = random.Random(4)
    text = {"user": lambda: "How about " + " ".join("abcdefg"[: rng.randrange(2, 6)]) + "?", "assistant": lambda: "It is so. " + "word " * rng.randrange(35, 70)}
    rows = [(c, t, r := ("user", "assistant")[t % 2], text[r]()) for c in range(90) for t in range(6)]
    lines = chat_hmm.marked_lines(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    unnamed = F.regexp_replace("line", r"^(###? *\w+:\n|\w+: |\[\w+\] |<\|\w+\|>)", "")
    # of the transcripts to learn from, every third turn has no name
    hmm = chat_hmm.fit(lines.filter(~chat_hmm.held_out(lines)).withColumn("line", F.when(F.col("turn") % 3 == 2, unnamed).otherwise(F.col("line"))))
    bare = lines.filter(chat_hmm.held_out(lines) & (F.col("turn") > 0)).withColumn("line", unnamed)
    shown = lines.filter(chat_hmm.held_out(lines) & (F.col("turn") == 0))
    got = chat_hmm.parse(chat_hmm.transcripts(bare.unionByName(shown)), hmm).orderBy("conv_id", "seq").toPandas()
    want = {c: ["user", "assistant"] * 3 for c in got.conv_id.unique()}
    right = sum(list(g.role) == want[c] for c, g in got.groupby("conv_id"))
    assert len(want) > 20 and right >= 0.95 * len(want)


def test_chats_on_hard_rows(spark):
    """Repeated rows, rows without ids, equal turns in a crowd, clashing columns, a very long text."""
    rows = [(7, 0, "user", "same", 1)] * 50 + [(None, None, "user", f"no id {i}", 1) for i in range(40)] + [(8, 0, "user", "long " * 100_000, 1), (8, 1, "assistant", "short", 1), (9, -70, "user", "early", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part int")
    lines = chat_hmm.marked_lines(df)
    got = chat_hmm.parse(chat_hmm.transcripts(lines, crowd=16), chat_hmm.fit(lines)).toPandas()
    assert list(got[got.conv_id == 7].content) == ["same"] * 50 and got[got.conv_id == 7].part.nunique() > 2 and sorted(got[got.conv_id.isna()].content) == sorted(f"no id {i}" for i in range(40))
    assert list(got[got.conv_id == 8].sort_values(["part", "seq"]).role) == ["user", "assistant"] and list(got[got.conv_id == 9].content) == ["early"]


def test_markers():
    name = lambda line: (chat_hmm.NAMES + [None])[chat_hmm.split_marker(line)[0]]
    assert name("Human: hi") == "human" and chat_hmm.split_marker("[ASSISTANT] x")[1] == "x" and name("[ASSISTANT] x") == "assistant"
    assert name("### System:") == "system" and chat_hmm.split_marker("### System:")[1] == "" and name("<|tool|>r") == "tool"
    assert name("Users: many") is None and np.isfinite(chat_hmm.feature(""))


def test_a_crowd_keeps_the_order_of_turns(spark):
    """40 turns of 30 rows each: split or not, the transcript is the same."""
    rows = [(3, t, ("user", "assistant")[t % 2], f"turn {t} row {i}") for t in range(40) for i in range(30)] + [(4, t, "user", "few") for t in range(3)]
    lines = chat_hmm.marked_lines(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))

    def text(crowd):
        parts = chat_hmm.transcripts(lines, crowd=crowd).orderBy("conv_id", "part").collect()
        return {c: "\n".join(r.text for r in parts if r.conv_id == c) for c in (3, 4)}, len(parts)

    (whole, n), (split, m) = text(10_000), text(64)
    assert whole == split and n == 2 and m == 41
    hmm = chat_hmm.fit(lines)
    roles = lambda crowd: [r.role for r in chat_hmm.parse(chat_hmm.transcripts(lines, crowd=crowd), hmm).filter("conv_id = 3 AND NOT continued").orderBy("part", "seq").collect()]
    assert roles(10_000) == roles(64)
