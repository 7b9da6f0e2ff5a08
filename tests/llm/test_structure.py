"""Web pages, fill-in-the-middle and conversations against brute force, with their defined cases."""

import hashlib
import html
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairmill.llm import fill_middle, html_extract, queries, turn_repair

# ---- pages

PAGES = "page_id long, url string, html string, text string, digest int"


def _texts(spark, rows):
    df = spark.createDataFrame([(i, u, h, "clash", 1) for i, u, h in rows], PAGES)
    return {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()}


def test_given_pages_by_their_article(spark, sf_dir):
    got = {r["page_id"]: r for r in queries.op11_html_extract(spark, sf_dir).collect()}
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        article = re.search(r"<article>(.*?)(</article>|\Z)", p["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        want = "\n\n".join(x for x in parts if x)
        assert (got[p["page_id"]]["text"], got[p["page_id"]]["n_chars"], got[p["page_id"]]["url"]) == (want, len(want), p["url"])


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""),
        ("", ""),
        ("plain &amp; simple &lt;b&gt; &#233;&nbsp; x", "plain & simple <b> é x"),
        ("<p>one<br>two <b>th</b>ree<p>four", "one two three\n\nfour"),
        ("<nav>menu<article><h1>T</h1><p>a</article>", "T\n\na"),
        ("<header><h1>Site</h1></header><main><p>m<form>f</form><div class='Share-box'>s<div>t</div></div>n</main>", "m\n\nn"),
        ("<article><header class='post-header'><h1>T</h1></header><p>a<footer>by x</footer></article><section id=comments><article class=comment>no</article></section>", "T\n\na"),
        ("<article><p>a</p><div class='comment-list'><p>reader</p></div><p hidden>h</p><p>b</p></article>", "a\n\nb"),
        ("<script>var t='</p><article>no</article>';</script><style>p{}</style><!-- <p>c --><article>a < b && c<!-- x --></article>", "a < b && c"),
        ("<div role=navigation>n</div><div role='main'>body <a title='x > y' href=z>link</a></div>", "body link"),
        ("<article>  &copy a&amp;amp;b </article>", "© a&amp;b"),
        ("<head><title>t</title><p>text", "text"),
        ("<article></article><p>only this", "only this"),
        ("<!-- never closed <p>x", ""),
        ("<p>a</p><script>never closed <p>x", "a"),
        ("a <b", "a <b"),
        ("<p>x</p><!doctype odd> tail", "x\n\ntail"),
        ("<p title=\"5' wide>a</p><p>b</p>", "a\n\nb"),
        ("<aside><p>a</aside><div>" + "w " * 50_000 + "</div>", ("w " * 50_000).strip()),
    ],
)
def test_parts_of_a_page(page, want):
    found = html_extract.blocks(page)
    best = max((k for k, _ in found), default=html_extract.SIDE)
    assert "\n\n".join(t for k, t in found if k == best and k > html_extract.SIDE) == want


@pytest.mark.parametrize("page", ['<a "' * 200_000, "<div><b>" * 100_000 + "x", "<!--" * 200_000, "<script>" * 50_000, "<a '\">" * 100_000, "</div>" * 200_000 + "<i>" * 50_000])
def test_broken_pages_are_read_in_time(page):
    began = time.time()
    html_extract.blocks(page)
    assert time.time() - began < 20


def _sites(n=30):
    rows = []
    for i in range(n):
        h = i % 2
        menu = f"<div>Home About us Contact Our shop Blog of site number {h}</div>"
        end = f"<div>All rights reserved by the owner of this site {h} since then</div>"
        rows.append((i, f"http://h{h}.org/{i}", f"<body>{menu}<p>Unique words number {i} x{i * 7} are here to stay {i * 13}.</p><p>short {i}</p>{end}"))
    # the same menu where a page declares it, and a host of its own with one page
    rows.append((n, "http://h0.org/q", "<nav>Home About us Contact Our shop Blog of site number 0</nav><p>alone</p>"))
    rows.append((n + 1, "http://other.org/", "<div>Home About us Contact Our shop Blog of site number 0</div>"))
    return rows


def test_repeated_runs_of_a_host_go(spark):
    got = _texts(spark, _sites())
    for i in range(30):
        assert got[i] == f"Unique words number {i} x{i * 7} are here to stay {i * 13}.\n\nshort {i}"
    assert got[30] == "alone"
    assert got[31] == "Home About us Contact Our shop Blog of site number 0"


def test_chunks_change_nothing(spark, monkeypatch):
    whole = _texts(spark, _sites())
    monkeypatch.setattr(html_extract, "CHUNK", 60)
    assert _texts(spark, _sites()) == whole


def test_copies_are_one_page_and_stay(spark):
    page = "<div>the same text of more than eight words on every page</div>"
    got = _texts(spark, [(i, "http://a.b/", page) for i in range(50)] + [(None, None, page), (None, None, None)])
    assert set(got.values()) <= {"the same text of more than eight words on every page", ""}
    # near copies: all blocks are repeated, so nothing tells an article from a template
    near = [(i, "http://a.b/", page + f"<p>{page}</p>" + ("<nav>x</nav>" * i)) for i in range(5)]
    assert len(set(_texts(spark, near).values())) == 1 and "" not in _texts(spark, near).values()


def test_repeated_articles_stay(spark):
    rows = [(i, "http://a.b/", f"<nav>menu {i}</nav><article><p>a passage of many words that all pages of the host share, word by word</p><p>own {i}</p></article>") for i in range(9)]
    assert all(t.startswith("a passage of many words") and t.endswith(f"own {i}") for i, t in _texts(spark, rows).items())


def test_suffix_array_against_brute_force():
    rng = random.Random(5)
    run = html_extract.RUN
    pages = [[rng.randint(1, 3) for _ in range(rng.randint(0, 40))] for _ in range(12)]
    hosts = [i % 2 for i in range(12)]
    tokens = [np.array(p, np.uint64) * np.uint64(2) + np.uint64(1) + np.uint64(100 * h) for p, h in zip(pages, hosts)]
    table = pa.table({"chunk": np.zeros(12, np.int64), "host": np.array(hosts, np.int64), "tokens": pa.array([t.tobytes() for t in tokens], pa.binary())})
    got = html_extract._local_heads(table)
    want = defaultdict(set)
    for i, t in enumerate(tokens):
        for j in range(len(t) - run + 1):
            want[hosts[i], tuple(t[j : j + run])].add(i)
    assert Counter((h, n) for h, n in zip(got["host"].to_pylist(), got["n"].to_pylist())) == Counter((h, len(v)) for (h, _), v in want.items())
    assert len(set(got["head"].to_pylist())) == len(want)


def _repeated(pages):
    """Blocks and blocks found repeated of (id, host, html), by sets of runs instead of the array."""
    run, streams = html_extract.RUN, {}
    for i, host, page in pages:
        found = html_extract.blocks(page)
        tokens = [w for k, t in found if k < html_extract.MAIN for w in (*t.split(), "")]
        streams[i] = host, tuple(found), tuple(tokens)
    seen = defaultdict(set)
    for host, found, tokens in streams.values():
        for j in range(len(tokens) - run + 1):
            seen[host, tokens[j : j + run]].add(found)
    want = {}
    for i, (host, found, tokens) in streams.items():
        covered = set()
        for j in range(len(tokens) - run + 1):
            if len(seen[host, tokens[j : j + run]]) >= html_extract.MIN_PAGES:
                covered |= set(range(j, j + run))
        gone = begin = 0
        for end in (j for j, w in enumerate(tokens) if not w):
            gone += 2 * len(covered & set(range(begin, end))) >= end - begin
            begin = end + 1
        want[i] = len(found), gone
    return want


def test_a_menu_of_different_articles_is_known_where_it_is_not_declared(spark):
    menu = "Home About us Contact Our shop Blog of the site"
    rows = [(i, "http://a.b/", f"<nav>{menu}</nav><article>own {i}</article>") for i in range(3)]
    rows += [(3, "http://a.b/", f"<div>{menu}</div><p>text of an undeclared page")]
    # copies of one page aren't different pages
    rows += [(10 + i, "http://c.d/", f"<nav>{menu}</nav><article>same</article>") for i in range(3)]
    rows += [(13, "http://c.d/", f"<div>{menu}</div><p>text of an undeclared page")]
    got = _texts(spark, rows)
    assert got[3] == "text of an undeclared page"
    assert got[13] == f"{menu}\n\ntext of an undeclared page"
    assert [got[i] for i in (0, 1, 2, 10, 11, 12)] == ["own 0", "own 1", "own 2", "same", "same", "same"]


def test_declared_pages_meet_the_array(spark):
    menu, end = "Home About us Contact Our shop Blog of the site", "All rights reserved by the owner of this site since then"
    html_of = lambda i: f"<nav>{menu}</nav><div class=ad>{i} only {i}</div><article><h1>T{i}</h1><p>own {i}</article><footer>{end}</footer>"
    rows = [(i, "http://a.b/", html_of(i)) for i in range(4)] + [(9, "http://c.d/", html_of(9)), (10, "http://c.d/", "<article>all of it</article>")]
    got = {r["page_id"]: r for r in html_extract.extract(spark.createDataFrame([(i, u, h, "", 1) for i, u, h in rows], PAGES)).collect()}
    assert {i: (r["text"], r["n_blocks"], r["n_repeated"]) for i, r in got.items()} == {
        **{i: (f"T{i}\n\nown {i}", 5, 2) for i in range(4)},
        9: ("T9\n\nown 9", 5, 0),
        10: ("all of it", 1, 0),
    }


def test_verdicts_of_given_pages_against_brute_force(spark, sf_dir):
    folder = sf_dir.replace("sf0.001", "sf0.1")  # hosts of more pages
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", html_extract.host(F.col("url")), "html").collect()
    want = _repeated(pages)
    got = {r["page_id"]: (r["n_blocks"], r["n_repeated"]) for r in queries.op11_html_extract(spark, folder).collect()}
    assert got == want and sum(n for _, n in want.values()) > 0


@pytest.mark.parametrize("n", range(10))
def test_streams_shorter_than_a_run(n):
    tokens = np.arange(1, n + 1, dtype=np.uint64)
    table = pa.table({"chunk": [0], "host": [1], "tokens": pa.array([tokens.tobytes()], pa.binary())})
    assert len(html_extract._local_heads(table)) == max(n - html_extract.RUN + 1, 0)


def test_no_pages(spark):
    assert _texts(spark, []) == {}


# ---- fill-in-the-middle


def _fim(i, t):
    t = t or ""
    n, h = len(t), hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    if not t or re.search("<[PSM]>", t) or h3 % 100 >= 90:
        return n, "plain", None, None, t
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = t[:a], t[a:b], t[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_fill_middle_against_brute_force(spark):
    rng = random.Random(3)
    texts = [None, "", "a", "é€😀\n\r\x00x", "has <P> in it", "<", "<P", "P>", "<S", " \x85 é", "x" * 49, "x" * 50, "x" * 51, "é" * 100, "ab😀" * 700_000]
    texts += ["".join(rng.choice("ab <>PSM\n😀é") for _ in range(rng.randint(0, 260))) for _ in range(400)]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(None, "no id", "", 2), (7, texts[7], "", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, output string, n int")
    got = fill_middle.fill_middle(df).collect()
    want = [(r[0], *_fim(r[0], r[1]), r[1] or "") for r in rows]
    assert Counter(map(tuple, got)) == Counter(want)
    assert {"plain", "psm", "spm"} == {r["form"] for r in got}
    short = fill_middle.fill_middle(df, texts=False).collect()
    assert Counter((r["doc_id"], r["output_sha256"], r["restored_sha256"]) for r in short) == Counter((w[0], *(hashlib.sha256(x.encode()).hexdigest() for x in w[5:])) for w in want)


def test_fill_middle_of_other_recipes_and_no_rows(spark):
    recipe = fill_middle.Recipe(seed=9, plain=0, spm=100, prefix="<|pre|>", suffix="<|suf|>", middle="<|it's|>")
    df = spark.createDataFrame([("k", "some words to be cut"), ("l", "<|suf|>")], "key string, body string")
    got = {r["doc_id"]: r for r in fill_middle.fill_middle(df, recipe, "key", "body").collect()}
    assert got["k"]["form"] == "spm" and got["k"]["restored"] == "some words to be cut" and got["k"]["output"].startswith("<|suf|>")
    assert got["l"]["form"] == "plain"
    assert fill_middle.fill_middle(df.limit(0), recipe, "key", "body").collect() == []


# ---- conversations

FORWARD = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}


def _insertions(best):
    again = True
    while again:
        again = False
        for s, (cost, audit, lines) in list(best.items()):
            for q, name in (("u", "user"), ("a", "assistant")):
                if s in FORWARD[q]:
                    new, to = (cost + 5, audit + "I", [*lines, name + ":"]), FORWARD[q][s]
                    if to not in best or new[:2] < best[to][:2]:
                        best[to], again = new, True
    return best


def _repair(rows):
    """What the contract says of (conv_id, turn, role, text) rows, damaged, by conversation."""
    ids = {}
    for c, t, r, x in rows:
        own = ids.setdefault(c, [])
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
        own += [(t, "user" if k == 4 else r, x)] * (0 if k == 0 else 2 if k == 3 else 1)
    out = {}
    for c, own in ids.items():
        own.sort(key=lambda q: (q[0] is not None, q[0] or 0, q[1], q[2]))
        seen, faults = set(), []
        for _, r, x in own:
            w = re.sub(r"[\x20\x09-\x0d]", "", x)
            faults.append("b" if not w else "d" if (r, x) in seen else "t" if w[-1] not in ".!?" else "")
            seen.add((r, x))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        best = _insertions({0: (0, "", [])})
        for (_, r, x), f in zip(own, faults):
            new = {}

            def put(to, made):
                if to not in new or made[:2] < new[to][:2]:
                    new[to] = made

            for s, (cost, audit, lines) in best.items():
                put(s, (cost + 2, audit + "D", lines))
                if f in ("b", "d"):
                    continue
                cost += 5 * (f == "t")
                if r[:1] in FORWARD and s in FORWARD[r[:1]]:
                    put(FORWARD[r[:1]][s], (cost, audit + "K", [*lines, f"{r}:{x}"]))
                for q, name in (("u", "user"), ("a", "assistant")):
                    if s in FORWARD[q]:
                        put(FORWARD[q][s], (cost + 1, audit + "R", [*lines, f"{name}:{x}"]))
            best = _insertions(new)
        cost, audit, lines = min(best[s] for s in (0, 3) if s in best)
        text = "\n".join(lines)
        out[c] = (gaps, *map(faults.count, "bdt"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


TURNS = "conv_id long, turn long, role string, text string"


def _report(df):
    return {r["conv_id"]: tuple(r)[1:] for r in turn_repair.repair_report(turn_repair.damage(df), df).collect()}


def test_given_conversations_against_brute_force(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    got = {r["conv_id"]: tuple(r)[1:] for r in queries.op13_turn_repair(spark, sf_dir).collect()}
    assert got == _repair([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


@pytest.mark.parametrize("block", [256, 3])
def test_odd_conversations_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(turn_repair, "BLOCK", block)
    rng, rows = random.Random(block), []
    for c in [None, *range(90)]:
        for t in range(rng.randint(1, 8)):
            rows.append((c, rng.choice([None, t, t, t + 3, 1]), rng.choice(["user", "assistant", "system", "tool", None, "u", "a", ""]), rng.choice(["a.", "b", "", "  \t", None, "x! ", "y?\n", "same."])))
    rows += [(777, t, rng.choice(["user", "assistant", "system"]), rng.choice([f"t{t}.", f"t{t}", "dup.", ""])) for t in range(700)]
    rows += rows[:5] + [(778, 0, "user", "long " * 40_000 + ".")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], TURNS + ", audit string, rank int")
    assert _report(df) == _repair(rows)


def test_conversation_of_which_nothing_is_left(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "hi.")], TURNS)
    assert _report(df) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert _report(df.limit(0)) == {}
