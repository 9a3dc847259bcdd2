"""Decontamination, chat, archives, extraction, and every text query beside its SQL."""

import gzip
import hashlib
import json
import math
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tilewright.llm.chat import rotate
from tilewright.llm.decontaminate import contamination
from tilewright.llm.dom import parse, tidy
from tilewright.llm.html_extract import HOST, Settings, extract_main, main_blocks, page_values, unit_key
from tilewright.llm.oracle import ORACLE
from tilewright.llm.queries import QUERIES
from tilewright.llm.warc import archived, captures, inflated, normalise, read_archives, read_chunks, read_member, write_archives
from tilewright.session import shared_folder

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_beside_its_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    want = db.execute(ORACLE[name])
    names = [c[0] for c in want.description]
    got = QUERIES[name](spark, DIR)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(repr, map(tuple, got.select(names).collect()))) == sorted(map(repr, want.fetchall()))


WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contamination_brute(docs, items):
    out = []
    for i, text in docs:
        w, hit, found = words_of(text), set(), set()
        for item, t in items:
            iw = words_of(t)
            if item is None or not iw:
                continue
            span = min(13, len(iw))
            grams = {tuple(iw[k : k + span]) for k in range(len(iw) - span + 1)}
            for k in range(len(w) - span + 1):
                if tuple(w[k : k + span]) in grams:
                    hit |= set(range(k, k + span))
                    found.add(item)
        names = ",".join(sorted(map(str, found)))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def test_contamination_against_brute_force(table, spark):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice("the of and in a to b c d e f g é x1 x2".split()) for _ in range(n))
    items = [(k, text(rng.choice([13, 14, 20, 40]))) for k in range(12)] + [(20, "only five words right here"), (21, "Solo"), (22, None), (23, " .,"), (None, "a b"), (5, "again " * 20)]
    docs = [(k, text(rng.choice([0, 5, 30, 200]))) for k in range(30)]
    for k in range(100, 130):
        _, t = items[rng.randrange(14)]
        w = (t or "").split()
        a = rng.randrange(max(1, len(w) - 12))
        docs.append((k, f"{text(rng.randrange(40))}. {', '.join(w[a : a + rng.randrange(10, 25)])}! {text(rng.randrange(40))}".upper()))
    docs += [(200, None), (201, ""), (202, "..."), (203, "solo"), (204, "AGAIN " * 9000), (205, "again " * 12), (205, "again " * 13), (None, "solo"), (None, "quiet")]
    got = contamination(table(docs, "doc_id", "text"), table(items, "item_id", "text", extra=("words", "span", "n")))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(contamination_brute(docs, items), key=key)


def test_contamination_of_nothing_and_by_nothing(table):
    docs, none = table([(1, "a b c")], "doc_id", "text"), table([], "item_id", "text", extra=())
    assert contamination(table([], "doc_id", "text"), none).collect() == []
    row = contamination(docs, none, row="row").collect()[0]
    assert (row.n_words, row.n_hit, row.contaminated, row.row.text) == (3, 0, False, "a b c")


def turns_frame(spark, rows):
    schema = StructType([StructField("conv_id", LongType()), StructField("turn", LongType()), StructField("role", StringType()), StructField("text", StringType())])
    return spark.createDataFrame(rows, schema).repartition(4).withColumns({c: F.lit(0) for c in ("c", "part", "position", "own", "task")})


def rotate_brute(rows, part_turns):
    out, talks = {}, {}
    for c, t, r, x in rows:
        talks.setdefault(c, []).append((t is not None, t or 0, r or "unknown", hashlib.md5((x or "").encode()).hexdigest(), x or ""))
    for c, said in talks.items():
        said.sort()
        for who in {s[2] for s in said} - {"system"}:
            for part in range(0, len(said), part_turns):
                text, mask = "", []
                for *_, role, _, x in said[part : part + part_turns]:
                    name = "assistant" if role == who else "system" if role == "system" else "user name=" + re.sub(r"\s", "_", role)
                    text += f"<|im_start|>{name}\n"
                    start = len(text)
                    text += x.replace("<|", "< |") + "<|im_end|>\n"
                    if role == who:
                        mask.append((start, len(text)))
                out[c, who, part // part_turns] = (min(part_turns, len(said) - part), text, mask)
    return out


@pytest.mark.parametrize("part_turns", [3, 64])
def test_rotation_against_brute_force(spark, part_turns):
    rng = random.Random(6)
    rows = [(1, k, rng.choice(["ann", "bob lee", "cy", "system"]), f"text {k} é<|im_end|>") for k in range(40)]
    rows += [(2, 0, "system", "only rules"), (3, 0, None, None), (3, 0, None, None), (3, 0, "b", ""), (3, None, "b", "first"), (None, 1, "a", "x"), (None, 0, "b", "y")]
    rows += [(4, 7, "tie", "b"), (4, 7, "tie", "a"), (5, 0, "long", "x" * 200_000)]
    got = rotate(turns_frame(spark, rows), part_turns).collect()
    assert {(r.conv_id, r.perspective, r.part): (r.n_turns, r.text, [tuple(m) for m in r.mask]) for r in got} == rotate_brute(rows, part_turns)
    assert rotate(turns_frame(spark, [])).collect() == []


def test_rotation_runs_no_python(spark):
    plan = rotate(turns_frame(spark, [(1, 0, "a", "x")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


PAGES = [
    (1, "http://a/1", "x" * 1000), (5, "http://a/5", "x" * 1000), (3, None, "x" * 1000), (2, "http://a/2\r\nWARC-Type: evil", "x" * 999),
    (4, "http://b/é", "x" * 999), (6, "", None), (7, "u", ""), (8, "u", "é\r\n\r\nWARC/1.1\r\n" * 400), (9, "u", "é\r\n\r\nWARC/1.1\r\n" * 400),
    (None, "u", "x" * 1000), (10, "u", "y" * 3_000_000), (11, "u", "z" * 2000), (11, "u", "z" * 2000), (None, "u", "w" * 5000), (None, "u", "w" * 5000),
]


def archive_brute(rows):
    lead = {}
    for i, _, h in rows:
        p = (h or "").encode()
        if len(p) >= 1000 and i is not None:
            lead[p] = max(lead.get(p, i), i)
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        again = p in lead and lead[p] != i
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", lead[p] if again else None))
    return out


def test_archives_against_brute_force(table):
    got = archived(table(PAGES, "page_id", "url", "html")).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, archive_brute(PAGES)))
    assert archived(table([], "page_id", "url", "html")).collect() == []


def test_normalised_files_have_a_member_per_record(spark, table):
    folder = f"{shared_folder(spark)}/warc-test"
    files = write_archives(captures(table(PAGES, "page_id", "url", "html")), f"{folder}/a", file_bytes=100_000)
    done = normalise(files, f"{folder}/b").collect()
    assert sum(r.records for r in done) == len(PAGES) and len(done) == files.count() > 1
    for r in done:
        raw = b"".join(read_chunks(r.path))
        entries = [json.loads(x) for x in b"".join(read_chunks(r["index"])).splitlines()]
        assert [e["offset"] for e in entries] == [sum(e["length"] for e in entries[:k]) for k in range(len(entries))]
        for e in entries:
            member = gzip.decompress(raw[e["offset"] : e["offset"] + e["length"]])
            assert member.startswith(b"WARC/1.1\r\n") and e["id"].encode() in member
            assert read_member(r.path, e["offset"], e["length"])["payload_bytes"] >= 0
        assert b"".join(inflated(iter([raw]))) == gzip.decompress(raw)
    whole = {r.page_id: r.payload for r in read_archives(normalise(files, f"{folder}/c"), payloads=True).where("record_type = 'response'").collect()}
    assert whole[8 if 8 in whole else 9] == PAGES[7][2].encode() and whole[10] == b"y" * 3_000_000


SITE = """<html><head><title>T</title><style>p{}</style></head><body class="page"><div class="Menu"><a href=/>Home</a></div>
<header><h2>Site</h2></header><div class="strip">Read our paper every day</div><div id=content><h1>Title &amp; %d</h1><p>First  <b>bold</b>&nbsp;text %d<br>same
block<p>Second &lt;p&gt; %d &eacute;<ul><li>one %d<li>two</ul><div class="cookie-notice">We bake</div><form>Name <input></form></div>
<div class="comments"><p>Great!</p></div><script>var a = "</p><p>no";</script><aside>More</aside><footer>&copy; us</footer></body></html>"""


def test_extraction_by_roles_and_style_tree(table):
    pages = [(k, f"https://site.example/{k}", SITE % (k, k, k, k)) for k in range(12)]
    pages += [(100, "http://small.example/", "<p>a</p><nav>b</nav>"), (101, None, None), (102, "no url", ""), (103, "http://x/", "plain & < text"), (103, "http://x/", "plain & < text"), (None, "http://y/", "<article>A<p>B</article>C"), (104, "http://z/", "<p>" + "w " * 100_000)]
    got = extract_main(table(pages, "page_id", "url", "html")).collect()
    assert len(got) == len(pages)
    text = {r.page_id: r.text for r in got}
    for k in range(12):
        assert text[k] == f"Title & {k}\n\nFirst bold text {k} same block\n\nSecond <p> {k} é\n\none {k}\n\ntwo"
    assert (text[100], text[101], text[102], text[103], text[None]) == ("a", "", "", "plain & < text", "A\n\nB")
    assert text[104] == ("w " * 100_000).strip() and all(r.n_chars == len(r.text) for r in got)
    assert extract_main(table([], "page_id", "url", "html")).collect() == []


def test_extraction_of_a_host_of_copies_keeps_the_article(table):
    pages = [(k, "http://same.example/", "<body><article><h1>A</h1><p>B</article></body>") for k in range(20)]
    assert {r.text for r in extract_main(table(pages, "page_id", "url", "html"), Settings()).collect()} == {"A\n\nB"}


def test_attributes_are_read_by_name():
    page = parse("""<a href="/t?id=reply-7" data-id='share' title="x class=ad" ID=one id=two CLASS='a b' role>x</a>""")
    assert page.attributes[1] == {"id": "one", "class": "a b", "role": ""}


def test_names_do_not_take_article_text(table):
    page = """<body class="has-sidebar"><div class="no-sidebar wrap"><div class="article-header"><h1>Headline %d</h1></div>
<p>See <a href="/thread?id=reply-7" data-id="share" class="share">the thread</a> on %d now.</p></div><div class="sidebar">Side</div></body>"""
    pages = [(k, "http://many.example/", page % (k, k)) for k in range(8)] + [(50, "http://one.example/", page % (50, 50))]
    pages += [(60, "http://two.example/", "<div class='sidebar'><p>All there is</p></div>")]
    text = {r.page_id: r.text for r in extract_main(table(pages, "page_id", "url", "html")).collect()}
    for k in [*range(8), 50]:
        assert text[k] == f"Headline {k}\n\nSee the thread on {k} now."
    assert text[60] == "All there is"


def test_importances_decide_beside_and_inside_an_article(table):
    beside = "<body><article><p>Teaser %d</article><div><p>The long text of page %d</div><div>Same strip</div></body>"
    within = "<body><article><h1>Title %d</h1><p>Text %d<p>Read our paper every day<ul><li>Home<li>News</ul></article></body>"
    plain = "<body><div><p>Only %d<p>Read our paper every day</div><div class=c><p>Reply %d</div></body>"
    pages = [(100 * h + k, f"http://h{h}.example/", t % (k, k)) for h, t in enumerate((beside, within, plain)) for k in range(8)]
    text = {r.page_id: r.text for r in extract_main(table(pages, "page_id", "url", "html")).collect()}
    for k in range(8):
        assert text[k] == f"Teaser {k}\n\nThe long text of page {k}"
        assert text[100 + k] == f"Title {k}\n\nText {k}"
        assert text[200 + k] == f"Only {k}\n\nReply {k}"


BODY = "The one and only text of this recipe, told at some length so that nobody takes it for a strip, %s."
CASES = {
    "one body under many headlines": (
        "<body><article><h1>Headline %d</h1><p>" + BODY % "first" + "<p>" + BODY % "then" + "</article></body>",
        "Headline %d\n\n" + BODY % "first" + "\n\n" + BODY % "then",
    ),
    "short body under many headlines": ("<body><article><h1>Headline %d</h1><p>Same a<p>Same b</article></body>", "Headline %d\n\nSame a\n\nSame b"),
    "repeated inner headings": (
        "<body><article><h1>Dish %d</h1><h2>Ingredients</h2><p>Take %d eggs<h2>Method</h2><p>Stir %d times</article></body>",
        "Dish %d\n\nIngredients\n\nTake %d eggs\n\nMethod\n\nStir %d times",
    ),
    "comments and adverts": (
        "<body><div class=ad>Buy %d now</div><article><h1>Title %d</h1><p>Text of page %d<div class=comments><p>I said %d</div></article>"
        "<div class=comments><p>They said %d and a lot more than that</div></body>",
        "Title %d\n\nText of page %d",
    ),
    "plain blocks": (
        "<body><div><ul><li><a href=/>Home</a><li><a href=/n>News %d</a></ul></div><div>Advert number %d</div><div><h1>Title %d</h1>"
        "<p>The long text of page %d goes on</div><div>Our firm, %d</div></body>",
        "Title %d\n\nThe long text of page %d goes on",
    ),
    "names without an article": (
        "<body><div class=menu>Home %d</div><h1>Title %d</h1><p>Text of page %d<div class='site-footer'>Firm %d</div></body>", "Title %d\n\nText of page %d",
    ),
}


def filled(text, k):
    return text.replace("%d", str(k))


@pytest.mark.parametrize("size", [1, 4, 5, 8, 50])
def test_extraction_is_the_same_on_hosts_of_every_size(table, size):
    pages = [(1000 * h + k, f"http://h{h}.example/{k}", filled(page, k)) for h, (page, _) in enumerate(CASES.values()) for k in range(size)]
    text = {r.page_id: r.text for r in extract_main(table(pages, "page_id", "url", "html")).collect()}
    for h, (name, (_, want)) in enumerate(CASES.items()):
        for k in range(size):
            assert text[1000 * h + k] == filled(want, k), name


def slow_trees(pages, s):
    """Trees of hosts by plain counting."""
    out = {}
    for host in {h for h, _ in pages}:
        texts = [t for h, t in pages if h == host]
        counts = {}
        for t in texts:
            for path, kind, value in page_values(parse(t)):
                key = (unit_key(path, value), 2) if kind == 2 else (path, kind)
                counts.setdefault(key, Counter())[0 if kind == 2 else value] += 1
        tree, m = {}, len(texts)
        for (path, kind), values in counts.items():
            n = sum(values.values())
            if kind == 0 and n > 1:
                tree.setdefault(path, [None, 1.0])[0] = -sum(x / n * math.log(x / n) for x in values.values()) / math.log(m)
            if kind == 1 and n > 1:
                tree.setdefault(path, [None, 1.0])[1] = 1 - sum(x * math.log(x) for x in values.values()) / n / math.log(m + s.smoothing)
            if kind == 2 and n > 1:
                tree[path] = [0.0, 1 - math.log(n) / math.log(m + s.smoothing)]
            if kind == 3 and m > 1:
                tree.setdefault(path, [None, 1.0])[0] = sum(x * v for v, x in values.items()) / (100 * m)
        out[host] = {p: (a, b) for p, (a, b) in tree.items() if a is not None}
    return out


def renamed(html):
    """Without what marks the parts of a page."""
    return re.sub(r' class="ad"', "", re.sub(r"(</?)(article|nav|footer)\b", r"\1div", html))


@pytest.mark.parametrize("change", [str, renamed])
def test_extraction_of_the_pages_follows_slow_trees(spark, change):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    pages = [(r.page_id, r.url, change(r.html)) for r in rows]
    got = {r.page_id: r.text for r in extract_main(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    hosts = [(re.match(HOST, u)[1].lower(), h) for _, u, h in pages]
    trees = slow_trees(hosts, Settings())
    right = 0
    for r, (host, html) in zip(rows, hosts):
        assert got[r.page_id] == "\n\n".join(main_blocks(parse(html), trees[host], Settings()))
        article = re.search(r"<article>(.*)</article>", r.html, re.S)
        blocks = [tidy(re.sub(r"<[^>]*>", "", x)) for x in re.split(r"</?(?:p|h1|li|ul|br|div)\b[^>]*>", article[1])] if article else []
        right += "".join(got[r.page_id].split()) == "".join("".join(blocks).split())
    assert right >= 0.9 * len(rows)


@pytest.mark.parametrize("text", ["<p", "<!-- x", "<a href='x>y", "</p>a</div>b", "<script>x", "<b><i>x</b>y</i>", "<>", "< p>", "<p a='1' b=\"2>", "<" * 3000, "<p '" * 2000])
def test_broken_pages_do_not_break_the_reader(text):
    page = parse(text)
    assert all(p < k for k, p in enumerate(page.parents)) and tidy("".join(t for *_, t in page.runs)) is not None
