import collections
import random
import re

from pyspark.sql import functions as F

from tlake.llm import decontam, html_text, jaccard, queries
from tlake.llm.components import components

SMALL = "/root/testdata/sf0.001"


def brute(given, percent=85):
    """(n_shingles, component) by all pairs; ids are None or int, rows may repeat."""
    sets = []
    for _, text in given:
        w = [x for x in re.split("[ \t-\r]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if x]
        sets.append(frozenset(tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))) if w else frozenset())
    parent = list(range(len(given)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(given)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = collections.defaultdict(list)
    for i, (doc_id, _) in enumerate(given):
        least[find(i)].append(doc_id)
    pick = {r: min((x for x in ids if x is not None), default=None) for r, ids in least.items()}
    return sorted(str((d, len(sets[i]), pick[find(i)])) for i, (d, _) in enumerate(given))


def ran(df):
    return sorted(str(tuple(r)) for r in df.select("doc_id", "n_shingles", "component_id").collect())


def test_op10_query(spark, rows):
    assert ran(queries.op10_jaccard_join(spark, SMALL)) == brute(rows("documents", "doc_id, text"))


def test_op10_near_copies(spark, monkeypatch):
    """A group of near copies around the threshold, a shared passage, chains; in small blocks too."""
    draw = random.Random(9)
    word = lambda: "".join(draw.choice("abcdef") for _ in range(4))
    base, passage = [word() for _ in range(120)], [word() for _ in range(60)]
    given, chain = [], [word() for _ in range(80)]
    for i in range(60):
        text = list(base)
        for _ in range(draw.randint(0, 7)):
            text[draw.randrange(len(text))] = draw.choice((word(), base[0], base[1]))
        given.append((1000 - i, " ".join(text)))
        given.append((2000 + i, " ".join([word() for _ in range(10)] + passage)))
        chain[draw.randrange(80)] = word()
        given.append((3000 + i, " ".join(chain)))
    docs = spark.createDataFrame(given, "doc_id long, text string")
    want = brute(given)
    assert ran(jaccard.similar_documents(docs)) == want
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "FRAGMENT_SHINGLES", 500)
    assert ran(jaccard.similar_documents(docs)) == want


def test_op10_on_odd_rows(spark, odd_docs):
    given = [(r.doc_id, r.text) for r in odd_docs.collect()]
    given = [(d, t) for d, t in given]
    assert ran(jaccard.similar_documents(odd_docs)) == brute(given)
    assert jaccard.similar_documents(odd_docs.limit(0)).count() == 0


def test_components(spark):
    path = [(f"{i:03d}", f"{i + 1:03d}") for i in range(60)]
    got = components(spark.createDataFrame([*path, ("x", "y"), ("z", "z")], "a string, b string")).collect()
    assert {r.v: r.part for r in got} == {f"{i:03d}": "000" for i in range(61)} | {"x": "x", "y": "x"}


def edit_distance_inside(pattern, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        left = [i]
        for j, b in enumerate(text, 1):
            left.append(min(row[j] + 1, left[-1] + 1, row[j - 1] + (a != b)))
        row = left
    return min(row)


def test_myers_against_the_table():
    draw = random.Random(4)
    for _ in range(300):
        p, t = ("".join(draw.choice("abc") for _ in range(draw.randint(1, n))) for n in (90, 120))
        want = edit_distance_inside(p, t)
        assert decontam.myers(decontam.pattern_bits(p), len(p), t, len(p))[0] == want


def test_finder_against_the_table():
    draw = random.Random(8)
    items = [(i, " ".join(draw.choice(("the", "stone", "river", "of", "and", "blue")) for _ in range(15))) for i in range(6)]
    finder = decontam.Finder(items, 0.1)
    for _ in range(60):
        _, text = draw.choice(items)
        chars = list(text)
        for _ in range(draw.randint(0, 9)):
            chars[draw.randrange(len(chars))] = draw.choice("xyz ")
        doc = decontam.normalise("start " + "".join(chars) + " end")
        got = {(i, d) for i, d, _ in finder.search(doc)}
        want = {(i, d) for i, t in items if (d := edit_distance_inside(t, doc)) <= int(0.1 * len(t))}
        assert got == want


def test_op4_query(spark, rows):
    items = [(i, decontam.normalise(t)) for i, t in rows("benchmark", "item_id, text")]
    want = {(d, i) for d, t in rows("documents", "doc_id, text") for i, p in items if p in decontam.normalise(t)}
    got = queries.op4_decontaminate_edits(spark, SMALL).collect()
    assert want <= {(r.doc_id, r.item_id) for r in got}
    assert {(r.doc_id, r.item_id) for r in got if r.distance == 0} == want


def test_op4_on_odd_rows(spark, odd_docs):
    item = "the long text of one word after another the long text"
    items = spark.createDataFrame([(1, item), (1, item), (None, item), (2, None), (3, ""), (4, "one two")], "item_id long, text string")
    got = decontam.contaminated(odd_docs, items).collect()
    assert [(r.doc_id, r.item_id, r.distance, r.start) for r in got] == [(6, 1, 0, 0)]
    assert decontam.contaminated(odd_docs, items.limit(0)).count() == 0
    assert decontam.contaminated(odd_docs.limit(0), items).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p><article>no</article>";</script></head><body class="has-sidebar">
<nav><ul><li>Home</li></ul></nav><!-- <p>hidden</p> --><div class="cookie-notice">We use cookies</div>
<article><h1>Big &amp; small</h1><p>First&nbsp;  line<br>second <b>bo</b>ld.<p>A &lt;tag&gt; 1 < 2<div class="ad">Buy</div>
<form><label>Mail</label><input name=x></form><p>End.</p><section id='comments'><p>I agree</p></section></article>
<aside>Side</aside><footer>&copy; me</footer></body></html>"""


def test_article_blocks():
    text = " ".join(t for where, t in html_text.blocks(PAGE) if where == html_text.ARTICLE)
    assert text == "Big & small First line second bold. A <tag> 1 < 2 End."


def test_op8_query(spark, rows):
    import html as entities

    got = {r.page_id: r for r in queries.op8_main_text(spark, SMALL).collect()}
    for page_id, url, page in rows("pages", "page_id, url, html"):
        inner = re.search("<article>(.*)</article>", page, re.S)[1]
        want = " ".join(entities.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)>", " ", inner))).split())
        assert (got[page_id].text, got[page_id].n_chars, got[page_id].url) == (want, len(want), url)


def test_pages_without_their_article_tags(spark):
    """Blocks and runs alone give the same text, but for the parts that other pages of the host have as well."""
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "url", "html")
    want = {r.page_id: r.text for r in html_text.main_texts(pages).collect()}
    bare = pages.withColumn("html", F.regexp_replace("html", "</?article[^>]*>", ""))
    got = {r.page_id: r.text for r in html_text.main_texts(bare).collect()}
    assert got.keys() == want.keys()
    assert sum(got[i] == want[i] for i in want) >= 0.9 * len(want)
    assert all(got[i] in want[i] for i in want)


def test_repeated_runs_of_a_host(spark):
    """Pages without an article element: what other pages of the host repeat goes."""
    menu, legal = "Start page About us Contact Archive Search", "All rights reserved by the owners of this place"
    data = [
        (i, f"https://h.example.com/{i}", f"<body><div>{menu}</div><p>Story number {i} tells of {'abcdefgh'[i]} things</p><div>{legal}</div></body>", "x")
        for i in range(8)
    ]
    data += [(20, "http://alone.example.com/", f"<p>{menu}</p>", "x"), (21, None, None, "x"), (22, "odd", "", "x"), data[0]]
    data += [(30, "https://t.example.com/1", "<p>one and the same whole page of words</p>", "x"), (31, "https://t.example.com/2", "<p>one and the same whole page of words</p>", "x")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string, host string")
    got = [(r.page_id, r.text) for r in html_text.main_texts(pages).collect()]
    want = [(i, f"Story number {i} tells of {'abcdefgh'[i]} things") for i in [*range(8), 0]]
    want += [(20, menu), (21, ""), (22, ""), (30, "one and the same whole page of words"), (31, "one and the same whole page of words")]
    assert sorted(got) == sorted(want)
    assert html_text.main_texts(pages.limit(0)).count() == 0


def test_large_hosts_are_dealt_out(spark, monkeypatch):
    """Every page comes back once, whichever way the part counts are joined."""
    data = [(i, f"https://h.example.com/{i}", f"<article>text {i}</article>") for i in range(60)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string")
    monkeypatch.setattr(html_text, "PART_CHARS", 200)
    for many in (20_000, 0):
        monkeypatch.setattr(html_text, "MANY_HOSTS", many)
        got = [(r.page_id, r.text) for r in html_text.main_texts(pages).collect()]
        assert sorted(got) == [(i, f"text {i}") for i in range(60)]


def test_parts_do_not_change_texts(spark, monkeypatch):
    """Menus on all pages, notices on two or three: as many tokens repeat, and the same go, whatever the parts of a host."""
    draw = random.Random(6)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(5))
    some = lambda n: " ".join(word() for _ in range(n))
    menu, notices, twin = some(9), [some(12) for _ in range(40)], f"<p>{some(15)}</p>"
    data, want = [], {}
    for i in range(90):
        own = some(30)
        data.append((i, f"https://h.example.com/{i}", f"<div>{menu}</div><p>{own}</p><div>{notices[i % 40]}</div>"))
        want[i] = own
    data += [(i, f"https://h.example.com/{i}", twin) for i in (100, 101, 102)]  # alike pages are one
    data += [(200, "https://other.example.com/", f"<p>{notices[0]}</p>"), (201, "https://h.example.com/201", None)]
    data.append(data[0])
    want |= {i: twin[3:-4] for i in (100, 101, 102)} | {200: notices[0], 201: ""}
    pages = spark.createDataFrame(data, "page_id long, url string, html string").repartition(5)
    got = []
    for chars, many, held in ((8_000_000, 20_000, 1_000_000), (1_000, 20_000, 1_000_000), (1_000, 0, 100)):
        monkeypatch.setattr(html_text, "PART_CHARS", chars)
        monkeypatch.setattr(html_text, "MANY_HOSTS", many)
        monkeypatch.setattr(html_text, "HELD_RUNS", held)
        got.append(sorted((r.page_id, r.text, r.n_repeated_tokens) for r in html_text.main_texts(pages).collect()))
        assert [(i, t) for i, t, _ in got[-1]] == sorted([*want.items(), (0, want[0])])
    assert got[0] == got[1] == got[2]


def test_covered_against_plain():
    draw = random.Random(2)
    for _ in range(30):
        streams = [[draw.choice("abc") for _ in range(draw.randint(0, 40))] for _ in range(5)]
        seen = collections.defaultdict(set)
        for s in streams:
            for i in range(len(s) - 5):
                seen[tuple(s[i : i + 6])].add(tuple(s))
        want = [[any(len(seen[tuple(s[i : i + 6])]) > 1 for i in range(max(0, k - 5), min(k, len(s) - 6) + 1)) for k in range(len(s))] for s in streams]
        assert [m.tolist() for m in html_text.covered(streams)] == want
