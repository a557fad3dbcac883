import collections
import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import connect, difference
from tlake.llm import fim, lines, negatives, queries

SMALL = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def dedup_brute(given, min_chars=10, min_docs=2):
    """(doc_id, text, n_lines, n_dropped) by plain code; ids are None or int, rows may repeat."""

    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})

    holders = collections.defaultdict(set)
    for doc_id, text in given:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(doc_id)
    out = []
    for doc_id, text in given:
        all_lines = (text or "").split("\n")
        kept = []
        for line in all_lines:
            docs = holders.get(key(line), ())
            first = min((d for d in docs if d is not None), default=None)
            if len(docs) < min_docs or doc_id == first:
                kept.append(line)
        out.append((doc_id, "\n".join(kept), len(all_lines), len(all_lines) - len(kept)))
    return sorted(map(str, out))


def dedup(spark, given, **kw):
    docs = spark.createDataFrame([(*g, "x", 1, "y") for g in given], "doc_id long, text string, h string, pos int, lines string")
    return sorted(str(tuple(r)) for r in lines.drop_repeated_lines(docs, **kw).select("doc_id", "text", "n_lines", "n_dropped").collect())


@pytest.mark.parametrize("name", ["op11_line_dedup", "op12_hard_negatives", "op13_fill_in_middle"])
def test_queries_equal_sql(spark, name):
    assert difference(queries.REGISTRY[name](spark, SMALL), connect(SMALL), queries.ORACLE[name]) == ""


def test_op11_query_equals_plain_code(spark, rows):
    given = rows("documents", "doc_id, text")
    got = queries.op11_line_dedup(spark, SMALL).collect()
    want = {(d, n, gone, sha(t)) for d, t, n, gone in map(eval, dedup_brute(given))}  # noqa: S307
    assert {tuple(r) for r in got} == want and len(got) == len(given)


def test_op11_odd_rows(spark, odd_docs):
    given = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = lines.drop_repeated_lines(odd_docs).collect()
    assert sorted(str(tuple(r)) for r in got) == dedup_brute(given)


def test_op11_lines_at_the_edges(spark):
    """Blank rules, the least length in code points, non-ASCII letters, repeats inside a document, empty lines at the end,
    ids that repeat or are null, and a document of which nothing stays."""
    same = "a line that repeats"
    given = [
        (5, f"{same}\n{same}\nown line of five\n\n"),
        (3, f"  {same.upper()}\t\x0b\x0c\r\nshort one\nx"),
        (9, same),
        (9, f"{same}\nanother text of nine"),
        (None, f"{same}\nonly null holds this"),
        (None, "only null holds this"),
        (7, "ninechars\n日本語日本語日本語日\nÄÖÜ line of umlauts"),
        (8, "ninechars\n日本語日本語日本語日\näöü line of umlauts"),
        (10, " a line that repeats"),
        (11, "A LINE THAT REPEATS ſK"),
        (12, "a line that repeats ſk"),
        (4, None),
        (4, None),
        (6, ""),
    ]
    assert dedup(spark, given) == dedup_brute(given)
    assert dedup(spark, given, min_chars=1, min_docs=3) == dedup_brute(given, 1, 3)
    assert dedup(spark, []) == []


def test_op11_long_text_and_frequent_line(spark):
    """100,000 lines in one text of which every other is held by others too; one line in every document."""
    long = "\n".join(f"line number {i} of the text" for i in range(100_000))
    some = "\n".join(f"Line number {i} of the text " for i in range(0, 100_000, 2))
    given = [(1, some), (2, long), *((i, "the line of all documents\nmine %d" % i) for i in range(3, 300))]
    got = {r.doc_id: r for r in lines.drop_repeated_lines(spark.createDataFrame(given, "doc_id int, text string")).collect()}
    assert (got[2].n_lines, got[2].n_dropped) == (100_000, 50_000) and got[1].text == some
    assert got[2].text == "\n".join(long.split("\n")[1::2])
    assert got[3].text == given[2][1] and {got[i].text for i in range(4, 300)} == {"mine %d" % i for i in range(4, 300)}


def test_op11_text_ids(spark):
    got = lines.drop_repeated_lines(spark.createDataFrame([("b", "one long line here"), ("a", "one long line here")], "doc_id string, text string"))
    assert {r.doc_id: r.text for r in got.collect()} == {"a": "one long line here", "b": ""}


# Fill-in-middle


def fim_brute(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(("1:" + ("" if doc_id is None else str(doc_id))).encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, text)
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return (doc_id, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def filled(docs):
    df = fim.fill_in_middle(docs)
    return [tuple(r) for r in df.select("*", fim.restored(F.col("output"), F.col("form")).alias("back")).collect()]


def test_op13_query(spark, rows):
    got = {tuple(r) for r in queries.op13_fill_in_middle(spark, SMALL).collect()}
    assert got == {(*(w := fim_brute(d, t))[:5], sha(w[5]), sha(t or "")) for d, t in rows("documents", "doc_id, text")}
    assert {g[2] for g in got} == {"plain", "psm", "spm"}


def test_op13_odd_rows(spark, odd_docs):
    key = lambda r: (r[0] is None, r[0], r[5])
    want = [(*fim_brute(r.doc_id, r.text), r.text or "") for r in odd_docs.collect()]
    assert sorted(filled(odd_docs), key=key) == sorted(want, key=key)
    assert filled(odd_docs.limit(0)) == []


def test_op13_marks_and_long_texts(spark):
    """Texts of one to four bytes a character, parts of marks at the cuts, whole marks, a text of 12 MB among small ones."""
    draw = random.Random(13)
    letters = ["<", "P", "S", "M", ">", "a", "é", "語", "🙂", "\n", "\x00"]
    given = [(i, "".join(draw.choice(letters) for _ in range(draw.randrange(40)))) for i in range(3000)]
    given += [(3000 + i, t) for i, t in enumerate(["<P>", "a<S>b", "<M", "<<P", "語" * 4_000_000, "", "x"])]
    got = {r[0]: r for r in filled(spark.createDataFrame(given, "doc_id int, text string").coalesce(2))}
    for doc_id, text in given:
        assert got[doc_id] == (*fim_brute(doc_id, text), text)


def test_op13_units_by_plain_code():
    """Rank and select over words against a scan of the text, at every place."""
    draw = random.Random(4)
    text = "".join(draw.choice(["a", "é", "語", "🙂"]) for _ in range(500))
    data = np.frombuffer(text.encode(), np.uint8)
    ends = np.cumsum([len(c.encode()) for c in text])
    units = fim.Units(data)
    assert units.select(np.arange(1, 501)).tolist() == ends.tolist()
    places = np.arange(len(data) + 1)
    assert units.rank(places).tolist() == [int((ends <= p).sum()) for p in places]


def test_op13_marks_must_split_exactly(spark):
    with pytest.raises(ValueError):
        fim.fill_in_middle(spark.createDataFrame([(1, "a")], "doc_id int, text string"), sentinels=("<<", "<>", "<M"))


# Hard negatives


def mined_brute(given, every=50, n_positives=5, n_negatives=3, share=(50, 95)):
    """All scores by plain loops over (vec_id, vector, label); a null id sorts last."""
    good = [
        (i, [int(np.floor(256 * float(x))) for x in v], label)
        for i, v, label in given
        if label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    out = []
    for at, (anchor, q, label) in enumerate(good):
        if anchor is None or anchor % every:
            continue
        scored = [
            (-sum(a * b for a, b in zip(q, v)), i is None, i, other == label)
            for n, (i, v, other) in enumerate(good)
            if n != at
        ]
        scored.sort(key=lambda r: r[:2] + (r[2] or 0,))
        for score, _, positive, _ in [r for r in scored if r[3]][:n_positives]:
            inside = [r for r in scored if not r[3] and share[0] * -score <= 100 * -r[0] <= share[1] * -score]
            out += [(anchor, positive, k + 1, r[2], -score, -r[0]) for k, r in enumerate(inside[:n_negatives])]
    return sorted(map(str, out))


def mined(spark, given, **kw):
    df = spark.createDataFrame([(*g, "x", 1) for g in given], "vec_id long, embedding array<double>, label int, slot string, score int")
    got = negatives.hard_negatives(df, **kw)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(str(tuple(r)) for r in got.collect())


def test_op12_odd_rows(spark):
    """Nulls everywhere, not finite components, vectors of other lengths, repeated ids and rows, ties, negative ids."""
    draw = np.random.default_rng(5)
    given = [(int(i), draw.normal(size=8).tolist(), int(i) % 3) for i in range(-60, 240)]
    given += [(50, given[0][1], 1), (50, given[0][1], 1), (None, given[3][1], 2), (None, given[3][1], 2), (100, [0.5], 0), (150, [], 1)]
    given += [(i, given[70][1], i % 2) for i in range(300, 420)]  # one vector, many ids
    given += [(200, None, 1), (250, [1.0, None], 1), (300, [float("nan")] * 8, 1), (350, [float("inf")] + [0.0] * 7, 0), (400, [1.0] * 8, None)]
    assert mined(spark, given) == mined_brute(given)
    # Small tiles: the best of each cell are put together.
    assert mined(spark, given, tile_rows=(3, 50)) == mined_brute(given)


def test_op12_empty_and_wide(spark):
    assert mined(spark, []) == []
    draw = np.random.default_rng(6)
    wide = [(i, draw.normal(size=70).tolist(), i % 4) for i in range(120)]
    assert mined(spark, wide, anchor_every=10, levels=2) == mined_brute(wide, every=10)


def test_op12_huge_components_are_cut(spark):
    given = [(0, [1e300, 1.0], 1), (1, [1e300, 0.0], 1), (2, [1.0, 1.0], 2)]
    df = spark.createDataFrame(given, "vec_id long, embedding array<double>, label int")
    assert negatives.hard_negatives(df).collect() == []
    assert negatives.largest_number(64) ** 2 * 64 <= 2**56


def test_op12_intervals_hold_and_filter(rows):
    """Every score lies in its interval, and on the given vectors few rows are left to score."""
    given = [np.array(v) for (v,) in rows("embeddings", "embedding")]
    numbers = np.floor(256 * np.array(given, dtype=np.float64)).astype(np.int32)
    turns = negatives.rotations(64, negatives.LEVELS, 12)
    bits, aligned, rest = negatives.encode(numbers, turns)
    ones = np.bitwise_count(bits).sum(axis=2, dtype=np.int64)
    scored = 0
    lows, highs = negatives.Queries(numbers[::50], turns).intervals(slice(None), bits, ones, aligned, rest)
    for q, low, high in zip(numbers[::50], lows, highs):
        exact = numbers.astype(np.int64) @ q.astype(np.int64)
        assert (low <= exact).all() and (exact <= high).all()
        scored += int((high >= np.partition(low, -5)[-5]).sum())
    assert scored < 0.2 * len(numbers) * len(numbers[::50])


def test_op12_covers_all_anchors():
    n = duckdb.connect().execute(f"select count(*) from '{SMALL}/embeddings.parquet' where vec_id % 50 = 0").fetchone()[0]
    got = duckdb.connect().execute(f"with embeddings as (from '{SMALL}/embeddings.parquet') select count(distinct anchor_id) from ({queries.ORACLE['op12_hard_negatives']})").fetchone()[0]
    assert got <= n
