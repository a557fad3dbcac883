import random
import zlib

import numpy as np

from tlake.llm import divergence, langid, nbsvm, queries, toxicity

MEDIUM = "/root/testdata/sf0.01"


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def label(spark, name):
    return {r.doc_id: r[name] for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}


def test_op3_held_out(spark):
    got, y = queries.op3_quality_nbsvm(spark, MEDIUM).collect(), label(spark, "quality")
    assert len(got) == 1000 and all(r.held_out == (fold(r.doc_id, 5) == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [(r.predicted, y[r.doc_id]) for r in got if r.held_out and r.doc_id in y]
    assert np.mean([a == b for a, b in held]) > 0.95


def test_op6_held_out(spark):
    got, y = queries.op6_toxicity(spark, MEDIUM).collect(), label(spark, "toxic")
    assert len(got) == 1000 and all(r.held_out == (fold(r.doc_id, 4) == 2) for r in got)
    held = [(r.predicted, y[r.doc_id]) for r in got if r.held_out and r.doc_id in y]
    assert np.mean([a == b for a, b in held]) > 0.93


def test_op7_held_out(spark):
    got = queries.op7_language_id(spark, MEDIUM).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()}
    assert len(got) == 1000
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97
    assert np.mean([r.rejected for r in got]) < 0.01


def test_classifiers_on_odd_rows(spark, odd_docs):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 1), (None, 1, 1), (8, None, 5)], "doc_id long, quality int, toxic int")
    for classify, train in ((nbsvm.classify, nbsvm.train), (toxicity.classify, toxicity.train)):
        got = classify(odd_docs, train(odd_docs, labels)).collect()
        assert len(got) == 10 and all(0 <= r.score <= 1 for r in got)
        same = [r.score for r in got if r.doc_id in (4, 3, 5)]
        assert len(set(same)) == 1  # null, empty and blank texts
        assert classify(odd_docs.limit(0), train(odd_docs.limit(0), labels)).count() == 0
        none = classify(odd_docs, train(odd_docs, labels.limit(0))).collect()
        assert {r.score for r in none} == {0.5}
    got = langid.identify(odd_docs, langid.train(odd_docs)).collect()
    assert len(got) == 10
    assert {(r.lang_pred, r.score, r.rejected) for r in got if r.doc_id in (3, 4, 5)} == {("und", 0.0, True)}
    assert all(r.lang_pred in ("en", "de", "und") for r in got)
    assert langid.identify(odd_docs.limit(0), langid.train(odd_docs.limit(0))).count() == 0


def test_dual_coordinate_descent_separates():
    rows = [(np.array([i % 2]), np.array([1.0])) for i in range(40)]
    y = np.array([1.0 if i % 2 else -1.0 for i in range(40)])
    w = nbsvm.dual_coordinate_descent(rows, y, 2)
    assert all(y[i] * (w[ids] @ v + w[2]) > 0.9 for i, (ids, v) in enumerate(rows))


def test_swaps_change_the_score_little():
    """Women are named in toxic texts only, men in clean ones: the penalty takes that away."""
    sample = [(f"you women idiot {i}", 1) for i in range(30)] + [(f"good men here {i}", 0) for i in range(30)]
    sample += [(f"an idiot again {i}", 1) for i in range(30)] + [(f"nice day {i}", 0) for i in range(60)]
    gaps = []
    for penalty in (0.0, 20.0):
        m = toxicity.fit(sample, penalty=penalty)
        a = toxicity.Active(m.weights)
        gaps.append(abs(m.score("some women sing", a) - m.score("some men sing", a)))
        assert m.score("idiot", a) > 0.5 > m.score("nice day", a)
    assert gaps[1] < 0.3 * gaps[0]


def base(text):
    words, text = [w for w in (text or "").translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if w], text or ""
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = {k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(i, i + 8)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        dup += line in lines and bool(line.strip(" \t\x0b\x0c\r"))
        lines.add(line)
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), failed


def test_op2_counts(spark, rows):
    short = [(i, t) for i, t in rows("documents", "doc_id, text") if len(t or "") < 8000]
    got = {r.doc_id: r for r in queries.op2_divergence_rules(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == 200
    for i, text in short:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(text)
        assert not (r.base_failed and r.kept)


def test_op2_keeps_clean_and_drops_junk(spark):
    got, y = queries.op2_divergence_rules(spark, MEDIUM).collect(), label(spark, "quality")
    judged = [(r.kept, y[r.doc_id]) for r in got if r.doc_id in y and not r.base_failed]
    assert np.mean([k for k, v in judged if v == 1]) > 0.98
    assert np.mean([k for k, v in judged if v == 0]) < 0.3


POLISH = (
    "wczesnym rankiem stary rybak wyszedł z domu nad jeziorem i powoli poszedł w stronę przystani gdzie czekała jego łódź "
    "nikt nie wiedział dlaczego co roku płynął właśnie tam gdzie woda była najgłębsza a wiatr najsilniejszy mówiono że szuka "
    "dzwonu który przed laty zatonął razem z promem ale on sam nigdy o tym nie opowiadał tylko uśmiechał się i naprawiał sieci"
).split()


def test_op2_drops_text_of_no_known_language(spark):
    """Random letters and a language without reference, at three lengths; drawn words of a known language stay."""
    references = divergence.count_references(spark.read.parquet(f"{MEDIUM}/documents.parquet"))
    draw = random.Random(5)
    letters = lambda: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randint(2, 9)))
    q = references.shares[1]
    rest = ["".join(draw.choice("aeinrst") for _ in range(6)) for _ in range(3000)]
    known = lambda: (references.vocabulary[1][k].decode() if (k := draw.choices(range(len(q)), q)[0]) < len(q) - 1 else draw.choice(rest))
    data = []
    for n in (50, 300, 5000):
        for kind, word in (("letters", letters), ("polish", lambda: draw.choice(POLISH)), ("known", known)):
            for _ in range(5):
                w = [word() for _ in range(n)]
                data.append((f"{kind} {n}", ". ".join(" ".join(w[i : i + 12]).capitalize() for i in range(0, n, 12)) + "."))
    got = divergence.judge(spark.createDataFrame(data, "doc_id string, text string"), references).collect()
    assert len(got) == 45 and not any(r.base_failed for r in got)
    assert {r.doc_id for r in got if r.kept} == {"known 50", "known 300", "known 5000"}
    assert sum(r.kept for r in got) == 15


def test_op2_on_odd_rows(spark, odd_docs):
    got = divergence.judge(odd_docs, divergence.count_references(odd_docs, min_words=1)).collect()
    assert len(got) == 10 and all(r.base_failed and not r.kept for r in got if r.doc_id != 6)
    none = divergence.judge(odd_docs, divergence.count_references(odd_docs.limit(0))).collect()
    assert all(r.word_distance is None and r.kept == (not r.base_failed) for r in none)


def test_distance():
    p = np.array([[0.5, 0.5, 0.0], [0.0, 0.0, 1.0]])
    assert np.allclose(divergence.distance(p, np.array([0.5, 0.5, 0.0])), [0, 1])
