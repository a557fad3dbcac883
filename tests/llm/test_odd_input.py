"""Short items, ids that are text, clashing names, very long texts."""

import resource

import numpy as np
from pyspark.sql import functions as F

from tlake.llm import byte_bpe, decontam, jaccard, langid, nbsvm, toxicity


def found(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id string, text string")
    return sorted((r.doc_id, r.item_id, r.distance) for r in decontam.contaminated(d, i, whole_texts=True).collect())


def test_op4_short_items(spark):
    items = [("q", "What is the capital of Mongolia?"), ("ja", "東京は日本の首都ですか、それとも京都ですか"), ("w", "capital"), ("none", "?!"), ("two", "the old man")]
    docs = [
        (1, "He asked: what is the capital of Mongolia! Nobody knew."), (2, "what is the capital of mongolias"), (3, "Capital."),
        (4, "the capital city"), (5, "東京は日本の首都ですか、それとも京都ですか"), (6, "質問：東京は日本の首都ですかそれとも京都ですか。はい"),
        (7, "The old man"), (8, "the old man and the sea"), (9, "?!"), (10, None), (11, ""),
    ]
    got = found(spark, docs, items)
    assert [(d, i) for d, i, _ in got] == [(1, "q"), (3, "w"), (5, "ja"), (6, "ja"), (7, "two")]
    assert {x for d, i, x in got if d != 6} == {0}


def test_op4_borders_by_plain_scan():
    finder = decontam.Finder([(1, "one two three four")], 0.08)
    for text, hit in [("one two three four", True), ("xone two three four", False), ("a one two three four b", True), ("one two three fours", False),
                      ("one two three four one two three fours", True), ("語one two three four語", True)]:
        assert bool(finder.search(text)) == hit


def test_text_ids(spark):
    docs = spark.createDataFrame([(f"d{i}", f"good text number {i} of many" if i % 2 else "x ## $$ 11", "en" if i % 2 else "de", i) for i in range(60)], "doc_id string, text string, lang string, n int")
    labels = spark.createDataFrame([(f"d{i}", i % 2, i % 2) for i in range(60)], "doc_id string, quality int, toxic int")
    assert nbsvm.classify(docs, nbsvm.train(docs, labels)).count() == 60
    assert toxicity.classify(docs, toxicity.train(docs, labels)).count() == 60
    assert langid.identify(docs, langid.train(docs)).count() == 60
    mixed = labels.withColumn("doc_id", F.substring("doc_id", 2, 9).cast("long"))
    assert nbsvm.classify(docs, nbsvm.train(docs, mixed)).count() == 60


def test_first_of_groups_with_clashing_names(spark):
    names = ["text_digest", "first_rows", "first_id", "first_text", "_first0_id", "part", "key"]
    text = "one two three four five six seven"
    rows = [(1, text, *names), (1, text, *names), (2, text.upper(), *names), (3, "other words than those", *names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    kept = jaccard.first_of_groups(docs).orderBy("doc_id").collect()
    assert [r.doc_id for r in kept] == [1, 3] and list(kept[0])[2:] == names and kept[0].__fields__ == docs.columns


def test_op7_long_text_takes_bounded_memory():
    draw = np.random.default_rng(1)
    languages = [f"l{i}" for i in range(50)]
    model = langid.LanguageModel(languages, draw.normal(size=(1 << langid.BITS, 50)).astype(np.float32), np.zeros(50), 1.0, 0.0)
    text = "Ein langer Satz mit vielen Wörtern. " * 30_000  # a million characters
    plain = model.table[langid.subwords(text)].mean(axis=0, dtype=np.float64)
    assert np.allclose(model.logits(text), plain)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    model.logits(text * 10)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000  # KB; a row of logits a subword would be 4 GB


def test_op9_merges_at_once_equal_one_by_one():
    import public_tokenizers

    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    draw = np.random.default_rng(3)
    pieces = [bytes(draw.choice(list(b"abcdetnos \xc3\xa9"), draw.integers(1, 40)).astype(np.uint8)) for _ in range(3000)] + [bytes([i]) for i in range(256)]
    merged = byte_bpe.Merges(ranks)(pieces)
    assert [np.frombuffer(m, np.int32).tolist() for m in merged] == [byte_bpe.merge(p, ranks) for p in pieces]
    assert byte_bpe.Merges(ranks)([]) == []


def test_op6_pairs_are_a_sample_of_the_whole_text():
    terms = sorted(toxicity.OTHERS)[:3]
    text = ". ".join(f"sentence {i} about {terms[i % 3]} people" for i in range(200))
    pairs = toxicity.swapped(text)
    numbers = [int(a.split()[1]) for a, _ in pairs]
    assert len(pairs) == 20 and max(numbers) > 100 and min(numbers) < 100
    assert toxicity.swapped(text) == pairs and toxicity.swapped("nobody is named") == []
