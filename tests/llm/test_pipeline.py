import hashlib

import corpus_pipeline
from pyspark.sql import functions as F

from tlake.llm import byte_bpe, decontam, jaccard, langid, nbsvm, queries

SMALL = "/root/testdata/sf0.001"


def test_stages_against_their_operators(spark):
    """The same models, then plain Python on collected rows."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = nbsvm.train(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    hashes = nbsvm.Hashes()
    left = [r for r in docs.collect() if model.score(nbsvm.indicators(r.text, hashes)) >= 0.3]
    good = docs.filter(F.col("doc_id").isin([r.doc_id for r in left]))
    speech = langid.train(good)
    left = [r for r in left if (p := speech.predict(r.text))[0] != "und" and p[1] >= speech.reject_below]
    good = docs.filter(F.col("doc_id").isin([r.doc_id for r in left]))
    first = {r.component_id for r in jaccard.similar_documents(good).collect()}
    items = [(r.item_id, decontam.normalise(r.text)) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    finder = decontam.Finder(items, 0.08)
    left = [r for r in left if r.doc_id in first and not finder.search(decontam.normalise(r.text))]
    encoder = byte_bpe.Encoder(byte_bpe.load_ranks(queries.BYTE_RANKS), queries.public_tokenizers.PATTERN)
    want = {r.doc_id: hashlib.sha256(" ".join(map(str, encoder.encode(r.text or ""))).encode()).hexdigest() for r in left}
    assert {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, SMALL).collect()} == want


def test_stages_on_odd_rows(spark, odd_docs):
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, odd_docs, SMALL)
        assert name == corpus_pipeline.STAGES[-1][0] or got.columns == odd_docs.columns
        got.count()
        assert stage(spark, odd_docs.limit(0), SMALL).count() == 0


def test_one_document_of_each_group(spark, odd_docs):
    """Repeated rows, an id with two texts, null ids with and without words."""
    got = corpus_pipeline.ngram_jaccard(spark, odd_docs, SMALL)
    assert got.columns == odd_docs.columns
    got = [(r.doc_id, r.text) for r in got.collect()]
    text = {r.doc_id: r.text for r in odd_docs.collect()}
    assert sorted(got, key=lambda x: x[0]) == [(i, text[i]) for i in (1, 3, 4, 5, 6, 7, 8)]
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    near = a + " end"
    given = [(3, near), (5, a), (5, b), (5, b), (None, a), (None, near), (None, c), (None, c + " end"), (None, ""), (None, ""), (None, None), (7, ""), (7, ""), (8, "")]
    docs = spark.createDataFrame(given, "doc_id long, text string").repartition(3)
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.ngram_jaccard(spark, docs, SMALL).collect()]
    c_kept = [x for x in kept if x[0] is None and x[1] in (c, c + " end")]
    assert len(c_kept) == 1
    rest = [(3, near), (5, b), (None, ""), (None, None), (7, ""), (8, "")]
    assert sorted(map(str, kept)) == sorted(map(str, rest + c_kept))
