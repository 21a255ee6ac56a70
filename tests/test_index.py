import pytest

from lodestar import queries
from lodestar.operators.index import postings, vocabulary
from lodestar.sources.tables import corpus, corpus_docs


def test_all_words_of_long_texts_are_in_the_vocabulary(spark):
    letters = "abcdefghijklmnop"
    many = ["zz" + a + b for a in letters for b in letters]
    docs = spark.createDataFrame([(1, "n.txt", "/f", " ".join(many), "")], "id long, name string, folder string, content string, extra string")
    assert {r.word for r in vocabulary(docs).where("src = 0").collect()} == set(many)


def test_corpus_and_search_full_read_whole_texts(spark, tmp_path, monkeypatch):
    rows = [(1, "alpha " * 4000 + "omega", "en", "src3", 24005)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = corpus_docs(corpus(spark.read.parquet(f"{tmp_path}/documents.parquet")))
    assert postings(docs).where("term = 'omega'").count() == 1 and vocabulary(docs).where("word = 'omega'").count() == 1
    built = []
    monkeypatch.setattr(queries.Index, "build", lambda files, docs: built.append(docs) or (_ for _ in ()).throw(StopIteration))
    with pytest.raises(StopIteration):
        queries.search_full(spark, str(tmp_path))
    assert built[0].first().content == rows[0][1]
