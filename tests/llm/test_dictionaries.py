"""Dictionaries of many languages, and of samples longer than their share."""

from schemaweft.llm import languages


def test_every_sampled_document_enters(spark):
    rows = [(i, f"mark{i}x " + "слово " * 400, "ru") for i in range(2000)] + [(i, f"mark{i}x", "en") for i in range(2000)]
    trained = languages.dictionaries(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {k: v.count(b"mark") for k, v in trained.items()} == {"ru": 64, "en": 64}
    assert len(trained["ru"]) <= languages.DICTIONARY_BYTES and trained["ru"].decode()


def test_shares():
    assert languages._shared([b"a" * 50, b"bb", b"c" * 9], 32) == [b"a" * 19, b"bb", b"c" * 9]
    assert languages._shared(["é".encode() * 9, b"b" * 9], 8) == ["éé".encode(), b"bbb"]
    assert languages._shared(["é".encode() * 9, b"b" * 9], 6) == ["é".encode(), b"bb"]
    assert languages._shared([], 8) == []


def test_more_languages_than_256(spark):
    rows = [(i, f"text of language {i} " * 20, f"l{i}") for i in range(300)]
    trained = languages.dictionaries(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(trained) == 300 and sum(map(len, trained.values())) <= languages.TOTAL_BYTES
