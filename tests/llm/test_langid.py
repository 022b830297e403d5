import zlib

from tests.llm.conftest import SF

from quarry.llm import langid, queries


def test_held_out_accuracy_and_defined_cases(spark, documents, no_documents):
    sf = SF.replace("sf0.001", "sf0.01")
    got = {r.doc_id: r for r in queries.op3_language_id(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    held = [r for r in docs if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(got[r.doc_id].held_out for r in held) and sum(g.held_out for g in got.values()) == len(held)
    right = sum(got[r.doc_id].lang_pred == r.lang for r in held)
    assert right / len(held) > 0.95
    assert all(0 <= g.score <= 1 for g in got.values())
    model = langid.train(documents)
    odd = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(documents, model).collect()}
    assert odd[0] == odd[1] == odd[2] == odd[3] == ("und", 0.0)
    assert odd[5] == odd[6] and odd[5][0] == "en"
    assert langid.train(no_documents) is None
    assert langid.identify(no_documents, None).count() == 0


def test_prediction_reads_the_text_only(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.train(docs)
    a = langid.identify(docs, model).collect()
    b = langid.identify(docs.selectExpr("doc_id", "text", "'xx' as lang", "1 as score", "'z' as id"), model).collect()
    assert sorted(a) == sorted(b)


def test_repeated_and_missing_ids_in_the_sample(spark):
    rows = [(7, "the cat and the dog went home", "en")] * 30 + [(8, "der Hund und die Katze gehen heim", "de")] * 30 + [(None, "the end of the day", "en"), (9, "the end", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = langid.identify(df, langid.train(df)).collect()
    assert len(got) == 62 and {r.lang_pred for r in got if r.doc_id == 7} == {"en"} and {r.lang_pred for r in got if r.doc_id == 8} == {"de"}
