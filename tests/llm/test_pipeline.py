"""The pipeline's stages against brute force on a small fixture."""

import random

import public_tokenizers
from tests.llm.test_decontam import plain as plain_hits
from tests.llm.test_ngramjoin import plain as plain_classes
from tests.llm.test_pii import plain as plain_pii
from tests.llm.test_pii import plain_terms
from tests.llm.test_tokens import check_packing
from tokenizers import Tokenizer

import corpus_pipeline
from quarry.llm import pii

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def sanitised(text, terms):
    marks = sorted([(a, b, f"[{k.upper()}]") for k, v in plain_pii(text).items() for a, b in v] + [(a, b, "[TERM]") for a, b in terms])
    out, at = "", 0
    for a, b, by in marks:
        if a >= at:
            out += text[at:a] + by
        at = max(at, b)
    return out + text[at:]


def fixture(spark, folder):
    rng = random.Random(11)
    vocab = [f"{a}{b}{c}" for a in "bdgklm" for b in "aeiou" for c in "nrst"]
    docs = [" ".join(rng.choices(vocab, k=rng.randint(12, 200))) for _ in range(60)]
    items = [(k, " ".join(rng.choices(vocab, k=15))) for k in range(5)]
    docs += [docs[3], docs[4] + " end", docs[5].upper()]
    docs += [docs[8] + " " + items[2][1] + " tail", " ".join(rng.choices(vocab, k=9)) + " " + items[0][1]]
    docs += [f"{vocab[k]} {vocab[k + 9]} Zebulon mail zeb@example.com or call +1 (415) 555-2671 {k}" for k in range(6)]
    docs += [None, "", "123 456", "!"]
    rows = [(k, t, "en" if k % 2 else "fr", "s", 7) for k, t in enumerate(docs)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, items


def test_stages_equal_brute_force(spark, tmp_path):
    rows, items = fixture(spark, str(tmp_path))
    want = [r for r in rows if r[1] and any(map(str.isalpha, r[1]))]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)

    def step(name, k):
        nonlocal docs
        out = steps[name](spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        return sorted(map(tuple, docs.collect()))

    assert step("language_id", 0) == want
    comp = plain_classes([r[:2] for r in want])
    want = [r for r in want if comp[r[0]][1] == r[0]]
    assert step("ngram_join", 1) == want
    hits = plain_hits([r[:2] for r in want], items)
    want = [r for r in want if not hits[r[0]][1]]
    assert step("decontamination", 2) == want and len(want) < 70
    terms = plain_terms([r[:2] for r in want])
    clean = [(r[0], sanitised(r[1], terms[r[0]])) for r in want]
    want = [(k, t, *r[2:4], len(t)) for (k, t), r in zip(clean, want, strict=True)]
    assert step("pii", 3) == want
    assert sum("[EMAIL]" in r[1] for r in want) == 6
    last = steps["packing"](spark, docs, str(tmp_path))
    check_packing(docs, last.collect())
    assert sorted(last.collect()) == sorted(corpus_pipeline.run(spark, str(tmp_path)).collect())


def test_rows_without_an_id_and_repeated_ids(spark, tmp_path):
    words = {"en": ["the house is", "and there was", "which they have", "with this other"], "fr": ["la maison est", "et il y avait", "que nous avons", "avec cette autre"]}
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choices(words[lang], k=5)) + f" {k * k} {k}", lang, "s", 1) for k in range(80) for lang in ["en" if k % 2 else "fr"]]
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    odd = [(None, "the house is here and there was " + item, "en", "s", 1), (None, "which they have with this other", "en", "s", 1), (None, None, None, "s", 1)]
    odd += [(200, "with this other and there was one", "en", "s", 1), (200, "la maison est ici " + item, "fr", "s", 1), (200, None, None, "s", 1)]
    spark.createDataFrame(rows + odd, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    left = steps["language_id"](spark, docs, str(tmp_path))
    want = rows + [r for r in odd if r[1]]
    assert sorted(map(tuple, left.collect()), key=str) == sorted(want, key=str)
    clean = steps["decontamination"](spark, docs, str(tmp_path))
    want = [r for r in rows + odd if item not in (r[1] or "")]
    assert sorted(map(tuple, clean.collect()), key=str) == sorted(want, key=str)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_the_tokenizers_are_no_part_of_the_library():
    assert Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json"))).get_vocab_size() < 1 << 16
    assert pii.KINDS[-1] == "term"
