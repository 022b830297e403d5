import math
import random
import re
import time
from collections import Counter, defaultdict
from hashlib import sha256

import regex
from tests.llm.conftest import SF

from quarry.llm import pii, queries

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    return {"email": True, "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]


def plain(text):
    out = {}
    for kind, pattern in PLAIN.items():
        out[kind] = [m.span() for m in re.finditer(pattern, text or "") if valid(kind, m[0])]
    return out


def base_text(found):
    return ",".join(f"{k}:{a}:{b}" for k in PLAIN for a, b in found[k])


def test_base_spans_equal_the_contract(spark):
    rng = random.Random(4)
    bits = ["a.b", "@", "x-y", ".", "com", "_", "%", "1", "12", "255", "256", "007", " ", "-", "+", "(", ")", "4111 1111 1111 1111", "4111111111111111", "é", "😀", "\n", "+1 (415) 555-2671", "10.0.0.1", "a@b.co"]
    texts = ["".join(rng.choices(bits, k=rng.randint(1, 12))) for _ in range(3000)]
    texts += [None, "", "a" * 30000, "1" * 30000, "@a" + ".a" * 9000, "+" + "1(" * 9000, "9 " * 9000, "a@b.com_x@y.org"]
    df = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)] + [(None, "10.0.0.1", "x")], "doc_id bigint, text string, email string")
    got = {r.doc_id: r for r in pii.find(df).collect()}
    assert len(got) == len(texts) + 1
    for k, t in enumerate(texts):
        assert {n: [(s.start, s.end) for s in got[k][n]] for n in PLAIN} == plain(t), t
    assert pii.find(df.limit(0)).count() == 0


TERM = regex.compile(rf"(?<![\p{{L}}\p{{N}}{pii.BLANK}])[\p{{L}}\p{{N}}]{{2,}}+(?!{pii.BLANK})")


def blanked(text):
    for kind, pattern in PLAIN.items():
        for m in list(re.finditer(pattern, text)):
            if valid(kind, m[0]):
                text = text[: m.start()] + pii.BLANK * len(m[0]) + text[m.end() :]
    return text


def plain_terms(docs, reach=40, disclosure=0.75, share=0.8, support=3):
    both, texts, held, n_term = Counter(), defaultdict(set), Counter(), Counter()
    clean = {doc: blanked(text or "") for doc, text in docs}
    for doc, text in docs:
        text = text or ""
        n_term.update({w.lower() for w in TERM.findall(clean[doc])})
        near, entities = set(), set()
        for kind, spans in plain(text).items():
            for a, b in spans:
                entity = (kind, text[a:b].lower())
                entities.add(entity)
                lo, hi = max(0, a - reach), min(len(text), b + reach)
                for m in TERM.finditer(clean[doc]):
                    x, y = m.span()
                    if lo <= x and y <= hi and (lo < x or not lo) and (y < hi or hi == len(text)):
                        near.add((entity, m[0].lower()))
        for e, t in near:
            both[e, t] += 1
            texts[e, t].add(text)
        held.update(entities)

    def discloses(e, t):
        n, most = both[e, t], math.log2(len(docs) / held[e])
        return len(texts[e, t]) >= support and most > 0 and n >= share * n_term[t] and math.log2(n * len(docs) / (n_term[t] * held[e])) >= disclosure * most

    bad = {t for e, t in both if discloses(e, t)}
    return {doc: [m.span() for m in TERM.finditer(text) if m[0].lower() in bad] for doc, text in clean.items()}


def secretive():
    rng = random.Random(8)
    words = ["river", "stone", "cloud", "meadow", "of", "the", "winter", "garden", "writes", "from", "in", "any", "address", "far", "rests", "calls"]
    docs = [(k, " ".join(rng.choices(words, k=30))) for k in range(400)]
    for k in range(10):
        docs.append((400 + k, f"meadow {rng.choice(words)} Zebulon writes from zeb@example.com in the garden {k}"))
    docs += [(410, docs[400][1]), (411, None), (412, "far from any address, Zebulon rests"), (413, "zeb@example.com " + "of the river " * 9 + "zebulon"), (414, "")]
    for k in range(200):  # an entity of a third of all rows, and its short name
        docs.append((415 + k, f"{rng.choice(words)} {rng.choice(words)} Xi7 calls +1 415 555 2671, {k}"))
    return docs


def test_disclosing_terms_equal_brute_force_and_are_sanitised(spark):
    docs = secretive()
    df = spark.createDataFrame([(k, t, "en") for k, t in docs], "doc_id bigint, text string, lang string")
    found = pii.find(df)
    got = {r.doc_id: sorted((s.start, s.end) for s in r.term) for r in found.collect()}
    assert got == plain_terms(docs)
    assert any(got.values())
    clean = {r.doc_id: r.text for r in pii.sanitise(df, found).collect()}
    assert len(clean) == len(docs) and clean[0] == docs[0][1] and clean[411] is None and clean[414] == ""
    assert "[EMAIL]" in clean[400] and "[TERM]" in clean[400] and clean[412] == "far from any address, [TERM] rests"
    assert not any("zeb" in (t or "").lower() or "xi7" in (t or "").lower() for t in clean.values())


def test_small_tables_are_judged_too(spark):
    docs = [(k, f"Ada {k} a@b.co") for k in range(3)] + [(3, "of the"), (4, "of it")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert {r.doc_id: [s.value for s in r.term] for r in pii.find(df).collect()} == {0: ["ada"], 1: ["ada"], 2: ["ada"], 3: [], 4: []}


def test_long_texts_take_time_in_proportion(spark):
    ips = [f"{k % 256}.{k // 256 % 256}.1.2" for k in range(100_000)]
    long = " at ".join(ips)
    texts = [long, "x" * 1_000_000, "1" * 1_000_000, "a@" + "b." * 300_000 + "c", "é +1 415 555 2671 😀 " * 20_000, "@" * 500_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    began = time.monotonic()
    found = pii.find(df)
    got = {r.doc_id: r for r in found.collect()}
    clean = {r.doc_id: r.text for r in pii.sanitise(df, found).collect()}
    assert time.monotonic() - began < 90
    assert [s.value for s in got[0].ip] == ips and long[got[0].ip[-1].start :] == ips[-1]
    assert clean[0] == " at ".join(["[IP]"] * len(ips)) and clean[1] == texts[1]
    assert len(got[4].phone) == 20_000 and clean[4] == texts[4].replace("+1 415 555 2671", "[PHONE]")


def test_query_equals_brute_force(spark):
    got = {r.doc_id: r for r in queries.op9_pii(spark, SF).collect()}
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    terms = plain_terms(docs)
    for k, t in docs:
        found = plain(t)
        text = base_text(found)
        assert got[k].base_sha256 == sha256(text.encode()).hexdigest()
        more = ",".join(f"term:{a}:{b}" for a, b in terms[k])
        assert got[k].spans == ",".join(x for x in (text, more) if x)
        assert (got[k].n_email, got[k].n_ip, got[k].n_card, got[k].n_phone) == tuple(len(found[x]) for x in PLAIN)
