"""Folding and pinned terms: columns and kernel say the same."""

import random
import unicodedata

from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators import diff, terms

WORDS = {
    "czech": "Příliš žluťoučký kůň úpěl ďábelské ódy řeřicha Čeština",
    "polish": "Zażółć gęślą jaźń źdźbło łódź Święto",
    "turkish": "İstanbul ığdır şişe çağ ÖĞRETMEN güneş",
    "hungarian": "Árvíztűrő tükörfúrógép őrült Űr",
    "greek": "Καλημέρα ΆΝΘΡΩΠΟΣ ώρα ύψος Ϊ",
    "russian": "Ёжик Йод съешь чаю ПОДЪЁМ",
    "french": "Noël œuvre Garçon ça FAÇADE naïve",
    "vietnamese": "Tiếng Việt ĐƯỜNG phố ước muốn",
}


def mixed(n=500, seed=3):
    rng = random.Random(seed)
    words = " ".join(WORDS.values()).split()
    return [unicodedata.normalize(rng.choice(("NFC", "NFD")), "".join(rng.choice((w, w.upper(), w.title())) for w in rng.sample(words, rng.randrange(1, 3)))) for _ in range(n)]


def test_one_fold(spark):
    words = mixed()
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", text.fold(F.col("w")).alias("f"), text.term_stem(F.col("w")).alias("s")).collect()
    for r in rows:
        assert r["f"] == text.folded(r["w"]) == "".join(c for c in unicodedata.normalize("NFD", r["w"].lower()) if not unicodedata.combining(c)), r["w"]
        assert r["s"] == diff.stem(r["w"])


def test_terms_in_any_script(spark):
    docs = spark.createDataFrame([(f"{w} {unicodedata.normalize('NFD', w)} short",) for w in ("человек", "ἄνθρωπος", "Bruckner") for _ in range(3)], "text string")
    assert {r["word"]: r["n"] for r in terms.frequencies(docs).collect()} == {"человек": 6, "ανθρωπος": 6, "bruckner": 6}


def test_pinned_terms_equal_the_kernel(spark):
    rng = random.Random(8)
    glossary = {"f(x": "g(x", "c++": "C plus", "új": "novo", "Noël": "natale", "łódź": "barca", "new york": "nuova york", "'tis": "è", "a.b": "a.b c", "\\E": "fine", "člověk": "uomo"}
    exceptions = {"Noël": ["père Noël"], "új": [""], "new york": ["New York Times"]}
    parts = [*glossary, *glossary.values(), "père noël", "new york times", "clovekem", "ujabb", "x", "if (x", "c+", "o", " ", " ", "-", "é"]
    pairs = [(i, " ".join(rng.choice(parts) for _ in range(rng.randrange(6))), "".join(rng.choice(parts) for _ in range(rng.randrange(8)))) for i in range(400)]
    table = spark.createDataFrame([(s, d, exceptions.get(s, [])) for s, d in glossary.items()], "src string, dst string, phrases array<string>")
    docs = spark.createDataFrame(pairs, "doc_id long, o string, t string")
    got = sorted(map(tuple, terms.broken(docs, table).collect()))
    want = sorted((i, s, d) for i, o, t in pairs for s, d in diff.broken_terms(o, t, glossary, exceptions))
    assert want and got == want
    plain = sorted((i, s, d) for i, o, t in pairs for s, d in diff.broken_terms(o, t, glossary))
    assert sorted(map(tuple, terms.broken(docs, table.drop("phrases")).collect())) == plain
    assert terms.broken(docs, table.limit(0)).count() == 0
    assert "Nested" not in terms.broken(docs, table)._jdf.queryExecution().toString()


def test_the_glossarys_facade(spark):
    docs = spark.createDataFrame([("a", "esoterism " * 5 + "exoterism " * 6), ("b", "esoterism " * 90)], "rel string, text string")
    done = spark.createDataFrame([("a",)], "rel string")
    assert [tuple(r) for r in terms.suggested(docs, done).collect()] == [("esoterism", "exoterism", 5, 6)]
    g = spark.createDataFrame([("a", "x"), ("b", "y")], "src string, dst string")
    more = spark.createDataFrame([("b", "z"), ("c", "w"), ("d", "")], "src string, dst string")
    assert {tuple(r) for r in terms.extended(g, more).collect()} == {("a", "x"), ("b", "z"), ("c", "w")}
    found = spark.createDataFrame([(1, "a", "x"), (2, "a", "x")], "doc_id long, src string, dst string")
    assert {tuple(r) for r in terms.shown(g, found).collect()} == {("a", "x", 2), ("b", "y", 0)}
