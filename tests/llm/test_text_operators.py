"""BPE, personal data, secrets: exact against plain versions."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from quillspark.llm import bpe, pii, queries, secrets

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "  a  b", "<|endoftext|> x<|endoftext|><|endoftext|>", "a" * 3000, "日本語" * 50, "\U0001f600 ‍ x\x00y", "1234567 '''s 're I'll", "\n\n\n \t x", "é\u0301ß"]


def random_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x20, 0x3000), rng.randrange(97, 110)])) for _ in range(rng.randrange(80))) for _ in range(n)]


def test_bpe_equals_the_library():
    ours, theirs = bpe.Codec(PATH), Tokenizer.from_file(PATH)
    for text in ODD + random_texts(300):
        ids = theirs.encode(text, add_special_tokens=False).ids
        assert ours.encode(text) == ids
        assert ours.decode(ids) == theirs.decode(ids, skip_special_tokens=False) == text


def test_segment_tree_equals_scanning():
    c = bpe.Codec(PATH)
    rng = random.Random(2)
    for _ in range(200):
        ids = [c.first[rng.choice(b"abetho nist")] for _ in range(rng.randrange(1, 40))]
        slow = list(ids)
        while True:
            ranks = [(c.merge[p][0], i) for i, p in enumerate(zip(slow, slow[1:])) if p in c.merge]
            if not ranks:
                break
            _, i = min(ranks)
            slow[i : i + 2] = [c.merge[slow[i], slow[i + 1]][1]]
        assert c.merged(ids) == slow


LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.no_truncation()
LIBRARY.no_padding()


def digests(text):
    """What the library says of a text: number of ids, and digests of them and of their decoding."""
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    told = LIBRARY.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(told.encode()).hexdigest()


def test_bpe_query(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = queries.op10_bpe(spark, "/root/testdata/sf0.001").collect()
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows} == {d: digests(t) for d, t in docs.items()}


def test_ids_that_are_no_text():
    ours = bpe.Codec(PATH)
    for ids in ([], [ours.first[0xC3]], [ours.first[0xE2], ours.first[0x82], ours.first[65]], [ours.first[0xFF]] * 3):
        assert ours.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_bpe_tables(spark):
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(ODD)] + [(None, None, 0), (3, ODD[3], 1)], "doc_id long, text string, ids long")
    enc = bpe.encode(docs, PATH)
    assert enc.count() == len(ODD) + 2
    back = bpe.decode(enc, PATH)
    assert sorted(r["text"] for r in back.collect()) == sorted([*ODD, "", ODD[3]])
    rows = bpe.round_trip(docs, PATH).collect()
    want = sorted(str(digests(t)) for t in [*ODD, "", ODD[3]])
    assert sorted(str((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"])) for r in rows) == want
    assert bpe.round_trip(docs.limit(0), PATH).count() == 0


def plain_base(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(v) <= 255 for v in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    made = ["".join(rng.choice("a1.2@+-( )_%9é0") for _ in range(rng.randrange(60))) for _ in range(4000)]
    made += ["".join(rng.choice("1.2345 -+") for _ in range(rng.randrange(80))) for _ in range(4000)]
    made += ["4111 1111 1111 1111", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "300.1.1.1.1", "+49 (0) 123 456789", "x" * 5000 + "@"]
    for t in made:
        assert pii.base_spans(t) == plain_base(t)


def test_tagger_learns_and_adds():
    tagger = pii.trained()
    x, y = pii.labelled(200, np.random.default_rng(99))
    found = tagger.viterbi(tagger.emissions(x))
    assert (found == y).mean() > 0.95
    text = "Call (243) 555-5526 or +1 (826) 555-4081 4111111111111112 now. " + "word " * 40 + "mail to jane.3@mail.example.com"
    (base, spans), = pii.all_spans(tagger, [text])
    assert set(base) <= set(spans) and len(spans) > len(base)
    assert pii.all_spans(tagger, ["no digits at all", ""]) == [([], []), ([], [])]


def test_training_learns():
    tagger = pii.train(windows=800, epochs=4)
    x, y = pii.labelled(100, np.random.default_rng(98))
    assert (tagger.viterbi(tagger.emissions(x)) == y).mean() > 0.85


def test_windows_that_are_not_decoded_hold_nothing():
    rows = pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist()
    made = [f"{'name of ' * 12}anna.{k}@mail.example.com and +49 {k}55 1234567, {'word ' * (k % 40)}call (243) 555-{5000 + k} " * 2 for k in range(60)]
    texts = sorted((t or "" for t in rows), key=len)[:940] + made
    tagger = pii.trained()
    assert pii.model_spans(tagger, texts) == pii.model_spans(tagger, texts, every=True)


def test_gradients_of_the_tagger():
    t = pii.Tagger(3, 4)
    t.p = {k: v.astype(np.float64) for k, v in t.p.items()}
    x, y = pii.labelled(3, np.random.default_rng(5))
    x, y = x[:, :12], np.where(y[:, :12] % 2 == 0, y[:, :12], y[:, :12])
    y[:, 0] = np.where((y[:, 0] > 0) & (y[:, 0] % 2 == 0), y[:, 0] - 1, y[:, 0])
    _, grad = t.step(x, y)
    rng = np.random.default_rng(1)
    for name in ("hf", "hb", "out", "bias"):
        i = tuple(rng.integers(s) for s in t.p[name].shape)
        before = t.p[name][i]
        t.p[name][i] = before + 1e-2
        up = t.step(x, y)[0]
        t.p[name][i] = before - 1e-2
        down = t.step(x, y)[0]
        t.p[name][i] = before
        assert abs((up - down) / 2e-2 - grad[name][i]) < 2e-2


def test_reconciled_spans():
    pieces = [(0, 10, 48, 5.0, False, True), (0, 48, 60, 3.0, True, False), (1, 12, 20, 1.0, False, False), (2, 70, 80, 2.0, False, False)]
    assert pii.reconciled(pieces) == [(0, 10, 60), (2, 70, 80)]
    assert pii.reconciled([]) == []


def test_redaction(spark):
    rows = [(1, "mail a@b.de now", 15, "z"), (2, None, None, "z"), (None, "nothing", 7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, doc_id_row string")
    out = pii.redact(docs)
    assert out.columns == docs.columns
    assert {r["text"]: r["n_chars"] for r in out.collect()} == {"mail [EMAIL] now": 16, None: None, "nothing": 7}
    assert pii.find(docs).count() == 3
    assert pii.find(docs.limit(0)).count() == 0


def plain_secrets(t):
    word = "|".join(re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    out = [("assign", m.start(), m.end()) for m in re.finditer(rf"""({word})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return out + [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]


def test_secret_candidates_equal_the_patterns():
    rng = random.Random(6)
    parts = ["token", "API_KEY", "apikey", "PassWord", ":", "=", '"', " ", "AKIA", "A1B2C3D4E5F6G7H8", "0123456789abcdef", "x", "\u212a", "ſecret", "abcdef", "é"]
    for _ in range(5000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert [c[:3] for c in secrets.candidates(t) if c[0] in secrets.BASE] == plain_secrets(t)


def test_secret_ownership(spark):
    shared, own = "token = aaaaaa0123456789", "ghp_Ab3dEf6hIj9kLm2nOp5q"
    rows = [(i, f"{shared} text", f"r{i}", f"o{i}") for i in range(3)] + [(7, f"x {own} y", "r", "o"), (8, f"x {own} y", "r2", "o"), (9, None, None, None), (9, "", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, repo string, owner string")
    found = {}
    for r in secrets.find(docs).collect():
        found.setdefault(r["doc_id"], []).append([(s["kind"], s["live"], s["owners"], s["repos"]) for s in r["spans"]])
    assert found[0] == [[("assign", False, 3, 3)]]
    assert found[7] == found[8] == [[("entropy", True, 1, 2)]]
    assert found[9] == [[], []]
    assert secrets.find(docs.limit(0)).count() == 0


def test_tokens_in_many_repositories_of_one_owner_go(spark):
    rows = [(i, "x Ab3dEf6hIj9kLm2nOp5q7 y " + "word " * 300_000 * (i == 0), f"r{i}", "o", 1, 2) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, repo string, owner string, row long, hash long")
    assert all(len(r["spans"]) == 1 for r in secrets.find(docs).collect())
    assert all(not r["spans"] for r in secrets.find(docs, max_repos=3).collect())


@pytest.mark.parametrize("copies", [1, 2])
def test_entropy_tokens_of_many_owners_go(spark, copies):
    rows = [(i, "x Ab3dEf6hIj9kLm2nOp5q7 y", "r", f"o{i % copies}") for i in range(4)]
    found = secrets.find(spark.createDataFrame(rows, "doc_id long, text string, repo string, owner string"))
    assert all(len(r["spans"]) == (copies == 1) for r in found.collect())
