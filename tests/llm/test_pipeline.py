"""The pipeline stage by stage, each against a plain version of its decision."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quillspark.llm import decontam, pii, queries, simhash
from quillspark.llm.common import written

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = written(stage(spark, docs, DIR), name)
        seen[name] = (before, {r["doc_id"]: r for r in docs.collect()})
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        assert set(seen[name][1]) <= set(before)

    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    before, after = seen["quality_classifier"]
    right = [(d in after) == bool(q) for d, q in truth.items()]
    assert sum(right) / len(right) > 0.9

    before, after = seen["near_duplicates"]
    sets = {d: set(simhash.shingle_hashes(r["text"]).tolist()) for d, r in before.items()}
    near = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    kept = sorted(after)
    assert not any(near(a, b) for i, a in enumerate(kept) for b in kept[:i])
    assert all(any(near(d, k) for k in before if k != d) for d in set(before) - set(after))

    before, after = seen["decontamination"]
    items = [decontam.words_of(r["text"]) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    holds = lambda t: any(b" ".join(i) in b" ".join(decontam.words_of(t)) for i in items)
    assert {d for d, r in before.items() if holds(r["text"])} == set(before) - set(after)

    before, after = seen["personal_data"]
    assert all(not pii.base_spans(r["text"]) and r["n_chars"] == len(r["text"]) for r in after.values())
    assert all(after[d]["text"] == r["text"] for d, r in before.items() if not pii.TRIGGER.search(r["text"]))
    assert set(seen["encoding"][1]) == set(after)
    library = Tokenizer.from_file(public_tokenizers.path(queries.VOCABULARY))
    for d, r in seen["encoding"][1].items():
        ids = library.encode(after[d]["text"] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_empty_and_odd_tables(spark):
    first = 10**9  # no labels there: nothing is rejected
    docs = spark.createDataFrame([(None, None, None, None, None), (first + 1, "", "en", "s", 0), (first + 1, "", "en", "s", 0), (first + 2, "word " * 50, None, "s", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    for rows, left in ((docs, {first + 1, first + 2}), (docs.limit(0), set())):
        out = rows
        for _, stage in corpus_pipeline.STAGES:
            out = written(stage(spark, out, DIR), "odd")
        assert sorted(r["doc_id"] for r in out.collect()) == sorted(left)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("pages", "embeddings", "conversations", "documents"):
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DIR)
    names = sorted(df.columns)
    found = con.execute(queries.ORACLE_SQL[name])
    cols = [c[0] for c in found.description]
    theirs = sorted(str(tuple(r[cols.index(c)] for c in names)) for r in found.fetchall())
    assert sorted(cols) == names
    assert sorted(str(tuple(r[c] for c in names)) for r in df.collect()) == theirs


def test_every_query_is_registered():
    import __spark_entry__

    found = __spark_entry__.queries()
    assert all(any(q.startswith(f"op{n}_") for q in found) for n in range(1, 11)) and "pipeline" in found


def plain_fingerprint(text):
    """The contract's fingerprint, word by word and bit by bit."""
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_query(spark):
    rows = queries.op2_simhash(spark, DIR).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    assert all(r["fingerprint"] == f"{plain_fingerprint(docs[r['doc_id']]):016x}" for r in rows)
    ids, fps = [r["doc_id"] for r in rows], [int(r["fingerprint"], 16) for r in rows]
    parent = {d: d for d in ids}

    def top(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = sorted((top(ids[i]), top(ids[j])))
                parent[b] = a
    assert {r["doc_id"]: r["component_id"] for r in rows} == {d: top(d) for d in ids}


def test_quality_query(spark):
    """Scores by the densities themselves, without Cholesky factors."""
    from quillspark.llm import quality

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    rows = queries.op5_quality(spark, DIR).collect()
    held = {d: zlib.crc32(str(d).encode()) % 5 == 0 for d in texts}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DIR}/labels.parquet").collect() if r["doc_id"] in texts and not held[r["doc_id"]]}
    x = {d: np.array(quality.statistics(t or "")) for d, t in texts.items()}
    known = np.array([x[d] for d in labels])
    center, scale = known.mean(0), np.sqrt(np.maximum(known.var(0), 1e-6))
    z = {d: (v - center) / scale for d, v in x.items()}
    parts = [np.array([z[d] for d, y in labels.items() if y == k]) for k in (0, 1)]
    covs = [np.cov(p.T, bias=True) for p in parts]
    pooled = sum(len(p) * c for p, c in zip(parts, covs)) / len(labels)
    mixed = [0.7 * c + 0.3 * pooled + 0.05 * np.eye(len(center)) for c in covs]

    def log_density(v, k):
        off = v - parts[k].mean(0)
        return np.log((len(parts[k]) + 1) / (len(labels) + 2)) - 0.5 * np.linalg.slogdet(mixed[k])[1] - 0.5 * off @ np.linalg.solve(mixed[k], off)

    assert len(rows) == len(texts)
    for r in rows:
        v = z[r["doc_id"]]
        assert r["score"] == pytest.approx(1 / (1 + np.exp(np.clip(log_density(v, 0) - log_density(v, 1), -60, 60))), abs=1e-6)
        assert r["held_out"] == held[r["doc_id"]] and r["predicted"] == int(r["score"] >= 0.3)


def test_personal_data_query(spark):
    import hashlib

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    for r in queries.op3_pii(spark, DIR).collect():
        base = pii.base_spans(docs[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(pii.spans_text(base).encode()).hexdigest()
        assert {k: sum(s[0] == k for s in base) for k in pii.KINDS} == {k: r[f"n_{k}"] for k in pii.KINDS}
        assert set(pii.spans_text(base).split(",")) <= set(r["spans"].split(",")) | {""}


def test_secrets_query(spark):
    import hashlib

    from quillspark.llm import secrets

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    for r in queries.op9_secrets(spark, DIR).collect():
        base = [c[:3] for c in secrets.candidates(docs[r["doc_id"]]) if c[0] in secrets.BASE]
        assert r["base_sha256"] == hashlib.sha256(secrets.spans_text(base).encode()).hexdigest()
        assert {k: sum(s[0] == k for s in base) for k in secrets.BASE} == {k: r[f"n_{k}"] for k in secrets.BASE}


def test_decontamination_query(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()
    items = {r["item_id"]: b" ".join(decontam.words_of(r["text"])) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()}
    want = {(d["doc_id"], i) for d in docs for i, t in items.items() if t in b" ".join(decontam.words_of(d["text"]))}
    assert {(r["doc_id"], r["item_id"]) for r in queries.op8_decontamination(spark, DIR).select(F.col("doc_id"), "item_id").collect()} == want
