"""Operators over the whole corpus, against brute force on small tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import chat, components, decontam, mips, pii, quality, queries, simhash, toxicity, url_filter

DIR = "/root/testdata/sf0.01"


def roots(n, links):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("shape", ["path", "star", "random", "none"])
def test_components(spark, shape):
    rng = random.Random(1)
    links = {"path": [(i, i + 1) for i in range(200)], "star": [(7, i) for i in range(150)], "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(170)], "none": []}[shape]
    df = spark.createDataFrame([*links, (None, 3)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(df).collect()}
    want = roots(300, links)
    assert set(got) == {x for p in links for x in p}
    groups = {}
    for node, root in got.items():
        groups.setdefault(root, set()).add(want[node])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len({want[n] for n in got})


def near_texts(n=60, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(rng.randrange(3, 80))] for _ in range(n)]
    out = [" ".join(b) for b in base]
    for b in base[: n // 2]:
        c = list(b)
        for _ in range(rng.randrange(1, 4)):
            c[rng.randrange(len(c))] = "zz"
        out += [" ".join(c), " ".join(b)]
    return [*out, "", "", "one", "A b\tC", "a B c"]


@pytest.mark.parametrize("bucket", [64, 0])
def test_simhash_components(spark, bucket):
    texts = near_texts()
    fps = [simhash.fingerprint(t) for t in texts]
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    want = roots(len(fps), links)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, fp string")
    got = {r["doc_id"]: (r["fp"], r["component_id"]) for r in simhash.near_duplicates(docs, bucket=bucket).collect()}
    assert [got[i] for i in range(len(texts))] == [(simhash.signed(f), w) for f, w in zip(fps, want)]
    assert simhash.one_of_each(docs, least=None).count() == len(set(want))


def test_every_close_fingerprint_is_linked(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(20)]
    prints = {b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(40)} | set(base)
    df = spark.createDataFrame([(simhash.signed(p),) for p in prints], "fp long")
    for bucket in (1000, 0):
        got = {tuple(sorted(r)) for r in simhash.links(df, bucket=bucket).collect()}
        true = {tuple(sorted((simhash.signed(a), simhash.signed(b)))) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 2}
        assert got == true if bucket else got <= true


def test_fingerprint_bits():
    assert simhash.fingerprint("") == simhash.fingerprint(None) == simhash.fingerprint(" \t") == 0
    import xxhash

    assert simhash.fingerprint("A b") == xxhash.xxh64_intdigest(b"a b", 42)


def test_similar_texts(spark):
    rng = random.Random(8)
    base = [[f"u{rng.randrange(9999)}" for _ in range(n)] for n in (30, 80, 200, 600, 50, 90)]
    texts = [" ".join(b) for b in base]
    for b in base:
        for changes in (1, len(b) // 60 + 1, len(b) // 8):
            c = list(b)
            for k in range(changes):
                c[(k * 37 + 5) % len(c)] = f"new{rng.random()}"
            texts.append(" ".join(c))
    texts += [texts[0], "", ""]
    sets = [set(simhash.shingle_hashes(t).tolist()) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, row int")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(docs).collect()}
    assert [got[i] for i in range(len(texts))] == roots(len(texts), links)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(roots(len(texts), links)))


def test_different_short_texts_stay(spark):
    docs = spark.createDataFrame([(i, f"only a few words {i}") for i in range(500)] + [(i + 500, f"only a few words {i}") for i in range(9)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(docs).collect()}
    assert got == {i: i % 500 for i in range(509)}
    assert simhash.one_of_each(docs).count() == 500


def test_similar_texts_of_one_template(spark):
    rng = random.Random(21)
    template = [f"t{rng.randrange(9999)}" for _ in range(300)]

    def changed(words, slots):
        out = list(words)
        for k in slots:
            out[6 * k + 2] = f"new{rng.random()}"
        return out

    texts, twins = [], []
    for i in range(2000):
        slots = rng.sample(range(50), 11)
        texts.append(changed(template, slots[:6]))  # two of these are 0.67 alike
        if i % 20 == 0:
            twins.append((i, 2000 + len(twins)))
            twins[-1] += (changed(texts[-1], slots[6:]),)  # 0.84
    docs = [" ".join(t) for t in texts] + [" ".join(t) for _, _, t in twins]
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()}
    found = sum(got[i] == got[j] for i, j, _ in twins)
    sets = [set(simhash.shingle_hashes(t).tolist()) for t in docs]
    assert found >= 97, found
    alike = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    assert all(alike(i, j) for i, j, _ in twins)
    groups = {}
    for i, root in got.items():
        groups.setdefault(root, []).append(i)
    assert all(any(alike(i, j) for j in g if j != i) for g in groups.values() if len(g) > 1 for i in g)


def clusters(groups, copies, replaced, seed=5, words=300):
    """``groups`` texts, each with ``copies`` in which a block of words is replaced."""
    rng = random.Random(seed)
    out = []
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(10**6)}" for _ in range(words)]
        out.append(" ".join(base))
        for _ in range(copies):
            at = rng.randrange(words - replaced + 1)
            out.append(" ".join([*base[:at], *(f"n{rng.random()}" for _ in range(replaced)), *base[at + replaced :]]))
    return out


def similar_pairs(texts, least=0.8):
    """All pairs by brute force, through the shingles that texts share."""
    sets = [simhash.shingle_hashes(t) for t in texts]
    holders = {}
    for i, s in enumerate(sets):
        for h in s.tolist():
            holders.setdefault(h, []).append(i)
    shared = {}
    for i, s in enumerate(sets):
        met = np.concatenate([np.array(holders[h]) for h in s.tolist()] or [np.zeros(0, int)])
        other, n = np.unique(met[met < i], return_counts=True)
        both = n / (len(s) + np.array([len(sets[j]) for j in other]) - n)
        shared |= {(int(j), i): float(b) for j, b in zip(other, both) if b >= least}
    return shared


@pytest.mark.parametrize("groups,copies,replaced", [(6, 100, 26), (2, 400, 28)])
def test_no_links_are_lost_in_clusters(spark, groups, copies, replaced):
    texts = clusters(groups, copies, replaced)
    pairs = similar_pairs(texts)
    want = roots(len(texts), pairs)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    split = sum(got[a] != got[b] for a, b in pairs)
    wrong = sum(want[a] != want[b] for a, b in got.items())
    assert wrong == 0 and split <= 0.01 * len(pairs), (split, len(pairs), len(set(got.values())), len(set(want)))


def test_near_copies_move_few_rows(spark, monkeypatch):
    """Members handed on for a second meeting don't multiply with the keys of a large group."""
    texts = clusters(1, 400, 34)  # alike, but few of them similar enough
    rows, plain = {}, simhash.written

    def counted(df, label):
        out = plain(df, label)
        rows[label] = rows.get(label, 0) + out.count()
        return out

    monkeypatch.setattr(simhash, "written", counted)
    simhash.similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert rows["wide-members"] <= 2 * len(texts), rows


def bridges(groups, members, replaced, seed=9, words=300):
    """Pairs of families of near copies, of which only the two first texts are similar across."""
    rng = random.Random(seed)
    texts = []
    for g in range(groups):
        left = [f"g{g}w{rng.randrange(10**6)}" for _ in range(words)]
        for core in (left, [*(f"n{rng.random()}" for _ in range(replaced)), *left[replaced:]]):
            texts.append(" ".join(core))
            for at in rng.sample(range(replaced + 10, words - 10), members):
                texts.append(" ".join([*core[:at], f"n{rng.random()}", *core[at + 1 :]]))
    return texts


def test_one_link_among_many_that_look_alike(spark):
    texts = bridges(20, 40, 32)
    want = roots(len(texts), similar_pairs(texts))
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_near_duplicates_of_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (None, None), (5, "a b c d"), (5, "a b c d"), (2, None)], "doc_id long, text string")
    rows = simhash.near_duplicates(docs).collect()
    assert sorted((r["doc_id"] is None, r["component_id"]) for r in rows) == [(False, 2), (False, 5), (False, 5), (True, 2), (True, 5)]
    assert sorted((r["doc_id"], r["text"]) for r in simhash.one_of_each(docs).collect() if r["doc_id"]) == [(2, None), (5, "a b c d")]
    assert simhash.one_of_each(docs).count() == 2
    for least in (None, 0.8):
        assert simhash.one_of_each(docs.limit(0), least=least).count() == 0
    assert simhash.one_of_each(docs.where("doc_id is null")).count() == 2


def test_url_rules_and_list(spark):
    rules = [url_filter.Rule("allow", "org"), url_filter.Rule("block", "example.org", "/es/"), url_filter.Rule("block", "example.org", "/en/1")]
    urls = ["http://A.Example.org/es/x", "https://example.org/en/12?q", "http://notexample.org/es/", "http://x.org", "http://bad.com/a/?x#y", "http://bad.com/a", "http://fine.com/b", None, "no scheme", "a://b://c/d", "http://bad.com/a/"]
    pages = spark.createDataFrame([(i, u, True) for i, u in enumerate(urls)], "page_id long, url string, listed boolean")
    listed = spark.createDataFrame([("bad.com/a",), (None,), ("bad.com/a",)], "url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, listed, rules).collect()}
    assert got[0] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got[1] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[2] == ("notexample.org", "/es/", "org/", "allow")
    assert got[3] == ("x.org", "", None, "allow")
    assert [got[i][3] for i in (4, 5, 6, 10)] == ["block", "block", "allow", "block"]
    assert got[7] == got[8] == ("", "", None, "allow")
    assert got[9] == ("b:", "//c/d", None, "allow")
    assert url_filter.judge(pages.limit(0), listed, rules).count() == 0
    twice = url_filter.judge(pages.union(pages.where("page_id = 4")), listed, rules)
    assert twice.count() == len(urls) + 1 and twice.where("page_id = 4 and verdict = 'block'").count() == 2
    assert url_filter.judge(pages, listed.limit(0)).where("verdict = 'block'").count() == 0


def test_bloom_has_no_misses_and_few_false_hits(spark):
    listed = spark.range(3000).select(F.concat(F.lit("in"), "id").alias("url"))
    pages = spark.range(6000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://"), F.when(F.col("id") < 3000, "in").otherwise("out"), "id").alias("url"))
    got = url_filter.judge(pages, listed).groupBy("maybe_listed", "listed").count().collect()
    counts = {(r["maybe_listed"], r["listed"]): r["count"] for r in got}
    assert counts[True, True] == 3000 and counts.get((True, False), 0) < 60


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = [v.tolist() for v in rng.normal(size=(300, 12))] + [[0.5] * 12] * 30
    x += [None, [None] * 12, [float("nan")] + [0.0] * 11, [float("inf")] * 12, [1.0] * 5, []]
    rows = [(i, v, 0) for i, v in enumerate(x)] + [(None, x[0], 1), (50, x[50], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, row int")
    vs = [(i, mips.integers(v)) for i, v, _ in rows]
    vs = [(i, np.pad(v, (0, 12 - len(v)))) for i, v in vs if v is not None]
    want = []
    for a, (i, q) in enumerate(vs):
        if i is not None and i % 10 == 0:
            others = sorted((-int(q @ v), j is None, j or 0) for b, (j, v) in enumerate(vs) if b != a)[:5]
            want += [(i, rank, None if none else j, -s) for rank, (s, none, j) in enumerate(others, 1)]
    for block in (4096, 7):
        got = [tuple(r) for r in mips.top_k(df, F.col("vec_id") % 10 == 0, block=block).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert mips.top_k(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert mips.top_k(df.where("vec_id < 3"), F.col("vec_id") == 0).count() == 2


ODD = ["", "plain", "<|user|>\nx</s>\n", "</s>[INST] ok [/INST]", "\\ \\\\. <\\.| [\\INST]", "a|>b<|>", "é\n\n", "<s><s>"]


def test_escapes(spark):
    df = spark.createDataFrame([(t,) for t in ODD], "t string").select("t", chat.escaped(F.col("t")).alias("e"))
    for r in df.collect():
        assert chat.unescaped(r["e"]) == r["t"]
        assert not any(c in r["e"] for c in ("<|", "|>", "</s>", "<s>", "[INST]", "[/INST]"))


def test_prefix_tree(spark):
    rng = random.Random(4)
    rows = []
    for c in range(80):
        for t in range(rng.randrange(1, 6)):
            rows.append((c, t, ("user", "assistant", None)[(t + (c % 9 == 0)) % 3 if c % 5 == 0 else t % 2], ODD[rng.randrange(3) if t < 2 else rng.randrange(len(ODD))], 0))
    rows += [(None, 1, "user", "x", 0), (None, None, "assistant", None, 0), (None, 1, "user", "x", 0), (3, 0, "user", "again", 0)]
    rows += [(90, 0, "user", "long " * 200_000, 0), (90, 1, "assistant", "x", 0), (91, 0, "user", "long " * 200_000, 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, node int")
    layout, pieces, convs = chat.tree(df)
    n = {r["node"]: r for r in layout.collect()}
    assert {r["node"]: len(r["piece"]) for r in pieces.collect()} == {k: r["end"] - r["start"] for k, r in n.items()}
    spans = sorted((r["start"], r["end"]) for r in n.values())
    assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    stack = []
    for r in sorted(n.values(), key=lambda r: r["start"]):
        del stack[r["depth"] :]
        assert (stack[-1] if stack else None) == r["parent"]
        stack.append(r["node"])
    for c in convs.collect():
        seen, at = [], 0
        for key in c["chain"]:
            r = n[key]
            assert r["position"] == at
            covered = [i for s in r["ancestors"] for i in range(s["start"], s["end"])]
            assert covered == sorted(i for a, b in seen for i in range(a, b))
            seen.append((r["start"], r["end"]))
            at += r["end"] - r["start"]
    told = {}
    for c, t, role, text, _ in rows:
        told.setdefault(c if c is not None else (None, len(told)), []).append((t is not None, t or 0, role or "", text or ""))
    want = sorted(str((c if isinstance(c, int) else None, [(a, b) for _, _, a, b in sorted(ts)])) for c, ts in told.items())
    back = chat.told(convs, chat.read_back(layout, pieces, convs)).collect()
    assert sorted(str((r["conv_id"], [(t["role"], t["text"]) for t in r["turns"]])) for r in back) == want
    for r in back:
        assert r["loss"] == "".join(t["text"] for t in r["turns"] if t["role"] == "assistant")
    assert len(n) < len(rows)
    assert [d.count() for d in chat.tree(df.limit(0))] == [0, 0, 0]


def held_out(rows, truth, threshold):
    pairs = [(r["score"] >= threshold, truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    return np.mean([a == bool(b) for a, b in pairs]), pairs


def test_quality_held_out(spark):
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    rows = queries.op5_quality(spark, DIR).collect()
    accuracy, _ = held_out(rows, truth, 0.3)
    assert accuracy > 0.93 and len(rows) == 1000 and all(0 <= r["score"] <= 1 for r in rows)


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a fine text. " * 9, 0.5), (2, None, None), (None, "", 0.1), (1, "###", 0.2)], "doc_id long, text string, x double")
    feats = quality.features(docs)
    none = spark.createDataFrame([], "doc_id long, quality int")
    for labels in (none, spark.createDataFrame([(1, 1), (None, 0), (2, None), (2, 7)], "doc_id long, quality int")):
        model = quality.fit(quality.labelled(feats, labels, "quality"))
        assert quality.score(feats, model).where("score between 0 and 1").count() == 4
        assert quality.keep(docs, model, 0.0).columns == docs.columns
    assert quality.keep(docs, quality.fit(quality.labelled(feats, none, "quality")), 0.3).count() == 4
    assert quality.score(feats.limit(0), model).count() == 0


def test_training_runs_one_python_map_a_task(spark, monkeypatch):
    """A second one in the same task would take a second worker, which stays and fills its caches too."""
    docs, labels = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "labels"))
    plans, moments = [], quality.moments
    monkeypatch.setattr(quality, "moments", lambda rows: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or moments(rows))
    model = quality.train(docs, labels, "quality")
    assert len(plans) == 1 and "MapInArrow" not in plans[0]
    whole = quality.fit(quality.labelled(quality.features(docs), labels, "quality"))
    assert np.allclose(model.means, whole.means) and np.allclose(model.factors, whole.factors) and np.allclose(model.offsets, whole.offsets)


def test_discriminant_equals_densities():
    rng = np.random.default_rng(0)
    m = quality.Discriminant(np.zeros(2), np.ones(2), np.array([[0.0, 0], [1, 1]]), np.array([np.linalg.inv(np.linalg.cholesky(c)) for c in (np.eye(2), np.array([[2.0, 0.5], [0.5, 1]]))]), np.array([-0.1, -0.4]))
    x = rng.normal(size=(20, 2))
    d = [m.offsets[k] - 0.5 * np.einsum("ij,jk,ik->i", x - m.means[k], np.linalg.inv(c), x - m.means[k]) for k, c in enumerate((np.eye(2), np.array([[2.0, 0.5], [0.5, 1]])))]
    assert np.allclose(m.scores(x), 1 / (1 + np.exp(d[0] - d[1])))


def test_toxicity_held_out(spark):
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    rows = queries.op6_toxicity(spark, DIR).collect()
    accuracy, pairs = held_out(rows, truth, 0.7)
    assert accuracy > 0.9 and len(rows) == 1000
    assert np.mean([b for a, b in pairs if a]) > 0.9


def test_label_model_finds_accuracies_and_echoes():
    rng = np.random.default_rng(3)
    y = rng.random(20000) < 0.2
    hit = [(0.7, 0.02), (0.6, 0.05), (0.5, 0.01)]
    fired = [np.where(y, rng.random(len(y)) < a, rng.random(len(y)) < b) for a, b in hit]
    fired.append(np.where(rng.random(len(y)) < 0.95, fired[1], False))  # an echo of the second
    votes = sum(f.astype(np.int64) << i for i, f in enumerate(fired))
    pattern, n = np.unique(votes, return_counts=True)
    known = np.full(len(pattern), -1)
    m = toxicity.fit_labels(pattern, n.astype(float), known, voters=4, hits=4, prior=0.2)
    assert abs(m.prior - 0.2) < 0.08
    # without a single label the accuracies are rough, but in order
    assert all(abs(a - x) < 0.2 and abs(1 - b - z) < 0.05 for (x, z), (a, b) in zip(m.accuracies(), hit))
    assert m.accuracies()[0][0] > m.accuracies()[2][0]
    assert (m.parent[3], m.parent[1]).count(1) + (m.parent[3], m.parent[1]).count(3) >= 1
    assert m.posterior(np.array([0b1010]))[0] < m.posterior(np.array([0b0011]))[0]


def test_very_long_texts(spark):
    rng = random.Random(2)
    long = " ".join(f"w{rng.randrange(10**5)}" for _ in range(200_000)) + " idiot " + " ".join(f"w{rng.randrange(10**5)}" for _ in range(60)) + " jane.3@mail.example.com"
    docs = spark.createDataFrame([(1, long), (2, long), (3, "short")], "doc_id long, text string")
    assert {r["component_id"] for r in simhash.near_duplicates(docs).collect()} == {1, 3}
    assert {r["component_id"] for r in simhash.similar(docs).collect()} == {1, 3}
    assert quality.features(docs).count() == 3
    assert {r["doc_id"]: len(r["base"]) for r in pii.find(docs).collect()} == {1: 1, 2: 1, 3: 0}
    assert toxicity.score(docs, spark.createDataFrame([], "doc_id long, label int")).count() == 3
    item = " ".join(long.split()[150_000:150_040])
    bench = spark.createDataFrame([(5, item + ".")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontam.find(docs, bench).collect()} == {(1, 5), (2, 5)}


def test_toxicity_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, "you idiot, you moron", 1), (2, None, 2), (None, "", 3), (1, "fine words", 4)], "doc_id long, text string, votes int")
    none = spark.createDataFrame([], "doc_id long, label int")
    rows = toxicity.score(docs, none).collect()
    assert len(rows) == 4 and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score(docs.limit(0), none).count() == 0


def test_decontamination(spark):
    rng = random.Random(9)
    word = lambda: f"k{rng.randrange(3000)}"
    items = [(i, " ".join(word() for _ in range(rng.randrange(15, 120))) + ". " + " ".join(word() for _ in range(5)) + ".") for i in range(30)]
    docs, want = [], set()
    for d in range(120):
        body = [word() for _ in range(rng.randrange(0, 300))]
        if d % 3 == 0:
            i, t = items[d % 30]
            w = t.split()
            if d % 2:
                w = [x for k, x in enumerate(w) if k % 5]  # a fifth is gone
            at = rng.randrange(len(body) + 1)
            body[at:at] = w
            want.add((d, i))
        docs.append((d, " ".join(body).upper(), "x"))
    docs += [(900, None, "x"), (None, "", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, item string")
    bench = spark.createDataFrame([*items, (77, None), (78, ""), *items[:2]], "item_id long, text string")
    for options in ({}, {"items_per_block": 7}, {"rank": 8, "min_cosine": 0.2, "min_cover": 0.1}):
        got = {(r["doc_id"], r["item_id"]) for r in decontam.find(df, bench, max_share=0.2, **options).collect()}
        assert got <= want
        assert len(got) >= len(want) * (1 if "rank" not in options else 0.5)
    left = decontam.clean(df, bench, max_share=0.2)
    assert left.columns == df.columns and left.count() == 122 - 40
    assert decontam.clean(df, bench.limit(0)).count() == 122
    assert decontam.find(df.limit(0), bench).count() == 0


def test_paraphrases_by_words_that_occur_together(spark):
    rng = random.Random(12)
    topics = [[f"t{k}w{i}" for i in range(60)] for k in range(50)]
    prose = lambda k, n: [rng.choice(topics[k]) if rng.random() < 0.8 else f"g{rng.randrange(400)}" for _ in range(n)]
    docs = [(d, " ".join(prose(d % 50, rng.randrange(60, 200)))) for d in range(800)]
    items = [(i, " ".join(rng.sample(topics[i], 24))) for i in range(40)]
    want = set()
    for i, t in items:
        words = t.split()
        for k in rng.sample(range(24), 8):
            words[k] = rng.choice([w for w in topics[i] if w not in words])
        body = prose((i + 7) % 50, 120)
        docs.append((1000 + i, " ".join([*body[:60], *words, *body[60:]])))
        want.add((1000 + i, i))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.find(df, bench, rank=60, sample_docs=400, max_share=0.2).collect()}
    assert got <= want and len(got) >= 0.9 * len(want), len(got)


def test_latent_space_is_reduced_and_knows_neighbours(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}".encode() for i in range(60)]
    items = [decontam.Item(0, np.arange(1, 11), np.arange(0)), decontam.Item(1, np.arange(31, 41), np.arange(0))]
    # words 11 to 20 stand with those of the first item, 41 to 50 with those of the second
    sample = [rng.choice(np.arange(1, 21) + 30 * (k % 2), 12, False) for k in range(80)]
    limits = {"min_cosine": 0.3, "min_cover": 0.3, "min_common": 0.6, "min_loose": 0.45, "min_answer": 0.8}
    made = decontam.index(spark, items, sample, np.full(len(words) + 1, 5), 100, len(words), 2, 1.0, 1.0, **limits)
    assert made.fold.shape[1] == 2 < len(items) + len(sample)
    like = lambda word, item: float(made.fold[made.column[word]] @ made.latent[item])
    for w in range(11, 21):
        assert like(w, 0) > 5 * abs(like(w, 1)) and like(w + 30, 1) > 5 * abs(like(w + 30, 0))
    for _ in range(50):  # the bound that comes first is never below a product
        passage = rng.choice(np.arange(1, 61), 20)
        at = made.column[passage]
        dots = made.fold[at[at >= 0]].sum(0) @ made.latent.T
        assert (made.mass[at[at >= 0]].sum(0) >= dots - 1e-4).all()


def test_no_false_hits(spark):
    docs = {r["doc_id"]: b" ".join(decontam.words_of(r["text"])) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    items = {r["item_id"]: b" ".join(decontam.words_of(r["text"])) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()}
    want = {(d, i) for d, t in docs.items() for i, x in items.items() if x in t}
    assert {(r["doc_id"], r["item_id"]) for r in queries.op8_decontamination(spark, DIR).collect()} == want


def test_columns_that_clash(spark):
    docs = spark.createDataFrame([(1, "some text of no benchmark at all", 5, 6), (1, "some text of no benchmark at all", 7, 8)], "doc_id long, text string, row long, ROW_ long")
    bench = spark.createDataFrame([(1, "other words stand here")], "item_id long, text string")
    assert sorted(map(tuple, decontam.clean(docs.drop("ROW_"), bench).collect())) == sorted(map(tuple, docs.drop("ROW_").collect()))
    for least in (None, 0.8):
        left = simhash.one_of_each(docs, least=least)
        assert left.columns == docs.columns and left.count() == 1


def test_recall_of_a_large_benchmark(spark):
    rng = random.Random(31)
    word = lambda: f"k{int(rng.paretovariate(0.4)) % 40000}"
    items = [(i, " ".join(word() for _ in range(rng.randrange(8, 14))) + ".") for i in range(1000)]
    docs = []
    for i, t in items:
        body = [word() for _ in range(200)]
        at = rng.randrange(201)
        docs.append((i, " ".join([*body[:at], t, *body[at:]])))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontam.find(df, bench).collect()}
    assert sum((i, i) in found for i, _ in items) >= 985


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(30))] for _ in "ab")
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], last + 1 if x == y and x else max(row[j + 1], row[j])
        assert decontam.common_length(np.array(a, int), np.array(b, int)) == row[-1]
