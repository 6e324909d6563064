"""Outcome store, run to the fixpoint, sources, streaming."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quillspark.operators import client, outcomes
from quillspark.plans import report, run
from quillspark.sources import config, epub
from quillspark.streaming import logs


def test_attempts_restart(spark):
    rows = [("a", 0, h, s, None, None, i) for i, (h, s) in enumerate([("x", "fail"), ("y", "fail"), ("x", "fail"), ("x", "ok")])]
    rows += [("b", 0, "x", "fail", None, None, 9), ("b", 0, "x", "drop", None, None, 10), ("b", 0, "x", "ok", None, None, 11)]
    log = spark.createDataFrame(rows, outcomes.SCHEMA)
    assert sorted(map(tuple, outcomes.attempts(log).collect())) == [("a", 0, 2), ("b", 0, 1)]
    assert outcomes.latest(log).count() == 2
    assert outcomes.attempts(log.limit(0)).count() == 0


def test_run_repairs_until_clean(spark, tmp_path):
    docs = spark.createDataFrame([("a", "<html lang='en'><body><p>one <b>two</b></p></body></html>"), ("b", "<p>plain text</p>")], "rel string, orig string")

    def write(df, name):
        df.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    log, pairs = run.run(docs, {}, client.stub_chat, write)
    found = {r["rel"]: r["trad"] for r in pairs.collect()}
    assert found["a"] == '<html lang="it"><body><p>ONE <b>TWO</b></p></body></html>'
    assert found["b"] == "<p>PLAIN TEXT</p>"
    assert outcomes.latest(log).where("status <> 'ok'").count() == 0


def test_gates(spark):
    rows = spark.createDataFrame([("a", None, ""), ("b", 5, "bad"), ("c", 8, "a slip"), ("d", 9, "faithful"), ("e", 10, "x")], "rel string, score int, comment string")
    assert {r["rel"]: r["action"] for r in run.gate(rows).collect()} == {"a": "unjudged", "b": "retranslate", "c": "polish", "d": "keep", "e": "keep"}
    c = spark.createDataFrame([("a", "x", "y", True, 5, 5)], "rel string, current string, polished string, verified boolean, old_score int, new_score int")
    assert run.kept_polish(c).first()["text"] == "x"
    assert run.kept_leftovers(c).first()["text"] == "y"


def test_epub_round_trip(spark, tmp_path):
    opf = """<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="a" href="cap%201.xhtml#x" media-type="application/xhtml+xml"/>
    <item id="b" href="../jacket.xhtml" media-type="application/xhtml+xml"/><item id="c" href="../../evil.xhtml" media-type="application/xhtml+xml"/><item id="d" href="s.css" media-type="text/css"/></manifest>
    <spine><itemref idref="b"/><itemref idref="a"/><itemref idref="b"/><itemref idref="c"/><itemref idref="d"/></spine></package>"""
    box = '<container><rootfiles><rootfile full-path="OPS/p.opf"/></rootfiles></container>'
    files = [("mimetype", b"application/epub+zip"), ("META-INF/container.xml", box.encode()), ("OPS/p.opf", opf.encode()), ("OPS/cap 1.xhtml", b"<p>1</p>"), ("jacket.xhtml", b"<p>0</p>"), ("OPS/s.css", b"")]
    target = epub.pack(files[::-1], str(tmp_path / "b.epub"))
    with zipfile.ZipFile(target) as z:
        assert z.namelist()[0] == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED
    entries = epub.entries(spark, target)
    assert entries.count() == 6
    assert [r["entry"] for r in epub.spine(entries).orderBy("pos").collect()] == ["jacket.xhtml", "OPS/cap 1.xhtml"]


def test_config():
    text = 'model = "m"\n[languages]\nsource_lang = "english"\n'
    assert config.settings("user", text) == [("user", "model", "m"), ("user", "source_lang", "english")]
    kept = ({"b": "x", "a": "y", 'say "a"': "it's"}, {"a": ["in a", "Loomis, The Grail"]}, "note\nof [two] lines")
    assert config.glossary(config.glossary_text(*kept)) == kept


def test_settings_stay_as_they_are_written():
    text = """# a comment
retries = 3   # another
on = true
ratio = 0.50
path = 'a # b\\n'
[lists]
hints = ["one, two", 'three', # the rest
  "four"]
empty = []
"""
    assert config.settings("book", text) == [("book", "retries", "3"), ("book", "on", "true"), ("book", "ratio", "0.50"), ("book", "path", "a # b\\n"), ("book", "hints", '["one, two", "three", "four"]'), ("book", "empty", "[]")]
    assert config.toml("") == {} and config.toml("no entry\n[x") == {}


def test_glossary_as_a_table(spark):
    rows = config.glossary_table(spark, {"b": "x", "a": "y"}, {"a": ["in a"]}).collect()
    assert [tuple(r) for r in rows] == [("a", "y", ["in a"]), ("b", "x", [])]


def test_root_of_a_package():
    names = {"META-INF/container.xml", "x/y/META-INF/container.xml"}
    assert epub.root_of("x/y/OPS/p.opf", names) == "x/y"
    assert epub.root_of("OPS/p.opf", names) == ""
    assert epub.root_of("a/b/c/d/e/f/p.opf", {"META-INF/c"}) == "a/b/c/d/e"


def test_a_failing_export_keeps_the_old_one(tmp_path):
    target = str(tmp_path / "b.epub")
    rows = [("mimetype", b"m"), ("a.xhtml", b"<p/>")]
    epub.pack_translation(rows, target, lambda files: files | {"made.xhtml": b"how"})
    with zipfile.ZipFile(target) as z:
        assert z.namelist() == ["mimetype", "a.xhtml", "made.xhtml"]

    def fails(files):
        raise RuntimeError

    with pytest.raises(RuntimeError):
        epub.pack_translation(rows, target, fails)
    with zipfile.ZipFile(target) as z:
        assert "made.xhtml" in z.namelist()


def test_tokens_in_sql(spark):
    from quillspark.operators import lexer

    lexer.register(spark)
    spark.createDataFrame([(1, "<p>a<br/></p>"), (2, None)], "id long, html string").createOrReplaceTempView("marked")
    rows = spark.sql("SELECT id, pos, kind, name, start, end FROM marked, LATERAL tokens(html) ORDER BY pos").collect()
    assert [tuple(r) for r in rows] == [(1, 0, "open", "p", 0, 3), (1, 1, "text", "", 3, 4), (1, 2, "void", "br", 4, 9), (1, 3, "close", "p", 9, 13)]


def writer(spark, tmp_path):
    def write(df, name):
        df.write.parquet(f"{tmp_path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{tmp_path}/{name}")

    return write


PAGE = "<html lang='en'><body><p>{}</p></body></html>"


def test_line_endings_and_checks_of_the_run(spark, tmp_path):
    docs = spark.createDataFrame([("a", PAGE.format("one\r\ntwo")), ("b", "<p>no page</p>")], "rel string, orig string")
    log, pairs = run.run(docs, {}, client.stub_chat, writer(spark, tmp_path), passes=2)
    found = {r["rel"]: r["trad"] for r in pairs.collect()}
    assert found["a"] == '<html lang="it"><body><p>ONE TWO</p></body></html>'
    # b has no <html> to carry its language: it never verifies, whatever its units are
    assert {r["rel"]: r["reasons"] for r in run.saved_failing(pairs, {}).collect()} == {"b": "lang"}
    assert outcomes.latest(log).where("status <> 'ok'").count() == 0


def test_quality_gate(spark, tmp_path):
    long = "The quick brown fox jumps over the lazy dog. "
    docs = {"good": PAGE.format(long), "slip": PAGE.format(long + "However."), "bad": PAGE.format(long + "x"), "words": PAGE.format("However " + long)}
    trad = {"good": long.upper(), "slip": (long + "slip").upper(), "bad": "WRONG " + long.upper(), "words": "However " + long.upper()}
    pairs = spark.createDataFrame([(k, v, PAGE.replace("'en'", '"it"').format(trad[k])) for k, v in docs.items()], "rel string, orig string, trad string")

    def judge(prompt, **_):
        said = prompt.partition("TRANSLATION:")[2]
        return "3/10 | wrong" if "WRONG" in said else "8/10 | slip remains" if "SLIP" in said else "9/10 | faithful"

    def chat(prompt, **options):
        if prompt.startswith("A reviewer"):
            return client.stub_chat(prompt.replace("CURRENT", "")) if "WRONG" in prompt else '<seg id="1">' + (long + "MENDED").upper() + "</seg>"
        if prompt.startswith("Replace the word"):
            return "TUTTAVIA " + long.upper().strip()
        return client.stub_chat(prompt)

    left, verdicts, stubborn = run.quality_gate(pairs, {}, chat, judge, writer(spark, tmp_path))
    text = {r["rel"]: r["trad"] for r in left.collect()}
    told = {r["rel"]: (r["score"], r["blocked"]) for r in verdicts.collect()}
    assert "MENDED" in text["slip"] and "TUTTAVIA" in text["words"] and "WRONG" not in text["bad"]
    assert told == {"good": (9, False), "slip": (9, False), "bad": (9, False), "words": (9, False)}
    assert stubborn.count() == 0


def test_gate_without_a_judge_or_with_a_bad_text(spark, tmp_path):
    pairs = spark.createDataFrame([("a", PAGE.format("however it is"), PAGE.format("however it is"))], "rel string, orig string, trad string")

    def out(prompt, **_):
        raise RuntimeError("out")

    _, verdicts, _ = run.quality_gate(pairs, {}, client.stub_chat, out, writer(spark, tmp_path / "out"))
    assert [tuple(r) for r in verdicts.collect()] == [("a", None, "ok", False)]
    keep = lambda prompt, **_: "however <b>" if prompt.startswith("Replace") or prompt.startswith("Translate from") and "<seg" not in prompt else client.stub_chat(prompt)
    _, verdicts, stubborn = run.quality_gate(pairs, {}, keep, lambda prompt, **_: "2/10 | faithful", writer(spark, tmp_path / "low"))
    assert [tuple(r)[1::2] for r in verdicts.collect()] == [(2, True)]
    assert [tuple(r) for r in stubborn.collect()] == [("a", "however")]


def test_measures(spark):
    docs = spark.createDataFrame([("a", "<p>hi <i>there</i></p><p>all 12 fine</p>")], "rel string, orig string")

    def chat(prompt, temperature, **_):
        return client.stub_chat(prompt).replace("<g1>", "") if temperature < 0.3 else client.stub_chat(prompt)

    found = client.measure_documents(docs, {}, chat, runs=2)
    r = report.measured(found).first()
    assert (r["units"], r["first"], r["final"], r["calls"]) == (4, 0.5, 1.0, 4) and r["chars_per_s"] > 0
    assert [tuple(x) for x in report.refusals(found).collect()] == [("placeholder _ missing", 2)]


def test_states_and_low_files(spark):
    rows = [("a", 0, "x", "ok", None, None, 1), ("a", 1, "x", "fail", "r1", None, 2), ("a", 2, "x", "fail", "r2", None, 3), ("b", 0, "x", "ok", None, None, 4), ("c", 0, "x", "drop", None, None, 5)]
    log = spark.createDataFrame(rows, outcomes.SCHEMA)
    assert {tuple(r) for r in outcomes.state(log).collect()} == {("a", False, "r2"), ("b", True, None)}
    assert [r["rel"] for r in outcomes.pending(log).collect()] == ["a"]
    sources = spark.createDataFrame([("a", "s")], "rel string, orig string")
    assert outcomes.valid_for(log, sources).count() == 0
    scores = spark.createDataFrame([("a", 3, "bad"), ("b", None, ""), ("c", 7, "")], "rel string, score int, comment string")
    assert [r["rel"] for r in report.judged_low(scores).collect()] == ["a"]


def test_logs_batch_and_stream(spark, tmp_path):
    lines = [json.dumps({"slug": "s", "score": 8, "completion_tokens": 5}), "{broken", json.dumps({"slug": "s", "score": None, "completion_tokens": None})]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_text("\n".join(lines))
    batch = config.records(spark, str(tmp_path / "in"))
    assert tuple(report.log_summary(batch).first()) == (2, 8, 5)
    q = logs.progress(logs.records(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("logs").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert tuple(spark.table("logs").first()) == ("s", 2, 8, 5)


def test_localname(spark):
    assert spark.range(1).select(epub.localname(F.lit("{urn:x}item")).alias("n")).first()["n"] == "item"


def test_single_files_are_dealt_out(spark, tmp_path):
    from quillspark.session import spread

    spark.range(100).coalesce(1).write.parquet(f"{tmp_path}/one")
    one = spark.read.parquet(f"{tmp_path}/one")
    assert spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert sorted(r["id"] for r in spread(one).collect()) == list(range(100))
    many = spark.range(100).repartition(9)
    assert spread(many) is many


def test_wrong_rendering_names_the_confusion():
    from quillspark.operators.terms import wrong_rendering

    g = {"esoterism": "esoterismo", "exoterism": "essoterismo"}
    assert "rendering of “exoterism”" in wrong_rendering("esoterism", "esoterismo", "about esoterism", "su essoterismo", g)
    assert wrong_rendering("esoterism", "esoterismo", "esoterism", "esoterism0 x", {"esoterism": "esoterismo"}).startswith("the previous output wrote “esoterism0”")
    assert wrong_rendering("trine", "trigono", "trine", "altro", {"trine": "trigono"}) == ""
