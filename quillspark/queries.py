"""The registered queries of the document engine and their SQL equivalents.

``pages`` are the documents, pairs are made from them; ``documents`` serve as a
corpus of terms and, dealt over their sources, as outcomes and judge reports.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import dims, text
from quillspark.operators import batching, client, diff, leftovers, lexer, outcomes, segment, splice, terms, verify
from quillspark.operators.pairs import CASE, pairs
from quillspark.plans import report, run
from quillspark.session import spread

#: Renderings that the invented prose keeps or misses, by number of the document.
GLOSSARY = (("thought", "gedanke"), ("reading", "reading"), ("the", "die"), ("onthe", "onthem"), ("tion", "tione"))
EXTRA_WORDS = ("the", "and", "with", "les", "und")
SETTINGS = (
    ("defaults", "source_lang", "english"), ("defaults", "target_lang", "italian"), ("defaults", "retries", "3"), ("defaults", "register", "tu"),
    ("user", "retries", "5"), ("user", "model", "m-small"), ("user", "register", ""), ("user", "unheard_of", "x"),
    ("book", "target_lang", "German"), ("book", "model", "m-large"), ("env", "model", ""), ("env", "backoff_s", "9"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def page_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexer.tokens(table(spark, sf_dir, "pages"))


def page_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(table(spark, sf_dir, "pages"))


# ---- lexing ----


def lex_token_kinds(spark, sf_dir):
    """Tokens of each kind in every page."""
    return page_tokens(spark, sf_dir).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


def lex_offsets(spark, sf_dir):
    """Every token with its place."""
    return lexer.with_offsets(page_tokens(spark, sf_dir)).select("doc_id", "pos", "kind", "name", "start", "end")


def lex_roundtrip_violations(spark, sf_dir):
    """Pages whose tokens, joined, aren't the page: none."""
    pages = table(spark, sf_dir, "pages")
    return pages.where(F.array_join(lexer.raw_tokens(F.col("html")), "") != F.col("html")).select(F.col("page_id").alias("doc_id"))


def attr_signature(spark, sf_dir):
    """Normal form of the attributes of every start tag."""
    t = page_tokens(spark, sf_dir).where("kind in ('open', 'void')")
    sig = F.array_join(F.transform(lexer.signature(lexer.attributes(F.col("raw"))), lambda a: F.concat(a["name"], F.lit("="), a["value"])), ";")
    return t.select("doc_id", "pos", "name", sig.alias("signature"))


def block_tag_counts(spark, sf_dir):
    """Opening and closing tags of block elements over all pages."""
    t = page_tokens(spark, sf_dir).where(F.col("name").isin(*dims.BLOCK))
    return t.groupBy("name").agg(F.count_if(F.col("kind") == "open").alias("n_open"), F.count_if(F.col("kind") == "close").alias("n_close"))


# ---- units ----


def unit_islands(spark, sf_dir):
    """Runs of tokens between block boundaries."""
    return segment.islands(page_tokens(spark, sf_dir))


def units_protected(spark, sf_dir):
    """Units of all pages with their markup taken out."""
    return segment.units(table(spark, sf_dir, "pages"))


def unit_stats(spark, sf_dir):
    """Units, characters and placeholders of each page."""
    return segment.unit_stats(units_protected(spark, sf_dir))


def identity_splice(spark, sf_dir):
    """Digests of all pages after taking the insides of their units out and putting them back."""
    pages = table(spark, sf_dir, "pages")
    units = segment.units(pages)
    taken = units.join(pages.select(F.col("page_id").alias("doc_id"), "html"), "doc_id")
    before = F.col("start") + F.length("lead")
    inner = F.substring(F.col("html"), before + 1, F.col("end") - F.length("trail") - before)
    return splice.spliced(pages, units, taken.select("doc_id", "idx", inner.alias("inner"))).select("doc_id", F.md5("html").alias("html_md5"))


def interval_units_at(spark, sf_dir):
    """Islands that meet spans of 20 characters in every 100 of each page."""
    t = lexer.with_offsets(page_tokens(spark, sf_dir))
    every = F.sequence(F.lit(0), F.floor(F.length("html") / 100).cast("int"))
    spans = table(spark, sf_dir, "pages").where("html is not null").select(F.col("page_id").alias("doc_id"), F.explode(every).alias("k")).select("doc_id", (F.col("k") * 100).alias("s"), (F.col("k") * 100 + 20).alias("e"))
    bound = segment.is_boundary(F.col("kind"), F.col("name"))
    runs = t.withColumn("b", bound).withColumn("idx", F.sum(bound.cast("int")).over(lexer.in_document())).where("not b").groupBy("doc_id", "idx").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return splice.units_at(runs, spans)


def overlap_edits(spark, sf_dir):
    """Whole texts after an edit for every 37 characters, of which overlapping ones are dropped."""
    d = table(spark, sf_dir, "documents").where("length(text) > 0")
    n = F.length("text")
    start = lambda k: (k * 61) % n
    at = F.transform(F.sequence(F.lit(0), F.floor(n / 37).cast("int")), lambda k: F.struct(start(k).alias("start"), F.least(n, start(k) + 4 + k % 9).alias("end"), F.concat(F.lit("["), k.cast("string"), F.lit("]")).alias("replacement")))
    kept = d.select("doc_id", "text", splice.resolved(at).alias("kept"))
    return kept.select("doc_id", F.size("kept").alias("n_kept"), F.md5(splice.applied(F.col("text"), F.col("kept"))).alias("edited_md5"))


# ---- pairs ----


def verify_tag_counts(spark, sf_dir):
    """Key tags on both sides of every pair."""
    return page_pairs(spark, sf_dir).select("doc_id", verify.counts(F.col("orig"), verify.KEY_TAGS).alias("o_tags"), verify.counts(F.col("trad"), verify.KEY_TAGS).alias("t_tags"))


def verify_checks(spark, sf_dir):
    """Each check of every pair."""
    return verify.checks(page_pairs(spark, sf_dir), hints=("ad",))


def verify_id_href_multisets(spark, sf_dir):
    """Link targets of both sides, as sorted lists."""
    p = page_pairs(spark, sf_dir)
    return p.select("doc_id", F.array_join(verify.values_of(F.col("orig"), "href"), " ").alias("o_hrefs"), F.array_join(verify.values_of(F.col("trad"), "href"), " ").alias("t_hrefs"), (verify.values_of(F.col("orig"), "id") == verify.values_of(F.col("trad"), "id")).alias("ids"))


def verify_score(spark, sf_dir):
    """Outcome, score and failing checks of every pair."""
    return verify.scored(verify_checks(spark, sf_dir)).select("doc_id", "passed", "score", "reasons")


def verify_xhtml(spark, sf_dir):
    """Pages that are well-formed XML, and the first error of others."""
    p = page_pairs(spark, sf_dir).select("doc_id", verify.parse_errors("trad").alias("error"))
    return p.select("doc_id", F.col("error").isNull().alias("xhtml"), "error")


def book_health(spark, sf_dir):
    """Checked and passing pairs and their scores, by book."""
    return verify.health(verify_score(spark, sf_dir).withColumn("book", F.col("doc_id") % 10), "book")


def failure_causes(spark, sf_dir):
    """Failing pairs by cause."""
    s = verify_score(spark, sf_dir).where("not passed").withColumn("reason", F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("HTTP 507: "), "reasons")).otherwise(F.col("reasons")))
    return s.groupBy(text.category(F.col("reason")).alias("cause")).agg(F.count("*").alias("n"))


def prologue_defects(spark, sf_dir):
    """Pairs whose beginning differs in more than language."""
    p = page_pairs(spark, sf_dir).withColumn("trad", F.when(F.col("doc_id") % 9 == 0, F.replace("trad", F.lit("<!DOCTYPE html>"), F.lit(""))).otherwise(F.col("trad")))
    return p.where(diff.prologue_differs(F.col("orig"), F.col("trad"))).select("doc_id")


def attr_defects(spark, sf_dir):
    """Start tags of aligned pairs whose attributes differ."""
    return diff.attribute_defects(page_pairs(spark, sf_dir))


def content_defects(spark, sf_dir):
    """Paragraphs that got short, or an ellipsis."""
    d = table(spark, sf_dir, "documents")
    t = F.when(F.col("doc_id") % 3 == 0, F.expr("left(text, cast(floor(length(text) * 0.6) as int))")).when(F.col("doc_id") % 3 == 1, F.concat("text", F.lit(" . . ."))).otherwise(F.col("text"))
    made = d.select("doc_id", F.concat(F.lit("<p>"), "text", F.lit("</p>")).alias("orig"), F.concat(F.lit("<p>"), t, F.lit("</p>")).alias("trad"))
    return diff.content_defects(made, "p")


def struct_diff(spark, sf_dir):
    """All defects of all pairs, by alignment of their tokens."""
    found = diff.defects(page_pairs(spark, sf_dir))
    return found.select("doc_id", "seq", "kind", "detail", F.col("trad_span.s").alias("trad_start"), F.col("trad_span.e").alias("trad_end"))


MOVED = ("<div>one <em>two</em> three</div>", "<div><em>two</em> three one</div>", "<div>one two three</div>")


def inline_moves(spark, sf_dir):
    """Defects of each page with an inline element moved within a block, and with it lost."""
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), *[F.replace("html", F.lit("</body>"), F.lit(f"{block}</body>")).alias(n) for n, block in zip(("orig", "moved", "lost"), MOVED, strict=True)])
    found = lambda name: diff.defects(p.select("doc_id", "orig", F.col(name).alias("trad"))).select("doc_id", F.lit(name).alias("kind"))
    counted = found("moved").union(found("lost")).groupBy("doc_id").agg(*[F.count_if(F.col("kind") == n).alias(f"n_{n}") for n in ("moved", "lost")])
    return p.select("doc_id").join(counted, "doc_id", "left").na.fill(0)


def blamed_units(spark, sf_dir):
    """Units of changed pages that a defect falls into."""
    p = page_pairs(spark, sf_dir)
    return diff.blamed_units(diff.defects(p), segment.units(p, (), "doc_id", "trad"))


def verify_full(spark, sf_dir):
    """All nine checks of every pair, structure included."""
    return verify.full(page_pairs(spark, sf_dir), hints=("ad",)).select("doc_id", "xhtml", "struct", "struct_reason", "passed", "score", "reasons")


# ---- text and terms ----


def leftover_sentences(spark, sf_dir):
    """Sentences of half documents that hold a word of the whole one's language."""
    d = table(spark, sf_dir, "documents")
    trad = F.expr("left(text, cast(floor(length(text) / 2) as int))")
    return leftovers.sentence_spans(d.select("doc_id", F.col("text").alias("orig"), trad.alias("trad")), extra=EXTRA_WORDS)


def sentences(spark, sf_dir):
    """Sentences of every document."""
    return leftovers.sentence_table(table(spark, sf_dir, "documents"))


def leftover_words(spark, sf_dir):
    """Function words on both sides of a pair of documents."""
    d = table(spark, sf_dir, "documents")
    trad = F.expr("left(text, cast(floor(length(text) / 2) as int))")
    return leftovers.find(d.select("doc_id", F.col("text").alias("orig"), trad.alias("trad")), extra=EXTRA_WORDS)


def term_frequencies(spark, sf_dir):
    """Frequent long words, folded."""
    return terms.frequencies(table(spark, sf_dir, "documents"))


def near_twins(spark, sf_dir):
    """Frequent words one letter apart."""
    return terms.near_twins(term_frequencies(spark, sf_dir))


def _glossary(spark):
    return spark.createDataFrame(list(GLOSSARY), "src string, dst string")


def _doc_pairs(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    t = F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.replace(F.lower("text"), F.lit("the"), F.lit("die")))
    return d.select("doc_id", F.col("text").alias("o"), t.alias("t"))


def glossary_defects(spark, sf_dir):
    """Pinned terms that documents don't render."""
    return terms.broken(_doc_pairs(spark, sf_dir), _glossary(spark))


def glossary_violations(spark, sf_dir):
    """Documents that miss each term."""
    return terms.violations(_glossary(spark), glossary_defects(spark, sf_dir))


def glossary_conflicts(spark, sf_dir):
    """Terms that fail in several sources."""
    found = glossary_defects(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    reason = F.concat(F.lit("term '"), "src", F.lit("' not rendered as '"), "dst", F.lit("' in <p>"))
    return terms.conflicts(found.select(F.col("source").alias("file"), F.col("doc_id").alias("seq"), reason.alias("reason")))


def parse_extraction(spark, sf_dir):
    """Rows of terminology replies made from documents, a line for every six words."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    word = lambda i: F.coalesce(F.get("w", i), F.lit(""))
    line = lambda i: F.concat((i + 1).cast("string"), F.lit(". "), word(6 * i), F.lit(" | "), word(6 * i + 1), F.lit("|"), word(6 * i + 2), F.lit(" | because\n- "), word(6 * i + 3), F.lit("|x|"), word(6 * i + 3))
    cut = d.select("doc_id", F.split("text", " ").alias("w"))
    reply = F.concat(F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / 6).cast("int")), line), "\n"), F.lit("\nNONE\n* only|two"))
    return terms.extraction(cut.select("doc_id", reply.alias("reply")))


def parse_judge_report(spark, sf_dir):
    """Score and comment of judge reports made from documents."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    line = F.when(F.col("doc_id") % 4 == 0, F.lit("no score here")).otherwise(F.concat((F.col("doc_id") % 13).cast("string"), F.lit(" /10 | "), F.lit("note "), F.col("lang")))
    r = d.select("doc_id", line.alias("r"))
    score, comment = text.judge_score(F.col("r")), text.judge_comment(F.col("r"))
    return r.select("doc_id", score.alias("score"), comment.alias("comment"), text.has_issue(score, comment).alias("has_issue"))


def gate_decisions(spark, sf_dir):
    """What the quality gate does with each judged document."""
    r = parse_judge_report(spark, sf_dir).select(F.col("doc_id").cast("string").alias("rel"), "score", "comment")
    return run.gate(r)


def judged_summary(spark, sf_dir):
    """Average score, and how many are low."""
    return report.judged(parse_judge_report(spark, sf_dir))


def sample_thirds(spark, sf_dir):
    """Head, middle and tail of long documents."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", F.md5(text.sample(F.col("text"), 600)).alias("sample_md5"))


def rewrite_lang(spark, sf_dir):
    """Pages with their language attributes rewritten."""
    p = table(spark, sf_dir, "pages")
    return p.select(F.col("page_id").alias("doc_id"), F.md5(text.rewrite_lang(F.col("html"), "it")).alias("html_md5"))


def text_functions(spark, sf_dir):
    """Small text functions on every document."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    first = F.split("text", "[ \n]")[0]
    return d.select(
        "doc_id",
        text.term_stem(first).alias("stem"),
        text.slug(F.left("text", F.lit(40))).alias("slug"),
        text.lang_code(F.col("lang")).alias("code"),
        F.md5(text.encoded(F.col("text"))).alias("encoded_md5"),
        F.md5(text.match_line_ending(F.col("text"), F.lit("\r\n"))).alias("crlf_md5"),
        text.ellipses(F.concat("text", F.lit("… . . . ..."))).alias("n_ellipses"),
    )


def answer_markers(spark, sf_dir):
    """Placeholders of answers in their normal spelling, and the text without."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    answer = F.concat(F.lit("<g1>"), F.replace("text", F.lit(". "), F.concat(F.lit(". < X"), (F.col("doc_id") % 9).cast("string"), F.lit("/><g2>"))), F.lit("</ g1> <x"), (F.col("doc_id") % 7).cast("string"), F.lit("></x2> end< X3/>"))
    return d.select("doc_id", F.array_join(splice.normal_markers(answer), " ").alias("markers"), F.md5(splice.plain_text(answer)).alias("plain_md5"))


# ---- batches, outcomes, reports ----


def greedy_batches(spark, sf_dir):
    """Documents of each source in batches of up to 9000 characters and 12 texts."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("idx"), F.length("text").alias("n"))
    return batching.batches(d, 9000, 12)


LOG = """
SELECT source AS rel, CAST(floor(doc_id / 20) AS INT) % 5 AS idx, lang AS orig_hash,
       CASE WHEN doc_id % 7 = 0 THEN 'drop' WHEN doc_id % 3 = 0 THEN 'fail' ELSE 'ok' END AS status,
       CASE WHEN doc_id % 3 = 0 THEN concat('r', CAST(doc_id % 5 AS STRING)) END AS reason,
       left(text, 20) AS text, doc_id AS seq
FROM {documents}
"""


def _log(spark, sf_dir):
    return spark.sql(LOG, documents=table(spark, sf_dir, "documents"))


def outcomes_latest(spark, sf_dir):
    """What holds now of each unit."""
    return outcomes.latest(_log(spark, sf_dir)).select("rel", "idx", "orig_hash", "status", "reason", "seq")


def attempts_latest(spark, sf_dir):
    """Attempts on the present source of each unit."""
    return outcomes.attempts(_log(spark, sf_dir))


def unit_status(spark, sf_dir):
    """Good and failing units of each file."""
    return outcomes.unit_status(_log(spark, sf_dir))


def failed_units_topk(spark, sf_dir):
    """The first three failing units of each file."""
    return outcomes.failed_units(_log(spark, sf_dir), 3)


def retry_budget(spark, sf_dir):
    """Calls that each unit has left."""
    return outcomes.retry_budget(outcomes.attempts(_log(spark, sf_dir))).select("rel", "idx", "attempts", "gave_up", "left")


def _plan(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("rel"), F.col("page_id").alias("pos"))
    n = F.col("pos")
    return p, p.where(n % 4 == 1), p.where(n % 5 == 2), p.where(n % 3 == 0)


def plan_pass(spark, sf_dir):
    """Files to translate and to repair in the next pass."""
    return outcomes.plan_pass(*_plan(spark, sf_dir))


def requeue_unknown(spark, sf_dir):
    """Files asked for that no book has."""
    spine, done, _, _ = _plan(spark, sf_dir)
    asked = spine.select((F.col("pos") * 2).cast("string").alias("rel"))
    return outcomes.requeue(done, asked, spine)[2]


def dropped_units(spark, sf_dir):
    """Tombstones for the files of three sources."""
    rels = spark.createDataFrame([("src1",), ("src2",), ("src2",), ("none",)], "rel string")
    return outcomes.dropped(_log(spark, sf_dir), rels, 10**9).select("rel", "idx", "orig_hash", "status", "seq")


def read_original(spark, sf_dir):
    """Original texts, or present ones where none was kept."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("rel"), "text")
    kept = d.where("rel % 3 <> 0").select("rel", F.concat(F.lit("o:"), "text").alias("text"))
    return outcomes.read_original(kept, d).select("rel", F.md5("orig").alias("orig_md5"))


def books_progress(spark, sf_dir):
    """Files, finished and failing ones of each book."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("slug"), F.col("doc_id").alias("rel"))
    return report.books(d, d.where("rel % 3 = 0"), d.where("rel % 7 = 1"))


def log_lines(spark, sf_dir):
    """Records as lines of text."""
    r = _records(spark, sf_dir).withColumns({"ts": F.lit("2020-01-01T00:00:00"), "file": F.concat("slug", F.lit(".xhtml")), "status": F.lit("ok")})
    return report.log_lines(r)


def judge_stub(spark, sf_dir):
    """Scores of a judge that always says the same."""
    p = page_pairs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("rel"), "orig", "trad")
    return client.judge_pairs(p, {}, lambda prompt, **_: f"{len(prompt) % 11}/10 | note")


def done_state(spark, sf_dir):
    """Finished and failing files, with the reason of the last failing unit."""
    return outcomes.state(_log(spark, sf_dir))


def config_precedence(spark, sf_dir):
    """The value of each setting and the layer it comes from."""
    return report.precedence(spark.createDataFrame(list(SETTINGS), "layer string, key string, value string"))


def _records(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("slug"), F.concat(F.lit("m"), (F.col("doc_id") % 3).cast("string")).alias("model"), F.when(F.col("doc_id") % 4 != 0, F.col("doc_id") % 101).alias("score"), F.when(F.col("doc_id") % 6 != 0, F.col("n_chars")).alias("completion_tokens"))


def log_summary(spark, sf_dir):
    """Attempts, average score and tokens of all records."""
    return report.log_summary(_records(spark, sf_dir))


def log_models(spark, sf_dir):
    """Models of each book."""
    return report.models(_records(spark, sf_dir))


def event_log(spark, sf_dir):
    """JSON records of the event log by kind."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count(k).alias("n_k"), F.sum(k).alias("sum_k"))


# ---- the model ----


def translate_stub(spark, sf_dir):
    """Every page through the protocol with the deterministic model."""
    docs = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("rel"), F.col("html").alias("orig"), F.lit(None).cast("array<struct<idx:int,attempts:bigint,reason:string,inner:string>>").alias("history"))
    return client.translate_documents(docs, dict(dims.DEFAULTS), client.stub_chat)


def measured_units(spark, sf_dir):
    """How many units of all pages are valid at once and in the end."""
    docs = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("rel"), F.col("html").alias("orig"))
    return report.measured(client.measure_documents(docs, {}, client.stub_chat)).drop("chars_per_s")


QUERIES = {
    f.__name__: f
    for f in (
        lex_token_kinds, lex_offsets, lex_roundtrip_violations, attr_signature, block_tag_counts,
        unit_islands, units_protected, unit_stats, identity_splice, interval_units_at, overlap_edits,
        verify_tag_counts, verify_checks, verify_id_href_multisets, verify_score, verify_xhtml, book_health, failure_causes,
        prologue_defects, attr_defects, content_defects, struct_diff, inline_moves, blamed_units, verify_full,
        sentences, leftover_sentences, leftover_words, term_frequencies, near_twins, glossary_defects, glossary_violations, glossary_conflicts,
        parse_extraction, parse_judge_report, gate_decisions, judged_summary, sample_thirds, rewrite_lang, text_functions, answer_markers,
        greedy_batches, outcomes_latest, attempts_latest, unit_status, failed_units_topk, retry_budget, plan_pass, requeue_unknown,
        dropped_units, read_original, books_progress, done_state, config_precedence, log_summary, log_models, log_lines, event_log,
        translate_stub, judge_stub, measured_units,
    )
}


# ---- equivalents in DuckDB SQL ----

_NAME = r"[A-Za-z][\pL\pN_:.\-]*"
_TOKEN = r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<![^>]*>|<\?.*?\?>" + rf"|</\s*{_NAME}\s*>" + rf"""|<{_NAME}[^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*>""" + r"|<|[^<]+"
_Q = lambda s: "'" + s.replace("'", "''") + "'"
_IN = lambda xs: "(" + ", ".join(map(_Q, xs)) + ")"
_TOK = f"""
raw_tok AS (SELECT page_id AS doc_id, regexp_extract_all(html, {_Q(_TOKEN)}) AS ts FROM pages),
cut AS (SELECT doc_id, CAST(unnest(range(len(ts))) AS INT) AS pos, unnest(ts) AS raw FROM raw_tok),
named AS (SELECT *, lower(regexp_extract(raw, {_Q("^</?[[:space:]]*(" + _NAME + ")")}, 1)) AS name FROM cut),
tok AS (SELECT *, CASE WHEN raw LIKE '<!--%' AND length(raw) > 4 THEN 'comment' WHEN raw LIKE '<![CDATA[%' THEN 'cdata' WHEN raw LIKE '<!%' THEN 'decl'
  WHEN raw LIKE '<?%' THEN 'pi' WHEN raw = '<' THEN 'lt' WHEN raw LIKE '</%' THEN 'close'
  WHEN raw LIKE '<%' THEN CASE WHEN name IN {_IN(dims.VOID)} THEN 'void' ELSE 'open' END ELSE 'text' END AS kind FROM named)"""
_OFF = _TOK + """,
off AS (SELECT *, sum(length(raw)) OVER w AS "end", sum(length(raw)) OVER w - length(raw) AS "start" FROM tok WINDOW w AS (PARTITION BY doc_id ORDER BY pos))"""
_BOUND = f"((kind IN ('open', 'close', 'void') AND name IN {_IN(dims.BLOCK + dims.EXTRA_BLOCKS)}) OR kind IN ('comment', 'decl', 'pi', 'cdata'))"
_ATTR = r"""([A-Za-z_:][\pL\pN_:.\-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?"""
_LANG = r"""(xml:lang|lang)\s*=\s*("[^"]*"|'[^']*')"""


def _lang_sql(html: str, code: str = "it") -> str:
    done = f"regexp_replace({html}, {_Q(_LANG)}, '\\1=\"{code}\"', 'g')"
    return f"regexp_replace({done}, '(?i)^((?s).*?)(<html)>', '\\1\\2 lang=\"{code}\" xml:lang=\"{code}\">')"


_PAIRS = f"""
mut AS (SELECT page_id AS doc_id, html AS orig, {CASE} AS trad0 FROM pages),
pairs AS (SELECT doc_id, orig, CASE WHEN doc_id % 16 = 15 THEN trad0 ELSE {_lang_sql("trad0")} END AS trad FROM mut)"""
_COUNT = lambda s, p: f"len(regexp_extract_all({s}, {_Q(p)}))"
_VALUES = lambda s, a: f"list_sort(regexp_extract_all({s}, {_Q(chr(92) + 's' + a + '=' + chr(34) + '([^' + chr(34) + ']*)' + chr(34))}, 1))"
_CHECKS = (
    _PAIRS
    + f""",
tagged AS (SELECT *, regexp_extract(trad, '<html\\b[^>]*>') AS tag FROM pairs),
checks AS (SELECT doc_id, {_COUNT("orig", verify.KEY_TAGS)} = {_COUNT("trad", verify.KEY_TAGS)} AS tags,
  {_COUNT("orig", 'class="ad"')} = {_COUNT("trad", 'class="ad"')} AS code,
  {_COUNT("orig", verify.PAGE_BREAK)} = {_COUNT("trad", verify.PAGE_BREAK)} AS pagebreak,
  {_VALUES("orig", "id")} = {_VALUES("trad", "id")} AS ids, {_VALUES("orig", "href")} = {_VALUES("trad", "href")} AS hrefs,
  contains(tag, 'lang="it"') OR contains(tag, 'lang=''it''') AS lang, length(trad) >= 0.5 * length(orig) AS length FROM tagged),
scores AS (SELECT doc_id, tags AND code AND pagebreak AND ids AND hrefs AND lang AND length AS passed,
  CAST(round_even(100.0 * (tags::INT + code::INT + pagebreak::INT + ids::INT + hrefs::INT + lang::INT + length::INT) / 7, 0) AS INT) AS score,
  concat_ws(';', {", ".join(f"CASE WHEN NOT {c} THEN '{c}' END" for c in verify.CHECKS)}) AS reasons FROM checks)"""
)
_FOLD = lambda s: f"strip_accents(lower({s}))"
_STEM = lambda f: f"CASE WHEN length({f}) > 7 THEN left({f}, length({f}) - 4) WHEN length({f}) >= 5 THEN left({f}, length({f}) - 1) ELSE {f} END"
_FREQ = f"""
words AS (SELECT unnest(regexp_extract_all({_FOLD("text")}, '[\\pL\\pN_]{{6,}}')) AS word FROM documents),
freq AS MATERIALIZED (SELECT word, count(*) AS n FROM words GROUP BY word HAVING count(*) >= 5)"""
_GLOSS = f"""
g AS (SELECT src, dst, {_FOLD("src")} AS s, {_FOLD("dst")} AS d, {_STEM(_FOLD("src"))} AS ss, {_STEM(_FOLD("dst"))} AS ds FROM (VALUES {", ".join(f"({_Q(a)}, {_Q(b)})" for a, b in GLOSSARY)}) AS v(src, dst)),
p AS (SELECT doc_id, source, {_FOLD("text")} AS o, {_FOLD("CASE WHEN doc_id % 2 = 0 THEN text ELSE replace(lower(text), 'the', 'die') END")} AS t FROM documents),
broken AS (SELECT doc_id, source, src, dst FROM p, g WHERE contains(o, s) AND regexp_matches(o, '(?:^|[^\\pL\\pN_])' || s)
  AND (NOT contains(t, ds) OR (NOT (regexp_matches(d, '^' || s || '(?:$|[^\\pL\\pN_])') OR ss = ds) AND regexp_matches(t, '(?:^|[^\\pL\\pN_])' || s || '(?:$|[^\\pL\\pN_])'))))"""
_REPORT = """
r AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'no score here' ELSE concat(CAST(doc_id % 13 AS VARCHAR), ' /10 | note ', lang) END AS r FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, least(CAST(nullif(regexp_extract(r, '(\\d{1,2})\\s*/\\s*10', 1), '') AS INT), CASE WHEN r LIKE 'no%' THEN NULL ELSE 10 END) AS score,
  CASE WHEN r LIKE 'no%' THEN r ELSE trim(regexp_extract(r, '\\d{1,2}\\s*/\\s*10[ |/—:-]*([^\\r\\n]*)', 1)) END AS comment FROM r),
judged AS (SELECT *, coalesce(score < 10 AND trim(comment) <> '' AND NOT lower(trim(comment)) LIKE 'faithful%' AND NOT lower(trim(comment)) LIKE 'fedele%', false) AS has_issue FROM s)"""
_LOG = LOG.replace("{documents}", "documents").replace("AS STRING", "AS VARCHAR").replace("% 5 AS idx", "% 5 AS idx")
_LATEST = f"""
log AS ({_LOG}),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rel, idx ORDER BY seq DESC) AS rn FROM log) WHERE rn = 1 AND status <> 'drop'),
marked AS (SELECT *, CASE WHEN lag(orig_hash) OVER w IS DISTINCT FROM orig_hash OR row_number() OVER w = 1 OR coalesce(lag(status) OVER w, '') = 'drop' THEN 1 ELSE 0 END AS fresh FROM log WINDOW w AS (PARTITION BY rel, idx ORDER BY seq)),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY rel, idx ORDER BY seq) AS run FROM marked),
per_run AS (SELECT rel, idx, run, count(*) AS n FROM runs WHERE status <> 'drop' GROUP BY ALL),
tries AS (SELECT rel, idx, arg_max(n, run) AS attempts FROM per_run GROUP BY ALL)"""
_RECORDS = "rec AS (SELECT source AS slug, concat('m', CAST(doc_id % 3 AS VARCHAR)) AS model, CASE WHEN doc_id % 4 <> 0 THEN doc_id % 101 END AS score, CASE WHEN doc_id % 6 <> 0 THEN n_chars END AS tok FROM documents)"
_CLEAN = "trim(regexp_replace(regexp_replace({}, '<[^>]*>', '', 'g'), '\\s+', ' ', 'g'))"
_MARK = r"<\s*(/?)\s*([gx])(\d+)\s*(/?)\s*>"
_ANSWER = "concat('<g1>', replace(text, '. ', concat('. < X', CAST(doc_id % 9 AS VARCHAR), '/><g2>')), '</ g1> <x', CAST(doc_id % 7 AS VARCHAR), '></x2> end< X3/>')"
_WORDS = _IN(sorted(set(dims.FUNCTION_WORDS["english"]) | set(EXTRA_WORDS)))
_SPLIT = lambda s: f"SELECT doc_id, unnest(regexp_split_to_array(lower(regexp_replace(regexp_replace({s}, {_Q('(?is)' + '|'.join(f'<{t}' + chr(92) + 'b[^>]*>.*?</' + t + chr(92) + 's*>' for t in dims.QUOTED_TAGS))}, ' ', 'g'), '<[^>]*>', ' ', 'g')), '[^\\pL\\pM\\pN_]+')) AS word FROM documents"
_PLAN = """
spine AS (SELECT CAST(page_id AS VARCHAR) AS rel, page_id AS pos FROM pages),
done AS (SELECT * FROM spine WHERE pos % 4 = 1), waiting AS (SELECT * FROM spine WHERE pos % 5 = 2), failing AS (SELECT * FROM spine WHERE pos % 3 = 0)"""
_CODES = "CASE lower(trim(coalesce({0}, ''))) " + " ".join(f"WHEN {_Q(k)} THEN {_Q(v)}" for k, v in dims.LANG_CODES.items()) + " ELSE coalesce(nullif(left(lower(trim(coalesce({0}, ''))), 2), ''), 'xx') END"

ORACLE_SQL = {
    "lex_token_kinds": f"WITH {_TOK} SELECT doc_id, kind, count(*) AS n FROM tok GROUP BY ALL",
    "lex_offsets": f'WITH {_OFF} SELECT doc_id, pos, kind, name, CAST("start" AS BIGINT) AS "start", CAST("end" AS BIGINT) AS "end" FROM off',
    "lex_roundtrip_violations": f"WITH {_TOK} SELECT doc_id FROM raw_tok JOIN pages ON page_id = doc_id WHERE array_to_string(ts, '') <> html",
    "attr_signature": f"""WITH {_TOK}, a AS (SELECT doc_id, pos, name, regexp_extract(raw, {_Q("(?s)^<" + _NAME + "(.*?)/?>$")}, 1) AS x FROM tok WHERE kind IN ('open', 'void')),
        z AS (SELECT doc_id, pos, name, list_zip(regexp_extract_all(x, {_Q(_ATTR)}, 1), regexp_extract_all(x, {_Q(_ATTR)}, 2), regexp_extract_all(x, {_Q(_ATTR)}, 3), regexp_extract_all(x, {_Q(_ATTR)}, 4)) AS zs FROM a),
        kv AS (SELECT doc_id, pos, name, list_sort(list_transform(list_filter(zs, lambda q: q[1] NOT IN {_IN(dims.LANG_ATTRS)}), lambda q: {{'k': q[1], 'v': concat(q[2], q[3], q[4])}})) AS kv FROM z)
        SELECT doc_id, pos, name, coalesce(array_to_string(list_transform(kv, lambda q: q.k || '=' || q.v), ';'), '') AS signature FROM kv""",
    "block_tag_counts": f"WITH {_TOK} SELECT name, count(*) FILTER (kind = 'open') AS n_open, count(*) FILTER (kind = 'close') AS n_close FROM tok WHERE name IN {_IN(dims.BLOCK)} GROUP BY ALL",
    "unit_islands": f"""WITH {_TOK}, m AS (SELECT *, {_BOUND} AS b, sum({_BOUND}::INT) OVER w AS island, sum(CASE WHEN name IN {_IN(dims.LITERAL_BLOCKS)} THEN CASE kind WHEN 'open' THEN 1 WHEN 'close' THEN -1 ELSE 0 END ELSE 0 END) OVER w AS depth FROM tok WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
        SELECT doc_id, CAST(island AS BIGINT) AS island, min(pos) AS first_pos, count(*) AS n_tokens, CAST(sum(length(raw)) AS BIGINT) AS n_chars, bool_or(kind = 'text' AND regexp_matches(raw, '\\pL')) AS has_letters, bool_or(depth > 0) AS literal FROM m WHERE NOT b GROUP BY doc_id, island""",
    "identity_splice": "SELECT page_id AS doc_id, md5(html) AS html_md5 FROM pages",
    "inline_moves": "SELECT page_id AS doc_id, CAST(0 AS BIGINT) AS n_moved, CAST(CASE WHEN contains(html, '</body>') THEN 1 ELSE 0 END AS BIGINT) AS n_lost FROM pages",
    "overlap_edits": """WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) > 0),
        k AS (SELECT doc_id, n, unnest(range(CAST(n // 37 + 1 AS BIGINT))) AS k FROM d),
        e AS MATERIALIZED (SELECT doc_id, k, k * 61 % n AS s, least(n, k * 61 % n + 4 + k % 9) AS e, row_number() OVER (PARTITION BY doc_id ORDER BY k * 61 % n, -(least(n, k * 61 % n + 4 + k % 9) - k * 61 % n), least(n, k * 61 % n + 4 + k % 9), '[' || k || ']') AS rn FROM k),
        f AS (SELECT doc_id, CAST(0 AS BIGINT) AS rn, CAST(-1 AS BIGINT) AS last, CAST(0 AS BIGINT) AS before, false AS kept, CAST(0 AS BIGINT) AS s, CAST(0 AS BIGINT) AS k FROM d UNION ALL
          SELECT e.doc_id, e.rn, CASE WHEN e.s >= f.last THEN e.e ELSE f.last END, CASE WHEN f.last < 0 THEN 0 ELSE f.last END, e.s >= f.last, e.s, e.k FROM f JOIN e ON e.doc_id = f.doc_id AND e.rn = f.rn + 1),
        p AS (SELECT f.doc_id, rn, last, substring(text, before + 1, s - before) || '[' || k || ']' AS piece FROM f JOIN d ON d.doc_id = f.doc_id WHERE kept)
        SELECT d.doc_id, CAST(count(*) AS INT) AS n_kept, md5(string_agg(piece, '' ORDER BY rn) || substring(any_value(text), max(last) + 1, any_value(n))) AS edited_md5 FROM p JOIN d ON d.doc_id = p.doc_id GROUP BY d.doc_id""",
    "leftover_sentences": f"""WITH f AS (SELECT DISTINCT doc_id, word FROM ({_SPLIT("left(text, CAST(floor(length(text) / 2) AS INT))")}) WHERE word IN {_WORDS} INTERSECT SELECT DISTINCT doc_id, word FROM ({_SPLIT("text")}) WHERE word IN {_WORDS}),
        h AS (SELECT doc_id, left(text, CAST(floor(length(text) / 2) AS INT)) AS html FROM documents SEMI JOIN f USING (doc_id)),
        c AS (SELECT doc_id, CAST(unnest(range(len(ts))) AS INT) AS pos, unnest(ts) AS raw FROM (SELECT doc_id, regexp_extract_all(html, {_Q(_TOKEN)}) AS ts FROM h)),
        o AS (SELECT *, sum(length(raw)) OVER (PARTITION BY doc_id ORDER BY pos) - length(raw) AS pos0 FROM c),
        g AS (SELECT doc_id, pos, pos0, string_split(regexp_replace(raw, '([.;:!?]\\s+)', '\\1' || chr(1), 'g'), chr(1)) AS ss FROM o WHERE raw NOT LIKE '<%'),
        i AS (SELECT doc_id, pos, pos0, unnest(range(len(ss))) AS j, unnest(ss) AS sentence FROM g),
        m AS (SELECT *, pos0 + sum(length(sentence)) OVER (PARTITION BY doc_id, pos ORDER BY j) AS e FROM i),
        w AS (SELECT doc_id, e - length(sentence) AS s, e, sentence, unnest(regexp_split_to_array(lower(sentence), '[^\\pL\\pN_]+')) AS word FROM m)
        SELECT doc_id, CAST(s AS INT) AS "start", CAST(e AS INT) AS "end", min(word) AS word, sentence FROM w SEMI JOIN f USING (doc_id, word) GROUP BY doc_id, s, e, sentence""",
    "judge_stub": f"""WITH {_PAIRS}, n AS (SELECT CAST(doc_id AS VARCHAR) AS rel, {len(client.judge_prompt("", "", dict(dims.DEFAULTS)))} + length(orig) + length(trad) AS n, greatest(length(orig), length(trad)) > {dims.DEFAULTS["check_max_chars"]} AS sampled FROM pairs)
        SELECT rel, CAST(n % 11 AS INT) AS score, 'note' AS comment, sampled FROM n""",
    "interval_units_at": f"""WITH {_OFF}, m AS (SELECT *, {_BOUND} AS b, CAST(sum({_BOUND}::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS idx FROM off),
        u AS (SELECT doc_id, idx, min("start") AS s0, max("end") AS e0 FROM m WHERE NOT b GROUP BY ALL), k AS (SELECT page_id AS doc_id, unnest(range(CAST(length(html) // 100 + 1 AS BIGINT))) AS k FROM pages)
        SELECT DISTINCT u.doc_id, idx FROM u JOIN k ON u.doc_id = k.doc_id AND k * 100 < e0 AND k * 100 + 20 > s0""",
    "verify_tag_counts": f"WITH {_PAIRS} SELECT doc_id, CAST({_COUNT('orig', verify.KEY_TAGS)} AS INT) AS o_tags, CAST({_COUNT('trad', verify.KEY_TAGS)} AS INT) AS t_tags FROM pairs",
    "verify_checks": f"WITH {_CHECKS} SELECT * FROM checks",
    "verify_id_href_multisets": f"WITH {_PAIRS} SELECT doc_id, array_to_string({_VALUES('orig', 'href')}, ' ') AS o_hrefs, array_to_string({_VALUES('trad', 'href')}, ' ') AS t_hrefs, {_VALUES('orig', 'id')} = {_VALUES('trad', 'id')} AS ids FROM pairs",
    "verify_score": f"WITH {_CHECKS} SELECT doc_id, passed, score, reasons FROM scores",
    "book_health": f"WITH {_CHECKS} SELECT doc_id % 10 AS book, count(*) AS checked, count(*) FILTER (passed) AS n_passed, CAST(sum(score) AS BIGINT) AS score_sum FROM scores GROUP BY ALL",
    "failure_causes": f"WITH {_CHECKS} SELECT CASE WHEN regexp_matches(lower(CASE WHEN doc_id % 5 = 0 THEN 'HTTP 507: ' || reasons ELSE reasons END), 'llm|http|unreachable| 507') THEN 'llm-error' ELSE 'quality' END AS cause, count(*) AS n FROM scores WHERE NOT passed GROUP BY ALL",
    "prologue_defects": f"""WITH {_PAIRS}, q AS (SELECT doc_id, regexp_extract(orig, '(?s)^.*?<html\\b[^>]*>') AS a, regexp_extract(CASE WHEN doc_id % 9 = 0 THEN replace(trad, '<!DOCTYPE html>', '') ELSE trad END, '(?s)^.*?<html\\b[^>]*>') AS b FROM pairs)
        SELECT doc_id FROM q WHERE a <> '' AND b <> '' AND regexp_replace(a, {_Q(diff.LANG_VALUE)}, '', 'g') <> regexp_replace(b, {_Q(diff.LANG_VALUE)}, '', 'g')""",
    "attr_defects": f"""WITH {_PAIRS}, e AS (SELECT doc_id, list_filter(regexp_extract_all(orig, {_Q(_TOKEN)}), lambda q: regexp_matches(q, {_Q("^</?[[:space:]]*[A-Za-z]")})) AS o, list_filter(regexp_extract_all(trad, {_Q(_TOKEN)}), lambda q: regexp_matches(q, {_Q("^</?[[:space:]]*[A-Za-z]")})) AS t FROM pairs),
        f AS (SELECT * FROM e WHERE list_transform(o, lambda q: lower(regexp_extract(q, {_Q("^</?[[:space:]]*" + _NAME)}))) = list_transform(t, lambda q: lower(regexp_extract(q, {_Q("^</?[[:space:]]*" + _NAME)})))),
        h AS (SELECT doc_id, CAST(unnest(range(len(o))) AS INT) AS pos, unnest(o) AS x, unnest(t) AS y FROM f),
        i AS (SELECT *, regexp_extract(x, {_Q("(?s)^<" + _NAME + "(.*?)/?>$")}, 1) AS ax, regexp_extract(y, {_Q("(?s)^<" + _NAME + "(.*?)/?>$")}, 1) AS ay FROM h WHERE x <> y AND x NOT LIKE '</%')
        SELECT doc_id, pos, lower(regexp_extract(x, {_Q("^<(" + _NAME + ")")}, 1)) AS name FROM i
        WHERE list_sort(list_filter(regexp_extract_all(ax, {_Q(_ATTR)}), lambda q: NOT regexp_matches(q, '^(xml:)?lang\\s*='))) <> list_sort(list_filter(regexp_extract_all(ay, {_Q(_ATTR)}), lambda q: NOT regexp_matches(q, '^(xml:)?lang\\s*=')))""",
    "content_defects": f"""WITH a AS (SELECT doc_id, {_CLEAN.format("text")} AS o, {_CLEAN.format("CASE doc_id % 3 WHEN 0 THEN left(text, CAST(floor(length(text) * 0.6) AS INT)) WHEN 1 THEN text || ' . . .' ELSE text END")} AS t FROM documents WHERE NOT contains(text, '</p')),
        b AS (SELECT doc_id, 0 AS block_no, CASE WHEN length(o) >= 80 AND length(t) < 0.7 * length(o) THEN 'short_text' WHEN {_COUNT("t", text.ELLIPSIS)} > {_COUNT("o", text.ELLIPSIS)} THEN 'ellipsis' END AS kind, CAST(length(o) AS INT) AS o_len, CAST(length(t) AS INT) AS t_len FROM a)
        SELECT * FROM b WHERE kind IS NOT NULL""",
    "sentences": """WITH a AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS x FROM documents), b AS (SELECT doc_id, list_filter(string_split(regexp_replace(x, '([.;:!?]) ', '\\1' || chr(1), 'g'), chr(1)), lambda q: q <> '') AS s FROM a)
        SELECT doc_id, CAST(unnest(range(len(s))) AS INT) AS sent_no, unnest(s) AS sentence FROM b""",
    "leftover_words": f"""WITH l AS (SELECT doc_id, word, count(*) AS n FROM ({_SPLIT("left(text, CAST(floor(length(text) / 2) AS INT))")}) WHERE word IN {_WORDS} GROUP BY ALL), o AS (SELECT DISTINCT doc_id, word FROM ({_SPLIT("text")}) WHERE word IN {_WORDS})
        SELECT l.doc_id, l.word, n FROM l SEMI JOIN o ON l.doc_id = o.doc_id AND l.word = o.word""",
    "term_frequencies": f"WITH {_FREQ} SELECT word, n FROM freq",
    "near_twins": f"""WITH {_FREQ}, k AS MATERIALIZED (SELECT word, n, left(word, i - 1) || chr(1) || substring(word, i + 1) AS m FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM freq)),
        g AS MATERIALIZED (SELECT m, list({{'w': word, 'n': n}} ORDER BY word) AS ws FROM k GROUP BY m HAVING count(*) > 1),
        a AS (SELECT ws, unnest(range(1, len(ws))) AS i FROM g), b AS (SELECT ws, i, unnest(range(i + 1, len(ws) + 1)) AS j FROM a)
        SELECT ws[i].w AS word_a, ws[j].w AS word_b, ws[i].n AS n_a, ws[j].n AS n_b FROM b""",
    "glossary_defects": f"WITH {_GLOSS} SELECT doc_id, src, dst FROM broken",
    "glossary_violations": f"WITH {_GLOSS} SELECT g.src, count(doc_id) AS n FROM g LEFT JOIN broken b ON g.src = b.src GROUP BY g.src",
    "glossary_conflicts": f"WITH {_GLOSS} SELECT src AS term, min(dst) AS expected, count(DISTINCT source) AS n_files, count(*) AS hits FROM broken GROUP BY src HAVING count(DISTINCT source) > 1",
    "parse_extraction": """WITH w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents WHERE text IS NOT NULL),
        l AS (SELECT doc_id, array_to_string(list_transform(range(CAST((len(w) - 1) // 6 + 1 AS BIGINT)), lambda i: (i + 1) || '. ' || coalesce(w[6 * i + 1], '') || ' | ' || coalesce(w[6 * i + 2], '') || '|' || coalesce(w[6 * i + 3], '') || ' | because' || chr(10) || '- ' || coalesce(w[6 * i + 4], '') || '|x|' || coalesce(w[6 * i + 4], '')), chr(10)) || chr(10) || 'NONE' || chr(10) || '* only|two' AS reply FROM w),
        s AS (SELECT doc_id, regexp_split_to_array(reply, '\\r\\n|\\r|\\n') AS ls FROM l), e AS (SELECT doc_id, CAST(unnest(range(len(ls))) AS INT) AS line_no, regexp_replace(trim(unnest(ls)), '^[-*0-9. ]+', '') AS line FROM s),
        f AS (SELECT doc_id, line_no, list_transform(string_split(line, '|'), lambda q: trim(q)) AS f FROM e)
        SELECT doc_id, line_no, f[1] AS source, f[2] AS current, f[3] AS correct, coalesce(f[4], '') AS reason FROM f
        WHERE len(f) >= 3 AND f[1] <> '' AND f[3] <> '' AND length(f[1]) <= 40 AND length(f[3]) <= 40 AND lower(f[1]) <> lower(f[3])""",
    "parse_judge_report": f"WITH {_REPORT} SELECT doc_id, score, comment, has_issue FROM judged",
    "gate_decisions": f"WITH {_REPORT} SELECT CAST(doc_id AS VARCHAR) AS rel, CASE WHEN score IS NULL THEN 'unjudged' WHEN score < 7 THEN 'retranslate' WHEN has_issue THEN 'polish' ELSE 'keep' END AS action FROM judged",
    "judged_summary": f"WITH {_REPORT} SELECT avg(score) AS avg_score, count(*) FILTER (score < 7) AS n_low FROM judged",
    "sample_thirds": "SELECT doc_id, md5(CASE WHEN length(text) <= 600 THEN text ELSE left(text, 200) || chr(10) || '[…]' || chr(10) || substring(text, CAST(floor((length(text) - 200) / 2) AS INT) + 1, 200) || chr(10) || '[…]' || chr(10) || right(text, 200) END) AS sample_md5 FROM documents WHERE text IS NOT NULL",
    "rewrite_lang": f"SELECT page_id AS doc_id, md5({_lang_sql('html')}) AS html_md5 FROM pages",
    "text_functions": f"""WITH a AS (SELECT doc_id, text, lang, {_FOLD("regexp_split_to_array(text, '[ \\n]')[1]")} AS f FROM documents WHERE text IS NOT NULL)
        SELECT doc_id, {_STEM("f")} AS stem, coalesce(nullif(regexp_replace(regexp_replace(lower(left(text, 40)), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), ''), 'book') AS slug, {_CODES.format("lang")} AS code,
        md5(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(160), '&#160;')) AS encoded_md5,
        md5(replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10), chr(13) || chr(10))) AS crlf_md5,
        CAST({_COUNT("text || '… . . . ...'", text.ELLIPSIS)} AS INT) AS n_ellipses FROM a""",
    "answer_markers": f"""WITH a AS (SELECT doc_id, {_ANSWER} AS x FROM documents WHERE text IS NOT NULL), b AS (SELECT doc_id, x, list_zip(regexp_extract_all(x, {_Q(_MARK)}, 1), regexp_extract_all(x, {_Q(_MARK)}, 2), regexp_extract_all(x, {_Q(_MARK)}, 3)) AS z FROM a)
        SELECT doc_id, array_to_string(list_transform(list_filter(z, lambda q: NOT (q[2] = 'x' AND q[1] = '/')), lambda q: CASE WHEN q[2] = 'x' THEN '<x' || q[3] || '/>' ELSE '<' || q[1] || 'g' || q[3] || '>' END), ' ') AS markers, md5(regexp_replace(x, {_Q(_MARK)}, '', 'g')) AS plain_md5 FROM b""",
    "greedy_batches": """WITH RECURSIVE u AS (SELECT source, doc_id AS idx, CAST(length(text) AS BIGINT) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents),
        f AS (SELECT source, idx, n, rn, 1 AS no, n AS size, 1 AS len FROM u WHERE rn = 1 UNION ALL
          SELECT u.source, u.idx, u.n, u.rn, f.no + (f.size + u.n > 9000 OR f.len >= 12)::INT, CASE WHEN f.size + u.n > 9000 OR f.len >= 12 THEN u.n ELSE f.size + u.n END, CASE WHEN f.size + u.n > 9000 OR f.len >= 12 THEN 1 ELSE f.len + 1 END
          FROM f JOIN u ON u.source = f.source AND u.rn = f.rn + 1)
        SELECT source AS doc_id, idx, CAST(n AS INT) AS n, CAST(no AS INT) AS batch_no FROM f""",
    "outcomes_latest": f"WITH {_LATEST} SELECT rel, idx, orig_hash, status, reason, seq FROM latest",
    "attempts_latest": f"WITH {_LATEST} SELECT rel, idx, attempts FROM tries",
    "unit_status": f"WITH {_LATEST} SELECT rel, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status <> 'ok') AS failed FROM latest GROUP BY ALL",
    "failed_units_topk": f"WITH {_LATEST}, b AS (SELECT l.rel, l.idx, attempts, coalesce(reason, '') AS reason, row_number() OVER (PARTITION BY l.rel ORDER BY l.idx) AS k FROM latest l JOIN tries t ON l.rel = t.rel AND l.idx = t.idx WHERE status <> 'ok') SELECT rel, idx, attempts, reason FROM b WHERE k <= 3",
    "retry_budget": f"""WITH {_LATEST} SELECT rel, idx, attempts, attempts > 2 AS gave_up, CASE WHEN attempts > 2 THEN 0 ELSE greatest(0, 2 - greatest(0, attempts - 1)) END AS "left" FROM tries""",
    "plan_pass": f"""WITH {_PLAN} SELECT rel, pos, 'translate' AS action FROM spine WHERE rel NOT IN (SELECT rel FROM done UNION SELECT rel FROM waiting)
        UNION ALL SELECT rel, pos, 'repair' FROM spine WHERE rel IN (SELECT rel FROM waiting) OR rel IN (SELECT rel FROM done WHERE rel IN (SELECT rel FROM failing))""",
    "requeue_unknown": f"WITH {_PLAN} SELECT CAST(pos * 2 AS VARCHAR) AS rel FROM spine WHERE CAST(pos * 2 AS VARCHAR) NOT IN (SELECT rel FROM spine)",
    "done_state": f"WITH {_LATEST} SELECT rel, bool_and(status = 'ok') AS done, arg_max(reason, seq) FILTER (status <> 'ok') AS reason FROM latest GROUP BY rel",
    "config_precedence": f"""WITH s(layer, key, value) AS (VALUES {", ".join("(" + ", ".join(map(_Q, r)) + ")" for r in SETTINGS)}), k AS (SELECT *, CASE layer WHEN 'defaults' THEN 1 WHEN 'user' THEN 2 WHEN 'book' THEN 3 ELSE 4 END AS r FROM s WHERE value <> '' AND key IN {_IN(tuple(dims.DEFAULTS))}),
        w AS (SELECT key, arg_max(value, r) AS value, arg_max(layer, r) AS layer FROM k GROUP BY ALL) SELECT * FROM w WHERE key <> 'dest_code' UNION ALL SELECT 'dest_code', {_CODES.format("value")}, layer FROM w WHERE key = 'target_lang'""",
    "log_summary": f"WITH {_RECORDS} SELECT count(*) AS attempts, CAST(floor(sum(score) / nullif(count(score), 0)) AS BIGINT) AS avg_score, CAST(sum(coalesce(tok, 0)) AS BIGINT) AS tokens FROM rec",
    "log_models": f"WITH {_RECORDS} SELECT slug, string_agg(DISTINCT model, ',' ORDER BY model) AS models FROM rec GROUP BY ALL",
    "event_log": "SELECT event_type, count(*) AS n, count(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS n_k, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS sum_k FROM events GROUP BY ALL",
    "dropped_units": f"WITH {_LATEST} SELECT rel, idx, orig_hash, 'drop' AS status, CAST(1000000000 AS BIGINT) AS seq FROM latest WHERE rel IN ('src1', 'src2', 'none')",
    "read_original": "SELECT doc_id AS rel, md5(CASE WHEN doc_id % 3 <> 0 AND text IS NOT NULL THEN 'o:' || text ELSE text END) AS orig_md5 FROM documents",
    "books_progress": "WITH d AS (SELECT DISTINCT source AS slug, doc_id AS rel FROM documents) SELECT slug, count(*) AS files, count(*) FILTER (rel % 3 = 0) AS n_done, count(*) FILTER (rel % 7 = 1) AS n_failed FROM d GROUP BY ALL",
    "log_lines": f"WITH {_RECORDS} SELECT concat_ws(' ', '[2020-01-01T00:00:00]', slug || '.xhtml', 'ok', concat_ws(' ', 'score=' || score, 'model=' || model)) AS line FROM rec",
}
