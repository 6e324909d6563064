"""The registered queries of the training-data operators.

Each is a thin layer: it reads whole tables, calls one operator with its
production parameters and derives the result columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bpe, chat, decontam, mips, pii, quality, secrets, simhash, toxicity, url_filter
from quillspark.llm.common import written
from quillspark.session import spread

VOCABULARY = "byte_bpe_50k.json"
RULES = (
    url_filter.Rule("allow", "org"),
    url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "com", "/de/"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def fold(doc_id: str, folds: int) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def span_list(spans: str, kinds: tuple[str, ...] | None = None) -> Column:
    """``kind:start:end`` of the spans of these kinds (None: all), comma-joined."""
    kept = F.filter(spans, lambda s: s["kind"].isin(*kinds)) if kinds else F.col(spans)
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all page URLs; listed are pages seen with a ``ref=`` tag."""
    pages = table(spark, sf_dir, "pages")
    listed = pages.where(F.col("url").rlike("[?&]ref=")).select(url_filter.canonical_url(F.col("url")).alias("url"))
    return url_filter.judge(pages, listed, RULES).select("page_id", "host", "path", "rule", "verdict", "listed")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and the components of those 2 bits apart."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), max_bits=2, words=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents: pattern spans and the tagger's."""
    found = pii.find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[of_kind("base", k) for k in pii.KINDS], F.sha2(span_list("base"), 256).alias("base_sha256"), span_list("spans").alias("spans"))


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best partners of every fiftieth vector among all others."""
    return mips.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learned from four folds of five."""
    feats = written(quality.features(table(spark, sf_dir, "documents")), "statistics")
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0)
    scored = quality.score(feats, quality.fit(quality.labelled(feats, labels, "quality")))
    held = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents; lexicons mined from two folds of three."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 3) != 1).where("toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("label")).distinct()
    scored = toxicity.score(docs, labels)
    held = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "posterior")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one of control strings, read back from the tree."""
    both = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", both), (-1, 1, "assistant", both)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    layout, pieces, conversations = chat.tree(rows)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = chat.read_back(layout, pieces, conversations)
    digests = read.select("leaf", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
    return chat.told(conversations, digests)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, with the evidence for each pair."""
    found = decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "cosine", "common", "answer")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents; owners are sources, repositories their languages."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.concat_ws("/", "source", "lang").alias("repo"), F.col("source").alias("owner"))
    found = secrets.find(docs)
    live = F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live")
    return found.select("doc_id", *[of_kind("spans", k) for k in secrets.BASE], F.sha2(span_list("spans", secrets.BASE), 256).alias("base_sha256"), span_list("spans").alias("spans"), live)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_simhash": op2_simhash,
    "op3_pii": op3_pii,
    "op4_top_k": op4_top_k,
    "op5_quality": op5_quality,
    "op6_toxicity": op6_toxicity,
    "op7_chat": op7_chat,
    "op8_decontamination": op8_decontamination,
    "op9_secrets": op9_secrets,
    "op10_bpe": op10_bpe,
}
def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _rules_case(what: str) -> str:
    """The first rule that fits, longest first."""
    cases = [f"WHEN (host = '{r.host}' OR host LIKE '%.{r.host}') AND starts_with(path, '{r.path}') THEN '{getattr(r, what)}'" for r in sorted(RULES, key=lambda r: -len(r.text))]
    return f"CASE {' '.join(cases)} END"


_PARTS = _quoted(url_filter.PARTS)
_HOST = f"translate(coalesce(regexp_extract(url, {_PARTS}, 1), ''), '{url_filter.UPPER}', '{url_filter.LOWER}')"
_PATH = f"coalesce(regexp_extract(url, {_PARTS}, 2), '')"


def _escaped_sql(text: str) -> str:
    r"""Backslashes doubled, then ``\.`` after the first sign of each control string."""
    out = f"replace({text}, chr(92), chr(92) || chr(92))"
    for c in ("<|", "</s>", "<s>", "|>", "[INST]", "[/INST]"):
        out = f"replace({out}, {_quoted(c)}, {_quoted(c[0])} || chr(92) || {_quoted('.' + c[1:])})"
    return out


def _matches(kind: str, rank: int, pattern: str, value: int, least: str = "true") -> str:
    """Rows ``(row, kind, rank, s, e, value)`` of the matches of a pattern, from left to right."""
    r = _quoted(pattern)
    return f"""SELECT row, '{kind}' AS kind, {rank} AS rank, s, s + length(m) AS e, v AS value FROM (
        SELECT row, ms[i] AS m, vs[i] AS v, CAST(list_sum(list_transform(gs[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s FROM (
        SELECT row, ms, vs, gs, unnest(range(1, len(ms) + 1)) AS i FROM (
        SELECT row, regexp_extract_all(text, {r}) AS ms, regexp_extract_all(text, {r}, {value}) AS vs, regexp_split_to_array(text, {r}) AS gs FROM d))) WHERE {least}"""


_ENTROPY = "list_sum(list_transform(map_values(list_histogram(string_split(value, ''))), lambda n: -n / length(value) * log2(n / length(value))))"

#: DuckDB SQL where it can express the whole result.
ORACLE_SQL: dict[str, str] = {
    "op1_url_filter": f"""
        WITH p AS (SELECT page_id, url, {_HOST} AS host, {_PATH} AS path FROM pages),
        r AS (SELECT *, {_rules_case("text")} AS rule, {_rules_case("verdict")} AS ruled, host || rtrim(path, '/') AS c FROM p),
        l AS (SELECT DISTINCT c FROM r WHERE regexp_matches(url, '[?&]ref='))
        SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN l.c IS NULL THEN 'allow' ELSE 'block' END) AS verdict, rule IS NULL AND l.c IS NOT NULL AS listed
        FROM r LEFT JOIN l ON r.c = l.c""",
    "op4_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
        k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s)
        SELECT query_id, CAST(r AS INT) AS rank, vec_id, score FROM k WHERE r <= 5""",
    "op7_chat": f"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))),
        e AS (SELECT *, length({_escaped_sql("role")}) + length({_escaped_sql("text")}) + {len(chat.OPEN) + len(chat.MID) + len(chat.END)} AS n FROM c)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
          CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
          sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(n) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op9_secrets": f"""
        WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, concat_ws('/', source, lang) AS repo, source AS owner FROM documents),
        b AS MATERIALIZED ({_matches("assign", 1, secrets.ASSIGN.pattern, 2, "length(v) >= 6")} UNION ALL {_matches("access", 2, secrets.ACCESS.pattern, 0, "length(m) >= 20")}
          UNION ALL {_matches("hex", 3, "[0-9a-f]{24,}", 0)}),
        t AS ({_matches("entropy", 4, secrets.TOKEN.pattern, 0)}),
        h AS (SELECT * FROM t WHERE regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[a-z]') AND {_ENTROPY} >= {secrets.LEAST_ENTROPY}
          AND NOT EXISTS (SELECT 1 FROM b WHERE b.row = t.row AND b.s < t.e AND t.s < b.e)),
        c AS MATERIALIZED (SELECT * FROM b UNION ALL SELECT * FROM h),
        w AS (SELECT value, count(DISTINCT coalesce('r' || repo, '')) AS repos, count(DISTINCT coalesce('o' || owner, '')) AS owners FROM c JOIN d ON c.row = d.row GROUP BY value),
        f AS (SELECT c.*, owners <= 1 AND repos <= 16 AS live, kind || ':' || s || ':' || e AS span FROM c JOIN w ON c.value = w.value WHERE kind <> 'entropy' OR (owners <= 1 AND repos <= 16)),
        g AS (SELECT row, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, count(*) FILTER (live) AS n_live,
          string_agg(span, ',' ORDER BY s, rank) AS spans, string_agg(span, ',' ORDER BY s, rank) FILTER (kind <> 'entropy') AS base FROM f GROUP BY row)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live
        FROM d LEFT JOIN g ON d.row = g.row""",
}
