"""Settings and glossaries from TOML, JSON lines from logs.

The TOML is the subset that settings need: tables, strings, arrays of strings,
prose in triple quotes, comments.  Every scalar stays the string it is written
as, escapes included, until something asks for a number.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "ts string, slug string, file string, status string, model string, score int, units int, prompt_tokens bigint, completion_tokens bigint"
ITEM = re.compile(r"""\#[^\n]*|"([^"]*)"|'([^']*)'|([^\s,"'\#]+)""")
ENTRY = re.compile(
    r"""(?ms)^[ \t]*(?:\[[ \t]*(?P<table>[^\]\[="\n]+?)[ \t]*\][ \t]*(?:\#[^\n]*)?$
    |(?P<key>"[^"\n]*"|'[^'\n]*'|[^\s=\#\["'][^=\#\n]*?)[ \t]*=[ \t]*
    (?:\"{3}\n?(?P<prose>.*?)\n?\"{3}|\[(?P<array>(?:"[^"]*"|'[^']*'|\#[^\n]*|[^\]"'\#])*)\]|(?P<quote>["'])(?P<string>[^\n]*?)(?P=quote)|(?P<bare>[^\#\n]*)))""",
    re.X,
)


def toml(text: str) -> dict:
    """Tables of strings, arrays of strings and further tables' entries by name."""
    data: dict = {}
    table = data
    for m in ENTRY.finditer(text):
        if m["table"]:
            table = data.setdefault(m["table"], {})
            continue
        key = m["key"][1:-1] if m["key"][0] in "\"'" else m["key"]
        if m["array"] is not None:
            table[key] = [next(filter(None, x.groups()), "") for x in ITEM.finditer(m["array"]) if not x[0].startswith("#")]
        else:
            table[key] = next((m[kind] for kind in ("prose", "string") if m[kind] is not None), (m["bare"] or "").strip())
    return data


def settings(layer: str, text: str) -> list[tuple[str, str, str]]:
    """``(layer, key, value)`` of every entry in a TOML text; tables are flattened, arrays are JSON."""
    out = []

    def walk(table: dict) -> None:
        for k, v in table.items():
            walk(v) if isinstance(v, dict) else out.append((layer, k, json.dumps(v, ensure_ascii=False) if isinstance(v, list) else v))

    walk(toml(text))
    return out


def glossary(text: str) -> tuple[dict[str, str], dict[str, list[str]], str]:
    """Terms, exception phrases by term, and free notes; empty pairs are dropped."""
    data = toml(text)
    return {s: d for s, d in data.get("terms", {}).items() if s and d}, dict(data.get("exceptions", {})), str(data.get("notes", ""))


def glossary_text(terms: dict[str, str], exceptions: dict[str, list[str]], notes: str) -> str:
    """The inverse of :func:`glossary`, terms sorted; double quotes within become typographic where single ones are there too."""

    def quote(s: str) -> str:
        if '"' in s and "'" in s:
            s = re.sub('"([^"]*)"?', "“\\1”", s)
        return f"'{s}'" if '"' in s else f'"{s}"'

    out = [f'notes = \"\"\"\n{notes}\n\"\"\"'] if notes else []
    out += ["[terms]", *(f"{quote(s)} = {quote(d)}" for s, d in sorted(terms.items()))]
    if exceptions:
        out += ["[exceptions]", *(f"{quote(s)} = [{', '.join(map(quote, p))}]" for s, p in sorted(exceptions.items()))]
    return "\n".join(out) + "\n"


def glossary_table(spark: SparkSession, terms: dict[str, str], exceptions: dict[str, list[str]] | None = None) -> DataFrame:
    """``(src, dst, phrases)``: what :func:`quillspark.operators.terms.broken` asks for."""
    rows = [(s, d, list((exceptions or {}).get(s, ()))) for s, d in sorted(terms.items())]
    return spark.createDataFrame(rows, "src string, dst string, phrases array<string>")


def records(spark: SparkSession, path: str, schema: str = RECORD) -> DataFrame:
    """Log records; malformed lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def parsed(lines: DataFrame, col: str, schema: str) -> DataFrame:
    """JSON in a column as fields; malformed ones become nulls."""
    return lines.withColumn("r", F.from_json(col, schema)).select(*[c for c in lines.columns if c != col], "r.*")
