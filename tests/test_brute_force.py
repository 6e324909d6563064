"""Queries that SQL can't express, executed and held against plain versions."""

import html as entities
import os
import re
from xml.dom import minidom
from xml.parsers.expat import ExpatError

import pytest

from quillspark.operators import pairs as paired
from quillspark.queries import QUERIES

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
MARK = re.compile(r"</?g\d+>|<x\d+/>")


@pytest.fixture(scope="module")
def pages(spark):
    return {r["page_id"]: r["html"] for r in spark.read.parquet(f"{DIR}/pages.parquet").collect()}


@pytest.fixture(scope="module")
def both(spark):
    return {r["doc_id"]: (r["orig"], r["trad"]) for r in paired.pairs(spark.read.parquet(f"{DIR}/pages.parquet")).collect()}


@pytest.fixture(scope="module")
def units(spark):
    return QUERIES["units_protected"](spark, DIR).collect()


def flat(text):
    return " ".join(entities.unescape(text).replace("\r", " ").replace("\n", " ").split())


def test_units(spark, pages, units):
    islands = QUERIES["unit_islands"](spark, DIR).where("has_letters and not literal").groupBy("doc_id").count().collect()
    per_page = {}
    for u in units:
        per_page.setdefault(u["doc_id"], []).append(u)
    assert {r["doc_id"]: r["count"] for r in islands} == {d: len(us) for d, us in per_page.items()}
    for d, us in per_page.items():
        us.sort(key=lambda u: u["idx"])
        assert [u["idx"] for u in us] == list(range(len(us)))
        assert all(a["end"] <= b["start"] for a, b in zip(us, us[1:]))
        for u in us:
            raw = pages[d][u["start"] : u["end"]]
            assert raw.startswith(u["lead"]) and raw.endswith(u["trail"])
            inner = raw[len(u["lead"]) : len(raw) - len(u["trail"])]
            markers = MARK.findall(u["visible"])
            assert markers == [r["marker"] for r in u["runs"]]
            # markup for its placeholder, in order, is the source again but for entities and line breaks
            back, rest = "", inner
            for text, run in zip(MARK.split(u["visible"]), [*u["runs"], None], strict=True):
                at = rest.index(run["raw"]) if run and run["raw"] else len(rest) if run is None else 0
                assert flat(rest[:at]) == flat(text.replace("&", "&amp;"))
                back, rest = back + rest[:at] + (run["raw"] if run else ""), rest[at + len(run["raw"]) :] if run else ""
            assert back == inner


def test_unit_stats(spark, units):
    want = {}
    for u in units:
        n = want.setdefault(u["doc_id"], [0, 0, 0])
        n[0], n[1], n[2] = n[0] + 1, n[1] + len(u["visible"]), n[2] + len(u["runs"])
    assert {r["doc_id"]: [r["n_units"], r["n_chars"], r["n_placeholders"]] for r in QUERIES["unit_stats"](spark, DIR).collect()} == want


def formed(text):
    try:
        minidom.parseString(text.encode())
    except ExpatError:
        return False
    return True


def test_well_formed(spark, both):
    rows = QUERIES["verify_xhtml"](spark, DIR).collect()
    assert {r["doc_id"]: r["xhtml"] for r in rows} == {d: formed(t) for d, (_, t) in both.items()}
    assert all((r["error"] is None) == r["xhtml"] for r in rows)


def shape(text):
    """Tags without the language, and where there is text."""
    toks = re.findall(r"<[^>]*>|[^<]+", text)
    return [re.sub(r'\s(?:xml:)?lang="[^"]*"', "", t) if t.startswith("<") else "#" for t in toks if t.startswith("<") or t.strip()]


def test_defects_and_blame(spark, both):
    rows = QUERIES["struct_diff"](spark, DIR).collect()
    found = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["seq"])):
        found.setdefault(r["doc_id"], []).append(r)
    tags = {d: [x for x in shape(o) if x != "#"] == [x for x in shape(t) if x != "#"] for d, (o, t) in both.items()}
    for d, (orig, trad) in both.items():
        mine = found.get(d, [])
        assert [r["seq"] for r in mine] == list(range(len(mine)))
        kinds = {r["kind"] for r in mine}
        if not tags[d]:  # structure or attributes changed: something is reported
            assert kinds - {"ellipsis", "short_text", "glossary"}, d
        else:
            assert not kinds & {"missing_block", "missing_tag", "extra_tag", "wrong_tag", "attr"}, (d, kinds)
        assert ("ellipsis" in kinds) == (trad.count("…") > orig.count("…") and tags[d] or "ellipsis" in kinds and not tags[d])
        assert all(r["trad_start"] is None or 0 <= r["trad_start"] <= r["trad_end"] <= len(trad) for r in mine)
    blamed = {}
    for r in QUERIES["blamed_units"](spark, DIR).collect():
        blamed.setdefault(r["doc_id"], {})[r["idx"]] = r["reason"]
    assert set(blamed) <= set(found)
    assert all(reason in {r["detail"] for r in found[d]} for d, us in blamed.items() for reason in us.values())


def test_full_verification(spark, both):
    plain = {r["doc_id"]: r.asDict() for r in QUERIES["verify_checks"](spark, DIR).collect()}
    details = {}
    for r in sorted(QUERIES["struct_diff"](spark, DIR).collect(), key=lambda r: (r["doc_id"], r["seq"])):
        details.setdefault(r["doc_id"], []).append(r["detail"])
    names = ("tags", "code", "pagebreak", "ids", "hrefs", "lang", "length")
    rows = QUERIES["verify_full"](spark, DIR).collect()
    assert {r["doc_id"] for r in rows} == set(both)
    for r in rows:
        d = r["doc_id"]
        ok = {"xhtml": formed(both[d][1]), **{n: plain[d][n] for n in names}, "struct": d not in details}
        assert r["xhtml"] == ok["xhtml"] and r["struct"] == ok["struct"] and r["passed"] == all(ok.values())
        assert r["score"] == round(100 * sum(ok.values()) / 9)
        assert r["reasons"] == ";".join(n for n, good in ok.items() if not good)
        assert r["struct_reason"] == ("; ".join(details[d][:3]) if d in details else None)


def test_translations(spark, units):
    rows = {(r["rel"], r["idx"]): r for r in QUERIES["translate_stub"](spark, DIR).collect()}
    assert set(rows) == {(str(u["doc_id"]), u["idx"]) for u in units}
    for u in units:
        r = rows[str(u["doc_id"]), u["idx"]]
        upper = [t.upper() for t in MARK.split(u["visible"])]
        want = "".join(t.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace("\xa0", "&#160;") + m for t, m in zip(upper, [*(x["raw"] for x in u["runs"]), ""], strict=True))
        if r["status"] == "ok":
            assert r["inner"] == want.strip() and not r["reason"]
        else:
            assert r["inner"] is None and r["reason"]
    got = QUERIES["measured_units"](spark, DIR).first()
    assert got["units"] == len(units) and got["chars"] == sum(len(MARK.sub("", u["visible"])) for u in units)
    assert got["final"] == pytest.approx(sum(r["status"] == "ok" for r in rows.values()) / len(rows))
