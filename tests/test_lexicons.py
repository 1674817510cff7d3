"""Vocabularies from files: earlier locales win, absent and broken files are told, and the parser takes what was read."""

from pyspark.sql import functions as F

from wayfind.plans.search import parse_queries
from wayfind.sources import lexicons

FILES = {
    "xx/aliases": '<aliases lang="xx"><concept kind="category" id="BOATS*"><term>Barça</term><term>bote</term></concept><concept kind="brand" id="ACME"/></aliases>',
    "xx/numbers": '<numbers decimal="," thousands="."><multiplier word="mil" factor="1000"/><multiplier word="k" factor="1000"/></numbers>',
    "xx/comparators": "<comparators><op id='gt'><p>mais de</p><p>&gt;</p></op><range><p>entre {a} e {b}</p><p>{a}-{b}</p></range></comparators>",
    "xx/stopwords": "<stopwords><w>de</w><w>DE</w></stopwords>",
    "xx/units": "<units><unit alias='cavalo' canonical='cv'/></units>",
    "en/aliases": '<aliases><concept kind="origin" id="mod"><term>mod</term></concept></aliases>',
    "en/numbers": '<numbers decimal="." thousands=","><multiplier word="k" factor="7"/><spelled word="two" value="2"/></numbers>',
    "en/stopwords": "<stopwords><w>the</w><w>",
    "en/context": "<context><compat><p>works with</p></compat><self><p>this</p></self></context>",
    "common/units": "<units><quantity id='power' specs='power'><unit alias='kw' factor='1'/><unit alias='cv' factor='0.7355'/></quantity><quantity id='money'><unit alias='r$' factor='1'/></quantity></units>",
    "zz/aliases": '<aliases><concept kind="brand" id="NOT ASKED"><term>bote</term></concept></aliases>',
}


def write(folder):
    for name, xml in FILES.items():
        path = folder / f"{name}.xml"
        path.parent.mkdir(exist_ok=True)
        path.write_text('<?xml version="1.0" encoding="utf-8"?>\n' + xml, encoding="utf-8")
    return f"file://{folder}"


def test_files_become_a_lexicon(spark, tmp_path):
    folder = write(tmp_path)
    lex = lexicons.load_lexicon(spark, folder, ("xx", "en"))
    assert lex.aliases == [(("barca",), ("category", "BOATS*")), (("bote",), ("category", "BOATS*")), (("mod",), ("origin", "mod"))]
    assert (lex.decimal, lex.thousands, lex.multipliers, lex.spelled) == (",", ".", {"mil": 1000.0, "k": 1000.0}, {"two": 2.0})
    assert lex.operators == [("gt", ["mais", "de"])] and sorted(lex.ranges) == [["entre", "{a}", "e", "{b}"], ["{a}", "{b}"]]
    assert lex.units == {"kw": ("power", 1.0, "kw"), "cv": ("power", 0.7355, "cv"), "r$": ("money", 1.0, "r$")} and lex.local_units == {"cavalo": "cv"}
    assert (lex.stopwords, lex.compat, lex.selected) == ({"de"}, [("works", "with")], [("this",)])
    q = spark.createDataFrame([(1, "bote de mais de 2 mil cavalo"), (2, "boat")], "query_id long, text string")
    got = {r["query_id"]: r for r in parse_queries(q, lexicon=lex).collect()}
    (c,) = got[1]["constraints"]
    assert [x["value"] for x in got[1]["concepts"]] == ["BOATS*"] and (c["quantity"], c["op"], round(c["low"], 6)) == ("power", "gt", 1471.0)
    assert [t["text"] for t in got[2]["terms"]] == ["boat"] and not got[2]["concepts"]


def test_missing_and_broken_files_are_told_once(spark, tmp_path):
    files = lexicons.read_files(spark, write(tmp_path))
    got = sorted(r["warning"] for r in lexicons.missing(files, ("xx", "en", "xx")).collect())
    assert got == [f"no vocabulary: {x}" for x in ("en/comparators", "en/stopwords", "en/units", "xx/context")]
    assert len(lexicons.missing(files.where("false"), ("en",)).collect()) == 7


def test_first_wins(spark):
    rows = spark.createDataFrame([("a", 1, 0, "x"), ("a", 0, 5, "y"), ("a", 0, 4, None), (None, 2, 0, "z"), ("b", 1, 1, "q"), ("b", 1, 1, "q")], "word string, prio int, n int, meaning string")
    assert {r["word"]: r["meaning"] for r in lexicons.first_wins(rows, "word").collect()} == {"a": None, None: "z", "b": "q"}
    assert lexicons.first_wins(rows.where(F.lit(False)), "word").count() == 0
