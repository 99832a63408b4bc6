"""License scans with long templates that repeat a phrase, and with phrases and templates of one word."""

from framelake.llm import licenses


def scanned(spark, texts, templates, phrases):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {r["doc_id"]: r for r in licenses.scan(docs, templates, phrases).collect()}


def test_chain_among_many_open_ones(spark):
    parts = [f"a{i} b{i} c{i} d{i}" for i in range(40)]
    template = " of this license ".join(parts)
    # a word in every place breaks the text into short matches, most of which stand at 39 places of the template
    text = " odd of this license odd ".join(parts)
    got = scanned(spark, [template, text, " of this license " * 50], [(template, "long")], [])
    assert [list(got[i]["labels"]) for i in range(3)] == [["long"], ["long"], []]
    assert max(s["covered"] for s in got[1]["spans"]) == 1.0


def test_phrases_and_templates_of_one_word(spark):
    got = scanned(spark, ["x gpl y", "gpl gpl", "mit", "public domain", "public x domain", "none"], [("MIT", "mit"), ("public domain", "pd")], [("gpl", "gpl")])
    assert [(got[i]["n_base"], got[i]["first_word"], list(got[i]["labels"])) for i in range(6)] == [(1, 1, ["gpl"]), (2, 0, ["gpl"]), (0, None, ["mit"]), (0, None, ["pd"]), (0, None, []), (0, None, [])]
    assert [(s["start"], s["end"], s["covered"]) for s in got[3]["spans"]] == [(0, 2, 1.0)]
