"""Corpus operators on inputs whose whole result an older version cut."""

import random
import string

import pytest

from sonagrid.llm import htmltext, secrets


def key(seed, n):
    return "".join(random.Random(seed).choices(string.ascii_letters + string.digits, k=n))


@pytest.mark.parametrize("n", [40, 64, 90])
def test_single_key_is_found(spark, n):
    """One key, alone and among words and names that are no secrets."""
    one = [(0, f"see {key(n, n)} there")]
    r = random.Random(4)
    words = ["international", "document", "quick", "representation", "brown", "characteristic", "element", "configuration"]
    plain = [(i, f"{''.join(r.choices(words, k=3))} and {'_'.join(r.choices(words, k=4))} or {''.join(w.title() for w in r.choices(words, k=3))}") for i in range(1, 400)]
    for rows in (one, one + plain):
        table = spark.createDataFrame(rows, "doc_id long, text string")
        spans = {g["doc_id"]: [(s["start"], s["kind"], s["end"]) for s in g["spans"]] for g in secrets.find_secrets(table).collect()}
        assert spans[0] == [(4, 3, 4 + n)]
        assert sum(map(len, spans.values())) <= 1 + 0.02 * len(plain)
        assert {x["doc_id"]: x["text"] for x in secrets.redact(table).collect()}[0] == "see [SECRET] there"


def test_words_are_not_reported(spark):
    rows = [(i, " ".join(["theinternationalrepresentation", "another_ordinary_name_of_a_thing"])) for i in range(50)]
    assert all(not g["spans"] for g in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect())


LINE = "A paragraph of the article with quite enough words in it to be taken for its content, number"


@pytest.mark.parametrize("wrap", ["<div id=content>{}</div>", "{}"])
def test_article_split_over_siblings(wrap):
    """85 and 15 percent of the article in two divs, without article or main around them."""
    parts = [f"{LINE} {i}." for i in range(20)]
    html = "<ul><li><a>x</a></li></ul>" + wrap.format("<div><h2>Top</h2>" + "".join(f"<p>{t}</p>" for t in parts[:17]) + "</div><div>" + "".join(f"<p>{t}</p>" for t in parts[17:]) + "</div>")
    assert htmltext.extract(f"<body>{html}</body>") == " ".join(["Top", *parts])


def test_short_lines_of_the_main_region_stay():
    parts = [f"{LINE} {i}." for i in range(20)]
    main = "<div>" + "".join(f"<p>{t}</p>" for t in parts[3:]) + "".join(f"<p>{t}</p>" for t in "abcde") + "</div>"
    html = "<div>" + "".join(f"<p>{t}</p>" for t in parts[:3]) + "</div>" + main
    assert htmltext.extract(f"<body>{html}</body>") == " ".join([*parts, *"abcde"])


def test_split_article_keeps_its_short_end():
    parts = [f"{LINE} {i}." for i in range(20)]
    div = lambda x: "<div>" + "".join(f"<p>{t}</p>" for t in x) + "</div>"
    assert htmltext.extract(f"<body>{div(parts[:17])}{div([*parts[17:], *'abcd'])}<div><a>z</a></div></body>") == " ".join([*parts, *"abcd"])
