from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioforge.functions import html_dom, jsons, office, tables
from folioforge.functions import text as T
from folioforge.operators import split


def test_recursive():
    assert split.recursive("Para1\n\nPara2", 10, 0, ("\n\n",)) == ["Para1", "Para2"]
    assert split.recursive("ABCD", 2, 1, ("",)) == ["AB", "BC", "CD"]


def test_sentences():
    assert len(split.pack_sentences("Sentence one. Sentence two. Sentence three.", 30, 0)) == 2
    assert [len(x) for x in split.pack_sentences("A" * 50, 20, 0)] == [20, 20, 10]
    assert split.pack_sentences("S1. S2. S3. S4.", 8, 4) == ["S1. S2.", "S2. S3.", "S3. S4."]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=80), st.integers(3, 20))
def test_recursive_covers_the_text(text, size):
    chunks = split.recursive(text, size, 0)
    assert "".join("".join(chunks).split()) == "".join(text.split())
    assert all(len(c) <= size for c in chunks)


def test_csv_rows():
    out = split.csv_table("id,name\n1,A\n2,B\n3,C", 2)
    assert [(d["start"], d["end"]) for d in out] == [(0, 2), (2, 3)]
    assert all(d["content"].startswith("id,name\n") for d in out)
    assert len(split.csv_table("a,b\n" + "x" * 50 + ",y", 100, 8)) == 1
    table = tables.parse_csv("1,Apple\n2,Banana\n3,C", ",", first_is_header=False)
    assert table.header == ["Column1", "Column2"] and len(table.rows) == 3


def test_markdown_tables():
    text = "before\n\n| Item | Price |\n|---|---|\n| a | 1 |\n| b | 2 |\n\nafter"
    assert [d["type"] for d in split.markdown_tables(text)] == ["text", "table", "text"]
    assert split.markdown_tables("  raw ")[0]["content"] == "  raw "
    t = tables.parse_markdown("| a | b |\n| --- | --- |\n| 1 | x\\|y |")
    assert t.header == ["a", "b"]
    assert tables.render_markdown(tables.Table(["h"], [["a|b\nc"]])) == "| h |\n| --- |\n| a\\|b<br>c |"


def test_json():
    found = jsons.split('[{"page_content": "x", "metadata": {"it_system": "s", "nested": {"flag": true}}}]')
    assert found[0][1]["json__metadata__nested__flag"] is True
    long = jsons.flat_metadata({"a": "x" * 300})["json__a"]
    assert len(long) == 256 and long.endswith("...")
    assert jsons.select([{"id": 1, "text": "foo"}], "0.text") == (True, "foo")
    assert jsons.select({"a": None}, ".a") == (True, None)
    assert jsons.as_markdown([]) == "## Item 1\n- value: []"


def test_hierarchy():
    out = split.markdown_hierarchy("intro\n# A\nx\n## B\ny\n# C\nz")
    assert [(d["title"], d["level"], d["path"]) for d in out] == [("ROOT", 0, []), ("A", 1, []), ("B", 2, ["A"]), ("C", 1, [])]
    assert split.markdown_hierarchy("# A\nx\n## B\ny", parents=True)[1]["content"] == "# A\nx\n## B\ny"


def test_html():
    html = "<html><body><h1>Main</h1><p>one<p>two <b>x</b><h2>Sub</h2><p>three</p><table><tr><th>a<th>b<tr><td>1<td>2</table></body></html>"
    out = html_dom.split_html(html)
    assert [(d["type"], d["level"], d["path"]) for d in out] == [("text", 1, []), ("text", 2, ["Main"]), ("table", 2, ["Main"])]
    assert out[1]["parent"] == 0
    assert html_dom.to_markdown("<ul><li>a<ul><li>b</ul><li>c</ul>") == "- a\n  - b\n- c"
    assert html_dom.links('<a href="/x#y">t</a><a href="mailto:a">m</a><a href="/x">u</a>', "http://h/a")[0]["url"] == "http://h/x"
    assert html_dom.parse_strict("<html><p>a</p></html>").text() == "a"


def test_office():
    assert office.to_roman(1994) == "MCMXCIV" and office.to_alpha(28) == "ab"
    assert office.heading_level("1.2 Scope of work", 1.0) == 3 and office.heading_level("some text.", 1.0) is None
    blocks = office.sheet_blocks([["note"], [], ["a", "b"], ["1", "2"], [], ["end"]])
    assert [k for k, _ in blocks] == ["text", "table", "text"]
    assert office.clean_doc_text("a\x13 HYPERLINK \x14shown\x15b\x07c\rd") == "ashownb\tc\nd"
    assert office.smartart_bullets({"1": "a", "2": "b"}, [("1", "2")]) == "- a\n  - b"


def test_columns(spark):
    df = spark.createDataFrame([("The cat on the mat", "a CAT sat"), (None, ""), ("", None)], "q string, t string")
    got = df.select(T.overlap(F.col("q"), F.col("t"))).collect()
    assert [r[0] for r in got] == [0.5, 0.0, 0.0]
    v = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([], []), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert [r[0] for r in v.select(T.cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 0.0, 0.0]


def test_semantic_windows(spark):
    rows = spark.createDataFrame([(1, 1, [1.0, 0.0]), (1, 2, [0.0, 1.0]), (1, 3, [1.0, 0.0])], "d int, p int, embedding array<double>")
    one = split.semantic_boundaries(rows, by=["d"], order="p", threshold=0.6, window=1)
    two = split.semantic_boundaries(rows, by=["d"], order="p", threshold=0.6, window=2)
    assert one.select("chunk_id").distinct().count() == 3
    assert two.select("chunk_id").distinct().count() == 1


def test_split_metadata_keeps_blank_lines(spark, tmp_path):
    from folioforge.plans import splits

    texts = ["a\nbc", "a\n\nbc\n\n\na", "\nbc", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in splits.split_metadata(spark, str(tmp_path)).collect())
    assert got == [(0, 0, 0), (0, 1, 2), (1, 0, 0), (1, 1, 3), (1, 2, 8), (2, 0, 1)]
