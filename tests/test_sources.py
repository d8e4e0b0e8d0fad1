import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from plumbline.plans import QUERIES, ingesting
from plumbline.sources import markup, names, readers, records, tables
from plumbline.sources.delimited import classify_text_tables, detect_delimiter, read_lines
from tests.conftest import rows


@pytest.mark.parametrize(
    "given,want",
    [
        (["100", " 100 ", "name", "name"], ["100", "100_2", "name", "name_2"]),
        (["a", "a_2", "a"], ["a", "a_2", "a_3"]),
        (["", " ", "unnamed", "unnamed_2"], ["unnamed", "unnamed_2", "unnamed_3", "unnamed_2_2"]),
    ],
)
def test_unique_names(given, want):
    assert names.unique_names(given) == want


def test_csv_variants(spark, tmp_path):
    (tmp_path / "semi.csv").write_text("name;name;n\nx;\"a;b\";1\ny;c;2\n")
    df = readers.load_table(spark, str(tmp_path / "semi.csv"))
    assert df.columns == ["name", "name_2", "n"]
    assert rows(df) == [("x", "a;b", 1), ("y", "c", 2)]
    (tmp_path / "west.csv").write_bytes("city,n\nK\xf6ln \u20ac,1\n".encode("cp1252"))
    assert readers.load_table(spark, str(tmp_path / "west.csv")).first()["city"] == "Köln €"
    (tmp_path / "bom.csv").write_bytes(b"\xef\xbb\xbfa,b\n1,2\n")
    assert readers.load_table(spark, str(tmp_path / "bom.csv")).columns == ["a", "b"]
    with pytest.raises(ValueError, match="no reader"):
        readers.load_table(spark, "x.xlsx")


def test_separators_and_text_tables(spark, tmp_path):
    texts = {
        "a.txt": "p|q|r\n1|2|3\n\n4|5|6\n",
        "b.txt": "just a line\nand another, with one comma\n",
        "c.txt": "select 1;\nselect 2;\n",
        "d.txt": "one line, only\n",
        "e.txt": 'k,v\n"x,y",1\nz,2\n',
    }
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    lines = read_lines(spark, str(tmp_path))
    found = {r["file"][-5:]: (r["is_table"], r["sep"], r["reason"]) for r in classify_text_tables(lines).collect()}
    assert found["a.txt"] == (True, "|", None)
    assert found["b.txt"][0] is False and found["b.txt"][2] == "no separator used consistently"
    assert found["c.txt"] == (False, ";", "a column is empty throughout")
    assert found["d.txt"] == (False, ",", "fewer than two lines")
    assert found["e.txt"] == (True, ",", None)
    seps = {r["file"][-5:]: (r["sep"], r["columns"]) for r in detect_delimiter(lines).collect()}
    assert seps["a.txt"] == ("|", 3) and seps["e.txt"] == (",", 2) and seps["c.txt"] == (";", 2)


def test_the_files_of_a_folder_are_judged_as_one_text(spark, tmp_path):
    spark.createDataFrame([(f"{i};{i % 3}" if i < 40 else f"line {i}",) for i in range(41)], "value string").repartition(8).write.text(str(tmp_path / "mixed"))
    spark.createDataFrame([(f"{i};{i % 3}",) for i in range(40)], "value string").repartition(8).write.text(str(tmp_path / "table"))
    judged = classify_text_tables(read_lines(spark, f"{tmp_path}/*", by_folder=True)).collect()
    assert {(r["file"].split("/")[-1], r["is_table"], r["sep"], r["lines"]) for r in judged} == {("mixed", False, None, 41), ("table", True, ";", 40)}


def test_lines_of_a_text_never_meet_in_one_task(spark, tmp_path):
    spark.range(100).select(F.concat_ws(";", "id", "id").alias("value")).write.text(f"{tmp_path}/t")
    judged = classify_text_tables(read_lines(spark, f"{tmp_path}/t", by_folder=True))
    plan = judged._jdf.queryExecution().optimizedPlan().toString()
    assert judged.first()["lines"] == 100
    assert "strategy=broadcast" in plan


def test_texts_to_classify_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(i, f"text {i}\nsecond") for i in range(40)], "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, f"c{i}") for i in range(5)], "c_custkey long, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    monkeypatch.setattr(ingesting, "_out", lambda t, name: f"{tmp_path}/{name}")
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")
    try:
        found = rows(QUERIES["s4_classify_text_tables"](spark, str(tmp_path)))
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert found == [("customer", True, ";", 5), ("texts", False, None, 80)]
    assert len(list((tmp_path / "texts" / "texts").glob("part-*"))) > 1


@pytest.mark.parametrize(
    "text,want",
    [
        ('[{"a": 1, "b": {"c": 2}}, {"a": 3}]', {(1, 2), (3, None)}),
        ('{"meta": 1, "rows": [{"a": 1, "b": 2}, {"a": 3, "b": 4}]}', {(1, 2), (3, 4)}),
        ('{"a": [1, 3], "b": [2, 4]}', {(1, 2), (3, 4)}),
        ('{"a": 1, "b": 2}', {(1, 2)}),
    ],
)
def test_json_shapes(spark, tmp_path, text, want):
    (tmp_path / "x.json").write_text(text)
    assert set(map(tuple, readers.load_table(spark, str(tmp_path / "x.json")).collect())) == want


def test_json_ambiguity_and_lists_in_records(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"p": [{"a": 1}], "q": [{"a": 2}]}')
    with pytest.raises(ValueError, match="ambiguous"):
        readers.load_table(spark, str(tmp_path / "x.json"))
    (tmp_path / "y.json").write_text('[{"a": 1, "t": ["u", "v"]}, {"a": 2, "t": []}]')
    assert rows(readers.load_table(spark, str(tmp_path / "y.json"))) == [(1, '["u","v"]'), (2, "[]")]


def test_jsonl(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1, "b": {"c": "x"}}\n{"a": 2}\n')
    df = readers.load_table(spark, str(tmp_path / "x.jsonl"), max_rows=5)
    assert df.columns == ["a", "b.c"] and rows(df) == [(1, "x"), (2, None)]


def test_xml(spark, tmp_path):
    (tmp_path / "x.xml").write_text(
        "<rows><item id='7'><name>n</name><tag>a</tag><tag>b</tag><place><city>c</city></place></item>"
        "<item id='8'><name lang='de'>m</name><tag>z</tag></item></rows>"
    )
    df = readers.load_table(spark, str(tmp_path / "x.xml"), row_tag="item")
    got = [r.asDict() for r in df.orderBy("`item@id`").collect()]
    assert got[0]["item@id"] == "7" and got[0]["tag_1"] == "a" and got[0]["tag_2"] == "b" and got[0]["place_city"] == "c"
    assert got[1]["tag"] == "z" and got[1]["name"] == "m" and got[1]["name@lang"] == "de"
    assert got[0]["tag"] is None
    (tmp_path / "bad.xml").write_text('<!DOCTYPE a [<!ENTITY x "y">]><a><b>1</b></a>')
    with pytest.raises(ValueError, match="DTD"):
        readers.load_table(spark, str(tmp_path / "bad.xml"))


def test_xml_row_tag_is_found(spark, tmp_path):
    (tmp_path / "x.xml").write_text("<?xml version='1.0'?>\n<all>\n<r><a>1</a></r>\n<r><a>2</a></r></all>")
    assert rows(readers.load_table(spark, str(tmp_path / "x.xml"))) == [("1",), ("2",)]


@pytest.mark.parametrize(
    "html,status,table",
    [
        ("<p>none</p>", "no table", []),
        ("<table><tr><td rowspan=2>a</td></tr><tr><td>b</td></tr></table>", "rowspan", []),
        ("<table><tr><th>a</th></tr></table>", "no table", []),
        (
            "<table><tr><th>h</th><th>h</th></tr><tr><td colspan='2'>x  y</td><td>z</td></tr><tr><td>w</td></tr></table>",
            "ok",
            [["h", "h_2", "column_2"], ["x y", "", "z"], ["w", "", ""]],
        ),
    ],
)
def test_html_tables(html, status, table):
    assert markup.largest_table(html) == (status, table)


def test_plain_pages_are_read_by_a_pattern_as_by_the_parser(monkeypatch):
    r = random.Random(7)
    cells = ["<td>", "<td colspan=2>", "<TD class='x y' rowspan=1>", '<th\tcolspan=" 3 ">', "<td colspan=2 colspan=0>"]
    odd = ["&amp;", "<br/>", "<!-- <td> -->", "a < b", "<td colspan>", "<script>", "</td x>", "<td\xa0>"]
    plain = ["<table>", "</table>", "<tr>", "</tr>", "</td>", "</th >", "<b>", "x", " é\n", "1 > 2", *cells]
    pages = ["".join(r.choices(plain + odd * (i % 2), k=r.randrange(40))) for i in range(2000)]
    pages += ["<table><tr>" + "".join(r.choices(cells, k=3)) + "x</td></tr><tr><td>y</td></tr></table>" for _ in range(50)]

    def closed(page):
        return page.rowspan, page.marks, [c for c, m in zip(page.cells, zip(page.marks, [*page.marks[1:], ""])) if m == ("D", "d")]

    for page in pages:
        ours, parser = markup._Marks(), markup._Marks()
        ours.read(page)
        parser.feed(page)
        assert closed(ours) == closed(parser), page

    def slow(*_):
        raise AssertionError("a plain page needs neither the parser nor pandas")

    monkeypatch.setattr(markup._Marks, "feed", slow)
    monkeypatch.setattr(markup.pd, "Series", slow)
    assert markup.largest_table("<table><tr><th>h</th><th>h</th></tr><tr><td colspan=2>x</td></tr></table>") == ("ok", [["h", "h_2"], ["x", ""]])


def test_merge_keeps_data_columns(spark):
    a = spark.createDataFrame([("oak", 31)], "tree string, height long")
    b = spark.createDataFrame([("elm", 4)], "tree string, rings long")
    merged = tables.merge_sources([("north.csv", a), ("south.csv", b)])
    assert merged.columns == ["source_file", "tree", "height", "rings"]
    assert rows(merged) == [("north.csv", "oak", 31, None), ("south.csv", "elm", None, 4)]
    taken = spark.createDataFrame([("x", 1)], "source_file string, rings long")
    assert tables.merge_sources([("f", taken)]).columns[0] == "uploaded_file"
    assert tables.provenance_name(["source_file", "uploaded_file", "source_file_2"]) == "source_file_3"
    with pytest.raises(ValueError):
        tables.merge_sources([])


def test_formula_guard(spark):
    cells = ["=B7*2", "plain", "-8", "+2.5e4", " @y", "\ty", "  ", "", "-7q", "-inf", None, " \ty", "-", "--3"]
    want = ["'=B7*2", "plain", "-8", "+2.5e4", "' @y", "'\ty", "  ", "", "'-7q", "-inf", None, " \ty", "'-", "'--3"]
    df = spark.createDataFrame(list(enumerate(cells)), "i int, `=c` string")
    out = tables.sanitize_for_csv(df)
    assert out.columns == ["i", "'=c"]
    assert [r[1] for r in out.orderBy("i").collect()] == want


def test_fingerprint_ignores_order_only(spark):
    df = spark.range(50).select("id", (F.col("id") * 2).alias("v"))

    def mark(d):
        return tables.fingerprint(d).first()["fingerprint"]

    assert mark(df) == mark(df.orderBy(F.desc("id")).repartition(3))
    assert mark(df) != mark(df.withColumnRenamed("v", "w"))
    assert mark(df) != mark(df.withColumn("v", F.when(F.col("id") != 7, F.col("v"))))
    assert mark(df) != mark(df.withColumn("v", F.col("v").cast("int")))
    assert mark(df) != mark(df.union(df))


def test_nested_cells_are_ordered_json(spark):
    df = spark.sql("SELECT map('b', 1, 'a', 2) AS m, named_struct('z', array(1, 2), 'a', map('k', null)) AS s")
    assert names.serialize_nested(df).first() == ('{"a":2,"b":1}', '{"a":{"k":null},"z":[1,2]}')


def test_catalog(spark):
    tables.save_table(spark.range(10), "kept_table")
    spark.range(3).createOrReplaceTempView("seen_view")
    listed = {r["name"]: r for r in tables.list_tables_with_files(spark).collect()}
    assert listed["kept_table"]["files"] >= 1 and listed["kept_table"]["bytes"] > 0 and listed["kept_table"]["modified"]
    assert listed["seen_view"]["temporary"]
    tables.drop_table(spark, "kept_table")
    assert not spark.catalog.tableExists("kept_table")


def test_pasted_text(spark):
    df = spark.createDataFrame([("1;a",), ("2;b",)], "line string")
    assert rows(readers.parse_delimited_text(df, "line", "n int, s string", ";")) == [(1, "a"), (2, "b")]


def test_line_breaks_in_quoted_cells(spark, tmp_path):
    texts = ["one\ntwo", 'say "hi"\n\nthere', " blanks ", "a,b", "", "last"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    tables.write_csv(df, str(tmp_path / "t.csv"), safe=False)
    got = readers.load_table(spark, str(tmp_path / "t.csv"))
    assert got.dtypes == [("i", "bigint"), ("t", "string")] or got.dtypes == [("i", "int"), ("t", "string")]
    assert sorted((r["i"], r["t"] or "") for r in got.collect()) == list(enumerate(texts))


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_quoted_line_breaks_over_many_blocks(spark, tmp_path, end):
    rng = random.Random(5)
    parts = ["a", "b", ",", '"', "\n", "\n\n", " z", 'x"y']
    table = [[i, *("".join(rng.choices(parts, k=900 if i % 89 == k else rng.choice([1, 4, 9]))) for k in range(2))] for i in range(400)]
    text = io.StringIO()
    csv.writer(text, lineterminator="\n").writerows([["n", "one", "two"], *table, [400, "," * 60_000 + '"' * 60_000, "end"]])
    path = tmp_path / "broken.csv"
    path.write_bytes(text.getvalue().replace("\n", end).encode())
    want = list(csv.reader(io.StringIO(path.read_bytes().decode(), newline="")))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        found = records.quoted_records(spark, str(path), ",").orderBy("block", "line_id").collect()
        loaded = readers.load_table(spark, str(path))
        got = {r["n"]: [r["one"] or "", r["two"] or ""] for r in loaded.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len({r["block"] for r in found}) > 5
    assert [next(csv.reader(io.StringIO(r["record"], newline=""))) for r in found] == want
    assert loaded.columns == ["n", "one", "two"] and len(got) == loaded.count() == len(want) - 1
    assert got == {int(n): cells for n, *cells in want[1:]}


def test_lines_of_broken_records_are_scanned_once(spark, tmp_path):
    path = tmp_path / "once.csv"
    path.write_text('n,t\n1,"a\nb"\n2,c\n')
    found = records.quoted_records(spark, str(path), ",")
    # neither the chained lines nor the table go back to the file
    assert all(f.endswith(".parquet") for f in found.inputFiles()) and found.count() == 3
    loaded = readers.load_table(spark, str(path))
    assert all(f.endswith(".parquet") for f in loaded.inputFiles())
    assert sorted(map(tuple, loaded.collect())) == [(1, "a\nb"), (2, "c")]


def test_files_with_other_headers_join_by_name(spark, tmp_path):
    folder = tmp_path / "many.csv"
    folder.mkdir()
    (folder / "one file.csv").write_text("x,y\n1,2\n")
    (folder / "two.csv").write_text("y,x\n20,10\n")
    (folder / "three.csv").write_text("x,z\n100,7\n")
    got = readers.load_table(spark, str(folder)).select("x", "y", "z")
    assert sorted(map(tuple, got.collect())) == [(1, 2, None), (10, 20, None), (100, None, 7)]


def test_prose_is_no_table(spark, tmp_path):
    (tmp_path / "prose.txt").write_text("Once upon a time.\nThere was, so they say, a king.\n")
    with pytest.raises(ValueError, match="not a table: prose.txt"):
        readers.load_table(spark, str(tmp_path / "prose.txt"))
    (tmp_path / "table.txt").write_text("a;b\n1;2\n3;4\n")
    assert rows(readers.load_table(spark, str(tmp_path / "table.txt"))) == [(1, 2), (3, 4)]


def test_every_child_of_the_xml_root_is_a_record(spark, tmp_path):
    (tmp_path / "x.xml").write_text("<?xml version='1.0' encoding='utf-8'?><all><item><a>1</a></item><other><b>2</b></other><item><a>3</a></item></all>")
    got = readers.load_table(spark, str(tmp_path / "x.xml")).select("a", "b")
    assert sorted(map(tuple, got.collect()), key=repr) == [("1", None), ("3", None), (None, "2")]


def test_html_files(spark, tmp_path):
    (tmp_path / "p.html").write_text("<table><tr><th>a<th>b</tr></table><table><tr><th>k</th><th>v</th></tr><tr><td>x</td><td>1</td></tr></table>")
    assert rows(readers.load_table(spark, str(tmp_path / "p.html"))) == [("x", "1")]
    (tmp_path / "none.htm").write_text("<p>nothing</p>")
    with pytest.raises(ValueError, match="no table"):
        readers.load_table(spark, str(tmp_path / "none.htm"))


@pytest.mark.parametrize(
    "text,want",
    [
        ('[{"a": 1}, {"a": 2}]', [(1,), (2,)]),
        ('{"rows": [{"a": 1}, {"a": 2}]}', [(1,), (2,)]),
        ('{"a": [1, 2]}', [(1,), (2,)]),
        ('{"a": 5}', [(5,)]),
    ],
)
def test_json_files_of_every_shape(spark, tmp_path, text, want):
    (tmp_path / "d.json").write_text(text)
    assert rows(readers.load_table(spark, str(tmp_path / "d.json"))) == want


def test_signatures_of_files_of_many_blocks(spark, tmp_path):
    import hashlib
    import random

    r = random.Random(3)
    long = r.randbytes(10_000)
    files = {"a.bin": long, "b b%20.bin": long, "changed.bin": long[:-1] + b"?", "short": b"x", "short2": b"x", "even": long[:2048]}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "empty").write_bytes(b"")

    def plain(data):
        if len(data) <= 1024:
            return hashlib.sha256(data).hexdigest()
        parts = [hashlib.sha256(data[i : i + 1024]).hexdigest() for i in range(0, len(data), 1024)]
        return hashlib.sha256("".join(parts).encode()).hexdigest()

    got = tables.file_signatures(spark, str(tmp_path), block=1024)
    found = {r["name"]: (r["size"], r["sha256"], r["copies"]) for r in got.collect()}
    signs = [plain(d) for d in files.values()]
    assert found == {n: (len(d), plain(d), signs.count(plain(d))) for n, d in files.items()}
    whole = {r["name"]: r["sha256"] for r in tables.file_signatures(spark, str(tmp_path)).collect()}
    assert whole == {n: hashlib.sha256(d).hexdigest() for n, d in files.items()}
    listed = spark.read.format("binaryFile").load(str(tmp_path)).selectExpr("path", "length as size")
    blocks = tables.block_hashes(listed, 1024)
    assert blocks.rdd.getNumPartitions() == sum(max(1, -(-len(d) // 1024)) for d in files.values())
    assert tables.block_hashes(listed.limit(0), 1024).count() == 0
    empty = spark.createDataFrame([(str(tmp_path / "empty"), 0)], "path string, size long")
    assert [tuple(r) for r in tables.block_hashes(empty).select("piece", "hash").collect()] == [(0, hashlib.sha256().hexdigest())]
    with pytest.raises(ValueError, match="at least one byte"):
        tables.block_hashes(listed, 0)


def test_extract_in_ranges_of_a_column():
    got = readers.extract_options("select * from t", "id", (1, 900), 8)
    assert got == {"dbtable": "(select * from t) extract_rows", "partitionColumn": "id", "lowerBound": "1", "upperBound": "900", "numPartitions": "8"}
    for bounds, parts in (((None, None), 8), ((4, 4), 8), ((1, 9), 1)):
        assert readers.extract_options("select 1", "id", bounds, parts) == {"dbtable": "(select 1) extract_rows"}
    import datetime as dt

    timed = readers.extract_options("select 1", "at", (dt.datetime(2024, 1, 1), dt.datetime(2024, 3, 1, 12, 30)), 4)
    assert (timed["lowerBound"], timed["upperBound"]) == ("2024-01-01 00:00:00", "2024-03-01 12:30:00")


def test_extract_over_views_ignores_the_split(spark):
    spark.range(10).createOrReplaceTempView("ten_rows")
    assert readers.sql_extract(spark, "SELECT id FROM ten_rows WHERE id > 3;", split_by="id").count() == 6
