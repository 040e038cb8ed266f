import csv
import random

import pytest
from pyspark.sql import functions as F

from tablewright.operators.ddl import SqlScript
from tablewright.sinks.files import report_document, write_csv, write_json, write_report, write_sql
from tablewright.sources import sqldump
from tablewright.sources.delimited import detect_separator, read_delimited
from tablewright.sources.files import list_files, read_any
from tablewright.sources.nested import read_json, read_xml
from tablewright.sources.sqldump import read_sql_dump
from tablewright.sources.texttables import table_from_text, table_lines


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_detect_separator():
    assert detect_separator("a,b;c") == "," and detect_separator("a;b;c,d") == ";" and detect_separator("a") == ","
    assert detect_separator("a|b|c") == "|" and detect_separator("a\tb") == "\t"


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_delimited(spark, tmp_path, sep):
    text = "\n".join(sep.join(r) for r in [("id", "name", "note"), ("1", f'"x{sep}y"', "NA"), ("2", '"say ""hi"""', ""), ("3", "NULL", "n/a")])
    df = read_any(spark, put(tmp_path / "a.csv", text))
    assert df.columns == ["id", "name", "note"] and dict(df.dtypes)["id"] == "bigint"
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, f"x{sep}y", None), (2, 'say "hi"', None), (3, None, None)]


def test_tab_files(spark, tmp_path):
    for name in ("a.tsv", "a.txt"):
        df = read_any(spark, put(tmp_path / name, "a,b\tc\n1,2\t3.5\n"))
        assert df.columns == ["a,b", "c"] and tuple(df.first()) == ("1,2", 3.5)


@pytest.mark.parametrize("block", [64, 300, 10**6])
def test_quoted_line_breaks_survive_splits(spark, tmp_path, block):
    rng = random.Random(5)
    data = [(str(i), "".join(rng.choice(['a', '\n', ',', '"', "é"]) for _ in range(rng.randint(0, 30))) + "x") for i in range(120)]
    for part in range(2):
        with open(tmp_path / f"p{part}.csv", "w", encoding="utf-8", newline="") as f:
            writer = csv.writer(f, lineterminator="\n")
            writer.writerow(["id", "text"])
            writer.writerows(data[part * 60 : part * 60 + 60])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    try:
        df = read_delimited(spark, str(tmp_path), multiline=True)
        found = sorted((r["id"], r["text"]) for r in df.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found == sorted((int(i), t) for i, t in data)


def test_stray_quotes_and_other_headers(spark, tmp_path):
    df = read_any(spark, put(tmp_path / "q.csv", 'name,size\nx,5" pipe\ny,2\nz,"3"\n'))
    assert [tuple(r) for r in df.orderBy("name").collect()] == [("x", '5" pipe'), ("y", "2"), ("z", "3")]
    (tmp_path / "two").mkdir()
    put(tmp_path / "two" / "a.csv", 'a,b\n1,"x\ny"\n')
    put(tmp_path / "two" / "b.csv", "b,a\nz,2\n")
    with pytest.raises(Exception):
        read_delimited(spark, str(tmp_path / "two"), multiline=True).collect()


def test_latin_text(spark, tmp_path):
    (tmp_path / "l.csv").write_bytes("name,n\nJos\u00e9,1\n".encode("latin-1"))
    assert [tuple(r) for r in read_any(spark, str(tmp_path / "l.csv")).collect()] == [("Jos\u00e9", 1)]


def test_json_shapes(spark, tmp_path):
    listed = read_any(spark, put(tmp_path / "list.json", '[{"a": 1, "b": {"c": "x"}}, {"a": 2}]'))
    assert sorted(listed.columns) == ["a", "b.c"] and listed.count() == 2
    many = put(tmp_path / "wrapped.json", '{"meta": 1, "z": [],\n"rows": [{"k": 1}, {"k": 2}], "a": [{"q": 9}]}')
    with pytest.raises(ValueError):
        read_json(spark, many)
    wrapped = read_json(spark, put(tmp_path / "one.json", '{"meta": {\n' + '"m": 1,\n' * 0 + '"m": 1}, "rows": [{"k": 1}, {"k": 2}]}'))
    assert wrapped.columns == ["k"] and wrapped.count() == 2
    one = read_json(spark, put(tmp_path / "single.json", '{"id": 1, "tags": [{"a": 1}, {"a": 2}]}\n'))
    assert one.columns == ["id", "tags"] and one.count() == 1
    chosen = read_json(spark, str(tmp_path / "wrapped.json"), records_path="a")
    assert [tuple(r) for r in chosen.collect()] == [(9,)]
    nested = read_json(spark, put(tmp_path / "nested.json", '{"a": {"b": {"c": 1}}, "l": [1, 2]}'))
    assert nested.columns == ["a.b.c", "l"] and nested.first()["l"] == [1, 2]
    lines = read_json(spark, put(tmp_path / "lines.json", '{"a": 1}\n{"a": 2}\n{"a": 3}\n'))
    assert lines.count() == 3
    with pytest.raises(ValueError):
        read_json(spark, put(tmp_path / "bad.json", "42"))


def test_xml_shapes(spark, tmp_path):
    text = '<r><rec id="1"><n>a</n><t>x</t><t>y</t></rec>\n<rec id="2"><n>b</n><p><q>5</q></p></rec></r>'
    df = read_any(spark, put(tmp_path / "recs.xml", text))
    assert sorted(df.columns) == ["_id", "n", "p.q", "t"] and df.count() == 2
    head = "<d><head>" + "<p><i>x</i></p>" * 300 + "</head>\n" + "<rec><a>1</a></rec>\n" * 3000 + "</d>"
    with pytest.raises(ValueError):
        read_xml(spark, put(tmp_path / "head.xml", head))
    assert read_xml(spark, str(tmp_path / "head.xml"), row_tag="rec").count() == 3000
    single = read_xml(spark, put(tmp_path / "one.xml", '<r><rec id="1"><n>a</n></rec></r>'))
    assert single.count() == 1 and single.columns == ["rec._id", "rec.n"]


DUMP = """-- it's a comment with one quote
CREATE TABLE people (id INTEGER PRIMARY KEY, name VARCHAR(20), score DECIMAL(5,2), CHECK (id > 0));
INSERT INTO people (id, name, score) VALUES (1, 'it''s; (ok)', 1.5), (2, NULL, 2.5);
insert into people (score, id) values (-3.25, 3);
INSERT INTO people VALUES (4, 'line one;
line two', NULL);
INSERT INTO other (x) VALUES (9);
"""


@pytest.mark.parametrize("block", [40, 10**6])
def test_sql_dump(spark, tmp_path, block):
    path = put(tmp_path / "dump.sql", DUMP)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    try:
        df = read_any(spark, path)
        found = [tuple(r) for r in df.orderBy("id").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert df.columns == ["id", "name", "score"]
    assert found == [(1, "it's; (ok)", 1.5), (2, None, 2.5), (3, None, -3.25), (4, "line one;\nline two", None)]
    assert [tuple(r) for r in read_sql_dump(spark, path, table="other").collect()] == [(9,)]
    with pytest.raises(ValueError):
        read_sql_dump(spark, put(tmp_path / "none.sql", "SELECT 1;\n"))


def test_sql_dumps_as_they_occur(spark, tmp_path):
    two = put(tmp_path / "two.sql", "INSERT INTO a (x) VALUES (1); INSERT INTO b (x) VALUES (2);")
    assert [tuple(r) for r in read_any(spark, two).collect()] == [(1,)]
    text = "/* c; ' */ INSERT INTO zz (k, v) VALUES ('00501', 7);\r\n-- it's\r\nINSERT INTO aa (x) VALUES (1);\r\nINSERT INTO mm (x) VALUES (2)"
    df = read_any(spark, put(tmp_path / "crlf.sql", text))
    assert [tuple(r) for r in df.collect()] == [("00501", 7)]
    declared = "CREATE TABLE t (zip TEXT, n INT, d DATE);\nINSERT INTO t VALUES ('00501', 1, '2024-01-02');"
    row = read_any(spark, put(tmp_path / "types.sql", declared)).first()
    assert row["zip"] == "00501" and row["n"] == 1 and str(row["d"]) == "2024-01-02"
    for bad in ("INSERT INTO t SELECT 1;", "INSERT INTO t (x) VALUES (1), 2;", "INSERT INTO t (x) VALUES ('a;"):
        with pytest.raises(Exception):
            read_any(spark, put(tmp_path / "bad.sql", bad)).collect()


def test_text_tables_decide_per_document(spark):
    docs = [
        (1, "Intro\nname|age\nann|3\n bob | 4 \nend"), (2, "k\tv\n1\t2"), (3, "name   age\nzoe   7\n|"), (4, "nothing here"),
    ]
    df = spark.createDataFrame(docs, "id int, body string")
    lines = {(r["id"], r["row_number"]): (r["header"], r["cells"]) for r in table_lines(df, "body", ["id"]).collect()}
    assert lines[1, 2] == (["name", "age"], ["bob", "4"]) and lines[2, 1] == (["k", "v"], ["1", "2"])
    assert {k[0] for k in lines} == {1, 2, 3}
    spaced = table_from_text(spark.createDataFrame([(1, "name   age\nzoe   7, 8")], "id int, body string"), "body", ["id"], ["name", "age", "gone"])
    assert tuple(spaced.first()) == (1, 1, "zoe", "7, 8", None)


def test_listing_and_unknown_formats(spark, tmp_path):
    put(tmp_path / "a.CSV", "x\n1\n")
    put(tmp_path / "noext", "x" * 3000)
    found = {r["name"]: r for r in list_files(spark, str(tmp_path)).collect()}
    assert found["a.CSV"]["extension"] == "csv" and found["noext"]["extension"] == "unknown"
    assert found["noext"]["formatted"] == "2.93 KB" and found["noext"]["size_ok"]
    assert not list_files(spark, str(tmp_path), max_mb=0).first()["size_ok"]
    for bad in ("x.xlsx", "x.pdf", "x.doc"):
        with pytest.raises(ValueError):
            read_any(spark, str(tmp_path / bad), bad.split(".")[1])


def test_round_trips(spark, tmp_path):
    df = spark.sql(
        "SELECT id, concat('t\"', id, ',\\n') AS s, id / 4 AS x, timestamp_ntz'2024-01-01 10:00:00.25' + make_dt_interval(id) AS t, "
        "array(id) AS l FROM range(20)"
    )
    write_csv(df, str(tmp_path / "c"))
    back = read_any(spark, str(tmp_path / "c"), "csv", multiline=True)
    assert sorted(map(tuple, back.select("id", "s", "x", "t").collect())) == sorted(map(tuple, df.select("id", "s", "x", "t").collect()))
    write_json(df.drop("t"), str(tmp_path / "j"))
    assert read_any(spark, str(tmp_path / "j")).select("id", "s", "x", "l").exceptAll(df.select("id", "s", "x", "l")).count() == 0


def test_sql_script_round_trip(spark, tmp_path):
    df = spark.sql("SELECT id, CASE WHEN id % 3 <> 0 THEN concat('it''s; ', id, ';\\n') END AS s, id * 1.5D AS x FROM range(250)")
    write_sql(SqlScript(df, "My Table", ["id"]).script(), str(tmp_path / "s"))
    text = "".join(sorted_part.read_text() for sorted_part in sorted((tmp_path / "s").glob("part-*")))
    assert text.index("CREATE TABLE my_table") < text.index("-- Create indexes") < text.index("INSERT INTO my_table")
    back = read_any(spark, str(tmp_path / "s"), "sql")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_reports(spark, tmp_path):
    sections = {"a": spark.createDataFrame([(1, None)], "x int, y string"), "b": spark.createDataFrame([], "z int")}
    assert report_document(sections).first()[0] == '{"a":[{"x":1,"y":null}],"b":[]}'
    write_report(sections, str(tmp_path / "r"), info=spark.createDataFrame([("n", "t")], "key string, value string"))
    assert spark.read.json(str(tmp_path / "r" / "info")).count() == 1


@pytest.mark.parametrize("split, block", [(64, 16), (1 << 20, 1 << 20)])
def test_one_dump_over_many_splits(spark, tmp_path, split, block):
    """Literals, names, comments, tuples and statements that cross splits and blocks give the rows of a dump read at once."""
    rows = [(i, ["plain", "it's; (ok)", "two\nlines; -- no comment", "/* no comment */ '", 'a "quoted"; `name`', ""][i % 6] * (1 + i % 3)) for i in range(120)]
    literal = lambda t: "'" + t.replace("'", "''") + "'"
    dump = "-- it's; a comment\r\nCREATE TABLE t (a INT, b TEXT);\n/* a ' long;\n comment\n; */\n"
    for n in range(0, 120, 5):
        dump += "INSERT INTO t (a,\n b)\nVALUES " + ",\n".join(f"({a},\n {literal(b)})" for a, b in rows[n : n + 5]) + "; /* ; */ INSERT INTO \"o;\nther\" VALUES (1);\n"
    (tmp_path / "d.sql").write_text(dump, newline="")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    opens = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        statements = sqldump._statements(spark, f"{tmp_path}/d.sql", block)
        assert statements.count() == 49
        blocks = sqldump._blocks(spark, f"{tmp_path}/d.sql", block)
        assert blocks.select("start").distinct().count() >= min(90, len(dump.encode()) // split)
        got = read_any(spark, f"{tmp_path}/d.sql", "sql")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.set("spark.sql.files.openCostInBytes", opens)
    assert sorted(map(tuple, got.collect())) == sorted(rows)


def test_dump_that_ends_inside_a_literal(spark, tmp_path):
    (tmp_path / "d.sql").write_text("INSERT INTO t VALUES ('a');\nINSERT INTO t VALUES ('b);\n")
    with pytest.raises(Exception, match="does not end"):
        read_any(spark, f"{tmp_path}/d.sql", "sql")


def test_quoted_line_breaks_are_not_broken_silently(spark, tmp_path, rows):
    path = put(tmp_path / "q.csv", 'id,name,note\n1,"two\nlines",x\n2,"a, ""b""",y\n')
    with pytest.raises(ValueError, match="multiline=True"):
        read_delimited(spark, path)
    assert rows(read_delimited(spark, path, multiline=True)) == [(1, "two\nlines", "x"), (2, 'a, "b"', "y")]
    last = put(tmp_path / "last.csv", 'id,note\r\n1,"two\r\nlines"\r\n')
    with pytest.raises(ValueError, match="multiline=True"):
        read_delimited(spark, last)
    # Quotes inside unquoted cells, closed cells, doubled quotes and empty cells are no open ones.
    fine = put(tmp_path / "fine.csv", 'id,name,note\n1,5" pipe,"x"\n2,"",""""\n3,"a,b",c"\n')
    assert read_delimited(spark, fine, types=False).count() == 3


def test_block_states_of_texts_without_closing_marks(spark):
    """A text that closes nothing stays inside of what it began in; all others are read through, mark by mark."""
    ab, r = ["'", '"', "`", "/*", "*/", "/", "*", "--", "\n", "a"], random.Random(3)
    texts = ["", "/", "*/", "a", "it"] + ["".join(r.choices(ab, k=r.randrange(7))) for _ in range(300)]

    def brute(text, state):
        i = 0
        while i < len(text):
            closer = ("", "'", '"', "`", "*/")[state]
            if state:
                if text.startswith(closer, i):
                    state, i = 0, i + len(closer)
                else:
                    i += 1
            elif text.startswith("--", i):
                end = text.find("\n", i)
                i = len(text) if end < 0 else end
            else:
                mark = next((k for k in (1, 2, 3, 4) if text.startswith(("", "'", '"', "`", "/*")[k], i)), 0)
                state, i = mark, i + (2 if mark == 4 else 1)
        return state

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = df.select("t", F.array(*[sqldump._end_state(F.col("t"), s) for s in range(5)]).alias("ends")).collect()
    assert [list(r.ends) for r in found] == [[brute(r.t, s) for s in range(5)] for r in found]
    for state in range(1, 5):
        assert "contains" in str(sqldump._end_state(F.col("t"), state))
