"""Page operators, paper metadata, sources, sinks and streaming."""

from pyspark.sql import functions as F

from acclaim import schemas
from acclaim.operators import layout, papers as P
from acclaim.sources import corpus, sinks, verdicts
from acclaim.streaming.incremental import run_incremental


def lines(spark, rows):
    return spark.createDataFrame(rows, schemas.TEXT_LINES)


def test_columns_and_order(spark):
    rows = [(1, 0, 50.0, 60.0 + 10 * i, 250.0, 68.0 + 10 * i, 9.0, f"l{i}") for i in range(6)]
    rows += [(1, 0, 320.0, 60.0 + 10 * i, 520.0, 68.0 + 10 * i, 9.0, f"r{i}") for i in range(6)]
    table = lines(spark, rows)
    columns = layout.page_columns(table)
    assert columns.first().n_columns == 2
    assert layout.reading_order(table).first().text.split("\n") == [f"l{i}" for i in range(6)] + [f"r{i}" for i in range(6)]
    anchors = spark.createDataFrame(
        [(1, 0, 1, 55.0, 100.0, 330.0, 80.0)],
        "doc_id bigint, page_num int, anchor_id int, start_x double, start_y double, end_x double, end_y double",
    )
    got = {r.text for r in layout.lines_between(anchors, table, columns).collect()}
    assert got == {"l4", "l5", "r0", "r1"}


def test_title_and_block(spark):
    table = lines(spark, [
        (1, 0, 50.0, 20.0, 500.0, 30.0, 8.0, "J. Something doi.org/10.1/x"), (1, 0, 50.0, 60.0, 500.0, 80.0, 18.0, "Article A remarkable title about water-in-salt"),
        (1, 0, 50.0, 90.0, 500.0, 100.0, 10.0, "Ann Lee1, Bob Ray2, and Cy Dee"), (1, 0, 50.0, 500.0, 500.0, 510.0, 20.0, "Too far down to be one"),
    ])
    assert layout.title_by_font(table).first().title == "A remarkable title about water-in-salt"
    found = layout.author_block(table, spark.createDataFrame([(1, 80.0)], "doc_id bigint, title_bottom double")).first()
    assert found.authors == ["Ann Lee", "Bob Ray", "Cy Dee"]
    probe = spark.createDataFrame([(1, "A remarkable title about water-in-salt", "Ann Lee")], "doc_id bigint, title string, first_author string")
    block = {r.text for r in layout.title_author_block(probe, table).collect()}
    assert "Article A remarkable title about water-in-salt" in block and "Ann Lee1, Bob Ray2, and Cy Dee" in block


def test_english_journal_lines(spark):
    heads = {
        "Electrochem. Energy Rev. (2021) 4:1–34": ("Electrochem. Energy Rev.", "2021", "4", "1-34"),
        "Author et al., 2021, Cell 184, 1362-1376": ("Cell", "2021", "184", "1362-1376"),
        "Current Biology 31, R1252–R1266, October 11, 2021": ("Current Biology", "2021", "31", "R1252-R1266"),
        "Heliyon 7 (2021) e06955": ("Heliyon", "2021", "7", "e06955"),
    }
    table = spark.createDataFrame([(h,) for h in heads], "h string")
    line = P.english_journal_line(F.col("h"))
    got = {r.h: (r.j, r.y, r.v, r.p) for r in table.select("h", line["journal"].alias("j"), line["year"].alias("y"), line["volume"].alias("v"), line["pages"].alias("p")).collect()}
    assert got == heads


def test_chinese_metadata(spark):
    first = (
        "文章编号：1009-6094(2019)02-0412-08\n某些问题的研究与分析*\n张三1，李四2\n（1 某某大学，南京210000）\n安全与环境学报\n第 19 卷第 2 期\n2019年4月\nDOI：10.1234/ab.2019\n"
    )
    r = P.chinese_metadata(spark.createDataFrame([(1, first, first, "")], "doc_id bigint, full_text string, first_page string, last_page string")).first()
    assert (r.title_cn, r.authors_cn, r.year, r.volume, r.issue, r.pages, r.country, r.doi) == (
        "某些问题的研究与分析", ["张三", "李四"], "2019", "19", "2", "412-419", "中国", "10.1234/ab.2019",
    )
    assert r.institution_cn == "某某大学" and r.journal_cn.endswith("学报")


def test_markdown_metadata(spark):
    text = "# On Salt Cells\n\nAnn Lee1,\\*, Bob Ray2\n\nJournal of Cells (2019) 12:10–20\nhttps://doi.org/10.1000/xyz.\n"
    r = P.markdown_metadata(spark.createDataFrame([(1, text)], "doc_id bigint, full_text string")).first()
    assert (r.title_en, r.authors_en, r.year, r.volume, r.pages, r.doi) == ("On Salt Cells", ["Ann Lee", "Bob Ray"], "2019", "12", "10-20", "10.1000/xyz")


def test_corpus_folder_and_verdict_files(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "b.TXT").write_text("two\nlines")
    (tmp_path / "in" / "sub" / "a.md").write_text("# t")
    (tmp_path / "in" / ".hidden.txt").write_text("x")
    (tmp_path / "in" / "c.bin").write_text("x")
    got = [(r.name, r.full_text) for r in corpus.list_corpus(corpus.read_text_folder(spark, str(tmp_path / "in"))).collect()]
    assert got == [("a", "# t"), ("b", "two\nlines")]
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "7_0.json").write_text('ok: {"results":[{"id":1,"accept":false,"reason":"r"},{"id":1,"accept":true}]}')
    answer = verdicts.parse_verdicts(verdicts.read_verdict_files(spark, str(tmp_path / "v"))).first()
    assert (answer.doc_id, answer.cand_id, answer.accept) == (7, 1, True)


def test_sinks(spark, tmp_path):
    results = spark.createDataFrame([(1, "a", 2, "success"), (2, "b", 0, "no_result")], "doc_id bigint, name string, n_records bigint, status string")
    sinks.write_results(results, str(tmp_path / "r"))
    again = spark.createDataFrame([(2, "b", 5, "success"), (3, "c", 0, "no_result")], results.schema)
    sinks.write_results(again, str(tmp_path / "r"))
    sinks.write_results(again.limit(0), str(tmp_path / "r"))
    found = {r.doc_id: (r.n_records, r.has_result) for r in sinks.read_results(spark, str(tmp_path / "r")).collect()}
    assert found == {1: (2, True), 2: (5, True), 3: (0, False)}  # paper 1 is left alone, paper 2 has moved
    assert [r.doc_id for r in sinks.read_results(spark, str(tmp_path / "r"), has_result=False).collect()] == [3]
    sinks.write_report(results.withColumn("error", F.lit(None).cast("string")), spark.createDataFrame([(1, [("m", "a", "s")])], "doc_id bigint, items array<struct<marker:string,author:string,sentence:string>>"), str(tmp_path / "t"))
    assert [(r.position, r.doc_id, r["items"] and r["items"][0].author) for r in sinks.read_report(spark, str(tmp_path / "t")).orderBy("position").collect()] == [(1, 1, "a"), (2, 2, None)]
    assert spark.read.json(str(tmp_path / "t" / "summary")).first().n_success == 1
    audit = spark.createDataFrame([(1, 0, "vetoed", 9, "r", "s")], schemas.AUDIT)
    sinks.write_audit(audit, str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a")).first().stage == "vetoed"


def test_incremental_run_appends_once(spark, tmp_path):
    text = "Smith et al. (2010) first reported it [1].\nReferences\n[1] Smith A. Some title [J]. J, 2010, 1(2): 3-4."
    paper = spark.createDataFrame([(1, text, "Ann Other")], schemas.PAPER_TEXT + ", authors_str string")
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    paper.coalesce(1).write.parquet(source)
    run_incremental(spark, source, out, state).awaitTermination()
    paper.coalesce(1).write.mode("append").parquet(source)  # the same paper again
    run_incremental(spark, source, out, state).awaitTermination()
    assert spark.read.parquet(out + "/candidates").count() == 1


def test_incremental_run_takes_late_files(spark, tmp_path):
    """A file that is older than one already processed is not dropped."""
    import os

    text = "Smith et al. (2010) first reported it [1].\nReferences\n[1] Smith A. Some title [J]. J, 2010, 1(2): 3-4."
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for doc_id, age in ((1, 0), (2, 5 * 86_400)):
        part = str(tmp_path / f"part{doc_id}")
        spark.createDataFrame([(doc_id, text, "Ann Other")], schemas.PAPER_TEXT + ", authors_str string").coalesce(1).write.parquet(part)
        os.makedirs(source, exist_ok=True)
        for name in os.listdir(part):
            if name.endswith(".parquet"):
                os.rename(f"{part}/{name}", f"{source}/{name}")
                before = os.stat(f"{source}/{name}").st_mtime - age
                os.utime(f"{source}/{name}", (before, before))
        run_incremental(spark, source, out, state).awaitTermination()
    assert sorted(r.doc_id for r in spark.read.parquet(out + "/candidates").collect()) == [1, 2]
