"""Citation text rendered from the structured tables.

``documents`` holds no citations, so the structured rows of ``lineitem`` are written out
as sentences, bibliography entries and papers; the operators must recover the structure.
Every rendered row comes from the given tables and grows with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEYS = ["l_shipdate", "l_partkey", "l_suppkey", "l_linenumber"]


def spelled(number: Column) -> Column:
    """A number spelled in letters, so that it cannot be read as a year."""
    return F.translate(number.cast("string"), "0123456789", "abcdefghij")


def letters(number: Column, width: int) -> Column:
    """A number spelled in so many letters; of a longer one the first ones."""
    return spelled(F.lpad(number.cast("string"), width, "0"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", *KEYS, "l_quantity", "l_returnflag")


def _gathered_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same ranks as ``_ranked_items``, for a table that gathers every order in one row: one shuffle does for both."""
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    items = _items(spark, sf_dir).filter("l_orderkey is not null").repartition(parallel, "l_orderkey")
    # items without a day are counted, but are no references
    ranked = items.withColumn("rank", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*KEYS)))
    return ranked.filter("l_shipdate is not null")


def _ranked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitems with their 1-based rank in the order.

    The rank is the number of items on earlier days plus the rank within the day: the windows
    run over one day of one order, and over one small row per day, never over a whole order.
    """
    items = _items(spark, sf_dir)
    day = ["l_orderkey", "l_shipdate"]
    local = F.row_number().over(Window.partitionBy(*day).orderBy(*KEYS[1:]))
    per_day = items.groupBy(*day).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("l_orderkey").orderBy("l_shipdate").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_day.select(*day, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return items.withColumn("local", local).join(starts, day).withColumn("rank", F.col("local") + F.col("before"))


def reference_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One structured reference per lineitem; an order is a paper."""
    return _structured(_ranked_items(spark, sf_dir))


def _structured(ranked: DataFrame) -> DataFrame:
    return ranked.select(
        F.col("l_orderkey").cast("bigint").alias("doc_id"), F.col("rank").cast("int").alias("ref_index"),
        F.concat(F.lit("S"), letters(F.col("l_suppkey"), 4)).alias("surname"),
        F.year("l_shipdate").cast("string").alias("year"),
        (F.col("l_returnflag") != "R").alias("is_journal"),
        F.col("l_quantity").cast("int").cast("string").alias("volume"),
        F.concat(F.lit("x"), letters(F.col("l_partkey"), 6)).alias("tag"),
        F.col("l_linenumber").cast("string").alias("issue"),
        F.col("l_linenumber").alias("line_no"), "l_partkey", "l_suppkey",
    )


def sentence_text() -> Column:
    """One of nine sentence templates, chosen by ref_index."""
    n, y, t, i = F.col("surname"), F.col("year"), F.col("tag"), F.col("ref_index")
    next_year = (y.cast("int") + 1).cast("string")

    def fill(template: str, year: Column = y) -> Column:
        parts = template.replace("N", "\0N\0").replace("Y", "\0Y\0").replace("T", "\0T\0").replace("#", "\0#\0")
        values = {"N": n, "Y": year, "T": t, "#": i.cast("string")}
        return F.concat(*[values.get(p, F.lit(p)) for p in parts.split("\0") if p])

    forms = [
        fill("N et al. (Y) first reported compound T [#]."),
        fill("In Y, N originally proposed scheme T [#]."),
        fill("N et al. (Y) reported item T [#]."),
        fill("We first reported what N et al. (Y) called T [#]."),
        fill("Method T was first used (N et al., Y)."),
        fill("N et al. [#] first reported it."),
        fill("It was first reported in Y [#]."),
        fill("N et al. (Y) first reported compound T [#].", next_year),
        fill("N et al. (Y) measured sample T [#]."),
    ]
    out = F.when(i % 9 == 0, forms[0])
    for k, form in enumerate(forms[1:], start=1):
        out = out.when(i % 9 == k, form)
    return out


def _kind() -> Column:
    return F.when(F.col("is_journal"), "[J]").otherwise("[C]")


def bracket_entry() -> Column:
    """``[3] Saahj A, Sbcde B. Title x [J]. Journal J, 1999, 12(3): 10-20.``"""
    return F.concat(
        F.lit("["), F.col("ref_index"), F.lit("] "), F.col("surname"), F.lit(" A, Coauth B. Title "), F.col("tag"),
        F.lit(" "), _kind(), F.lit(". Journal J, "), F.col("year"), F.lit(", "), F.col("volume"), F.lit("("),
        F.col("issue"), F.lit("): 10-20."),
    )


def dot_entry() -> Column:
    """``3.\\tSaahj, A., Coauth, B.: Title x. Journal J 12, 10-20 (1999)``"""
    title = F.when(F.col("is_journal"), "Title ").otherwise("Conference title ")
    return F.concat(
        F.col("ref_index"), F.lit(".\t"), F.col("surname"), F.lit(", A., Coauth, B.: "), title, F.col("tag"),
        F.lit(". Journal J "), F.col("volume"), F.lit(", 10–20 ("), F.col("year"), F.lit(")"),
    )


def chinese_entry() -> Column:
    """``[3] 张三，李四，等．标题x[J]．某某学报，1999，12（3）：10-20．DOI：10.1000/x``"""
    return F.concat(
        F.lit("["), F.col("ref_index"), F.lit("] 张三，李四，等．标题"), F.col("tag"), F.when(F.col("is_journal"), "[J]").otherwise("[D]"),
        F.lit("．某某学报，"), F.col("year"), F.lit("，"), F.col("volume"), F.lit("（"), F.col("issue"), F.lit("）：10-20．DOI：10.1000/"), F.col("tag"),
    )


def author_year_entry() -> Column:
    """``Saahj, A., 1999. Title x. Journal J 12 (3), 10-20.``"""
    title = F.when(F.col("is_journal"), "Title ").otherwise("Conference title ")
    return F.concat(
        F.col("surname"), F.lit(", A., "), F.col("year"), F.lit(". "), title, F.col("tag"), F.lit(". Journal J "),
        F.col("volume"), F.lit(" ("), F.col("issue"), F.lit("), 10–20."),
    )


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence rows; sent_idx = ref_index - 1."""
    return reference_rows(spark, sf_dir).select(
        "doc_id", (F.col("ref_index") - 1).alias("sent_idx"), sentence_text().alias("text"), "ref_index", "surname",
        "year", "tag", "is_journal",
    )


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference rows with the schema of parsed references."""
    return structured_references(reference_rows(spark, sf_dir))


def structured_references(rows: DataFrame) -> DataFrame:
    author = F.concat("surname", F.lit(" A"))
    nothing = F.lit(None).cast("string")
    return rows.select(
        "doc_id", "ref_index", bracket_entry().alias("raw_text"), F.array(author, F.lit("Coauth B")).alias("authors"),
        author.alias("first_author"), F.concat(F.lit("Title "), "tag").alias("title"),
        F.when(F.col("is_journal"), F.lit("Journal J")).otherwise(nothing).alias("journal"), "year", "volume", "issue",
        F.lit("10-20").alias("pages"), F.when(F.col("is_journal"), "J").otherwise("C").alias("ref_type"), "is_journal",
        nothing.alias("doi"),
    )


def papers(spark: SparkSession, sf_dir: str, style: str = "mixed", noise: bool = True) -> DataFrame:
    """Papers: body with page furniture between sentences, then a reference section.

    ``style``: bracket, dot, author_year, chinese, or mixed (bracket for even doc_id, dot for odd).
    Every fifth paper is written by the author of its first reference.
    """
    entry = {
        "bracket": bracket_entry(),
        "dot": dot_entry(),
        "author_year": author_year_entry(),
        "chinese": chinese_entry(),
        "mixed": F.when(F.col("doc_id") % 2 == 0, bracket_entry()).otherwise(dot_entry()),
    }[style]
    furniture = (
        F.when(F.col("ref_index") % 4 == 1, F.lit("\n12\n"))
        .when(F.col("ref_index") % 4 == 2, F.lit("\n· 34 ·\n"))
        .when(F.col("ref_index") % 4 == 3, F.lit("\nVol. 35 No. 2 2019\n"))
        .otherwise(F.lit("\n"))
        if noise
        else F.lit(" ")
    )
    printed = F.replace(sentence_text(), F.lit("first used"), F.lit("ﬁrst used")) if noise else sentence_text()
    rows = _structured(_gathered_items(spark, sf_dir)).select(
        "doc_id", "ref_index", F.concat(printed, furniture).alias("body"), entry.alias("entry"), "surname"
    )
    grouped = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ref_index", "body", "entry", "surname"))).alias("r"))
    body = F.array_join(F.transform("r", lambda x: x["body"]), "")
    listed = F.array_join(F.transform("r", lambda x: x["entry"]), "\n")
    own = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("Ana "), F.col("r")[0]["surname"])).otherwise(F.lit("Ana Quist"))
    return grouped.select(
        "doc_id", F.concat(body, F.lit("\nReferences\n"), listed).alias("full_text"), own.alias("authors_str")
    )
