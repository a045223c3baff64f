import pytest
from pyspark.sql import functions as F

from salesgrid.functions import dates
from salesgrid.functions import formats as fmt
from salesgrid.operators import agg, dataset, questions, verbalise
from salesgrid.plans import answer as ans
from salesgrid.plans.sql import run_sql, safe_sql


def intent(spark, text):
    df = spark.createDataFrame([(1, text)], "question_id int, text string")
    return questions.extract_intents(df).first()


def test_intents(spark):
    r = intent(spark, 'Top 5 brands in MAT category: "Biscuits" market: india')
    assert (r["task"], r["top_n"], r["mode"], r["dims"]) == ("topn", 5, "MAT", ["brand"])
    assert (r["filter_category"], r["filter_market"]) == ("biscuits", "india")
    r = intent(spark, "category: biscuits market: india from Jan 2024 to September 2025")
    assert (r["filter_category"], r["range_start"], r["range_end"]) == ("biscuits", "2024-01", "2025-09")
    r = intent(spark, "unit sales trend by brand ytd")
    assert (r["task"], r["measures"], r["dims"], r["mode"]) == ("chart", ["unit_sales"], ["date", "brand"], "YTD")
    r = intent(spark, "yoy top 3 by brand last 12 months")
    assert (r["sort_by"], r["is_yoy"], r["dims"], r["mode"]) == ("value_yoy", True, ["brand"], "MAT")
    r = intent(spark, "stop the tomato sales")
    assert (r["task"], r["mode"], r["top_n"], r["mom"]) == ("topn", None, 10, False)
    r = intent(spark, "mat and year to date summary, mom")
    assert (r["task"], r["mode"], r["mom"]) == ("text", "YTD", True)


def test_brand_matches(spark):
    brands = spark.createDataFrame([("Alpha",), ("Beta",), ("Brandy & Co",)], "brand string")
    asked = [(1, "compare brands: Alpha, Beta"), (2, "sales of al-pha!"), (3, "brands: nothing known, sales of Alpha"),
             (4, "total"), (5, "brand Brandy & Co"), (6, "brands alpha vs beta"), (7, "BRANDY & CO sales")]
    df = spark.createDataFrame(asked, "question_id int, text string")
    got = {r["question_id"]: r["brands"] for r in questions.match_brands(df, brands).collect()}
    assert got == {1: ["Alpha", "Beta"], 2: ["Alpha"], 3: [], 4: [], 5: [], 6: ["Alpha", "Beta"], 7: ["Brandy & Co"]}
    assert questions.extract_mat_years(spark.createDataFrame([("mat24 vs mat 2025, MAT-24",)], "text string")).first()["mat_years"] == [2024, 2025]


@pytest.mark.parametrize("value,km,rs", [(1_234_567.0, "1.2M", "₹12.35L"), (999.0, "999", "₹999"),
                                         (4321.0, "4.3K", "₹4,321"), (25_000_000.0, "25.0M", "₹2.50Cr"), (None, None, "NA")])
def test_formats(spark, value, km, rs):
    df = spark.createDataFrame([(value,)], "x double")
    assert tuple(df.select(fmt.k_m("x"), fmt.rupees("x")).first()) == (km, rs)


def test_bands_and_periods(spark):
    df = spark.createDataFrame([("2025-01..2025-09 YTD", 0.081), ("2024-10 to 2025-09", -3.0), ("2024-02", 15.0), ("all", -0.0001)], "p string, g double")
    zero = F.lit(0)
    got = df.select(fmt.period_text("p"), fmt.share_pct("g"), fmt.growth_words(fmt.points(F.col("g")), zero)).collect()
    assert [tuple(r) for r in got] == [("Jan–Sep 2025 (YTD)", "8.1%", "grew"), ("Oct 2024–Sep 2025", "-3.0%", "softened"),
                                       ("Feb 2024", "15.0%", "surged"), ("all", "0.0%", "was flat")]


def test_instruction_rows(spark):
    schema = ("task string, category string, market string, period string, ytd_sales_cr double, yoy double, "
              "leaders array<struct<brand:string,share:double,ytd_cr:double>>")
    rows = [("ytd_summary", "Biscuits", "India", "2025-01..2025-09 YTD", 102.27, 0.081, [("Alpha", 0.31, 31.7)])]
    out = dataset.nlg_summaries(spark.createDataFrame(rows, schema), k=3, k_ytd=5).collect()
    assert len(out) == 5
    for r in out:
        first, second = r["output"].split("\n")
        assert "₹102.27 Cr" in first and "8.1%" in first and "(YTD)" in first and "31.0%" in second
    again = dataset.nlg_summaries(spark.createDataFrame(rows, schema), k=3, k_ytd=5).collect()
    assert sorted(r["output"] for r in out) == sorted(r["output"] for r in again)
    df = spark.createDataFrame([(10.0, 0.05, "₹10.02 Cr up 5.2%"), (10.0, 0.05, "₹11 Cr"), (10.0, 0.05, "up 9%")],
                               "ytd_sales_cr double, yoy double, text string")
    assert [r["supported"] for r in dataset.numbers_supported(df).collect()] == [True, False, False]


def test_oversample_and_sentences(spark):
    rows = [('x JSON: {"task": "YTD_summary"}',), ('x JSON: {"task": "brand_pair"}',), ("none",), ("JSON: {bad",)]
    df = dataset.oversample(spark.createDataFrame(rows, "instruction string"), factor=3)
    assert {r["task"]: r["rows"] for r in dataset.task_counts(df).collect()} == {"ytd_summary": 3, "brand_pair": 1, "": 2}
    text = spark.createDataFrame([(1, "One up.\nTwo at 3.5? yes! Last")], "id int, t string")
    assert [r["sentence"] for r in dataset.split_sentences(text, "t").collect()] == ["One up.", "Two at 3.5? yes!", "Last"]
    split = dataset.split_train_val(spark.range(5000), "id").groupBy("split").count().collect()
    assert 0.88 < {r["split"]: r["count"] for r in split}["train"] / 5000 < 0.92
    said = spark.createDataFrame([("A leads with 5. up YoY",)], "s string")
    variants = dataset.paraphrase(said, "s", "s", 5).collect()
    assert {r["paraphrase"] for r in variants if r["variant"] == 0} == {"A leads with 5. up YoY"} and len(variants) > 1


def test_rewordings_keep_the_numbers(spark, monkeypatch):
    monkeypatch.setattr(dataset, "SYNONYMS", (("up", ("up", "up 7", "higher by")), ("-3", ("-3", "3"))))
    said = spark.createDataFrame([("A is up 5.2% from -3",), (None,)], "s string")
    out = dataset.paraphrase(said, "s", "s", 30).collect()
    assert {r["paraphrase"] for r in out if r["s"]} == {"A is up 5.2% from -3", "A is higher by 5.2% from -3"}


def test_read_only_sql(spark):
    spark.range(10).createOrReplaceTempView("numbers")
    assert run_sql(spark, "select replace('a;b', ';', 'drop') as x, id from numbers;", 3).count() == 3
    for bad in ("drop table numbers", "with x as (select 1) insert into numbers select 1", "selectx", "select 1; delete from numbers"):
        assert safe_sql(spark, bad)[0]
    assert not safe_sql(spark, "SELECT 'please delete' AS x")[0]
    with pytest.raises(ValueError):
        run_sql(spark, "update numbers set id = 1")


def test_settled_brands():
    one = ans.settle_brands(ans.Intent(filters={"brand": "Alpha, Brandy and Beta"}))
    assert one.filters["brand"] == ["Alpha", "Brandy", "Beta"] and one.brand_group
    assert "brand" not in ans.settle_brands(ans.Intent(filters={"brand": ["A"]}, brand_group=True)).filters
    assert ans.previous_month("2024-01-15") == (2023, 12)


def test_fallback_sentence(spark):
    df = spark.createDataFrame([(1, "A", 1234.0, "unit_sales"), (2, None, None, "unit_sales")], "k int, label string, value double, measure string")
    got = [r["sentence"] for r in verbalise.say_fallback(df, ["k"]).orderBy("k").collect()]
    assert got == ["Largest unit sales: A, 1,234.", verbalise.FALLBACK]


def test_sql_reads_views_only_and_keeps_all_rows(spark):
    spark.range(20_000).createOrReplaceTempView("many")
    assert run_sql(spark, "select * from many").count() == 20_000
    for good in (
        "(select 1) union all select 2", "select 1 as copy, id from many", "with a as (select id from many), b as (select * from a) select * from b",
        "select id, row_number() over (partition by id % 3 order by id) r from many m where exists (select 1 from many n where n.id = m.id)"
        " and id in (select id from many) group by id having count(*) > 0 order by 1 limit 3 offset 1",
        "select (select max(id) from many) x, explode(array(1, 2)) from values (1), (2) as t(a)",
        "select * from range(3)", "select a.id from many a left join many b using (id) lateral view explode(array(1)) z as y",
        "select * from (select id % 2 k, id from many) pivot (sum(id) for k in (0, 1))", "select distinct id from many window w as (order by id)",
    ):
        assert safe_sql(spark, good)[0] is None, good
        run_sql(spark, good, 1).collect()
    for bad in (
        "select * from parquet.`/tmp/x`", "select reflect('java.lang.Math', 'abs', 1)", "select `java_method`('a', 'b')",
        "select * from csv . `x`", "select count(*) from `parquet`.`/path`", "select reflect/**/('java.lang.Math','abs',-1)",
        "select * from parquet/**/.`/x`", "select * from `csv` . `x`", "select * from unknown", "select * from default.many",
        "with a as (select * from json.`/x`) select 1", "select (select max(x) from text.`/x`)", "select 1 where 1 in (select a from orc.`/x`)",
        "select exists (select 1 from avro.`/x`)", "set spark.x = 1", "explain select 1", "create view v as select 1", "cache table many",
        "select transform(id) using 'cat' as (x) from many", "from many insert into numbers select *", "select input_file_name() from many",
        "select * from many, lateral (select reflect('a', 'b'))", "add jar '/x'", "select * from many lateral view reflect('a', 'b') z as y", "select a.b.c(1)", "show tables", "",
    ):
        assert safe_sql(spark, bad)[0], bad


def test_declines_are_supported_and_kept(spark):
    rows = spark.createDataFrame(
        [("down 5.0%", 1.0, -0.05), ("-5.0%", 1.0, -0.05), ("-5.0%", 1.0, 0.05), ("up 7.0%", 1.0, 0.05)],
        "text string, ytd_sales_cr double, yoy double",
    )
    assert [r["supported"] for r in dataset.numbers_supported(rows).collect()] == [True, True, False, False]


def test_rewording_replaces_whole_words(spark):
    rows = spark.createDataFrame([("Share within the top 10 grew within weeks",)], "s string")
    said = {r["paraphrase"] for r in dataset.paraphrase(rows, "s", "s", 8).collect()}
    assert all("within" in t.split() and "totalingin" not in t and "atin" not in t for t in said)


def test_brands_are_found_as_whole_words_and_restrict_the_answer(spark):
    names = ["A-B", "AB", "Brand#1", "Brand#12", "Zed Co"]
    brands = spark.createDataFrame([(x,) for x in names], "brand string")
    texts = ["compare brand#12 with a b", "brands: Zed Co sales and Brand#1", "zed co?", "", None]
    asked = spark.createDataFrame(list(enumerate(texts)), "question_id int, text string")
    got = {r["question_id"]: r["brands"] for r in questions.match_brands(asked, brands).collect()}
    assert got == {0: ["A-B", "AB", "Brand#12"], 1: ["Brand#1", "Zed Co"], 2: ["Zed Co"], 3: [], 4: []}
    fact = spark.createDataFrame([("2024-01-01", b, float(i + 1)) for i, b in enumerate(names)], "d string, brand string, value_sales double")
    fact = fact.select(F.to_date("d").alias("date"), "brand", "value_sales")

    def said(text):
        return {r["brand"]: r["value_sales"] for r in ans.ask(fact, text, "2024-02-15").collect()}

    assert said("compare brands Brand#1 and Brand#12 sales ytd") == {"Brand#1": 3.0, "Brand#12": 4.0}
    assert said("total sales of Brand#12 ytd") == {"Brand#12": 4.0}
    assert said("total sales ytd brand: Brand#1") == {"brand#1": 3.0}  # labelled as the question's filter is read


def test_repeated_questions_keep_their_rows(spark):
    brands = spark.createDataFrame([("Alpha",)], "brand string")
    asked = spark.createDataFrame([(1, "alpha"), (1, "alpha"), (None, "alpha"), (2, None), (2, None)], "question_id int, text string")
    got = sorted((str(r["question_id"]), r["brands"]) for r in questions.match_brands(asked, brands).collect())
    assert got == [("1", ["Alpha"]), ("1", ["Alpha"]), ("2", []), ("2", []), ("None", ["Alpha"])]


def test_trend_names_every_drop_in_sentences_of_ten(spark):
    rows = [(f"b{i:02d}", m, 100.0 - (i + 1 if m == "2024-02-01" else 0)) for i in range(23) for m in ("2024-01-01", "2024-02-01")]
    points = spark.createDataFrame(rows, "brand string, date string, value_sales double").withColumn("date", F.to_date("date"))
    for keys in ([], ["k"]):
        said = [r["sentence"] for r in verbalise.say_trend(points.withColumn("k", F.lit("x")), keys, variant=0).orderBy("pos").collect()]
        assert len(said) == 5 and said[1].startswith("Drops from high to low, places 1 to 10: b22 ~23%") and said[3].endswith("b00 ~1%.")
        assert sum(s.count("~") for s in said) == 23 and said[4] == "Low month of several items: Feb 2024."
    none = verbalise.say_trend(points.limit(0).withColumn("k", F.lit("x")), ["k"], variant=0)
    assert none.count() == 0


def test_lists_come_in_pages(spark):
    pairs = [("a", f"b{i:03d}") for i in range(25)] * 2 + [("c", "x"), ("c", None), (None, "y")]
    df = spark.createDataFrame(pairs, "category string, brand string")
    got = {(r["category"], r["page"]): r["brands"] for r in agg.entities(df, 10).collect()}
    assert {k: len(v) for k, v in got.items()} == {("a", 1): 10, ("a", 2): 10, ("a", 3): 5, ("c", 1): 1, (None, 1): 1}
    assert got["a", 3] == [f"b{i:03d}" for i in range(20, 25)]


def test_bare_filters_hold_digits_and_signs(spark):
    rows = [("brand: Brand#7 mat",), ("category: 7up from jan 2024",), ("market: north jan 2024 to mar 2024",), ("category: brand: x",)]
    got = questions.extract_intents(spark.createDataFrame(rows, "text string")).select(*[f"filter_{d}" for d in ("brand", "category", "market")])
    assert [tuple(r) for r in got.collect()] == [("brand#7", None, None), (None, "7up", None), (None, None, "north"), ("x", None, None)]


def test_rarer_date_shapes(spark):
    want = {
        "25-Nov-25": "2025-11-25 00:00:00", "Nov-25": "2025-11-01 00:00:00", "15/01/24": "2024-01-15 00:00:00",
        "15/01/70": "1970-01-15 00:00:00", "Nov 25 2025": "2025-11-25 00:00:00", "2024-01-15T10:00:00Z": "2024-01-15 10:00:00",
        "2024.01.15": "2024-01-15 00:00:00", "01/15/2024 12:00:00 AM": "2024-01-15 00:00:00", "15/01/2024 3:05 PM": "2024-01-15 15:05:00",
        "2024": "2024-01-01 00:00:00", "45000": "2023-03-15 00:00:00", "junk": None,
    }
    rows = spark.createDataFrame([(x,) for x in want], "x string")
    got = {r["x"]: r["t"] for r in rows.select("x", dates.parse_mixed_date("x").cast("string").alias("t")).collect()}
    assert got == want
