"""Documents and joins that must not grow with the square, or the size, of the tables."""
import time

from pyspark.sql import functions as F

from ringproof.functions.text import parse_boxer
from ringproof.operators import discovery
from ringproof.plans import catalog

SMALL = "/root/testdata/sf0.001"


def repeated(spark, at, copies):
    """The order tables again under other keys that give the same names."""
    shift = (F.col("i") * 1430 * 8).cast("bigint")
    for table, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")):
        df = spark.read.parquet(f"{SMALL}/{table}.parquet").crossJoin(spark.range(copies).withColumnRenamed("id", "i"))
        df.withColumn(key, F.col(key) + shift).drop("i").write.parquet(f"{at}/{table}.parquet")
    return str(at)


def test_documents_do_not_grow_with_the_tables(spark, tmp_path):
    large = repeated(spark, tmp_path, 4)
    for made, text in ((catalog._feeds, "content"), (catalog._record_pages, "html")):
        longest = [made(spark, d).agg(F.max(F.length(text)), F.sum(F.length(text))).first() for d in (SMALL, large)]
        assert longest[1][1] > 3 * longest[0][1]
        assert longest[1][0] < 1.2 * longest[0][0]


def test_record_rows_of_a_page_and_day_meet_each_surname_once(spark):
    """8,000 sides of a page and day ask for one of three surnames among 8,000 rows: 64 million pairs of names, if each met each."""
    n, names = 8000, F.array(*map(F.lit, ("Cruz", "O'Neil", "ÖZIL")))
    rows = spark.range(n).select(F.lit("p").alias("page_url"), (F.col("id") % 4).alias("part"), F.floor(F.col("id") / 4).cast("int").alias("row_pos"), F.concat(F.lit("Leo "), F.get(F.array(F.lit("Marco"), F.lit("cruz"), F.lit("o'neil"), F.lit("Özil")), (F.col("id") % 4).cast("int"))).alias("opponent"), F.expr("date_add(date'2020-01-01', case when id < 4000 then 3 else 2 end)").alias("date"), F.lit("q").alias("quote"))
    sides = spark.range(n).select(F.col("id").alias("fight_id"), F.lit("A").alias("side"), F.lit("p").alias("page_url"), F.expr("date'2020-01-01'").alias("event_date"), parse_boxer(F.concat(F.lit("Leo "), F.get(names, (F.col("id") % 3).cast("int")))).alias("opponent"))
    sides = sides.withColumn("opponent", F.when(F.col("fight_id") % 3 == 2, F.col("opponent").withField("surname", F.lit("ÖZIL"))).otherwise(F.col("opponent")))
    began = time.time()
    got = discovery.match_records_to_fights(rows, sides).groupBy("opponent.surname", "part", "row_pos").count().collect()
    assert time.time() - began < 60
    # The first row that is near enough: those of the first thousand row numbers are three days off.
    assert {(r.surname, r.part, r.row_pos) for r in got} == {("Cruz", 1, 1000), ("O'Neil", 2, 1000), ("ÖZIL", 3, 1000)}
    assert sum(r["count"] for r in got) == n
