"""Times of the headline queries as one JSON line.

"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def workloads(spark):
    from lodegrain.operators import combine, decode, decode_column, double_, field, float_, int_, list_, long_, optional_field, string
    from lodegrain.operators import issues as I
    from lodegrain.plans import catalog

    read = lambda t: spark.read.parquet(f"{SF_DIR}/{t}.parquet")
    lines, events, vectors, docs = read("lineitem"), read("events"), read("embeddings"), read("documents")
    x = double_()
    fields = combine(
        field("l_orderkey", long_().non_negative()), field("l_partkey", long_().non_negative()), field("l_suppkey", long_().non_negative()), field("l_linenumber", int_().range(1, 7)),
        field("l_quantity", x.range(1.0, 45.0)), field("l_extendedprice", x.positive()), field("l_discount", x.range(0.0, 0.09)), field("l_tax", x.range(0.0, 0.07)),
        field("l_returnflag", string().one_of("A", "R", "N")), field("l_linestatus", string().one_of("O", "F")), optional_field("l_comment", string()),
    )
    named = lines.drop("l_shipdate")
    email = docs.select(F.regexp_extract("text", r"\S+@\S+", 0).alias("t"))
    heavy = string().trim().to_lower_case().min_length(1).trim().max_length(100).to_upper_case().non_blank()
    yield "b1_decode_lineitem", lambda: decode(named, fields).frame
    yield "b1_plain_select", lambda: named.select(F.struct("*").alias("value"))
    yield "b2_issue_summary", lambda: I.summary(decode(named, fields).frame)
    yield "b2_plain_group", lambda: named.filter("l_quantity > 45 or l_discount > 0.09 or l_tax > 0.07").groupBy("l_quantity").count()
    yield "b3_json_decode", lambda: decode_column(events.select(F.try_parse_json("props").alias("j")), "j", field("k", int_().range(0, 50))).frame
    yield "b3_plain_parse", lambda: events.select(F.try_parse_json("props").alias("j"))
    yield "b4_list_decode", lambda: decode(vectors, field("embedding", list_(float_().max(0.3)))).frame
    yield "b4_plain_transform", lambda: vectors.select(F.transform("embedding", lambda v: v <= 0.3).alias("e"))
    yield "b5_format_rules", lambda: decode(email, field("t", string().email())).frame
    yield "b5_plain_match", lambda: email.filter(F.col("t").rlike(r"^[^@]+@[^@]+\.[a-z]+$"))
    yield "b6_long_chain", lambda: decode(read("part"), field("p_name", heavy)).frame
    for name in ("decode_customer_issues", "discriminate", "one_of", "flat_map_cross_field", "flatten", "one_to_many", "map2_join", "traverse_index", "schema_versions"):
        yield name, lambda n=name: catalog.QUERIES[n](spark, SF_DIR)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name, make in workloads(spark):
        runs = []
        for _ in range(1 + RUNS):
            began = time.time()
            make().write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        times[name] = round(statistics.median(runs[1:]), 3)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": SF_DIR.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
