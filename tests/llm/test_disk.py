"""Tables and shuffles that once took more disk than the job needs."""

from pathlib import Path

from pyspark.sql import functions as F

from framewright.llm import jaccard_join


def test_keys_are_shuffled_once(spark, capsys):
    rows = spark.range(1000).select((F.col("id") % 600).alias("key"), F.col("id").alias("rep"), F.lit(7).cast("long").alias("slot"))
    found = jaccard_join.met(rows, "key", "slot").where("documents > 1")
    assert found.count() == 800 and found.where("rep % 600 <> low or high <> low + 600").count() == 0
    capsys.readouterr()
    found.explain()
    assert capsys.readouterr().out.count("Exchange") == 1


def test_the_join_leaves_no_sets_and_no_keys_on_disk(spark):
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(shared.iterdir())
    words = [f"w{k}" for k in range(60)]
    docs = [(k, " ".join(words[:50] + [f"x{k}"] + words[50:])) for k in range(6)] + [(9, "some other words of their own")]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.link(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {**dict.fromkeys(range(6), 0), 9: 9}
    left = {p.name.rsplit("-", 1)[0] for p in set(shared.iterdir()) - before}
    assert "described" in left and not left & {"sets", "shared", "less"}
