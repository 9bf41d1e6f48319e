"""Texts that a redaction leaves where they are."""

from pyspark.sql import functions as F

from voxmill.llm import secrets


def moved(spark):
    """Rows that all stages so far have written to shuffles."""
    jvm = spark.sparkContext._gateway
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, jvm.new_array(jvm.jvm.double, 0), jvm.jvm.java.util.ArrayList())
    return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}


def test_clean_texts_are_not_moved(spark):
    """Redaction joins the texts that can have a span, whatever the join; the others, null ones and repeated rows too, stay."""
    text = F.when(F.col("id") % 400 == 0, F.concat(F.lit("é password = abcdefghijkl"), F.col("id"), F.lit(" end"))).when(F.col("id") % 7 > 0, F.concat(F.lit("plain words "), F.col("id")))
    docs = spark.range(4000).select(F.when(F.col("id") % 5 > 0, F.col("id")).alias("doc_id"), text.alias("text"), F.col("id").alias("given"))
    docs = docs.unionByName(docs.where("given < 500"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = moved(spark)
        got = secrets.redact(docs).collect()
        rows = sum(n for k, n in moved(spark).items() if k not in before)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)

    def want(r):
        return r.text and ("é [secret] end" if "password" in r.text else r.text)

    key = lambda t: tuple(map(repr, t))
    assert sorted(((r.doc_id, r.text, r.given) for r in got), key=key) == sorted(((r.doc_id, want(r), r.given) for r in docs.collect()), key=key)
    assert 0 < rows < 500
