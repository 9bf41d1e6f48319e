"""What a task of the packing step holds at once."""

from pyspark.sql import functions as F

from voxmill.llm import interpolated_lm, shared


def test_packing_reads_small_batches(spark, tmp_path, monkeypatch):
    """A partition's texts come to the packing step in batches of a block's bytes, not all at once; scores are the same."""
    pack, log = interpolated_lm._pack, str(tmp_path / "batches")

    def spied(extra, block_bytes):
        inner = pack(extra, block_bytes)

        def run(batches):
            def seen():
                for batch in batches:
                    with open(log, "a") as f:
                        print(batch.nbytes, file=f)
                    yield batch

            yield from inner(seen())

        return run

    monkeypatch.setattr(interpolated_lm, "_pack", spied)
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(200)), lambda i: F.pmod(F.xxhash64("id", i), F.lit(500)).cast("string"))).alias("text")).coalesce(1)
    before = spark.conf.get(shared.BATCH)
    held = F.pmod("doc_id", F.lit(3)) == 0
    got = {r.doc_id: r for r in interpolated_lm.score_documents(docs, held, block_bytes=1 << 16).collect()}
    sizes = [int(x) for x in open(log)]
    assert sum(sizes) > 6 << 16 and max(sizes) < 2 << 16
    assert spark.conf.get(shared.BATCH) == before
    whole = {r.doc_id: r for r in interpolated_lm.score_documents(docs, held).collect()}
    assert got.keys() == whole.keys() and len(got) == 600
    assert all(abs(got[d].score - whole[d].score) < 1e-6 and got[d].n_tokens == 201 for d in got)
