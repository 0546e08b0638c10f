"""The pipeline over the smallest tables, stage by stage."""

import gc
import time

import corpus_pipeline

from tessella.llm.session import let_go


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, held = docs.columns, docs
    sizes = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        held = stage(spark, held, sf_dir).cache()
        assert held.columns == columns
        sizes.append(held.count())
    n = docs.count()
    assert 0 < sizes[1] <= sizes[0] <= n and sizes[2] == sizes[1] and sizes[3] > 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near copies", "secrets", "mixing", "packing"]


def test_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(x.startswith(f"op{n}_") for x in names) for n in range(1, 11))


def test_rounds_give_back_what_the_jvm_freed(spark):
    """Memory of the driver's JVM outside its heap, freed but for its last blocks, lies with the machine again after let_go()."""
    held = lambda: sum(int(x.split()[1]) for x in open(f"/proc/{spark._jvm.ProcessHandle.current().pid()}/smaps_rollup") if x.startswith("Pss_Anon"))
    blocks = [spark._jvm.java.nio.ByteBuffer.allocateDirect(100_000) for _ in range(2000)]
    full = held()
    last = blocks[::50]  # so that what is free lies between blocks in use
    del blocks
    for _ in range(3):
        gc.collect()
        time.sleep(0.3)  # py4j tells the JVM by and by
        let_go(spark)
    assert held() < full - 100_000 and last
