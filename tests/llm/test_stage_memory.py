import corpus_pipeline
from millrace.llm.common import load

SF = "/root/testdata/sf0.001"


def full_collections(spark):
    """Of the JVM, which in local mode is the executor's too."""
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())


def test_each_stage_begins_with_the_heaps_given_back(spark):
    none = load(spark, SF, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        before = full_collections(spark)
        assert stage(spark, none, SF).columns[0] == "doc_id"
        assert full_collections(spark) > before, name
