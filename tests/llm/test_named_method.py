"""The near-duplicate stage works with the groups of operator 6: fingerprints linked by their inverted index."""

from pyspark.sql import functions as F
from test_similar import near_copies, plain_groups

from lacuna.llm import similar, simhash


def test_groups_of_fingerprints_are_candidates(spark, scratch):
    docs = near_copies()
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    marked = scratch.table(similar.marks(frame, 5), "own-marks").cache()
    entries = marked.groupBy("own").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.min("fp").alias("fp"), F.array().cast("array<bigint>").alias("keys"))
    lists = {r["first"]: r["key"] for r in similar.candidates(entries, scratch).filter("band = 0").collect()}
    words = {r["first"] for r in entries.filter("n > 0").collect()}
    groups = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(frame.filter(F.col("doc_id").isin(*words)), scratch, 5).collect()}
    assert set(lists) == words and len(set(lists.values())) == len(set(groups.values())) < len(words)
    assert len({(lists[d], groups[d]) for d in words}) == len(set(lists.values()))
    own = {r["own"]: r["first"] for r in entries.collect()}
    plain, _ = plain_groups(docs)
    found = [(own[r["a"]], own[r["b"]]) for r in similar.links(entries, frame, scratch, 5, 80).collect()]
    assert found and all(plain[a] == plain[b] for a, b in found)  # without any band of MinHash
