"""Repeated and null ids through what the operators write and return."""

import base64
import hashlib
from collections import Counter

import pytest

from loomgraph.llm import queries, sharding

ROWS = [(1, "abcd"), (1, "abcd"), (1, "x" * 9), (None, "null id"), (None, None), (2, "b")]


def test_written_shards_hold_every_row(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "length(text) AS n_chars")
    given = sharding.write_shards(docs, f"file://{tmp_path}/s", 50)
    assert given.columns == ["doc_id", "shard", "depth", "n_bytes", "oversized"] and given.count() == len(ROWS)
    back = spark.read.schema("doc_id long, text string, n_chars int, shard string").parquet(f"file://{tmp_path}/s").collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter(ROWS)
    told = Counter((r.doc_id, r.shard, r.n_bytes) for r in given.collect())
    assert Counter((r.doc_id, r.shard or "", len(r.text or "") + 16) for r in back) == told  # the other two columns count 8 bytes each
    with pytest.raises(ValueError):
        sharding.write_shards(docs, f"file://{tmp_path}/t", 0)


@pytest.mark.parametrize("odd", [False, True])
def test_warc_query_returns_the_ids(spark, tmp_path, odd):
    pages = [(7, "http://a", "same"), (9, "http://b", "same"), (12, "http://c", "other"), (30, None, None)]
    pages += [(9, "http://d", "third"), (None, "http://e", "fourth"), (None, "http://f", "fifth"), (None, "http://g", "fifth")] if odd else []
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"file://{tmp_path}/pages.parquet")
    got = queries.op7_warc(spark, f"file://{tmp_path}").collect()
    digests = {base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(): h for _, _, h in pages}
    assert Counter((r.page_id, digests[r.payload_digest], r.payload_bytes) for r in got) == Counter((i, h, len(h or "")) for i, _, h in pages)
    revisits = Counter((r.page_id, r.refers_to) for r in got if r.record_type == "revisit")
    assert revisits == Counter([(7, 9), (None, None)] if odd else [(7, 9)])
    assert all(r.refers_to is None for r in got if r.record_type == "response")
