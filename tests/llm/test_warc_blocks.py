"""The registered WARC query: archives of several blocks, and revisits found without shuffling all payloads."""

import base64
import hashlib

import pytest

from faultfold.llm import queries, warc

DATA = [(i, f"u{i}", f"{i % 40:04d}" * (100 + i % 40)) for i in range(120)]
DATA += [(120 + i, f"v{i}", "z" * i) for i in range(60)] + [(None, "n", "zz"), (None, None, None), (7, "again", DATA[7][2])]


def expected():
    best = {}
    for i, _, p in DATA:
        if i is not None:
            best[p or ""] = max(i, best.get(p or "", -1))
    out = []
    for i, _, p in DATA:
        raw, top = (p or "").encode(), best.get(p or "")
        again = top is not None and (i is None or i < top)
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out.append((i, len(raw), digest, "revisit" if again else "response", top if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("words", [1, warc.MARK_WORDS])
def test_chains_lead_from_block_to_block(spark, tmp_path, monkeypatch, words):
    """Pointer jumping finds the records of the later blocks; marks that many pages share change nothing."""
    monkeypatch.setattr(warc, "MARK_WORDS", words)
    spark.createDataFrame(DATA, "page_id long, url string, html string").coalesce(2).write.parquet(f"{tmp_path}/pages.parquet")
    seen, original = [], warc._entries

    def watched(spark, exits, blocks):
        entries = original(spark, exits, blocks)
        seen.append((blocks, entries.where("off > 0").count()))
        return entries

    monkeypatch.setattr(warc, "_entries", watched)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "6000")
    try:
        found = queries.op1_warc_chain(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((tuple(r) for r in found), key=repr) == expected()
    ((blocks, later),) = seen
    assert blocks > 2 and later > 0
