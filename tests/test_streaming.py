import json

import pytest
from pyspark.sql import functions as F

from loamsift.operators import first_seen as FS
from loamsift.operators.minhash import signatures
from loamsift.plans.config import StreamConfig
from loamsift.streaming.dedup import BandIndex, deduplicate_stream
from tests.test_text_and_minhash import CAT, FOX, corpus, frame


def plain(sigs, config):
    b, r = config.dedup.bands
    seen, out = set(), {}
    for i in sorted(sigs):
        keys = {(k, tuple(sigs[i][k * r : k * r + r])) for k in range(b)}
        out[i] = bool(keys & seen)
        seen |= keys
    return out


def test_flags_are_check_and_insert(spark):
    docs, config = frame(spark, [*corpus(9), "", ""]), StreamConfig()
    want = plain({r.doc_id: r.signature for r in signatures(docs, config.dedup).collect()}, config)
    got = FS.first_seen(docs, config)
    assert {r.doc_id: r.is_duplicate for r in got.collect()} == want
    s = FS.stream_stats(got).first()
    assert (s.total, s.duplicates) == (len(want), sum(want.values()))


def test_batches_through_an_index(spark, tmp_path):
    texts = corpus(10)
    docs = frame(spark, texts)
    want = {r.doc_id: r.is_duplicate for r in FS.first_seen(docs).collect()}
    index, got = BandIndex(spark, str(tmp_path / "i")), {}
    for k in range(3):
        part = docs.where((F.col("doc_id") >= 20 * k) & (F.col("doc_id") < 20 * (k + 1)))
        got |= {r.doc_id: r.is_duplicate for r in index.check_and_insert(part, k).collect()}
    assert got == want
    again = index.check_and_insert(docs.where("doc_id >= 40"), 2)  # a batch that is run again
    assert {r.doc_id: r.is_duplicate for r in again.collect()} == {i: want[i] for i in range(40, 60)}
    n = index.state().count()
    index.compact()
    assert index.state().count() == n and index.parts() == [2]
    other = BandIndex(spark, str(tmp_path / "i"), StreamConfig(threshold=0.5))
    assert other.config == index.config  # what was stored wins
    index.reset()
    assert index.state().count() == 0


def test_merge_of_indexes(spark, tmp_path):
    a, b = BandIndex(spark, str(tmp_path / "a")), BandIndex(spark, str(tmp_path / "b"))
    a.check_and_insert(frame(spark, [FOX])), b.check_and_insert(frame(spark, [CAT]))
    before, added, after = a.merge(b)
    assert (before, added, after) == (8, 8, 16)
    assert {r.is_known for r in FS.probe(frame(spark, [FOX, CAT]), a.state()).collect()} == {True}
    with pytest.raises(ValueError, match="num_bands"):
        a.merge(BandIndex(spark, str(tmp_path / "c"), StreamConfig(threshold=0.5)))
    one = FS.build_state(FS.keys_of(frame(spark, [FOX])))
    with pytest.raises(ValueError, match="num_bands"):
        FS.merge_states(one, one.where("band_id < 4"))


def test_stream_is_batch(spark, tmp_path):
    texts = corpus(12, 40)
    source = tmp_path / "in"
    source.mkdir()
    index = BandIndex(spark, str(tmp_path / "index"))

    def feed():
        stream = spark.readStream.schema("doc_id long, text string, extra string").option("maxFilesPerTrigger", 1).json(str(source))
        deduplicate_stream(stream, index, str(tmp_path / "out"), str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()

    for k in (0, 1):  # stopped in between and taken up again
        (source / f"{k}.json").write_text("".join(json.dumps({"doc_id": i, "text": t, "extra": "e"}) + "\n" for i, t in enumerate(texts) if i // 20 == k))
        feed()
    out = spark.read.parquet(*(str(p) for p in (tmp_path / "out").iterdir()))
    assert set(out.columns) == {"doc_id", "text", "extra"}
    want = {r.doc_id for r in FS.first_seen(frame(spark, texts)).where("NOT is_duplicate").collect()}
    assert {r.doc_id for r in out.collect()} == want
