import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.llm import extendible_sharding, segment_bpe, warc_index
from graphloom.llm.segment_bpe import Codec, Vocabulary
from graphloom.llm.warc_index import LoserTree

PATH = public_tokenizers.path("byte_bpe_50k.json")
PAGES = "page_id bigint, url string, html string, run string, url_key int"


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 20)), max_size=9))
def test_loser_tree_merges(runs):
    assert list(LoserTree([sorted(r) for r in runs], lambda x: x)) == sorted(x for r in runs for x in r)


def test_loser_tree_is_stable():
    assert [x for x in LoserTree([[(1, "a")], [(1, "b")], [(0, "c"), (1, "d")]], lambda x: x[0])] == [(0, "c"), (1, "a"), (1, "b"), (1, "d")]


def test_archives(spark, tmp_path):
    big, odd = "x" * 120, "WARC/1.1\r\n\r\nfake\r\n\r\n" + "é" * 100
    rows = [
        (5, "http://b.org/x", big), (3, "http://b.org/x", big), (9, None, big), (1, "http://a.org/\r\nX: y", "small"), (2, "not a url", "small"), (4, "https://a.org/?q=1", None),
        (6, "http://A.org/é", odd), (7, "http://a.org/long", "<p>" * 300_000), (3, "http://b.org/x", big), (None, "http://n.org", big), (8, "", ""),
    ]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], PAGES)
    out = warc_index.capture_index(df.repartition(3), str(tmp_path / "warc")).collect()
    assert len(out) == len(rows)
    by = {}
    for i, _, html in rows:
        data = (html or "").encode()
        by.setdefault(i, []).append((len(data), hashlib.sha256(data).hexdigest()))
    for r in out:
        assert (r.payload_bytes, r.payload_digest) in by[r.page_id]
    kinds = {(r.page_id, r.record_type, r.refers_to) for r in out}
    assert {(3, "response", None), (5, "revisit", 3), (9, "revisit", 3), (None, "revisit", 3), (1, "response", None), (2, "response", None), (4, "response", None), (8, "response", None)} <= kinds
    order = [(r.url_key.encode(), r.capture_ts) for r in out]
    assert order == sorted(order) and out[0].url_key in ("", ")")
    one = next(r for r in out if r.page_id == 6)
    data = (tmp_path / "warc" / one.run).read_bytes()[one.record_offset : one.record_offset + one.record_bytes]
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: response") and odd.encode() in data and data.endswith(b"\r\n\r\n")
    assert warc_index.capture_index(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="digest"):
        list(warc_index.parse_archive("x", (tmp_path / "warc" / one.run).read_bytes().replace("é".encode() * 100, "è".encode() * 100)))


def test_archives_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc_index, "ARCHIVE_BYTES", 40_000)
    monkeypatch.setattr(warc_index, "SMALL_BYTES", 4_000)
    monkeypatch.setattr(warc_index, "ROWS_PER_MERGE", 40)
    rng = random.Random(6)
    sizes = [rng.choice([0, 50, 200, 3000, 9000, 30_000, 90_000]) for _ in range(300)]
    rows = [(i, f"http://h{i % 7}.org/{i % 3}", "".join(rng.choice("abc") for _ in range(20)) * (n // 20), "x", 1) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows + [(None, "http://h1.org/0", "same", "x", 1)] * 90, PAGES)
    out = warc_index.capture_index(df.repartition(2), str(tmp_path / "w")).collect()
    assert len(out) == 390 and sorted(r.page_id for r in out if r.page_id is not None) == list(range(300))
    order = [(r.url_key.encode(), r.capture_ts) for r in out]
    assert order == sorted(order)
    by_file = {}
    for r in out:
        by_file.setdefault(r.run, []).append(r.record_bytes)
    assert len(by_file) > 10 and all(sum(b) <= 41_000 or len(b) == 1 for b in by_file.values())


def test_bpe_like_the_library():
    from tokenizers import Tokenizer

    library, codec = Tokenizer.from_file(PATH), Codec(Vocabulary(PATH))
    rng = random.Random(2)
    bits = ["a", "the", "ing", " ", "  ", "\n", "\t", "'s", "'ll", "é", "日本", "12", "!", "?!", "\xa0", "　", "\x1c", "​", "<|endoftext|>", "<|end", "\U0001f600", "\x85", "\r\n", "²", "é", "Ġ", "A"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(30))) for _ in range(1500)] + ["", " ", "a" * 3000, " " * 700, "ab" * 900, "!" * 400]
    for text, ids in zip(texts, codec.encode(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids == ",".join(map(str, want))
        assert codec.decode(ids) == library.decode(want, skip_special_tokens=False)
    assert codec.decode("220,126") == library.decode([220, 126], skip_special_tokens=False)


def test_long_words_like_the_library():
    from tokenizers import Tokenizer

    library, rng = Tokenizer.from_file(PATH), random.Random(5)
    texts = ["ab" * 30_000, "".join(rng.choice("etaoinshr") for _ in range(50_000)), "é日" * 3000, "=" * 5000, "x" * 2048]
    for text, ids in zip(texts, Codec(Vocabulary(PATH)).encode(texts)):
        assert ids == ",".join(map(str, library.encode(text, add_special_tokens=False).ids))


def test_other_schemes_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        Vocabulary(public_tokenizers.path("word_bpe_49k.json"))


@settings(max_examples=30, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=40), min_size=1, max_size=20))
def test_segment_tree_merges_the_leftmost_lowest_rank(words):
    vocab = _vocab()
    ranks = {k: (r, vocab.merged[r]) for k, r in zip(vocab.pair_keys.tolist(), vocab.ranks.tolist())}
    for word, got in zip(words, segment_bpe.encode_words(words, vocab)):
        ids = vocab.byte_id[np.frombuffer(word, np.uint8)].tolist()
        while True:
            options = [(ranks[a << 32 | b][0], i) for i, (a, b) in enumerate(zip(ids, ids[1:])) if a << 32 | b in ranks]
            if not options:
                break
            i = min(options)[1]
            ids[i : i + 2] = [int(ranks[ids[i] << 32 | ids[i + 1]][1])]
        assert got.tolist() == ids


_cached = []


def _vocab():
    if not _cached:
        _cached.append(Vocabulary(PATH))
    return _cached[0]


def test_bpe_columns(spark):
    df = spark.createDataFrame([(1, "hello world", "x"), (2, None, "y"), (2, None, "y"), (3, "", "z"), (4, "a\U0001f600 " * 5000, "w")], "doc_id bigint, text string, n_tokens string")
    out = {r.doc_id: r for r in segment_bpe.round_trip(df, PATH).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert (out[2].n_tokens, out[2].ids_sha256, out[2].decoded_sha256) == (0, empty, empty) and out[1].n_tokens == 2
    assert out[4].decoded_sha256 == hashlib.sha256(("a\U0001f600 " * 5000).encode()).hexdigest()
    both = segment_bpe.decode(segment_bpe.encode(df, PATH), PATH).orderBy("doc_id").collect()
    assert [r.decoded for r in both] == ["hello world", "", "", "", "a\U0001f600 " * 5000] and both[0].ids == [31373, 995]
    assert segment_bpe.round_trip(df.limit(0), PATH).count() == 0


def bits(key):
    return int(hashlib.md5(("" if key is None else str(key)).encode()).hexdigest()[:15], 16)


def test_shards(spark):
    rng = random.Random(4)
    rows = [(i, rng.randrange(200)) for i in range(3000)] + [(5000, 9000), (None, 3), (None, None)] + [(77777, 40)] * 100
    df = spark.createDataFrame(rows, "doc_id bigint, n bigint").withColumns({"p": F.lit(1), "depth": F.lit("clash"), "h": F.lit(0)})
    limit = 1000
    out = extendible_sharding.shard(df, "doc_id", F.col("n"), limit)
    assert out.count() == len(rows)
    sizes = out.groupBy("shard_depth", "shard_prefix", "shard_page").agg(F.sum("shard_bytes").alias("n"), F.count("*").alias("c")).collect()
    assert all(r.n <= limit or r.c == 1 for r in sizes)  # only the row of 9000 bytes is over
    total = lambda depth, prefix: sum(n or 0 for k, n in rows if bits(k) >> (60 - depth) == prefix)
    for r in random.Random(1).sample(out.collect(), 60):
        assert bits(r.doc_id) >> (60 - r.shard_depth) == r.shard_prefix
        if r.shard_depth:  # its bucket was split because the parent was too large
            assert total(r.shard_depth - 1, r.shard_prefix >> 1) > limit
    assert extendible_sharding.shard(df.limit(0), "doc_id", F.col("n"), limit).count() == 0
    # pages of a key that alone is over the limit: half full at least, but for the last of each part
    pages = out.where("doc_id = 77777").groupBy("shard_page").agg(F.sum("shard_bytes").alias("n")).orderBy("shard_page").collect()
    assert [r.shard_page for r in pages] == list(range(len(pages))) and 4 <= len(pages) <= 4 + 3 * 9
    mixed = spark.createDataFrame([(1, 99)] + [(1, 1)] * 200 + [(1, 51), (1, 50)], "doc_id bigint, n bigint").repartition(2)
    got = extendible_sharding.shard(mixed, "doc_id", F.col("n"), 100).groupBy("shard_page").agg(F.sum("n").alias("n"), F.count("*").alias("c")).collect()
    assert sum(r.c for r in got) == 203 and max(r.n for r in got) <= 100 and 4 <= len(got) <= 10 and {r.shard_page for r in got} == set(range(len(got)))
    with pytest.raises(ValueError, match="begin with"):
        extendible_sharding.shard(df.withColumn("shard_page", F.lit(1)), "doc_id", F.col("n"), limit)
    whole = extendible_sharding.shard(df, "doc_id", F.col("n"), 1 << 30).select("shard_depth").distinct().collect()
    assert [r.shard_depth for r in whole] == [0]


def test_shards_on_disk(spark, tmp_path):
    df = spark.createDataFrame([(i, 10) for i in range(100)], "doc_id bigint, n bigint")
    extendible_sharding.write_shards(extendible_sharding.shard(df, "doc_id", F.col("n"), 300), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 100
