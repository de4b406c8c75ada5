import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import packing, telephony, tokenfile, tokens
from tidewatch.llm.common import documents


def slow_adpcm(block):
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for c in (byte & 15, byte >> 4):
            step = int(telephony.STEPS[index])
            move = (step >> 3) + (step >> 2 if c & 1 else 0) + (step >> 1 if c & 2 else 0) + (step if c & 4 else 0)
            value = max(-32768, min(32767, value - move if c & 8 else value + move))
            index = max(0, min(88, index + int(telephony.INDEX_STEPS[c])))
            out.append(value)
    return out


def test_tables_and_blocks():
    mu, a = telephony.TABLES["mulaw"], telephony.TABLES["alaw"]
    assert [mu[0xFF], mu[0x80], mu[0x00], mu[0x7F]] == [0, 32124, -32124, 0]
    assert [a[0xD5], a[0x55], a[0xAA], a[0x2A]] == [8, -8, 32256, -32256]
    blocks = np.random.default_rng(0).integers(0, 256, (9, 64), np.uint8)
    assert telephony.adpcm(blocks).tolist() == [slow_adpcm(bytes(b)) for b in blocks]
    assert telephony.resample(np.array([0, 100], np.int16), 8000, 16000).tolist() == [0, 50, 100, 100]


def test_media_round_trip(odd_docs, odd_rows, no_docs):
    media = telephony.store(telephony.text_payload(documents(odd_docs)))
    rows = telephony.decode(media, pcm=True).collect()
    want = []
    for i, t in odd_rows:
        raw = (t or "").encode()
        full = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        want.append((i, len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:])))
    assert sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows), key=repr) == sorted(want, key=repr)
    assert {r.feature.split()[0] for r in rows} == set(telephony.CODECS)
    assert all(zlib.crc32(r.pcm) == int(r.feature.rpartition("=")[2]) for r in rows)
    assert telephony.decode(telephony.store(telephony.text_payload(documents(no_docs)))).count() == 0
    with pytest.raises(ValueError):
        telephony.unwav(b"RIFF0000WAVE")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunks_encode_as_whole_texts(name, odd_rows):
    enc = tokens.ChunkEncoder(tokens.tokenizer_path(name))
    texts = [t or "" for _, t in odd_rows] + ["a  b", "a   b", "a \nb", "\n \nb", "don't  they're 'tis", "§ a§ ø", "İ ΣΑΣ", "a\x85b", "　a  b "]
    assert enc.batch(texts) == [enc.whole(t) for t in texts]


def test_shards_round_trip(spark, odd_docs, odd_rows, no_docs):
    path = tokens.tokenizer_path("byte_bpe_50k.json")
    shards = tokenfile.write(odd_docs, path, shard_bytes=2000)
    assert shards.count() > 5
    enc = tokens.ChunkEncoder(path)
    at, want = 0, []
    for i, t in sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = enc.whole(t or "") + b"\0\0\0\0"
        want.append((i, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    got = sorted(map(tuple, tokenfile.read_all(shards).collect()), key=lambda r: r[1])
    assert got == want
    asked = spark.createDataFrame([(3,), (11,), (5000,), (77777,), (-4,), (None,)], "doc_id long")
    found = tokenfile.lookup(shards, asked).drop("ids").collect()
    assert sorted(map(tuple, found), key=repr) == sorted((r for r in want if r[0] in (3, 11, 5000, None)), key=repr)
    assert tokenfile.read_all(tokenfile.write(no_docs, path)).count() == 0


def test_a_key_of_many_rows_goes_on_in_more_shards(spark):
    rows = [(7 if i % 3 else i, f"text {i} " * 40) for i in range(300)]
    shards = tokenfile.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), tokens.tokenizer_path("byte_bpe_50k.json"), shard_bytes=2000)
    assert max(len(r.payload) for r in shards.select("payload").collect()) < 4000
    got = tokenfile.lookup(shards, spark.createDataFrame([(7,), (9,)], "doc_id long")).collect()
    assert sorted(r.doc_id for r in got) == [7] * 200 + [9]
    assert sorted(r.start for r in tokenfile.read_all(shards).collect() if r.doc_id == 7) == sorted(r.start for r in got if r.doc_id == 7)


def test_perfect_hash_is_one_to_one():
    for n in (1, 2, 3, 10, 1000):
        hashes = [tokenfile.key_hash(i, 0)[0] for i in range(n)]
        seeds = tokenfile.perfect_hash(hashes)
        assert sorted(tokenfile.slot_of(h, int(seeds[h % len(seeds)]), n) for h in hashes) == list(range(n))


def test_packing(odd_docs, odd_rows, no_docs):
    path = tokens.tokenizer_path("word_bpe_49k.json")
    enc = tokens.ChunkEncoder(path)
    rows = packing.pack(odd_docs, path).orderBy("sequence_id").collect()
    assert [r.sequence_id for r in rows] == list(range(len(rows)))
    assert [r.length for r in rows] == sorted(r.length for r in rows)
    assert all(r.length & (r.length - 1) == 0 and r.length <= 4096 and r.offset == 0 and zlib.crc32(r.ids) == r.ids_crc32 for r in rows)
    single = {i: t for i, t in odd_rows if i != 3}
    for i, t in single.items():
        own = sorted((r.start, r.ids) for r in rows if r.doc_id == i)
        ids = enc.whole(t or "") + b"\2\0\0\0"
        assert b"".join(b for _, b in own) == ids
        assert {r.doc_tokens for r in rows if r.doc_id == i} == {len(ids) // 4}
    assert packing.pack(no_docs, path).count() == 0
    assert packing.pieces(4096 * 2 + 5) == [4096, 4096, 4, 1]


def test_only_distinct_words_are_encoded():
    enc = tokens.ChunkEncoder(tokens.tokenizer_path("byte_bpe_50k.json"))
    texts = ["an \ntwo one\ntwo one.\ntwo,$$$ \ntwo", "one$$$ one&&& one.### été.\nété one*", "x\ntwo.\n\ntwo one.\n two", "$$ one\n\n", "one's$$ one'$ $"]
    assert enc.batch(texts) == [enc.whole(t) for t in texts]
    # words with marks behind them and words at the ends of lines take no call of the whole library
    calls, whole = [], enc.learn
    enc.learn = lambda hard: calls.append(hard) or whole(hard)
    one, texts = enc.unit, ["go " + " ".join(f"word{c}{m}" for c in "abcdefgh" for m in ("", ".", "$$$", "&&&", ".%%%")), "go worda"]
    made = []
    enc.unit = lambda *a: made.append(a) or one(*a)
    assert enc.batch(texts * 3) == [enc.whole(t) for t in texts * 3]
    assert not calls and len(made) <= 13
