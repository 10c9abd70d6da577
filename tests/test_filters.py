import hashlib
import tracemalloc
import zlib

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import crypt, filters


@given(st.binary(max_size=200), st.integers(0, 4), st.integers(1, 9), st.integers(1, 4), st.sampled_from([8, 16]))
def test_predictors_undo(data, kind, columns, colors, bits):
    width = (columns * colors * bits + 7) // 8
    whole = data + bytes(-len(data) % width)
    assert filters.unpredict(filters.predict(whole, kind, columns, colors, bits), 15, columns, colors, bits) == whole


@pytest.mark.parametrize(
    ("kind", "rows", "expected"),
    [
        (1, [[1, 1, 2, 3, 4], [1, 255, 2, 0, 1]], [[1, 3, 6, 10], [255, 1, 1, 2]]),
        (2, [[2, 1, 2, 3, 4], [2, 255, 1, 1, 1]], [[1, 2, 3, 4], [0, 3, 4, 5]]),
        (3, [[0, 10, 20, 30, 40], [3, 1, 1, 1, 1]], [[10, 20, 30, 40], [6, 14, 23, 32]]),
        (4, [[0, 10, 20, 30, 40], [4, 1, 1, 1, 1]], [[10, 20, 30, 40], [11, 21, 31, 41]]),
    ],
)
def test_predictor_vectors(kind, rows, expected):
    assert filters.unpredict(bytes(sum(rows, [])), 15, 4) == bytes(sum(expected, []))


def test_predictor_errors():
    assert filters.unpredict(b"abc", 1) == b"abc"
    assert filters.unpredict(b"\0ab", 15, 4) == b"ab\0\0"
    for data, predictor in ((b"\0ab", 12), (b"\5abcd", 15), (b"x", 2)):
        with pytest.raises(filters.FilterError):
            filters.unpredict(data, predictor, 4)


def test_deflate():
    assert filters.inflate(zlib.compress(b"x" * 99) + b" \n") == b"x" * 99
    assert filters.deflate(b"") is not None and zlib.decompress(filters.deflate(b"x" * 500)) == b"x" * 500
    for bad in (b"junk", zlib.compress(b"x") + b"!"):
        with pytest.raises(filters.FilterError):
            filters.inflate(bad)


def test_rc4_vectors():
    assert crypt.rc4(b"Key", b"Plaintext").hex().upper() == "BBF316E8D940AF0AD3"
    assert crypt.rc4(b"Wiki", b"pedia").hex().upper() == "1021BF0420"


def test_keys():
    for revision, bits in ((2, 40), (3, 128)):
        key = crypt.document_key(b"secret", b"o" * 32, -4, b"id", revision, bits)
        assert len(key) == bits // 8
        stored = crypt.user_hash(key, b"id", revision)
        assert crypt.password_fits(key, stored.ljust(32, b"\0"), b"id", revision)
        other = crypt.document_key(b"wrong", b"o" * 32, -4, b"id", revision, bits)
        assert not crypt.password_fits(other, stored.ljust(32, b"\0"), b"id", revision)
    assert crypt.object_key(b"12345", 1, 0, False) == hashlib.md5(b"12345\1\0\0\0\0").digest()[:10]


def test_aes_and_rc4_columns(spark):
    key = b"0123456789abcdef"
    df = spark.createDataFrame([(7, 0, key, b"some stream")], "n int, g int, k binary, d binary")
    made = crypt.object_key_column(F.col("k"), F.col("n"), F.col("g"), True)
    sealed = df.withColumn("e", F.aes_encrypt("d", made, F.lit("CBC"), F.lit("PKCS")))
    row = sealed.select(crypt.aes_stream_column(F.col("e"), F.col("k"), F.col("n"), F.col("g")).alias("p"), made.alias("ok"), crypt.object_key_column(F.col("k"), F.col("n"), F.col("g"), False).alias("rk")).first()
    assert bytes(row.p) == b"some stream"
    assert bytes(row.ok) == crypt.object_key(key, 7, 0, True) and bytes(row.rk) == crypt.object_key(key, 7, 0, False)
    back = df.select(crypt.rc4_udf(crypt.rc4_udf("d", "k"), "k").alias("d")).first()
    assert bytes(back.d) == b"some stream"


def test_running_sums_read_every_byte(spark):
    texts = ["é" * 200 + "tail", "", "abc", "x" * 5000, None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", *[filters.running_digest_udf(k, 16, 3)(F.col("t").cast("binary")).alias(n) for k, n in ((1, "sub"), (2, "up"))])
    digest = lambda b: hashlib.md5(bytes(b).hex().upper().encode()).hexdigest() if b else None
    for r in df.collect():
        b = (r.t or "").encode()
        assert r.sub == digest([sum(b[j] for j in range(i // 48 * 48, i + 1) if j % 3 == i % 3) % 256 for i in range(len(b))])
        assert r.up == digest([sum(b[i % 48 : i + 1 : 48]) % 256 for i in range(len(b))])


@given(st.binary(max_size=200), st.integers(0, 4), st.integers(1, 9), st.integers(1, 4), st.sampled_from([8, 16]))
def test_predicting_by_parts(data, kind, columns, colors, bits):
    whole, most = filters.predict(data, kind, columns, colors, bits), filters.PREDICTED
    filters.PREDICTED = 40
    try:
        assert filters.predict(data, kind, columns, colors, bits) == whole
    finally:
        filters.PREDICTED = most


def test_predicting_takes_little_room():
    data = bytes(range(256)) * (1 << 15)
    for kind in range(5):
        tracemalloc.start()
        made = filters.predict(data, kind, 16)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(made) == len(data) * 17 // 16 and peak < 5 * len(data)
