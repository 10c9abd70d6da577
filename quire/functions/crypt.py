"""Reading encrypted documents: keys, RC4, and AES by Spark's own function."""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

# Fixed value: the padding of short passwords
PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def rc4(key: bytes, data: bytes) -> bytes:
    box, j = list(range(256)), 0
    for i in range(256):
        j = (j + box[i] + key[i % len(key)]) & 255
        box[i], box[j] = box[j], box[i]
    out, i, j = bytearray(len(data)), 0, 0
    for n, b in enumerate(data):
        i = (i + 1) & 255
        j = (j + box[i]) & 255
        box[i], box[j] = box[j], box[i]
        out[n] = b ^ box[(box[i] + box[j]) & 255]
    return bytes(out)


def _field() -> tuple[np.ndarray, list[np.ndarray]]:
    """The cipher's inverse substitution, and multiplication tables by 14, 11, 13 and 9 in its field of 256 elements."""

    def times(a: int, b: int) -> int:
        out = 0
        while b:
            out ^= a if b & 1 else 0
            a = (a << 1) ^ (0x11B if a & 0x80 else 0)
            b >>= 1
        return out

    power, inverse, x = [1], [0] * 256, 1
    for _ in range(254):
        x = times(x, 3)
        power.append(x)
    for k, x in enumerate(power):
        inverse[x] = power[-k % 255]
    turn = lambda v, n: (v << n | v >> (8 - n)) & 255
    forward = [v ^ turn(v, 1) ^ turn(v, 2) ^ turn(v, 3) ^ turn(v, 4) ^ 0x63 for v in inverse]
    back = np.zeros(256, np.uint8)
    back[forward] = np.arange(256, dtype=np.uint8)
    return back, [np.array([times(v, k) for v in range(256)], np.uint8) for k in (14, 11, 13, 9)]


_BACK, _TIMES = _field()


def _round_keys(key: bytes) -> np.ndarray:
    forward = np.argsort(_BACK)  # the substitution itself
    words, constant = [list(key[i : i + 4]) for i in range(0, 16, 4)], 1
    for k in range(4, 44):
        last = words[-1]
        if k % 4 == 0:
            last = [int(forward[b]) for b in last[1:] + last[:1]]
            last[0] ^= constant
            constant = (constant << 1) ^ (0x11B if constant & 0x80 else 0)
        words.append([a ^ b for a, b in zip(words[-4], last, strict=True)])
    return np.array(words, np.uint8).reshape(11, 16)


def aes(key: bytes, data: bytes) -> bytes:
    """AES-128-CBC with the vector in the first block and padding in the last; all blocks at once. ValueError for damaged data."""
    if len(data) % 16 or len(data) < 32:
        raise ValueError("sealed data isn't whole blocks")
    blocks, keys = np.frombuffer(data, np.uint8).reshape(-1, 16), _round_keys(key)
    shift = np.array([(k - 4 * (k % 4)) % 16 for k in range(16)])  # bytes stand column by column, rows turn to the right
    x = blocks[1:] ^ keys[10]
    for r in range(9, -1, -1):
        x = _BACK[x[:, shift]] ^ keys[r]
        if r:
            columns = x.reshape(-1, 4, 4)
            x = np.stack([_TIMES[-row % 4][columns[:, :, 0]] ^ _TIMES[(1 - row) % 4][columns[:, :, 1]] ^ _TIMES[(2 - row) % 4][columns[:, :, 2]] ^ _TIMES[(3 - row) % 4][columns[:, :, 3]] for row in range(4)], axis=2).reshape(-1, 16)
    out = (x ^ blocks[:-1]).tobytes()
    if not 1 <= out[-1] <= 16 or out[-out[-1] :] != bytes([out[-1]]) * out[-1]:
        raise ValueError("sealed data has no proper padding")
    return out[: -out[-1]]


def document_key(password: bytes, owner: bytes, permissions: int, first_id: bytes, revision: int, bits: int = 40) -> bytes:
    size = bits // 8 if revision >= 3 else 5
    key = hashlib.md5((password + PAD)[:32] + owner + struct.pack("<I", permissions & 0xFFFFFFFF) + first_id).digest()
    if revision >= 3:
        for _ in range(50):
            key = hashlib.md5(key[:size]).digest()
    return key[:size]


def user_hash(key: bytes, first_id: bytes, revision: int) -> bytes:
    """What the document stores for the user's password; of the longer form only the first 16 bytes are compared."""
    if revision < 3:
        return rc4(key, PAD)
    out = hashlib.md5(PAD + first_id).digest()
    for i in range(20):
        out = rc4(bytes(b ^ i for b in key), out)
    return out


def password_fits(key: bytes, stored: bytes, first_id: bytes, revision: int) -> bool:
    n = 32 if revision < 3 else 16
    return user_hash(key, first_id, revision)[:n] == stored[:n]


def object_key(key: bytes, objnum: int, gennum: int, aes: bool) -> bytes:
    made = hashlib.md5(key + struct.pack("<I", objnum)[:3] + struct.pack("<I", gennum)[:2] + b"sAlT" * aes).digest()
    return made if aes else made[: min(len(key) + 5, 16)]


def object_key_column(key: Column, objnum: Column, gennum: Column, aes: bool) -> Column:
    """object_key() as an expression; numbers are turned low byte first."""
    low = lambda x, n: F.concat(*[F.unhex(F.lpad(F.hex(F.shiftright(x, 8 * i).bitwiseAND(255)), 2, "0")) for i in range(n)])
    made = F.unhex(F.md5(F.concat(key, low(objnum, 3), low(gennum, 2), F.lit(b"sAlT" if aes else b""))))
    return made if aes else F.substring(made, F.lit(1), F.least(F.length(key) + 5, F.lit(16)))


def aes_stream_column(data: Column, key: Column, objnum: Column, gennum: Column) -> Column:
    """AES-128-CBC with the vector in the first block; null where the data can't be read."""
    return F.try_aes_decrypt(data, object_key_column(key, objnum, gennum, True), F.lit("CBC"), F.lit("PKCS"))


@F.pandas_udf(BinaryType())
def rc4_udf(data: pd.Series, key: pd.Series) -> pd.Series:
    return pd.Series([None if d is None or k is None else rc4(bytes(k), bytes(d)) for d, k in zip(data, key, strict=True)])
