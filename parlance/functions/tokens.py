"""Authenticated encryption tokens by built-in functions: version, time, vector, AES-CBC text, HMAC-SHA256.

The layout is the published one of such tokens: byte 0x80, seconds as 64 bits, 16 bytes of vector, the padded
ciphertext, 32 bytes of HMAC over all before; base64 with ``-`` and ``_``. A key is 32 bytes: the first half
signs, the second encrypts. The signature is checked before anything is decrypted.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: First byte, inner and outer pad, block and digest bytes; fixed values.
VERSION, INNER, OUTER, BLOCK, DIGEST, VECTOR, HEAD = "80", 0x36, 0x5C, 64, 32, 16, 9


def _padded(key: Column, pad: int) -> Column:
    """The key, filled up with zeros to a block, with every byte xor ``pad``."""
    spelled = F.rpad(F.hex(key), 2 * BLOCK, "0")
    value = lambda i: F.conv(F.substring(spelled, 2 * i + 1, F.lit(2)), 16, 10).cast("int").bitwiseXOR(F.lit(pad))
    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(BLOCK - 1)), lambda i: F.lpad(F.hex(value(i)), 2, "0")), ""))


def hmac_sha256(key: Column, message: Column) -> Column:
    """HMAC of a binary column; keys of up to 64 bytes."""
    inner = F.unhex(F.sha2(F.concat(_padded(key, INNER), message), 256))
    return F.unhex(F.sha2(F.concat(_padded(key, OUTER), inner), 256))


def _halves(key: Column) -> tuple[Column, Column]:
    return F.substring(key, F.lit(1), F.lit(16)), F.substring(key, F.lit(17), F.lit(16))


def sealed(text: Column, key: Column, at: Column, vector: Column | None = None) -> Column:
    """The token of a text at a time in seconds; null stays null. A vector must never come twice under a key."""
    sign, own = _halves(key)
    vector = F.unhex(F.replace(F.uuid(), F.lit("-"), F.lit(""))) if vector is None else vector
    head = F.concat(F.unhex(F.lit(VERSION)), F.unhex(F.lpad(F.hex(at.cast("long")), 16, "0")))
    body = F.concat(head, F.aes_encrypt(text.cast("binary"), own, F.lit("CBC"), F.lit("PKCS"), vector))
    return F.translate(F.base64(F.concat(body, hmac_sha256(sign, body))), "+/\r\n", "-_")  # without line breaks


def unsealed(token: Column, key: Column, now: Column | None = None, seconds: int | None = None) -> Column:
    """The text of a token; null where it is not whole, not signed with the key, or older than ``seconds`` at ``now``."""
    sign, own = _halves(key)
    raw = F.try_to_binary(F.translate(token, "-_", "+/"), F.lit("base64"))
    size = F.octet_length(raw)
    body, mac = F.substring(raw, F.lit(1), size - DIGEST), F.substring(raw, size - DIGEST + 1, F.lit(DIGEST))
    good = (size >= HEAD + 2 * VECTOR + DIGEST) & ((size - HEAD - DIGEST) % 16 == 0) & (F.hex(F.substring(raw, F.lit(1), F.lit(1))) == VERSION) & (mac == hmac_sha256(sign, body))
    if seconds is not None:
        good = good & (F.conv(F.hex(F.substring(raw, F.lit(2), F.lit(8))), 16, 10).cast("long") + seconds >= now.cast("long"))
    return F.try_aes_decrypt(F.when(good, F.substring(body, F.lit(HEAD + 1), size - HEAD - DIGEST)), own, F.lit("CBC"), F.lit("PKCS")).cast("string")
