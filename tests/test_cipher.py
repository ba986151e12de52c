import base64

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from siv_by_hand import seal
from veilcraft.functions import cipher as cip
from veilcraft.functions.cipher import CipherKey, TokenCipher, UnusableKey

KEY = bytes(range(64))
SIZES = [1, 2, 8, 15, 16, 17, 31, 32, 33, 47, 48, 63, 64, 65, 159, 160, 161, 176, 177, 500, 1000]


def text_of(size):
    return "".join(chr(97 + (i * 7 + size) % 26) for i in range(size))


def by_hand(namespace, text):
    body = seal(KEY, [cip.TOKEN_CONTEXT, namespace.encode()], text.encode())
    return f"{namespace}:" + base64.urlsafe_b64encode(body).decode().rstrip("=")


def sealed_with(spark, key, associated, text):
    """Seal under arbitrary associated data, for the published vectors."""
    half = len(key) // 2
    mac = key[:half]
    (seed,) = cip._evaluate(spark, cip._left_block(cip._ecb(mac, cip._literal(bytes(16)))))
    whole = cip._double(seed)
    padded = cip._double(whole)
    state = cip._cmac(spark, mac, whole, padded, bytes(16))
    for item in associated:
        state = cip._xor(cip._double(state), cip._cmac(spark, mac, whole, padded, item))
    tool = TokenCipher.__new__(TokenCipher)
    tool._sub = cip._Subkeys(
        mac, key[half:], whole, padded, state, cip.closing_blocks(spark, key[half:])
    )
    column = cip._state_struct(
        *[cip._literal(b) for b in (state, cip._xor(cip._double(state), whole), cip._xor(state, whole))]
    )
    sealed = cip._evaluate(spark, tool._seal(column, cip._literal(text)))[0]
    assert cip._evaluate(spark, tool._open(column, cip._literal(sealed)))[0] == text
    return sealed.hex()


def test_published_vectors(spark):
    # RFC 5297, A.1 and A.2
    assert sealed_with(
        spark,
        bytes.fromhex("fffefdfcfbfaf9f8f7f6f5f4f3f2f1f0f0f1f2f3f4f5f6f7f8f9fafbfcfdfeff"),
        [bytes.fromhex("101112131415161718191a1b1c1d1e1f2021222324252627")],
        bytes.fromhex("112233445566778899aabbccddee"),
    ) == "85632d07c6e8f37f950acd320a2ecc9340c02b9690c4dc04daef7f6afe5c"
    assert sealed_with(
        spark,
        bytes.fromhex("7f7e7d7c7b7a79787776757473727170404142434445464748494a4b4c4d4e4f"),
        [
            bytes.fromhex("00112233445566778899aabbccddeeffdeaddadadeaddadaffeeddccbbaa99887766554433221100"),
            bytes.fromhex("102030405060708090a0"),
            bytes.fromhex("09f911029d74e35bd84156c5635688c0"),
        ],
        b"this is some plaintext to encrypt using SIV-AES",
    ) == (
        "7bdb6e3b432667eb06f4d14bff2fbd0fcb900f2fddbe404326601965c889bf17"
        "dba77ceb094fa663b7a3f748ba8af829ea64ad544a272e9c485b62a3fd5c0d"
    )


def test_tokens_for_every_size_and_namespace_form(spark, cipher):
    known = TokenCipher(spark, CipherKey(KEY), ["client-name"])
    spaces = ["a", "client-name", "n" * 16, "n" * 17, "n" * 32, "n" * 64]
    rows = [("client-name", text_of(n)) for n in SIZES] + [(ns, "value") for ns in spaces]
    rows += [("client-name", "Zoë 🎈 名前"), ("client-name", "\x00\x01")]
    df = spark.createDataFrame(rows, "ns string, t string").select(
        "ns", "t",
        cipher.encrypt_by("ns", "t").alias("computed"),
        known.encrypt_by("ns", "t").alias("known"),
        known.encrypt("client-name", "t").alias("literal"),
    )
    back = df.withColumn("plain", cipher.decrypt("computed")).collect()
    assert len(back) == len(rows)
    for row in back:
        want = by_hand(row["ns"], row["t"])
        assert row["computed"] == want and row["known"] == want
        assert row["plain"] == row["t"]
        if row["ns"] == "client-name":
            assert row["literal"] == want


def test_null_and_empty_pass(evaluate, cipher):
    assert evaluate(lambda c: cipher.encrypt("a", "t"), [None, ""]) == [None, ""]
    assert evaluate(lambda c: cipher.decrypt("t"), [None, "", "plain", "a:b"]) == [None, "", "plain", "a:b"]


def test_refuses_tokens_and_bad_namespaces(spark, evaluate, cipher):
    with pytest.raises(PySparkException, match="already contains an encrypted value"):
        evaluate(lambda c: cipher.encrypt("a", "t"), ["note:" + "A" * 22])
    with pytest.raises(PySparkException, match="Unsupported encryption namespace"):
        evaluate(lambda c: cipher.encrypt_by("t", "'x'"), ["Bad Space"])
    with pytest.raises(ValueError, match="Unsupported encryption namespace"):
        cipher.encrypt("Bad Space", "t")


def test_changed_tokens_and_wrong_keys_fail(spark, evaluate, cipher):
    token = by_hand("custom", "legacy value")
    bad = [token[:12] + ("A" if token[12] != "A" else "B") + token[13:], token + "AAAA", "other" + token[6:]]
    assert evaluate(lambda c: cipher.try_decrypt("t"), [token, *bad]) == ["legacy value", None, None, None]
    other = TokenCipher(spark, CipherKey(bytes(64)))
    assert evaluate(lambda c: other.try_decrypt("t"), [token]) == [None]
    for text in bad:
        with pytest.raises(PySparkException, match="key is wrong or the ciphertext was modified"):
            evaluate(lambda c: cipher.decrypt("t"), [text])


def test_bytes_that_are_not_utf8_fail(spark, evaluate, cipher):
    body = seal(KEY, [cip.TOKEN_CONTEXT, b"a"], b"\xff\xfe\xfd")
    token = "a:" + base64.urlsafe_b64encode(body).decode().rstrip("=")
    assert evaluate(lambda c: cipher.try_decrypt("t"), [token]) == [None]
    with pytest.raises(PySparkException, match="key is wrong"):
        evaluate(lambda c: cipher.decrypt("t"), [token])


def test_key_checks():
    good = base64.urlsafe_b64encode(KEY).decode().rstrip("=")
    assert CipherKey.from_text(f" {good}\n").raw == KEY
    assert CipherKey.from_env({"SECRET_KEY": good}).raw == KEY
    assert CipherKey.from_text(f"{good}==").raw == KEY
    for bad in ("", "A", good[:-4], "%%%", good[1:]):
        with pytest.raises(UnusableKey) as refused:
            CipherKey.from_env({"SECRET_KEY": bad})
        assert len(bad) < 5 or bad not in str(refused.value)
    with pytest.raises(UnusableKey):
        CipherKey.from_env({})
    assert "raw" not in repr(CipherKey(KEY))


def test_plans_hide_the_key(spark, cipher):
    plan = spark.range(1).select(cipher.encrypt("a", "CAST(id AS STRING)"))._jdf.queryExecution().toString()
    assert KEY[:32].hex().upper() not in plan.upper()
    assert KEY[32:].hex().upper() not in plan.upper()
