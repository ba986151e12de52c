"""Deterministic authenticated tokens (AES-SIV, RFC 5297) from Spark's own AES.

A token is ``namespace:base64url(SIV || ciphertext)``. The same key, namespace
and text always give the same token, so equality joins, ``groupBy`` and
``distinct`` keep working on encrypted columns of one namespace.

Everything is a column expression over ``aes_encrypt``, so the work stays in
the JVM and needs no shuffle. A call of ``aes_encrypt`` sets up a cipher and
costs far more than the arithmetic around it; the expressions are arranged to
need two calls for a text up to 160 bytes and four for a longer one, whatever
its length.
"""

from __future__ import annotations

import base64
import binascii
import itertools
import os
import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, SparkSession, functions as F

from veilcraft.functions import text as tx
from veilcraft.session import redact_keys

# --- fixed values -----------------------------------------------------------
KEY_BYTES = 64
TOKEN_CONTEXT = b"pii-xlsx-scrubber:v1"
KEY_NAME = "SECRET_KEY"
ENCRYPTED_INPUT = "Input already contains an encrypted value"
BAD_NAMESPACE = "Unsupported encryption namespace"
BAD_TOKEN = "Unable to decrypt a value: the key is wrong or the ciphertext was modified"
# ----------------------------------------------------------------------------

BLOCK = 16
_ZERO = bytes(BLOCK)
_PAD = b"\x80" + bytes(BLOCK - 1)
# Beyond this size one more cipher call costs less than XOR word by word.
_WORDWISE_BYTES = 160


class UnusableKey(ValueError):
    """No cipher can be made of this key; the text of the key is never part of the message."""


@dataclass(frozen=True)
class CipherKey:
    """A 64-byte key held by the driver: MAC half and counter half."""

    raw: bytes = field(repr=False)

    def __post_init__(self) -> None:
        if (size := len(self.raw)) != KEY_BYTES:
            raise UnusableKey(f"a key has {KEY_BYTES} bytes, this one {size}")

    @classmethod
    def from_text(cls, encoded: str) -> CipherKey:
        """The key behind URL-safe Base64, with or without its padding; characters of no alphabet do not matter."""
        text = encoded.strip().rstrip("=")
        try:
            raw = base64.b64decode(text + "=" * (-len(text) % 4), altchars=b"-_")
        except binascii.Error:
            raise UnusableKey("the key's text is no URL-safe Base64") from None
        return cls(raw)

    @classmethod
    def from_env(cls, environ: Mapping[str, str] = os.environ) -> CipherKey:
        """The key in the variable ``SECRET_KEY``; one that is unset is as good as empty."""
        return cls.from_text(environ.get(KEY_NAME, ""))

    @property
    def mac_half(self) -> bytes:
        return self.raw[: KEY_BYTES // 2]

    @property
    def counter_half(self) -> bytes:
        return self.raw[KEY_BYTES // 2 :]


def _double(block: bytes) -> bytes:
    value = int.from_bytes(block, "big") << 1
    if value >> 128:
        value ^= (1 << 128) | 0x87
    return value.to_bytes(BLOCK, "big")


def _xor(left: bytes, right: bytes) -> bytes:
    return bytes(a ^ b for a, b in zip(left, right, strict=True))


# Expressions are assembled as SQL text: a few hundred nested calls reach the JVM
# as one string instead of one call each.

_names = itertools.count()


def _literal(data: bytes) -> str:
    return f"X'{data.hex().upper()}'"


def _let(value: str, body: Callable[[str], str]) -> str:
    """Bind ``value`` to a variable so that ``body`` can use it many times but compute it once."""
    name = f"_siv{next(_names)}"
    return f"element_at(transform(array({value}), {name} -> {body(name)}), 1)"


def _evaluate(spark: SparkSession, *expressions: str) -> list[bytes]:
    """Evaluate constant expressions; folds to a local relation, so no job runs."""
    return [bytes(value) for value in spark.sql(f"SELECT {', '.join(expressions)}").first()]


def _ecb(key: bytes, data: str) -> str:
    return f"aes_encrypt({data}, {_literal(key)}, 'ECB', 'DEFAULT')"


def _cbc_last(key: bytes, data: str, size: str | int, start: str) -> str:
    """Last block of CBC over whole blocks. The output is IV, ciphertext, padding block."""
    return f"substring(aes_encrypt({data}, {_literal(key)}, 'CBC', 'DEFAULT', {start}), 1 + {size}, {BLOCK})"


def _left_block(data: str) -> str:
    return f"substring({data}, 1, {BLOCK})"


def _word(data: str, index: str | int) -> str:
    """The 8 bytes at word ``index`` as a BIGINT."""
    return f"CAST(conv(hex(substring({data}, {index} * 8 + 1, 8)), 16, -10) AS BIGINT)"


def _hex_word(value: str) -> str:
    return f"lpad(hex({value}), 16, '0')"


def _xor_words(left: str, right: str, words: str | int) -> str:
    """XOR of two binaries of ``words`` times 8 bytes."""

    def one(index: str | int) -> str:
        return _hex_word(f"{_word(left, index)} ^ {_word(right, index)}")

    if isinstance(words, int):
        return f"unhex(concat({', '.join(one(i) for i in range(words))}))"
    return f"unhex(array_join(transform(sequence(0, {words} - 1), i -> {one('i')}), ''))"


def _xor_block(left: str, right: str) -> str:
    return _xor_words(left, right, 2)


def _padded_block(data: str) -> str:
    return _left_block(f"concat({data}, {_literal(_PAD)})")


def _doubled(state: str) -> str:
    high, low = _word(state, 0), _word(state, 1)
    carried = f"shiftleft({high}, 1) | shiftrightunsigned({low}, 63)"
    reduced = f"shiftleft({low}, 1) ^ CASE WHEN {high} < 0 THEN {0x87}L ELSE 0L END"
    return f"unhex(concat({_hex_word(carried)}, {_hex_word(reduced)}))"


def _state_struct(tail: str, short: str, block: str) -> str:
    return f"named_struct('tail', {tail}, 'short', {short}, 'block', {block})"


def _encoded(data: str) -> str:
    """Unpadded URL-safe Base64. ``replace`` is several times faster than ``translate`` on long text."""
    plain = f"replace(rtrim('=', base64({data})), '\\r\\n', '')"
    return f"replace(replace({plain}, '+', '-'), '/', '_')"


def _is_token(text: str) -> str:
    return f"(rlike({text}, r'{tx.TOKEN_PATTERN}') AND (length({text}) - locate(':', {text})) % 4 <> 1)"


@dataclass(frozen=True)
class _Subkeys:
    """Values that depend on the key alone."""

    mac: bytes
    counter: bytes
    whole: bytes  # CMAC subkey for a message of whole blocks
    padded: bytes  # CMAC subkey for a padded message
    base: bytes  # doubled S2V state after the token context
    closing: bytes  # two counter-key blocks that decrypt to noise and a padding block

    @classmethod
    def derive(cls, spark: SparkSession, key: CipherKey, context: bytes = TOKEN_CONTEXT) -> _Subkeys:
        mac = key.mac_half
        (seed,) = _evaluate(spark, _left_block(_ecb(mac, _literal(_ZERO))))
        whole = _double(seed)
        padded = _double(whole)
        zero_tag, context_tag = (
            _cmac(spark, mac, whole, padded, message) for message in (_ZERO, context)
        )
        state = _xor(_double(zero_tag), context_tag)
        return cls(
            mac, key.counter_half, whole, padded, _double(state), closing_blocks(spark, key.counter_half)
        )


def closing_blocks(spark: SparkSession, key: bytes) -> bytes:
    (padding,) = _evaluate(spark, _left_block(_ecb(key, _literal(bytes([BLOCK]) * BLOCK))))
    return _ZERO + padding


def _cmac(spark: SparkSession, mac: bytes, whole: bytes, padded: bytes, message: bytes) -> bytes:
    if message and len(message) % BLOCK == 0:
        head, tail = message[:-BLOCK], _xor(message[-BLOCK:], whole)
    else:
        filled = message + _PAD[: BLOCK - len(message) % BLOCK]
        head, tail = filled[:-BLOCK], _xor(filled[-BLOCK:], padded)
    size = len(head) + BLOCK
    (tag,) = _evaluate(spark, _cbc_last(mac, _literal(head + tail), size, _literal(_ZERO)))
    return tag


class TokenCipher:
    """Column functions that seal and open tokens under one key.

    Arguments that name data are SQL expressions, such as a column name.

    A namespace enters the cipher as a *state*: a struct of the S2V state and the
    CBC start values for texts below and of exactly one block. States of known
    namespaces are literals; others are computed from the namespace column.
    """

    def __init__(self, spark: SparkSession, key: CipherKey, namespaces: Iterable[str] = ()) -> None:
        redact_keys(spark)
        self._spark = spark
        self._sub = _Subkeys.derive(spark, key)
        self._known = {name: self._derive_state(name) for name in dict.fromkeys(namespaces)}

    # -- tokens --------------------------------------------------------------

    def encrypt(self, namespace: str, text: str) -> Column:
        """Token of ``text`` in a namespace given by name.

        NULL and '' stay as they are. Text that already is a token is an error.
        """
        return F.expr(self._token(f"'{namespace}'", text, self._known_state(namespace), "true"))

    def encrypt_by(self, namespace: str, text: str, state: str | None = None) -> Column:
        """Token of ``text`` in the namespace of a column; a malformed namespace is an error.

        ``state`` is a column made by :meth:`state` beforehand, for callers that
        compute it once per namespace and join it in.
        """
        allowed = f"rlike({namespace}, r'{tx.NAMESPACE_PATTERN}')"
        return F.expr(self._token(namespace, text, state or self._state(namespace), allowed))

    def state(self, namespace: str) -> Column:
        """State of a namespace column (at most 64 ASCII characters)."""
        return F.expr(self._state(namespace))

    @property
    def knows_namespaces(self) -> bool:
        """Whether states of named namespaces are literals of every expression."""
        return bool(self._known)

    def decrypt(self, text: str, state: str | None = None) -> Column:
        """Text of a token; other text unchanged. A token that fails is an error.

        ``state`` is a column with the state of the token's namespace, made by :meth:`state` beforehand.
        """
        return F.expr(self._opened(text, strict=True, state=state))

    def try_decrypt(self, text: str, state: str | None = None) -> Column:
        """Like :meth:`decrypt`, but a token that fails becomes NULL."""
        return F.expr(self._opened(text, strict=False, state=state))

    def decrypt_each(self, texts: str, strict: bool = True, namespace: str | None = None, state: str | None = None) -> Column:
        """:meth:`decrypt` or :meth:`try_decrypt` on every element of an array.

        ``state`` serves the elements of one ``namespace``, both columns; states of others are computed.
        """
        return F.expr(f"transform({texts}, item -> {self._opened('item', strict, namespace, state)})")

    def _token(self, namespace: str, text: str, state: str, allowed: str) -> str:
        def sealed(t: str) -> str:
            body = _encoded(self._seal(state, f"CAST({t} AS BINARY)"))
            return (
                f"CASE WHEN {t} = '' THEN {t}"
                f" WHEN {_is_token(t)} THEN CAST(raise_error('{ENCRYPTED_INPUT}') AS STRING)"
                f" WHEN NOT {allowed} THEN CAST(raise_error('{BAD_NAMESPACE}: ' || {namespace}) AS STRING)"
                f" WHEN {t} IS NOT NULL THEN concat({namespace}, ':', {body}) END"
            )

        return _let(text, sealed)

    def _opened(self, text: str, strict: bool, of: str | None = None, state: str | None = None) -> str:
        def opened(t: str) -> str:
            namespace = f"substring_index({t}, ':', 1)"
            given = state or self._state(namespace)
            if state and of:
                given = f"CASE WHEN {namespace} = {of} THEN {state} ELSE {self._state(namespace)} END"
            sealed = f"unbase64(replace(replace(substring_index({t}, ':', -1), '-', '+'), '_', '/'))"
            plain = f"try_validate_utf8(CAST({self._open(given, sealed)} AS STRING))"
            if strict:
                plain = f"coalesce({plain}, CAST(raise_error('{BAD_TOKEN}') AS STRING))"
            return f"CASE WHEN {_is_token(t)} THEN {plain} ELSE {t} END"

        return _let(text, opened)

    # -- bytes in, bytes out -------------------------------------------------

    def _seal(self, state: str, data: str) -> str:
        def iv_and_text(state: str, data: str) -> str:
            return _let(
                self._synthetic_iv(state, data),
                lambda iv: f"concat({iv}, {self._apply_stream(iv, data)})",
            )

        return _let(state, lambda s: _let(data, lambda d: iv_and_text(s, d)))

    def _open(self, state: str, sealed: str) -> str:
        """The plaintext, or NULL when the synthetic IV does not match."""

        def verified(state: str, sealed: str) -> str:
            iv = _left_block(sealed)
            body = f"substring({sealed}, {BLOCK + 1}, octet_length({sealed}))"
            return _let(
                _let(body, lambda b: self._apply_stream(iv, b)),
                lambda data: f"CASE WHEN {self._synthetic_iv(state, data)} = {iv} THEN {data} END",
            )

        return _let(state, lambda s: _let(sealed, lambda b: verified(s, b)))

    # -- namespaces ----------------------------------------------------------

    def _derive_state(self, namespace: str) -> tuple[bytes, bytes, bytes]:
        if not re.fullmatch(tx.NAMESPACE_PATTERN.removesuffix(r"\z"), namespace):
            raise ValueError(f"{BAD_NAMESPACE}: {namespace}")
        sub = self._sub
        state = _xor(sub.base, _cmac(self._spark, sub.mac, sub.whole, sub.padded, namespace.encode()))
        return state, _xor(_double(state), sub.whole), _xor(state, sub.whole)

    def _known_state(self, namespace: str) -> str:
        values = self._known.get(namespace) or self._derive_state(namespace)
        return _state_struct(*[_literal(value) for value in values])

    def _state(self, namespace: str) -> str:
        computed = self._computed_state(namespace)
        if not self._known:
            return computed
        table = ", ".join(f"'{name}', {self._known_state(name)}" for name in self._known)
        return f"coalesce(try_element_at(map({table}), {namespace}), {computed})"

    def _computed_state(self, namespace: str) -> str:
        sub = self._sub
        tag = _let(f"CAST({namespace} AS BINARY)", self._mac)
        return _let(
            _xor_block(tag, _literal(sub.base)),
            lambda state: _state_struct(
                state,
                _xor_block(_doubled(state), _literal(sub.whole)),
                _xor_block(state, _literal(sub.whole)),
            ),
        )

    def _mac(self, data: str) -> str:
        """CMAC of a binary variable."""
        sub = self._sub
        size = f"octet_length({data})"
        exact = f"({size} % {BLOCK} = 0 AND {size} > 0)"
        filled = (
            f"CASE WHEN {exact} THEN {data}"
            f" ELSE concat({data}, substring({_literal(_PAD)}, 1, {BLOCK} - {size} % {BLOCK})) END"
        )
        subkey = f"CASE WHEN {exact} THEN {_literal(sub.whole)} ELSE {_literal(sub.padded)} END"

        def tagged(blocks: str) -> str:
            length = f"octet_length({blocks})"
            last = _let(subkey, lambda k: _xor_block(f"substring({blocks}, {length} - {BLOCK - 1}, {BLOCK})", k))
            message = f"concat(substring({blocks}, 1, {length} - {BLOCK}), {last})"
            return _cbc_last(sub.mac, message, length, _literal(_ZERO))

        return _let(filled, tagged)

    # -- the synthetic IV ----------------------------------------------------

    def _synthetic_iv(self, state: str, data: str) -> str:
        size = f"octet_length({data})"
        # Up to one block, CBC's own start value does the XOR.
        start = f"CASE WHEN {size} = {BLOCK} THEN {state}.block ELSE {state}.short END"
        short = _cbc_last(self._sub.mac, _padded_block(data), BLOCK, start)
        last = _xor_block(f"substring({data}, {size} - {BLOCK - 1}, {BLOCK})", f"{state}.tail")
        mixed = f"concat(substring({data}, 1, {size} - {BLOCK}), {last})"
        return f"CASE WHEN {size} <= {BLOCK} THEN {short} ELSE {_let(mixed, self._mac)} END"

    # -- the counter stream --------------------------------------------------

    def _apply_stream(self, iv: str, data: str) -> str:
        key = self._sub.counter
        size = f"octet_length({data})"
        blocks = f"CAST(({size} + {BLOCK - 1}) DIV {BLOCK} AS INT)"

        def from_start(start: str) -> str:
            """``start`` is the first counter block in hex digits."""
            short = _let(
                _ecb(key, f"unhex({start})"), lambda stream: _xor_words(_padded_block(data), stream, 2)
            )

            def with_low(low: str) -> str:
                # The cleared top bit keeps the carry inside the last 32-bit word.
                counter = f"concat(substring({start}, 1, 24), substring(hex({1 << 32}L + {low} + i), 2, 8))"
                counters = f"unhex(array_join(transform(sequence(0, {blocks} - 1), i -> {counter}), ''))"

                def applied(stream: str, filled: str) -> str:
                    return (
                        f"CASE WHEN {size} <= {_WORDWISE_BYTES} THEN {_xor_words(filled, stream, f'{blocks} * 2')}"
                        f" ELSE {self._xor_by_chaining(filled, stream, blocks)} END"
                    )

                return _let(
                    _ecb(key, counters),
                    lambda stream: _let(
                        f"concat({data}, {_literal(_PAD)})", lambda filled: applied(stream, filled)
                    ),
                )

            long = _let(f"CAST(conv(substring({start}, 25, 8), 16, 10) AS BIGINT)", with_low)
            return f"substring(CASE WHEN {size} <= {BLOCK} THEN {short} ELSE {long} END, 1, {size})"

        def clear_top(digits: str, at: int) -> str:
            return f"translate(substring({digits}, {at}, 1), '89ABCDEF', '01234567')"

        def first_counter(digits: str) -> str:
            return (
                f"concat(substring({digits}, 1, 16), {clear_top(digits, 17)}, substring({digits}, 18, 7),"
                f" {clear_top(digits, 25)}, substring({digits}, 26, 7))"
            )

        return _let(_let(f"hex({iv})", first_counter), from_start)

    def _xor_by_chaining(self, left: str, right: str, blocks: str) -> str:
        """XOR of many blocks in one CBC decryption.

        CBC decrypts a block X that follows P to D(X) XOR P. With X = E(right) the
        result is right XOR left. Left and encrypted right alternate; every second
        output block is noise and is dropped.
        """
        key = self._sub.counter

        def woven(sealed: str) -> str:
            at = f"i * {BLOCK} + 1, {BLOCK}"
            pair = f"hex(concat(substring({left}, {at}), substring({sealed}, {at})))"
            pairs = f"unhex(array_join(transform(sequence(0, {blocks} - 1), i -> {pair}), ''))"
            chain = f"concat({pairs}, {_literal(self._sub.closing)})"
            opened = f"hex(aes_decrypt({chain}, {_literal(key)}, 'CBC'))"
            return f"unhex(regexp_replace({opened}, '(.{{32}}).{{32}}', '$1'))"

        return _let(_ecb(key, right), woven)
