"""A slow, independent AES-SIV for checking the Spark expressions on small data."""


def _times(a, b):
    product = 0
    while b:
        if b & 1:
            product ^= a
        a = (a << 1) ^ (0x11B if a & 0x80 else 0)
        b >>= 1
    return product


def _sbox():
    table = []
    for value in range(256):
        inverse = next((c for c in range(256) if _times(value, c) == 1), 0)
        spread = inverse
        for turn in range(1, 5):
            spread ^= ((inverse << turn) | (inverse >> (8 - turn))) & 0xFF
        table.append(spread ^ 0x63)
    return table


SBOX = _sbox()


def _schedule(key):
    words = [list(key[i : i + 4]) for i in range(0, len(key), 4)]
    size, rcon = len(words), 1
    while len(words) < 4 * (size + 7):
        last = list(words[-1])
        if len(words) % size == 0:
            last = [SBOX[b] for b in last[1:] + last[:1]]
            last[0] ^= rcon
            rcon = _times(rcon, 2)
        elif size > 6 and len(words) % size == 4:
            last = [SBOX[b] for b in last]
        words.append([a ^ b for a, b in zip(words[-size], last)])
    return [sum(words[i : i + 4], []) for i in range(0, len(words), 4)]


def block(key, data):
    keys = _schedule(key)
    state = [a ^ b for a, b in zip(data, keys[0])]
    for number, round_key in enumerate(keys[1:], start=1):
        state = [SBOX[state[(i + 4 * (i % 4)) % 16]] for i in range(16)]
        if number < len(keys) - 1:
            mixed = []
            for c in range(0, 16, 4):
                w = state[c : c + 4]
                mixed += [
                    _times(w[i], 2) ^ _times(w[(i + 1) % 4], 3) ^ w[(i + 2) % 4] ^ w[(i + 3) % 4]
                    for i in range(4)
                ]
            state = mixed
        state = [a ^ b for a, b in zip(state, round_key)]
    return bytes(state)


def _xor(a, b):
    return bytes(x ^ y for x, y in zip(a, b))


def _double(data):
    value = int.from_bytes(data, "big") << 1
    return (value ^ ((1 << 128 | 0x87) if value >> 128 else 0)).to_bytes(16, "big")


def _cmac(key, data):
    first = _double(block(key, bytes(16)))
    full = bool(data) and len(data) % 16 == 0
    if not full:
        data = data + b"\x80" + bytes(-(len(data) + 1) % 16)
    mask = first if full else _double(first)
    data = data[:-16] + _xor(data[-16:], mask)
    tag = bytes(16)
    for i in range(0, len(data), 16):
        tag = block(key, _xor(tag, data[i : i + 16]))
    return tag


def seal(key, associated, text):
    mac, counter = key[: len(key) // 2], key[len(key) // 2 :]
    state = _cmac(mac, bytes(16))
    for item in associated:
        state = _xor(_double(state), _cmac(mac, item))
    if len(text) >= 16:
        last = text[:-16] + _xor(text[-16:], state)
    else:
        last = _xor(_double(state), text + b"\x80" + bytes(15 - len(text)))
    iv = _cmac(mac, last)
    start = int.from_bytes(iv, "big") & ~(1 << 63) & ~(1 << 31)
    stream = b"".join(
        block(counter, (start + i).to_bytes(16, "big")) for i in range((len(text) + 15) // 16)
    )
    return iv + _xor(text, stream)
