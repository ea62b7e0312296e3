"""64-bit names of byte strings, strong enough that a name stands for its string.

A string is read eight bytes at a time; each step mixes them into all 64 bits, one to one for a given
state, so strings of up to eight bytes of one length never meet. A string above ``SHORT`` bytes takes
a cryptographic digest. No family of strings (as Thue-Morse strings are for polynomials modulo 2^64)
has equal names beyond chance.
"""

import hashlib

import numpy as np

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Odd multipliers.
R1, R2, R3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
SHORT = 256
#: Masks of the first 0 to 8 bytes of a little-endian word.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def names_of(data: bytes, starts: np.ndarray, sizes: np.ndarray, turn: int = 0) -> np.ndarray:
    """A name for each of the non-empty strings ``data[start : start + size]``.

    Names of another ``turn`` are independent.
    """
    name = mixed((sizes.astype(np.uint64) + np.uint64(turn << 48)) * R3)
    if not len(starts):
        return name
    words = np.ndarray((len(data) + 1,), "<u8", data + bytes(8), strides=(1,))
    at = np.arange(len(starts))
    for done in range(0, min(int(sizes.max()), SHORT), 8):
        if done:
            at = at[sizes[at] > done]
        left = np.minimum(sizes[at] - done, 8)
        chunk = words[starts[at] + done] & _FIRST[left]
        name[at] = mixed((name[at] ^ chunk) * R1 + R2)
    for i in np.flatnonzero(sizes > SHORT).tolist():
        text = data[int(starts[i]) : int(starts[i] + sizes[i])]
        digest = hashlib.blake2b(text, digest_size=8, salt=bytes([turn])).digest()
        name[i] = int.from_bytes(digest, "little")
    return name
