"""Binary and text containers of private keys, told by their grammar.

DER (PKCS#1, DSA, SEC 1, PKCS#8 plain and encrypted, PKCS#12), OpenSSH, Java key stores and
PuTTY files. A container must parse as far as its key; a leading magic number alone is none.
"""

from __future__ import annotations

import re
import struct

_SEQUENCE, _INTEGER, _OCTETS = 0x30, 0x02, 0x04
#: Fixed value: the object identifiers of password-based encryption (1.2.840.113549.1.5).
_PBES = b"\x06\x09\x2a\x86\x48\x86\xf7\x0d\x01\x05"
_PUTTY = re.compile(rb"PuTTY-User-Key-File-\d: [\w@.-]+\r?\nEncryption: [\w-]+\r?\n(?:[\w-]+: [^\n]*\n|[A-Za-z0-9+/=]+\r?\n)*?Private-Lines: [1-9]\d*\r?\n[A-Za-z0-9+/=]{16,}")


def _der(data: bytes, at: int = 0) -> tuple[int, int, int] | None:
    """Tag, start and end of the content of the DER element at ``at``."""
    if at + 2 > len(data):
        return None
    tag, n, start = data[at], data[at + 1], at + 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or start + k > len(data):
            return None
        n, start = int.from_bytes(data[start : start + k]), start + k
    return (tag, start, start + n) if start + n <= len(data) else None


def _der_key(data: bytes) -> bool:
    outer = _der(data)
    if not outer or outer[0] != _SEQUENCE or outer[2] - outer[1] < 40:
        return False
    parts, at = [], outer[1]
    while at < outer[2] and len(parts) < 12:
        part = _der(data, at)
        if not part:
            return False
        parts.append(part)
        at = part[2]
    tags = [p[0] for p in parts]
    number = lambda p: int.from_bytes(data[p[1] : p[2]]) if p[2] - p[1] < 3 else -1
    first = number(parts[0]) if tags[0] == _INTEGER else None
    if first == 0 and len(tags) >= 9 and set(tags) <= {_INTEGER, _SEQUENCE} or first == 0 and tags == [_INTEGER] * 6:
        return True  # RSA, DSA
    if first == 1 and tags[:2] == [_INTEGER, _OCTETS] or first in (0, 1) and tags[:3] == [_INTEGER, _SEQUENCE, _OCTETS]:
        return True  # SEC 1, PKCS#8
    if first == 3 and tags[:2] == [_INTEGER, _SEQUENCE]:
        return True  # PKCS#12
    return tags == [_SEQUENCE, _OCTETS] and data[parts[0][1] :].startswith(_PBES)


def _openssh_key(data: bytes) -> bool:
    """Magic, three strings (cipher, derivation, its options), the number of keys, and that many public keys and one private part."""
    at = len(b"openssh-key-v1\0")

    def string() -> bytes | None:
        nonlocal at
        if at + 4 > len(data):
            return None
        n = int.from_bytes(data[at : at + 4])
        at += 4 + n
        return data[at - n : at] if at <= len(data) else None

    cipher, derivation, options = string(), string(), string()
    if options is None or not re.fullmatch(rb"[a-z0-9@.-]+", cipher) or not re.fullmatch(rb"[a-z0-9@.-]+", derivation) or at + 4 > len(data):
        return False
    keys = int.from_bytes(data[at : at + 4])
    at += 4
    return 1 <= keys <= 64 and all(string() for _ in range(keys)) and bool(string())


def _java_store(data: bytes) -> bool:
    """Magic, version 1 or 2, the number of entries, and an entry of a private or secret key at the head."""
    if len(data) < 18:
        return False
    version, entries, kind, name = struct.unpack(">IIIH", data[4:18])
    return version in (1, 2) and entries >= 1 and kind in (1, 3) and name > 0 and 18 + name < len(data)


def private_key(data: bytes) -> bool:
    """Whether bytes are a container of a private key."""
    if data.startswith(b"openssh-key-v1\0"):
        return _openssh_key(data)
    if data[:4] in (b"\xfe\xed\xfe\xed", b"\xce\xce\xce\xce"):
        return _java_store(data)
    return bool(_PUTTY.match(data)) or _der_key(data)
