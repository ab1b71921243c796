"""Credentials that are longer, deeper or further apart than usual."""

from __future__ import annotations

import base64
import random
import struct
import time

import pytest

from lodestone.llm import credentials

B64 = lambda s: base64.b64encode(s if isinstance(s, bytes) else s.encode()).decode()
NOISE = random.Random(5).randbytes(60_000)
BODY = [B64(NOISE[i : i + 48]) for i in range(0, 48_000, 48)]
PEM, END = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
STORE = b"\xfe\xed\xfe\xed" + struct.pack(">IIIH", 2, 1, 1, 4) + b"main" + NOISE
URL = "postgres://app:zX81kkQp@db.example.invalid/x"


def nested(value, n):
    for _ in range(n):
        value = B64(value)
    return value


WHOLE = {
    "long block": ("const k = `" + "\n".join([PEM, *BODY, END]) + "`\nf()\n", [BODY[0], BODY[600], BODY[-1]], "`\nf()\n"),
    "cut off, long": (PEM + "\n" + "\n".join(BODY) + "\n\nconst a = 1\n", [BODY[0], BODY[600], BODY[-1]], "\n\nconst a = 1\n"),
    "cut off, pieces": (f"const k = '{PEM}\\n' +\n" + " +\n".join(f"  '{line}\\n'" for line in BODY[:6]) + "\nexport const verifyPrivateKey = 1\n", BODY[:6], "'\nexport const verifyPrivateKey = 1\n"),
    "cut off before another": (f"a = '{PEM}\\n{BODY[0]}\\n{BODY[1]}'\nconst between = read(1)\nb = '{PEM}\\n{BODY[2]}\\n{END}'\n", BODY[:3], "'\n"),
    "template": ("const k = `" + "\n".join(B64(STORE)[i : i + 76] for i in range(0, 60_000, 76)) + "`\nf()\n", [B64(STORE)[:70]], "`\nf()\n"),
    "stray backtick": (f"// don`t\nf('{B64(URL)}')\ng(`x`)\n", [B64(URL)], "')\ng(`x`)\n"),
    "continued template": ("const key = `" + "\\\n".join([B64(STORE)[:100]]) + "\\\n`\nf()\n", [B64(STORE)[:100]], "`\nf()\n"),
    "named": (f"const password = '{'aZ4+' * 2_000}q7'\n", ["aZ4+aZ4+"], "'\n"),
    "address": (f"u = 'amqp://app:{'kP3x' * 100}@broker.invalid'\n", ["kP3xkP3x"], "@broker.invalid'\n"),
    "name before": (f"const {'veryLong' * 12}Password = 'zX81kkQp!w9'\n", ["zX81kkQp"], "'\n"),
    "name behind": (f"const secret{'OfTheNextStage' * 4}Token = 'zX81kkQp!w9'\n", ["zX81kkQp"], "'\n"),
    "deep": (f"const a = '{nested('password = zX81kkQp!w9', 8)}'\n", [nested("password = zX81kkQp!w9", 8)], "'\n"),
    "run in a sentence": (f"log('sent {B64(URL)} to it')\n", [B64(URL)], " to it')\n"),
    "unquoted": (f"send {B64(URL)}\n", [B64(URL)], "\n"),
    "unquoted block": ("data: |\n" + "".join(f"  {B64(STORE)[i : i + 76]}\n" for i in range(0, 760, 76)) + "next: 1\n", [B64(STORE)[:70]], "\nnext: 1\n"),
    "joined": (f"f('{B64(URL)[:20]}' + '{B64(URL)[20:]}')\n", [B64(URL)[:20], B64(URL)[20:]], "')\n"),
}


@pytest.mark.parametrize("name", WHOLE)
def test_nothing_of_a_long_credential_stays(name):
    code, gone, rest = WHOLE[name]
    clean = credentials.redact(code, credentials.find(code, "a.ts"))
    assert credentials.MARK in clean and not [x for x in gone if x in clean]
    assert clean.endswith(rest) and clean.count("\n") == code.count("\n") and ("between" not in code or "const between = read(1)\n" in clean)


@pytest.mark.parametrize("code", [f"if (s.startsWith('{PEM}')) f()\n" + "for (const row of rows) out.push(prepare(row, limit))\n" * 800 + f"if (s.endsWith('{END}')) g()\n"])
def test_mentions_far_apart_are_no_key(code):
    assert credentials.find(code, "a.ts") == []


@pytest.mark.parametrize("code", ["`" + "\\`" * 100_000, "`x" * 100_001, "const password = '" + "ab-" * 100_000 + "'", f"'{PEM}' " * 4_000, "a" * 300_000 + "://b:", "key" * 100_000, "a://b:c" * 40_000, "(" * 50_000 + "'x'" + ")" * 1_000], ids=range(8))
def test_odd_long_texts_take_linear_time(code):
    began = time.thread_time()
    credentials.find(code, "deploy/.env")
    assert time.thread_time() - began < 10
