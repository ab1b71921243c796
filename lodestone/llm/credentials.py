"""Credentials in source code and configuration: where they begin, and the code without them.

A text is scanned in layers. Layer 0 is the text itself; every literal and every encoded run of a
layer, inside or outside of quotes, is decoded from base64, hex, percent signs, backslash escapes
or arrays of bytes to the next layer, until nothing is left to decode. Each layer is read as a key
container by the container's grammar and is scanned by one and the same scanner: a value is judged
by its own form (private keys, provider tokens, signed web tokens), by its place in a URL, header
or connection text, by the name, call or comparison it is given to, or by the comment that holds it
or stands beside it. What is found inside a layer counts where the enclosing literal or run of the
text stands, and that is redacted.
"""

from __future__ import annotations

import base64
import binascii
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import containers

MARK = "REDACTED"

#: Forms of tokens that name their own kind.
_TOKENS = re.compile(
    r"(?<![A-Za-z0-9_-])(?:"
    r"(?:AKIA|ASIA)[0-9A-Z]{16}"
    r"|(?:sk|rk|qk|ak)_(?:live|prod|test)_[A-Za-z0-9]{16,}"
    r"|sk-[A-Za-z0-9_-]{20,}"
    r"|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{40,}|glpat-[A-Za-z0-9_-]{18,}"
    r"|xox[abposr]-[A-Za-z0-9-]{16,}"
    r"|AIza[0-9A-Za-z_-]{35}|ya29\.[0-9A-Za-z_-]{20,}"
    r"|npm_[A-Za-z0-9]{30,}|pypi-[A-Za-z0-9_-]{40,}|dop_v1_[0-9a-f]{40,}|hf_[A-Za-z0-9]{30,}"
    r"|SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}|shp(?:at|ss|ca|pa)_[0-9a-fA-F]{32}"
    r"|[a-z]{2,5}[-_](?:[a-z]{2,6}[-_])?(?=[a-z0-9]*[A-Z])(?=[A-Z0-9]*[a-z])(?=[A-Za-z]*[0-9])[A-Za-z0-9]{32,}"
    r")(?![A-Za-z0-9_])"
)
_JWT = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{16,}")
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
#: The body of a key without its END line: what may stand between two runs of base64, the runs, the headers before them.
_BETWEEN = re.compile(r"(?:\s|\\+(?:[nrt]|\r?\n)|(?:[#>*|]|//)(?=[ \t]*[A-Za-z0-9+/])|(?<=[\s'\"`])\+\s|['\"`]\s*(?:[+,.\\]\s*)?[rRbBuUfF]{0,2}['\"`])*+")
_RUN64 = re.compile(r"[A-Za-z0-9+/]++={0,2}(?![ \t]*[(:{]|[ \t]*=|\.[A-Za-z]|[\w$])")
_LAST64 = re.compile(r"[A-Za-z0-9+/]++={0,2}(?=[ \t]*(?:\r?\n|\\|['\"`]|\Z))")
_KEY_HEADER = re.compile(r"(?:Proc-Type|DEK-Info|Version|Comment|Hash|Charset|MessageID): [^\n\\'\"`]*")
_USERINFO = re.compile(r"(?<=[a-zA-Z0-9+.-]{2})://[^\s:/@'\"`<>]*:([^\s/@'\"`]{3,})@[\w.$\[{-]")
_PARAMETER = re.compile(r"[?&;](?:[\w.-]*?(?:sig|signature|token|api[_-]?key|apikey|access[_-]?key|secret|password|passwd|pwd|credential|auth|key))=([^&\s'\"`#;<>]{6,})", re.I)
_HEADER = re.compile(r"\b(Bearer|Basic|Token|ApiKey)\s+([A-Za-z0-9+/=_.~-]{8,})")
#: A template literal does not open at an escaped sign; so at most one of a text, the last, is looked for in vain.
_QUOTE = r"[rRbBuUfF]{0,2}['\"`]"
_TEMPLATE = r"(?<!\\)`((?:[^`\\]|\\[\s\S])*+)`"
_STRING = rf"""(?:[rRbBuUfF]{{0,2}})(?:'''((?:[^'\\]|\\.|'(?!''))*+)'''|\"\"\"((?:[^"\\]|\\.|"(?!""))*+)\"\"\"|'((?:[^'\\\n]|\\.)*)'|"((?:[^"\\\n]|\\.)*)"|{_TEMPLATE})"""
_LITERAL = re.compile(rf"""'((?:[^'\\\n]|\\.){{8,}})'|"((?:[^"\\\n]|\\.){{8,}})"|{_TEMPLATE}""")
_QUOTED = re.compile(r"""'((?:[^'\\\n]|\\.){8,})'|"((?:[^"\\\n]|\\.){8,})\"""")
_JOIN = re.compile(r"\s*(?:\+|\.(?=\s*['\"]))\s*(?=['\"`])")
#: Literals side by side are one in Python; pieces of a list may be joined by an empty literal.
_BESIDE_JOIN = re.compile(r"[ \t]*(?:\\?\r?\n[ \t]*)?(?=[rRbBuUfF]{0,2}['\"])")
_LIST = re.compile(rf"(?:''|\"\")\.join\(\s*\[\s*(?={_QUOTE})|\[\s*(?={_QUOTE})")
_LIST_NEXT, _LIST_END = re.compile(rf"\s*,\s*(?={_QUOTE})"), re.compile(r"\s*,?\s*\](?:\s*\)|\s*\.join\(\s*(?:''|\"\"|``)\s*\))")
_OCTETS = re.compile(r"(?<=[\[({])\s*(?:0[xX][0-9a-fA-F]{1,2}|[0-9]{1,3})(?:\s*,\s*(?:0[xX][0-9a-fA-F]{1,2}|[0-9]{1,3})){7,}+\s*,?\s*(?=[\])}])")
_ENCODED = re.compile(r"[A-Za-z0-9+/_%\\-]{16,}+={0,2}")
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{16,}+(?:[ \t]*+\\?+\r?\n[ \t]*+[A-Za-z0-9+/]++(?=={0,2}[ \t]*(?:\\?\r?\n|['\"`]|\Z)))++={0,2}")
_ONE = re.compile(_STRING)
_SECRET_WORD = r"pass(?:wd|word|phrase|code)?|pwd?|secret|token|key|credentials?|auth|dsn|pin"
_SECRET = re.compile(_SECRET_WORD, re.I)
_TO = r"(?:Buffer\.from\(\s*|(?:new\s+)?[\w.]*(?:[sS]ecret|[kK]ey|[bB]ytes|[sS]tr|[sS]tring|Encoder\(\)\.encode)\(\s*)?"
_NAMED = re.compile(rf"(?<![\w$.-])([\"']?)([A-Za-z_$][\w$.-]*+)\1\s*+(?:[?!]?:\s*[A-Za-z_][\w<>\[\]| ]*+\s*=|\]\s*(?:\?\?|\|\|)?=|(?:\?\?|\|\||&&)=|:=|=>|[:=](?!=)|[)\]]*\s*(?:\?\?|\|\||\bor\b)|[!=]==?|\.(?:equals|compareTo|endsWith)\()\s*+{_TO}(?=[\[({{]*\s*{_QUOTE})")
#: A call with literals: what is done, or the name that its first argument holds, tells what the others are.
_CALL = re.compile(r"(?<![\w$])([A-Za-z_$][\w$]*+)\s*\(\s*(?=[rRbBuUfF]{0,2}['\"])")
_ARGUMENT_NEXT = re.compile(r"\s*,\s*(?:[\w]+\s*[=:]\s*)?(?=[rRbBuUfF]{0,2}['\"`])")
_ENTER = re.compile(r"(?:log|sign)_?(?:in|on)|authenticate|basic_?auth|(?:set|with|use|add|make|new)_?(?:basic_?)?credentials?|credentials?|connect|UsernamePassword\w*|HTTP\w+Auth", re.I)
_PAIR = re.compile(r"\b(?:auth|credentials?|creds|login)\s*[=:]\s*[(\[]\s*(?=['\"])", re.I)
#: What is entered is compared with a literal, or the branch lets one in.
_COMPARED = re.compile(r"(?:===?|\.equals\()\s*(?=['\"])")
_GIVEN = re.compile(r"(?:given|entered|supplied|provided|typed|submitted|candidate|attempt|guess|answer)\w*\s*\Z", re.I)
_LETS_IN = re.compile(r"\s*\)*\s*[:{]?\s*(?:return\s+)?[\w$.]{0,80}?(?:unlock|open|grant|allow|admit|authori[sz]e|authenticate|log_?in|sign_?in|elevate|enable_?admin)", re.I)
_ARGUMENT = re.compile(r"['\"](?:--?(?:p|pw|pass|passwd|password|token|secret|api-?key|auth|access-?key))['\"]\s*,\s*(?=['\"])")
_CONNECTION = re.compile(r"(?:(?:^|[\"'`;?\s])(?:server|data source|host|addr|user id|uid|user|username|endpoint|defaultendpointsprotocol|accountname|sharedaccesskeyname|initial catalog|database|port)\s*=[^;\"'`\n]*;(?:[^\"'`\n]*?;)??\s*|(?<=;)\s*)(?:password|pwd|accountkey|sharedaccesskey|secret|token)\s*=\s*([^;\"'`\s]{4,})(?=[;\"'`\s]|\Z)", re.I)
_SHELL = re.compile(r"\b(?:curl|wget|http)\b[^\n]*?\s(?:-u|--user)[ =]?['\"]?[\w.@-]+:([^\s'\"]{4,})|\bmysql\w*\b[^\n]*?\s-p([^\s'\"]{6,})|\bsshpass\s+-p\s*['\"]?([^\s'\"]{4,})")
_ELEMENT = re.compile(r"<([A-Za-z][\w:.-]*)>([^<>\s]{6,})</\1>")
#: A comment that says who enters where and with what.
_REMARK = re.compile(r"(?://|#|/\*|<!--|--|^[ \t]*\*)([^\n]*)", re.M)
_ASKS = re.compile(r"\b(?:log[- ]?in|sign[- ]?in|passw(?:or)?d|pwd?|credentials?|creds|pass ?phrase|secret|token|api[ _-]?key|account|access)\b[^\n:='\"`]{0,80}(?:[:=]|\bis\b)[ \t]*(?:([\w.@+-]++)(?:[ \t]+[/|][ \t]+|[ \t]*[,:][ \t]+))?\Z", re.I)
_FLAG = re.compile(r"--(?:pass|passwd|password|token|secret|api-?key|auth-?token)[= ]([^\s'\"`,;)]{6,})")
_BESIDE = re.compile(rf"(?:{_STRING})[^'\"`\n]*?(?:,\s*['\"](?:hex|base64|utf-?8|ascii)['\"])?[ \t,;)\]}}]*(?://|#|/\*)(?P<note>[^\n]*)")
_COMMENT = re.compile(r"\b(?:(?:api|aes|hmac|des|rsa|signing|encryption|account|access|secret|private|storage|master|shared|service|deploy|session|client|license)[ _-]*(?:\w+[ _-])?keys?|passwords?|passwd|secrets?|tokens?|credentials?|passphrase)\b", re.I)
_PUBLIC = re.compile(r"\bpublic\b|\bchecksum|\bdigest|\bhash\b|\bexample\b|\bsample\b|\bformat\b|\bplaceholder\b", re.I)
_PLAIN = re.compile(r"^[ \t]*(?:-[ \t]+)?(?:export[ \t]+|set[ \t]+|ENV[ \t]+)?([A-Za-z_][\w.-]*)[ \t]*[:=][ \t]*([^\s'\"`#][^\n#]*?)[ \t]*\r?$", re.M)
_PYTHON = re.compile(r"\.pyi?$", re.I)
_SENTENCE = re.compile(r"\b(?:the|your|you|is|are|to|for|and|or|not|please|enter|must|this|that|with|from|into|of|in|on|at|by|an?)\b", re.I)
_UNQUOTED = re.compile(r"(?:\.(?:env|ya?ml|ini|cfg|conf|properties|toml|sh|bash|tfvars)|(?:^|/)\.env[\w.]*|(?:^|/)Dockerfile[\w.]*|\.env\.[\w]+)$", re.I)

#: Words of a name that make it a secret's, and words that make it something about one.
_STRONG = frozenset("password passwd pass passphrase passcode pwd pw secret secrets token credential credentials dsn pgpassword apikey authtoken".split())
_QUALIFIED = frozenset("api access secret private signing sign encryption encrypt decryption master shared auth client account hmac aes storage service session deploy license jwt cookie webhook crypto ssh root admin app".split())
_ABOUT = frozenset(
    "min max length len ttl rotation store field pattern name names path file files url uri endpoint id ids count size type kind regex format hash digest checksum sha sha1 sha256 sha512 md5 commit integrity public label"
    " prompt hint title text message placeholder header prefix suffix policy expiry expires lifetime timeout strength reset help description column param parameter attempts usage limit scope scopes algorithm alg issuer version provider manager enabled required input".split()
)
_WORDS = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_DUMMY = re.compile(
    r"change[-_ ]?me|^(?:your|my|insert|enter)[-_ ].*|[-_]here$|x{6,}|\*{3,}|\.{3,}|example|sample|dummy|placeholder|redacted|^(?:todo|tbd|fixme|none|null|undefined|true|false|default|secret|password|passwd|token|test|admin|root|guest|foobar|foo|bar|qwerty|abc123|123456\d*)$|^0+$|1234567890|^[-_]+$"
    r"|^<.*>$|^\$|^\{|^%|\$\{|\{\{|\}\}|^@|^\[.*\]$|#\{|^not[-_]",
    re.I,
)
_ELSEWHERE = re.compile(r"^(?:vault|file|env|ssm|secret|secrets|sops|op|kms|ref|arn|gcp|aws|azure|keychain|keyring|config|gs|s3|https?|projects)[:/]|^process\.|^os\.|^\.{0,2}/|^~/|^[A-Za-z]:\\", re.I)
_WORDLIKE = re.compile(r"[A-Z]?[a-z]+(?:[-_ /:][A-Z]?[a-z]+|\.[a-z]+)*|[A-Z]+(?:[-_ .][A-Z0-9]+)*|[a-z]+(?:[A-Z][a-z]+)+")
_VOWELLESS = re.compile(r"(?<![a-zA-Z])[b-df-hj-np-tv-xzy]{7,}(?![a-zA-Z])")
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_B64 = re.compile(r"[A-Za-z0-9+/]{16,}={0,2}|[A-Za-z0-9_-]{16,}={0,2}")
_HEX = re.compile(r"(?:[0-9a-fA-F]{2}){8,}")
_ESCAPED = re.compile(r"\\(?:x([0-9a-fA-F]{2})|u\{?([0-9a-fA-F]{4,6})\}?|([0-3]?[0-7]{2})|([nrt0\\'\"/`]|\r?\n))")
_BREAKS = {"n": "\n", "r": "\r", "t": "\t", "0": "\0", "\n": "", "\r\n": ""}


def _base64_like(value: str) -> bool:
    """Whether what begins like a path is rather base64."""
    return bool(re.fullmatch(r"/[A-Za-z0-9+/]{29,}={0,2}", value)) and entropy(value) > 4 and bool(re.search(r"[+=]", value))


def entropy(value: str) -> float:
    """Bits per sign."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


@lru_cache(maxsize=20_000)
def secret_name(name: str) -> int:
    """0: no secret's name; 1: only for values that look random; 2: a secret's name."""
    words = [w.lower() for w in _WORDS.findall(name)]
    while words and words[-1].isdigit():
        words.pop()
    if not words or words[-1] in _ABOUT or any(w in ("public", "pattern", "regex", "integrity", "checksum") for w in words):
        return 0
    if any(w in _STRONG for w in words[-2:]):
        return 2
    if words[-1] in ("key", "keys", "auth", "pin"):
        return 2 if any(w in _QUALIFIED for w in words[:-1]) else 1
    return 0


def plausible(value: str, random: bool = False) -> bool:
    """Whether a literal can be a secret's value, and with ``random`` looks like drawn signs."""
    if len(value) < 6 or re.search(r"\s", value) or _DUMMY.search(value) or _ELSEWHERE.match(value) and not _base64_like(value) or "://" in value:
        return False
    if _WORDLIKE.fullmatch(value) and not _VOWELLESS.search(value) or re.fullmatch(r"[\d.:,-]{1,7}|\d+(?:ms|s|m|h|d)?", value):
        return False
    if len(set(value)) <= 3:
        return False
    if not random:
        return True
    return len(value) >= 16 and entropy(value) >= 3.0 and bool(re.search(r"\d", value) or len(value) >= 24) and not _UUID.fullmatch(value) and not value.startswith(("sha1-", "sha256-", "sha384-", "sha512-", "sha256:", "md5:"))


def _unescaped(m: re.Match) -> str:
    if m[4] is not None:
        return _BREAKS.get(m[4], m[4])
    code = int(m[3], 8) if m[3] else int(m[1] or m[2], 16)
    return chr(code) if code < 0x110000 else "\0"


def layers(value: str) -> Iterator[bytes]:
    """The bytes that a literal stands for under each encoding it fits."""
    if "\\" in value:
        plain = _ESCAPED.sub(_unescaped, value)
        if plain != value:
            yield plain.encode("latin-1") if all(ord(c) < 256 for c in plain) else plain.encode(errors="replace")
    if value.count("%") >= 2 and re.search(r"%[0-9a-fA-F]{2}", value):
        yield unquote_to_bytes(value)
    bare = re.sub(r"\s+", "", value)
    if "," in bare:
        numbers = [int(x, 0) if x[:2] in ("0x", "0X") else int(x) for x in bare.split(",") if re.fullmatch(r"0[xX][0-9a-fA-F]{1,2}|[0-9]{1,3}", x)]
        if len(numbers) >= 8 and len(numbers) == len(bare.rstrip(",").split(",")) and max(numbers) < 256:
            yield bytes(numbers)
    elif _HEX.fullmatch(bare):
        yield bytes.fromhex(bare)
    elif len(bare) >= 16 and _B64.fullmatch(bare):
        body = bare.rstrip("=").replace("-", "+").replace("_", "/")
        if len(body) % 4 != 1:
            try:
                yield base64.b64decode(body + "=" * (-len(body) % 4))
            except (ValueError, binascii.Error):
                pass


def _runs(text: str) -> list[tuple[int, int]]:
    """Spans of encoded runs, also of those broken into lines, and of arrays of bytes."""
    runs = [(m.start(), m.start() + len(m.group().rstrip("\\"))) for m in _ENCODED.finditer(text)] + [m.span() for m in _WRAPPED.finditer(text)]
    return runs + [m.span() for m in _OCTETS.finditer(text)] if "," in text else runs


def _readable(data: bytes) -> str | None:
    """The text that decoded bytes are, if they are one."""
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return None
    return text if len(text) >= 6 and sum(c.isprintable() or c in "\n\r\t" for c in text) >= 0.97 * len(text) else None


def hidden(value: str) -> bool:
    """Whether some layer inside a literal or run holds a credential. Each layer is shorter than the one around it."""
    waiting, seen = [value], {value}
    while waiting:
        for data in layers(waiting.pop()):
            if containers.private_key(data):
                return True
            text = _readable(data)
            if text is None:
                continue
            if next(_scanned(text, True, True), None):
                return True
            for inner in (text, *(text[a:b] for a, b in _runs(text)), *(v for v, _, _ in _literals(text) if len(v) >= 16)):
                if inner not in seen:
                    seen.add(inner)
                    waiting.append(inner)
    return False


def _key_like(body: str) -> bool:
    """Whether the text between BEGIN and END lines is a key's rather than code that stands between two mentions."""
    return 2 * sum(map(len, re.findall(r"[A-Za-z0-9+/=]{20,}", body))) >= len(body)


def _cut_off(text: str, at: int, stop: int) -> int:
    """Where the body of a key that has no END line ends; its runs may be lines or joined pieces."""
    end = at
    while head := _KEY_HEADER.match(text, _BETWEEN.match(text, end, stop).end(), stop):
        end = head.end()
    while True:
        start = _BETWEEN.match(text, end, stop).end()
        run = _RUN64.match(text, start, stop)
        if not run or len(run.group()) < 16:
            last = _LAST64.match(text, start, stop)
            return last.end() if last and end > at else end
        end = run.end()


def _private_keys(text: str) -> Iterator[tuple[int, int]]:
    """Spans of private keys in text form, up to their END line if there is one before the next BEGIN."""
    begins, ends = list(_PEM.finditer(text)), list(_PEM_END.finditer(text))
    starts = [m.start() for m in ends]
    for k, m in enumerate(begins):
        border = begins[k + 1].start() if k + 1 < len(begins) else len(text)
        i = bisect_left(starts, m.end())
        end = ends[i] if i < len(ends) and starts[i] < border else None
        body = re.sub(r"\\[nr]|[\s\\'\"+,]", "", text[m.end() : end.start()]) if end else ""
        if end and _key_like(body):
            stop = end.end()
        else:
            stop = _cut_off(text, m.end(), end.start() if end else border)
            body = re.sub(r"\\[nr]|[\s\\'\"+,]", "", text[m.end() : stop])
        if len(re.findall(r"[A-Za-z0-9+/=]", body)) >= 40 and not _DUMMY.search(body[:20]):
            yield m.start(), stop


def _formed(text: str) -> Iterator[tuple[int, int]]:
    """Spans that their own form, a URL or a header gives away."""
    if "PRIVATE KEY" in text:
        yield from _private_keys(text)
    for m in _TOKENS.finditer(text):
        if not _DUMMY.search(m.group()) and entropy(m.group()) > 2.5 and (m.group()[:4] in ("AKIA", "ASIA") or re.search(r"\d|[a-z].*[A-Z]|[A-Z].*[a-z]", m.group()[4:])):
            yield m.span()
    if "eyJ" in text:
        for m in _JWT.finditer(text):
            yield m.span()
    if "://" in text:
        for m in _USERINFO.finditer(text):
            if not re.match(r"\$|\{|<|%[({]|\*{2,}|:|x{3,}$", m.group(1)) and not _DUMMY.search(m.group(1)) and m.group(1).lower() not in ("pass", "user"):
                yield m.span(1)
    for m in _PARAMETER.finditer(text):
        if plausible(m.group(1), True):
            yield m.span(1)
    for m in _HEADER.finditer(text):
        value = m.group(2)
        if m.group(1) == "Basic":
            try:
                pair = base64.b64decode(value + "=" * (-len(value) % 4)).decode()
            except (ValueError, UnicodeDecodeError):
                continue
            if ":" in pair and len(pair.split(":", 1)[1]) >= 3 and not _DUMMY.search(pair.split(":", 1)[1]):
                yield m.span(2)
        elif plausible(value, True):
            yield m.span(2)
    for m in _FLAG.finditer(text):
        if plausible(m.group(1)):
            yield m.span(1)
    if ";" in text and re.search("(?:password|pwd|key|secret|token)[ \t]*=", text, re.I):
        for m in _CONNECTION.finditer(text):
            if plausible(m.group(1)) or _base64_like("/" + m.group(1)):
                yield m.span(1)
    if re.search(" -u|--user|mysql|sshpass", text):
        for m in _SHELL.finditer(text):
            k = m.lastindex
            if not _DUMMY.search(m.group(k)) and len(set(m.group(k))) > 3 and not m.group(k).startswith(("$", "<", "{")):
                yield m.span(k)
    if "</" in text:
        for m in _ELEMENT.finditer(text):
            kind = secret_name(m.group(1))
            if kind and plausible(m.group(2), kind == 1):
                yield m.span(2)


def _joined(text: str, at: int, beside: bool = False) -> tuple[str, int, int] | None:
    """The string literal at ``at`` with those joined to it, or a joined list of them: value, start and end of what to redact."""
    pieces = _LIST.match(text, at)
    first = _ONE.match(text, pieces.end() if pieces else at)
    if not first:
        return None
    group = first.lastindex
    value, start, end, m = first.group(group), first.start(group), first.end(group), first
    while True:
        gap = (_LIST_NEXT if pieces else _JOIN).match(text, m.end()) or beside and not pieces and _BESIDE_JOIN.match(text, m.end())
        following = gap and _ONE.match(text, gap.end())
        if not following:
            break
        m = following
        value, end = value + m.group(m.lastindex), m.end(m.lastindex)
    return None if pieces and not _LIST_END.match(text, m.end()) else (value, start, end)


@lru_cache(maxsize=20_000)
def _callee(name: str) -> tuple[bool, int]:
    """Whether a call enters or sets credentials, and of what kind its name is."""
    return bool(_ENTER.fullmatch(name)), secret_name(name) if _SECRET.search(name) else 0


def _phrase(name: str, value: str) -> bool:
    """Whether a value of words is a secret: several of them, for a name that asks for such a one, and no sentence."""
    words = re.split(r"[ -]", value)
    last = [w.lower() for w in _WORDS.findall(name) if not w.isdigit()][-1:]
    wanted = 4 if last in (["passphrase"], ["mnemonic"], ["phrase"], ["seed"]) and " " in value else 3 if last and last[0] in ("password", "passwd", "passphrase", "passcode", "pwd") and "-" in value else 99
    return len(words) >= wanted and all(w.isalpha() and w.islower() and len(w) > 2 for w in words) and not _SENTENCE.search(value) and not _SECRET.search(value) and not _DUMMY.search(value)


def _named(text: str, plain: bool, beside: bool = False) -> Iterator[tuple[int, int]]:
    """Spans that a name, call, comparison or comment gives away; ``plain``: also without quotes; ``beside``: literals side by side are one."""
    for m in _NAMED.finditer(text):
        kind = _SECRET.search(m.group(2)) and secret_name(m.group(2)) or m.group(2).rsplit(".", 1)[-1] in ("mnemonic", "seedPhrase", "seed_phrase") and 2
        if not kind:
            continue
        at = re.compile(r"[({]*\s*").match(text, m.end()).end()
        found = _joined(text, at, beside)
        if found:
            value, start, end = found
            if (plausible(value, kind == 1) or _phrase(m.group(2), value)) and not (text[start - 1] == "`" and "${" in value):
                yield start, end
    for m in _ARGUMENT.finditer(text):
        if (found := _joined(text, m.end(), beside)) and plausible(found[0]):
            yield found[1], found[2]
    for m in _CALL.finditer(text):
        enters, kind = _callee(m.group(1))
        following = _ONE.match(text, m.end())
        values, first = [], following
        while following:
            values.append(following.span(following.lastindex))
            gap = _ARGUMENT_NEXT.match(text, following.end())
            following = gap and _ONE.match(text, gap.end())
        if not first or len(values) == 1 and not (enters or kind):
            continue
        rest = values[1:] if len(values) > 1 else values
        if len(values) > 1 and not enters:
            name = text[slice(*values[0])]
            kind = _SECRET.search(name) and not re.search(r"\s", name) and secret_name(name) or len(values) == 1 and kind
        if enters or kind:
            yield from (span for span in rest if plausible(text[slice(*span)], kind == 1 and not enters))
    for m in _PAIR.finditer(text) if re.search("auth|cred|login", text, re.I) else ():
        first = _ONE.match(text, m.end())
        gap = first and _ARGUMENT_NEXT.match(text, first.end())
        if gap and (found := _joined(text, gap.end())) and plausible(found[0]):
            yield found[1], found[2]
    for m in _COMPARED.finditer(text):
        found = _joined(text, m.end())
        given = found and _GIVEN.search(text[max(0, m.start() - 60) : m.start()])
        if found and plausible(found[0]) and re.search(r"[\d\W]" if given else r"\W", found[0]) and (given or _LETS_IN.match(text, found[2] + 1)):
            yield found[1], found[2]
    if "//" in text or "#" in text or "/*" in text or "--" in text:
        for m in _BESIDE.finditer(text):
            note = m["note"]
            if _COMMENT.search(note) and not _PUBLIC.search(note):
                k = next(i for i in range(1, 6) if m.group(i) is not None)
                if plausible(m.group(k), True):
                    yield m.span(k)
        for m in _REMARK.finditer(text):
            yield from _remark(m.group(1), m.start(1))
    if plain:
        yield from _unquoted(text, 0, len(text))


def _remark(note: str, at: int) -> Iterator[tuple[int, int]]:
    """The span of the value at the end of a comment that says who enters where and with what; ``at``: where the comment stands."""
    tail = note.rstrip()
    start = max(tail.rfind(" "), tail.rfind("\t")) + 1
    if tail.endswith(("*/", "-->")) and start:
        tail = tail[: -2 if tail.endswith("*/") else -3].rstrip()
        start = max(tail.rfind(" "), tail.rfind("\t")) + 1
    value = tail[start:]
    if len(value) < 6 or re.search(r"['\"`]", value) or not (asked := _ASKS.search(note[:start])):
        return
    known = asked.group(1)
    if not known and (pair := re.fullmatch(r"[\w.@+-]{2,}:([^:/]{6,})", value)):
        known, start, value = "user", start + pair.start(1), pair.group(1)
    drawn = re.search(r"\d", value) and re.search(r"[A-Za-z]", value) and (re.search(r"[^\w.:/@-]", value) or plausible(value, True))
    if plausible(value) and (known or drawn) and not _PUBLIC.search(note):
        yield at + start, at + start + len(value)


def _unquoted(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Spans of unquoted values of a secret's name, as configuration has them."""
    for m in _PLAIN.finditer(text, start, end):
        kind = secret_name(m.group(1))
        if kind and plausible(m.group(2), kind == 1):
            yield m.span(2)


def _scanned(text: str, plain: bool, beside: bool = False) -> Iterator[tuple[int, int]]:
    """What one layer shows without being decoded."""
    yield from _formed(text)
    yield from _named(text, plain, beside)


def _literals(code: str) -> Iterator[tuple[str, int, int]]:
    """The literals of a text with those joined to them, and those inside template literals: value, start, end.

    A stray backtick makes a template of the code up to the next; the literals in there count by themselves.
    """
    value, start, end, after = "", 0, 0, -1
    for m in _LITERAL.finditer(code):
        k = m.lastindex
        gap = after >= 0 and _JOIN.match(code, after)
        if gap and gap.end() == m.start():
            value, end, after = value + m.group(k), m.end(k), m.end()
        else:
            if after >= 0:
                yield value, start, end
            value, start, end, after = m.group(k), m.start(k), m.end(k), m.end()
        if k == 3:
            for inner in _QUOTED.finditer(code, m.start(k), m.end(k)):
                yield inner.group(inner.lastindex), *inner.span(inner.lastindex)
    if after >= 0:
        yield value, start, end


def find(code: str, path: str | None = None) -> list[tuple[int, int]]:
    """The spans of credential values in a text, in order and not overlapping."""
    plain, beside = bool(_UNQUOTED.search(path or "")), bool(_PYTHON.search(path or ""))
    spans = [*_scanned(code, plain, beside)]
    for value, start, end in _literals(code):
        if not plain and "\n" in value:
            spans += _unquoted(code, start, end)
        if len(value) >= 16 and (not re.search(r"\s", value) or "\\" in value or _B64.fullmatch(re.sub(r"\s", "", value))) and not value.startswith(("data:", "sha", "./", "../")) and hidden(value):
            spans.append((start, end))
    spans += [span for span in _runs(code) + ([m.span(2) for m in _PLAIN.finditer(code)] if plain else []) if hidden(code[slice(*span)])]
    merged: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if merged and start < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    return merged


def redact(code: str, spans: list[tuple[int, int]]) -> str:
    """``code`` with the values replaced; quotes, joins, line breaks and everything outside stay."""
    out, last = [], 0
    for start, end in spans:
        value = code[start:end]
        value = "0" if _OCTETS.fullmatch(value) or re.fullmatch(r"[\s\dxXa-fA-F,]+", value) and "," in value else re.sub(r"[^\s'\"`+][^\n'\"`]*", lambda m: m.group() if m.group().strip() in (",", ".", "\\") else MARK, value)
        out += [code[last:start], value]
        last = end
    return "".join([*out, code[last:]])


def _lines(code: str, spans: list[tuple[int, int]]) -> list[int]:
    """The line (from 1) on which each value begins, once each."""
    return sorted({code.count("\n", 0, start) + 1 for start, _ in spans})


def credential_lines(chunks: DataFrame) -> DataFrame:
    """``seq, line_no`` of every line on which a credential's value begins, once each.

    Null and empty code has none; a null path only means that unquoted values don't count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs, paths, codes = (c.to_pylist() for c in batch.columns)
            rows = [(seq, line) for seq, path, code in zip(seqs, paths, codes) if code for line in _lines(code, find(code, path))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32())], ["seq", "line_no"])

    return chunks.select(F.col("seq").cast("long"), "path", "code").mapInArrow(run, "seq long, line_no int").distinct()


def redacted(chunks: DataFrame) -> DataFrame:
    """``seq, credentials, code`` of every row, its code with the values redacted; null code stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs, paths, codes = (c.to_pylist() for c in batch.columns)
            spans = [find(code, path) if code else [] for path, code in zip(paths, codes)]
            clean = [redact(code, s) if s else code for code, s in zip(codes, spans)]
            yield pa.RecordBatch.from_arrays([pa.array(seqs, pa.int64()), pa.array([len(s) for s in spans], pa.int32()), pa.array(clean, pa.string())], ["seq", "credentials", "code"])

    return chunks.select(F.col("seq").cast("long"), "path", "code").mapInArrow(run, "seq long, credentials int, code string")
