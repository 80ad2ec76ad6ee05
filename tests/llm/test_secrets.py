import base64
import hashlib
import json
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import DOCS, documents

from walkweave.llm import secrets as S


def element(tag, body):
    size = len(body)
    if size < 128:
        return bytes([tag, size]) + body
    length = size.to_bytes((size.bit_length() + 7) // 8, "big")
    return bytes([tag, 0x80 | len(length)]) + length + body


def number(n):
    return element(2, n.to_bytes(n.bit_length() // 8 + 1, "big"))


RSA = element(0x30, number(0) + b"".join(number((1 << 500) + i) for i in range(8)))
WRAPPED = element(0x30, number(0) + element(0x30, element(6, b"\x2a\x86\x48") + element(5, b"")) + element(4, RSA))
CURVE = element(0x30, number(1) + element(4, b"k" * 32) + element(0xA0, element(6, b"\x2b\x81\x04")))
PUBLIC = element(0x30, element(0x30, element(6, b"\x2a\x86\x48") + element(5, b"")) + element(3, b"\0" + b"p" * 70))


def field(data):
    return len(data).to_bytes(4, "big") + data


SSH = b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(b"public" * 8) + field(b"private" * 10)


def b64(data, url=False):
    return (base64.urlsafe_b64encode(data).rstrip(b"=") if url else base64.b64encode(data)).decode()


def token(head, claims={"sub": "x"}, signature=b"s" * 32):
    return ".".join([b64(json.dumps(head).encode(), True), b64(json.dumps(claims).encode(), True), b64(signature, True)])


def kinds(text):
    return [k for k, _, _ in S.scan(text) if k not in S.BASE_KINDS]


@pytest.mark.parametrize("data", [RSA, WRAPPED, CURVE])
def test_private_keys(data):
    assert S.is_private_key(data) and not S.is_private_key(data[:-1]) and not S.is_private_key(data + b"x")
    assert kinds(f"here {b64(data)} it is") == ["der"]
    assert "der" in kinds(f"here {data.hex()} it is")
    lines = "\n".join(re.findall(".{1,64}", b64(data)))
    text = f"x\n-----BEGIN PRIVATE KEY-----\n{lines}\n-----END PRIVATE KEY-----\ny"
    assert [s for s in S.scan(text) if s[0] == "pem"] == [("pem", 2, len(text) - 2)] and kinds(text) == ["pem"]


def test_other_structures():
    assert not S.is_private_key(PUBLIC) and kinds(b64(PUBLIC)) == []
    assert S.is_ssh_key(SSH) and not S.is_ssh_key(SSH[:-1]) and kinds(b64(SSH)) == ["ssh"]
    assert kinds(f"-----BEGIN OPENSSH PRIVATE KEY-----\n{b64(SSH)}\n-----END OPENSSH PRIVATE KEY-----") == ["pem"]
    assert kinds("-----BEGIN PRIVATE KEY-----\nnot a key at all, is it\n-----END PRIVATE KEY-----") == []
    assert kinds(b64(b"just some text that is long enough to be looked at")) == []


def test_signed_tokens():
    assert kinds("a " + token({"alg": "HS256"}) + " b") == ["jwt"]
    assert kinds(token({"typ": "x"})) == kinds(token({"alg": 5})) == kinds(token({"alg": "RS256"}, signature=b"short")) == []
    assert kinds(token({"alg": "none"}, signature=b"")) == kinds(token({"alg": "none"})[:-30]) == []
    assert kinds("ey." + token({"alg": "HS256"}) + " " + "e30xy" + token({"alg": "HS256"})) == ["jwt", "jwt"]


KEY_PIECES = [
    *(b64(x) for x in (RSA, WRAPPED, CURVE, PUBLIC, SSH)),
    b64(WRAPPED, True),
    b64(RSA)[:300],
    *("\n".join(re.findall(".{1,64}", b64(x))) for x in (RSA, SSH)),
    "\\n".join(re.findall(".{1,40}", b64(CURVE))),
    *(CURVE.hex(), RSA.hex()[:200], "\n  ".join(re.findall(".{1,32}", CURVE.hex()))),
    *(":".join(f"{b:02x}" for b in CURVE), ":\n    ".join(":".join(re.findall("..", x)) for x in re.findall(".{1,30}", WRAPPED.hex()))),
    *(" ", "\n", "x", "MIMB8AAA", "b3Blb", "30", ":", "=", "\\n", "-", "é", "30:82:01:"),
]


def plain_keys(text):
    """Keys found by decoding, at each place, all that follows."""
    out, end = [], 0
    for m in S.START.finditer(text):
        at = m.start()
        if at < end:
            continue
        colons, digits = text[at + 2 : at + 3] == ":", text[at] == "3"
        if colons:
            places = [x.start() + k for x in re.finditer("[0-9A-Fa-f]{2}", text[: re.compile(r"[0-9A-Fa-f]{2}(?::\s*[0-9A-Fa-f]{2})*").match(text, at).end()][at:]) for k in (0, 1)]
            places = [at + x for x in places]
        else:
            line, places, k = re.compile("[0-9A-Fa-f]+" if digits else "[A-Za-z0-9+/_-]+"), [], at
            while got := line.match(text, k):
                places += range(*got.span())
                if not (gap := S.BREAK.match(text, got.end())):
                    break
                k = gap.end()
        body = "".join(text[k] for k in places)
        body = body[: len(body) - (len(body) % 4 == 1)] if not digits else body[: len(body) // 2 * 2]
        data = bytes.fromhex(body) if digits else S.from_base64(body)
        size = S.ssh_size(S.of_bytes(data)) if text[at] == "b" else S.key_size(S.of_bytes(data))
        if size and (text[at] == "b" or S.is_private_key(data[:size])):
            end = places[(2 * size if digits else -(-size * 4 // 3)) - 1] + 1
            while not digits and text[end : end + 1] == "=" and end - places[-(-size * 4 // 3) - 1] <= 2:
                end += 1
            out.append(("ssh" if text[at] == "b" else "der", at, end))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(KEY_PIECES), max_size=12).map("".join))
def test_keys_equal_whole_decoding(text):
    assert [s for s in S.confirmed(text) if s[0] in ("der", "ssh")] == plain_keys(text)


@pytest.mark.parametrize("size", [1 << 17, 1 << 20])
def test_keys_of_any_length(size):
    key = element(0x30, number(0) + element(0x30, element(6, b"\x2a\x86\x48")) + element(4, b"k" * size))
    text = "x " + "\n".join(re.findall(".{1,64}", b64(key))) + " y"
    assert kinds(text) == ["der"] and S.confirmed(text)[0][2] == len(text) - 2
    assert kinds(key.hex()) == ["der"]


@pytest.mark.parametrize("unit", ["MIMB8AAA", "MIQAAPAA", "MIMAgAAw", "MIMB8AACAQACA", "MIGHAgEAMBMG", "MIQAAPAA\n", "3082ffff0201000282010100", "308400ff0000020100308400", "30:84:00:ff:02:01:00:02:82:01:aa:bb:cc:\n   ", "30:82:01:ff:02:01:00:02:82:01:", b64(SSH)[:60], "eyeyeyey"])
def test_each_start_takes_bounded_work(unit, monkeypatch):
    calls = []
    real = S.Reader.__init__
    monkeypatch.setattr(S.Reader, "__init__", lambda self, size, read: real(self, size, lambda a, n: calls.append(n) or read(a, n)))
    built = []
    monkeypatch.setattr(S.Run, "__init__", lambda self, pieces, own=S.Run.__init__: (own(self, pieces), built.append(len(self.body)))[0])
    text = (unit * (400_000 // len(unit)))[:400_000]
    S.scan(text)
    starts = sum(1 for _ in S.START.finditer(text))
    assert sum(built) <= 2 * len(text)  # a run is put together once for each kind of digits
    assert sum(calls) <= 400 * starts


def plain_base(text):
    out = []
    for m in re.finditer(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for m in re.finditer("AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 20:
            out.append((m.start(), 1, f"access:{m.start()}:{m.end()}"))
    for m in re.finditer("[0-9a-f]+", text):
        if len(m[0]) >= 24:
            out.append((m.start(), 2, f"hex:{m.start()}:{m.end()}"))
    return [x for *_, x in sorted(out)]


PIECES = ["password", "PassWD", "secret", "toKen", "api_key", "apikey", "ſecret", "toKen", ":", "=", " ", '"', "'", "abc", "AKIA", "A1B2C3D4E5F6G7H8", "deadbeef", "0123456789abcdef", "é", "-", "AKIAAKIA", "longervalue"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=25).map("".join))
def test_base_spans(text):
    assert [f"{k}:{a}:{b}" for k, a, b in S.scan(text) if k in S.BASE_KINDS] == plain_base(text)


def test_rows(spark):
    more = [*DOCS, (20, "é password = 'hunter22' " + "ab" * 15), (21, b64(RSA)), (20, "token:abcdef AKIA" + "Z" * 16)]
    got = S.find_secrets(documents(spark, more)).collect()
    assert len(got) == len(more)
    of = {}
    for r in got:
        of.setdefault(r.doc_id, []).append(r)
    for i, t in more:
        want = plain_base(t or "")
        rows = [r for r in of[i] if r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()]
        assert rows and (rows[0].n_assign, rows[0].n_access, rows[0].n_hex) == tuple(sum(w.startswith(k) for w in want) for k in ("assign", "access", "hex"))
    assert of[21][0].spans.startswith("der:0:") and of[21][0].n_confirmed == 1
    assert S.find_secrets(documents(spark, [])).count() == 0


def test_masking(spark):
    rows = [(1, "é password = 'hunter22' end"), (2, "clean"), (3, None), (4, "token: abcdefabcdefabcdefabcdef tail")]
    got = {r.doc_id: r.text for r in S.mask_secrets(documents(spark, rows)).collect()}
    assert got == {1: "é [secret]' end", 2: "clean", 3: None, 4: "[secret] tail"}
