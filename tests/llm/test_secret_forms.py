import json
import re

import pytest
from test_secrets import CURVE, RSA, SSH, WRAPPED, b64, kinds, token

from walkweave.llm import secrets as S

KEYS = [(RSA, "der"), (WRAPPED, "der"), (CURVE, "der"), (SSH, "ssh")]


def confirmed(text):
    return [text[a:b] for k, a, b in S.scan(text) if k not in S.BASE_KINDS]


@pytest.mark.parametrize("data, kind", KEYS)
@pytest.mark.parametrize("line", ["\\n", "\\r\\n", "\\\\n"])
def test_armour_in_a_string(data, kind, line):
    body = line.join(re.findall(".{1,64}", b64(data)))
    text = f"-----BEGIN PRIVATE KEY-----{line}{body}{line}-----END PRIVATE KEY-----{line}"
    assert kinds(json.dumps({"a": 1})[:-1] + f', "private_key": "{text}"}}') == ["pem"]


@pytest.mark.parametrize("data, kind", KEYS)
@pytest.mark.parametrize("width", [64, 76])
@pytest.mark.parametrize("line", ["\n", "\r\n", "\n    ", "\\n"])
def test_wrapped_without_armour(data, kind, width, line):
    body = line.join(re.findall(f".{{1,{width}}}", b64(data)))
    assert kinds(f"see\n{body}\nand more") == [kind]
    assert confirmed(f"see\n{body}\nand more") == [body]


@pytest.mark.parametrize("data, kind", KEYS)
@pytest.mark.parametrize("before", ["id-", "/keys/", "name_", "a+"])
def test_glued_to_a_word(data, kind, before):
    assert kinds(f"x {before}{b64(data)} y") == [kind]
    assert confirmed(f"x {before}{b64(data)} y") == [b64(data)]


def test_token_headers():
    head, rest = json.dumps({"alg": "HS256"}), token({"alg": "HS256"}).split(".", 1)[1]
    for text in ("{ " + head[1:], "\n" + head, " " + head, "{\n  " + head[1:]):
        made = f"{b64(text.encode(), True)}.{rest}"
        assert confirmed(f"a {made} b") == [made]
    for before in ("id-", "t_", "x.y."):
        assert confirmed(f"a {before}{token({'alg': 'HS256'})} b") == [token({"alg": "HS256"})]
