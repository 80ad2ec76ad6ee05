import hashlib
import re
from collections import Counter

import pytest
from llm_cases import DOCS, PASSAGE, documents, words

from walkweave.llm import decontaminate as D

ITEMS = [(100, " ".join(PASSAGE.split()[5:30]).upper()), (9, "Short item here"), (None, " ".join(words(5, 80).split()[:12])), (7, None), (8, "?! ..."), (100, "spam Spam spam"), (20, "ñandú 日本語 qué"), (21, "quarter " * 11)]


def plain_words(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)


def brute(rows, items):
    windows = {}
    for item, text in items:
        w = plain_words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(item)
    out = []
    for i, text in rows:
        w = plain_words(text)
        hit, owners = set(), set()
        for window, own in windows.items():
            for k in range(len(w) - len(window) + 1):
                if tuple(w[k : k + len(window)]) == window:
                    hit |= set(range(k, k + len(window)))
                    owners |= own
        owners.discard(None)
        out.append((i, len(w), len(hit), len(owners), hashlib.sha256(",".join(sorted(map(str, owners))).encode()).hexdigest(), bool(hit)))
    return Counter(out)


ROWS = [*DOCS, (30, "a SHORT-item; here! and short item"), (31, "quarter " * 9), (32, "quarter " * 30), (30, "a SHORT-item; here! and short item")]


@pytest.mark.parametrize("block", [1 << 20, 60])
@pytest.mark.parametrize("items", [ITEMS, []])
def test_hits(spark, block, items):
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = D.find_contamination(documents(spark, ROWS), bench, block_bytes=block).collect()
    assert Counter(tuple(r)[:6] for r in got) == brute(ROWS, items)
    kept = D.drop_contaminated(documents(spark, ROWS), bench, block_bytes=block)
    assert kept.columns == documents(spark, ROWS).columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(x[0] for x, n in brute(ROWS, items).items() for _ in range(n) if not x[-1])
    assert D.find_contamination(documents(spark, []), bench).count() == 0


def test_offsets_are_those_of_the_original(spark):
    text = "¿Sí? — one TWO, three; vier!"
    bench = spark.createDataFrame([(1, "one two three")], "item_id bigint, text string")
    row = D.find_contamination(documents(spark, [(1, text)]), bench).first()
    a, b = row.spans
    assert text[a:b] == "one TWO, three"
