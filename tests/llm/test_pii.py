import hashlib
import re

import pytest

from kinsieve.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def ok(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]


def brute(text):
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text or "", re.ASCII) if ok(k, m[0])] for k, p in PLAIN.items()}


TEXTS = [
    None, "", "nothing here", "a@b.com", "a@b.com_x@d.com..y@z.org @q.com a@b a@b. ..@x.y.", "été 😀 a.b+c@dé.com x@y-z.co.uk, 😀1.2.3.4.5.6.7.8 256.1.1.1 0001.002.3.255 1.2.3",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111 5500005555555559 41111111111111111111 12 3 4-5--6", "+1 (555) 123-4567 +12 +33 1 23 45 67 89 10 11 12 13 +1+2 +49(0)30-1234567. +1 5",
    "1" * 60_000, "+" + "1 (" * 30_000 + "1", "a" * 100_000 + "@", ".".join(["9"] * 3000), "x@y.z " * 600, "😀\n+4912345678 1.1.1.1\r\n7@8.9",
    "IBAN DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432, DE00 3704 0044 0532 0130 00", "tel. 030 1234567 but, after more than forty characters of text, 030 1234567", "amex 378282246310005 but, after more than forty characters of text, 378282246310005",
]


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(0, None, 1), (None, "a@b.com", 2)], "doc_id long, text string, spans int")
    return docs, pii.find(docs).collect()


def test_base_spans(found):
    _, rows = found
    assert len(rows) == len(TEXTS) + 2
    for row in rows:
        text = TEXTS[row.doc_id] if row.doc_id is not None else "a@b.com"
        want = brute(text)
        assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == tuple(map(len, want.values())), text[:80]
        listed = ",".join(f"{k}:{a}:{b}" for k, spans in want.items() for a, b in spans)
        assert row.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert row.spans == listed or row.spans.startswith(listed)
        assert len(row.spans.split(",")) == len(row.scores.split(","))


def test_added_spans(found):
    rows = {r.doc_id: r.spans for r in found[1]}
    kinds = lambda text: [x.split(":")[0] for x in rows[TEXTS.index(text)].split(",") if x]
    assert kinds(TEXTS[-3]).count("iban") == 2
    assert kinds(TEXTS[-2]) == ["local_phone"]
    assert kinds(TEXTS[-1]) == ["short_card"]


def test_redaction(spark, found):
    docs, _ = found
    rows = pii.redacted(docs).collect()
    assert len(rows) == len(TEXTS) + 2 and rows[0].spans == 1
    by = {r.doc_id: r.text for r in rows}
    assert by[3] == "[EMAIL]" and by[2] == "nothing here" and by[1] == "" and by[0] is None
    assert by[5] == "été 😀 a.b+c@dé.com [EMAIL], 😀[IP].[IP] 256.1.1.1 [IP] 1.2.3" or "[EMAIL]" in by[5]
    for i, text in enumerate(TEXTS):
        if text:
            assert not any(text[a:b] in by[i] for a, b in brute(text)["email"]), text[:80]
    assert pii.find(docs.limit(0)).count() == 0
