"""Personal data: base spans against the patterns run in Python, planted data in disguise, and odd rows."""

import collections
import hashlib
import random
import re

from mnemospark.llm import pii

KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SCHEMA = "doc_id long, text string, base string, m int, `a.b` int"


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def fits(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": all(int(p) <= 255 for p in m.split(".")) if kind == "ip" else None, "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]


def brute(text):
    return [(k, m.start(), m.end()) for k in KINDS for m in re.finditer(BASE[k], text or "") if fits(k, m[0])]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in enumerate(texts)], SCHEMA)


def odd_texts():
    rng = random.Random(6)
    some = ["".join(rng.choice(("a", "@", ".", "1", "23", "0", " ", "-", "+", "(", ")", "com", "é", "😀", "\n")) for _ in range(rng.randint(0, 120))) for _ in range(400)]
    some += ["4111 1111 1111 1111", "4111-1111-1111-1112", "0000000000000000", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.256", "00255.0.0.1", "a@b.c@d.e", "a@b..c", "+1 (743) 555-3824 10.0.0.1"]
    return some + [None, "", "x" * 5000, "a@b.co " * 3000, "1.1.1.1 " * 3000]


def test_base_spans(spark):
    texts = odd_texts() + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows = pii.find(spark, frame(spark, texts)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r.doc_id])
        n = collections.Counter(k for k, *_ in want)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(n[k] for k in KINDS), texts[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        spans = [tuple(int(y) if y.isdigit() else y for y in x.split(":")) for x in r.spans.split(",") if x]
        assert set(want) <= set(spans) and r.n_spans == len(spans) == len(set(spans))
        assert spans == sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1]))


def test_data_in_disguise(spark):
    """Spelt-out and oddly separated data of every kind is found among clean texts, which are left alone."""
    rng = random.Random(9)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n))
    card = "4111111111111111"
    hidden = {
        "email": ["joe (at) example (dot) com", "ann[at]web.org", "kim at mail dot net"],
        "ip": ["93[.]184[.]216[.]34", "8(dot)8(dot)4(dot)4", "52 dot 1 dot 2 dot 3"],
        "card": [".".join(card[i : i + 4] for i in (0, 4, 8, 12)), "3782/822463/10005", "4111 - 1111 - 1111 - 1111"],
        "phone": ["(743) 555-3824", "743.555.3824", "1-743-555-3824", "0044 20 7946 0958"],
    }
    plain = {"email": "joe@example.com", "ip": "93.184.216.34", "card": card, "phone": "+1 743 555 3824"}
    texts, want = [], []
    for kind, some in hidden.items():
        for k, x in enumerate(some * 10 + [plain[kind]] * 30):
            texts.append(f"{words(8)} {x}, {words(8)}")
            want.append((kind, texts[-1].index(x), texts[-1].index(x) + len(x)) if k < len(some) * 10 else None)
    clean = [f"{words(5)} 1,234 of 5.678 at 12:30, look at it dot. {words(3)} 2024-01-02 v1.2.3 §4 {words(4)} 300[.]1[.]1[.]1 4111.1111.1111.1112" for _ in range(50)]
    rows = {r.doc_id: r for r in pii.find(spark, frame(spark, texts + clean)).collect()}
    for i, w in enumerate(want):
        if w:
            assert "{}:{}:{}".format(*w) in rows[i].spans.split(","), texts[i]
    assert all(rows[len(texts) + i].spans == "" for i in range(len(clean)))


def test_very_long_matches(spark):
    """Matches of many thousand repeats come out whole; none of them makes the pattern engine run out of stack."""
    long = ["a@b" + ".c" * 60000, "joe (at) host" + " (dot) z" * 40000, "4 " * 60000, "1 dot " * 40000, "4111." * 20000, "+1" + " 2" * 50000, "743-" * 30000]
    found = {r.doc_id: r for r in pii.find(spark, frame(spark, long)).collect()}
    assert found[0].spans == f"email:0:{len(long[0])}" and found[2].n_card == found[5].n_phone == 0


def test_nothing(spark):
    none = frame(spark, ["x"]).where("false")
    assert pii.find(spark, none).count() == 0
    assert [r.spans for r in pii.find(spark, frame(spark, ["nothing here", None])).collect()] == ["", ""]


def test_expectation_tells_labelers_apart():
    rng = random.Random(2)
    counts = collections.Counter()
    for _ in range(4000):
        real = rng.random() < 0.5
        counts["card", tuple((1 if real else -1) * (1 if rng.random() < a else -1) for a in (0.95, 0.9, 0.6, 0.85))] += 1
    p = pii.expectation(counts)
    assert p["card", (1, 1, 1, 1)] > 0.97 and p["card", (-1, -1, -1, -1)] < 0.03 and p["card", (1, 1, -1, 1)] > 0.9


def test_classifier_follows_its_targets():
    counts = {("ip", (0, 1, 0, 1), 1): 50, ("ip", (1, 1, 1, 1), 1): 500, ("ip", (-1, -1, -1, -1), 1): 300, ("ip", (0, -1, -1, -1), 2): 40}
    w = pii.classifier(counts)
    score = lambda v, s: sum(a * b for a, b in zip(w, pii.inputs("ip", v, s), strict=True))
    assert score((1, 1, 1, 1), 1) > score((0, 1, 0, 1), 1) > 0 > score((0, -1, -1, -1), 2) > score((-1, -1, -1, -1), 1) - 1
