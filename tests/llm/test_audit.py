"""The filter audit against plain filtering in every order."""

import random
from itertools import permutations

import pytest

from pagestream.llm import filter_audit
from pagestream.llm.common import ship

DOC = "doc_id long, text string, lang string, source string, n_chars long, part string, mask int, digest string, n string"


@pytest.fixture(autouse=True)
def _shipped(spark):
    ship(spark)


def words_of(text):
    out, word = [], ""
    for c in text or "":
        if c in " \t\n\x0b\x0c\r":
            out, word = out + [word] * bool(word), ""
        else:
            word += c
    return out + [word] * bool(word)


def brute(docs, labels):
    marks = {}
    for i, quality, toxic in labels:
        good, bad = marks.get(i, (False, False))
        marks[i] = (good or quality == 1, bad or toxic == 1)

    def fails(i, text):
        text, words = text or "", words_of(text)
        least = min((d[0] for d in docs if (d[1] or "") == text and d[0] is not None), default=None)
        return {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text), "D": any(c in "#$%&*|" for c in text),
            "E": i is not None and least is not None and least < i,
        }

    judged = [(d[2] or "", fails(d[0], d[1]), marks.get(d[0], (False, False)) if d[0] is not None else (False, False)) for d in docs]
    out = []
    for part in {p for p, _, _ in judged}:
        own = [(f, m) for p, f, m in judged if p == part]
        shapley, rows = dict.fromkeys("ABCDE", 0), []
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, x in enumerate(order):
                lost, kept = [r for r in left if r[0][x]], [r for r in left if not r[0][x]]
                redundant = sum(f[x] for f, _ in own) - len(lost)
                alone = sum(f[x] and sum(f.values()) == 1 for f, _ in own)
                rows.append((part, order, step + 1, len(kept), len(lost), redundant, alone, sum(m[0] for _, m in lost), sum(m[1] for _, m in lost)))
                shapley[x] += len(lost)
                left = kept
        out += [(*r, shapley[r[1][r[2] - 1]]) for r in rows]
    return sorted(out, key=repr)


def test_audit_equals_filtering_in_every_order(spark, rows):
    rng = random.Random(11)
    pool = ["a", "B", "Cc", "d#", "Ä", "e f", "x|y", *(f"w{k}" for k in range(150))]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.choice([0, 1, 40, 99, 100, 120, 400]))) for _ in range(40)]
    texts += [None, "", " \t\n", "ONLY CAPITALS " * 60, "same words here " * 3000, " ".join(pool)]
    docs = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(200)]
    docs += [docs[0], docs[0], (None, docs[0][1], "en"), (None, None, None), (-5, "", "en"), (300, None, "de"), (301, "", "de")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 220)] + [(3, 1, 1), (3, 0, 0), (None, 1, 1)]
    frame = spark.createDataFrame([(*d, "s", 1, "x", 7, "y", "z") for d in docs], DOC)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert rows(filter_audit.audit(frame, marks)) == brute(docs, labels)
    assert filter_audit.audit(frame.where("false"), marks).count() == 0
    alone = rows(filter_audit.audit(frame.limit(1), marks.where("false")))
    assert len(alone) == 600 and all(r[7:9] == (0, 0) for r in alone)


def test_packed_sums_do_not_overflow():
    many = 2**62
    found = filter_audit.unpacked(many * filter_audit.packed()[31] + many * filter_audit.packed()[0])
    assert {f["kept"] for f in found} == {many} and {f["removed"] for f in found} == {0, many}
    assert all(f["removed"] + f["redundant"] == many for f in found)
