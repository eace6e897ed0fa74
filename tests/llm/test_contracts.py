"""What the first operators promise, against plain rules: planted cases, odd rows, blocks, long texts."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pagestream.llm import decontaminate, language_id, quality_llr, secret_scan, simhash, toxicity
from pagestream.llm.common import fold, ship, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def _shipped(spark):
    ship(spark)


def prose(rng, many):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(many))


# Secrets.


def test_planted_literals_are_found_where_they_are(spark):
    rng, rows, expected = random.Random(1), [], {}
    forms = ['db_passphrase = "{}"', "  \"signingKey\": '{}',", "export THEME_NAME={}", "client.private_key := `{}`", "bearer: str = \"{}\""]
    for number in range(150):
        text, spans = prose(rng, 30) + ".\n", []
        for _ in range(rng.randrange(4)):
            value = "Zq8" + "".join(rng.choice("abcdefghABCDEFGH234567") for _ in range(14)) + "9x"
            line = rng.choice(forms).format(value)
            begin = len(text) + line.index(value)
            sensitive = "THEME" not in line
            text += line + "\n" + prose(rng, 8) + "\n"
            if sensitive:
                spans.append(f"literal:{begin}:{begin + len(value)}")
        rows.append((number, text))
        expected[number] = ",".join(spans)
    got = {r["doc_id"]: r["spans"] for r in secret_scan.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == expected and sum(map(bool, expected.values())) > 80


def literals(text):
    return [text[s.start:s.end] for s in secret_scan.find_secrets(text)[1] if s.kind == "literal"]


def test_long_names_passphrases_and_scopes():
    assert literals("x" * 500 + '_passphrase = "h7#kQ9!zLm2"') == ["h7#kQ9!zLm2"]
    assert literals('passphrase = "correct horse battery staple"') == ["correct horse battery staple"]
    assert literals('"password": "please enter your password again"') == []
    apart = 'def a():\n    KEY = "Zx81kfQ0pLm"\n\ndef b():\n    auth_token2 = KEY\n'
    assert literals(apart) == [] and literals(apart.replace("def b():\n", "")) == ["Zx81kfQ0pLm"]
    assert literals('KEY = "Zx81kfQ0pLm"\ndef b():\n    auth_token2 = KEY\n') == ["Zx81kfQ0pLm"]


def test_many_secrets_take_time_in_proportion():
    import time

    took = []
    for many in (1000, 8000):
        text = "".join(f'token{i} = "abcd1234efgh56{i}"\nprivate_key{i} = "abcD1234{i}xyz"\n' for i in range(many))
        began = time.process_time()
        assert len(secret_scan.find_secrets(text)[1]) == 2 * many
        took.append(time.process_time() - began)
    assert took[1] < 30 * took[0]
    secret_scan.find_secrets("k = " + "a" * 500_000 + " \n" + "b " * 300_000 + '"c' * 100_000)


# SimHash.


def plain_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split("[\x20\x09-\x0d]+", lower) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def test_fingerprints_follow_the_plain_rule():
    rng = random.Random(2)
    texts = [None, "", " \t", "One", "Ünï CODE x y", "a b c d", "A\x0bb\x0cC d e", "same " * 50]
    texts += [prose(rng, rng.randrange(1, 60)).upper() for _ in range(60)]
    assert [simhash.fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]


def test_planted_near_copies_meet_in_a_component(spark):
    rng, rows = random.Random(3), []
    for number in range(60):
        words = prose(rng, 700).split()
        rows.append((number, " ".join(words)))
        words[rng.randrange(len(words))] = "changed"
        rows.append((1000 + number, " ".join(words)))
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    near = [n for n in range(60) if (plain_fingerprint(rows[2 * n][1]) ^ plain_fingerprint(rows[2 * n + 1][1])).bit_count() <= 4]
    assert len(near) > 40 and all(found[n] == found[1000 + n] == n for n in near)
    assert all(found[1000 + n] == 1000 + n for n in set(range(60)) - set(near))


def test_representatives_of_odd_rows(spark):
    schema = "doc_id long, text string, _keep int, kept_id string, kept_row string, attributes map<string, int>"
    rows = [(1, "a b c d e", 1, "x", "y", {"a": 1}), (2, "a b c d e", 2, None, None, None), (None, "only this one here", 3, "x", "y", {})]
    rows += [(7, "one id very many times over", k % 3, "x", "y", {"k": k % 3}) for k in range(5000)]
    kept = simhash.keep_representatives(spark.createDataFrame(rows, schema))
    assert kept.columns == [c.split()[0] for c in schema.replace("map<string, int>", "map").split(", ")]
    got = sorted(((r["doc_id"], r["_keep"]) for r in kept.collect()), key=repr)
    assert [i for i, _ in got] == [1, 7, None] and got[0][1] == 1
    assert kept.where("doc_id = 7").first()["attributes"]["k"] == kept.where("doc_id = 7").first()["_keep"]
    assert simhash.keep_representatives(spark.createDataFrame([], schema)).count() == 0


# Quality.


def test_quality_scores_follow_the_plain_rule(spark):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()] + [(-1, None), (-2, "one"), (-3, "Two wörds")]
    trusted = {r["doc_id"] for r in table(spark, SF, "labels").where("quality = 1").collect()}
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality_llr.judge_quality(frame, table(spark, SF, "labels").where("quality = 1")).collect()}

    def buckets(text):
        tokens = re.findall("[a-z0-9\u0080-\U0010ffff]+|[^a-z0-9\u0080-\U0010ffff\x20\x09-\x0d]", (text or "").lower())
        hashes = [xxhash.xxh64_intdigest(b.encode(), xxhash.xxh64_intdigest(a.encode(), 42)) for a, b in zip(tokens, tokens[1:])]
        return [(h - 2**64 if h >= 2**63 else h) % quality_llr.BUCKETS for h in hashes]

    raw, good = Counter(), Counter()
    for i, text in docs:
        raw.update(buckets(text))
        good.update(buckets(text) if i in trusted else [])
    all_raw, all_good = (sum(c.values()) + quality_llr.BUCKETS for c in (raw, good))
    for i, text in docs:
        found = buckets(text)
        ratios = [math.log((good[b] + 1) / all_good) - math.log((raw[b] + 1) / all_raw) for b in found]
        score = sum(ratios) / len(ratios) if ratios else 0.0
        assert got[i]["score"] == pytest.approx(score, abs=1e-9)
        if abs(score - quality_llr.THRESHOLD) > 1e-9:
            assert got[i]["kept"] == (not got[i]["base_failed"] and score >= quality_llr.THRESHOLD)
    nothing = quality_llr.judge_quality(frame.where("false"), table(spark, SF, "labels"))
    assert nothing.count() == 0


# Decontamination.


def edits_between(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def best_edits(window, text):
    """Fewest edits of `window` against any part of `text`."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(window, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return min(row)


@pytest.mark.parametrize("size", [14, 20, 26, 30, 60, 100, 180])
def test_windows_within_the_budget_are_all_found(size):
    rng = random.Random(size)
    letters = "abcdefgh "
    for _ in range(30):
        item = "x" + re.sub(" +", " ", "".join(rng.choice(letters) for _ in range(size - 2))).strip() + "y"
        index = decontaminate.Index([(1, item)])
        changed = list(item)
        for _ in range(rng.randrange(0, 12)):
            at, kind = rng.randrange(len(changed)), rng.randrange(3)
            changed[at:at + 1] = {0: ["z"], 1: [], 2: [changed[at], "q"]}[kind]
        before, after = prose(rng, 30), prose(rng, 30)
        text = f"{before} {''.join(changed)} {after}"
        found = decontaminate.search_texts([text], index)[0]
        codes = decontaminate.normalised(text)[0].tolist()
        inside = [w for w in index.windows if best_edits(w.codes.tolist(), codes) <= w.edits]
        assert bool(found) == bool(inside)
        if found:
            assert found[0][0] == 1 and found[0][3] == min(best_edits(w.codes.tolist(), codes) for w in inside) or found[0][3] <= index.windows[0].edits
            assert found[0][4] == len(inside)


def test_short_items_occur_as_whole_words():
    index = decontaminate.Index([(1, "Qx-zebra 7"), (2, "of"), (3, "..."), (4, "")])
    found = decontaminate.search_texts(["the QX zebra, 7 times", "qx zebra 77", "ofter", "made of it", "of", "...", "", None], index)
    assert [[r[0] for r in f] for f in found] == [[1], [], [], [2], [2], [], [], []]
    assert found[0][0][1:4] == (4, 15, 0)
    assert [decontaminate.normalised(t)[0].tolist() for t in ("、。", "漢、字")] == [[], [ord("漢"), 32, ord("字")]]


def test_many_blocks_equal_one(spark, rows, monkeypatch, tmp_path):
    bench = table(spark, SF, "benchmark").union(spark.createDataFrame([(500, "Qx zebra 7"), (501, "a short one here now")], "item_id long, text string"))
    docs = table(spark, SF, "documents").withColumn("maybe", F.lit("kept")).unionByName(
        spark.createDataFrame([(-1, "it is the qx zebra 7 again", "x"), (-2, None, "y"), (-3, "", None)], "doc_id long, text string, maybe string"),
        allowMissingColumns=True,
    )
    one = rows(decontaminate.find_leaks(docs, bench))
    left = rows(decontaminate.drop_leaks(docs, bench))
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 1000)
    assert sum(1 for _ in decontaminate._blocks(bench, "item_id", "text")) >= 9
    assert rows(decontaminate.find_leaks(docs, bench)) == one and len(one) > 3
    many = decontaminate.drop_leaks(docs, bench)
    assert rows(many) == left and many.columns == docs.columns and 0 < len(left) < docs.count()


def test_an_index_is_built_once_a_task(monkeypatch):
    built = []
    monkeypatch.setattr(decontaminate, "Index", lambda items: built.append(1) or type("Nothing", (), {"grams": [], "windows": []}))
    import pandas as pd

    sent = type("Sent", (), {"value": ((1, "x"),)})
    search = decontaminate._searcher(sent)
    list(search(iter([pd.DataFrame({"id": [1], "text": ["a"]})] * 5)))
    assert built == [1]


# Language.


def test_a_language_of_long_texts_only_is_learned(spark):
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choice(["the", "house", "and", "of", "which"]) for _ in range(40)), "en", "x") for k in range(30)]
    rows += [(100 + k, " ".join(rng.choice(["gallia", "est", "omnis", "divisa"]) for _ in range(8000)), "la", "y") for k in range(4)]
    rows += [(7, rows[0][1], "en", "x")] * 500 + [(None, None, None, None), (300, "", "xx", None), (301, "12 34", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = language_id.fit(docs, F.lit(True))
    assert model.languages == ["en", "la"]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(docs, model).collect()}
    assert got[100][0] == "la" and got[3][0] == "en" and got[None] == got[300] == got[301] == ("und", 0.0)
    assert language_id.identify(docs, model).count() == len(rows)
    nothing = language_id.fit(docs.where("false"), F.lit(True))
    assert nothing.languages == [] and {r["lang_pred"] for r in language_id.identify(docs.limit(5), nothing).collect()} == {"und"}
    assert language_id.identify(docs.where("false"), model).count() == 0
    tie = language_id.train({"b": [b"same text"], "a": [b"same text"]})
    assert language_id.predict(tie, ["same text"]) == [("a", 0.5)]


def test_a_fit_reads_so_many_code_points_of_a_language(spark, monkeypatch):
    monkeypatch.setattr(language_id, "CODES_PER_LANGUAGE", 1000)
    seen = {}
    monkeypatch.setattr(language_id, "train", lambda texts: seen.update(texts))
    rows = [(k, f"{k} " + "word " * 100, "en") for k in range(50)]
    language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert sum(map(len, seen["en"])) == 1000


# Toxicity.


def test_one_id_very_many_times_in_the_fit(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_ROWS", 120)
    rng = random.Random(5)
    rows = [(k, f"{prose(rng, 20)} {'you vile gronk' if k % 2 else 'a kind word'}") for k in range(100)]
    rows += [(5, rows[5][1])] * 3000 + [(6, f"{n} more rows of one id") for n in range(3000)] + [(None, "x"), (101, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(100)] + [(1, None), (None, 1)], "doc_id long, toxic int")
    collected = []
    frames = toxicity.cut_lineage
    monkeypatch.setattr(toxicity, "cut_lineage", lambda df: collected.append(frames(df)) or collected[-1])
    model = toxicity.fit(docs, labels, F.lit(True))
    assert collected[0].count() <= 120
    assert model.score("you vile gronk you") > 0.5 > model.score("a kind word here")


# Pipeline.


def test_pipeline_stages_take_odd_rows(spark):
    import corpus_pipeline

    kinds = "doc_id long, text string, lang string, source string, n_chars long, toxicity double, maybe int, _keep int, tokens string, redacted string"
    clean = [r["text"] for r in table(spark, SF, "documents").limit(30).collect()]
    rows = [(k, t, "en", "s", len(t or ""), 1.0, 2, 3, "t", "r") for k, t in enumerate(clean)]
    rows += [(None, None, None, None, None, None, None, None, None, None), (900, "", "en", None, 0, None, None, None, None, None)]
    rows += [(901, "word " * 40_000, "en", "s", 200_000, 0.0, 1, 1, "", "")] * 3 + [rows[0]] * 2
    docs = spark.createDataFrame(rows, kinds)
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        nothing = stage(spark, docs.where("false"), SF)
        assert nothing.count() == 0
        if n < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns and out.count() <= docs.count(), name
            docs = out
    found = out.collect()
    assert all(r["exact"] for r in found) and len({r["doc_id"] for r in found}) == len(found)
    assert sum(r["doc_id"] in (None, 900) for r in found) == 1  # both are empty: one stands for the other
