"""Each operator against brute force, on small tables with nulls, empties, repeats and clashing names."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagestream.llm import (
    byte_bpe, chat_format, components, decontaminate, html_text, language_id, quality_llr, secret_scan, simhash,
    toxicity, url_filter,
)
from pagestream.llm.common import fold, ship, table
from pagestream.llm.queries import URL_RULES

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, score string, spans string"


@pytest.fixture(autouse=True)
def _shipped(spark):
    ship(spark)


@pytest.fixture
def docs(spark):
    """Nulls, an empty, a very long and repeated rows, with columns named as results are."""
    words = "the cat sat on a mat and looked at the moon over the hill while it rained all day long".split()
    long = " ".join(f"{w}{k}" for k in range(3000) for w in words)
    rows = [
        (1, " ".join(words), "en", "s", 1, "x", "y", "z"), (1, " ".join(words), "en", "s", 1, "x", "y", "z"),
        (2, None, None, None, None, None, None, None), (3, "", "en", "s", 0, None, None, None),
        (None, "no id here", "en", None, 10, None, None, None), (4, long, "en", "s", len(long), None, None, None),
        (5, 'token = "abcd1234efgh5678"', "de", "s", 30, None, None, None),
    ]
    return spark.createDataFrame(rows, DOC)


def test_components_equal_union_find(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 480)] + [(7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r[0]: r[1] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_base_secrets_follow_the_plain_patterns():
    rng, alphabet = random.Random(1), ["token", "=", "secret", ":", " ", '"', "ab12cd34", "a", "AKIA", "0F", "api_key", "f" * 16]
    assign = re.compile(secret_scan._ASSIGN.pattern, re.I | re.A)
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(14))
        expected = [("assign", *m.span()) for m in assign.finditer(text) if len(m[2]) >= 8]
        expected += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
        expected += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
        got = [(s.kind, s.start, s.end) for s in secret_scan.find_secrets(text)[0]]
        assert sorted(got) == sorted(expected)
        assert set(got) <= {(s.kind, s.start, s.end) for s in secret_scan.find_secrets(text)[1]}


@pytest.mark.parametrize("text, literals", [
    ('db_passphrase = "h7#kQ9!zLm2"', ["h7#kQ9!zLm2"]),
    ('KEY = "Zx81kfQ0pLm"\nclient.auth_token2 = KEY', ["Zx81kfQ0pLm"]),
    ('signing_key: str = "q8W7e6R5t4Y3"', ["q8W7e6R5t4Y3"]),
    ('private_key = "abcD1234" + "efgH5678"', ["abcD1234", "efgH5678"]),
    ("credentials: happiness", []), ("password = changeme", []), ('title = "Zx81kfQ0pLm"', []), ("a = b = c : d", []),
])
def test_literals_reach_sensitive_names(text, literals):
    found = [s for s in secret_scan.find_secrets(text)[1] if s.kind == "literal"]
    assert [text[s.start:s.end] for s in found] == literals


def test_secrets_of_odd_rows(docs):
    rows = secret_scan.scan_secrets(docs).collect()
    assert len(rows) == 7 and sum(r["n_assign"] for r in rows) == 1
    assert {r["base_sha256"] for r in rows if not r["n_assign"]} == {hashlib.sha256(b"").hexdigest()}
    masked = secret_scan.redact_secrets(docs)
    assert masked.columns == docs.columns
    assert masked.where("doc_id = 5").first()["text"] == 'token = "[SECRET]"'
    assert masked.where("doc_id = 5").first()["n_chars"] == 18
    assert secret_scan.scan_secrets(docs.limit(0)).count() == 0


def test_urls(spark):
    pages = spark.createDataFrame([
        (1, "https://a.example.com/en/1", None), (2, "https://www.example.com/en/1", ""), (3, None, "x"), (4, "no url", "x"),
        (5, "http://EVIL.org/x", '<link rel="canonical" href="https://b.net/es/1">'), (6, "http://other.org/y#t", '<meta http-equiv=refresh content="0;url=//evil.org/x">'),
        (7, "http://other.org/y?utm_source=q", None), (8, "http://z.net/fr/1", None), (9, "http://ok.net/de?x", None), (9, "http://ok.net/de?x", None),
    ], "page_id long, url string, html string")
    got = {r["page_id"]: (r["rule"], r["verdict"], r["via"]) for r in url_filter.judge_urls(pages.withColumn("verdict", F.lit("x")), URL_RULES).collect()}
    assert got == {
        1: ("example.com/en/", "block", "rule"), 2: ("www.example.com/en/", "allow", "rule"), 3: (None, "allow", "default"),
        4: (None, "allow", "default"), 5: (None, "block", "alias"), 6: (None, "block", "alias"), 7: (None, "block", "alias"),
        8: ("net/fr/", "block", "rule"), 9: (None, "allow", "default"),
    }
    allowed = spark.createDataFrame([("http://evil.org/x", "http://fine.com/")], "url string, target string")
    again = {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(pages, URL_RULES, allowed).collect()}
    assert again[5] == again[6] == "allow" and again[8] == "block"
    assert url_filter.judge_urls(pages.limit(0), URL_RULES).count() == 0


def test_bpe_equals_the_public_library(spark, docs):
    import tiktoken

    own = byte_bpe.tokenizer(*byte_bpe.default_files())
    other = tiktoken.Encoding("own", pat_str=byte_bpe.default_files()[1], mergeable_ranks=own.encoder.ranks, special_tokens={})
    texts = [r["text"] for r in table(spark, SF, "documents").collect()]
    texts += ["", " " * 700, "a" * 900, "日本語 テスト🙂" * 40, "don't  \n\n x\t\t", "0123456789" * 9, " \x1c\x85"]
    for text, ids in zip(texts, own.encode_all(texts)):
        assert list(memoryview(ids).cast("I")) == other.encode_ordinary(text)
        assert own.decode(ids) == text.encode()
    rows = {r["doc_id"]: r for r in byte_bpe.digest_tokens(docs, *byte_bpe.default_files()).collect()}
    assert rows[2]["n_tokens"] == rows[3]["n_tokens"] == 0


def test_bpe_appends_and_edits():
    one, rng = byte_bpe.tokenizer(*byte_bpe.default_files()).encoder, random.Random(2)
    for _ in range(60):
        data = bytes(rng.choice(b"abct he in") for _ in range(24))
        last = one.prefixes(data)
        assert one.append(data, last, b"ing the") == one.prefixes(data + b"ing the")
        at = rng.randrange(24)
        changed = data[:at] + b"Q" + data[at + 1:]
        assert one.edit(last, data, changed) == one.prefixes(changed)


def test_simhash_groups_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    values = rng.integers(0, 2**63, 300, dtype=np.uint64)
    for base in (0, 1, 2):  # large groups of near copies, and chains
        for _ in range(150):
            near = values[base]
            for bit in rng.integers(0, 64, rng.integers(0, 5)):
                near ^= np.uint64(1) << np.uint64(bit)
            values = np.append(values, near)
    values = np.unique(values)
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, v in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(values ^ v) <= simhash.MAX_BITS):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    signed = values.view(np.int64).tolist()
    nodes = spark.createDataFrame([(v, 1) for v in signed], "fp long, weight long")
    got = {r["fp"]: r["group"] for r in simhash.near_groups(nodes).collect()}
    least = {}
    for i, v in enumerate(signed):
        least[find(i)] = min(v, least.get(find(i), v))
    assert {v: got.get(v, v) for v in signed} == {v: least[find(i)] for i, v in enumerate(signed)}


def test_simhash_of_odd_rows(docs):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == 7
    by = {r["doc_id"]: (r["fp"], r["component_id"]) for r in rows}
    assert by[2] == by[3] == (0, 2)
    kept = simhash.keep_representatives(docs)
    assert kept.columns == docs.columns and sorted(r[0] or 0 for r in kept.collect()) == [0, 1, 2, 4, 5]


def test_quality_base_equals_brute_force(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "a b c d e f g h " * 9 + "\n\n \na\na"), (-3, "x"), (None, "#*$ y")], "doc_id long, text string")
    docs = docs.select("doc_id", "text").union(odd).withColumn("kept", F.lit(1))
    rows = quality_llr.judge_quality(docs, labels.where("quality = 1")).collect()
    assert len(rows) == docs.count()
    expected = Counter()
    for _, text, _ in docs.collect():
        text = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        seen = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
        covered = {k for i in range(len(words) - 7) if seen[tuple(words[i:i + 8])] > 1 for k in range(i, i + 8)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
        expected[len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed] += 1
    assert Counter((r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rows) == expected
    assert not any(r["kept"] for r in rows if r["base_failed"])
    by, good = {r["doc_id"]: r for r in rows}, {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert all(by[i]["kept"] for i, q in good.items() if q and not by[i]["base_failed"])
    assert sum(by[i]["kept"] for i, q in good.items() if not q) <= 0.1 * sum(not q for q in good.values())


def test_html_leaves_the_article():
    page = (
        '<html><head><title>t</title></head><body><header><h1>Site</h1></header><nav><ul><li>a<li>b</ul></nav><div class="cookie-notice">n</div>'
        '<article><header><h1>T</h1><span class="byline">by</span></header><p>Hello <a href=x>li</a>nk &amp; <i>co</i><br>more'
        '<p class=x>two&nbsp; &#233;<div class="comments"><p>c</p></div><ul><li>a<li>b</ul><script>if(a<b){"</p>"}</script><footer>f</footer></article><form>q<input></form><aside>s</aside>'
    )
    assert html_text.main_text(page, None) == "T\nHello link & co more\ntwo é\na\nb"
    assert html_text.main_text(None, None) == html_text.main_text("", None) == ""
    assert html_text.main_text("<p>cut &am", None) == "cut &am"


def test_html_template_is_what_pages_share(spark):
    def page(k):
        return f"<body><div>Welcome to our site, dear reader</div><div><p>Story {k} is long and about number {k}.</p><p>It goes on {k * k} lines</p></div><div>All about us</div></body>"

    rows = [(k, "http://h.org/" + str(k), page(k)) for k in range(40) if k not in (9, 10)] + [(9, None, None), (10, "http://x.org", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("n_chars", F.lit("x"))
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(pages).collect()}
    assert got[3] == "Story 3 is long and about number 3.\nIt goes on 9 lines" and got[9] == got[10] == ""
    copies = spark.createDataFrame([(k, f"http://h.org/{k}", page(1) + "<!-- %d -->" % k) for k in range(4)], "page_id long, url string, html string")
    assert all("Story 1" in r["text"] for r in html_text.extract_text(copies).collect())


def test_toxicity_learns_and_generalises(spark, docs):
    given, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    model = toxicity.fit(given, labels, fold("doc_id", 5) != 0)
    scored = toxicity.score_toxicity(given, model).join(labels, "doc_id").where(fold("doc_id", 5) == 0).collect()
    said = [r for r in scored if r["predicted"]]
    assert said and all(r["toxic"] for r in said)
    assert sum(r["toxic"] != r["predicted"] for r in scored) <= 0.06 * len(scored)
    assert toxicity.score_toxicity(docs, model).where("score between 0 and 1").count() == 7
    assert toxicity.drop_toxic(docs, model).columns == docs.columns
    empty = toxicity.fit(docs.limit(0), labels, F.lit(True))
    assert 0 <= empty.score(None) <= 1


def test_lexicon_words_count_by_how_dense_they_lie():
    model = toxicity.Model({"bad*": 0, "fine": 1}, frozenset([0]), np.zeros(2 + len(toxicity.PATTERNS)), 0.0)
    base = 2

    def fired(text):
        return {toxicity.PATTERNS[f - base] for f in model.features(text) if f >= base}

    assert toxicity.terms_of("Badness fine") >= {"badness", "badn*", "badne*", "badnes*", "fine"}
    model = model._replace(terms={"badn*": 0, "fine": 1})
    assert fired("badness fine") == set()  # a single one may be chance
    assert fired("badness badness fine") == {"lexicon_twice", "lexicon_dense", "lexicon_denser"}
    assert fired("badness badnesses" + " fine" * 148) == {"lexicon_twice", "lexicon_dense"}
    assert fired("badness badnesses" + " fine" * 500) == {"lexicon_twice"}
    assert fired(None) == fired("") == set()


def test_label_model_discounts_copies_of_a_voter():
    rng = np.random.default_rng(0)
    truth = rng.random(3000) < 0.3
    votes = [(np.where(truth, rng.random(3000) < 0.6, rng.random(3000) < 0.1)) for _ in range(6)]
    votes += [votes[0]] * 4
    post, info = toxicity.label_model(np.stack(votes, axis=1), np.full(3000, -1))
    assert ((post > 0.5) == truth).mean() > 0.8
    assert info["discount"][0] < 0.35 < info["discount"][3]


def test_leaks_within_the_edit_budget(spark):
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    clean = " ".join(f"word{k} plain" for k in range(60))
    rng, rows = random.Random(4), []
    for item, text in items:
        changed = list(text)
        for _ in range(len(text) // 25):
            changed[rng.randrange(len(text))] = rng.choice("xyz")
        rows.append((item, f"{clean} {''.join(changed).upper()} {clean}"))
    rows += [(-1, clean), (-2, None), (-3, ""), (None, items[0][1])]
    found = decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit(1)), table(spark, SF, "benchmark")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} >= {(i, i) for i, _ in items if len(_) > 30} | {(None, items[0][0])}
    assert not {-1, -2, -3} & {r["doc_id"] for r in found}
    for r in found:
        if r["doc_id"] is not None and r["doc_id"] == r["item_id"]:
            assert abs(r["start"] - len(clean)) < 12
    nothing = table(spark, SF, "benchmark").limit(0)
    assert decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), nothing).count() == 0


def test_banded_alignment_equals_full_table():
    rng = random.Random(6)
    for _ in range(200):
        window = np.array([rng.randrange(4) for _ in range(20)], np.uint32)
        region = np.array([rng.randrange(4) for _ in range(34)], np.uint32)
        if rng.random() < 0.7:
            region[7:27] = window
            region[rng.randrange(7, 27)] = 9
        row = [0] * 35
        for i in range(20):
            new = [i + 1]
            for j in range(34):
                new.append(min(row[j] + (window[i] != region[j]), row[j + 1] + 1, new[j] + 1))
            row = new
        got = decontaminate.aligned(window, region, 4)
        assert (min(row) <= 4) == (got is not None)
        assert got is None or got[2] == min(row)


def test_role_repair_is_cheapest():
    from itertools import product

    legal = chat_format._MOVE
    for n in range(1, 5):
        for codes in product(range(4), repeat=n):
            best = 1 << 60
            for roles in product((1, 2, 3), repeat=n):
                state, cost = 0, 0
                for given, role in zip(codes, roles):
                    cost += legal.get((state, role), 1 << 50) + chat_format._relabel(given, role)
                    state = role
                best = min(best, cost + chat_format._END[state])
            assert chat_format.repair([chat_format.ROLES[c] or "?" for c in codes])[1] == best


def test_one_conversation_over_many_partitions(spark):
    rng = random.Random(7)
    rows = [(1, k, rng.choice(["user", "assistant", "system", None, "human"]), f"t{k}") for k in range(800)]
    rows += [(2, 0, "assistant", "x <|im_end|>"), (None, 0, "user", None), (3, None, "user", "b"), (3, None, "user", "b"), (3, 5, "user", "a")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("action", F.lit(1))
    got = sorted(((r["conv_id"] or 0, r["pos"]), r["rendered"]) for r in chat_format.format_chats(turns).collect())
    whole = {c: "".join(t for (k, _), t in got if k == c) for c in (0, 1, 2, 3)}
    expected = chat_format.pieces("", [r[1] for r in rows[:800]], [r[2] for r in rows[:800]], [r[3] for r in rows[:800]])
    assert whole[1] == "".join(p[-1] for p in expected)
    head, end = "<|im_start|>", "<|im_end|>\n"
    assert whole[2] == f"{head}user\n{end}{head}assistant\nx < |im_end|>{end}"
    assert whole[0] == f"{head}user\n{end}{head}assistant\n{end}"
    assert whole[3] == f"{head}user\na\n\nb\n\nb{end}{head}assistant\n{end}"
    assert chat_format.format_chats(turns.limit(0)).count() == 0


def test_languages_held_out(spark, docs):
    given = table(spark, "/root/testdata/sf0.01", "documents")
    model = language_id.fit(given, fold("doc_id", 4) != 2)
    found = language_id.identify(given, model).join(given, "doc_id").where(fold("doc_id", 4) == 2).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in found) >= 0.98 * len(found)
    odd = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs, model).collect()}
    assert odd[2] == odd[3] == "und"


def test_code_lengths_equal_a_walk_of_the_tree():
    texts = {"a": [b"abracadabra", b"abc"], "b": [b"bobby bobs"]}
    model = language_id.train(texts)
    for probe in (b"abrab", b"bob zz", b"q", b""):
        for k, lang in enumerate(model.languages):
            bits = 0.0
            for i, byte in enumerate(probe):
                for n in range(min(i, language_id.ORDER), -1, -1):
                    seen = Counter(t[j] for t in texts[lang] for j in range(n, len(t)) if t[j - n:j] == probe[i - n:i])
                    total = sum(seen.values())
                    if byte in seen:
                        bits -= np.log2(seen[byte] / (total + len(seen)))
                        break
                    if seen:
                        bits -= np.log2(len(seen) / (total + len(seen)))
                else:
                    bits += model.unseen
            assert language_id.code_lengths(model, [probe])[0, k] == pytest.approx(bits, abs=1e-3)


def test_pipeline(spark):
    import corpus_pipeline

    given = {r["doc_id"]: r for r in table(spark, SF, "documents").collect()}
    out = corpus_pipeline.run(spark, SF).collect()
    assert all(r["exact"] for r in out) and len({r["doc_id"] for r in out}) == len(out)
    prints = {r["doc_id"]: simhash.fingerprint(given[r["doc_id"]]["text"]) for r in out}
    values = np.array(list(prints.values()), np.uint64)
    assert all((np.bitwise_count(values ^ v) <= simhash.MAX_BITS).sum() == 1 for v in values)
    index = decontaminate.Index([(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()])
    own = byte_bpe.tokenizer(*byte_bpe.default_files())
    for r in out:
        text = given[r["doc_id"]]["text"]
        assert not decontaminate.search_texts([text], index)[0]
        assert own.decode(r["ids"]).decode() == secret_scan.redact(text)
    model = toxicity.fit(table(spark, SF, "documents"), table(spark, SF, "labels"), fold("doc_id", 5) != 0)
    assert all(model.score(given[r["doc_id"]]["text"]) < 0.5 for r in out)
    assert len(out) > len(given) // 2
