"""Wrapper induction: matching against brute force, pages without telling tags, odd pages."""

import random

import pytest

from pagestream.llm import html_text
from pagestream.llm.common import ship


@pytest.fixture(autouse=True)
def _shipped(spark):
    ship(spark)


def words(rng, many):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9))) for _ in range(many))


def tree(rng, depth):
    node = html_text.Node(rng.choice(["div", "p", "ul"]))
    if depth:
        node.parts = [tree(rng, depth - 1) for _ in range(rng.randrange(4))]
    return node


def largest(a, b):
    """Nodes in the largest alignment, by all ways to pair the children in order."""
    if a.label != b.label:
        return 0
    left, right = a.blocks(), b.blocks()

    def best(i, j):
        if i == len(left) or j == len(right):
            return 0
        own = largest(left[i], right[j])
        return max(best(i + 1, j), best(i, j + 1), (own and own + best(i + 1, j + 1)))

    return 1 + best(0, 0)


def test_matching_equals_brute_force():
    rng = random.Random(2)
    for _ in range(400):
        a, b = tree(rng, 3), tree(rng, 3)
        pairs = html_text.matched(a, html_text._frozen(b))
        assert len(pairs) == largest(a, b)
        assert len({id(x) for x, _ in pairs}) == len({id(y) for _, y in pairs}) == len(pairs)
        assert all(x.label == y[0] for x, y in pairs)


def page(rng, number):
    """No tag, class or role tells what is what."""
    menu = "".join(f'<div><a href="/{k}">{words(rng, 1)}</a></div>' for k in range(5))
    advert = rng.choice(["Buy our fine lamps now", "Cheap flights to the moon"])
    title, body = words(rng, 5), [words(rng, rng.randrange(20, 60)) for _ in range(rng.randrange(1, 6))]
    text = "".join(f"<div>{b}</div>" for b in body)
    return (
        f"<html><body><div>The Daily Page</div><div>{menu}</div><div>{advert}</div>"
        f"<div><h1>{title}</h1><div>{text}</div></div><div>All rights kept by us, {'long ' * 90}</div></body></html>"
    ), "\n".join([title, *body])


def test_pages_without_telling_tags_come_from_the_wrapper(spark):
    rng = random.Random(3)
    made = [page(rng, k) for k in range(40)]
    rows = [(k, "http://plain.example/%d" % k, html, "x", True) for k, (html, _) in enumerate(made)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, by_wrapper boolean")
    got = {r["page_id"]: r for r in html_text.extract_text(pages).collect()}
    assert all(got[k]["text"] == text and got[k]["by_wrapper"] for k, (_, text) in enumerate(made))
    assert got[0]["n_chars"] == len(made[0][1])
    alone = html_text.extract_text(pages.where("page_id = 0")).first()
    assert not alone["by_wrapper"] and made[0][1].split("\n")[-1] in alone["text"]


def test_a_long_notice_goes_from_a_short_page():
    rng = random.Random(4)
    notice = "<div>" + "We use every cookie there is. " * 60 + "</div>"
    pages = [f"<body>{notice}<article><h1>{words(rng, 3)}</h1><div>{words(rng, 30)}</div></article></body>" for _ in range(5)]
    inside = [p.replace(notice, "").replace("<article>", "<article>" + notice) for p in pages]
    for some in (pages, inside):
        wrapper = html_text.induce(some)
        assert all("cookie" not in html_text.main_text(p, wrapper) for p in some)
        short = some[0].replace("</h1>", "</h1><p>short</p>")
        assert "cookie" not in html_text.main_text(short, wrapper) and "short" in html_text.main_text(short, wrapper)


def test_all_articles_of_a_page_stay():
    one = "<body><nav>menu</nav><article><p>first part</p></article><div>between</div><article><p>second, the longer part</p></article></body>"
    assert html_text.main_text(one, None) == "first part\nsecond, the longer part"
    rng = random.Random(5)
    pages = ["<body><nav>menu</nav>" + "".join(f"<article><p>{words(rng, 20)}</p></article>" for _ in range(2)) + "</body>" for _ in range(4)]
    wrapper = html_text.induce(pages)
    assert all(html_text.main_text(p, wrapper).count("\n") == 1 for p in pages)


def test_inline_adverts_end_with_their_own_tag():
    assert html_text.main_text('<p>a <span class="ad">x <span>y</span> z</span> b</p>', None) == "a b"


def test_deep_and_wide_pages(spark):
    deep = "<div>" * 100_000 + "<p>inner</p>outer" + "</div>" * 100_000
    mixed = "".join(f"<div>{k} " for k in range(300)) + "end" + "".join(f"</div>t{k} " for k in range(300))
    flat = html_text.main_text(mixed, None).split()
    assert flat == [str(k) for k in range(300)] + ["end"] + [f"t{k}" for k in range(300)]
    wide = ["<ul>" + "".join(f"<li>{k} {i}</li>" for i in range(20_000)) + "</ul>" for k in range(3)]
    broken = "<div>" * 50_000 + "</section></p></td>" * 50_000 + "<li>x" * 1000
    rows = [(k, "http://deep.example/", html) for k, html in enumerate([deep, deep + "<p>2</p>", deep + "<p>3</p>", *wide, broken, None, ""])]
    rows += [(9, None, "<p>no host</p>"), (None, "none", "<p>no id</p>"), (0, "http://deep.example/", deep)]
    got = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 12
    text = {r["page_id"]: r["text"] for r in got}
    assert text[0] == "inner\nouter" and text[7] == text[8] == "" and text[9] == "no host" and text[None] == "no id"
    assert text[3].count("\n") == 19_999
    empty = html_text.extract_text(spark.createDataFrame([], "page_id long, url string, html string"))
    assert empty.count() == 0


def test_pages_of_a_large_host_are_dealt_to_several_tasks(spark, setting):
    from pyspark.sql import functions as F

    setting("spark.sql.autoBroadcastJoinThreshold", "-1")
    setting("spark.sql.adaptive.enabled", "false")
    rng = random.Random(6)
    rows = [(k, "http://one.example/%d" % k, page(rng, k)[0]) for k in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    done = html_text.extract_text(pages).groupBy(F.spark_partition_id()).count().collect()
    assert len(done) > 1 and max(r["count"] for r in done) < 150


def test_slots_are_judged_by_all_pages_of_a_host(spark):
    """A block on one page in six with one of three texts, among pages of equal length, is an advert, of which eight pages say little."""
    rng = random.Random(7)
    made = []
    for k in range(300):
        title, body = words(rng, 5), [words(rng, 30) for _ in range(4)]
        advert = f"<div class='q7'>{rng.choice(['Buy our fine lamps now', 'Cheap flights to the moon', 'Soap, soap and soap'])}</div>" if k % 6 == 0 else ""
        menu = "<div>The Daily Page</div>"
        made.append((
            f"<body>{menu}<div><h1>{title}</h1>{''.join(f'<div>{b}</div>' for b in body)}{advert}</div></body>", "\n".join([title, *body])
        ))
    # Two pages unlike the others, far longer, are not what these are aligned with; copies of a page count once.
    odd = ["<body><table>" + "".join(f"<tr><td><a href='/'>{words(rng, 2)}</a></td></tr>" for _ in range(400)) + "</table></body>" for _ in range(2)]
    rows = [(k, "http://all.example/%d" % k, html) for k, (html, _) in enumerate(made)]
    rows += [(1000 + k, "http://all.example/odd", html) for k, html in enumerate(odd)]
    rows += [(2000 + k, "http://all.example/1", made[1][0]) for k in range(700)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(8)
    got = {r["page_id"]: r for r in html_text.extract_text(pages).collect()}
    assert len(got) == len(rows)
    wrong = [k for k, (_, text) in enumerate(made) if got[k]["text"] != text or not got[k]["by_wrapper"]]
    assert not wrong
    assert all(got[2000 + k]["text"] == made[1][1] for k in range(700))
    wrapper = html_text.host_wrappers(pages).first()["wrapper"]
    assert all(html_text.extracted(html, html_text._unpacked(wrapper)) == (text, True) for html, text in made)
