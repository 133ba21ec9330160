import random
import time

import numpy as np
import pytest

from tessella.llm import maintext
from tessella.llm.maintext import dense, main_text, parsed, smoothed

SCHEMA = "page_id long, url string, html string, text string, N_chars int"
LOREM = "The committee met on Tuesday, as it had every week since spring, and put off its decision for a third time."
NAV = "<nav><ul>" + "".join(f'<li><a href="/{w}">{w}</a></li>' for w in ("home", "news", "about", "contact")) + "</ul></nav>"
MENU = '<div><ul>' + "".join(f'<li><a href="/{w}">{w}</a></li>' for w in ("home", "news", "about", "contact")) + "</ul></div>"
FOOT = "<footer>&copy; example &middot; all rights reserved by us and by nobody else at all</footer>"


def page(body, head="<title>Tea</title><style>p{margin:0}</style><script>var t='</p><article>no</article>';</script>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


CASES = {
    "article": (page(f"{NAV}<div class='ad'>Buy now, friends.</div><article><h1>Tea &amp; milk</h1><p>{LOREM}</p><p>Yes.</p></article>{FOOT}"), f"Tea & milk\n{LOREM}\nYes."),
    "open elements": (page(f"{NAV}<article><h1>Tea</h1><p><b>{LOREM}<br>{LOREM}<p>No.<ul><li>one<li>two</ul></article>{FOOT}"), f"Tea\n{LOREM} {LOREM}\nNo.\none\ntwo"),
    "references and white space": (page("<article><p>a&nbsp;&lt;b&gt;&#x41;\n\t <i>c</i><b>d</b> &eacute;&unknown;</p>\n\n<p> e </p><p>  </p></article>"), "a <b>A cd é&unknown;\ne"),
    "upper case, bare attributes": (page(f"<DIV CLASS=sidebar><P>{LOREM}</DIV><ARTICLE ID=x><H1>Tea</H1><P>{LOREM}</ARTICLE>"), f"Tea\n{LOREM}"),
    "menu left open": (page(f"<nav><ul><li><a href=/>home</a><article><h1>Tea</h1><p>{LOREM}</p></article>{FOOT}"), f"Tea\n{LOREM}"),
    "no article, divisions only": (page(f"{MENU}<div><div><h1>Tea</h1><p>{LOREM}</p><p>Yes.</p><p>{LOREM}</p></div></div><div><a href=/a>imprint</a> <a href=/b>press</a></div>"), f"Tea\n{LOREM}\nYes.\n{LOREM}"),
    "paragraphs as divisions": (page(f"{MENU}<div id=wrap><div>{LOREM}</div><div>{LOREM}</div><div>{LOREM}</div></div>"), "\n".join([LOREM] * 3)),
    "text in the body": (page(f"{LOREM}<p>{LOREM}"), f"{LOREM}\n{LOREM}"),
    "reader comments": (page(f"<main><article><h1>Tea</h1><p>{LOREM}</p></article><section id='comments'><article class='comment'><p>{LOREM} {LOREM}</p></article><p>{LOREM}</p></section></main>"), f"Tea\n{LOREM}"),
    "comments inside": (page(f"<article><h1>Tea</h1><p>{LOREM}</p><div class='comment-list'><p>{LOREM}</p><p>{LOREM}</p></div></article>"), f"Tea\n{LOREM}"),
    "site header and article header": (page(f"<header><h1>The Daily</h1><p>{LOREM}</p></header><article><header><h1>Tea</h1><p>by Someone</p></header><p>{LOREM}</p><footer>filed</footer></article>"), f"Tea\n{LOREM}"),
    "heading before the article": (page(f"<main><h1>Tea</h1><article><p>{LOREM}</p></article><div>{MENU}</div></main>"), f"Tea\n{LOREM}"),
    "notices, forms, hidden": (page(f"<div id='cookie-notice'><p>{LOREM}</p></div><article><h1>Tea</h1><form><p>{LOREM}</p><input></form><p hidden>{LOREM}</p><p style='display: none'>x</p><p>{LOREM}</p><div class='newsletterSignup'>{LOREM}</div></article>"), f"Tea\n{LOREM}"),
    "aside and role": (page(f"<article><p>{LOREM}</p><aside>{LOREM}</aside><div role=navigation>{LOREM}</div><figure><img><figcaption>Leaves</figcaption></figure></article>"), f"{LOREM}\nLeaves"),
    "links in a sentence stay, a list of links goes": (page(f"<article><h1>Tea</h1><p>See <a href=/x>this</a> and <a href=/y>that</a>.</p><p>{LOREM}</p>{MENU[5:-6]}</article>"), f"Tea\nSee this and that.\n{LOREM}"),
    "whole page in a form": (page(f"<form id=aspnet>{NAV}<div><h1>Tea</h1><p>{LOREM}</p></div>{FOOT}</form>"), f"Tea\n{LOREM}"),
    "hinted wrapper of the article": (page(f"<div class='page with-sidebar'><article><h1>Tea</h1><p>{LOREM}</p></article><div class='sidebar'><p>{LOREM}</p></div></div>"), f"Tea\n{LOREM}"),
    "teasers of other articles": (page(f"<article><h1>Tea</h1><p>Short today.</p></article><section class='related'><article><p>{LOREM}</p></article><article><p>{LOREM}</p></article></section>"), "Tea\nShort today."),
    "article in a widget only": (page(f"{MENU}<div class='widget'><article><p>{LOREM}</p></article></div>"), LOREM),
    "comment markup and cut end": (f"<body><article><p>{LOREM}<!-- <p>no</p> --></p><p>tail <a hr", f"{LOREM}\ntail"),
    "comment never closed": (f"<body><article><p>{LOREM}</p><!-- <p>no</p>", LOREM),
    "script never closed": (f"<body><article><p>{LOREM}</p></article><script>var x = '<p>no</p>'", LOREM),
    "table": (page("<article><table><tr><th>cup<th>pot<tr><td>1</td><td>2</td></tr></table></article>"), "cup pot\n1 2"),
    "only boilerplate": (page(f"{NAV}{FOOT}"), ""),
    "short article beside long junk": (page(f"<div class='advert'><p>{LOREM * 5}</p></div><article><p>Be.</p></article>{FOOT}"), "Be."),
    "self-closed": (page(f"<div class='ad'/><article><p>{LOREM}</p><script src=x /><p>b</p></article>"), f"{LOREM}\nb"),
    "plain text": ("just words & more", "just words & more"),
    "empty": ("", ""),
    "null": (None, ""),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(name):
    html, want = CASES[name]
    assert main_text(html) == want


def invented(rnd):
    """A page and its article: blocks in random markup around random boilerplate."""

    def words(n):
        return " ".join("".join(rnd.choice("abcdefgh&<é ") for _ in range(rnd.randint(1, 9))).strip() or "x" for _ in range(n))

    def escaped(s):
        return s.replace("&", "&amp;").replace("<", rnd.choice(["&lt;", "&#60;"])).replace(" ", rnd.choice([" ", "\n  ", "\t"]))

    blocks = [" ".join(words(rnd.choice([1, 3, 12, 60])).split()) for _ in range(rnd.randint(1, 12))]
    marked = [rnd.choice(["<p>{}</p>", "<p>{}", "<P><b>{}</b></P>", "<h2>{}</h2>", "<div>{}</div>", "<ul><li>{}</ul>", "<p><b>{}<br>"]).format(escaped(b)) for b in blocks]
    junk = [NAV, "<div class='ad'>{}</div>", "<aside><p>{}</p></aside>", "<form>{}<input></form>", "<!-- {} -->", "<script>var x='<p>{}</p>'</script>", "<div id=comments><p>{}</p></div>"]
    before, after = (("".join(rnd.choice(junk).format(escaped(words(20))) for _ in range(3))) for _ in range(2))
    return page(f"{before}<article>{''.join(marked)}</article>{after}{FOOT}"), "\n".join(blocks)


def test_invented_articles_come_back_whole(spark):
    rnd = random.Random(11)
    made = [invented(rnd) for _ in range(300)]
    rows = [(i, f"u{i}", html, "old", 1) for i, (html, _) in enumerate(made)]
    rows += [(None, None, None, None, None), rows[0], (999, "u", "", "x", 0)]
    got = maintext.extracted(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(got) == 303 and got[0].__fields__ == ["page_id", "url", "text", "n_chars"]
    of = {i: text for i, (_, text) in enumerate(made)} | {None: "", 999: ""}
    for r in got:
        assert r["text"] == of[r["page_id"]] and r["n_chars"] == len(r["text"])
    assert maintext.extracted(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pieces_do_not_matter(monkeypatch):
    rnd = random.Random(12)
    for size in (1, 7, 100):
        html, want = invented(rnd)
        monkeypatch.setattr(maintext, "PIECE", size)
        assert main_text(html) == want


def test_smoothing_and_threshold():
    ratios = np.array([1, 1, 1, 1, 90, 100, 2, 80, 95, 1, 1, 1, 1], float)
    flat = smoothed(ratios)
    kernel = np.exp(-0.5 * np.arange(-3, 4) ** 2)
    want = [sum(k * ratios[i + j] for j, k in zip(range(-3, 4), kernel) if 0 <= i + j < 13) / sum(k for j, k in zip(range(-3, 4), kernel) if 0 <= i + j < 13) for i in range(13)]
    assert np.allclose(flat, want)
    assert dense(ratios)[0].tolist() == [False] * 3 + [True] * 7 + [False] * 3
    assert dense(np.array([5.0, 5.0]))[0].all() and dense(np.array([3.0]))[0].all()


def test_text_is_kept_whole_and_long_or_broken_pages_end():
    body = "".join(f"<p>{i} {LOREM}</p>" for i in range(20_000))
    assert main_text(page(f"{NAV}<article>{body}</article>")).count("\n") == 19_999
    for broken in ("<a " * 300_000, "<!--" * 300_000, "<" * 300_000, "<div>" * 100_000 + "x", "&" * 300_000, "</p>" * 200_000, "<li>x" * 50_000, "<p " + "a=1 " * 100_000 + ">x"):
        began = time.time()
        main_text(broken)
        main_text(broken + ">")
        assert time.time() - began < 20, broken[:10]


def test_ratio_counts_tags_since_the_last_line():
    lines = parsed("<p>ab</p><p><b>cde</b> <a href=x>f</a></p>").lines
    assert [(t, n, links, linked) for _, t, n, links, linked in lines] == [("ab", 2, 0, 0), ("cde f", 6, 1, 1)]
