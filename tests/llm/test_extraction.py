"""Tree scoring against a plain reading of its rules on random trees, and pages of many forms."""

from __future__ import annotations

import random
import time

import pytest
from paperweave.llm import html_extract as x
from paperweave.llm.common import table


class Node:
    def __init__(self, tag, name="", children=(), text="", link=False):
        self.tag, self.name, self.children, self.text, self.link = tag, name, list(children), text, link

    def html(self):
        inner = "".join(c.html() for c in self.children) + (f'<a href="/hidden-sidebar">{self.text}</a>' if self.link else self.text)
        return f'<{self.tag} class="{self.name}">{inner}</{self.tag}>' if self.name else f"<{self.tag}>{inner}</{self.tag}>"

    def all(self):
        yield self
        for c in self.children:
            yield from c.all()


def plain_text(root):
    """The rules read node by node: sums over descendants, each found anew."""
    up = {c: n for n in root.all() for c in n.children}

    def chain(n):
        while n in up:
            n = up[n]
            yield n

    nodes = list(root.all())
    place = {n: i for i, n in enumerate(nodes)}
    in_article = {n: any(a.tag in ("article", "main") for a in chain(n)) for n in nodes}
    bad = {n: x.suspicious(n.tag, f'class="{n.name}"' if n.name else "", in_article[n]) for n in nodes}
    leaves = [n for n in nodes if n.text]
    for least in (25, 1):
        points = {n: 1 + n.text.count(",") + min(len(n.text) / 100, 3) if len(n.text) >= least else 0 for n in leaves}
        below = {n: [m for m in n.all() if m.text] for n in nodes}
        inner = {n: sum(points[m] for m in below[n]) for n in nodes}
        weight = {m: len(m.text) if in_article[m] or m.tag not in x.HEADINGS else 0 for m in leaves}

        def free_of_bad(n, m):
            return not any(bad[a] for a in [m, *chain(m)] if a is not n and n in chain(a))

        clean = {n: sum(weight[m] for m in below[n] if free_of_bad(n, m)) for n in nodes}
        dropped, elsewhere = {}, clean[root]
        for n in nodes:
            dropped[n] = dropped.get(up.get(n), False)
            if n is not root and bad[n] and not dropped[n]:
                held = any(inner[a] >= 0.5 * inner[n] > 0 for a in n.all() if a.tag in ("article", "main") and not bad[a] and (a is n or free_of_bad(n, a)))
                dropped[n] = not held and elsewhere > 0
                elsewhere += 0 if dropped[n] else clean[n]
        live = [m for m in leaves if not dropped[m]]
        own = {m: m if m.tag in x.CONTAINERS or m is root else up[m] for m in live}

        def score(n, decay):
            total = 0.0
            for m in live:
                line = [own[m], *chain(own[m])]
                if n in line:
                    total += points[m] * decay ** line.index(n)
            return total

        chars = {n: sum(len(m.text) for m in below[n] if m in own) for n in nodes}
        linked = {n: sum(len(m.text) for m in below[n] if m in own and m.link) for n in nodes}
        links = {n: sum(m.link for m in below[n] if m in own) for n in nodes}
        density = {n: linked[n] / chars[n] if chars[n] else 1.0 for n in nodes}
        s = {n: (score(n, 0.5) + (3 if n.tag in ("article", "main") and score(n, 0.5) else 0)) * (1 - density[n]) for n in nodes}
        t = {n: score(n, 1.0) * (1 - density[n]) for n in nodes}
        best = max(nodes, key=lambda n: (s[n], -place[n]))
        if s[best]:
            break
    else:
        return ""
    kept = {best}
    if best is not root:
        near = [n for n in up[best].children if n is not best and not dropped[n]]
        for k, n in enumerate(near):
            ok = 1 - density[n] > 0.75
            after = k + 1 == len(near) or place[near[k + 1]] > place[best]
            if t[n] >= 0.2 * t[best] > 0 or (n.tag == "p" and chars[n] >= 80 and ok) or (n.tag in x.HEADINGS and place[n] < place[best] and ok and after):
                kept.add(n)
    menu = {n for n in nodes if n is not best and links[n] >= 3 and linked[n] >= 0.8 * chars[n] and n.tag in ("ul", "ol", "div", "p", "table", "section")}
    out = []
    for m in leaves:
        line = [m, *chain(m)]
        if not dropped[m] and any(n in kept for n in line) and not any(n in menu for n in line):
            out.append(m.text)
    return "\n".join(out)


def random_tree(rng, depth=0):
    if depth > 5 or (depth and rng.random() < 0.35):
        n = rng.choice([3, 20, 30, 90, 400])
        text = "".join(rng.choice("abcdef ,") for _ in range(n)).strip(" ,") + "."
        return Node(rng.choice(["p", "p", "p", "h1", "h2", "div", "li"]), text=" ".join(text.split()), link=rng.random() < 0.2)
    name = rng.choice(["", "", "", "", "content", "sidebar", "comments", "has-sidebar", "site-footer", "share"])
    tag = rng.choice(["div", "div", "section", "article", "main", "ul", "form", "aside", "header", "nav"]) if depth else "html"
    return Node(tag, name if depth else "", [random_tree(rng, depth + 1) for _ in range(rng.randrange(1, 5))])


def test_scores_are_plain():
    rng = random.Random(5)
    for _ in range(250):
        tree = random_tree(rng)
        source = "".join(c.html() for c in tree.children) if tree.children else tree.html()
        assert x.main_text(source) == plain_text(tree), source


LONG = "A first sentence of the text, with a comma, and some more words in it. "
BODY = f"<p>{LONG * 3}</p><p>{LONG * 2}</p>"
TEXT = f"{(LONG * 3).strip()}\n{(LONG * 2).strip()}"
JUNK = '<nav><a href="/">Home</a></nav><div class="cookie-notice">We use cookies, and more cookies, to make cookies for you all.</div>'
TALK = f'<section id="comments"><article class="comment"><p>{"I say, this is great, really, and I mean it. " * 40}</p></article></section>'


@pytest.mark.parametrize(
    "source",
    [
        f'{JUNK}<div class="content has-sidebar">{BODY}</div>{TALK}',
        f'{JUNK}<article class="post comments-open">{BODY}</article>{TALK}',
        f'{JUNK}<div class="elementor-widget">{BODY}</div>',
        f'<form action="/x"><header>Site</header><div id="main">{BODY}</div><footer>Rights, all, reserved, here, and there.</footer></form>',
        f'<div class="sidebar"><main>{BODY}</main></div>',
        f'<table><tr><td class="nav"><ul><li><a href="/a">One</a></li></ul></td><td>{BODY}</td></tr></table>',
        f'{JUNK}<div>{BODY}<ul><li><a href="/1">Face page</a></li><li><a href="/2">Bird page</a></li><li><a href="/3">Mail it on</a></li></ul></div>',
        f'<article>{BODY}<div class="share">Tell, all, of your many, many friends about this one.</div></article>'.replace('class="share"', 'class="share-buttons sharing"'),
        f'<article>{BODY}<button>Press, here, and, there, for, more, of, it.</button></article>',
        f'<div width=10 id="comments" data-video="1" class=x><p>{"Reader, reader, says, a lot of things. " * 30}</p></div><article>{BODY}</article>',
    ],
)
def test_forms_of_pages(source):
    assert x.main_text(f"<html><body>{source}</body></html>") == TEXT


def test_attributes_are_read_one_by_one():
    page = f'<article><p>See <a href="/hidden-lake">the lake</a> here, and <span data-hidden-by="x">also</span> this: {LONG}</p><p hidden>{LONG}</p></article>'
    assert x.main_text(page) == f"See the lake here, and also this: {LONG.strip()}"


@pytest.mark.parametrize("source", ["<div><p>" * 8000 + LONG, "</div>" * 8000 + LONG, "</b>" * 8000 + LONG, "<b>" * 20_000 + LONG, "<form><div class=sidebar>" * 8000 + LONG, "<ul><li>" * 8000 + LONG, f"<div>{'<p>' + LONG}" * 4000])
def test_time_grows_with_length(source):
    began = time.perf_counter()
    assert LONG.strip() in x.main_text(source)
    assert time.perf_counter() - began < 3


BROKEN = ["<a ", '<p x="', '<a ">" ', "<a '\">' ", "<p x=\"'>", "<", "</", "<!", "<!--", "<a", '<a "">']


@pytest.mark.parametrize("part", BROKEN)
def test_broken_tags_take_no_longer(part):
    """A megabyte of tags without ends, or of quotes without ends."""
    for source in (part * (1_000_000 // len(part)), part * (1_000_000 // len(part)) + "'", f"<div><p>{LONG}</p>" + part * (500_000 // len(part)) + '"'):
        began = time.perf_counter()
        x.main_text(source)
        assert time.perf_counter() - began < 6


def test_tags_of_any_text():
    """Random pieces of markup against one regular expression a tag, which takes longer; a name ends at white space, / or >."""
    import random
    import re

    one = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<[/!?][^>]*>|<(/?)([A-Za-z][^\s/>]*+)([^>]*)>""", re.S)
    rng = random.Random(5)
    bits = ["<", ">", '"', "'", "<p", "</p>", "<a ", 'x="', "<!--", "-->", "</", "<!", "<?", "text ", "/", "=", "<br/>", '<i class="a">', " "]
    for _ in range(4000):
        source = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 50)))
        want = [(m.start(), m.end(), bool(m[1] or m[4]), (m[2] or m[5] or "").lower(), m[3] or m[6] or "") for m in one.finditer(source)]
        got = list(x.tags(source))
        assert [(a, b, c if n else False, n, s if n else "") for a, b, c, n, s in got] == [(a, b, c if n else False, n, s) for a, b, c, n, s in want]


def test_time_of_open_tags_only():
    source = "<div>" * 30_000 + LONG
    began = time.perf_counter()
    assert LONG.strip() in x.main_text(source)
    assert time.perf_counter() - began < 3


def test_rows(spark, small):
    rows = [(1, "u", None, 5, "n"), (2, None, "", 6, "n"), (3, "v", f"<p>{LONG}</p>", 7, "n"), (3, "v", f"<p>{LONG}</p>", 7, "n"), (None, None, f"<div>{BODY * 2000}</div>", 8, "n")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int, name string")
    found = x.extract_main_text(df)
    assert found.columns == ["page_id", "url", "name", "text", "n_chars"] and [f.dataType.typeName() for f in found.schema.fields][3:] == ["string", "long"]
    got = sorted(((r["page_id"], r["text"], r["n_chars"], r["name"]) for r in found.collect()), key=str)
    want = [(1, "", 0, "n"), (2, "", 0, "n"), *[(3, LONG.strip(), len(LONG.strip()), "n")] * 2, (None, "\n".join([TEXT] * 2000), len(TEXT) * 2000 + 1999, "n")]
    assert got == sorted(want, key=str)
    assert x.extract_main_text(df.filter("false")).count() == 0
    pages = table(spark, small, "pages").collect()
    got = {r["page_id"]: r["text"] for r in x.op2_html_text(spark, small).collect()}
    assert got == {r["page_id"]: x.main_text(r["html"]) for r in pages}
