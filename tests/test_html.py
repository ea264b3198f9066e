"""Pages by structure: nesting, quoted attributes, references and tables, against a plain reader of tags."""

import html
import html.parser
import random
import re

import pytest
from pyspark.sql import functions as F

from passages.operators import segments

NOISE, BLOCKS, ROOTS = set(segments.NOISE), set(segments.BLOCKS), segments.ROOTS


def lines_of(spark, pages):
    df = spark.createDataFrame(list(enumerate(pages)), "doc int, html string")
    out = {i: [] for i in range(len(pages))}
    for r in sorted(segments.html_lines(df).collect(), key=lambda r: (r.doc, r.seq)):
        if r.text:
            out[r.doc].append((r.level, r.text))
    return [out[i] for i in range(len(pages))]


class Reader(html.parser.HTMLParser):
    """Tags one by one, with a stack of counters: independent of the operator's windows and patterns."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.noise = dict.fromkeys(NOISE, 0)
        self.open, self.seen = dict.fromkeys(ROOTS, 0), dict.fromkeys(ROOTS, 0)
        self.events, self.raw = [], 0
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.raw += 1
        elif tag in NOISE:
            self.noise[tag] += 1
        elif not any(self.noise.values()):
            if tag in ROOTS:
                self.open[tag] += 1
                self.seen[tag] += self.open[tag] == 1
            self.events.append(("start", tag, dict(self.open), dict(self.seen)))

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.raw = max(0, self.raw - 1)
        elif tag in NOISE:
            self.noise[tag] = max(0, self.noise[tag] - 1)
        elif not any(self.noise.values()):
            if tag in ROOTS:
                self.open[tag] = max(0, self.open[tag] - 1)
            self.events.append(("end", tag, dict(self.open), dict(self.seen)))

    def handle_data(self, data):
        if not self.raw and not any(self.noise.values()):
            self.events.append(("text", data, dict(self.open), dict(self.seen)))

    def lines(self):
        root = next((r for r in ROOTS if self.seen[r]), None)
        out, text, level = [], "", None
        for kind, value, opened, seen in self.events:
            if root and not (opened[root] and seen[root] == 1):
                continue
            if kind == "text":
                text += value
            elif value in BLOCKS:
                out.append((level, text))
                text, level = "", int(value[1]) if kind == "start" and re.fullmatch("h[1-6]", value) else None
        out.append((level, text))
        flat = [(lv, re.sub(r"[ \t\r\n]+", " ", t).strip(" ")) for lv, t in out]
        return [x for x in flat if x[1]]


CASES = {
    "nested article": ("<body><article><p>one</p><article>inner</article><p>after inner</p></article><p>outside</p></body>", ["one", "inner", "after inner"]),
    "nested noise": ("<body><aside>ad<aside>ad2</aside>LEAK</aside><p>text</p></body>", ["text"]),
    "quoted attribute": ("""<body><p title="a>b" data-x='c>d'>hello</p><a href="x?a=1&b=2">link</a></body>""", ["hello", "link"]),
    "references": ("<p>&aring; &rarr; &oslash; &Eacute; &#233;&#x20AC; &lt;b&gt; &amp;lt; &bogus; &</p>", ["å → ø É é€ <b> &lt; &bogus; &"]),
    "main before article": ("<body><article>first</article><main><p>x</p><div><main>y</main></div>z</main>tail</body>", ["x", "y", "z"]),
    "root in noise": ("<body><nav><main>menu</main></nav><article>text</article></body>", ["text"]),
    "stray ends": ("<body></aside></article></nav><p>kept</p></aside></body>", ["kept"]),
    "never closed": ("<body><article><p>a<p>b<aside>rest", ["a", "b"]),
    "no body": ("just <b>bold</b> text<br>next", ["just bold text", "next"]),
    "scripts": ("<body><script>if (a < b) { '<article>' }</script><style>p > a {}</style><!-- <main> --><p>a < b</p></body>", ["a < b"]),
    "table": ("<table><tr><th>h1</th><th>h2</th></tr><tr><td>a</td>\n<td><b>b</b></td><td></td></tr><tr><td>only</td></tr></table>", ["h1 | h2", "a | b |", "only"]),
    "self-closed": ("<body><svg/><p>x</p><svg><path d='M0'/>label</svg><p>y</p></body>", ["x", "y"]),
    "empty": ("", []),
}


def test_cases(spark):
    found = lines_of(spark, [p for p, _ in CASES.values()])
    assert {k: [t for _, t in x] for k, x in zip(CASES, found, strict=True)} == {k: w for k, (_, w) in CASES.items()}


def test_against_a_plain_reader(spark):
    """Random pages, well formed and not."""
    r = random.Random(11)
    tags = [*ROOTS, "aside", "nav", "form", "div", "p", "h2", "b", "li", "section", "span"]
    pages = []
    for k in range(120):
        out, stack = ["<html><body>"], []
        for i in range(r.randint(1, 60)):
            x = r.random()
            if x < 0.35:
                tag = r.choice(tags)
                stack.append(tag)
                out.append(f'<{tag} class="c{i}"' + (' title="x > y"' if i % 7 == 0 else "") + ">")
            elif x < 0.6 and stack:
                out.append(f"</{stack.pop()}>")
            elif x < 0.65:
                out.append(f"</{r.choice(tags)}>")  # an end that fits nothing
            else:
                out.append(f"t{i} &eacute;\n w{i} ")
        pages.append("".join(out + [f"</{t}>" for t in reversed(stack)] + (["</body></html>"] if k % 3 else [])))
    for page, found in zip(pages, lines_of(spark, pages), strict=True):
        assert found == Reader(page).lines(), page


def test_all_named_references(spark):
    names = [n for n in html.entities.html5 if n.endswith(";")]
    df = spark.createDataFrame([(n, f"x&{n}y") for n in names], "n string, t string")
    assert all(r.d == f"x{html.entities.html5[r.n]}y" for r in df.select("n", segments.decode_references(F.col("t")).alias("d")).collect())


@pytest.mark.parametrize("page", ["<a " + "x='" * 3, "<" * 50_000, "<p title=" + "x" * 100_000, '<p a="' + "y>" * 60_000, "<!--" + "-" * 50_000, "<aside>" * 20_000 + "x" + "</aside>" * 20_000 + "end"])
def test_hostile_pages(spark, page):
    found = lines_of(spark, [page, None])
    assert found[1] == [] and all(isinstance(t, str) for _, t in found[0])
