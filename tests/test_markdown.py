import random

import pytest

from plainfold.markdown import blocks, inline, kernel
from plainfold.options import Options, merged


def cuts(text):
    out, at = [], 0
    for a, b in kernel.sentence_breaks(text, set(Options().abbreviations)):
        out.append(text[at:a])
        at = b
    return [*out, text[at:]]


@pytest.mark.parametrize(
    "marked",
    [
        "This is one.|This is two.",
        "Dr. Hale met Mrs. Hale there.|Then both went home.",
        "Bring rope, lamps, etc. We go at dawn.",
        "Wait... what was that.",
        "Hold on...|Something moved.",
        'She called "I am here."|Then silence.',
        "It is so (I saw it.)|Moving along.",
        "See part one.|2 comes after it.",
        'He was done.|"And now?"|She asked.',
        "J. R. R. Stone wrote it.|All agreed.",
        "A sentence ends.|`code` follows.",
        "A sentence ends.|**Bold** follows.",
        "A sentence ends.|_Under_ follows.",
        "A sentence ends.|***Both*** follow.",
        "A sentence ends. `unmatched follows.",
        "A sentence ends. *unmatched follows.",
        "A sentence ends. lowercase follows.",
        r"A sentence ends. \*escaped* follows.",
        "(e.g.|Foo) splits, as the word is not the abbreviation alone.",
    ],
)
def test_sentences(marked):
    assert cuts(marked.replace("|", " ")) == marked.split("|")


@pytest.mark.parametrize(
    ("source", "skips"),
    [
        ("Fine words.\n\n[label]: /url\nwords below it\n", [(4, 4, "link-ref-def-neighbor")]),
        ("Words with `x[0]: bang` in\nthem on two lines.\n", [(1, 2, "link-ref-def-shape")]),
        ("> * > deep words\n", [(1, 1, "deep-nesting")]),
        ("<Widget attr\nmore>\n", [(1, 2, "unterminated-tag")]),
        ("words with a \x01 in them\nsecond line\n", [(1, 2, "control-bytes")]),
        ("words with <!DOCTYPE in them\nsecond line\n", [(1, 2, "raw-html-decl-opener")]),
        ("{props}\n", [(1, 1, "dialect-block")]),
        ("$$\nx\n$$\n", [(1, 3, "dialect-block")]),
        ("import A from 'a'\nexport default A\n", [(1, 2, "dialect-block")]),
        ("All is well here.\nAnd here.\n", []),
        ("---\nkey: {x}\n---\n\nText.\n", []),
        (None, []),
    ],
)
def test_explain(source, skips):
    assert kernel.explain(source) == skips


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("One. Two.\nThree\ngoes on.\n", "One.\nTwo.\nThree goes on.\n"),
        ("# Head. Line.\n\n- Item one. Item two.\n  More.\n", "# Head. Line.\n\n- Item one.\n  Item two.\n  More.\n"),
        ("> Quote one. Quote two.\nlazy line.\n", "> Quote one.\n> Quote two. lazy line.\n"),
        ("1. First. Second.\n   > In it. Again.\n", "1. First.\n   Second.\n   > In it.\n   > Again.\n"),
        ("```\nCode. Stays. Here.\n```\n\n    More. Code.\n", "```\nCode. Stays. Here.\n```\n\n    More. Code.\n"),
        ("Hard  \nbreak. And on.\n", "Hard\\\nbreak.\nAnd on.\n"),
        ("Hard\\\nbreak<br />\nhere.\n", "Hard\\\nbreak<br>\nhere.\n"),
        ("A list follows. 1. Not a list.\n", "A list follows.\n1\\.\nNot a list.\n"),
        ("| a | b |\n|---|---|\n| x. Y. | z |\n\nAfter. Words.\n", "| a | b |\n|---|---|\n| x. Y. | z |\n\nAfter.\nWords.\n"),
        ("See [a link. With stops](http://x.y/A.B) here. End.\n", "See [a link. With stops](http://x.y/A.B) here.\nEnd.\n"),
        ("Dashes below. Head?\n---\n\nText. More.\n", "Dashes below. Head?\n---\n\nText.\nMore.\n"),
        ("---\ntitle: A. B.\n---\nText. More.\n", "---\ntitle: A. B.\n---\nText.\nMore.\n"),
        ("::: note\nInside. Text.\n:::\n", "::: note\nInside.\nText.\n:::\n"),
        ("> [!NOTE]\n> Mind this. And that.\n", "> [!NOTE]\n> Mind this.\n> And that.\n"),
        ("<div>\nRaw. Text.\n</div>\n", "<div>\nRaw. Text.\n</div>\n"),
        ("", ""),
        ("\n\n", "\n\n"),
    ],
)
def test_reflow(source, want):
    assert kernel.reflow(source) == want
    assert kernel.reflow(want) == want


def test_modes():
    text = "The first clause runs on, and a second one follows it closely; then a third. Short one.\n"
    assert kernel.reflow(text, Options("para")) == text
    assert kernel.reflow(text, Options("wrap", max_width=30)) == "The first clause runs on, and\na second one follows it\nclosely; then a third. Short\none.\n"
    assert kernel.reflow(text, Options("sentence", max_width=40)) == "The first clause runs on,\nand a second one follows it closely;\nthen a third.\nShort one.\n"
    assert kernel.reflow("a  \nb\n", Options(dialect="mkdocs")) == "a  \nb\n"
    assert kernel.reflow("one two\n", Options(segmenter=lambda t: [(t.index(" "), t.index(" ") + 1)] if " " in t else [])) == "one\ntwo\n"


@pytest.mark.parametrize(
    ("line", "want"),
    [("1. x", "1\\. x"), ("12) x", "12\\) x"), ("# x", "\\# x"), ("#x", "#x"), ("> x", "\\> x"), ("- x", "\\- x"), ("-x", "-x"), ("***", "\\***"), ("===", "\\==="), ("```", "&#96;&#96;&#96;"), ("~~~", "\\~\\~\\~"), ("<div>", "\\<div>"), ("[a]: /b", "\\[a]: /b"), ("|-|-|", "\\|-|-|"), ("plain", "plain")],
)
def test_escapes(line, want):
    assert kernel.escaped(line) == want


def test_options():
    for bad in ({"mode": "x"}, {"dialect": "commonmark"}, {"dialect": "x"}, {"mode": "para", "max_width": 40}, {"max_width": 19}, {"max_width": -1}):
        with pytest.raises(ValueError):
            Options(**bad)
    assert merged({"max_width": 0}, {"max_width": 50}).max_width == 0
    assert "zzz." in merged({}, {"abbreviations": ["Zzz."]}).abbreviations


def test_random_markdown_settles():
    r = random.Random(6)
    bits = ["A word. ", "Another, one; ", "\n", "\n\n", "- ", "> ", "1. ", "`co. De`", "*em. Ph*", "[l. K](u)", "# ", "```\n", "  \n", "\\\n", "<br>\n", "| a | b |\n|-|-|\n", "[x]: y\n", "{z}\n", "    ", "\t", "$$\n", "<div>\n", "~~~\n", "***\n", "&amp; ", "http://a.b/C. D "]
    for k in range(1500):
        text = "".join(r.choice(bits) for _ in range(r.randint(1, 14)))
        o = r.choice([Options(), Options("para"), Options("wrap", max_width=24), Options("sentence", "mkdocs", 30)])
        out = kernel.reflow(text, o)
        assert kernel.reflow(out, o) == out or kernel.rendered(kernel.reflow(out, o)) == kernel.rendered(text), (text, o)
        kernel.explain(text, o)
        assert kernel.rendered(out) == kernel.rendered(text)


def test_block_kinds():
    kinds = [b.kind for b in blocks.scan("a\n===\n\n* x\n\n  y\n* z\n\n---\n<!-- c\n-->\n[q]: /r\npara\n".split("\n"))]
    assert kinds == ["heading", "para", "para", "para", "rule", "html", "def", "para"]


def test_spans():
    t = "a `b c` [d e](f) <i> http://x.y/z, end"
    assert [t[a:b] for a, b, _ in inline.spans(t)] == ["`b c`", "[d e](f)", "<i>", "http://x.y/z"]


def test_time_is_in_proportion_to_the_text():
    import time

    for word in ("to ", "a ", "longer, words; and more. "):
        took = []
        for n in (4000, 16000):
            text = word * (n // len(word)) + "`c`"
            for o in (Options("wrap"), Options("sentence", max_width=80)):
                began = time.process_time()
                kernel.reflow(text, o)
                took.append(time.process_time() - began)
        assert max(took[2:]) < 12 * max(max(took[:2]), 0.02)


def test_widths_by_hand():
    text = "a  b `c  d`\t\te \r f"
    w = kernel._Widths(text, inline.no_break_spans(text))
    assert w(0, len(text)) == len("a b `c  d` e f") and w(0, 4) == 3 and w(4, 11) == 7
    assert w._shown(0, len(text)) == "a b `c  d` e f"
    assert kernel._Widths("- x", []).fits(0, 3, 3) is False  # an escape would make it longer


def brute_wrap(text, width):
    """The longest line that fits, by trying all cuts."""
    words, out = text.split(" "), []
    while words:
        k = max((k for k in range(1, len(words) + 1) if len(kernel.escaped(" ".join(words[:k]))) <= width), default=1)
        out.append(" ".join(words[:k]))
        words = words[k:]
    return out


def test_wrap_equals_trying_all_cuts():
    r = random.Random(3)
    for _ in range(400):
        text = " ".join(r.choice(["a", "be", "sea", "-", "1.", "#", "+", "letters", "extraordinarily", "x."]) for _ in range(r.randint(1, 40)))
        text = "go " + text
        width = r.randint(5, 30)
        cuts = [(i, i + 1) for i, c in enumerate(text) if c == " "]
        assert kernel._ranked(text, [], cuts, [], width) == brute_wrap(text, width), (text, width)


BODY = "    The body's sentence is long enough that it must go onto more than one line."


@pytest.mark.parametrize("marker", ["!!! note", '!!! note "Title"', '???+ tip "Open"', "??? tip", '!!! note inline end "T"'])
def test_admonition_bodies(marker):
    o = Options("wrap", "mkdocs", 40)
    source = f"{marker}\n\n{BODY}\n\nAfter.\n"
    want = f"{marker}\n\n    The body's sentence is long enough that\n    it must go onto more than one line.\n\nAfter.\n"
    assert kernel.reflow(source, o) == want and kernel.reflow(want, o) == want
    assert kernel.reflow(source, Options("wrap", "gfm", 40)) == source


@pytest.mark.parametrize(
    "source",
    [
        f"Words.\n\n{BODY}\n",
        f"!!!\n\n{BODY}\n",
        f"!!! note\nmore\n\n{BODY}\n",
        f"!!! note\n\n{BODY}\n\n{BODY}\n",
        f"!!! note\n\n {BODY}\n",
        "!!! note\n\n    ```\n    some code that is far too long for a line of this width\n    ```\n",
        "!!! note\n\n    some words that fill nearly a whole - and then what would be a list item\n",
    ],
)
def test_indented_code_stays(source):
    assert kernel.reflow(source, Options("wrap", "mkdocs", 36)) in (source, source.replace("!!! note\nmore", "!!! note\n    more"))


def test_rare_line_ends_and_checkboxes():
    for text in ("0 \\\r\r\n:::\n", "words  \r\r\nmore. And more.\n"):
        assert kernel.reflow(text) == text
    assert kernel.reflow("a\r\r\nb\n") == "a b\n"
    assert "<br>" not in kernel.rendered("* [X]  \n0\n") and kernel.rendered(kernel.reflow("* [X]  \n0\n")) == kernel.rendered("* [X]  \n0\n")
    assert kernel.reflow("* y  \n  0\n") == "* y\\\n  0\n"


@pytest.mark.parametrize(
    ("source", "frozen"),
    [("- [foo\n\nbar\n", False), ("# x [foo\nbar]: baz. And.\n", True), ("# [a]: b\nprose. More.\n", False), ("# some words [a]: /b\nprose. More.\n", False)],
)
def test_definitions_reach_into_a_paragraph(source, frozen):
    assert any(r.startswith("link-ref") for _, _, r in kernel.explain(source)) == frozen, kernel.explain(source)


def test_reasons_that_only_a_broken_scan_gives():
    lines = ["one", "two", "three"]
    gap = blocks.Block("para", [(0, 0), (2, 0)])
    assert kernel._frozen(gap, lines, [False] * 3, [False] * 3, []) == "hidden-line-gap"
    para, definition = blocks.Block("para", [(0, 0), (1, 0)]), blocks.Block("def", [(1, 0)])
    assert kernel._frozen(para, lines, [False] * 3, [False] * 3, [definition]) == "duplicate-def-line"
    assert kernel.explain("| a | b |\n|---|---|\n| 1 | 2 |\n=\nx\n") == [(4, 5, "table-adjacency")]


def test_switches():
    text = "!*  \n0*\n"  # a break written as a backslash lets the emphasis open
    assert kernel.reflow(text) == text != kernel.reflow(text, Options(render_check=False))
    one = kernel.reflow("One. Two.\n", Options(settle=False))
    assert one == kernel._pass("One. Two.\n", Options()) == "One.\nTwo.\n"


@pytest.mark.parametrize("text", ["!!! ev BX1201\n", "!!!  ev BX1201\n", "!!!\tev BX1201\n", "0 \\\r\r\n:::", "* [X]  \n0", "1. - x y z. A b c.\n\n      Q r s. T u v.\n"])
@pytest.mark.parametrize("dialect", ["gfm", "mkdocs"])
def test_one_pass_is_enough(text, dialect):
    o = Options("wrap", dialect, 7, width_floor=False, settle=False)
    once = kernel.reflow(text, o)
    assert kernel.reflow(once, o) == once


def test_rendering():
    out = lambda t: kernel.rendered(t)
    assert out("*a **b** c* `x  y` [l](u \"t\") <i> \\* &amp; &#96;\n") == "<p><em>a <strong>b</strong> c</em> <code>x y</code> <link (u &quot;t&quot;)>l</link> <i> * &amp; `</p>"
    assert out("a  \nb\\\nc<BR />\nd\n") == "<p>a<br> b<br> c<br> d</p>"
    assert out("- a\n- b\n") == "<list> <item> <p>a</p> </item> <item> <p>b</p>"
    assert out("a\nb\n") == out("a b\n") != out("a\n\nb\n")
    assert out("***a** b*\n") == "<p><em><strong>a</strong> b</em></p>"
    assert out("- a\n  - b\n") != out("- a\n- b\n") and out("> a\n") != out("a\n") and out("# a\n") != out("a\n")
    for a, b in (("x *y z*\n", "x \\*y z*\n"), ("1. a\n", "1\\. a\n"), ("a `b` c\n", "a b c\n"), ("[a]: b\n\n[a]\n", "[a]\n")):
        assert out(a) != out(b)
