"""Normalisation, corruptions, pages as text and addresses on hand-made cases."""

import pytest

from prosemill.functions import text as T
from prosemill.functions import urls


def meta(text, kind="prose"):
    return dict(zip([x.split()[0] for x in T.META.split(", ")], T.normalise_with_meta(text, kind), strict=True))


def test_prose_is_joined_by_paragraphs():
    m = meta("One line wraps here\nand continues.\n\nNew para.\n")
    assert m["text"] == "One line wraps here and continues.\n\nNew para." and m["replaced_single_newlines"] == 2 and not m["preserved_newlines"]
    m = meta("This is exam-\nple text, A-\nB and co‐\nop.")
    assert m["text"] == "This is example text, AB and coop." and m["joined_hyphen_breaks"] == 3


def test_lines_that_carry_meaning_stay():
    assert meta("First line\nSecond line\n", "poem")["text"] == "First line\nSecond line"
    verse = "\n".join(f"a short line {i}" for i in range(12))
    code = "```\nx = 1\n```"
    items = "\n".join(["intro text that is long enough to be prose and more"] + [f"- item number {i} with some words in it, quite long indeed" for i in range(6)])
    for t in (verse, code, items):
        assert meta(t)["text"] == t and meta(t)["preserved_newlines"]
    assert meta("\n".join("a line of prose that is clearly longer than verse would be" for _ in range(12)))["replaced_single_newlines"] == 11


def test_characters_after_compatibility_forms():
    assert T.normalise("a﹘b 5″ “x”…  y") == 'a--b 5\'\' "x"... y'
    m = meta("﻿ze​ro soft­hyphen")
    assert m["text"] == "zero softhyphen" and (m["removed_zero_width_chars"], m["removed_soft_hyphens"]) == (1, 1)
    assert T.normalise(None) is None and T.normalise("") == "" and meta("same")["applied"] is False


def test_boilerplate_between_marks():
    book = "Header\n*** START OF THE PROJECT GUTENBERG EBOOK TEST ***\nBody line one.\nBody line two.\n*** END OF THE PROJECT GUTENBERG EBOOK TEST ***\nFooter\n"
    assert meta(book)["text"] == "Body line one. Body line two." and meta(book)["stripped_boilerplate"]
    assert not meta("*** START OF something *** text")["stripped_boilerplate"]
    assert T.without_boilerplate("Project Gutenberg eBook\nno marks") == ("Project Gutenberg eBook\nno marks", False)


@pytest.mark.parametrize("seed", ["1", "2", "3"])
def test_corruptions(seed):
    text = "One is here. Two is there! Three?\n\nFour now. Five later.\n\nSix alone."
    two = "First one. Second one."
    assert T.corrupt(two, "shuffle_sentences", seed) == "Second one. First one."
    got = T.corrupt(text, "shuffle_all_sentences", seed)
    assert [len(T._sentences(p)) for p in got.split("\n\n")] == [3, 2, 1] and got != text
    assert sorted(s for p in got.split("\n\n") for s in T._sentences(p)) == sorted(s for p in text.split("\n\n") for s in T._sentences(p))
    assert T.corrupt("A b. C d.\n\nE f.", "shuffle_all_sentences", seed) == "C d. A b.\n\nE f."
    assert T.corrupt("Only one sentence.", "repeat_sentences", seed) == "Only one sentence."
    assert sorted(T.corrupt(text, "shuffle_paragraphs", seed).split("\n\n")) == sorted(text.split("\n\n")) and T.corrupt(two, "shuffle_paragraphs", seed) == two
    assert T.corrupt("a, b. (c) “d” e-f `g`\n\n\nh;  i", "drop_punctuation", seed) == "a b (c) d e-f g\n\n\nh i"
    assert T.corrupt(text, "flatten_paragraphs", seed) == text.replace("\n\n", " ")
    assert all(T.corrupt("", k, seed) == "" for k in T.KINDS)


def test_pages_as_text():
    page = "<html><head><style>p{}</style><script>var t='</p>';</script></head><body><!-- no --><h1>A &amp; B</h1><p>one <b>two</b><br>three</p>\r\n<ul><li>x</li><li>&#8212; y &lt;z&gt;</li></ul>2 < 3</body></html>"
    assert T.html_text(page) == "A & B\none twothree\n\nx\n— y <z>\n2 < 3"
    assert T.html_text(None) is None and T.html_text("") == ""


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://1.1.1.1/example", "ok"), ("http://example.com:8080/a?b#c", "ok"), ("HTTP://Example.com", "ok"), ("file:///etc/passwd", "scheme"), ("", "scheme"), (None, "scheme"), ("example.com", "scheme"), ("http://a:b@example.com/", "userinfo"),
        ("http://@example.com/", "userinfo"), ("http://localhost/admin", "host"), ("http://localhost./", "host"), ("http://a.localhost/", "host"), ("http:///x", "host"), ("http://[::1", "host"), ("http://exa mple.com/", "host"), ("http://example.com:x/", "host"),
        ("http://127.0.0.1:8000/", "address"), ("http://10.1.2.3", "address"), ("http://169.254.169.254/latest/meta-data", "address"), ("http://172.31.0.1", "address"), ("http://192.168.1.1.", "address"), ("http://224.0.0.1", "address"), ("http://0.0.0.0", "address"),
        ("http://[::1]/x", "address"), ("http://[fd00::1]/", "address"), ("http://[fe80::1%25eth0]/", "address"), ("http://[::ffff:127.0.0.1]/", "address"), ("http://[2002:7f00:1::]/", "address"), ("http://[2606:4700:4700::1111]/", "ok"),
        ("http://2130706433/", "address"), ("http://0x7f000001/", "address"), ("http://0x7f.1/", "address"), ("http://017700000001/", "address"), ("http://127.1/", "address"), ("http://16843009/", "ok"), ("http://0x/", "address"), ("http://1.2.3.4.5/", "ok"),
    ],
)
def test_addresses(url, want):
    assert urls.verdict(url) == want


def test_redirects():
    assert urls.redirect("https://public.example/start", "/next/page") == ("https://public.example/next/page", "ok")
    assert urls.redirect("https://public.example/start", "http://169.254.169.254/latest")[1] == "address"
    assert urls.redirect("https://public.example/a", "//localhost/b") == ("https://localhost/b", "host")
    assert urls.redirect("https://public.example/a", "javascript:alert(1)")[1] == "scheme"
    assert urls.redirect(None, "/x") == (None, "host") == urls.redirect("https://a.example", " ")
