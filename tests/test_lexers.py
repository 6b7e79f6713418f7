"""The readers of JavaScript, Ruby and HCL: what is code, and that any text is read to its end."""

import random

import pytest

from cairngraph.operators import config, javascript, js_lexer, ruby, ruby_lexer
from cairngraph.operators.base import Context
from cairngraph.operators.hcl import parse

PIECES = ["'", '"', "`", "${", "#{", "}", "{", "(", ")", "[", "]", "/", "//", "/*", "*/", "\\", "\n", " ", "<", ">", "</", "/>", "<a ", "<<~A", "<<-A", "<<A\n", "A", "\nA\n", "%w[", "%", "?", ":", "=", "==", ",", ";", "#",
          "class K", "def m", "end", "do", "if ", "x", "1", "return ", "=>", "import a from 'b'", "function f() {", "=begin\n", "=end\n", "__END__\n", 'resource "a" "b" {', "é", "😀", "|", "&&", "++", "."]


@pytest.mark.parametrize("seed", range(4))
def test_any_text_is_read_to_its_end(seed):
    rnd = random.Random(seed)
    for _ in range(400):
        text = "".join(rnd.choice(PIECES) for _ in range(rnd.randrange(60)))
        for mask in (js_lexer.masked(text), js_lexer.masked(text, False), ruby_lexer.masked(text)):
            assert len(mask) == len(text) and all(a in (b, " ") for a, b in zip(mask, text, strict=True)) and mask.count("\n") == text.count("\n")
        assert len(js_lexer.scopes(mask)) == text.count("\n") + 1
        parse(text)
        for extract, path in ((javascript.extract, "a.tsx"), (ruby.extract, "a.rb"), (config.extract, "a.tf")):
            list(extract(path, text, Context()))


def test_deep_nesting_is_read():
    for text in ("{" * 5000, "<a>" * 5000, "x = <a b={" * 2000, "`${" * 5000, 'a = "${' * 3000, "b {" * 5000 + "}" * 5000, "a = {" * 3000):
        assert len(js_lexer.masked(text)) == len(text) == len(ruby_lexer.masked(text))
        parse(text)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a / b / c", "a / b / c"), ("x = /a'b/g;", "x =       ;"), ("f(/'/)", "f(   )"), ("a[0] / '1'", "a[0] / ' '"), ("if (a) /'/", "if (a)    "), ("f(a) / '/'", "f(a) / ' '"),
        ("return /'/", "return    "), ("a++ / 2 / b", "a++ / 2 / b"), ("/[/']/ + 1", "       + 1"), ("`a${b + `c${'d'}`}e`", "`   b + `   ' ' `  `"), ("// '\n'a'", "    \n' '"), ("'a\nb", "' \nb"),
        ("x = <p>it's</p>; 'a'", "x = <p>        ; ' '"), ("a < b > c", "a < b > c"), ("<><b c='d'/></>", "<><b c=' '/>   "), ("f = <T,>(x) => 'y'", "f = <T,>(x) => ' '"),
    ],
)
def test_javascript_code(text, want):
    assert js_lexer.masked(text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("x = 'a#b' # c", "x = '   '    "), ('"a#{b["c"]}d" + e', '"           " + e'), ("a = <<~X + 1\n  end\nX\nb", "a = <<   + 1\n     \n \nb"), ("a << B\nc", "a << B\nc"), ("x = %w[a b] + y", "x = %w[   ] + y"),
        ("a % b", "a % b"), ("a =~ /x'y/ ; z", "a =~ /   / ; z"), ("a / b / c", "a / b / c"), ("puts /'/", "puts / /"), ("c = ?' ; d", "c = ?  ; d"), ("a ? b : c", "a ? b : c"),
        ("=begin\nx\n=end\ny", "      \n \n    \ny"), ("a\n__END__\nb", "a\n       \n "),
    ],
)
def test_ruby_code(text, want):
    assert ruby_lexer.masked(text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("def a", ["def"]), ("return if x", []), ("if x", ["if"]), ("y = if x then 1 else 2 end", ["if", "end"]), ("while x do", ["while"]), ("x.each do |y|", ["do"]), ("begin", ["begin"]), ("end while x", ["end"]),
        ("def a = 1", []), ("def a=(v)", ["def"]), ("x.class", []), ("a = :end", []), ("{end: 1}", []), ("class << self", ["class"]), ("for i in x do", ["for"]), ("private def a(b) = b.begin", []), ("x if y unless z", []),
        ("loop do", ["do"]), ("case x when 1 then 2 end", ["case", "end"]), ("A::Begin.end", []),
    ],
)
def test_ruby_blocks(text, want):
    assert list(ruby_lexer.block_words(text)) == want


def test_hcl_structure():
    root, balanced = parse('a = 1\nb "c" d {\n  e = "f" # }\n  g { h = <<X\n}\nX\n i = "${"}"}" }\n}\nk = { "l" = "m", n : [1, "o"] }\n')
    assert balanced and [a.name for a in root.attributes] == ["a", "k"] and {n: f.text for n, f in root.attribute("k").fields.items()} == {"l": "m", "n": None}
    b = root.blocks[0]
    assert (b.type, b.labels, b.attribute("e").text) == ("b", ["c", "d"], "f") and b.blocks[0].attribute("h").text is None and b.blocks[0].attribute("i").text == '${"}"}'
    assert [a.name for a in b.strings()] == ["e", "i"]
    assert not parse("a {")[1] and not parse("a {}}")[1] and parse('a = "{" # {')[1]
    assert parse('a = "b" == "b" ? 1 : 2').__class__ is tuple and parse('a = "b" == "b" ? 1 : 2')[0].attribute("a").text is None
