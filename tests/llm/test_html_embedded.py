import pytest

from tidemark.llm.html_text import main_text

WORDS = "plain text of an article that goes on for quite a while with more words"


@pytest.mark.parametrize("name", ["svg", "object", "canvas", "audio", "video", "noscript", "template"])
def test_unclosed_elements_keep_what_follows(name):
    assert main_text(f"<article><p>{WORDS}</p><{name} width=1><p>{WORDS} end</p></article>") == f"{WORDS}\n{WORDS} end"
    assert main_text(f"<article><{name}><p>{WORDS}</p><{name}>no</{name}></article>") == WORDS
    assert main_text(f"<article><p>{WORDS}</p><{name}><{name}>no</{name}>nor this</{name}><p>{WORDS} end</p></article>") == f"{WORDS}\n{WORDS} end"


def test_math_is_text():
    assert main_text(f"<article><p>{WORDS} <math><mi>x</mi><mo>=</mo><mn>2</mn></math> then</p></article>") == f"{WORDS} x=2 then"


def test_unclosed_script_is_raw():
    assert main_text(f"<article><p>{WORDS}</p><script>var x = 1; <p>{WORDS}</p>") == WORDS
