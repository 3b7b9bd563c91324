"""Parts that are never content do not cut an article."""

import pytest

from tarn.llm import html_text


@pytest.mark.parametrize("part", ["<aside>{}</aside>", "<div class='ad-slot'><p>{}</p></div>", "<form><p>{}</p></form>", "<nav><ul><li>{}</li></ul></nav>"])
@pytest.mark.parametrize("around", ["<article>{}</article>", "<div class='post-content'><div>{}</div></div>"])
def test_a_long_aside_keeps_both_ends_of_the_article(part, around):
    lead, end = "lead " * 11 + "lead", "body " * 299 + "body"
    aside = part.format("other " * 40)
    page = "<body><nav><a href='/'>Home</a></nav>" + around + "<footer>foot words here</footer></body>"
    assert html_text.main_text(page.format(f"<h1>Title</h1><p>{lead}</p>{aside}<p>{end}</p>")) == f"Title\n\n{lead}\n\n{end}"
    assert html_text.main_text(page.format(f"<h1>Title</h1><p>{end}</p>{part.format('other ' * 400)}<p>{lead}</p>")) == f"Title\n\n{end}\n\n{lead}"


def test_a_long_side_outside_still_ends_the_text():
    assert html_text.main_text("<aside>" + "other " * 40 + "</aside><p>" + "body " * 30 + "</p>") == " ".join(["body"] * 30)
