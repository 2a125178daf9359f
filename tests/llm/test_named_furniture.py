"""Names of furniture on elements that hold the main text, and beside it."""

import pytest

from misheard.llm import tag_paths

TEXT = "<h1>Head</h1><p>First paragraph, with text. And more, of it.</p><p>Second: it is longer, with marks, and so on.</p>"
LINES = "Head\nFirst paragraph, with text. And more, of it.\nSecond: it is longer, with marks, and so on."


@pytest.mark.parametrize(
    "name",
    ["layout has-sidebar", "content with-sidebar", "col no-sidebar", "page-wrapper nav-open", "sidebar", "widget",
     "elementor-widget-theme-post-content", "footnotes"],
)
@pytest.mark.parametrize("inner", ["article", "div"])
def test_a_name_does_not_drop_the_main_text(name, inner):
    page = f'<body><nav>menu</nav><div class="{name}"><{inner}>{TEXT}</{inner}></div><footer>Foot</footer>'
    assert tag_paths.extract(page) == LINES


@pytest.mark.parametrize("name", ["sidebar", "cookie-notice", "comments", "share_buttons social"])
def test_named_furniture_beside_the_text_is_left_out(name):
    page = f'<body><div class="x">{TEXT}<div class="{name}"><p>Reader, one: a note.</p></div></div>'
    assert tag_paths.extract(page) == LINES
