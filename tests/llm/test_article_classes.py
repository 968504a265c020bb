"""Class names inside an article: whole names of boilerplate go, other names keep their text."""

import pytest

from lumenfold.llm import html

KEPT = ["ad-hoc", "cookie-recipe", "navigation-systems", "comment-history", "promo-codes-explained", "newsletter-history", "footer-note", "social", "skip", "share", "banner-history", "menu-of-the-day"]
GONE = ["ad", "ads", "ad-slot", "advert_box", "comments", "comment-list", "comment-thread-3", "cookie-banner", "cookie-notice", "newsletter-signup", "sidebar", "promo", "social-sharing"]


@pytest.mark.parametrize("name", KEPT)
def test_names_of_content_keep_their_text(name):
    page = f"<body><nav>Menu</nav><article><h1>Title</h1><div class='{name}'><p>Part of the text.</p></div><p>End.</p></article></body>"
    assert html.blocks(html.tree(page), frozenset()) == ["Title", "Part of the text.", "End."]


@pytest.mark.parametrize("name", GONE)
def test_names_of_boilerplate_go(name):
    page = f"<body><article><h1>Title</h1><div class='x {name}'><p>Noise.</p></div><p>End.</p></article><div id='{name}'>Noise.</div></body>"
    assert html.blocks(html.tree(page), frozenset()) == ["Title", "End."]
