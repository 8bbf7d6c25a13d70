"""HTML extraction: odd markup, pages without names, and a plain twin over the test pages."""

import time
from html.parser import HTMLParser

import pyarrow.parquet as pq
import regex
from conftest import SMALL

from assayer.llm import html_text

PAGES = pq.read_table(f"{SMALL}/pages.parquet", columns=["html"]).column(0).to_pylist()
PROSE = "The man who was there had seen it with his own eyes, and he said that it was not for them to judge. "


def test_a_head_that_is_not_closed():
    assert html_text.main_text(f"<html><head><title>t</title><article><p>{PROSE}</p></article>") == PROSE.strip()
    assert html_text.main_text(f"<head><meta charset=x><script>x</script><div><p>{PROSE}<p>{PROSE}</div>") == f"{PROSE}{PROSE}".strip()


def test_paragraphs_of_an_article_that_density_turns_away():
    page = f"<article><p>{PROSE}</p><p>© is a sign, and this is a paragraph about it.</p><p><a href=x>{PROSE}</a> so.</p><p>* * *</p><p>{PROSE}</p></article>"
    text = html_text.main_text(page)
    assert "© is a sign" in text and text.count("judge") == 3 and "so." in text and "* * *" in text


def test_other_languages_outside_a_main_element():
    russian = "Он не знал, что это было так, и всё же за ним кто-то шёл по улице, но он не видел его, а она из окна видела. " * 2
    chinese = "我不是一个在城里的人,我和他在一起的时候,这里的人都不知道我们是从哪里来的,也没有人在意。" * 3
    polish = "Dawno temu żył sobie król, który miał trzy córki. Każda była piękna. Najmłodsza kochała ogród, lecz nikt tego nie wiedział. "
    for text in (russian, chinese):
        assert html_text.main_text(f"<body><div><a href=/>Home</a> <a href=/x>More</a></div><div><p>{text}</p></div></body>") == text.strip()
    assert html_text.main_text(f"<body><div><p>{PROSE}</p><p>{polish}</p><p>{PROSE}</p></div></body>") == f"{PROSE}{polish}{PROSE}".strip()


def test_names_that_speak_for_and_against():
    assert html_text.main_text(f'<div class="story share"><p>{PROSE}</p><p>Short end.</p></div>') == f"{PROSE}Short end."
    assert html_text.main_text(f'<article><p>{PROSE}</p></article><div class="comments"><p>{PROSE}</p></div>') == PROSE.strip()


def test_odd_names_around_an_article():
    for wrapper in ('div id="side-effects"', 'div class="legal-analysis"', 'section class="search"', 'div class="recommendations-story"', 'div class="social policy"', 'table class="header"', 'div class="related share"', 'div id="foot"'):
        tag = wrapper.split()[0]
        cell = ("<tr><td>", "</td></tr>") if tag == "table" else ("", "")
        inside = f"<{wrapper}>{cell[0]}<h2>A title</h2><p>{PROSE}</p><p>Short end.</p><p>{PROSE}</p>{cell[1]}</{tag}>"
        want = f"A title {PROSE}Short end. {PROSE}".strip()
        assert html_text.main_text(f"<body>{inside}</body>") == want, wrapper
        assert html_text.main_text(f"<body><article>{inside}</article></body>") == want, wrapper


#: Pages as sites have them, each with its text marked by hand.
MARKED = [
    ('<div class="page"><div class="header-top"><a href=/>Home</a> <a href=/n>News</a></div><div class="article-body"><h1>T</h1><p>{P}</p></div><div class="sidebar-right"><p>{P}</p></div><div class="footer-legal">© 2020 All rights.</div></div>', "T {P}"),
    ('<body><div class="cookie-consent-banner"><p>{P}</p></div><div id="searchResults"><p>{P}</p></div><ul class="share-bar"><li>Tweet</li><li>Mail</li></ul></body>', "{P}"),
    ('<body><section id="comments-policy-review"><h2>Policy</h2><p>{P}</p></section><section id="comments"><p>{P}</p></section><div class="comment-list"><p>{P}</p></div></body>', "Policy {P}"),
    ('<body><div class="social"><a href=x>Like</a> us</div><main><p>{P}</p><div class="promo-box"><p>{P}</p></div><p>{P}</p><p class="legal">Terms apply.</p></main></body>', "{P} {P}"),
    ('<body><div class="adBox2"><p>{P}</p></div><p>{P}</p><aside class="story"><p>{P}</p></aside><span class="newsletter">{P}</span></body>', "{P}"),
    ('<body><div class="related-work"><h3>Related work</h3><p>{P}</p><ul><li>{P}</li></ul></div><div class="related-posts"><a href=1>One</a><a href=2>Two</a></div></body>', "Related work {P} {P}"),
]


def test_pages_marked_by_hand():
    for page, want in MARKED:
        assert html_text.main_text(page.replace("{P}", PROSE)) == want.replace("{P}", PROSE.strip()), page


def test_stray_end_tags_take_linear_time():
    took = []
    for n in (4000, 16000):
        page = "<div>" * n + "</span></section>" * n + f"<article><p>{PROSE}</p>"
        began = time.process_time()
        assert html_text.main_text(page) == PROSE.strip()
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0] + 0.2


def test_density_alone_finds_most_of_the_article():
    kept, found, right = 0, 0, 0
    for page in PAGES:
        truth = html_text.blocks_of(page or "")
        bare = html_text.blocks_of(regex.sub(r"<(/?)(article|main|nav|aside|footer|header|form)\b", r"<\1div", regex.sub(r"\s(class|id|role)=(\"[^\"]*\"|'[^']*'|[^\s>]+)", "", page or "")))
        assert [b.text for b in truth] == [b.text for b in bare]
        for blocks in (truth, bare):
            for b in blocks:
                b.label = html_text.first_pass(b)
            html_text.second_pass(blocks)
        pairs = [(a.label == html_text.GOOD, b.label == html_text.GOOD) for a, b in zip(truth, bare, strict=True)]
        kept += sum(a for a, _ in pairs)
        found += sum(b for _, b in pairs)
        right += sum(a and b for a, b in pairs)
    assert right / kept > 0.85 and right / found > 0.95


class Twin(HTMLParser):
    """Text of article elements outside of what its names call boilerplate, block by block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.blocks, self.now, self.head = [], [], "", False

    def inside(self):
        return any(t in ("article", "main") for t, _ in self.stack) and not any(bad for _, bad in self.stack)

    def cut(self):
        if text := " ".join(self.now.split()):
            self.blocks.append(text)
        self.now = ""

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.now += " "
        elif tag not in html_text.INLINE:
            self.cut()
            if tag in ("article", "main", "div", "section", "nav", "aside", "footer", "header", "form", "script", "style"):
                names = " ".join(v or "" for k, v in attrs if k in ("class", "id"))
                bad = tag in ("nav", "aside", "footer", "form", "script", "style") or names in ("ad", "sidebar", "comments", "cookie-banner", "related")
                self.stack.append((tag, bad))

    def handle_endtag(self, tag):
        if tag not in html_text.INLINE:
            self.cut()
            if tag in [t for t, _ in self.stack]:
                while self.stack.pop()[0] != tag:
                    pass

    def handle_data(self, data):
        if self.inside():
            self.now += data


def test_pages_equal_a_plain_twin():
    for page in PAGES:
        twin = Twin()
        twin.feed(page or "")
        twin.close()
        twin.cut()
        assert html_text.main_text(page) == " ".join(twin.blocks)
