"""The small labelled table that HTML extraction is trained on: pages whose main blocks are marked.

The pages are put together from frames (where the article stands) and furniture (everything else),
with invented text of all lengths in both, so that place and markup, not length, tell them apart;
some pages have no telling markup, and there length and links do. A main block's text begins with
``MARK``.
"""

from __future__ import annotations

import random

MARK = "\ue000"  # a private-use character, in no page

_SYLLABLES = ["ta", "re", "mi", "on", "el", "su", "vo", "ka", "den", "ilo", "är", "éna", "pol", "gri", "ües"]

# the article's frame, its heading and its paragraph
FRAMES = [
    ("<article>{}</article>", "h1", "p"),
    ("<article class='post'><header>{h}</header>{}</article>", "h1", "p"),
    ("<main><article>{}</article></main>", "h1", "p"),
    ("<main id='main'>{}</main>", "h2", "p"),
    ("<div class='content'>{}</div>", "h1", "p"),
    ("<div id='article-body' class='entry-content'>{}</div>", "h1", "p"),
    ("<section class='story'>{}</section>", "h2", "p"),
    ("<div class='wrap'><div class='post-body'>{}</div></div>", "h1", "p"),
    ("<table><tr><td class='text'>{}</td></tr></table>", "h1", "p"),
    ("<div itemprop='articleBody' class='text'>{}</div>", "h1", "div"),
    ("<article>{}</article>", "h1", "p"),
    ("{}", "h1", "p"),
    ("<article>{}</article>", "h2", "div"),
    ("<div class='story-text'>{}</div>", "h1", "div"),
    ("<main>{}</main>", "h1", "section"),
    ("<article>{}</article>", "h1", ""),
    ("<div class='content'>{}</div>", "h2", ""),
]
# furniture that holds links
LINKS = [
    "<nav><ul>{}</ul></nav>", "<nav class='menu main-menu'><ul>{}</ul></nav>", "<div class='menu'><ul>{}</ul></div>",
    "<ul class='navigation nav'>{}</ul>", "<div id='sidebar' class='sidebar'><ul>{}</ul></div>", "<aside><h3>{t}</h3><ul>{}</ul></aside>",
    "<div class='related'><h3>{t}</h3><ul>{}</ul></div>", "<div class='breadcrumb'><ul>{}</ul></div>", "<footer><ul>{}</ul></footer>",
    "<div class='share social'><ul>{}</ul></div>", "<header><nav><ul>{}</ul></nav></header>", "<div class='tags'><ul>{}</ul></div>",
]
# furniture that holds prose
PROSE = [
    "<div class='ad'>{}</div>", "<div class='ads advert'><p>{}</p></div>", "<aside class='advertisement sponsored promo'><p>{}</p></aside>",
    "<header>{}</header>", "<header class='site-header'><h1>{}</h1><p>{}</p></header>", "<div id='header' class='header banner'><p>{}</p></div>",
    "<footer>&copy; {} &middot; {}</footer>", "<footer><p>{}</p><p>{}</p></footer>", "<div id='footer' class='footer copyright'><p>{}</p></div>",
    "<aside><p>{}</p></aside>", "<aside class='sidebar'><h2>{}</h2><p>{}</p></aside>", "<div class='sidebar widget'><p>{}</p></div>",
    "<div class='cookie notice'><p>{}</p><button>{w}</button></div>", "<div class='cookie-banner consent gdpr'>{}</div>",
    "<div class='notice alert popup' role='alert'><p>{}</p></div>", "<div class='newsletter subscribe signup'><p>{}</p></div>",
    "<form><label>{w}</label><select><option>{w}</option></select><button>{w}</button><p>{}</p></form>",
    "<form class='search'><label>{}</label><textarea>{}</textarea></form>", "<noscript>{}</noscript>",
    "<div class='disclaimer legal'><p>{}</p></div>",
]
# stands at the article's end, in it or after it
COMMENTS = [
    "<section id='comments' class='comments'><h2>{w}</h2><div class='comment'><p>{}</p></div><div class='comment'><p>{}</p></div></section>",
    "<div class='comment-list'><h3>{w}</h3><ol><li class='comment'><p>{}</p></li><li class='comment reply'><p>{}</p></li></ol></div>",
    "<div id='disqus_thread' class='comments discussion'><p>{}</p><p>{}</p></div>",
    "<ul class='comments'><li>{}</li><li>{}</li></ul>",
    "<section id='comments'><p>{}</p></section>", "<section class='comments'><p>{}</p><p>{}</p><p>{}</p></section>", "<div class='comment'>{}</div>",
    "<section class='reader-comments'><h2>{w}</h2><article><p>{}</p></article><article class='comment'><p>{}</p></article></section>",
    "<div id='comments'><div><p>{}</p></div><div><p>{}</p></div></div>", "<div class='replies reader responses'><p>{}</p></div>",
]
# blocks of an article besides paragraphs
INNER = ["<ul><li>{m}</li><li>{m}</li></ul>", "<blockquote><p>{m}</p></blockquote>", "<h2>{m}</h2>", "<pre>{m}</pre>", "<ol><li>{m}</li></ol>",
         "<table><tr><td>{m}</td><td>{m}</td></tr></table>", "<figure><figcaption>{m}</figcaption></figure>", "<h3>{m}</h3>"]


def labelled_pages(count: int = 600, seed: int = 7) -> list[str]:
    """``count`` pages, the same at every call."""
    rng = random.Random(seed)

    def word() -> str:
        return "".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 4)))

    def prose(most: int = 60) -> str:
        n = rng.choice([1, 2, 4, 8, 15, 30, most])
        return " ".join(word() for _ in range(n)).capitalize() + rng.choice([".", ".", ".", "", "!", "?"])

    def fill(piece: str) -> str:
        while "{" in piece:
            piece = piece.replace("{}", prose(), 1) if "{}" in piece else piece.replace("{w}", word(), 1).replace("{t}", word(), 1).replace("{m}", MARK + prose(), 1)
        return piece

    def links() -> str:
        items = "".join(f"<li><a href='/{word()}'>{rng.choice([word(), word(), prose(4)])}</a></li>" for _ in range(rng.randint(1, 8)))
        return fill(rng.choice(LINKS).replace("{}", items))

    def article(frame: str, head: str, para: str) -> str:
        heading = f"<{head}>{MARK}{prose(15)}</{head}>"
        parts = [] if "{h}" in frame else [heading]
        if not para:  # the text stands in the frame itself
            parts = rng.choice([[], [], parts]) + [MARK + prose() + "<br>" + prose()]
        for _ in range(rng.randint(1, 8) if para else 0):
            r = rng.random()
            text = MARK + prose()
            text = text if r > 0.3 else text + f" <a href='#'>{word()}</a> <b>{word()}</b>"
            parts.append(f"<{para}><b>{text}<br>" if r > 0.9 and para == "p" else f"<{para}>{text}</{para}>")
            if rng.random() < 0.15:
                parts.append(fill(rng.choice(INNER)))
            if rng.random() < 0.15:
                parts.append(fill(rng.choice(PROSE[:3] + ["<div class='share'>{}</div>", "<nav class='toc'>{}</nav>", "<aside class='related'>{}</aside>"])))
        if rng.random() < 0.15:
            parts.append(fill(rng.choice(COMMENTS)))
        return frame.replace("{h}", heading).replace("{}", "".join(parts))

    def plain() -> str:
        """No telling markup: short pieces and links around long paragraphs."""
        def short() -> str:
            return "".join(rng.choice([f"<div>{word()}</div>", f"<div><a href='/'>{word()}</a> | <a href='/'>{word()}</a></div>"]) for _ in range(rng.randint(1, 4)))

        long = "".join(f"<div>{MARK}{' '.join(word() for _ in range(rng.randint(15, 60)))}.</div>" for _ in range(rng.randint(2, 6)))
        return short() + "<div>" + long + "</div>" + short()

    pages = []
    for i in range(count):
        before = [links() if rng.random() < 0.5 else fill(rng.choice(PROSE)) for _ in range(rng.randint(1, 4))]
        after = [links() if rng.random() < 0.4 else fill(rng.choice(PROSE)) for _ in range(rng.randint(1, 4))]
        if rng.random() < 0.4:
            after.insert(0, fill(rng.choice(COMMENTS)))
        body = plain() if i % 8 == 7 else "".join(before) + article(*FRAMES[i % len(FRAMES)]) + "".join(after)
        body = f"<div id='page' class='container'>{body}</div>" if rng.random() < 0.3 else body
        pages.append(f"<!DOCTYPE html><html><head><title>{word()}</title></head><body>{body}</body></html>")
    return pages
