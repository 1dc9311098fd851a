"""Seeded pages with known main text, to train the extractor on: the same kinds of parts under many names, orders and nestings."""

from __future__ import annotations

import random

#: Marks main text in training pages only.
MARK = "\x01"

_SYLLABLES = "an be co de er fi ga hi in ju ka lo mi no or pa que re st ti ou ver wh é ö ñ".split()


def prose(rng: random.Random, words: int) -> str:
    out = []
    for k in range(words):
        w = "".join(rng.choice(_SYLLABLES) for _ in range(rng.choice((1, 1, 2, 2, 3, 4))))
        out.append((w.capitalize() if k == 0 or out[-1].endswith(".") else w) + rng.choice(("", "", "", "", "", ",", ".", "&amp;" if rng.random() < 0.1 else "")))
    return " ".join(out)


def _named(rng: random.Random, tag: str, names: str, plain: float = 0.25) -> tuple[str, str]:
    """An element of a telling name or, now and then, of a name that tells nothing."""
    roll = rng.random()
    name = rng.choice(names.split("|")) if roll > plain else f"c{rng.randrange(999)}"
    return f'<{tag} {rng.choice(("class", "class", "id"))}="{name}">' if roll > plain / 2 else f"<{tag}>", f"</{tag}>"


def _links(rng: random.Random, n: int) -> str:
    items = [f'<a href="/{k}">{prose(rng, rng.randrange(1, 7))}</a>' for k in range(n)]
    return rng.choice(("<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>", " | ".join(items), "".join(f"<p>{i}</p>" for i in items),
                       "<ul>" + "".join(f"<li>{i}" for i in items) + "</ul>", "<table><tr>" + "".join(f"<td>{i}</td>" for i in items) + "</tr></table>"))


def _boiler(rng: random.Random) -> dict[str, str]:
    def wrap(tags: str, names: str, inner: str) -> str:
        tag = rng.choice(tags.split())
        a, b = _named(rng, tag, names, 0.4 if tag in ("nav", "aside", "header", "footer", "form") else 0.12)
        return a + inner + b

    short, some = prose(rng, rng.randrange(2, 9)), prose(rng, rng.randrange(4, 40))
    comment = lambda: wrap("div li article div", "comment|comment-body|reply|comment depth-1", f"<p>{prose(rng, rng.randrange(2, 60))}</p>" + rng.choice(("", f"<span>{short}</span>")))
    return {
        "header": wrap("header div", "header|site-header|masthead|top header", rng.choice((f"<h1>{short}</h1>", f"<p>{short}</p>", f'<a href="/">{short}</a>')) + rng.choice(("", f"<p>{some}</p>"))),
        "nav": wrap("nav nav div", "nav|menu|main-menu|navbar|breadcrumbs", _links(rng, rng.randrange(2, 14))),
        "notice": wrap("div div section aside", "cookie-notice|notice|consent banner|alert|gdpr-consent", f"<p>{some}</p>" + rng.choice(("", "<button>OK</button>", f'<a href="#">{short}</a>'))),
        "ad": wrap("div div aside", "ad|ads|advert|ad-slot|sponsor promo", rng.choice((some, f"<p>{some}</p>", f'<a href="/x">{some}</a>'))),
        "sidebar": wrap("aside div", "sidebar|side|widget|sidebar-right", f"<h3>{short}</h3>" + rng.choice((_links(rng, rng.randrange(2, 9)), f"<p>{some}</p>", f"<p>{some}</p><p>{short}</p>"))),
        "form": wrap("form form div", "signup-form|newsletter|search-form|login", f"<label>{short}</label><input name=q><textarea>{some}</textarea><button>{short}</button>" + rng.choice(("", f"<p>{some}</p>"))),
        "comments": wrap("section div ol", "comments|comment-list|respond|discussion comments", rng.choice(("", f"<h2>{short}</h2>")) + "".join(comment() for _ in range(rng.randrange(1, 9)))),
        "related": wrap("div section", "related|related-posts|recommended", f"<h3>{short}</h3>" + _links(rng, rng.randrange(2, 7))),
        "share": wrap("div ul", "share|social|share-buttons", _links(rng, rng.randrange(2, 5))),
        "footer": wrap("footer footer div", "footer|site-footer|copyright legal", rng.choice((f"&copy; {some}", f"<p>&copy; {short}</p>", f"<p>{some}</p>" + _links(rng, 3), some))),
    }


def _main(rng: random.Random, inside: list[str]) -> str:
    def text(n: int) -> str:
        return MARK + prose(rng, n)

    def paragraph() -> str:
        t = text(rng.choice((1, 3, rng.randrange(5, 40), rng.randrange(20, 150))))
        return rng.choice((f"<p>{t}</p>",) * 6 + (f"<p><b>{t}<br>", f"<p>{t}", f"<p>{t} <a href='/l'>{prose(rng, 3)}</a> {prose(rng, 9)}</p>", f"<p><em>{t}</em></p>"))

    parts = [paragraph() for _ in range(rng.choice((1, 1, 2, 3, rng.randrange(3, 12), rng.randrange(8, 40))))]
    extras = ("<ul>" + "".join(f"<li>{text(rng.randrange(3, 20))}</li>" for _ in range(4)) + "</ul>", f"<blockquote>{text(20)}</blockquote>",
              f"<blockquote><p>{text(25)}</p></blockquote>", f"<h2>{text(4)}</h2>", f"<pre>{text(12)}</pre>", f"<h3>{text(3)}</h3>",
              f"<table><tr><td>{text(5)}</td><td>{text(6)}</td></tr></table>", f"<div>{text(30)}</div>", f"<figure><img src=x><figcaption>{text(6)}</figcaption></figure>")
    for _ in range(rng.choice((0, 0, 1, 2, 4))):
        parts.insert(rng.randrange(len(parts) + 1), rng.choice(extras))
    for part in inside:
        parts.insert(rng.randrange(len(parts) + 1), part)
    if rng.random() < 0.75:
        parts.insert(0, f"<h1>{text(rng.randrange(2, 12))}</h1>")
    if rng.random() < 0.1:
        parts = [text(rng.randrange(20, 200)) + "<br><br>" + prose(rng, 60)]
    body = "".join(parts)
    for _ in range(rng.choice((0, 0, 0, 1, 2))):
        a, b = _named(rng, rng.choice(("div", "section")), "wrapper|inner|column|row|container|entry", 0.5)
        body = a + body + b
    a, b = rng.choice((("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"),
                       _named(rng, "article", "post|story|hentry"), _named(rng, "div", "content|post|entry-content|story-body|main content|article-text", 0.2),
                       _named(rng, "section", "content|article|text", 0.3), ("", "")))
    return a + body + b


def template_page(seed: int) -> str:
    """A page of random parts; main text is marked."""
    rng = random.Random(seed)
    parts = _boiler(rng)
    inside = [parts[k] for k in ("ad", "share", "related", "notice", "form") if rng.random() < 0.12]
    before = [parts[k] for k in ("header", "nav", "notice", "ad", "sidebar", "form") if rng.random() < 0.45]
    more = _boiler(rng)
    after = [more[k] for k in ("comments", "related", "share", "sidebar", "ad", "form", "footer", "notice") if rng.random() < 0.45]
    rng.shuffle(before)
    main = _main(rng, inside)
    if rng.random() < 0.3:
        a, b = _named(rng, "div", "page|wrapper|container|layout", 0.5)
        cut = rng.randrange(len(before) + 1)
        whole = "".join(before[:cut]) + a + "".join(before[cut:]) + main + "".join(after[:2]) + b + "".join(after[2:])
    else:
        whole = "".join(before) + main + "".join(after)
    head = f"<head><title>{prose(rng, 5)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
    return f"<!DOCTYPE html><html>{head}<body><!-- x -->{whole}" + rng.choice(("</body></html>", "</body></html>", ""))
