"""A bidirectional LSTM in numpy that labels the blocks of a page as main text or not, and pages to train it on (no Spark).

A block is read as a vector: the mean of learned vectors of its tag path's hashed tokens, the mean of learned vectors of its hashed words,
and a few ratios. Two LSTMs read the page's blocks in either direction, so each decision sees the whole page.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np

from quarry.llm.html_blocks import Block, blocks_of

TOKENS = 2048
_PATH, _WORD, _RATIOS, _HIDDEN = 24, 8, 6, 16
_WIDTH = _PATH + _WORD + _RATIOS
PAGES, EPOCHS, SEED = 600, 7, 11
#: Word hashes of fewer training pages have no vector, so that words never learned tell nothing.
LEAST_PAGES = 12
#: Taken off words before they are hashed.
_MARKS = ".,:;!?|()[]{}<>\"'#*%&$_~^=+-/\\"
#: Blocks of a page that are held as vectors at once; longer pages are read in parts of this size, from either end.
PART = 8192
#: Log odds above which a block is main text. Below 0, as a line of the article that is lost counts more than one that is let in.
LEAST = -1.0


def _bucket(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass"))


@lru_cache(maxsize=20_000)
def _path(path: tuple[str, ...]) -> np.ndarray:
    own = path[-6:]  # the innermost tokens count again, as tokens of their own
    return np.array([_bucket(t) % TOKENS for t in path] + [_bucket("near " + t) % TOKENS for t in own], np.int64)


def features(blocks: list[Block], low: int = 0, high: int | None = None) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """(path buckets, word hashes, ratios) of a page's blocks, or of those from low to high."""
    n, part = len(blocks), blocks[low:high]
    ratios, buckets = np.zeros((len(part), _RATIOS)), []
    for k, b in enumerate(part, low):
        words = b.text.split(" ")
        said = {w.strip(_MARKS) for w in b.text.lower().split(" ")} - {""}
        buckets.append(np.sort(np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in said], np.int64)))
        size = len(b.text)
        stops = b.text.count(".") + b.text.count("!") + b.text.count("?")
        ratios[k - low] = (np.log1p(len(words)) / 5, b.linked, min(stops / len(words), 1), k / n, (n - k) / n, min(size / len(words) / 20, 1))
    return [_path(b.path) for b in part], buckets, ratios


class _Bags:
    """Bags of table rows, one for each block of padded pages."""

    def __init__(self, pages: list[list[np.ndarray]], t: int, power: float, known: np.ndarray | None = None):
        """known: sorted hashes, whose places are the rows of the table; others are left out."""
        sizes = [[len(q) for q in p] for p in pages]
        self.rows = np.concatenate([np.repeat(i * t + np.arange(len(z)), z) for i, z in enumerate(sizes)]).astype(np.int64)
        self.entries = np.concatenate([q for p in pages for q in p]) if len(self.rows) else self.rows
        self.share = np.concatenate([np.repeat([max(x, 1) ** -power for x in z], z) for z in sizes])
        if known is not None:
            place = np.searchsorted(known, self.entries)
            kept = np.flatnonzero(known[np.minimum(place, len(known) - 1)] == self.entries) if len(known) else np.zeros(0, np.int64)
            self.rows, self.entries, self.share = self.rows[kept], place[kept], self.share[kept]
        self.start = np.flatnonzero(np.concatenate([[True], self.rows[1:] != self.rows[:-1]])) if len(self.rows) else self.rows

    def sums(self, table: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, table.shape[1]))
        if len(self.rows):
            out[self.rows[self.start]] = np.add.reduceat(table[self.entries] * self.share[:, None], self.start)
        return out

    def back(self, d: np.ndarray, table: np.ndarray) -> np.ndarray:
        g = d[self.rows] * self.share[:, None]
        return np.stack([np.bincount(self.entries, g[:, k], len(table)) for k in range(table.shape[1])], 1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Labeller:
    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        h = _HIDDEN
        draw = lambda *shape: r.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.p = {"tokens": np.zeros((TOKENS, _PATH)), "words": np.zeros((0, _WORD)), "spread": draw(_PATH, _PATH), "turn": draw(_WORD, _WORD), "out": draw(2 * h + _WIDTH, 1)[:, 0], "bias": np.zeros(1)}
        self.known = np.zeros(0, np.int64)
        for d in "fb":
            self.p |= {f"w{d}": draw(_WIDTH, 4 * h), f"u{d}": draw(h, 4 * h), f"c{d}": np.concatenate([np.ones(h), np.zeros(3 * h)])}

    def _inputs(self, pages: list[tuple]) -> tuple:
        n, t = len(pages), max(len(p[0]) for p in pages)
        x, live = np.zeros((n, t, _WIDTH)), np.zeros((n, t), bool)
        for i, (paths, _, ratios) in enumerate(pages):
            live[i, : len(paths)], x[i, : len(paths), _PATH + _WORD :] = True, ratios
        paths, words = _Bags([p[0] for p in pages], t, 0.5), _Bags([p[1] for p in pages], t, 1.0, self.known)
        pooled, said = paths.sums(self.p["tokens"], n * t).reshape(n, t, _PATH), words.sums(self.p["words"], n * t).reshape(n, t, _WORD)
        x[:, :, :_PATH], x[:, :, _PATH : _PATH + _WORD] = pooled @ self.p["spread"], said @ self.p["turn"]
        return x, live, paths, words, pooled, said

    def _run(self, x: np.ndarray, live: np.ndarray, d: str, state: tuple[np.ndarray, np.ndarray] | None = None, keep: bool = False) -> tuple[np.ndarray, list, tuple[np.ndarray, np.ndarray]]:
        n, t, _ = x.shape
        h, c = state or (np.zeros((n, _HIDDEN)), np.zeros((n, _HIDDEN)))
        out, kept = np.zeros((n, t, _HIDDEN)), []
        ahead = x @ self.p[f"w{d}"] + self.p[f"c{d}"]
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            g = ahead[:, k] + h @ self.p[f"u{d}"]
            f, i, o, a = (_sigmoid(g[:, : _HIDDEN]), _sigmoid(g[:, _HIDDEN : 2 * _HIDDEN]), _sigmoid(g[:, 2 * _HIDDEN : 3 * _HIDDEN]), np.tanh(g[:, 3 * _HIDDEN :]))
            m = live[:, k, None]
            c2 = np.where(m, f * c + i * a, c)
            tc = np.tanh(c2)
            h2 = np.where(m, o * tc, h)
            if keep:
                kept.append((k, f, i, o, a, c, tc, h, m))
            h, c = h2, c2
            out[:, k] = h
        return out, kept, (h, c)

    def scores(self, pages: list[tuple]) -> list[np.ndarray]:
        """For each page, from its features, the log odds that a block is main text."""
        x, live, *_ = self._inputs(pages)
        both = np.concatenate([self._run(x, live, "f")[0], self._run(x, live, "b")[0], x], 2)
        z = both @ self.p["out"] + self.p["bias"]
        return [z[i, : len(p[0])] for i, p in enumerate(pages)]

    def long_scores(self, blocks: list[Block], part: int = PART) -> np.ndarray:
        """The same for a page of any length, whose vectors are made part by part, from either end."""
        z, h = np.full(len(blocks), self.p["bias"][0]), _HIDDEN
        cuts = [(low, min(low + part, len(blocks))) for low in range(0, len(blocks), part)]
        for d, weight, order in (("f", self.p["out"][:h], cuts), ("b", self.p["out"][h : 2 * h], cuts[::-1])):
            state = None
            for low, high in order:
                x, live, *_ = self._inputs([features(blocks, low, high)])
                out, _, state = self._run(x, live, d, state)
                z[low:high] += out[0] @ weight
                if d == "f":
                    z[low:high] += x[0] @ self.p["out"][2 * h :]
        return z

    def gradient(self, pages: list[tuple], labels: list[np.ndarray]) -> tuple[float, dict[str, np.ndarray]]:
        x, live, paths, words, pooled, said = self._inputs(pages)
        n, t, _ = x.shape
        fo, fk, _ = self._run(x, live, "f", keep=True)
        bo, bk, _ = self._run(x, live, "b", keep=True)
        both = np.concatenate([fo, bo, x], 2)
        y = np.zeros((n, t))
        for i, v in enumerate(labels):
            y[i, : len(v)] = v
        z = both @ self.p["out"] + self.p["bias"]
        q = _sigmoid(z)
        total = live.sum()
        loss = float(-(np.log(np.where(y > 0, q, 1 - q) + 1e-12) * live).sum() / total)
        e = (q - y) * live / total
        g = {"out": np.einsum("nt,ntd->d", e, both), "bias": np.array([e.sum()])}
        d_both = e[:, :, None] * self.p["out"]
        dx = d_both[:, :, 2 * _HIDDEN :].copy()
        for d, kept, part in (("f", fk, d_both[:, :, :_HIDDEN]), ("b", bk, d_both[:, :, _HIDDEN : 2 * _HIDDEN])):
            du, dg = np.zeros_like(self.p[f"u{d}"]), np.zeros((n, t, 4 * _HIDDEN))
            dh, dc = np.zeros((n, _HIDDEN)), np.zeros((n, _HIDDEN))
            for k, f, i, o, a, c, tc, h, m in reversed(kept):
                dh = dh + part[:, k]
                up, through = dh * m, dc * m + dh * m * o * (1 - tc * tc)
                gates = np.concatenate([through * c * f * (1 - f), through * a * i * (1 - i), up * tc * o * (1 - o), through * i * (1 - a * a)], 1)
                dg[:, k] = gates
                du += h.T @ gates
                dh, dc = gates @ self.p[f"u{d}"].T + dh * ~m, through * f + dc * ~m
            g[f"u{d}"], g[f"w{d}"], g[f"c{d}"] = du, np.einsum("ntd,ntg->dg", x, dg), dg.sum((0, 1))
            dx += dg @ self.p[f"w{d}"].T
        dp, dw = dx[:, :, :_PATH], dx[:, :, _PATH : _PATH + _WORD]
        g["spread"], g["turn"] = np.einsum("ntp,ntd->pd", pooled, dp), np.einsum("ntp,ntd->pd", said, dw)
        g["tokens"] = paths.back((dp @ self.p["spread"].T).reshape(n * t, _PATH), self.p["tokens"])
        if len(self.known):
            g["words"] = words.back((dw @ self.p["turn"].T).reshape(n * t, _WORD), self.p["words"])
        return loss, g

    def learn_words(self, pages: list[tuple], least: int = LEAST_PAGES) -> None:
        """Gives every word hash of at least so many of these pages a vector, of zeros at first."""
        words, seen = np.unique(np.concatenate([np.unique(np.concatenate(p[1])) for p in pages]), return_counts=True)
        self.known = words[seen >= least]
        self.p["words"] = np.zeros((len(self.known), _WORD))

    def train(self, pages: list[tuple], labels: list[np.ndarray], epochs: int = EPOCHS, rate: float = 0.02, seed: int = SEED) -> float:
        random, step, loss = np.random.default_rng(seed), 0, 0.0
        order = np.argsort([len(p[0]) for p in pages], kind="stable")
        self.learn_words(pages)
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        for _ in range(epochs):
            cuts = np.array_split(order, max(1, len(pages) // 16))
            for j in random.permutation(len(cuts)):
                # blocks are often read without their words, each with its page's own chance, so that tags and places tell enough
                deaf = random.random(len(cuts[j])) * 1.5
                chosen = [(pages[i][0], [w[:0] if random.random() < no else w for w in pages[i][1]], pages[i][2]) for i, no in zip(cuts[j], deaf, strict=True)]
                loss, g = self.gradient(chosen, [labels[i] for i in cuts[j]])
                step += 1
                for k in g:
                    m[k] += 0.1 * (g[k] - m[k])
                    v[k] += 0.01 * (g[k] ** 2 - v[k])
                    self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        return loss


_COMMON = "the of and to in a is for on that by this with you at from your we us an about it are not may has will all be as or if its our more i up back no use also".split()
_LETTERS = "aaabcdeeeefghiiijklmnnooopqrrsstttuuvwxyzäéñöü"
#: What wraps blocks that are not main text: (opening tag, kind of content).
_AROUND = [
    *((t, "links") for t in ("nav", 'div class="menu"', 'ul id="navigation"', 'div class="navbar"', 'div class="breadcrumbs"', 'div class="topbar"', 'div class="pagination"', 'nav class="main-menu"', 'div id="site-nav"', 'div class="toc"')),
    *((t, "short") for t in ("header", 'div class="header"', 'div id="masthead"', 'div class="site-header"', 'header class="site-header"', 'div class="logo"', 'div class="branding"')),
    *((t, "mixed") for t in ("aside", 'div class="sidebar"', 'div id="sidebar"', 'aside class="widget"', 'div class="widget-area"', 'div class="related-posts"', 'section class="related"', 'div class="recommended"', 'div class="trending"', 'div class="popular"', 'div class="tags"', 'div class="author-box"')),
    *((t, "notice") for t in ('div class="cookie-notice"', 'div id="cookie-banner"', 'div class="notice"', 'div class="consent"', 'div class="gdpr"', 'div class="alert"', 'div class="popup"', 'div class="modal"', 'div role="alert"', 'div class="banner"', 'section class="notification"', 'div class="disclaimer"', 'div class="privacy"')),
    *((t, "advert") for t in ('div class="ad"', 'div class="ads"', 'div class="advert"', 'div class="advertisement"', 'div id="ad-slot"', 'aside class="sponsored"', 'div class="promo"', 'div class="sponsor"', 'section class="promotion"', 'ins class="adsbygoogle"')),
    *((t, "form") for t in ("form", 'form class="search"', 'div class="newsletter"', 'form id="login"', 'div class="subscribe"', 'div class="signup"', 'form class="contact-form"')),
    *((t, "short") for t in ('div class="share"', 'div class="social"', 'div class="toolbar"', 'a class="skip-link"')),
]
_COMMENTS = [(t, "comment") for t in ('section class="comments"', 'div id="comments"', 'div class="comment-list"', 'div class="comment"', 'div class="discussion"', 'section id="reader-comments"', 'ol class="commentlist"', 'div class="replies"', 'div id="disqus_thread"', 'div class="responses"')]
_FOOTERS = [(t, "footer") for t in ("footer", 'div class="footer"', 'div id="footer"', 'footer class="site-footer"', 'div class="copyright"', 'div class="legal"', 'div id="colophon"', 'div class="bottom"')]
_MAIN = ("article", "main", 'div class="content"', 'div id="main"', 'div class="article-body"', 'div class="post"', 'div class="entry-content"', 'section class="story"', 'article class="post"', 'div id="content"', 'main id="main"', 'div itemprop="articleBody"', 'article id="article"')
#: Tags that say nothing of what they hold.
_NEUTRAL = ("div", "section", 'div class="txt"', 'div class="bt"', 'div class="resp"', 'div class="c1"', 'div class="col"', 'div class="row"', 'div id="w"', 'div class="box"', 'div class="css k7"', 'div class="inner"', 'div class="block"')
#: Words by which readers know what a block is, by kind.
_SAID = {
    "comment": "reply|reply to this|says:|said:|wrote:|2 hours ago|3 days ago|5 minutes ago|posted by|comments|leave a comment|report abuse|thanks for sharing|great post!|i agree|lol|upvote|permalink",
    "footer": "&copy; 2019|&copy; 2024|copyright|all rights reserved|privacy policy|terms of use|terms of service|imprint|contact us|about us|sitemap|powered by|unsubscribe",
    "notice": "we use cookies|accept all|this site uses cookies|privacy policy|consent|click ok to continue|your browser is not supported|please enable javascript|notice:",
    "advert": "advertisement|sponsored|buy now|special offer|50% off|sale|order today|free shipping|promoted|click here",
    "form": "your email address|subscribe|sign up|newsletter|password|username|search|submit|log in|enter your name",
    "short": "share this|follow us|tweet|skip to content|print|menu|log in|search|back to top",
    "mixed": "related articles|you may also like|popular posts|recent posts|trending|tags:|about the author|read more|archives|categories",
    "links": "home|about|contact|news|next|previous|archive|blog|products|services|login",
}
_SAID = {k: v.split("|") for k, v in _SAID.items()}
_SAID_WORDS = sorted({w for v in _SAID.values() for x in v for w in x.split()})


def training_page(random: np.random.Generator, silent: bool = False) -> tuple[list[Block], np.ndarray]:
    """Blocks of an invented page and whether each is main text. Every word of main text starts with a mark that is taken off again.

    silent: tags often say nothing of what they hold, so that words and places must.
    """

    letters, cued = np.array(list(_LETTERS)), [w for w in _SAID_WORDS if w not in _COMMON]

    def word() -> str:
        if random.random() < 0.3:
            return str(random.choice(_COMMON))
        return "".join(letters[random.integers(0, len(letters), random.integers(2, 10))])

    def own_word() -> str:
        """Main text holds any word now and then."""
        return word() if random.random() > 0.01 else str(random.choice(cued))

    def prose(low: int, high: int, mark: str) -> str:
        out = []
        for _ in range(random.integers(1, 4)):
            w = [own_word() if mark else word() for _ in range(random.integers(low, high))]
            out.append(mark + f" {mark}".join(w).capitalize() + ".")
        return " ".join(out)

    def wrapped(tag: str, inner: str) -> str:
        return f"<{tag}>{inner}</{tag.split(' ')[0]}>"

    def filler(kind: str, plain: bool = False) -> str:
        """plain: the tag around says nothing, so the words or links must."""
        cue = str(random.choice(_SAID[kind])) if plain or random.random() < 0.5 else ""
        cue = cue.capitalize() if random.random() < 0.6 else cue
        if kind == "links":
            links = [f'<a href="/{word()}">{x}</a>' for x in [cue or word(), *(word() if random.random() < 0.6 else str(random.choice(_SAID[kind])) for _ in range(random.integers(2, 8)))]]
            return "<ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul>" if random.random() < 0.7 else " ".join(links)
        if kind == "short":
            return random.choice([f"{cue} {word()}", f"{cue} {word()} {word()}" if plain else f"<h1>{cue} {word()} {word()}</h1>", f"<p>{cue} {prose(2, 6, '')}</p>", f"<h2>{word()}</h2><p>{cue} {prose(2, 9, '')}</p>", f"<p>{cue}</p>"])
        if kind == "footer":
            return random.choice([f"{cue or '&copy;'} {word()} &middot; {prose(3, 12, '')}", f"<p>{cue} {word()}</p><p>{prose(2, 9, '')} {random.choice(_SAID[kind])}</p>", f"<p>{cue} {prose(2, 12, '')}</p>", f"{cue} <a href=/>{random.choice(_SAID[kind])}</a> <a href=/>{word()}</a>", f"<h2>{word()}</h2><p>{cue} {prose(2, 9, '')}</p>"])
        if kind == "form":
            return f"<label>{cue or word()}</label><input name=q><p>{prose(3, 9, '')}</p><label>{word()} {cue}</label>"
        if kind == "mixed":
            return f"<h3>{cue or word()} {word()}</h3>" + random.choice([filler("links"), f"<p>{prose(4, 20, '')}</p>", f"<div>{prose(4, 12, '')}</div><div>{prose(4, 12, '')}</div>"])
        body = [prose(3, 40, "") for _ in range(random.integers(1, 4))]
        if plain or random.random() < 0.4:
            body = [f"{cue} {b}" if random.random() < 0.5 else f"{b} {random.choice(_SAID[kind])}" for b in body]
            if kind == "comment" and random.random() < 0.6:
                body = [f"{word().capitalize()} {cue}", *body] if random.random() < 0.5 else [x for b in body for x in (f"{word().capitalize()} {random.choice(_SAID[kind])}", b)]
        return random.choice(["".join(f"<p>{b}</p>" for b in body), " ".join(body), "".join(f"<div><p>{b}</p></div>" for b in body), "".join(f"<li>{b}</li>" for b in body)])

    def noise(choices: list[tuple[str, str]]) -> str:
        tag, kind = choices[random.integers(len(choices))]
        plain = bare or silent and random.random() < 0.1
        return wrapped(str(random.choice(_NEUTRAL)) if plain else tag, filler(kind, plain))

    mark, bare = "\x01", silent and random.random() < 0.15
    body = []
    title = f"<h1>{prose(2, 9, mark)}</h1>"
    body.append(wrapped("header", title) if random.random() < 0.15 and not bare else title)
    style = random.random()  # some pages hold all their paragraphs in one way
    for _ in range(random.integers(1, 14)):
        kind = random.random()
        if kind < 0.72:
            text = prose(3, 60, mark) if random.random() < 0.85 else prose(1, 3, mark)
            if not bare and random.random() < 0.04:  # an article may hold such a line of its own
                text = " ".join(mark + w for w in str(random.choice(_SAID[str(random.choice(list(_SAID)))])).capitalize().split()) + "."
            ways = [f"<p>{text}</p>", f"<p><b>{text}<br>", f"<p>{text} <a href=x>{mark}{word()}</a> {mark}{word()}</p>", f"<div><p>{text}</p></div>", f"<p class=x>{text}", f"<div>{text}</div>", f"<pre>{text}</pre>", f"<section><p>{text}</p></section>", f"<p><code>{text}</code></p>"]
            body.append(ways[int(style * 4 * len(ways))] if style < 0.25 else str(random.choice(ways)))
        elif kind < 0.8:
            level = random.integers(2, 5)
            body.append(f"<h{level}>{prose(1, 6, mark)}</h{level}>")
        elif kind < 0.86:
            body.append(random.choice(["<ul>", "<ol>"]) + "".join(f"<li>{prose(1, 12, mark)}</li>" for _ in range(random.integers(1, 5))) + "</ul></ol>")
        elif kind < 0.89:
            body.append(f"<blockquote>{prose(3, 20, mark)}</blockquote>")
        elif kind < 0.91:
            body.append(f"<figure><img src=x><figcaption>{prose(2, 12, mark)}</figcaption></figure>")
        elif kind < 0.92:
            body.append(f"<dl><dt>{mark}{word()}<dd>{prose(2, 12, mark)}</dl>")
        elif kind < 0.94:
            body.append(f"<table><tr><td>{mark}{word()}</td><td>{mark}{word()}</td></tr></table>")
        else:
            body.append(noise(_AROUND))
    inner = "".join(body)
    if random.random() < 0.2:
        inner += noise(_COMMENTS)
    kind = random.random()
    main = inner if kind < (0.15 if silent else 0.08) else wrapped(str(random.choice(_NEUTRAL)) if bare or silent and kind < 0.3 else _MAIN[random.integers(len(_MAIN))], inner)
    if random.random() < 0.3:
        main = wrapped(str(random.choice(["div", 'div class="wrapper"', 'div class="container"', "main"])), main)
    before = "".join(noise(_AROUND) for _ in range(random.integers(0, 4)))
    after = "".join(noise(_AROUND) for _ in range(random.integers(0, 3))) + "".join(noise(_COMMENTS + _FOOTERS) for _ in range(random.integers(0, 4)))
    blocks = blocks_of(f"<html><body>{before}{main}{after}</body></html>")
    labels = np.array([mark in b.text for b in blocks], np.float64)
    for b in blocks:
        b.text = b.text.replace(mark, "")
    return blocks, labels


@lru_cache(maxsize=2)
def trained(pages: int = PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
    """A labeller trained on invented pages; the same arguments give the same one."""
    random = np.random.default_rng(seed)
    made = [training_page(random, silent=True) for _ in range(pages)]
    made = [(b, y) for b, y in made if b]
    out = Labeller(seed)
    out.train([features(b) for b, _ in made], [y for _, y in made], epochs)
    return out
