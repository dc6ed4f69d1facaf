"""Main text of web pages by a recurrent block labeller.

A page is cut into its leaf blocks: runs of text between block-level tags. Each
block becomes a vector of its hashed tag path (tags and class or id words of all
open elements), its hashed words and a few measures. A bidirectional LSTM in
numpy reads the blocks of the whole page in order and labels every block as main
text or not. It is trained here, on pages that a seeded generator builds, never
on the pages it is to read. Part of these have telling container names; in the
others names are random or absent, so that lengths, links, marks, words and
neighbours must tell.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_batches

PATH, WORDS, MEASURES, HIDDEN = 192, 64, 9, 20
TRAIN_PAGES, EPOCHS, BATCH, SEED = 4800, 12, 48, 20
#: Blocks of a page that are vectors at one time; pages of more are read in parts with the state carried on.
PART = 4096

# Element names of HTML.
INLINE = frozenset("a abbr acronym audio b bdi bdo big br canvas cite code data del dfn em font i img input ins kbd label map mark meter object output picture q rp rt ruby s samp slot small source span strike strong sub sup time tt u var video wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes".split())
FOREIGN = frozenset("svg math".split())
CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl dt dd fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
SCOPE = frozenset("ul ol dl table article section div main aside nav header footer form body".split())
#: Open elements are that many at most; a deeper one takes the place of the deepest, as in browsers.
DEPTH = 512

# Attributes as the HTML standard reads them: a quote counts after "=" only, and only if it is closed.
_attributes = r"(?:[\s/]++|(?:=[^\s/>=]*+|[^\s/>=]++)(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)?+)*+"
_token = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*>?|</(?![a-zA-Z])(?!\Z)[^>]*>?|<(/?)([a-zA-Z][^\s/>]*+)({_attributes})(?:>|\Z)|([^<]+|<)", re.S)
_marks = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_part = re.compile(r"[a-z]+")
_template = re.compile(r"<(/?)template(?=[\s/>])[^>]*>", re.I)
_raw_end = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


class Block(NamedTuple):
    path: int  # a bit for each hashed tag, class and id word of the open elements
    leaf: int  # that of the innermost one's last word
    text: str
    linked: float  # share of the text inside links


@lru_cache(100_000)
def _bit(mark: str) -> int:
    return zlib.crc32(mark.encode("utf-8", "replace")) % PATH


def _past_template(html: str, at: int) -> int | None:
    """Where a template that begins before ``at`` ends; None if it doesn't."""
    depth = 1
    for m in _template.finditer(html, at):
        depth += -1 if m[1] else 1
        if not depth:
            return m.end()
    return None


def blocks(html: str) -> list[Block]:
    """Leaf blocks in page order; references decoded, white space one space, no empty ones.

    Scripts, styles, titles, frames, text areas, templates and comments hold no
    text; all else does, however badly nested or closed.
    """
    found: list[Block] = []
    open_: list[tuple[str, int, int]] = []  # name, path, leaf
    count: Counter[str] = Counter()
    parts: list[str] = []
    linked, links, foreign, templates = 0, -1, 0, True  # links: number of open elements where a link began

    def end() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            _, path, leaf = open_[-1] if open_ else ("", 0, -1)
            found.append(Block(path, leaf, text, min(1.0, linked / len(text))))
        parts.clear()
        linked = 0

    def close(at: int) -> None:
        nonlocal links
        for name, *_ in open_[at:]:
            count[name] -= 1
        del open_[at:]
        if links > len(open_):
            links = -1

    at = 0
    while m := _token.match(html, at):
        at = m.end()
        slash, name, attributes, text = m.groups()
        if text is not None:
            text = unescape(text) if "&" in text else text
            parts.append(text)
            linked += len(text) if links >= 0 else 0
            continue
        if name is None:
            continue
        name = name.lower()
        if name in FOREIGN:
            foreign = max(0, foreign + (-1 if slash else 0 if attributes.endswith("/") else 1))
            continue
        if name in RAW:
            if not slash and not (foreign and attributes.endswith("/")):
                stop = _raw_end[name].search(html, at)
                at = stop.start() if stop else len(html)
            continue
        if name == "template":
            if not slash and templates:
                past = _past_template(html, at)
                templates, at = past is not None, past or at
            continue
        if foreign and name not in ENDS_P:
            continue
        foreign = 0
        if name in INLINE or (name == "noscript" and "".join(parts).strip()):
            if name == "a":
                links = -1 if slash else len(open_)
            if name in ("br", "img", "input"):
                parts.append(" ")
            continue
        end()
        if slash:
            if count[name]:
                close(next(k for k in range(len(open_) - 1, -1, -1) if open_[k][0] == name))
            continue
        if name in VOID:
            continue
        for k in range(len(open_) - 1, -1, -1):
            if open_[k][0] in CLOSES.get(name, ()) or (open_[k][0] == "p" and name in ENDS_P):
                close(k)
                break
            if open_[k][0] in SCOPE:
                break
        if len(open_) >= DEPTH:
            close(DEPTH - 1)
        words = [w for x in _marks.finditer(attributes) for w in _part.findall((x[1] or x[2] or x[3] or "").lower())]
        own = [_bit("t:" + name), *(_bit("c:" + w) for w in words)]
        path = open_[-1][1] if open_ else 0
        for b in own:
            path |= 1 << b
        open_.append((name, path, own[-1]))
        count[name] += 1
    end()
    return found


@lru_cache(50_000)
def _path_vector(path: int, leaf: int) -> np.ndarray:
    v = np.unpackbits(np.frombuffer(path.to_bytes(PATH // 8, "little"), np.uint8), bitorder="little").astype(np.float32)
    if leaf >= 0:
        v[leaf] += 0.5
    return v


@lru_cache(100_000)
def _word(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) % WORDS


_mark = re.compile(r"[.,;:!?]")


def vectors(page: list[Block], first: int = 0, total: int = 0) -> np.ndarray:
    """(block, feature) of blocks that stand from ``first`` on a page of ``total``."""
    total = total or len(page)
    out = np.zeros((len(page), PATH + WORDS + MEASURES), np.float32)
    for k, (path, leaf, text, linked) in enumerate(page):
        words = text.split(" ")
        n = len(words)
        out[k, :PATH] = _path_vector(path, leaf)
        hashed = np.bincount([_word(w) for w in text.lower().split(" ")] if n < 12 else [zlib.crc32(w) % WORDS for w in text.lower().encode("utf-8", "replace").split(b" ")], minlength=WORDS)
        out[k, PATH : PATH + WORDS] = hashed / n
        here = first + k
        out[k, PATH + WORDS :] = (np.log1p(n) / 4, linked, here / total, text[-1] in ".!?。", np.log1p(len(text) / n) / 3, len(_mark.findall(text)) / n, n > 12, text[0].isupper(), "©" in text or "|" in text)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Bidirectional LSTM with a logistic output, for padded batches (page, block, feature)."""

    def __init__(self, size: int = PATH + WORDS + MEASURES, hidden: int = HIDDEN, seed: int = SEED):
        r, h = np.random.default_rng(seed), hidden
        self.h = h
        self.p = {f"{n}{d}": (r.normal(0, 1 / np.sqrt(a), (a, 4 * h)) * s).astype(np.float32) for d in "fb" for n, a, s in (("x", size, 1.5), ("h", h, 0.7))}
        self.p |= {f"c{d}": np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)]).astype(np.float32) for d in "fb"}
        self.p |= {"o": r.normal(0, 0.3, 2 * h).astype(np.float32), "z": np.zeros(1, np.float32)}

    def start(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        return np.zeros((n, self.h), np.float32), np.zeros((n, self.h), np.float32)

    def run(self, x: np.ndarray, mask: np.ndarray, d: str, state: tuple[np.ndarray, np.ndarray], kept: list | None = None) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """Outputs of one direction and the state after them; ``kept`` gathers what gradients need."""
        n, t, _ = x.shape
        h, c = state
        pre, out = x @ self.p["x" + d] + self.p["c" + d], np.zeros((n, t, self.h), np.float32)
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            a = pre[:, k] + h @ self.p["h" + d]
            i, f, o = np.split(_sigmoid(a[:, : 3 * self.h]), 3, 1)
            g, m = np.tanh(a[:, 3 * self.h :]), mask[:, k, None]
            c1 = f * c + i * g
            th = np.tanh(c1)
            if kept is not None:
                kept.append((k, h, c, i, f, o, g, th, m))
            h, c = m * o * th + (1 - m) * h, m * c1 + (1 - m) * c
            out[:, k] = h
        return out, (h, c)

    def likely(self, f: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _sigmoid(f @ self.p["o"][: self.h] + b @ self.p["o"][self.h :] + self.p["z"])

    def predict(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        f, b = (self.run(x, mask, d, self.start(len(x)))[0] for d in "fb")
        return self.likely(f, b)

    def predict_long(self, page: list[Block]) -> np.ndarray:
        """As ``predict`` for a single page, of which PART blocks are vectors at a time."""
        n, out = len(page), {d: np.zeros((len(page), self.h), np.float32) for d in "fb"}
        for d in "fb":
            state, firsts = self.start(1), range(0, n, PART)
            for at in firsts if d == "f" else reversed(firsts):
                x = vectors(page[at : at + PART], at, n)[None]
                told, state = self.run(x, np.ones(x.shape[:2], np.float32), d, state)
                out[d][at : at + PART] = told[0]
        return self.likely(out["f"], out["b"])

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        kept: dict[str, list] = {"f": [], "b": []}
        f, b = (self.run(x, mask, d, self.start(len(x)), kept[d])[0] for d in "fb")
        both = np.concatenate([f, b], 2)
        e = (self.likely(f, b) - y) * mask / mask.sum()
        grad = {"o": np.einsum("nt,nth->h", e, both), "z": np.array([e.sum()])}
        for d, part in (("f", slice(None, self.h)), ("b", slice(self.h, None))):
            back = e[:, :, None] * self.p["o"][part]
            da = np.zeros((*x.shape[:2], 4 * self.h), np.float32)
            dh = dc = np.zeros((len(x), self.h), np.float32)
            gh = np.zeros_like(self.p["h" + d])
            for k, h0, c0, i, f, o, g, th, m in reversed(kept[d]):
                dh = dh + back[:, k]
                live, ch = dh * m, dc * m
                c_grad = ch + live * o * (1 - th**2)
                da[:, k] = np.concatenate([c_grad * g * i * (1 - i), c_grad * c0 * f * (1 - f), live * th * o * (1 - o), c_grad * i * (1 - g**2)], 1)
                gh += h0.T @ da[:, k]
                dh = da[:, k] @ self.p["h" + d].T + dh * (1 - m)
                dc = c_grad * f + dc * (1 - m)
            grad |= {"x" + d: x.reshape(-1, x.shape[2]).T @ da.reshape(-1, 4 * self.h), "h" + d: gh, "c" + d: da.sum((0, 1))}
        return grad


# Container names and words of the training pages.
MAIN = ["article", "main", "section class='content'", "div class='post'", "div class='entry-content'", "div class='article-body'", "div id='content'", "div class='story text'", "article class='post'", "main id='main'"]
OTHER = {
    "menu": ["nav", "div id='menu'", "ul class='menu'", "div class='nav'", "div class='breadcrumb'", "nav class='navbar'"],
    "head": ["header", "div class='header'", "div class='banner'", "div id='masthead'"],
    "foot": ["footer", "div class='footer'", "div id='footer'"],
    "side": ["aside", "div class='sidebar'", "div class='related'", "div class='widget'", "div class='share'", "div class='promo'"],
    "form": ["form", "div class='login'", "div class='newsletter'", "div class='search'"],
    "ad": ["div class='ad'", "div class='ads'", "div class='advert'", "div class='sponsored'"],
    "notice": ["div class='cookie-notice'", "div class='notice'", "div class='popup'", "noscript"],
    "comment": ["div class='comments'", "section id='comments'", "section class='comments'", "div class='comment'"],
}
#: Words that names of a kind are made of, beside NEUTRAL ones, which stand in names of all kinds.
NAMES = {
    "main": "content article post entry story text body prose main page recipe document",
    "menu": "menu nav navbar navigation breadcrumb breadcrumbs topnav pagination pager tabs",
    "head": "header masthead top topbar banner branding logo",
    "foot": "footer foot copyright colophon bottom legal imprint credits",
    "side": "sidebar side widget related share social promo popular recommended tags secondary",
    "form": "form login newsletter search subscribe signup register",
    "ad": "ad ads advert advertisement sponsored sponsor adsense",
    "notice": "cookie cookies notice consent gdpr popup modal alert overlay",
    "comment": "comments comment replies discussion responses respond reactions",
    "meta": "meta byline posted date author timestamp published",
}
NEUTRAL = "site page area wrap wrapper box block inner list section container primary row col item group app ui js the".split()
SAID = {
    "meta": "Posted on by Written in Published Updated Filed under Author January March June 2019 2021 2024 min read Von am Publié le por",
    "menu": "Home About Contact News Login Register Search Menu Shop Blog FAQ Help Sitemap Archive Categories Products Services Sports Politics Startseite Über Kontakt Anmelden Suche Accueil Actualités Connexion Recherche Inicio Noticias Contacto Buscar",
    "head": "Daily Online Journal Weekly News Magazine The Times Blog of Portal Network Site",
    "foot": "© Copyright 2019 2021 2024 All rights reserved Privacy Policy Terms of Use Imprint Impressum Datenschutz Alle Rechte vorbehalten Tous droits réservés Mentions légales Todos los derechos reservados Aviso legal Contact",
    "side": "Related articles Read more Most popular Share Tweet Follow us Trending See also Recent posts Tags Mehr lesen Lire aussi Leer más",
    "form": "Email Name Password Submit Search Subscribe Newsletter Sign up Your Send Enter Register Absenden Envoyer Enviar",
    "ad": "Advertisement Sponsored Buy now Sale Offer Free shipping Discount Click here Deal Save Anzeige Publicité Publicidad % off today only",
    "notice": "We use cookies to improve your experience Accept all Please enable JavaScript Wir verwenden Cookies Nous utilisons des cookies Utilizamos cookies this site By continuing you agree",
    "comment": "Reply Comments Comment said posted ago hours Leave a reply Report Antworten Kommentar Répondre Commentaires Responder Comentarios",
}
_said = {kind: words.split() for kind, words in SAID.items()}
_names = {kind: words.split() for kind, words in NAMES.items()}


def training_page(r: np.random.Generator) -> tuple[str, list[int]]:
    """A page and the label of each of its blocks."""
    labels: list[int] = []
    named = r.random() < 0.5  # containers tell their kind
    common = ["".join(chr(97 + c) for c in r.integers(0, 26, r.integers(1, 4))) for _ in range(12)]

    def pick(options: list):  # noqa: ANN202
        return options[r.integers(len(options))]

    def word() -> str:
        if r.random() < 0.35:
            return pick(common)
        return "".join(chr(97 + c) if c < 26 else pick("éüñßèö") for c in r.integers(0, 27, r.integers(1, 10)))

    def prose(lo: int, hi: int) -> str:
        out, fresh = [], True
        for _ in range(r.integers(lo, hi + 1)):
            w = word()
            w, fresh = w.capitalize() if fresh else w, False
            mark = r.random()
            if mark < 0.08:
                w, fresh = w + ".", True
            elif mark < 0.16:
                w += ","
            out.append(w)
        text = " ".join(out)
        return text if text[-1] in ".," or r.random() < 0.25 else text + "."

    def main_text(text: str) -> str:
        labels.append(1)
        if r.random() < 0.12 and text.count(" ") > 12:  # a link within
            words = text.split(" ")
            at = int(r.integers(1, len(words) - 3))
            words[at : at + 2] = [f"<a href='/{word()}'>{words[at]} {words[at + 1]}</a>"]
            text = " ".join(words)
        return text

    def said(kind: str, lo: int, hi: int) -> str:
        n = int(r.integers(lo, hi + 1))
        known = r.random() < 0.75
        out = [pick(_said[kind]) if known and r.random() < 0.8 else word() for _ in range(n)]
        if kind == "foot" and r.random() < 0.5:
            out.insert(0, "©")
        if r.random() < 0.15:
            out.append(pick("|»›·"))
        labels.append(0)
        return " ".join(out)

    def link(text: str) -> str:
        return f"<a href='/{word()}'>{text}</a>"

    def random_name() -> str:
        kind = r.random()
        if kind < 0.4:
            return ""
        if kind < 0.6:
            return f" class='css-{word()}{r.integers(99)}{word()}'"
        return f" {pick(['class', 'class', 'id'])}='{word()}{pick(['-', '_', ' '])}{word()}'"

    def telling(kind: str, tags: list[str]) -> str:
        words = [pick(_names[kind])]
        if r.random() < 0.6:
            words.insert(int(r.integers(2)), pick(NEUTRAL))
        return f"{pick(tags)} {pick(['class', 'class', 'id'])}='{pick(['-', '_', ' ']).join(words)}'"

    def box(kind: str, names: list[str], tags: list[str]) -> tuple[str, str]:
        name = pick(names) if r.random() < 0.5 else telling(kind, ["div", "div", "section"])
        name = name if named and r.random() < 0.95 else pick(tags) + random_name()
        tag = name.split()[0]
        return (f"<table><tr><{name}>", f"</{tag}></tr></table>") if tag == "td" else (f"<{name}>", f"</{tag}>")

    def inner(tag: str, kind: str) -> str:
        return telling(kind, [tag]) if named and r.random() < 0.7 else tag + random_name()

    def thread(level: int) -> str:
        """Comments as a list, with answers as lists within."""
        item, body = pick(["article", "div", "div"]), []
        for _ in range(r.integers(1, 4)):
            who = f"{word().capitalize()} {pick(['', word().capitalize()])} {pick(['says:', 'said', 'schrieb', 'a dit', ''])} {pick(['', f'{r.integers(1, 31)} {word()} 2020 at {r.integers(1, 24)}:{r.integers(10, 60)}'])}"
            labels.append(0)
            top = f"<{(t := pick(['footer', 'header', 'div', 'div']))} {pick(['class=meta', 'class=author', ''])}>{who}</{t}>"
            text = "".join(f"<p>{labels.append(0) or prose(2, 40)}</p>" for _ in range(r.integers(1, 4)))
            text = f"<{inner('div', 'main')}>{text}</div>" if r.random() < 0.5 else text
            back = f"<div>{link(said('comment', 1, 1))}</div>" if r.random() < 0.6 else ""
            answers = thread(level + 1) if level < 2 and r.random() < 0.3 else ""
            body.append(f"<li><{inner(item, 'comment')}>{top}{text}{back}</{item}>{answers}</li>")
        return f"<{inner('ol', 'comment')}>{''.join(body)}</ol>"

    def bare(lo: int, hi: int) -> str:
        return pick([f"{r.integers(1, 900)} ", "", ""]) + prose(lo, hi).rstrip(".,")

    def rows() -> str:
        """A table or a list of terms, of short texts, within the article."""
        if r.random() < 0.35:
            many = range(r.integers(2, 7))
            return "<dl>" + "".join(f"<dt>{main_text(bare(1, 4))}</dt><dd>{main_text(prose(2, 25))}</dd>" for _ in many) + "</dl>"
        wide, head = int(r.integers(2, 5)), r.random() < 0.5
        line = lambda tag: "<tr>" + "".join(f"<{tag}>{main_text(bare(1, 4))}</{tag}>" for _ in range(wide)) + "</tr>"
        return "<table>" + (line("th") if head else "") + "".join(line("td") for _ in range(r.integers(2, 8))) + "</table>"

    def other(kind: str) -> str:
        start, stop = box(kind, OTHER[kind], ["div", "div", "div", "section", "td"])
        if kind == "menu":
            if r.random() < 0.6 or start.startswith("<ul"):
                items = "".join(f"<li>{link(said(kind, 1, 3))}</li>" for _ in range(r.integers(2, 9)))
                return start + (items if start.startswith("<ul") else f"<ul>{items}</ul>") + stop
            if r.random() < 0.5:
                labels.append(0)
                row = pick([" | ", " ", " · "]).join(link(pick(_said[kind]) if r.random() < 0.6 else word()) for _ in range(r.integers(3, 9)))
                return start + row + stop
            return start + "".join(f"<div>{link(said(kind, 1, 2))}</div>" for _ in range(r.integers(2, 8))) + stop
        if kind == "head":
            text = said(kind, 1, 4)
            text = link(text) if r.random() < 0.6 else text
            tag = pick(["div", "p", "h2", "span", "div"]) + random_name()
            out = f"<{tag}>{text}</{tag.split()[0]}>"
            return start + out + (f"<p>{said(kind, 2, 7)}</p>" if r.random() < 0.4 else "") + stop
        if kind == "foot":
            tag, out = pick(["p", "div", ""]), []
            for _ in range(r.integers(1, 4) if tag else 1):
                text = said(kind, 2, 12)
                text = link(text) if r.random() < 0.25 else text
                out.append(f"<{tag}>{text}</{tag}>" if tag else text)
            return start + "".join(out) + stop
        if kind == "side":
            out = [f"<{(t := pick(['h3', 'h4', 'div', 'p']))}>{said(kind, 1, 4)}</{t}>"] if r.random() < 0.8 else []
            if r.random() < 0.7:
                out.append("<ul>" + "".join(f"<li>{link(said('side', 1, 2) if r.random() < 0.2 else (labels.append(0) or prose(2, 9)))}</li>" for _ in range(r.integers(2, 7))) + "</ul>")
            elif named:
                out += [f"<p>{labels.append(0) or prose(3, 40)}</p>" for _ in range(r.integers(1, 4))]
            else:
                for _ in range(r.integers(1, 4)):
                    out += [f"<p>{link(labels.append(0) or prose(2, 8))}</p>", f"<p>{labels.append(0) or prose(4, 14)}</p>" if r.random() < 0.4 else ""]
            return start + "".join(out) + stop
        if kind == "form":
            return start + "".join(f"<p>{said(kind, 1, 3)} <input></p>" for _ in range(r.integers(1, 4))) + f"<button>{said(kind, 1, 2)}</button>" + stop
        if kind == "ad":
            if named and r.random() < 0.7:
                labels.append(0)
                return start + prose(2, 30) + stop
            text = said(kind, 2, 9)
            return start + (link(text) if r.random() < 0.7 else text) + stop
        if kind == "notice":
            text = (labels.append(0) or prose(3, 30)) if named and r.random() < 0.4 else said(kind, 4, 18)
            return start + f"<p>{text}</p>" + (f"<button>{said(kind, 1, 2)}</button>" if r.random() < 0.5 else "") + stop
        out = [f"<{(t := pick(['h3', 'h4', 'p', 'div']))}>{pick(['', str(r.integers(40)) + ' '])}{said(kind, 1, 2)}</{t}>"] if not named or r.random() < 0.7 else []
        if r.random() < 0.4:
            return start + "".join(out) + thread(0) + stop
        for _ in range(r.integers(1, 6)):
            who = f"{word().capitalize()}{pick(['', ' ' + word().capitalize(), ' ' + str(r.integers(1, 31)) + ' ' + word()])}"
            if not named or r.random() < 0.6:
                tag = pick(["div", "b", "p", "span"])
                labels.append(0)
                out.append(f"<div><{tag}>{who}{pick([':', ' said', ' ago', ''])}</{tag}></div>")
            out.append(f"<p>{labels.append(0) or prose(2, 35)}</p>")
            if not named or r.random() < 0.5:
                out.append(f"<div>{link(said(kind, 1, 1))}</div>")
        return start + "".join(out) + stop

    def main() -> str:
        start, stop = box("main", MAIN, ["div", "div", "div", "section", "td"])
        par = "p" if named else pick(["p", "p", "p", "div", "p" + random_name()])
        if not named and r.random() < 0.3:  # no container
            start = stop = ""
        around = ("", "")
        if not named and r.random() < 0.25:  # a box for each paragraph
            around = (f"<div{random_name()}>", "</div>")
        short = 1 if named else 8
        out = [f"<{(t := pick(['h1', 'h1', 'h2']))}>{main_text(prose(1, 12))}</{t}>"] if r.random() < (0.85 if named else 0.7) else []
        if named and r.random() < 0.12:  # a few words are the whole article
            return start + "".join(out) + "".join(f"<p>{main_text(bare(1, 6) if r.random() < 0.7 else prose(1, 6))}" for _ in range(r.integers(1, 4))) + stop
        if out and named and r.random() < 0.25:
            out[0] = f"<header class='{pick(_names['main'])}-header'>{out[0]}</header>"
        if named and r.random() < 0.3:
            out.append(f"<{telling('meta', ['div'])}>{said('meta', 2, 7)}</div>")
        if r.random() < 0.15:  # breaks instead of paragraphs: one block
            text = "<br><br>".join(prose(5, 60) for _ in range(r.integers(2, 9)))
            return start + "".join(out) + main_text(text) + stop
        for _ in range(r.integers(1, 14) if named else r.integers(2, 14)):
            kind = r.random()
            if kind < 0.1:
                out.append(f"<h2>{main_text(prose(1, 8))}</h2>")
            elif kind < 0.17:
                out.append("<ul>" + "".join(f"<li>{main_text(prose(1 if named else 3, 14))}</li>" for _ in range(r.integers(1, 5))) + "</ul>")
            elif kind < 0.23:
                out.append(f"<blockquote>{main_text(prose(4, 30))}</blockquote>")
            elif kind < 0.29 and named:
                out.append(other(pick(["ad", "side", "notice", "form"])))
            elif kind < 0.32 and not named:
                out.append(other("ad"))
            elif kind < 0.42 and named:
                out.append(f"<p><b>{main_text(prose(1, 12))}<br>")
            elif kind < 0.5:
                again = f"<{par}>{main_text(prose(1 if named else 4, 6 if named else 9))}</{par.split()[0]}>"
                times = int(r.integers(1, 30 if named else 4))
                labels.extend([1] * (times - 1))
                out.append(again * times)
            elif kind < 0.55:
                out.append(f"<{par}>{main_text(prose(1, 5))}</{par.split()[0]}>")
            elif kind < 0.59:
                out.append(rows())
            elif kind < 0.62:
                out.append(f"<pre><code>{main_text(chr(10).join(bare(1, 6) for _ in range(r.integers(1, 6))))}</code></pre>")
            elif kind < 0.64:
                out.append(f"<figure><img src='{word()}'><figcaption>{main_text(prose(3, 16))}</figcaption></figure>")
            elif kind < 0.68 and named:  # words set apart by marks
                out.append(f"<p>{main_text(prose(2, 40).replace(' ', pick([' | ', ' | ', ' · ', ' / ', ' - '])))}</p>")
            else:
                out.append(f"{around[0]}<{par}>{main_text(prose(short, 70))}</{par.split()[0]}>{around[1]}")
        if named and r.random() < 0.15:
            out.append(f"<footer>{said('meta', 2, 6)}</footer>")
        return start + "".join(out) + stop

    def some(kinds: list[str], share: float) -> str:
        return "".join(other(k) for k in kinds if r.random() < share)

    before = ["notice", "head", "menu", "form", "ad", "side"]
    after = ["ad", "side", "comment", "form", "foot", "notice"]
    if named and r.random() < 0.1:
        before = after = []
    elif named and r.random() < 0.5:
        before, after = ([pick(list(OTHER)) for _ in range(r.integers(0, 5))] for _ in range(2))
    body = some(before, 0.55)
    text = main() if r.random() < 0.93 else ""
    if named and text and r.random() < 0.25:  # comments beside the article, in a box of both
        name = pick(["main", "main id='main'", "div id='content'", "div class='content-area'"])
        text = f"<{name}>{text}{other('comment')}</{name.split()[0]}>"
    body += text + some(after, 0.55)
    for _ in range(r.integers(0, 3)):
        name = "div" + (random_name() if r.random() < 0.6 else f" class='{pick(['page', 'wrapper', 'container', 'row', 'col', 'site', 'inner', 'grid'])}'")
        body = f"<{name}>{body}</div>"
    return f"<html><body>{body}</body></html>", labels


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(map(len, pages))
    x, mask = np.zeros((len(pages), longest, pages[0].shape[1]), np.float32), np.zeros((len(pages), longest), np.float32)
    for k, p in enumerate(pages):
        x[k, : len(p)], mask[k, : len(p)] = p, 1
    return x, mask


@lru_cache(1)
def trained(pages: int = TRAIN_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
    """The labeller, the same for the same parameters."""
    r = np.random.default_rng(seed)
    data = []
    while len(data) < pages:
        html, labels = training_page(r)
        found = blocks(html)
        if found and len(found) == len(labels):
            data.append((vectors(found), np.array(labels, np.float32)))
    data.sort(key=lambda d: len(d[0]))  # pages of like length meet in a batch
    model, moments, step = Labeller(seed=seed), {}, 0
    for epoch in range(epochs):
        for first in r.permutation(np.arange(r.integers(0, BATCH), pages, BATCH)):
            chosen = data[first : first + BATCH]
            x, mask = _padded([c[0] for c in chosen])
            y = np.zeros_like(mask)
            for k, (_, labels) in enumerate(chosen):
                y[k, : len(labels)] = labels
            step += 1
            rate = 0.02 * (1 - epoch / epochs) + 0.001
            for name, g in model.gradients(x, mask, y).items():
                m, v = moments.get(name, (0, 0))
                moments[name] = m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g**2
                model.p[name] = (model.p[name] - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def main_texts(pages: list[str], model: Labeller) -> list[str]:
    """Main text of each page; pages of like length are read together."""
    cut = [blocks(p) for p in pages]
    order = sorted((k for k in range(len(cut)) if cut[k]), key=lambda k: len(cut[k]))
    out = [""] * len(pages)
    while order:
        most = len(cut[order[-1]])
        group = [order.pop() for _ in range(min(len(order), max(1, min(256, 40_000 // most))))]
        if most > PART:
            told = [model.predict_long(cut[k]) for k in group]
        else:
            told = model.predict(*_padded([vectors(cut[k]) for k in group]))
        for k, likely in zip(group, told, strict=True):
            out[k] = "\n\n".join(b.text for b, p in zip(cut[k], likely.tolist(), strict=False) if p > 0.5)
    return out


def extract(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """(page_id, url, text) for each row of ``pages``.

    Null, empty and text-free pages give an empty text. Whole pages are read,
    cut off or not; of a very long page few blocks at a time are vectors.
    Repeated rows repeat, null ids and addresses are carried along, other
    columns (of whatever name) are not read, an empty table stays empty.
    """
    weights = model or trained()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = main_texts([x or "" for x in part.column(2).to_pylist()], weights)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return map_batches(pages.select(F.col("page_id").cast("long"), "url", "html"), read, "page_id long, url string, text string")


def op10(pages: DataFrame) -> DataFrame:
    return extract(pages).withColumn("n_chars", F.char_length("text").cast("long"))
