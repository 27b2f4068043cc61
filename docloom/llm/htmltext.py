"""Main text of web pages from flat text blocks and a small decision tree.

A page is cut into blocks at block-level tags. Each block has its number of words and its link
density (the share of words inside links), the same of the blocks before and after it, whether it
is a heading, whether it stands inside an article element (or outside one on a page that has one),
inside an element for menus, forms and the like, how far class names speak of such, and whether it follows a heading
of readers' comments or speaks of rights. A decision tree, grown here by Gini impurity from ``LABELLED``, decides which
blocks are main text. Class names alone never leave a page without text.

Counts of open elements are kept while a page is read, so a page takes time in proportion to its
length, however deep its elements lie. An element that is never closed says nothing about the
blocks in it, and a form around an article is not a form.

Defined results: null and empty pages, and pages without main text, give empty text; character
references are decoded, white space inside a block becomes one space; unclosed and stray tags are
allowed; repeated rows get a row each; null ids and URLs are kept; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: ``noted`` is 1 from a heading of readers' comments on, as far as the element goes, and for a last line about rights.
FEATURES = ("around", "article", "heading", "named", "noted", "words", "links", "words_before", "links_before", "words_after", "links_after")

#: Labelled blocks: the features above, then 1 for main text. Fixed values, made for this purpose.
#: ``article`` is 1 inside an article, -1 outside it on a page that has one, 0 on a page without.
_WITHOUT_NOTES = np.array(
    [
        # inside an article: paragraphs, short lines, headings, lists of references
        (0, 1, 0, 0.0, 85, 0.00, 40, 0.00, 60, 0.00, 1),
        (0, 1, 0, 0.0, 40, 0.05, 85, 0.00, 12, 0.00, 1),
        (0, 1, 0, 0.0, 2, 0.00, 60, 0.00, 55, 0.00, 1),
        (0, 1, 0, 0.0, 1, 0.00, 3, 0.00, 0, 0.00, 1),
        (0, 1, 0, 0.0, 6, 0.00, 0, 0.00, 3, 1.00, 1),
        (0, 1, 0, 0.0, 25, 0.40, 30, 0.10, 22, 0.00, 1),
        (0, 1, 0, 0.0, 120, 0.02, 5, 1.00, 4, 1.00, 1),
        (0, 1, 1, 0.0, 8, 0.00, 7, 0.00, 50, 0.00, 1),
        (0, 1, 1, 0.5, 6, 1.00, 4, 1.00, 70, 0.00, 1),
        (0, 1, 0, 0.0, 4, 1.00, 5, 1.00, 3, 1.00, 1),
        (0, 1, 0, 0.0, 7, 1.00, 60, 0.00, 6, 1.00, 1),
        (0, 1, 0, 0.5, 30, 0.00, 40, 0.00, 20, 0.00, 1),
        (0, 1, 0, 0.0, 12, 0.00, 3, 1.00, 5, 1.00, 1),
        (0, 1, 0, 0.0, 1, 0.00, 1, 1.00, 2, 0.00, 1),
        (0, 1, 0, 0.0, 2, 1.00, 2, 1.00, 1, 1.00, 1),
        (0, 1, 0, 0.0, 9, 0.60, 8, 0.70, 11, 0.50, 1),
        (0, 1, 0, 0.0, 3, 1.00, 5, 0.00, 0, 0.00, 1),
        (0, 1, 1, 0.0, 1, 0.00, 1, 1.00, 4, 0.00, 1),
        (0, 1, 1, 0.0, 2, 0.00, 0, 0.00, 4, 0.00, 1),
        (0, 1, 0, 0.0, 0, 0.00, 20, 0.00, 20, 0.00, 1),
        (0, 1, 0, 0.0, 30, 0.00, 6, 1.00, 0, 0.00, 1),
        (0, 1, 0, 0.5, 3, 0.00, 1, 1.00, 0, 0.00, 1),
        # inside elements for menus, side bars, forms and feet
        (1, -1, 0, 0.0, 1, 1.00, 0, 0.00, 1, 1.00, 0),
        (1, -1, 0, 0.0, 18, 0.00, 60, 0.00, 0, 0.00, 0),
        (1, 0, 0, 0.0, 1, 1.00, 1, 1.00, 8, 0.00, 0),
        (1, 0, 0, 0.0, 60, 0.00, 5, 0.00, 70, 0.00, 0),
        (1, 0, 0, 0.0, 14, 0.10, 40, 0.00, 0, 0.00, 0),
        (1, 0, 1, 0.0, 3, 0.00, 6, 0.00, 20, 0.00, 0),
        (1, 1, 0, 0.0, 30, 0.00, 50, 0.00, 25, 0.00, 0),
        (1, 1, 0, 1.0, 90, 0.00, 80, 0.00, 60, 0.00, 0),
        (1, 1, 1, 0.0, 2, 0.00, 60, 0.00, 30, 0.00, 0),
        # named as adverts, comments, notices
        (0, 1, 0, 1.0, 30, 0.00, 50, 0.00, 25, 0.00, 0),
        (0, 1, 0, 1.0, 4, 0.00, 60, 0.00, 60, 0.00, 0),
        (0, 1, 0, 1.0, 5, 1.00, 40, 0.00, 6, 1.00, 0),
        (0, 0, 0, 1.0, 70, 0.00, 30, 0.00, 40, 0.00, 0),
        (0, 0, 0, 1.0, 12, 0.00, 20, 0.00, 15, 0.00, 0),
        (0, 0, 0, 1.0, 6, 0.00, 0, 0.00, 30, 0.00, 0),
        (0, 1, 0, 1.0, 15, 0.00, 30, 0.00, 0, 0.00, 0),
        (0, 1, 0, 1.0, 8, 0.20, 9, 0.10, 7, 0.00, 0),
        (0, 1, 1, 1.0, 2, 0.00, 44, 0.00, 12, 0.00, 0),
        (0, -1, 0, 1.0, 33, 0.00, 12, 0.00, 8, 0.00, 0),
        (0, 0, 0, 1.0, 9, 0.00, 2, 1.00, 50, 0.00, 0),
        (0, -1, 0, 1.0, 8, 0.00, 1, 1.00, 10, 0.00, 0),
        # outside the article of a page that has one
        (0, -1, 0, 0.0, 40, 0.00, 60, 0.00, 30, 0.00, 0),
        (0, -1, 0, 0.0, 5, 0.00, 1, 1.00, 9, 0.00, 0),
        (0, -1, 1, 0.0, 4, 0.00, 2, 1.00, 60, 0.00, 0),
        (0, -1, 0, 0.5, 20, 0.00, 60, 0.00, 0, 0.00, 0),
        (0, -1, 0, 0.0, 70, 0.00, 25, 0.00, 80, 0.00, 0),
        (0, -1, 0, 0.0, 9, 0.00, 30, 0.00, 6, 0.00, 0),
        (0, -1, 1, 0.0, 3, 0.00, 12, 0.00, 20, 0.00, 0),
        (0, -1, 0, 0.0, 2, 0.00, 3, 0.00, 0, 0.00, 0),
        # pages that name nothing: running text
        (0, 0, 0, 0.0, 90, 0.00, 6, 0.00, 70, 0.00, 1),
        (0, 0, 0, 0.0, 45, 0.10, 3, 1.00, 60, 0.05, 1),
        (0, 0, 0, 0.0, 24, 0.00, 50, 0.00, 2, 1.00, 1),
        (0, 0, 0, 0.5, 60, 0.00, 0, 0.00, 0, 0.00, 1),
        (0, 0, 0, 0.5, 35, 0.05, 40, 0.00, 30, 0.00, 1),
        (0, 0, 0, 0.0, 30, 0.20, 9, 0.00, 3, 1.00, 1),
        (0, 0, 0, 0.0, 28, 0.00, 1, 1.00, 1, 1.00, 1),
        # short lines and headings among text without links
        (0, 0, 0, 0.0, 6, 0.00, 55, 0.00, 48, 0.00, 1),
        (0, 0, 0, 0.0, 4, 0.00, 35, 0.00, 80, 0.00, 1),
        (0, 0, 0, 0.0, 3, 0.00, 1, 0.00, 0, 0.00, 1),
        (0, 0, 0, 0.0, 5, 0.00, 4, 0.00, 3, 0.00, 1),
        (0, 0, 0, 0.0, 7, 0.00, 30, 0.00, 0, 0.00, 1),
        (0, 0, 0, 0.0, 6, 0.00, 40, 0.00, 0, 0.00, 1),
        (0, 0, 0, 0.0, 5, 0.00, 10, 0.00, 0, 0.00, 1),
        (0, 0, 0, 0.0, 5, 0.00, 1, 0.00, 0, 0.00, 1),
        (0, 0, 0, 0.0, 2, 0.00, 3, 0.05, 0, 0.00, 1),
        (0, 0, 0, 0.0, 1, 0.00, 6, 0.00, 4, 0.00, 1),
        (0, 0, 0, 0.0, 6, 0.00, 0, 0.00, 0, 0.00, 1),
        (0, 0, 1, 0.0, 1, 0.00, 0, 0.00, 3, 0.00, 1),
        (0, 0, 1, 0.0, 5, 0.00, 30, 0.00, 44, 0.00, 1),
        (0, 0, 1, 0.0, 7, 0.00, 2, 1.00, 60, 0.00, 1),
        (0, 0, 1, 0.0, 3, 0.00, 1, 1.00, 20, 0.05, 1),
        (0, 0, 1, 0.0, 1, 0.00, 1, 1.00, 40, 0.00, 1),
        (0, 0, 1, 0.0, 2, 0.00, 3, 1.00, 15, 0.00, 1),
        (0, 0, 0, 0.0, 8, 0.00, 50, 0.00, 1, 1.00, 1),
        # menus, tag lines and notes beside them
        (0, 0, 0, 0.0, 0, 0.00, 0, 0.00, 0, 0.00, 0),
        (0, 0, 0, 0.0, 1, 1.00, 0, 0.00, 1, 1.00, 0),
        (0, 0, 0, 0.0, 4, 1.00, 1, 1.00, 60, 0.00, 0),
        (0, 0, 0, 0.0, 18, 0.90, 20, 0.00, 30, 0.80, 0),
        (0, 0, 0, 0.0, 40, 0.80, 2, 1.00, 3, 1.00, 0),
        (0, 0, 0, 0.0, 3, 0.00, 1, 1.00, 2, 1.00, 0),
        (0, 0, 0, 0.0, 6, 0.00, 1, 1.00, 1, 1.00, 0),
        (0, 0, 0, 0.0, 4, 0.00, 2, 1.00, 50, 0.00, 0),
        (0, 0, 0, 0.0, 5, 0.00, 2, 1.00, 0, 0.00, 0),
        (0, 0, 0, 0.0, 6, 0.00, 3, 1.00, 0, 0.00, 0),
        (0, 0, 0, 0.0, 2, 0.00, 1, 1.00, 0, 0.00, 0),
        (0, 0, 0, 0.0, 1, 0.00, 4, 1.00, 6, 0.00, 0),
        (0, 0, 0, 0.0, 3, 0.00, 2, 0.80, 30, 0.00, 0),
        (0, 0, 0, 0.0, 5, 0.00, 0, 0.00, 1, 1.00, 0),
        (0, 0, 0, 0.0, 4, 0.00, 5, 0.20, 2, 1.00, 0),
        (0, 0, 0, 0.0, 8, 0.50, 40, 0.00, 0, 0.00, 0),
        (0, 0, 1, 0.0, 2, 0.00, 1, 1.00, 1, 1.00, 0),
        (0, 0, 1, 0.0, 4, 0.00, 2, 1.00, 2, 1.00, 0),
        (0, 0, 1, 0.0, 3, 1.00, 5, 0.00, 2, 1.00, 0),
        (0, 0, 0, 0.5, 4, 0.00, 1, 1.00, 3, 1.00, 0),
        (0, 0, 0, 0.5, 9, 0.60, 3, 0.00, 3, 1.00, 0),
    ]
)

#: The same blocks, none of them noted, and blocks of comments and last lines, which are.
LABELLED = np.vstack(
    [
        np.insert(_WITHOUT_NOTES, FEATURES.index("noted"), 0, axis=1),
        [
            (0, 1, 1, 0.0, 1, 2, 0.00, 60, 0.00, 9, 0.00, 0),
            (0, 1, 0, 0.0, 1, 30, 0.00, 2, 0.00, 25, 0.00, 0),
            (0, 1, 0, 0.0, 1, 4, 0.10, 30, 0.00, 0, 0.00, 0),
            (0, -1, 1, 0.0, 1, 2, 0.00, 60, 0.00, 14, 0.00, 0),
            (0, -1, 0, 0.5, 1, 80, 0.00, 12, 0.00, 6, 0.50, 0),
            (0, 0, 1, 0.0, 1, 2, 0.00, 70, 0.00, 20, 0.00, 0),
            (0, 0, 1, 0.0, 1, 1, 0.00, 3, 0.00, 5, 0.00, 0),
            (0, 0, 0, 0.0, 1, 6, 0.00, 2, 0.00, 3, 0.00, 0),
            (0, 0, 0, 0.0, 1, 25, 0.00, 2, 0.00, 40, 0.00, 0),
            (0, 0, 0, 0.0, 1, 90, 0.05, 50, 0.00, 60, 0.00, 0),
            (0, 0, 0, 0.0, 1, 3, 0.00, 25, 0.00, 0, 0.00, 0),
            (0, 0, 0, 0.0, 1, 6, 0.00, 60, 0.00, 0, 0.00, 0),
            (0, 0, 0, 0.0, 1, 14, 0.20, 30, 0.00, 2, 1.00, 0),
            (1, 0, 0, 0.0, 1, 8, 0.00, 40, 0.00, 0, 0.00, 0),
        ],
    ]
)

#: Names of HTML, fixed values.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never shown as text of the page; of some not even a gap is seen where they stand.
UNSEEN_TAGS = frozenset("script style noscript template svg".split())
HIDDEN_TAGS = frozenset("script style noscript template iframe object svg math canvas audio video select textarea button head title datalist".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
AROUND_TAGS = frozenset("nav footer aside form menu dialog".split())
AROUND_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Words of class names and ids, fixed values: of what stands around an article (if it is the last that counts), of the
#: heads of pages, of articles, and words that say nothing.
AROUND_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar sidebars widget widgets nav navbar navigation menu submenu breadcrumb breadcrumbs footer comment comments commentlist commentform reply replies respond disqus share sharing social related recommended recommendations cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search searchform pagination pager skip"
    # the same in German, French and Spanish
    " werbung anzeige anzeigen fusszeile fussleiste seitenleiste navigationsleiste kommentar kommentare hinweis hinweise teilen suche anmeldung verwandte empfehlungen"
    " publicite publicites pub pubs pied piedpage barre commentaire commentaires avis partager partage recherche connexion connexes recommandations abonnement"
    " publicidad anuncio anuncios pie piepagina barralateral comentario comentarios aviso avisos compartir buscar busqueda acceso relacionados recomendados suscripcion".split()
)
HEAD_NAMES = frozenset("header masthead topbar kopfzeile kopf entete cabecera encabezado".split())
ARTICLE_NAMES = frozenset("article articlebody entry story post content maincontent main body text".split())
PLAIN_NAMES = frozenset("site page main top bottom left right primary secondary wrapper wrap container inner outer box block section area list item items links posts content body text bar row col js is has the".split())
ARTICLE_TAGS = frozenset("article main".split())
#: Elements that hold the whole page, whose class names say nothing about their text.
WHOLE_TAGS = frozenset("html body article main".split())

#: How readers' comments are headed and how the last line of a page begins, in four languages; fixed values.
_COMMENTS = re.compile(r"(?:\d+\s+(?:comments?|replies|responses|kommentare?|antworten|commentaires?|réponses|comentarios?|respuestas)|(?:comments?|kommentare?|commentaires?|comentarios?)(?:\s*\(\s*\d+\s*\))?)\s*:?\Z", re.I)
_LAST_LINE = re.compile(r"(?:©|\(c\)|copyright\b|all rights reserved|alle rechte vorbehalten|tous droits réservés|todos los derechos reservados)", re.I)
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^<>]*>"
    r"|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:\s[^<>\"']*|/)?(?:\"[^\"]*\"[^<>\"']*|'[^']*'[^<>\"']*)*)>"
    r"|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^<>]*)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_BODY = re.compile(r"<body\b", re.I)
_HIDDEN_END = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in HIDDEN_TAGS}
_WORD = re.compile(r"[^\W_]")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Block:
    text: str
    words: int
    linked: int
    around: int
    tagged: bool
    article: bool
    heading: bool
    named: float
    #: The block-level element around the one that it stands in.
    holder: _Element | None = None

    @property
    def links(self) -> float:
        return self.linked / self.words if self.words else 0.0


@dataclass
class _Element:
    tag: str
    first_block: int
    around: bool = False
    article: bool = False
    half: bool = False
    full: bool = False
    #: The first block behind it; None while it is open.
    end: int | None = None


def named(value: str, inside: bool) -> tuple[float, bool]:
    """(how far a class name or id speaks of something around an article: wholly if its last word does, half if another; whether it names an article)."""
    most, article = 0.0, False
    for name in value.split():
        words = [w.lower() for w in _NAME.findall(name)]
        telling = [w for w in words if w not in PLAIN_NAMES]
        around = [w in AROUND_NAMES or (w in HEAD_NAMES and not inside) for w in telling]
        most = max(most, 1.0 if around[-1:] == [True] else 0.5 if any(around) else 0.0)
        article |= bool(words) and not any(around) and all(w in ARTICLE_NAMES or w in PLAIN_NAMES for w in words) and any(w in ARTICLE_NAMES for w in words)
    return most, article


@dataclass
class _Page:
    """The open elements of a page while it is read with their counts, and its blocks so far."""

    blocks: list[Block] = field(default_factory=list)
    open: list[_Element] = field(default_factory=list)
    #: Places in ``open``, of each tag and of all block-level elements.
    at: dict[str, list[int]] = field(default_factory=dict)
    block_at: list[int] = field(default_factory=list)
    forms: list[_Element] = field(default_factory=list)
    parts: list[tuple[str, bool]] = field(default_factory=list)
    around: int = 0
    articles: int = 0
    tagged: int = 0
    headings: int = 0
    half: int = 0
    full: int = 0

    def text(self, text: str) -> None:
        self.parts.append((text, bool(self.at.get("a"))))

    def end_block(self) -> None:
        if not self.parts:
            return
        whole = " ".join(html.unescape("".join(p for p, _ in self.parts)).split())
        if whole:
            linked = sum(1 for p, inside in self.parts if inside for w in html.unescape(p).split() if _WORD.search(w))
            words = sum(1 for w in whole.split(" ") if _WORD.search(w))
            self.blocks.append(
                Block(
                    whole, words, min(linked, words), self.around, self.tagged > 0, self.articles > 0, self.headings > 0, 1.0 if self.full else 0.5 if self.half else 0.0,
                    self.open[self.block_at[-2]] if len(self.block_at) > 1 else None,
                )
            )
        self.parts = []

    def _count(self, e: _Element, by: int) -> None:
        self.around += by * e.around
        self.articles += by * e.article
        self.tagged += by * (e.tag in ARTICLE_TAGS)
        self.headings += by * (e.tag in HEADINGS)
        self.half += by * e.half
        self.full += by * e.full

    def _close_down_to(self, place: int) -> None:
        while len(self.open) > place:
            e = self.open.pop()
            e.end = len(self.blocks)
            self.at[e.tag].pop()
            if e.tag in BLOCK_TAGS:
                self.block_at.pop()
            if self.forms and self.forms[-1] is e:
                self.forms.pop()
            self._count(e, -1)

    def start(self, tag: str, attributes: str) -> None:
        if tag in BLOCK_TAGS:
            self.end_block()
        if tag in ("p", "li", "a"):  # these end an open one of their kind
            nearest = self.block_at[-1] if self.block_at else 0
            if self.at.get(tag) and self.at[tag][-1] >= nearest:
                self._close_down_to(self.at[tag][-1])
        if tag in VOID_TAGS:
            return
        if tag in ARTICLE_TAGS:  # a form around an article is the page's
            for e in self.forms:
                self.around -= e.around
                e.around = False
            self.forms = []
        e = self._element(tag, attributes)
        self.at.setdefault(tag, []).append(len(self.open))
        if tag in BLOCK_TAGS:
            self.block_at.append(len(self.open))
        if tag == "form" and e.around:
            self.forms.append(e)
        self.open.append(e)
        self._count(e, 1)

    def _element(self, tag: str, attributes: str) -> _Element:
        inside = self.articles > 0
        e = _Element(tag, len(self.blocks), tag in AROUND_TAGS or (tag == "header" and not inside), tag in ARTICLE_TAGS)
        if attributes:
            for name, *values in _ATTRIBUTE.findall(attributes):
                name, value = name.lower(), next((v for v in values if v), "")
                if name == "role":
                    e.around |= value.strip().lower() in AROUND_ROLES
                    e.article |= value.strip().lower() in ARTICLE_TAGS
                elif name == "aria-hidden":
                    e.around |= value.lower() == "true"
                elif name == "hidden":
                    e.around = True
                elif tag not in WHOLE_TAGS:
                    share, article = named(value, inside)
                    e.full |= share == 1.0
                    e.half |= share == 0.5
                    e.article |= article
        return e

    def end(self, tag: str) -> None:
        if tag in BLOCK_TAGS:
            self.end_block()
        places = self.at.get(tag)
        # A stray end of an inline element doesn't close blocks; the end of the page closes nothing.
        if places and tag not in ("html", "body") and (tag in BLOCK_TAGS or not self.block_at or places[-1] > self.block_at[-1]):
            self._close_down_to(places[-1])

    def done(self) -> list[Block]:
        """The blocks. Elements that were never closed no longer count as standing around them."""
        self.end_block()
        unclosed = np.zeros(len(self.blocks) + 1, int)
        for e in self.open:
            unclosed[e.first_block] += e.around
        for block, number in zip(self.blocks, np.cumsum(unclosed).tolist(), strict=False):
            block.around -= number
        return self.blocks


def blocks(page: str | None) -> list[Block]:
    """The text blocks of a whole page in order."""
    source, found, at, endless = page or "", _Page(), 0, set()
    while True:
        tag = _TAG.search(source, at)
        text = source[at : tag.start() if tag else len(source)]
        if text:
            found.text(text)
        if tag is None:
            return found.done()
        at = tag.end()
        closing, name, attributes = (tag[1], tag[2], tag[3]) if tag[2] else (tag[4], tag[5], tag[6])
        if not name:
            continue
        name = name.lower()
        if closing:
            found.end(name)
        elif name in HIDDEN_TAGS:
            end = None if name in endless else _HIDDEN_END[name].search(source, at)
            if end is None:
                endless.add(name)  # nor is there one further on
            if name == "head":  # holds other elements; may be left open
                body = _BODY.search(source, at) if "body" not in endless else None
                if body is None:
                    endless.add("body")
                at = min([m.end() if m is end else m.start() for m in (end, body) if m], default=at)
            elif end:
                at = end.end()
            elif name in ("script", "style", "textarea"):
                at = len(source)
            if name not in UNSEEN_TAGS:
                found.parts.append((" ", False))
        else:
            found.start(name, attributes or "")
            if attributes and attributes.endswith("/") and name not in VOID_TAGS and name not in BLOCK_TAGS:
                found.end(name)


def noted(found: list[Block]) -> np.ndarray:
    """Whether each block follows a heading of readers' comments in the element that holds the heading, or is a line about rights at the end of a page.

    Within an article, or with long text behind it, such a line is text like any other.
    """
    change, rights = np.zeros(len(found) + 1, int), np.zeros(len(found), bool)
    behind = np.maximum.accumulate([0, *(b.words for b in reversed(found))])[-2::-1]
    for i, block in enumerate(found):
        if block.words <= 6 and _COMMENTS.match(block.text):
            end = block.holder.end if block.holder and block.holder.end is not None else len(found)
            change[i] += 1
            change[max(end, i + 1)] -= 1
        rights[i] = block.words <= 40 and behind[i] <= 20 and not block.article and bool(_LAST_LINE.match(block.text))
    return (np.cumsum(change)[:-1] > 0) | rights


def features(found: list[Block]) -> np.ndarray:
    """A row of FEATURES for each block."""
    sizes = np.array([(b.words, b.links) for b in found], float).reshape(-1, 2)
    nothing, outside = np.zeros((1, 2)), -1 if any(b.tagged for b in found) else 0
    own = np.array([(b.around > 0, 1 if b.article else outside, b.heading, b.named) for b in found], float).reshape(-1, 4)
    marks = noted(found).astype(float).reshape(-1, 1)
    return np.hstack([own, marks, sizes, np.vstack([nothing, sizes[:-1]])[: len(found)], np.vstack([sizes[1:], nothing])[: len(found)]])


@dataclass
class Tree:
    """A node: a share of main text, or a feature and a bound with two trees below."""

    share: float
    feature: int = -1
    bound: float = 0.0
    below: Tree | None = None
    above: Tree | None = None

    def used(self) -> set[int]:
        """The features that it splits by."""
        return set() if self.below is None or self.above is None else {self.feature} | self.below.used() | self.above.used()

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.below is None or self.above is None:
            return np.full(len(x), self.share)
        low = x[:, self.feature] <= self.bound
        out = np.empty(len(x))
        out[low], out[~low] = self.below.predict(x[low]), self.above.predict(x[~low])
        return out


def grow(x: np.ndarray, y: np.ndarray, depth: int = 10) -> Tree:
    """A tree that splits where the Gini impurity falls most; the first such feature and bound on ties."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0):
        return Tree(share)
    best, impurity = None, len(y) * share * (1 - share)
    for feature in range(x.shape[1]):
        values = np.unique(x[:, feature])
        for bound in (values[1:] + values[:-1]) / 2:
            low = x[:, feature] <= bound
            parts = sum(len(p) * p.mean() * (1 - p.mean()) for p in (y[low], y[~low]))
            if parts < impurity - 1e-12:
                best, impurity = (feature, float(bound)), parts
    if best is None:
        return Tree(share)
    low = x[:, best[0]] <= best[1]
    return Tree(share, *best, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1))


def trained(labelled: np.ndarray = LABELLED) -> Tree:
    return grow(labelled[:, :-1].astype(float), labelled[:, -1].astype(float))


def main_text(page: str | None, tree: Tree) -> str:
    """The text of the blocks that the tree takes; where class names alone leave none, of those it takes without them."""
    found = blocks(page)
    if not found:
        return ""
    rows = features(found)
    chosen = tree.predict(rows) > 0.5
    if not chosen.any():
        rows[:, FEATURES.index("named")] = 0.0
        chosen = tree.predict(rows) > 0.5
    return " ".join(b.text for b, c in zip(found, chosen, strict=True) if c)


def extract(pages: DataFrame, labelled: np.ndarray = LABELLED) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html)."""
    tree, source = trained(labelled), pages.select("page_id", "url", "html")
    types = {f.name: f.dataType.simpleString() for f in source.schema}

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page, tree) for page in batch.column(2).to_pylist()]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes], ["page_id", "url", "text", "n_chars"])

    return source.mapInArrow(extracted, f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long")
