"""Template residue, filler and error pages among documents.

Labelled exemplars of residue, and of harmless talk about it, are held in an
inverted index of their terms.  Inverse document frequencies are counted over
all documents.  A window of a text that holds a distinctive term of an
exemplar is compared with it by TF-IDF containment: the share of the
exemplar's weight found in the window.  A document is residue where a residue
exemplar is covered and no harmless exemplar explains the same place better.

Slots of any template language (``{{name}}``, ``<your city>``, ``%(tone)s``,
label tokens, ...) are one term of their own.  Bags of filler words are
exemplars too: a place is filler where words of one bag fill a short window, of
which one word may be another, and no harmless exemplar that names words of the
bag explains the place better.

Defined cases: null and blank texts are no residue; a text is read to its end
whatever its length; repeated documents give one row each id; ties between a
residue and a harmless exemplar go to the harmless one; no documents give no
rows; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaza.llm.tokens import Table, Words, slices, word_hash, words

#: Share of an exemplar's weight that a window must hold.
MIN_CONTAINMENT = 0.8
#: Exemplars of so few terms must also make up half of their sentence.
SHORT_TERMS, MIN_COVERAGE = 3, 0.5
SLOT = "xxslot"

#: Names that template slots commonly have.
SLOT_NAMES = (
    "name|first_name|last_name|full_name|username|user|handle|email|mod_name|bio|role|hobby|quote|link|url|date|time|city|region|country|"
    "group|community|topic|title|thread_title|summary|reply_text|tone|persona|age|age_band|count|number|company|product|description|text"
)
_HTML = r"html|head|body|title|meta|link|script|style|div|span|p|br|hr|h[1-6]|a|b|i|u|s|em|strong|small|code|pre|ul|ol|li|table|tr|td|th|tbody|thead|img|form|input|button|center|font|blockquote|section|nav|main|header|footer|article"
_SLOT = re.compile(
    "|".join(
        [
            r"<?\bLBL:[A-Z][A-Z0-9_]*>?",
            r"\{\{+[^{}\n]{0,60}(?:\}+)?|\b\w+\}\}",
            r"\{%[^%\n]{0,60}%\}|<%[^%\n]{0,60}%>",
            r"[$#]\{[\w.|]+\}?|\$[A-Z][A-Z_]{2,}\$?",
            r"\{\d*:?[A-Za-z_]+\}",
            r"<!--[^>\n]{0,60}\bhere\b[^>\n]{0,20}-->",
            r"<<\w+>>|<extra_id_\d+>|<(?:your|insert|enter|add) [\w ]{1,40}>",
            rf"<(?!/|(?:{_HTML})\b)(?:{SLOT_NAMES})>",
            rf"\[(?:INSERT|Insert|insert|YOUR|Your|your|ENTER|Enter|enter|ADD|Add) [\w ]{{1,40}}\]|\[[\w ]{{1,30}} here\]|\[(?:{SLOT_NAMES})\]|\[[A-Z][A-Z_ ]{{2,40}}\]",
            r"@@\w+@@|%%\w+%%|%\(\w+\)[sd]|__[A-Z][A-Z_]+__|:[A-Z][A-Z_]{2,}:|\((?:insert|enter|add) [\w ]{1,40}\)",
            rf"~[A-Z][A-Z_]+~|«(?:{SLOT_NAMES})»|\{{\w+\.\w+\}}|\[object Object\]",
            r"#REF!|#NAME\?|#VALUE!|\bX{4,}\b|\bNaN\b|\b(?:TK){2,}\b",
        ]
    )
)

#: Phrases of residue; words that vary from page to page are left out.
RESIDUE = """
xxslot
please enable javascript to view the board of
javascript is disabled
your browser does not run scripts so cannot be shown
you need to turn on scripting in your browser to use this site
this feed requires scripts
this page requires javascript
scripts and cookies must be allowed
enable them and reload the page
some features will not work until you switch it on
bitte aktivieren sie javascript um zu sehen
activa javascript en tu navegador para continuar
veuillez activer javascript pour afficher
ative o javascript no navegador para ver
checking your browser before showing
checking if the site connection is secure
please verify you are a human to continue
loading
just a moment
404 not found
403 forbidden
500 internal server error request id
502 bad gateway
503 service unavailable
error bad gateway please try again in seconds
http 1 1 403 forbidden server edge content length 0
http 1 1 server edge content length
page not found
the page you requested could not be found
this page does not exist
access denied
you do not have permission to view this resource
your request was blocked for security reasons
request timed out after ms
upstream connect error
the server took too long to respond
service temporarily unavailable due to maintenance
no route to feed service
connection refused while contacting on port
database error near line too many connections
error code message backend fetch failed
status retry after
traceback most recent call last file line in
rate limit of per minute exceeded
too many requests
something went wrong while loading this thread
refresh or come back later
we couldn't load this conversation
this page isn't available the link may be broken or the post may have been taken down
check your connection and retry
our team has been notified
an unexpected error has occurred
session expired
please log in again to continue to
please sign in to continue
sorry this board has been removed or is private
post unavailable it was deleted by its author or hidden by staff
try again later
erreur la page demandée est introuvable
página no encontrada
vuelve al inicio o intenta más tarde
der beitrag existiert nicht mehr
seite nicht gefunden
ocorreu um erro inesperado
tente novamente em minutos
your text goes here
insert a two sentence persona essay in this box
replace this paragraph before publishing
this is a placeholder description for
write something here about later
todo write bio for
description not set
bio coming soon
body copy to come
headline to come
edit me
sample caption sample caption sample caption
no content no content
n a n a n a
test test test please ignore
lorem ipsum
"""

#: Phrases in which someone only writes about such things.
HARMLESS = """
in the templating lesson showed that xxslot prints the title trick
typesetters still joke about lorem ipsum on every poster
use s in the log line and the afterwards worked for
got a 404 on the tracker again anyone else the page was fine
our internal server error turned out to be a leaning on the switch
i turned javascript off to read in peace and half of broke somehow
wrote todo on the and never came back
the sign said access denied so we had lunch in instead
the bot kept saying rate limit while
"""

#: Bags of filler words; so many words of one bag, with at most one other among them, are filler.
FILLER = [
    (
        4,
        "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud "
        "matrus suntra solvet monita calens velluptas finita tincta irumo vestra tresque felicor cordina novellum ambera domare orbita urnas pellente quavis",
    ),
    (3, "blah"),
    (3, "foo bar baz qux"),
    (3, "asdf qwer zxcv qwerty"),
    (3, "xxx xxxx xx"),
    (3, "undefined null nan"),
    (3, "test testing"),
]


@dataclass
class Index:
    """Exemplars as an inverted index: postings of the exemplars that hold each term, and the terms of each exemplar.

    The first exemplars are the labelled ones, the last the bags of filler.
    """

    terms: list[str]
    #: Whether each exemplar is residue, and its number of terms.
    residue: np.ndarray
    size: np.ndarray
    #: Terms of all exemplars in a row and where each begins; exemplars of all terms in a row and where each begins.
    held: np.ndarray
    held_at: np.ndarray
    postings: np.ndarray
    postings_at: np.ndarray
    #: For each bag the least number of its words in a window.
    least: list[int] = field(default_factory=list)

    @classmethod
    def of(cls, residue: list[str], harmless: list[str], filler: list[tuple[int, str]] | None = None) -> Index:
        """The index of labelled exemplars and bags."""
        sets = [list(dict.fromkeys(x.split())) for x in [*residue, *harmless, *[b for _, b in filler or []]]]
        terms = sorted({t for s in sets for t in s})
        at = {t: i for i, t in enumerate(terms)}
        size = np.array([len(s) for s in sets], int)
        held = np.array([at[t] for s in sets for t in s], int)
        owner = np.repeat(np.arange(len(sets)), size)
        order = np.argsort(held, kind="stable")
        counts = np.bincount(held, minlength=len(terms))
        begin = lambda n: np.concatenate([[0], np.cumsum(n)]).astype(int)
        return cls(terms, np.arange(len(sets)) < len(residue), size, held, begin(size), owner[order], begin(counts), [n for n, _ in filler or []])

    def table(self) -> Table:
        """Term numbers by word hash."""
        return Table(np.array([word_hash(t) for t in self.terms], np.uint64), np.arange(len(self.terms), dtype=np.int32))

    def terms_of(self, exemplar: int) -> np.ndarray:
        """The terms of one exemplar."""
        return self.held[self.held_at[exemplar] : self.held_at[exemplar + 1]]

    @property
    def n_labelled(self) -> int:
        """Exemplars that are no bags."""
        return len(self.size) - len(self.least)


def _runs(begin: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``which``, place in the flat array) of all entries of the lists ``which``."""
    n = begin[which + 1] - begin[which]
    owner = np.repeat(np.arange(len(which)), n)
    return owner, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[which], n)


def default_index() -> Index:
    """The index of the exemplars above."""
    return Index.of(RESIDUE.strip().split("\n"), HARMLESS.strip().split("\n"), FILLER)


_TAG = re.compile(rf"</?(?:{_HTML})\b[^<>\n]*>")


#: What a text must hold for any slot pattern to match.
_MARKS = ("{", "<", "[", "}}", "$", "LBL:", "@@", "%%", "%(", "__", "(insert ", "(enter ", "(add ", "~", "«", "#REF!", "#NAME?", "#VALUE!", "XXXX", "NaN", "TKTK")
_CODE = re.compile(r":[A-Z][A-Z_]{2,}:")


def _plain(t: str) -> str:
    if "<" in t:
        t = _TAG.sub("\n", t)
    return _SLOT.sub(f" {SLOT} ", t) if any(m in t for m in _MARKS) or _CODE.search(t) else t


def analyse(texts: list[str | None]) -> list[bytes]:
    """Texts with every slot as the word SLOT and mark-up as line ends, in lower case."""
    return [b"" if not t else _plain(t).replace("’", "'").lower().encode("utf-8", "replace") for t in texts]


def term_counts(index: Index, table: Table, texts: list[str | None]) -> np.ndarray:
    """Number of texts that hold each term."""
    w = words(analyse(texts))
    t = table.get(w.hash)
    hit = t >= 0
    both = np.unique(w.doc[hit] * len(index.terms) + t[hit])
    return np.bincount(both % len(index.terms), minlength=len(index.terms))


class Judge:
    """Finds residue in batches of texts, given inverse document frequencies."""

    def __init__(self, index: Index, idf: np.ndarray) -> None:
        self.index, self.table, self.idf = index, index.table(), idf
        ix = index
        owner = np.repeat(np.arange(len(ix.size)), ix.size)
        self.total = np.bincount(owner, idf[ix.held], len(ix.size))
        self.radius = 2 * np.minimum(np.select([ix.size <= 4, ix.size <= 9], [4, 9], 14), 14) + 2
        # A window is looked at where a term stands that is among the heavier half of some residue exemplar.
        self.anchor = np.zeros(len(ix.terms), bool)
        for e in np.flatnonzero(ix.residue):
            own = np.sort(ix.terms_of(e))
            self.anchor[own[np.argsort(-idf[own], kind="stable")[: (len(own) + 1) // 2]]] = True
        self.bags = [np.isin(np.arange(len(ix.terms)), ix.terms_of(ix.n_labelled + i)) for i in range(len(ix.least))]

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        """True for each text that holds residue."""
        w = words(analyse(texts))
        out = np.zeros(len(texts), bool)
        term = self.table.get(w.hash)
        # Occurrences of terms in order of term and place: one search answers whether a term stands in a window.
        self.span = len(term) + 1
        hit = np.flatnonzero(term >= 0)
        self.places = np.sort(term[hit].astype(np.int64) * self.span + hit)
        self.first, self.last = np.searchsorted(w.doc, np.arange(len(texts))), np.searchsorted(w.doc, np.arange(len(texts)), side="right") - 1
        for i, (least, bag) in enumerate(zip(self.index.least, self.bags, strict=True)):
            at = self._filled(w, term, least, bag)
            for k in range(0, len(at), 4096):
                part = at[k : k + 4096]
                out[w.doc[part[~self._explained(w, part, self.index.n_labelled + i)]]] = True
        anchors = np.flatnonzero((term >= 0) & self.anchor[term])
        anchors = anchors[~out[w.doc[anchors]]]
        for i in range(0, len(anchors), 4096):
            part = anchors[i : i + 4096]
            hit = self._windows(w, term, part)
            out[w.doc[part[hit]]] = True
        return out

    def _mass(self, w: Words, at: np.ndarray, exemplar: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Weight of each exemplar's terms that stand within ``radius`` words of the word ``at`` in its text."""
        ix = self.index
        pair, place = _runs(ix.held_at, exemplar)
        t, doc = ix.held[place], w.doc[at]
        low, high = np.maximum(at - radius, self.first[doc]), np.minimum(at + radius, self.last[doc])
        found = np.searchsorted(self.places, t * self.span + low[pair])
        there = (found < len(self.places)) & (self.places[np.minimum(found, len(self.places) - 1)] <= t * self.span + high[pair])
        return np.bincount(pair, self.idf[t] * there, len(at))

    def _filled(self, w: Words, term: np.ndarray, least: int, bag: np.ndarray) -> np.ndarray:
        """First words of windows of ``least`` words, or one more, of which ``least`` are of the bag."""
        own = (term >= 0) & bag[term]
        upto = np.concatenate([[0], np.cumsum(own)])
        first = np.flatnonzero(own)
        hit = np.zeros(len(first), bool)
        for size in (least, least + 1):
            ok = first + size <= len(term)
            end = np.where(ok, first + size, 1)
            hit |= ok & (upto[end] - upto[first] >= least) & (w.doc[end - 1] == w.doc[first])
        return first[hit]

    def _explained(self, w: Words, at: np.ndarray, bag: int) -> np.ndarray:
        """True where a harmless exemplar that names words of the bag is covered and weighs as much as the bag's words there."""
        ix, out = self.index, np.zeros(len(at), bool)
        _, place = _runs(ix.postings_at, ix.terms_of(bag))
        for e in np.unique(ix.postings[place]):
            if ix.residue[e] or e >= ix.n_labelled:
                continue
            r = np.full(len(at), self.radius[e])
            got = self._mass(w, at, np.full(len(at), e), r)
            out |= (got >= MIN_CONTAINMENT * self.total[e]) & (got >= self._mass(w, at, np.full(len(at), bag), r))
        return out

    def _windows(self, w: Words, term: np.ndarray, at: np.ndarray) -> np.ndarray:
        """True where a residue exemplar in the postings of the word is covered and no harmless one in them weighs as much."""
        ix = self.index
        own, place = _runs(ix.postings_at, term[at].astype(int))
        e = ix.postings[place]
        labelled = e < ix.n_labelled
        own, e = own[labelled], e[labelled]
        got = self._mass(w, at[own], e, self.radius[e])
        enough = np.flatnonzero(got >= MIN_CONTAINMENT * self.total[e])
        own, e, got = own[enough], e[enough], got[enough]
        slot = ix.terms.index(SLOT) if SLOT in ix.terms else -1
        good = ix.residue[e]
        for k in np.flatnonzero(good & (ix.size[e] <= SHORT_TERMS)):
            if ix.terms_of(e[k]).tolist() != [slot]:
                good[k] = self._covers(w, term, at[own[k]], e[k])
        mass, harmless = np.zeros(len(at)), np.zeros(len(at))
        np.maximum.at(mass, own[good], got[good])
        np.maximum.at(harmless, own[~ix.residue[e]], got[~ix.residue[e]])
        return (mass > 0) & (mass > harmless)

    def _covers(self, w: Words, term: np.ndarray, at: int, exemplar: int) -> bool:
        """Whether the sentence of a word holds enough of the exemplar, and little else."""
        s, e = np.searchsorted(w.sentence, [w.sentence[at], w.sentence[at] + 1])
        t = term[s:e]
        mine = (t >= 0) & np.isin(t, self.index.terms_of(exemplar))
        return bool(self.total[exemplar] * MIN_CONTAINMENT <= self.idf[np.unique(t[mine])].sum() and mine.sum() >= MIN_COVERAGE * (e - s))


def inverse_frequencies(docs: DataFrame, text: str, index: Index) -> np.ndarray:
    """``ln((1 + N) / (1 + df)) + 1`` of each term, over all rows of ``docs``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, n, df = index.table(), 0, np.zeros(len(index.terms), np.int64)
        for b in batches:
            n += b.num_rows
            for _, texts in slices(b.column(0)):
                df += term_counts(index, table, texts)
        term = np.arange(-1, len(index.terms), dtype=np.int32)
        yield pa.RecordBatch.from_pydict({"term": pa.array(term), "n": pa.array(np.concatenate([[n], df]))})

    rows = docs.select(text).mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found: Counter = Counter({r.term: r.n for r in rows})
    return np.array([math.log((1 + found[-1]) / (1 + found[t])) + 1 for t in range(len(index.terms))])


def residue(docs: DataFrame, key: str, text: str, index: Index | None = None) -> DataFrame:
    """(key, is_residue): one row per row of ``docs``."""
    index = index or default_index()
    idf = inverse_frequencies(docs, text, index)
    kind = docs.schema[key].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = Judge(index, idf)
        for b in batches:
            hit = [one(texts) for _, texts in slices(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(hit) if hit else np.zeros(0, bool))], [key, "is_residue"])

    return docs.select(key, text).mapInArrow(judge, f"`{key}` {kind}, is_residue boolean")
