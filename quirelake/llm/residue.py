"""Template residue, filler and error pages in place of content.

Labelled exemplars are held in an inverted index (token -> exemplars). A first pass counts over all documents in how many
each index token occurs; only those sums leave the executors. The second pass retrieves for each passage window the
exemplars it shares index tokens with and scores their TF-IDF containment in it. A window whose weight is covered by well-contained
exemplars to a high degree is residue of their kind, unless an exemplar of a sentence that only speaks about such
things covers it better. Open places of templates are index tokens themselves (one class for all notations). An exact
check then looks at the document: an error page or a script notice has to be what stands instead of the content, an
open place or filler passage counts wherever it is.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.llm import residue_exemplars as X

SLOT = "slot"
#: An exemplar counts in a window from this containment on, one of the mentions from the lower one.
CONTAINED, MENTIONED = 0.75, 0.6
#: Share of a window's weight that contained exemplars have to cover.
COVERED = {"error": 0.5, "script": 0.5, "filler": 0.8, "around": 0.8}
#: Share of a document's content that error pages and notices have to make up.
INSTEAD = 0.5
# The notations of open places, (name, opening, closing); the longer ones first.
_NOTATIONS = (
    ("{{{", "{{{", "}}}"), ("{{", "{{", "}}"), ("{%", "{%", "%}"), ("<%", "<%", "%>"), ("<?", "<?", "?>"), ("${", "${", "}"), ("#{", "#{", "}"), ("$(", "$(", ")"), ("%(", "%(", ")"), ("[[", "[[", "]]"), ("@@", "@@", "@@"),
    ("##", "##", "##"), ("__", "__", "__"), ("&lt;", "&lt;", "&gt;"), ("«", "«", "»"), ("【", "【", "】"), ("〔", "〔", "〕"), ("（", "（", "）"), ("{", "{", "}"), ("[", "[", "]"), ("<", "<", ">"), ("(", "(", ")"), ("%", "%", "%"), ("$", "$", "$"),
)
#: Notations that mean other things as well: there the name or a word that asks for something has to speak for an open place.
_AMBIGUOUS = {"##", "__", "&lt;", "«", "【", "〔", "（", "{", "[", "<", "(", "%", "$"}
_PLACE = re.compile(r"(?=[{<$#@_&«\[(【〔（%])(?:" + "|".join(rf"(?P<n{i}>(?<![A-Za-z0-9_\\]){re.escape(o)}(?=[^\n])" + (r"[^\n{}]*?" if o[-1] == "{" else r"[^\n]*?") + rf"{re.escape(c)})" if o[0] in "_%$" and o == c else rf"(?P<n{i}>{re.escape(o)}" + (r"[^\n{}]*?" if o[-1] == "{" else r"[^\n]*?") + rf"{re.escape(c)})" for i, (_, o, c) in enumerate(_NOTATIONS)) + ")")
_PLACE_HINT = re.compile(r"[{<$#@_&«\[(【〔（%]|undefined")
_NAME = re.compile(r"[=#/*-]?\s*(?:echo\s+)?\$?[^\W\d]\w*(?:\.\w+)*(?:\s*\|\s*\w+)*\s*;?")
_PART = re.compile(r"[^\W\d_]+")
_UNDEFINED = re.compile(r"(?<![\w'’“\"‘`])undefined(?![\w'’”\"`])")
_SUBJECT = re.compile(r"\b(?:is|are|was|were|be|been|being|remains?|left|leaves?|becomes?|an?|the|any|some|as|or|and|term|value|called|of)\s+$", re.I)
_GOES_ON = re.compile(r"\s+(?!(?:is|was|has|had|by|in|on|at|of|for|to|from|with|and)\b)[a-z]{3,}")
_ENGLISH = re.compile(r"\b(?:the|of|is|was|by|for|and|when|where|this|that)\b", re.I)
_FIELDS, _ASK, _FORMULA, _ABOUT = (frozenset(x.split()) for x in (X.FIELDS, X.ASK, X.FORMULA, X.ABOUT))


def place_tokens(span: str, notation: str) -> frozenset[str]:
    """Index tokens of a span in the notation of an open place: the notation, the kind of what it holds, and what speaks for a place."""
    _, opening, closing = next(x for x in _NOTATIONS if x[0] == notation)
    inner = span[len(opening) : len(span) - len(closing)].strip()
    parts = [w.casefold() for w in _PART.findall(inner)]
    kind = "word" if _NAME.fullmatch(inner) else "number" if inner.isdigit() and len(inner) < 3 else "words" if len(parts) > 1 or _HAN.search(inner) else "other"
    out = {f"\ue001{notation}", f"\ue002{kind}"}
    if kind == "word" and any(w in _FIELDS for w in parts) and (inner.islower() or inner.isupper() or notation not in ("«", "[")):
        out.add("\ue003field")
    if kind == "words" and parts and parts[-1] in _FIELDS and len(parts) < 4 and inner[:1].isupper():
        out.add("\ue003field")
    if any(w in _ASK for w in parts) or any(a in inner for a in _ASK if a >= "\u3400"):
        out.add("\ue003ask")
    if inner == "object Object":
        out.add("\ue003object")
    return frozenset(out)


def places(text: str) -> list[tuple[int, int, frozenset[str]]]:
    """(start, end, index tokens) of all spans in the notation of an open place."""
    out = []
    for m in _PLACE.finditer(text) if _PLACE_HINT.search(text) else ():
        out.append((m.start(), m.end(), place_tokens(m[0], _NOTATIONS[int(m.lastgroup[1:])][0])))
    return out


@lru_cache(maxsize=1)
def place_exemplars() -> tuple[frozenset[str], ...]:
    return tuple(dict.fromkeys(t for line in X.lines(X.PLACE) for _, _, t in places(line)))


def is_open(tokens_: frozenset[str], weight: dict[str, float], formula: bool) -> bool:
    """Whether a span is an open place: the best exemplar's TF-IDF containment in it, found by notation, is high enough.

    In a line about formulas a notation that means both counts only with the name of a field or a word that asks for something.
    """
    notation = next(t for t in tokens_ if t[0] == "\ue001")
    if notation[1:] in _AMBIGUOUS and formula and not tokens_ & {"\ue003ask", "\ue003field"}:
        return False
    for e in place_exemplars():
        if notation in e:
            whole = sum(weight.get(t, 1.0) for t in e)
            strong = {t for t in e if t[0] == "\ue003"}
            if sum(weight.get(t, 1.0) for t in e & tokens_) >= CONTAINED * whole and strong <= tokens_:
                return True
    return False


def _undefined(text: str) -> Iterator[tuple[int, int]]:
    """Where a programme's "undefined" stands for a value; not where it is said of something."""
    for m in _UNDEFINED.finditer(text):
        start = max(text.rfind("\n", 0, m.start()), text.rfind(". ", 0, m.start()), text.rfind("。", 0, m.start())) + 1
        line = text[start : (text.find("\n", m.end()) + 1 or len(text) + 1) - 1]
        before = text[start : m.start()]
        if _ENGLISH.search(line) and (_SUBJECT.search(before) and not re.search(r"(?:[a-z]{3,}ing|edited by|written by)\s+$", before) or _GOES_ON.match(text, m.end())):
            continue
        yield m.span()


_TAG = re.compile(r"</?(?:h[1-6]|p|div|span|noscript|br|b|i|em|strong|body|html|head|title|center|pre|code)\b[^<>]*>", re.I)
_CUT = re.compile(r"(?<=[.!?…])\s+|(?<=[。？！])|\n")
_TOKEN = re.compile(rf"{SLOT}|[a-z]*\d[a-z\d]*|[^\W\d_]+(?:['’][^\W\d_]+)?|______+")
_HAN = re.compile(r"[㐀-鿿]")
_END = re.compile(r"[.!?。？！:：][)\"”»]*$")


def tokens(window: str) -> list[str]:
    """Index tokens of a window: words in one letter case, pairs of adjacent ideographs, one token for all open places.

    Numbers and codes are left out; they say nothing.
    """
    out = []
    for w in _TOKEN.findall(window.casefold()):
        if _HAN.search(w):
            for part in re.findall(r"[㐀-鿿]+|[^㐀-鿿]+", w):
                if _HAN.match(part):
                    out += [part[i : i + 2] for i in range(len(part) - 1)] or [part]
                else:
                    out.append(part)
        elif not any(c.isdigit() for c in w):
            out.append(w.replace("’", "'"))
    return out


def marked(text: str, weight: dict[str, float]) -> str:
    """The text with its open places replaced by one token."""
    if not _PLACE_HINT.search(text):
        return text
    spans = list(_undefined(text))
    for start, end, found in places(text):
        lo = max(text.rfind(c, 0, start) + len(c) for c in ("\n", "。", ". "))
        hi = min((i for c in ("\n", "。", ". ") if (i := text.find(c, end)) >= 0), default=len(text))
        around = {w.casefold() for w in _PART.findall(text[lo:start] + " " + text[end:hi])}
        if around & _ABOUT or any(w in text[lo:start] or w in text[end:hi] for w in _ABOUT if w >= "\u3400"):
            continue
        formula = bool(around & _FORMULA) or any(w in text[lo:hi] for w in _FORMULA if w >= "\u3400")
        if is_open(found, weight, formula):
            spans.append((start, end))
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            out += [text[at:start], SLOT]
            at = end
    return "".join(out) + text[at:]


def windows(text: str) -> list[str]:
    """Passage windows: lines and sentences, with tags taken out."""
    return [w for w in (x.strip() for x in _CUT.split(_TAG.sub("\n", text))) if w]


_PLAIN = re.compile(r"[A-Z]?[a-z]+(?:,? [a-z]+){4,}[.!?]?")
_ENDINGS, _FREQUENT = frozenset("\ue004" + e for e in X.LATIN_ENDINGS.split()), frozenset(X.FREQUENT)


def endings(window: str) -> list[str]:
    """Index tokens of a window that is nothing but plain words of which none is frequent in a language: their endings."""
    if not _PLAIN.fullmatch(window):
        return []
    words = [w.casefold() for w in _PART.findall(window)]
    return [] if _FREQUENT.intersection(words) else ["\ue004" + w[-2:] for w in words]


def occurring(text: str, wanted: frozenset[str]) -> set[str]:
    """The wanted tokens that occur in a whole text."""
    found = set()
    for w in set(_TOKEN.findall(text.casefold())):
        if w[-1] >= "\u3400" or w[0] >= "\u3400" or not w.isascii() and _HAN.search(w):
            found |= wanted.intersection(tokens(w))
        elif w.replace("’", "'") in wanted:
            found.add(w.replace("’", "'"))
    for _, _, t in places(text):
        found |= wanted & t
    for w in windows(text):
        found |= wanted.intersection(endings(w))
    return found


@dataclass(frozen=True)
class Exemplar:
    label: str
    tokens: frozenset[str]


@dataclass
class Index:
    """Inverted index over the labelled exemplars, with the weight of each token."""

    exemplars: list[Exemplar]
    postings: dict[str, list[int]] = field(default_factory=dict)
    weight: dict[str, float] = field(default_factory=dict)
    other: float = 1.0
    rare: float = 1.0
    anchors: ahocorasick.Automaton | None = None
    #: Weight of each whole exemplar.
    whole: list[float] = field(default_factory=list)

    def reaches(self, low: str) -> bool:
        """Whether a text in one letter case has an anchor as a word of its own, or as a pair of ideographs."""
        for end, t in self.anchors.iter(low):
            if t == SLOT or t[0] >= "㐀":
                return True
            start = end - len(t)
            if not (start >= 0 and low[start].isalpha() or end + 1 < len(low) and low[end + 1].isalpha() and low[end + 1] < "㐀"):
                return True
        return False


@lru_cache(maxsize=1)
def exemplars() -> list[Exemplar]:
    out = [Exemplar("slot", frozenset([SLOT]))]
    for label, text in (("error", X.ERROR), ("script", X.SCRIPT), ("filler", X.FILLER), ("around", X.AROUND), ("mention", X.MENTION)):
        for line in X.lines(text):
            found = frozenset(t for w in windows(marked(line, {})) for t in tokens(w))
            out.append(Exemplar(label, found))
    return out


def vocabulary() -> frozenset[str]:
    return frozenset(t for e in exemplars() for t in e.tokens) | _ENDINGS | frozenset(t for e in place_exemplars() for t in e)


def build_index(documents: int, counts: dict[str, int]) -> Index:
    """`counts`: in how many documents each token occurs."""
    idf = lambda n: math.log((documents + 2) / (n + 1))
    index = Index(exemplars())
    for i, e in enumerate(index.exemplars):
        for t in e.tokens:
            index.postings.setdefault(t, []).append(i)
    index.weight = {t: max(idf(counts.get(t, 0)), 0.1) for t in vocabulary()}
    index.whole = [sum(index.weight[t] for t in e.tokens) for e in index.exemplars]
    known = sorted(index.weight[t] for t in index.postings)
    # a token outside the index weighs what a middling one does
    index.other = known[len(known) // 2] if known else 1.0
    # rare: in fewer documents than the 0.6th power of their number
    index.rare = 0.4 * math.log(documents + 2)
    index.anchors = ahocorasick.Automaton()
    for t in anchor_tokens(index):
        index.anchors.add_word(t, t)
    index.anchors.make_automaton()
    return index


def anchor_tokens(index: Index) -> set[str]:
    """Tokens of which a window needs at least one to be labelled: of each exemplar the heaviest ones, until the rest is too light
    to make up the least containment, and every rare word."""
    out = set()
    for e in index.exemplars:
        rest = sum(index.weight[t] for t in e.tokens)
        least = min(LOOSE, MENTIONED, CONTAINED) * rest
        for t in sorted(e.tokens, key=lambda t: (-index.weight[t], t)):
            if rest < least:
                break
            out.add(t)
            rest -= index.weight[t]
        if e.label in DRAWN:
            out |= {t for t in e.tokens if index.weight[t] >= index.rare}
    return out


def label_window(window: str, index: Index) -> str | None:
    """The kind of residue a window is, 'around', or None."""
    toks = tokens(window)
    if not toks:
        return None
    present = set(toks)
    shared: dict[int, float] = {}
    for t in present:
        for i in index.postings.get(t, ()):
            shared[i] = shared.get(i, 0.0) + index.weight[t]
    if not shared:
        return None
    covering: dict[str, set[str]] = {}
    best: dict[str, float] = {}
    pools: dict[str, set[str]] = {}
    for i, w in shared.items():
        e = index.exemplars[i]
        contained = w / index.whole[i]
        best[e.label] = max(best.get(e.label, 0.0), contained)
        if e.label in DRAWN:
            pools.setdefault(e.label, set()).update(e.tokens & present)
        if contained >= (MENTIONED if e.label == "mention" else CONTAINED):
            covering.setdefault(e.label, set()).update(e.tokens & present)
    # notices vary their parts and filler like lorem ipsum is drawn at random, so no one exemplar need be contained
    for label, pool in pools.items():
        if best[label] >= LOOSE or sum(index.weight[t] >= index.rare for t in pool) >= DRAWN[label]:
            covering.setdefault(label, set()).update(pool)
    if not covering:
        return None
    total = sum(index.weight.get(t, index.other) for t in toks)
    share = {label: sum(index.weight[t] for t in toks if t in got) / total for label, got in covering.items()}
    mention = share.get("mention", 0.0)
    if SLOT in present:
        return None if mention >= 0.5 else "slot"
    kinds = [(s, label) for label, s in share.items() if label != "mention" and s >= COVERED.get(label, 2) and s > mention]
    if not kinds:
        return None
    label = max(kinds)[1]
    return None if label == "filler" and len(toks) < 2 and toks[0] not in ALONE else label


#: Containment of the best exemplar from which the pooled tokens of its kind may cover a window.
LOOSE = 0.4
#: Distinct rare words of a kind from which a window counts as put together from them.
DRAWN = {"error": 2, "script": 2, "filler": 3}
#: Filler that is one word.
ALONE = frozenset(["platzhalter", "placeholder", "blindtext", "platzhaltertext"])


#: Words that a passage of made-up Latin has at least, the share of different ones it has at most, and of its weight in Latin endings.
LATIN_WORDS, LATIN_DIFFERENT, LATIN_COVERED = 12, 0.8, 0.85


def made_up(passage: list[str], index: Index) -> bool:
    """Whether windows that follow each other are filler drawn from a few made-up Latin words: Latin endings cover their weight, and the same
    words come again and again, as frequent words do in a language, which they lack."""
    words = [w.casefold() for x in passage for w in _PART.findall(x)]
    if len(words) < LATIN_WORDS or len(set(words)) > LATIN_DIFFERENT * len(words):
        return False
    found = [t for x in passage for t in endings(x)]
    total = sum(index.weight.get(t, index.other) for t in found)
    return sum(index.weight[t] for t in found if t in _ENDINGS) >= LATIN_COVERED * total


def judge(text: str | None, index: Index) -> str | None:
    """The kind of residue a whole document is kept out for, None if it is usable.

    An open place or a passage of filler counts wherever it is. An error page or a notice has to stand for the content: it is as long
    as the sentences beside it; lines without the end of a sentence, such as titles and menus, count beside it only beyond its own length.
    """
    if text is None:
        return None
    text = marked(text, index.weight)
    parts = windows(text)
    passage: list[str] = []
    filler = False
    for w in parts:
        if endings(w):
            passage.append(w)
        else:
            filler = filler or made_up(passage, index)
            passage = []
    filler = filler or made_up(passage, index)
    if not index.reaches(text.casefold().replace("’", "'")):
        return "filler" if filler else None
    prose = notice = titles = 0
    slot = False
    kinds: dict[str, int] = {}
    for w in parts:
        label = label_window(w, index) if index.reaches(w.casefold().replace("’", "'")) else None
        if label == "slot":
            slot = True
        elif label == "filler":
            filler = True
        elif label in ("error", "script"):
            notice += len(w)
            kinds[label] = kinds.get(label, 0) + len(w)
        elif label is None and _END.search(w):
            prose += len(w)
        elif label is None:
            titles += len(w)
    if slot:
        return "slot"
    if notice and notice >= INSTEAD * (notice + prose + max(0, titles - notice)):
        return max(kinds, key=lambda k: kinds[k])
    return "filler" if filler else None


def count_tokens(df: DataFrame, text: str) -> tuple[int, dict[str, int]]:
    """(documents, documents with each index token), over all documents. The result is as large as the index vocabulary."""
    words = vocabulary()

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, int] = {}
        n = 0
        for pdf in it:
            for t in pdf["_text"]:
                n += 1
                if t is not None:
                    for tok in occurring(t, words):
                        counts[tok] = counts.get(tok, 0) + 1
        yield pd.DataFrame([("", n), *counts.items()], columns=["token", "n"])

    rows = (
        df.select(F.col(text).cast("string").alias("_text"))
        .mapInPandas(batches, "token string, n bigint")
        .groupBy("token")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    counts = {r["token"]: r["n"] for r in rows}
    return counts.pop("", 0), counts


def _kind(df: DataFrame, text: str) -> Column:
    """The kind of residue of a text column, from counts over all its rows. The index is built once a task."""
    documents, counts = count_tokens(df, text)

    @F.pandas_udf("string")
    def kinds(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = build_index(documents, counts)
        for texts in batches:
            yield pd.Series([judge(t, index) for t in texts], dtype=object)

    return kinds(F.col(text).cast("string"))


def judged(df: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row_id, kind): what each document is kept out for, null if it is usable.

    Null and blank texts are usable as far as this operator goes; repeated rows count each; an empty table gives an empty one.
    """
    return df.select(F.col(row_id).alias("row_id"), _kind(df, text).alias("kind"))


def usable(df: DataFrame, text: str = "text") -> DataFrame:
    """The documents that are not residue, with all their columns."""
    return df.where(_kind(df, text).isNull())
