"""Problem 1: personal information inside free text.

Patterns that err to yes propose the places that may hold a name, an e-mail address, a
number or an address. They are the nodes of a skip-chain conditional random field:
each node has hashed features of its form and surroundings, neighbours in the text
are linked, and so are distant nodes that share a rare token. Loopy message passing
makes the labels of a document agree. Unary weights are learnt by a softmax, edge
potentials from label counts (piecewise training), both on a bounded sample of
documents whose nodes weak rules label where they can.

Defined results: null and empty texts have no spans; repeated rows are judged alike;
spans count code points and never overlap; without weakly labelled nodes only e-mail
and address patterns count.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.unify import CYRILLIC_ALIKE, CYRILLIC_LATIN, GREEK_ALIKE, GREEK_LATIN

SAMPLE = 800  # documents that train, those of the smallest key hashes; all documents are judged
BITS = 17
EPOCHS, RATE, L2 = 4, 0.4, 1e-5
ROUNDS = 4  # of message passing
COMMON_SHARE = 0.02  # share of sampled documents above which a last word rarely seen in a name counts as a weak sign of none

LABELS = ("other", "name", "email", "phone", "identity_number", "address")
KIND_LABELS = {"name": (0, 1), "email": (0, 2), "number": (0, 3, 4), "address": (0, 5)}  # two or three states
PLACEHOLDERS = {k: f"[{k.upper()}]" for k in LABELS[1:]}

# What the patterns know about addresses, titles and labels in eight languages.
U = r"[A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĖĘĚĞĢĪĮİĶŁĻŃŅŇŌŐŘŚŞŠŤŪŮŰŲŹŻŽА-ЯЁ]"
WORD = rf"{U}[\w'’]+(?:-{U}?[\w'’]+)*"
STREET_EN = r"(?:Lane|Close|Avenue|Ave\.?|Court|Row|Blvd\.?|Boulevard|Road|Rd\.?|Street|St\.|Drive|Way|Square|Terrace|Crescent|Gardens|Hill|Park|Place|Mews|Grove)"
TOWN = rf"{WORD}(?: {U}[\w'’-]+)?"
UK_CODE = r"[A-Z]{1,2}\d[\dA-Z]? ?\d[A-Z]{2}\b"
GAP = r"(?:,[ \t]*\r?\n?|\r?\n|[ \t]+[–-][ \t]+)[ \t]*"
STREET = "|".join((
    rf"(?:(?:Flat|Apt\.?|Unit|Suite) \d+[A-Za-z]?{GAP})?(?:{WORD} House{GAP})?\d{{1,5}}[A-Za-z]? (?:{U}[\w'’.-]+ ){{1,3}}{STREET_EN}(?!\w)(?:{GAP}(?:Flat|Apt\.?|Unit|Suite) \d+[A-Za-z]?)?",
    r"(?:P\. ?O\. ?|PO )?(?:Box|Postfach|Apartado|Boîte postale|BP|Postbus|Casella postale) \d+",
    r"\d{1,5}(?: bis| ter| quater)?,? (?:rue|avenue|boulevard|place|allée|chemin|impasse|quai|cours)(?: (?:des|de la|de|du|la|le|les))?(?: (?:d|l)['’])? ?[\w'’-]+",
    r"(?:Calle|Rua|Via|Avenida|Av\.|Plaza|Praça|Viale|Piazza|Corso|Travessa|Paseo|C/) ?(?:(?:de|da|do|del|della|dos|das|la|el) )*[\w'’-]+,? \d{1,5}[A-Za-z]?(?:, \d{1,3}[ºª°]? ?[A-Z]?\b)?",
    rf"{U}[\w'’-]*(?:weg|straße|strasse|str\.|allee|gasse|platz|ring|ufer|laan|straat|gracht|plein|kade) \d{{1,5}} ?[a-z]?\b",
    rf"(?:Am|Im|An der|An den|Auf der|Zum|Zur) {WORD} \d{{1,5}} ?[a-z]?\b",
    r"(?:ул\.|улица|пр\.|проспект|пер\.) ?[\w'’-]+, ?(?:д\.|дом) ?\d+[а-я]?(?:, ?(?:кв\.|квартира) ?\d+)?",
))
TAIL = rf"(?:(?:[A-Z]{{1,2}}-)?\d{{4,6}}(?:,? {TOWN}|\b)|{TOWN}(?:{GAP}| ){UK_CODE}|{TOWN}(?:,? )(?:[A-Z]-)?\d{{4,6}}\b|(?:г\. ?)?{TOWN}(?:, ?\d{{5,6}})?)"
ADDRESS = re.compile(rf"(?<![\w.])(?:{STREET}){GAP}{TAIL}")
EMAIL = re.compile(
    r"(?<![\w.+-])[A-Za-z0-9](?:[\w.+-]|\s?[\[(]dot[\])]\s?)*(?: ?@ ?|\s?[\[(]at[\])]\s?|\s?[\[{]@[\]}]\s?)[\w-]+(?:(?:\.|\s?[\[(]dot[\])]\s?)[\w-]+)+|(?<![\w.+-])[A-Za-z0-9][\w.+-]*(?: dot [\w+-]+)* at [\w-]+(?: dot [\w-]+)+", re.I
)
# Patterns that start with a set of letters are searched by that set, several times as fast as behind an assertion; what may not stand before is asked after the first letter.
NUMBER = re.compile(
    r"[A-Z+(\d](?<![\w.,@+/-].)(?:(?<=[A-Z])(?:[A-Z] \d\d ?\d\d ?\d\d ?[A-Z]\b|[A-Z]{0,5}-?\d[\d-]{3,}[A-Z]?\b)|(?:(?<=\+)\(?\d|(?<=\()\d|(?<=\d))[\d().\-/ ]{3,}\d(?:-?[A-Z]\b)?)(?: ?(?:x|ext\.? ?|#)\d{1,5}\b)?"
)
_LETTERS = rf"[\w'’]++(?:-{U}?[\w'’]++)*+"  # of a word behind its first; none are given back, as no name goes on with them
_REST = rf"(?:{_LETTERS}|\.)"
NAME = re.compile(rf"{U}(?<![\w'’.&-].)(?:{_REST}(?: (?:(?:de|da|van|von|der|den|del|di|la|le|ten|ter|dos|zu) )*{U}{_REST})*? {U}{_REST} {U}{_LETTERS}|{_REST} {U}{_LETTERS})(?![\w'’])")
NAME_TURNED = re.compile(rf"[ \t]*{U}{_LETTERS}, {U}{_REST}(?: {U}{_REST})?(?=[ \t]*\r?$|,)", re.M)
TITLE = re.compile(r"(?:(?:Mr|Ms|Mrs|Miss|Mx|Dr|Prof|Frau|Herr|Mme|Mlle|M|Sr|Sra|Srta|Dott|Sig|Ing|Dipl|Name|Nom|Contact|Curriculum)\.? )+")
ODD = re.compile(r"[^\x00-\x9f\xa1-\xac\xae-\u024f\u0400-\u045f\u2012-\u2023\u2026\u2116\u2122\u2600-\u26ff]")
OTHER = re.compile(r"[\u0370-\u04ff]")
MIXED = re.compile(r"(?<!\w)(?=\w*[a-zA-Zà-ÿ])(?=\w*[\u0370-\u04ff])\w+")
ALIKE = str.maketrans(CYRILLIC_ALIKE + GREEK_ALIKE, CYRILLIC_LATIN + GREEK_LATIN)
SIGN = re.compile("@")
BREAK = re.compile("\n")
DIGIT = re.compile(r"\d")
AT = re.compile(r"@|[\[({](?:at|@)[\])}]| at (?=[\w-]+ dot )", re.I)
STREETS = re.compile(
    rf"\b(?=[A-Zp])(?:{STREET_EN}(?!\w)|(?:Box|Postfach|Apartado|postale|Postbus) \d|(?:Calle|Rua|Via|Avenida|Plaza|Praça|Viale|Piazza|Corso|Travessa|Paseo)\b|Av\.|(?:Am|Im|An der|An den|Auf der|Zum|Zur) (?=\w+ \d))|"
    r"(?:\d| bis| ter| quater),? (?:rue|avenue|boulevard|place|allée|chemin|impasse|quai|cours)\b|C/|\w(?:weg|str(?:aße|asse|\.|aat)|allee|g(?:asse|racht)|pl(?:atz|ein)|ring|ufer|laan|kade) \d|(?:ул\.|улица|пр\.|проспект|пер\.)"
)
HOUSE = re.compile(rf"\d(?:[A-Za-z]?(?: bis| ter| quater)?,? (?:{U}|rue |avenue |boulevard |place |allée |chemin |impasse |quai |cours )|(?<=[.,]\d)\d{{0,4}},|(?<=[.,] \d)\d{{0,4}},|(?<=/\d)|(?<=/ \d))")
HOUSE_BEHIND = re.compile(r" (?<=[^\W\d_] )\d{1,5} ?[a-z]?(?=,|\r?$| [–-])")
INVISIBLE = re.compile(r"[­͏᠎​-‏⁠-⁤︀-️﻿]")
PHONE_BEFORE = re.compile(r"(?:tel|telefon|téléphone|teléfono|telefone|telefoon|telefono|тел|phone|mobile|mobil|mob|cell|fax|☎|✆|📞)[.:]?\s*$", re.I)
NUMBER_BEFORE = re.compile(r"(?:\b(?:id|ssn|nino|passport|ni no|nif|cpf|bsn|national id|tax id|steuer-?id|licence holder|license holder|carry the number|nr|no|nº|n°)|№)[.:]?\s*$", re.I)
NONE_BEFORE = re.compile(r"(?:order|batch|ticket|form|norm|worth|invoice|version|ref\.?|applicant|candidate|room|page|step|serial|item|from|to)\s*$", re.I)
DATE = re.compile(r"^(?:\d{1,2}[./-]\d{1,2}[./-]\d{2,4}|\d{4}[./-]\d{1,2}[./-]\d{1,2}|(?:19|20)\d\d ?[-/] ?(?:19|20)\d\d|\d{1,3} ?\d{3})$")
NAME_BEFORE = re.compile(r"(?:curriculum vitae –|name:|took over from|reported to|shared a desk with|\bcall|answered by|^|\bmr\.?|\bms\.?|\bdr\.?)\s*$", re.I)
NAME_AFTER = re.compile(r"^(?:\s*\(?[\w.+-]+ ?(?:@|\[at\]|\(at\))|,? (?:head of|has agreed|and covered|, my partner|when\b)|, my )", re.I)


def straight(text: str) -> tuple[str, np.ndarray | None]:
    """The text in ordinary characters, and where each of its characters was (None: in place)."""
    if OTHER.search(text):
        text = MIXED.sub(lambda m: m[0].translate(ALIKE), text)
    if not ODD.search(text):
        return text, None
    out: list[str] = []
    at: list[int] = []
    odd, pos = False, 0
    for m in ODD.finditer(text):
        i, c = m.start(), m[0]
        out.extend(text[pos:i])
        at.extend(range(pos, i))
        pos = i + 1
        if INVISIBLE.match(c):
            odd = True
            continue
        if unicodedata.combining(c) and out:
            whole = unicodedata.normalize("NFC", out[-1] + c)
            if len(whole) == 1:
                out[-1] = whole
                odd = True
                continue
        new = " " if unicodedata.category(c) == "Zs" else "-" if c in "‐‑" else unicodedata.normalize("NFKC", c) or c
        out.extend(new)
        at.extend([i] * len(new))
        odd = odd or new != c
    if not odd:
        return text, None
    out.extend(text[pos:])
    at.extend(range(pos, len(text) + 1))
    return "".join(out), np.array(at)


def _names(s: str, starts: list[int]) -> Iterator[tuple[int, int]]:
    """Where names stand; surnames before a comma only at the start of a line, unless another form starts there."""
    pos = 0
    for a in starts:
        turned = NAME_TURNED.match(s, a)
        if turned and not NAME.match(s, a):
            for m in NAME.finditer(s, pos, a):
                yield m.span()
            yield turned.span()
            pos = turned.end()
    for m in NAME.finditer(s, pos):
        yield m.span()


class Node:
    """A place that may hold something; kind decides its states."""

    __slots__ = ("kind", "start", "end", "text", "line", "features", "tokens", "weak")


def nodes(text: str, weak: bool = False) -> tuple[list[Node], np.ndarray | None]:
    """The nodes of a text in order, spans in its straight form, and the map to the original; weak: with weak labels."""
    s, at = straight(text)
    taken: list[tuple[int, int]] = []
    found: list[Node] = []

    def free(a: int, b: int) -> bool:
        for x, y in taken:
            if x < b and a < y:
                return False
        return True

    def add(kind: str, a: int, b: int) -> None:
        n = Node()
        n.kind, n.start, n.end, n.text, n.weak = kind, a, b, s[a:b], -1
        found.append(n)

    starts = [0]
    for m in BREAK.finditer(s):
        starts.append(m.end())
    border = lambda k: starts[k] if k < len(starts) else len(s)
    end = k = 0
    low = s.lower()
    spelled = "[at" in low or "(at" in low or "{at" in low or " dot " in low
    for m in (AT if spelled else SIGN).finditer(s):
        while border(k + 1) <= m.start():
            k += 1
        if m.start() >= end:
            # an address may break its line once on either side of the sign
            for e in EMAIL.finditer(s, max(end, starts[max(0, k - 1)]), border(k + 2)):
                if e.end() > m.start():
                    if e.start() <= m.start():
                        a, b = e.span()
                        while s[b - 1] in "-_.":
                            b -= 1
                        taken.append((a, b))
                        add("email", a, b)
                        end = b
                    break
    end = 0
    for k, (line_start, line_end) in enumerate(zip(starts, starts[1:] + [len(s)])):
        line = s[line_start:line_end]
        if DIGIT.search(line) and (HOUSE.search(line) or HOUSE_BEHIND.search(line)):
            for m in STREETS.finditer(line):
                at_street = line_start + m.start()
                if at_street >= end:
                    # up to two breaks before the street (flat, house) and four behind it (flat, town, postcode)
                    for e in ADDRESS.finditer(s, max(end, starts[max(0, k - 2)]), border(k + 5)):
                        if e.end() > at_street or e.start() > at_street:
                            if e.start() <= at_street and free(*e.span()):
                                taken.append(e.span())
                                add("address", *e.span())
                                end = e.end()
                            break
    for m in NUMBER.finditer(s):
        a, b = m.span()
        t = m[0]
        if t.count("(") != t.count(")"):
            if t.startswith("(") and ")" not in t:
                a += 1
            elif t.endswith(")"):
                b -= 1
        if free(a, b):
            taken.append((a, b))
            add("number", a, b)
    for a, b in _names(s, starts):
        while s[a] in " \t":
            a += 1
        if (t := TITLE.match(s, a)) and t.end() < b:
            a = t.end()
        if " " in s[a:b] and free(a, b):
            add("name", a, b)
    found.sort(key=lambda n: n.start)
    k = 0
    for n in found:
        while k + 1 < len(starts) and starts[k + 1] <= n.start:
            k += 1
        n.line = k
        _describe(n, s, starts[k], starts[k + 1] - 1 if k + 1 < len(starts) else len(s), weak)
    return found, at


_hashes: dict[str, int] = {}


def _hash(x: str) -> int:
    h = _hashes.get(x)
    if h is None:
        if len(_hashes) > 400_000:
            _hashes.clear()
        h = _hashes[x] = xxhash.xxh32_intdigest(x) & ((1 << BITS) - 1)
    return h


_MASK = str.maketrans("0123456789", "9999999999")


_forms: dict[tuple[str, str], tuple[tuple[str, ...], tuple[int, ...]]] = {}


def _form(kind: str, text: str) -> tuple[tuple[str, ...], tuple[int, ...]]:
    """(tokens, features) of a node's own text; remembered."""
    known = _forms.get((kind, text))
    if known is not None:
        return known
    out: list[str] = []
    if kind == "name":
        parts = text.replace(",", " ,").split()
        tokens = [w.lower() for w in parts if len(w) > 2]
        for w in tokens:
            out += [f"w{w}", f"x{w[-4:]}", f"y{w[-3:]}", f"v{w[:4]}"]
        if tokens:
            out += [f"F{tokens[0]}", f"L{tokens[-1]}", f"Lx{tokens[-1][-4:]}", f"Ly{tokens[-1][-3:]}"]
        out.append(f"s{len(parts)}{'.' in text}{',' in text}{text.isupper()}{'-' in text}")
    elif kind == "number":
        mask = text.translate(_MASK)
        tokens = [re.sub(r"\W", "", text)]
        out += [f"m{mask}", f"M{re.sub(r'9+', '9', mask)}", f"d{len(tokens[0])}", f"a{mask[:2]}", f"A{text[:3]}", f"e{mask[-2:]}", f"g{len(re.findall(r'9+', mask))}"]
    else:
        tokens = [text.lower()]
    if len(_forms) > 200_000:
        _forms.clear()
    known = _forms[kind, text] = tuple(tokens), tuple([_hash(x) for x in out])
    return known


_arounds: dict[tuple, tuple[int, ...]] = {}


def _around(k: str, p1: str | None, p2: str | None, q: str | None, beside: str, line: int) -> tuple[int, ...]:
    """Features of a node's surroundings; remembered. p1, p2 and q are the words before and after, line is at most 9."""
    key = k, p1, p2, q, beside, line
    known = _arounds.get(key)
    if known is None:
        p1, p2, q = (x and x.translate(_MASK) for x in (p1, p2, q))
        out = (
            k, f"{k}p{p1 or '^'}", f"{k}P^" if p2 is None else f"{k}P{p2} {p1}", f"{k}q$" if q is None else f"{k}q{q}", f"{k}c{beside}",
            f"{k}l{line == 0}{line < 9}{p1 is None}{q is None}", f"{k}h{line < 9}",
        )
        if len(_arounds) > 200_000:
            _arounds.clear()
        known = _arounds[key] = tuple([_hash(x) for x in out])
    return known


def _describe(n: Node, s: str, line_start: int, line_end: int, weak: bool) -> None:
    before, after = s[max(line_start, n.start - 32) : n.start], s[n.end : min(line_end, n.end + 20)]
    pre, post = before.lower().rsplit(None, 2), after.lower().split(None, 1)
    around = _around("#" if n.kind == "number" else n.kind[0], pre[-1] if pre else None, pre[-2] if len(pre) > 1 else None, post[0] if post else None, after[:1] + before[-1:], min(n.line, 9))
    n.tokens, own = _form(n.kind, n.text)
    n.features = around + own
    shouted = n.kind == "name" and n.text.isupper() and s[line_start:line_end].isupper() and s.count(" ", line_start, line_end) > 6
    if shouted:  # capitals tell no name in a shouted sentence: a feature that learns it, not a veto
        n.features += (_hash("Z"),)
    if weak:
        n.weak = _weak_name(n, before, s[n.end : min(line_end, n.end + 80)]) if n.kind == "name" else _weak_number(n, before) if n.kind == "number" else {"email": 2, "address": 5}[n.kind]
        if shouted and n.weak < 0:
            n.weak = 0


def _weak_name(n: Node, before: str, after: str) -> int:
    if NAME_BEFORE.search(before) and (n.line == 0 or before.strip()) and not re.match(r"\s*\d", after) and (n.line or not after.strip()):
        return 1
    if not before.strip() and re.match(r"^, [^,\n@]{3,40}, (?:[\w.+-]+ ?(?:@|\[|\()|[+(]?\d[\d ().\-/]{7,})", after):
        return 1
    return 1 if NAME_AFTER.match(after) and not re.match(r"\s*@ ?\w+ ", after) else -1


def _weak_number(n: Node, before: str) -> int:
    if DATE.match(n.text) or NONE_BEFORE.search(before):
        return 0
    return 3 if PHONE_BEFORE.search(before) or n.text.startswith("+") else 4 if NUMBER_BEFORE.search(before) else -1


class Model:
    """Unary weights of each label, chain potentials by kinds and line, skip potentials by kind."""

    def __init__(self):
        self.weights = np.zeros((1 << BITS, len(LABELS)), dtype=np.float32)
        self.chain: dict[tuple, np.ndarray] = {}
        self.skip: dict[str, np.ndarray] = {}


def fit(texts: list[str]) -> Model:
    """Piecewise training on the nodes that weak rules label."""
    model = Model()
    docs = [nodes(t, True)[0] for t in texts]
    last, named, phrases = Counter(), set(), Counter()
    for found in docs:
        last.update({n.tokens[-1] for n in found if n.kind == "name" and n.tokens})
        phrases.update({n.text for n in found if n.kind == "name"})
        named |= {n.tokens[-1] for n in found if n.kind == "name" and n.weak == 1 and n.tokens}
    often = max(3, COMMON_SHARE * len(docs))
    votes: dict[str, Counter] = defaultdict(Counter)
    for found in docs:
        for n in found:
            if n.kind == "name" and n.tokens:
                votes[n.tokens[-1]][n.weak == 1] += 1
    for found in docs:
        for n in found:
            if n.kind == "name" and n.tokens:
                share = votes[n.tokens[-1]][True] / sum(votes[n.tokens[-1]].values())
                if n.weak == 1 and last[n.tokens[-1]] > often and share < 0.05:
                    n.weak = 0
                elif n.weak == -1 and (last[n.tokens[-1]] > often and share < 0.05 or phrases[n.text] > often / 4 and share < 0.2):
                    n.weak = 0
    rows = [n for found in docs for n in found if n.weak >= 0]
    seen = np.full((1 << BITS, len(LABELS)), 1e-6)
    w = np.zeros((1 << BITS, len(LABELS)))
    for _ in range(EPOCHS if rows else 0):
        for i in np.random.default_rng(11).permutation(len(rows)):
            n = rows[i]
            states = list(KIND_LABELS[n.kind])
            at = np.array(n.features)[:, None]
            z = w[at, states].sum(axis=0) / np.sqrt(len(n.features))
            p = np.exp(z - z.max())
            p /= p.sum()
            p[states.index(n.weak)] -= 1
            g = p / np.sqrt(len(n.features)) + L2 * w[at, states]
            seen[at, states] += g * g
            w[at, states] -= RATE * g / np.sqrt(seen[at, states])
    model.weights = w.astype(np.float32)
    beside: dict[tuple, np.ndarray] = defaultdict(lambda: np.ones((3, 3)))
    skip: dict[str, np.ndarray] = defaultdict(lambda: np.ones((3, 3)))
    for found in docs:
        for a, b in zip(found, found[1:]):
            if a.weak >= 0 and b.weak >= 0:
                beside[a.kind, b.kind, b.line - a.line if b.line - a.line < 2 else 2][KIND_LABELS[a.kind].index(a.weak), KIND_LABELS[b.kind].index(b.weak)] += 1
        for i, j in _skips(found):
            if found[i].weak >= 0 and found[j].weak >= 0:
                skip[found[i].kind][KIND_LABELS[found[i].kind].index(found[i].weak), KIND_LABELS[found[j].kind].index(found[j].weak)] += 1
    model.chain = {k: _potential(c) for k, c in beside.items()}
    model.skip = {k: _potential(c) for k, c in skip.items()}
    return model


def _potential(counts: np.ndarray) -> np.ndarray:
    """Pointwise mutual information of two labels, kept within one unit so that no edge overrules a clear node."""
    p = counts / counts.sum()
    return np.clip(np.log(p / (p.sum(axis=1, keepdims=True) * p.sum(axis=0, keepdims=True))), -1, 1).astype(np.float32)


def _skips(found: list[Node]) -> list[tuple[int, int]]:
    """Distant nodes of one kind that share a token, each linked to the one before it."""
    out, last = [], {}
    for i, n in enumerate(found):
        if n.kind in ("name", "number"):
            near = set()
            for t in n.tokens:
                j = last.get((n.kind, t))
                if j is not None and j not in near:
                    near.add(j)
                    out.append((j, i))
                last[n.kind, t] = i
    return out


def label(model: Model, docs: list[list[Node]]) -> list[np.ndarray]:
    """(states' probabilities of every node) by loopy message passing over all documents at once."""
    flat = [n for found in docs for n in found]
    if not flat:
        return [np.zeros((0, 3)) for _ in docs]
    sizes = np.array([len(n.features) for n in flat])
    every = np.fromiter(chain.from_iterable(n.features for n in flat), dtype=np.int64, count=int(sizes.sum()))
    sums = np.add.reduceat(model.weights[every], np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0) / np.sqrt(sizes)[:, None]
    states = np.array([(*KIND_LABELS[n.kind], -1)[:3] for n in flat])
    unary = np.where(states >= 0, np.take_along_axis(sums, np.maximum(states, 0), 1), -30).astype(np.float32)
    left, right, tables = [], [], []  # of edges that have a potential; others say nothing
    base = 0
    number = {k: i for i, k in enumerate((*model.chain, *model.skip))}
    for found in docs:
        for i, (a, b) in enumerate(zip(found, found[1:]), base):
            apart = b.line - a.line
            t = number.get((a.kind, b.kind, apart if apart < 2 else 2))
            if t is not None:
                left.append(i)
                right.append(i + 1)
                tables.append(t)
        for i, j in _skips(found):
            t = number.get(found[i].kind)
            if t is not None:
                left.append(base + i)
                right.append(base + j)
                tables.append(t)
        base += len(found)
    belief = unary
    if left:
        a, b, t = np.array(left), np.array(right), np.stack([*model.chain.values(), *model.skip.values()])[tables]
        to_b, to_a = np.zeros((len(a), 3), dtype=np.float32), np.zeros((len(a), 3), dtype=np.float32)
        for _ in range(ROUNDS):
            new_b = _log_sum((belief[a] - to_a)[:, :, None] + t, 1)
            new_a = _log_sum((belief[b] - to_b)[:, None, :] + t, 2)
            to_b, to_a = 0.5 * to_b + 0.5 * new_b, 0.5 * to_a + 0.5 * new_a
            belief = unary.copy()
            np.add.at(belief, b, to_b)
            np.add.at(belief, a, to_a)
    p = np.exp(belief - belief.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    return np.split(p, np.cumsum([len(found) for found in docs])[:-1])


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    out = np.log(np.exp(x - m).sum(axis=axis)) + m.squeeze(axis)
    return out - out.max(axis=1, keepdims=True)


def spans(model: Model, texts: list[str | None]) -> list[list[tuple[str, int, int, float]]]:
    """(type, start, end, confidence) of each text, in order, in its own code points."""
    parsed = [nodes(t or "") for t in texts]
    out = []
    for (found, at), p in zip(parsed, label(model, [f for f, _ in parsed])):
        rows, end = [], -1
        for n, q in zip(found, p):
            k = int(q.argmax())
            if k and n.start >= end:
                a, b = (n.start, n.end) if at is None else (int(at[n.start]), int(at[n.end - 1]) + 1)
                rows.append((LABELS[KIND_LABELS[n.kind][k]], a, b, float(q[k])))
                end = n.end
        out.append(rows)
    return out


def trained(df: DataFrame, key: str, text: str) -> Model:
    """A model from the bounded sample."""
    rows = df.select(F.xxhash64(key).alias("h"), F.col(text).alias("text")).where(F.length("text") > 0)
    # the hashes first, so that tasks send the driver only numbers and then only the sample's texts
    last = rows.select("h").orderBy("h").limit(SAMPLE).agg(F.max("h")).first()[0]
    rows = rows.where(F.col("h") <= last).collect() if last is not None else []
    return fit(list(dict.fromkeys(r.text for r in sorted(rows, key=lambda r: (r.h, r.text)))))


def found_spans(df: DataFrame, key: str, text: str, model: Model | None = None) -> DataFrame:
    """(key, pii_type, span_start, span_end, confidence) of every occurrence."""
    shared = df.sparkSession.sparkContext.broadcast(model or trained(df, key, text))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for start in range(0, len(rows), 256):
                part = rows.iloc[start : start + 256]
                for k, found in zip(part.key, spans(shared.value, list(part.text))):
                    out += [(k, *f) for f in found]
            yield pd.DataFrame(out, columns=["key", "pii_type", "span_start", "span_end", "confidence"])

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    return rows.mapInPandas(run, f"key {dict(rows.dtypes)['key']}, pii_type string, span_start int, span_end int, confidence double").withColumnRenamed("key", key)


def masked(df: DataFrame, key: str, text: str, model: Model | None = None) -> DataFrame:
    """df with each occurrence in the text column replaced by the placeholder of its type."""
    shared = df.sparkSession.sparkContext.broadcast(model or trained(df, key, text))

    @F.pandas_udf("string")
    def replaced(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for t, found in zip(texts, spans(shared.value, list(texts))):
                for kind, a, b, _ in reversed(found):
                    t = t[:a] + PLACEHOLDERS[kind] + t[b:]
                out.append(t)
            yield pd.Series(out)

    return df.withColumn(text, replaced(F.col(text)))
