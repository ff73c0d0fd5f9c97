"""Subject, predicate and object of Korean sentences by case particles, over given tokens.

One sentence is a left-to-right walk with a small state (roles, noun phrase under construction, clause memory), so it
runs in Python on Arrow batches; everything around it (splitting, exploding, dedup) is columns.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from termgraph import vocab
from termgraph.operators.hierarchy import Token

OF = "의"
SENTENCE = re.compile(r"(?<=다\.)\s*|(?<=[\n!.?。])\s+")
_MARK = re.compile(r"^(\s*(?:[가-힣]|\d+(?:의\d+)?))\.(?=\s)", re.M)
_TAG = re.compile(r"<[^><]{,100}>")
ITEM = re.compile(r"\s*(?:[가-힣]|\d+(?:의\d+)?)\)\s")
FORBIDS = re.compile(r"아니\s?된다|못한다|수\s?없다")
_OPEN, _CLOSE = "(（", ")）"
_QUOTES = "「」『』“”"
_NAME = re.compile("[가-힣][가-힣]+")
_NAME_DIGITS = re.compile("[가-힣][0-9가-힣]+")
NO = " 금지"


def prepared(text: str) -> str:
    """Without tags; ``1.`` and ``가.`` at a line's start as ``1)`` and ``가)``."""
    return _MARK.sub(r"\1)", _TAG.sub(" ", text))


def sentences(text: str) -> list[str]:
    return [s for s in SENTENCE.split(prepared(text)) if s.strip()]


def nominal(stem: str) -> str:
    """Noun form of a verb stem."""
    if stem and "가" <= stem[-1] <= "힣" and not (ord(stem[-1]) - 0xAC00) % 28:
        return stem[:-1] + chr(ord(stem[-1]) + 16)
    return stem and stem + "음"


def phrase(parts: list[str], max_len: int = 30) -> str:
    """The noun phrase of its parts, or an empty string where it can't be an argument."""
    parts = list(parts)
    while parts and parts[-1] == OF:
        parts.pop()
    if len(parts) > 2 and parts[-2] == OF and parts[-1] in vocab.STOP_KO:
        del parts[-2:]
    words = "".join(parts).strip().split(" ")
    if len(words) > 1:
        while len(words) > 1 and words[0] in vocab.STOP_KO:
            words.pop(0)
        words = [w for i, w in enumerate(words) if not i or w != words[i - 1]]
    out = " ".join(words)
    core = out.replace(" ", "")
    fits = len(core) > 1 and len(out) <= max_len and core not in vocab.STOP_KO and (_NAME.fullmatch(core) or _NAME_DIGITS.fullmatch(core))
    return out if fits else ""


@dataclass
class Reading:
    triples: list[tuple[str, str, str, bool]]
    topic: str
    pending: str
    last: str


@dataclass
class Walk:
    """State of one sentence; a subject is (name, was it carried or used already)."""

    tokens: list[Token]
    item: bool
    forbidden: bool
    spaced: bool
    subject: str = ""
    used: bool = False
    topic: str = ""
    object: str = ""
    place: str = ""
    agent: bool = False
    buffer: list[str] = field(default_factory=list)
    end: int | None = None
    linked: bool = False
    role: str = ""
    outer: tuple[str, bool] = ("", True)
    anchor: str = ""
    pending: str = ""
    triples: list[tuple[str, str, str, bool]] = field(default_factory=list)

    def at(self, i: int) -> Token:
        return self.tokens[i] if 0 <= i < len(self.tokens) else Token(("", "", 0, 0))

    # look-ahead tests

    def negated(self, i: int) -> bool:
        """A prohibition follows within nine tokens; ``may not`` as permission, or before a noun, isn't one."""
        was, found = "", False
        for t in self.tokens[i + 1 : i + 10]:
            if (
                t.form in vocab.NOT
                or (t.tag, t.form) == ("VX", "못하")
                or (t.tag, t.form, was) == ("VX", "말", "지")
                or (t.tag, t.form) == ("MAG", "아니")
                or ((t.tag, t.form) == ("VA", "없") and was == "수")
            ):
                found = True
            elif found and (t.tag == "ETM" or (t.form == "있" and was == "수")):
                return False
            elif t.tag == "SF":
                break
            was = t.form
        return found

    def modifies(self, i: int) -> bool:
        """The predicate at i modifies a noun; before ``수``, or before ``행위`` in a list item, it is the main one."""
        j = i + 1
        while self.at(j).tag == "EP":
            j += 1
        if self.at(j).tag != "ETM":
            return False
        head = self.at(j + 1)
        return not ((head.tag, head.form) == ("NNB", "수") or (self.item and (head.tag, head.form) == ("NNG", "행위")))

    def emit(self, predicate: str, i: int) -> None:
        """A triple if the clause is complete, else the predicate waits for the items of a list."""
        o = self.object or self.place
        if self.subject and o and predicate and self.subject != o:
            self.triples.append((self.subject, predicate + (NO if self.forbidden or self.negated(i) else ""), o, self.used))
            self.used, self.object, self.place = True, "", ""
        else:
            self.pending = predicate + (NO if self.negated(i) else "")

    # noun phrases: True where the token was taken and the phrase goes on

    def gap_before(self, t: Token) -> bool:
        return bool(self.buffer) and self.end is not None and t.start > self.end and not self.linked

    def noun(self, t: Token) -> None:
        if self.gap_before(t):
            if self.spaced and t.start == self.end + 1 and OF not in self.buffer:
                self.buffer.append(" ")
            else:
                self.buffer = []
        self.linked, self.end = False, t.end
        self.buffer.append(t.form)

    def genitive(self, t: Token) -> None:
        if OF in self.buffer:
            self.buffer = self.buffer[self.buffer.index(OF) + 1 :]
        if " " in self.buffer:
            self.buffer = self.buffer[len(self.buffer) - self.buffer[::-1].index(" ") :]
        self.buffer.append(OF)
        self.linked, self.end = True, t.end

    def prefix(self, i: int) -> int:
        """Prefixes and numbers from i: part of a noun that follows at once, else passed over."""
        j = i
        while self.at(j).tag in vocab.PREFIX_TAGS:
            j += 1
        stop = self.at(j - 1).end
        if self.at(j).tag in ("NNG", "NNP") and self.at(j).start == stop:
            if self.gap_before(self.at(i)):
                self.buffer = []
            self.linked = False
            self.buffer += [t.form for t in self.tokens[i:j]]
        self.end = stop
        return j

    def parenthesis(self, i: int) -> int:
        depth, j = 1, i + 1
        while j < len(self.tokens) and depth:
            depth += (self.tokens[j].form in _OPEN) - (self.tokens[j].form in _CLOSE)
            j += 1
        self.end = self.at(j - 1).end
        return j

    # roles

    def on_subject(self, t: Token, i: int) -> None:
        topical = t.tag == "JX"
        after_place = self.role == "dat" and bool(self.place)
        if topical and not self.buffer and not self.subject and not after_place and self.anchor:
            self.subject, self.used, self.topic, self.anchor = self.anchor, False, self.anchor, ""
        elif topical and not self.buffer and not self.subject and after_place:
            self.subject, self.used, self.topic, self.place = self.place, False, self.place, ""
        else:
            nxt = self.at(i + 1)
            exists = not topical and nxt.form in vocab.EXISTS and nxt.tag in vocab.EXISTS_TAGS
            name = phrase(self.buffer)
            if name and not exists:
                if not topical:
                    self.outer = (self.subject, self.used)
                self.subject, self.used, self.place = name, False, ""
                if topical:
                    self.topic, self.outer = name, ("", True)
        self.role = "subj"

    def on_object(self, t: Token, i: int) -> None:
        self.object = phrase(self.buffer) or self.object
        self.role = "obj"

    def on_place(self, t: Token, i: int) -> None:
        name = phrase(self.buffer)
        if name:
            nxt = self.at(i + 1)
            self.place, self.role, self.agent = name, "dat", (nxt.tag, nxt.form) == ("VV", "의하")

    def on_noun_verb(self, t: Token, i: int) -> None:
        self.role = ""
        stem = self.buffer[-1] if self.buffer else ""
        if not (2 <= len(stem) <= 20 and stem not in vocab.STOP_KO and _NAME.fullmatch(stem)) or self.modifies(i):
            return
        if t.form == "되":
            if self.place and self.agent and self.subject:
                self.triples.append((self.place, stem + (NO if self.negated(i) else ""), self.subject, False))
                self.agent = False
            self.object = self.place = ""
        else:
            self.emit(stem + {"받": "받음", "당하": "당함"}.get(t.form, ""), i)

    def on_verb(self, t: Token, i: int) -> None:
        if t.form in vocab.VERBS_FUNCTIONAL:
            return
        self.role = ""
        if t.form in vocab.VERBS_AUXILIARY:
            return
        nxt = self.at(i + 1)
        ends = nxt.tag == "EF" or (nxt.form in vocab.MUST and nxt.tag == "EC")
        name = nominal(t.form)
        if ends and 2 <= len(name) <= 20 and name not in vocab.STOP_KO and _NAME.fullmatch(name) and not self.modifies(i):
            self.emit(name, i)

    def on_modifier(self, t: Token, i: int) -> None:
        nxt = self.at(i + 1)
        if (nxt.tag, nxt.form) == ("NNB", "수"):
            return
        if self.outer[0]:
            (self.subject, self.used), self.outer = self.outer, ("", self.outer[1])
        self.anchor = self.place or self.anchor
        self.place = self.object = ""

    def on_connective(self, t: Token, i: int) -> None:
        j = i - 1
        while self.at(j).tag == "EP":
            j -= 1
        verb = self.at(j)
        if j >= 0 and verb.tag == "VV" and verb.form not in vocab.VERBS_AUXILIARY | vocab.VERBS_FUNCTIONAL:
            self.object = ""

    def run(self) -> Reading:
        i = 0
        while i < len(self.tokens):
            t = self.tokens[i]
            if t.tag in ("NNG", "NNP") or (t.tag == "XSN" and t.form != vocab.PLURAL and self.buffer):
                self.noun(t)
            elif t.tag == "JKG" and self.buffer:
                self.genitive(t)
            elif t.tag in ("XPN", "SN"):
                i = self.prefix(i)
                continue
            elif t.tag == "NNB" or t.form in _QUOTES and t.form:
                self.end = t.end
            elif t.form in _OPEN and t.form:
                i = self.parenthesis(i)
                continue
            else:
                self.end, self.linked = t.end, False
                self.dispatch(t, i)
                self.buffer = []
            i += 1
        return Reading(self.triples, self.topic, self.pending, phrase(self.buffer))

    def dispatch(self, t: Token, i: int) -> None:
        if t.tag in ("JKS", "JKC") or (t.tag == "JX" and t.form in ("은", "는")):
            self.on_subject(t, i)
        elif t.tag == "JKO":
            self.on_object(t, i)
        elif t.tag == "JKB" and t.form in vocab.DATIVE:
            self.on_place(t, i)
        elif t.tag == "XSV":
            self.on_noun_verb(t, i)
        elif t.tag == "VV":
            self.on_verb(t, i)
        elif t.tag == "ETM":
            self.on_modifier(t, i)
        elif t.tag == "EC":
            self.on_connective(t, i)
        else:
            self.role = ""


def read(tokens: list[Token], carried: str = "", item: bool = False, forbidden: bool = False, spaced: bool = False) -> Reading:
    return Walk(tokens, item, forbidden, spaced, subject=carried, used=bool(carried), topic=carried).run()


def chunk_triples(pieces: list[tuple[str, list[Token]]], carry: bool = True, spaced: bool = False) -> list[tuple[str, str, str, bool]]:
    """Triples (subject, predicate, object, inferred) of a chunk's sentences: list items take over topic, prohibition and the
    waiting predicate of the sentence before the list; no loops; the first of equal triples."""
    topic, forbidden, pending = "", False, ""
    out: dict[tuple[str, str, str], bool] = {}
    for text, tokens in pieces:
        item = bool(ITEM.match(text))
        given = topic if item and carry else ""
        r = read(tokens, given, item, item and forbidden, spaced)
        found = r.triples
        if item and not found and given and pending and r.last:
            found = [(given, pending, r.last, True)]
        if not item:
            topic, forbidden, pending = r.topic, bool(FORBIDS.search(text)), r.pending
        for s, p, o, inferred in found:
            if s != o:
                out.setdefault((s, p, o), inferred)
    return [(*k, v) for k, v in out.items()]


@dataclass
class Node:
    """A token of an English dependency tree."""

    i: int
    head: int
    text: str
    lemma: str
    pos: str
    dep: str
    ent_type: str


def english_triples(nodes: list[Node], max_reach: int = 4) -> list[tuple[str, str, str]]:
    """Triples of a parsed English text: active objects, prepositional objects (no dates), passive agents."""
    kids: dict[int, list[Node]] = {}
    for n in nodes:
        if n.head != n.i:
            kids.setdefault(n.head, []).append(n)

    def subtree(n: Node) -> list[Node]:
        out, open_ = [], [n]
        while open_:
            x = open_.pop()
            out.append(x)
            open_ += kids.get(x.i, [])
        return [x for x in sorted(out, key=lambda x: x.i) if abs(x.i - n.i) <= max_reach]

    def name(n: Node) -> str:
        inside = {x.i: x for x in subtree(n) if x.dep not in ("acl", "appos", "det", "pobj", "prep", "punct", "relcl")}
        if n.i not in inside:
            return n.text
        a = b = n.i
        while a - 1 in inside:
            a -= 1
        while b + 1 in inside:
            b += 1
        return " ".join(inside[k].text for k in range(a, b + 1)).strip()

    def fits(n: Node, s: str) -> bool:
        if n.pos == "PRON" or not s or s.endswith((" such", " that")) or s.startswith("'s"):
            return False
        return any(x.pos == "PROPN" for x in subtree(n)) or len(s.split()) > 1

    def below(n: Node, *deps: str) -> list[Node]:
        return [k for k in kids.get(n.i, []) if k.dep in deps]

    out: dict[tuple[str, str, str], None] = {}
    for v in nodes:
        subjects = below(v, "nsubj", "nsubjpass")
        if v.pos != "VERB" or v.lemma.lower() in vocab.EN_STOP_VERBS or not subjects:
            continue
        s = subjects[0]
        if s.dep == "nsubjpass":
            for agent in (o for p in below(v, "agent") for o in below(p, "pobj")):
                a, b = name(agent), name(s)
                if fits(agent, a) and fits(s, b):
                    out[a, v.lemma, b] = None
            continue
        objects = [(o, v.lemma) for o in below(v, "dobj")]
        objects += [(o, f"{v.lemma} {p.text.lower()}") for p in below(v, "prep") for o in below(p, "pobj") if o.ent_type not in ("DATE", "TIME")]
        a = name(s)
        if fits(s, a):
            for o, p in objects:
                b = name(o)
                if fits(o, b) and a != b:
                    out[a, p, b] = None
    return list(out)
