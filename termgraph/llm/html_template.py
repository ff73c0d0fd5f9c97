"""HTML extraction by deduction of each host's template from equivalence classes of tokens.

A page is a sequence of tokens: tags (name, class and id), words, and scripts, styles and comments as one
token each.  A token's role is its text and the containers it stands in, hashed to 64 bits.

1. Occurrence vectors.  A role's vector is its number of occurrences on each page of the host, compared by a commutative 64-bit
   sum over (page, count), so that a host's pages never need to be in one place.  A task sums tags and words of its pages at once. It sends
   all tags, but only the words on a share of the host's pages that it has read, and the count that a word it doesn't send
   can have at most.  These bounds tell which words can be on enough pages and which of those have been sent by all tasks; only
   the others, if there are any, are summed in a second reading of their hosts' pages.
2. Classes.  Roles with equal vectors form an equivalence class: tags, and the words that occur as often as they do on every
   page.  A class must occur on enough of the host's pages and needs two roles.  Words whose vector no tag has form
   classes of their own; these come after those with tags.
3. Validity.  The tags (without tags, the words) of a class must come in the same order, repeated as a whole, on every page, and its words
   always in the same order within the same gap between its tags (else the words of the gap leave it).  Two classes
   must be disjoint or nested on every page; of two that cross, the one on fewer pages goes.
4. The template of a host is the nest of its valid classes.  A page's slots are what remains between
   template tokens, named by the gap of the outermost class and, inside a nested class, its gap ("0.20/2.1"), so that
   repeated records share a slot.

``main_text`` is all text, nested slots included, of the outermost gap that holds most of it.

What moves: one row for each (host, tag role or word sent) and task in step 1, one for
each (host, class, gap) in step 3.  The templates (a few hundred tokens a host) are joined to the pages: by broadcast where
their bytes allow, else by a shuffle in which hosts with many pages are salted.

Defined cases: a NULL or empty page has no slots and an empty main text; a host with fewer than ``least_pages``
pages, or without a valid class, has no template, and its pages' whole text is the one slot ``all``; a NULL url belongs to
the host ''; ids of any type; rows that repeat are pages of their own; broken markup is read as it comes, in time linear in
its length; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import compress, count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termgraph.llm.lookup import BROADCAST_BYTES, lookup
from termgraph.llm.vectortext import mix, runs
from termgraph.storage import materialise

LEAST_PAGES = 3
SUPPORT = 0.5  #: share of a host's pages that a class must occur on
_HOLD = 200_000
_TOKENS, _CHARS = 1_000_000, 1 << 25  #: a task counts its pages when it holds so many tokens, or so much text
_SLACK_FROM = 5  #: of so many pages of a host, a task sends the words on half the share already, so that few need a second reading
_ROWS = 500  #: pages that are Python objects at a time
_M = (1 << 64) - 1
_PIECE = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|</?[a-zA-Z][^>]*>|[^<]+|<", re.S | re.I)
_CLOSED = re.compile(r"</(?:script|style)\s*>\Z", re.I)
_ATTR = re.compile(r"\s(class|id)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_NESTS = frozenset("html head body nav ul ol table thead tbody tr div article section header footer main aside form figure blockquote dl".split())
_BLOCK = frozenset("p br li td th h1 h2 h3 h4 h5 h6 dt dd pre option".split()) | _NESTS


def _h(*parts: str) -> int:
    return xxhash.xxh3_64_intdigest("\x00".join(parts))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def pieces(page: str) -> Iterator[tuple[str, str | None]]:
    """The page cut into tags, comments, scripts and text; beside each whether it is a script or style.  No tag ends after the
    last '>', so none is looked for there: a scan for an end that never comes would run over the rest at every '<'."""
    end = page.rfind(">") + 1
    for m in _PIECE.finditer(page, 0, end):
        piece, script = m.group(), m.group(1)
        if m.end() == end and (not _CLOSED.search(piece, piece.index(">") + 1) if script else piece.startswith("<!--") and not (piece.endswith("-->") and len(piece) > 6)):
            yield piece + page[end:], script  # it goes on to the end of the page
            return
        if m.end() == end and piece[0] != "<":
            end = m.start()  # text that holds the last '>' and may go on
            break
        yield piece, script
    tail = page[end:]
    cut = tail.find("<!--") if "<!--" in tail else len(tail)
    for m in re.finditer("[^<]+|<", tail[:cut]):
        yield m.group(), None
    if cut < len(tail):
        yield tail[cut:], None


_known: dict[tuple[str, int], tuple[int, str, bool, int]] = {}  #: the worker's tags by (text, place)


def _opening(piece: str, place: int) -> tuple[int, str, bool, int]:
    """(role, name, breaks a line, place inside or -1) of an opening tag."""
    own = _known.get((piece, place))
    if own is None:
        name = re.match(r"<([a-zA-Z][a-zA-Z0-9:-]*)", piece).group(1).lower()
        key = name + "".join(sorted(a.group(1).lower() + "=" + a.group(2).strip("\"'") for a in _ATTR.finditer(piece)))
        inside = _h(key, str(place)) if name in _NESTS and not piece.endswith("/>") else -1
        own = (_h("<" + key, str(place)), name, name in _BLOCK, inside)
        if len(piece) < 400:
            if len(_known) > 100_000:
                _known.clear()
            _known[piece, place] = own
    return own


@lru_cache(100_000)
def _closing(name: str, place: int) -> int:
    return _h("</" + name, str(place))


def parts(page: str) -> Iterator[tuple[int, str | None, bool, int]]:
    """(role, None, breaks a line, place) of each tag of a page, and (0, text, False, place) of the text between tags."""
    path, place, opened = [], [0], Counter()
    for piece, script in pieces(page):
        here = place[-1]
        if piece[0] != "<" or piece == "<":
            yield 0, piece, False, here
        elif script or piece[1] in "!?":
            yield _h("<" + (script or piece[1]).lower(), str(here)), None, False, here
        elif piece[1] == "/":
            name = piece[2:-1]
            if not (name.isascii() and name.isalpha()):
                name = re.match(r"</([a-zA-Z][a-zA-Z0-9:-]*)", piece).group(1)
            name = name.lower()
            if opened.get(name):
                while True:
                    gone = path.pop()
                    place.pop()
                    opened[gone] -= 1
                    if gone == name:
                        break
            here = place[-1]
            yield (_closing if len(name) < 100 else _closing.__wrapped__)(name, here), None, name in _BLOCK, here
        else:
            role, name, breaks, inside = _opening(piece, here)
            yield role, None, breaks, here
            if inside >= 0:
                path.append(name)
                place.append(inside)
                opened[name] += 1


def tokens(page: str, places: set[int] | None = None, text: bool = True) -> Iterator[tuple[int, bool, str, bool, int]]:
    """(role, is a tag, text to show, breaks a line, place) of each token of a page; text in none of ``places`` (where no class has a
    word) is one token of role 0, and left out without ``text``."""
    for role, piece, breaks, here in parts(page):
        if piece is None:
            yield role, True, "", breaks, here
        elif not text:
            continue
        elif places is not None and here not in places:
            yield 0, False, " ".join(piece.split()), False, here
        else:
            for w in piece.split():
                yield xxhash.xxh3_64_intdigest(w, here), False, w, False, here


class _Roles(dict):
    """Roles of the words at one place."""

    def __init__(self, place: int):
        self.place = place

    def __missing__(self, word: str) -> int:
        role = xxhash.xxh3_64_intdigest(word, self.place)
        if len(word) < 100:
            self[word] = role
            _kept[0] += 1
        return role


_kept = [0]
_by_place: dict[int, _Roles] = {}  #: the worker's words


def word_roles(words: list[str], place: int) -> list[int]:
    """Role of each word; those seen before are looked up, not hashed."""
    if _kept[0] + 4 * len(_by_place) > _HOLD:
        _by_place.clear()
        _kept[0] = 0
    known = _by_place.get(place)
    if known is None:
        known = _by_place[place] = _Roles(place)
    return list(map(known.__getitem__, words))


def _rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for first in range(0, batch.num_rows, _ROWS):
        yield batch.slice(first, _ROWS)


def host_of(url: str = "url"):
    return F.lower(F.coalesce(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


class _Counted:
    """The tokens of some pages, as numbers, until they are counted all at once."""

    def __init__(self):
        self.new = count().__next__
        self.words: dict[int, dict[str, int]] = {}  # numbers of the words at each place
        self.tags: dict[int, int] = defaultdict(self.new)
        self.seq, self.ends, self.pages, self.hosts = [], [], [], []
        self.chars = self.numbers = 0

    def full(self) -> bool:
        return len(self.seq) > _TOKENS or self.numbers + 4 * len(self.words) > _HOLD or self.chars > _CHARS

    def read(self, page: int, host: str, text: str, within: set[int] | None = None) -> None:
        """Take in a page; only its words in the places ``within``, if these are given."""
        seq, tags, words = self.seq, self.tags, self.words
        for role, piece, _, here in parts(text):
            if piece is None:
                if within is None:
                    seq.append(tags[role])
            elif (within is None or here in within) and not piece.isspace():
                own = words.get(here)
                if own is None:
                    own = words[here] = defaultdict(self.new)
                seq.extend(map(own.__getitem__, piece.split()))
        self.ends.append(len(seq))
        self.pages.append(page)
        self.hosts.append(host)
        self.chars += len(text)
        self.numbers = self.new() + 1  # a page takes one itself

    def is_tag(self) -> np.ndarray:
        out = np.zeros(self.numbers, bool)
        out[list(self.tags.values())] = True
        return out

    def roles(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(role, place) of the ``wanted`` numbers, a mask over all; the place of a tag is 0."""
        role, place = np.zeros(self.numbers, np.uint64), np.zeros(self.numbers, np.uint64)
        role[list(self.tags.values())] = np.array(list(self.tags), np.uint64)
        for here, own in self.words.items():
            number = np.fromiter(own.values(), np.int64, len(own))
            asked = wanted[number]
            role[number[asked]] = np.array([xxhash.xxh3_64_intdigest(w, here) for w in compress(own, asked.tolist())], np.uint64)
            place[number] = here
        return role.view(np.int64), place.view(np.int64)

    def sums(self) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hosts, pages read of each), and (host, number, pages, vector) of each role of each host."""
        names = sorted(set(self.hosts))
        at = {h: i for i, h in enumerate(names)}
        owner = np.array([at[h] for h in self.hosts], np.int64)
        order = np.argsort(owner, kind="stable")  # a host's pages side by side
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        owner, page = owner[order], mix(np.array(self.pages, np.int64).view(np.uint64)[order])
        bits = np.int64(len(order).bit_length())
        key = np.array(self.seq, np.int64) << bits | np.repeat(rank, np.diff(self.ends, prepend=0))
        key.sort()
        first = runs(key)
        key = key[first[:-1]]
        number, on = key >> bits, key & ((np.int64(1) << bits) - np.int64(1))
        marks = mix(page[on] + np.diff(first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        host = owner[on]
        group = runs(number * len(names) + host)
        vector = np.add.reduceat(marks, group[:-1]) if len(marks) else marks
        return names, np.bincount(owner, minlength=len(names)), host[group[:-1]], number[group[:-1]], np.diff(group), vector

    def table(self, names: list[str], host: np.ndarray, number: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
        """Rows (host, role, place, ...) of the given numbers."""
        wanted = np.zeros(self.numbers, bool)
        wanted[number] = True
        role, place = self.roles(wanted)
        keys = [pa.array(names, pa.string()).take(pa.array(host)), pa.array(role[number]), pa.array(place[number], mask=self.is_tag()[number])]
        return pa.RecordBatch.from_arrays([*keys, *(pa.array(c.astype(np.int64)) for c in columns.values())], names=["host", "role", "place", *columns])


def role_vectors(pages: DataFrame, support: float) -> DataFrame:
    """(host, role, place, pages, vector, unsent) of every tag role (its place is NULL) and of the words sent, from (page, host, html); and a row
    of role NULL for each host.  A word that is on fewer pages of a task than some share isn't sent: there it has at most ``unsent``, summed
    over the tasks that have sent the word, or at the role NULL over all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Counted()

        def flush() -> Iterator[pa.RecordBatch]:
            names, read, host, number, n, vector = held.sums()
            least = np.maximum(1, np.ceil(np.where(read < _SLACK_FROM, 1.0, 0.5) * support * read)).astype(np.int64)
            sent = np.flatnonzero(held.is_tag()[number] | (n >= least[host]))
            host = host[sent]
            yield held.table(names, host, number[sent], pages=n[sent], vector=vector[sent].view(np.int64), unsent=least[host] - 1)
            none = pa.nulls(len(names), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), none, none, pa.array(read.astype(np.int64)), pa.array(np.zeros(len(names), np.int64)), pa.array(least - 1)], names=["host", "role", "place", "pages", "vector", "unsent"])

        for b in batches:
            for own in _rows(b):
                for page, host, text in zip(*(own.column(i).to_pylist() for i in range(3))):
                    held.read(page, host, text or "")
                    if held.full():
                        yield from flush()
                        held = _Counted()
        if held.ends:
            yield from flush()

    return summed(pages.mapInArrow(run, "host string, role long, place long, pages long, vector long, unsent long"), F.sum("unsent").alias("unsent"))


def word_vectors(pages: DataFrame) -> DataFrame:
    """(host, role, place, pages, vector) of the words in ``words``, from (page, host, html, words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Counted()
        asked: dict[str, tuple[np.ndarray, set[int]]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            names, _, host, number, n, vector = held.sums()
            role = held.roles(np.ones(held.numbers, bool))[0][number]
            by_host = np.argsort(host, kind="stable")
            ends = np.searchsorted(host[by_host], np.arange(len(names) + 1))
            sent = np.concatenate([np.zeros(0, np.int64), *(own[np.isin(role[own], asked[h][0])] for h, own in zip(names, (by_host[a:b] for a, b in zip(ends, ends[1:]))))])
            yield held.table(names, host[sent], number[sent], pages=n[sent], vector=vector[sent].view(np.int64))
            asked.clear()

        for b in batches:
            for own in _rows(b):
                for i, (page, host, text) in enumerate(zip(*(own.column(i).to_pylist() for i in range(3)))):
                    if host not in asked:
                        words = own.column(3)[i].as_py()
                        asked[host] = (np.array([w["role"] for w in words], np.int64), {w["place"] & _M for w in words})
                    held.read(page, host, text or "", asked[host][1])
                    if held.full() or len(asked) > 1000:
                        yield from flush()
                        held = _Counted()
        if held.ends:
            yield from flush()

    return summed(pages.mapInArrow(run, "host string, role long, place long, pages long, vector long"))


def summed(sent: DataFrame, *more) -> DataFrame:
    """The rows of all tasks for each (host, role, place), added up."""
    low, high = F.col("vector").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("vector", 32)
    sums = sent.groupBy("host", "role", "place").agg(F.sum("pages").alias("pages"), F.sum(low).alias("low"), F.sum(high).alias("high"), *more)
    return sums.select("host", "role", "place", "pages", vector_name().alias("vector"), *([F.col("unsent")] if more else []))


def vector_name():
    """Sums of two's complement wrap as the unsigned ones do; ANSI mode forbids it, so the halves are summed apart and the high one takes what the
    low one carries: a vector has one name however its parts were cut."""
    high = (F.col("high") + F.shiftrightunsigned("low", 32)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.concat_ws(":", F.col("low").bitwiseAND(F.lit(0xFFFFFFFF)).cast("string"), high.cast("string"))


def enough(pages: str, least_pages: int, support: float):
    return (F.col(pages) >= least_pages) & (F.col(pages) >= F.col("n") * support)


def frequent(vectors: DataFrame, hosts: DataFrame, least_pages: int, support: float) -> DataFrame:
    """(host, role, place, pages, vector, n, whole) of the roles that are, or where ``whole`` is false may be, on enough of the host's ``n`` pages.

    A page bounds them: the roles on a share s of the pages are at most 1/s of the tokens of an average page."""
    bound = vectors.where("role IS NULL").select("host", F.col("unsent").alias("bound"))
    known = vectors.where("role IS NOT NULL").join(hosts.where(F.col("n") >= least_pages), "host").join(bound, "host")
    missing = F.when(F.col("place").isNull(), 0).otherwise(F.col("bound") - F.col("unsent"))
    most = known.withColumn("most", F.col("pages") + missing).where(enough("most", least_pages, support))
    return most.select("host", "role", "place", "pages", "vector", "n", (missing == 0).alias("whole"))


def all_classes(roles: DataFrame) -> DataFrame:
    """(host, classes): for each host the array of (pages, tags, words) of its classes of two roles or more, those with tags first, largest support first."""
    tag = F.col("place").isNull()
    found = roles.groupBy("host", "pages", "vector").agg(
        F.array_sort(F.collect_list(F.when(tag, F.col("role")))).alias("tags"), F.array_sort(F.collect_list(F.when(~tag, F.struct("role", "place")))).alias("words")
    )
    tagged = F.size("tags") > 0
    ranked = found.where(F.size("tags") + F.size("words") > 1).select("host", F.struct(tagged.alias("tagged"), "pages", F.when(tagged, F.size("tags")).otherwise(F.size("words")).alias("n"), "tags", "words").alias("c"))
    classes = ranked.groupBy("host").agg(F.reverse(F.array_sort(F.collect_list("c"))).alias("c"))
    return classes.select("host", F.transform("c", lambda c: F.struct(c.pages.alias("pages"), c.tags.alias("tags"), c.words.alias("words"))).alias("classes"))


def _owners(classes: list[dict]) -> dict[int, int]:
    return {r & _M: i for i, c in enumerate(classes) for r in [*c["tags"], *(w["role"] for w in c["words"])]}


def _places(classes: list[dict]) -> set[int]:
    return {w["place"] & _M for c in classes for w in c["words"]}


def page_marks(page: str, owner: dict[int, int], places: set[int]) -> list[tuple[int, int, int, bool, int]]:
    """(class, gap or -1, signature, crossed, words) of each class on one page; gap -1 is the order of the tags.  The signature
    is 0 where the page breaks the pattern; gap 0 is what lies outside the class's repetitions, a later one must be the same in each."""
    seen: dict[int, list[tuple[int, bool, int]]] = {}
    at = 0
    for role, piece, _, here in parts(page):
        if piece is None:
            c = owner.get(role)
            if c is not None:
                seen.setdefault(c, []).append((role, True, at))
                at += 1
        elif here in places:
            for role in filter(owner.__contains__, word_roles(piece.split(), here)):
                seen.setdefault(owner[role], []).append((role, False, at))
                at += 1
    out, spans = [], []
    for c, found in seen.items():
        words_alone = not any(tag for _, tag, _ in found)  # their own order is that of the class
        tags = [(r, at) for r, tag, at in found if tag or words_alone]
        kinds = len({r for r, _ in tags})
        order = [r for r, _ in tags]
        good = len(order) % kinds == 0 and order == order[:kinds] * (len(order) // kinds)
        out.append((c, -1, _h(*map(str, order[:kinds])) | 1 if good else 0, False, 0))
        if not good:
            continue
        gaps: dict[int, dict[int, list[int]]] = {}
        n = 0
        for r, tag, _ in found:
            if tag or words_alone:
                n += 1
            else:
                g = n % kinds
                gaps.setdefault(g, {}).setdefault(n // kinds if g else 0, []).append(r)
        for g, turns in gaps.items():
            one = next(iter(turns.values()))
            same = not g or (len(turns) == len(order) // kinds and all(t == one for t in turns.values()))
            out.append((c, g, _h(*map(str, one)) | 1 if same else 0, False, len(set(one))))
        if kinds > 1:
            spans += [(tags[i][1], tags[i + kinds - 1][1], c) for i in range(0, len(tags), kinds)]
    spans.sort(key=lambda s: (s[0], -s[1]))
    stack: list[tuple[int, int, int]] = []
    crossed = set()
    for s in spans:
        while stack and stack[-1][1] < s[0]:
            stack.pop()
        while stack and stack[-1][1] < s[1]:  # neither nested nor disjoint: the class that comes later in the list goes
            worse = max(stack[-1][2], s[2])
            crossed.add(worse)
            if worse == s[2]:
                break
            stack.pop()
        else:
            stack.append(s)
    return out + [(c, -2, 0, True, 0) for c in crossed]


def verdicts(pages: DataFrame) -> DataFrame:
    """(host, class, gap, low, high, crossed, pages, words) over all pages of each host, from (host, html, classes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int, int], list[int]] = {}
        cache: dict[str, tuple[dict[int, int], set[int]]] = {}

        def flush() -> pa.RecordBatch:
            keys, v = list(held), np.array(list(held.values()), np.int64).reshape(-1, 5)
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.int32()), *(pa.array(v[:, i]) for i in range(5))],
                names=["host", "class", "gap", "low", "high", "crossed", "pages", "words"],
            )

        for b in (own for whole in batches for own in _rows(whole)):
            for i, (host, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                if host not in cache:
                    cache = {} if len(cache) > 1000 else cache
                    classes = b.column(2)[i].as_py()
                    cache[host] = (_owners(classes), _places(classes))
                for c, gap, sig, cross, n in page_marks(text or "", *cache[host]):
                    sig = _signed(sig)
                    own = held.get((host, c, gap))
                    if own is None:
                        held[host, c, gap] = [sig, sig, int(cross), 1, n]
                    else:
                        own[:] = min(own[0], sig), max(own[1], sig), own[2] + cross, own[3] + 1, max(own[4], n)
            if len(held) > _HOLD:
                yield flush()
        yield flush()

    parts = pages.mapInArrow(run, "host string, class int, gap int, low long, high long, crossed long, pages long, words long")
    return parts.groupBy("host", "class", "gap").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("crossed").alias("crossed"), F.sum("pages").alias("pages"), F.max("words").alias("words"))


@dataclass
class Template:
    """``roles``: role -> (class, is a tag); ``order``: how many tags each class has; ``gaps``: (class, gap) with words;
    ``places``: where words are; ``size``: number of template tokens."""

    roles: dict[int, tuple[int, bool]]
    order: dict[int, int]
    gaps: set[tuple[int, int]]
    places: set[int]
    size: int


def slots_of(page: str, template: Template) -> list:
    """(slot, text) of a page: the text between template tokens."""
    roles, order = template.roles, template.order
    out: list[tuple[str, list[str]]] = []
    name, held, met, outer = "0", [], {}, ""
    root = min(order, default=0)

    def met_one(own: tuple[int, bool]) -> None:
        nonlocal name, held, outer
        if held:
            out.append((name, held))
            held = []
        if own[1]:
            met[own[0]] = met.get(own[0], 0) + 1
        gap = f"{own[0]}.{(met.get(own[0], 0) - 1) % order[own[0]] + 1}"
        if own[0] == root:
            name = outer = gap
        else:
            name = f"{outer}/{gap}"

    for role, piece, breaks, here in parts(page):
        if piece is None:
            own = roles.get(role)
            if own is not None and (own[1] or (own[0], met.get(own[0], 0) % order[own[0]]) in template.gaps):
                met_one(own)
            elif breaks and held and held[-1] != "\n":
                held.append("\n")
            continue
        words = piece.split()
        found = word_roles(words, here) if here in template.places else ()
        if roles.keys().isdisjoint(found):
            held += words
            continue
        for role, word in zip(found, words):
            own = roles.get(role)
            if own is not None and (own[1] or (own[0], met.get(own[0], 0) % order[own[0]]) in template.gaps):
                met_one(own)
            else:
                held.append(word)
    if held:
        out.append((name, held))
    shown = [(n, entities.unescape(re.sub(r" ?\n ?", "\n", " ".join(h)).strip())) for n, h in out]
    return [s for s in shown if s[1]]


def main_text(slots: list[tuple[str, str]]) -> str:
    """All text in the gap of the outermost class that holds most text, the first of equals."""
    size: dict[str, int] = {}
    for n, t in slots:
        size[n.split("/")[0]] = size.get(n.split("/")[0], 0) + len(t)
    best = max(size, key=lambda n: size[n], default=None)
    return "\n".join(t for n, t in slots if n.split("/")[0] == best)


def extract(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", least_pages: int = LEAST_PAGES, support: float = SUPPORT, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(page_id, host, template_tokens, slots, main_text) of each page."""
    work = pages.select(F.col(id).alias("page_id"), host_of(url).alias("host"), F.col(html).alias("html")).withColumn("page", F.xxhash64("page_id", "host", "html"))
    keyed = work.select("page", "host", "html")
    hosts = materialise(work.groupBy("host").agg(F.count(F.lit(1)).alias("n")), "hosts")
    templates = deduced(keyed, hosts, least_pages, support, broadcast_bytes)
    whole = lookup(work, templates, hosts, ["host"], "page", "left", broadcast_bytes).select("page_id", "host", "html", "classes", "marks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, Template] = {}
        for b in (own for whole in batches for own in _rows(whole)):
            texts = b.column(2).to_pylist()
            slots, mains, sizes = [], [], []
            for i, host in enumerate(b.column(1).to_pylist()):
                if host not in cache:
                    cache = {} if len(cache) > 1000 else cache
                    cache[host] = template_of(b.column(3)[i].as_py() or [], b.column(4)[i].as_py() or [])
                own = slots_of(texts[i] or "", cache[host])
                if not cache[host].roles:
                    own = [("all", "\n".join(t for _, t in own))] if own else []
                slots.append([{"slot": n, "text": t} for n, t in own])
                mains.append(main_text(own))
                sizes.append(cache[host].size)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(sizes, pa.int32()), pa.array(slots, pa.list_(pa.struct([("slot", pa.string()), ("text", pa.string())]))), pa.array(mains, pa.string())],
                names=["page_id", "host", "template_tokens", "slots", "main_text"],
            )

    kind = work.schema["page_id"].dataType.simpleString()
    return whole.mapInArrow(run, f"page_id {kind}, host string, template_tokens int, slots array<struct<slot:string,text:string>>, main_text string")


def deduced(keyed: DataFrame, hosts: DataFrame, least_pages: int = LEAST_PAGES, support: float = SUPPORT, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(host, classes, marks) of the hosts with a candidate class, from (page, host, html) and (host, n)."""
    sums = materialise(role_vectors(keyed, support), "role-vectors")
    roles = materialise(frequent(sums, hosts, least_pages, support), "frequent-roles")
    whole = roles.where("whole").select("host", "role", "place", "pages", "vector")
    asked = roles.where("NOT whole").groupBy("host").agg(F.collect_list(F.struct("role", "place")).alias("words"))
    if roles.where("NOT whole").limit(1).count():
        asked = materialise(asked, "asked-words")
        again = word_vectors(lookup(keyed, asked, hosts, ["host"], "page", "inner", broadcast_bytes).select("page", "host", "html", "words"))
        whole = whole.unionByName(again.join(hosts, "host").where(enough("pages", least_pages, support)).drop("n"))
    classes = materialise(all_classes(whole), "classes")
    marks = verdicts(lookup(keyed, classes, hosts, ["host"], "page", "inner", broadcast_bytes).select("host", "html", "classes"))
    judged = marks.groupBy("host").agg(F.collect_list(F.struct("class", "gap", (F.col("low") == F.col("high")).alias("same"), (F.col("low") != 0).alias("kept"), "crossed", "pages", "words")).alias("marks"))
    return materialise(classes.join(judged, "host"), "templates")


def template_of(classes: list[dict], marks: list[dict]) -> Template:
    """A host's valid classes."""
    crossed = {m["class"] for m in marks if m["crossed"]}
    order_ok = {m["class"] for m in marks if m["gap"] == -1 and m["same"] and m["kept"]} - crossed
    words = {(m["class"], m["gap"]): m["words"] for m in marks if m["gap"] >= 0 and m["same"] and m["kept"] and m["pages"] == classes[m["class"]]["pages"]}
    out = Template({}, {}, set(), set(), 0)
    for c in sorted(order_ok):
        alone = not classes[c]["tags"]
        tags, gaps = [w["role"] for w in classes[c]["words"]] if alone else classes[c]["tags"], {g: n for g, n in words.items() if g[0] == c}
        if len(tags) + sum(gaps.values()) > 1:
            out.order[c] = len(tags)
            out.gaps |= gaps.keys()
            out.roles |= {r & _M: (c, True) for r in tags} | {w["role"] & _M: (c, False) for w in classes[c]["words"] if gaps}
            out.places |= {w["place"] & _M for w in classes[c]["words"] if gaps or alone}
            out.size += len(tags) + sum(gaps.values())
    return out
