"""Sentence boundaries across languages and scripts (problem 8).

Method: candidate boundaries, each classified by a maximum-entropy model.

1. Layout. Lines form blocks; a blank line ends a block. Headings, list items
   and time-stamped log lines are units of their own.
2. Candidates. In a block, every run of sentence marks outside matched quotes
   and brackets, every closing quote or bracket right behind a mark, and (Thai)
   every blank between two Thai characters. Runs inside numbers, names, files
   and addresses are no candidates, since text follows them directly.
3. Evidence. The pass that finds the candidates also counts, for each word
   before a mark, how often it stands at a block's end, and for each following
   word how often it begins a block. All words of all documents are counted, in
   a sketch of fixed width: SKETCH_ROWS rows of CELLS cells, a word's least
   count is taken. Words met fewer than LEAST_SEEN times count as unknown; no
   bound moves with the size of the input. The driver gets one byte a cell.
4. Training. Reliable boundaries are marks at the end of a block and marks
   between a common last word and a common first word; reliable non-boundaries
   are words that never end a block, or are followed by a word that never begins
   one, although both are frequent. A bounded sample of these trains the model.
5. All candidates of all documents are classified with it, from the contexts
   kept in step 2: texts are read once.

Words are whole, however long; a feature names a word by the WORD characters
nearest to the mark (in scripts without blanks a "word" is all that stands
between two marks).
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.functions.arrow import strings
from recordloom.session import materialize

#: Documents the classifier's labelled rows are drawn from, and distinct labelled rows at most.
TRAINING_DOCUMENTS = 20_000
TRAINING_ROWS = 100_000
#: Cells in each row of the sketch of word counts: 8 MB for both tables, whatever the input.
CELLS = 1 << 21
SKETCH_ROWS = 2
LEAST_SEEN = 5
#: Characters by which a feature names a word.
WORD = 24
#: So many sightings without one at a block's edge make a type a reliable non-boundary.
SURE_AFTER = 12

# Common abbreviations written with a full stop, by language; the model weighs them as one feature.
ABBREVIATIONS = frozenset(
    """
    mr mrs ms dr prof st jr sr vs etc e.g i.e cf al approx fig figs no nos vol vols pp p sec ch ed eds inc ltd co corp dept est
    min max jan feb mar apr jun jul aug sep sept oct nov dec a.m p.m u.s u.k
    z b d h u a bzw ca usw nr abb s vgl bspw evtl ggf inkl str tel hr fr z.b d.h u.a
    m mm mme mlle art env ex chap éd
    sra srta dra núm pág págs ej aprox cap
    т е д п г гг рис стр см гл пп мин др пр тыс млн ср т.е т.д
    κ π.χ κ.λπ αρ βλ σελ
    डॉ प्रो श्री
    د أ
    น พ.ศ
    """.split()
)
# Marks, quotes and brackets.
MARKS = ".!?…。！？؟।॥"
WIDE = frozenset("。！？؟।॥")
PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "【": "】", "《": "》", "「": "」", "『": "』", "“": "”", "„": "“”", "«": "»", "‹": "›", "‘": "’"}
CLOSERS = frozenset(")]}）］】》」』”“»›’\"")
OPENERS = frozenset([*PAIRS, '"', "¿", "¡"])

_OPENED_BY = {c: tuple(o for o in PAIRS if c in PAIRS[o]) for c in CLOSERS} | {'"': ('"',)}
_BRACKETS = frozenset([*PAIRS, *CLOSERS])
_MARK_SET = frozenset(MARKS)
_AFTER = frozenset([*MARKS, *",;:，；：、،؛"])

_UNIT_STARTS = frozenset("-*•‣◦–[#=0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_UNIT = re.compile(r"\s*(?:[-*•‣◦–]\s|\d{1,4}[.)]\s|[A-Za-z]\)\s|\[\d{1,2}:\d\d|#{1,6}\s|={2,}\s?)")
_LOOSE_UNIT = re.compile(r"\s*(?:[-*•‣◦]\s|\[\d{1,2}:\d\d:\d\d|#{1,6}\s|={2,}\s)")
# One leading character class, which the engine can search for quickly. A Western mark with a small letter or digit right behind it (in names, numbers, addresses) is no event.
_EVENT = re.compile(
    r"[.!?…؟。！？।॥;;“”„\"«»‹›‘’「」『』()（）\[\]【】［］《》{}]"
    r"(?:(?<=[.!?…؟])(?:[.!?…؟]*+[。！？।॥][.!?…؟。！？।॥]*+|[.!?…؟]*+(?![a-z0-9]))|(?<=[。！？।॥])[.!?…؟。！？।॥]*+|(?<![.!?…؟。！？।॥]))"
)
_THAI_BLANK = re.compile(r"[฀-๿]\s+(?=[฀-๿])")
_GREEK = re.compile(r"[\u0370-\u03ff\u1f00-\u1fff]")
_HEAD = re.compile(rf"\S{{1,{WORD}}}")
_SEP = "\x1f"  # white space to Python, so in no word
_STRIP = "([{（［【《「『“„«‹‘\"'¿¡"


def blocks(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, whole): stretches of text; ``whole`` ones are single units (list items, headings, log lines)."""
    out: list[tuple[int, int, bool]] = []
    start, last, at = -1, 0, 0  # the open block, if any, and where its text ends
    unit = False  # the open block is a unit line
    for line in text.splitlines(keepends=True):
        bare = line.rstrip()
        if not bare:
            if start >= 0:
                out.append((start, last, unit))
                start = -1
        else:
            first = bare[0]
            if (first in _UNIT_STARTS or first.isspace()) and (_UNIT.match(line) if start < 0 or unit else _LOOSE_UNIT.match(line)):
                if start >= 0:
                    out.append((start, last, unit))
                start, unit = at, True
            elif start < 0:
                start, unit = at, False
            # else: a wrapped line goes on with the open block
            last = at + len(bare)
        at += len(line)
    if start >= 0:
        out.append((start, last, unit))
    return out


def matched(text: str, events: list[tuple[int, int, str]]) -> dict[int, int]:
    """open -> close for quotes and brackets that have both; in linear time, however many stay open."""
    opened: dict[str, list[int]] = {}
    pairs: dict[int, int] = {}
    for a, _, c in events:
        if c == "’" and (not opened.get("‘") or (a and text[a - 1].isalpha() and a + 1 < len(text) and text[a + 1].isalpha())):
            continue  # an apostrophe
        last = max((held[-1] for o in _OPENED_BY.get(c, ()) if (held := opened.get(o))), default=-1)
        if last >= 0:
            pairs[last] = a
            for held in opened.values():  # what opened inside stays without a partner
                while held and held[-1] >= last:
                    held.pop()
        elif c == '"' or c in PAIRS:
            opened.setdefault(c, []).append(a)
    return pairs


@lru_cache(maxsize=65536)
def script(ch: str) -> str:
    if not ch:
        return "none"
    if ch.isdigit():
        return "digit"
    o = ord(ch)
    if not ch.isalpha():
        if 0x0900 <= o < 0x0980:
            return "deva"
        if 0x0E00 <= o < 0x0E80:
            return "thai"
        return "open" if ch in OPENERS else "other"
    if o < 0x0370:
        return "upper" if ch.isupper() else "lower"
    if o < 0x0530:
        return "UPPER" if ch.isupper() else "LOWER"  # Greek and Cyrillic
    if o < 0x0800:
        return "arab"
    if o < 0x0E00:
        return "deva"
    if o < 0x0E80:
        return "thai"
    if 0x1F00 <= o < 0x2000:
        return "UPPER" if ch.isupper() else "LOWER"
    if 0xAC00 <= o < 0xD7B0:
        return "hang"
    return "cjk"


@lru_cache(maxsize=2)
def _greek_letters(text: str) -> list[int]:
    return [m.start() for m in _GREEK.finditer(text)]


def is_greek_question(text: str, start: int, at: int) -> bool:
    """Greek asks with a semicolon: one behind Greek words (six letters since ``start``) is a mark, everywhere else it is none."""
    if text[at] == "\u037e":
        return True
    letters = _greek_letters(text)
    return bisect_left(letters, at) - bisect_left(letters, start) >= 6


def candidates(text: str, start: int, end: int) -> Iterator[tuple[int, str, int, bool]]:
    """(position behind the candidate, its mark, begin of the mark, certain) in order; the block's end is not among them.

    ``certain`` ones need no classifier: a mark of a script that uses it for
    nothing else, or a Thai blank.
    """
    events = [(*m.span(), m[0]) for m in _EVENT.finditer(text, start, end)]
    thai = [(m.start() + 1, m.end(), " ") for m in _THAI_BLANK.finditer(text, start, end)]
    if thai:
        events = sorted(events + thai)
    if not events:
        return
    brackets = [e for e in events if e[2] in _BRACKETS]
    pairs = matched(text, brackets) if brackets else {}
    if not pairs and len(brackets) == len(events):
        return
    ends = set(pairs.values())
    skip_to = -1
    sentence = start
    for a, b, c in events:
        if a < skip_to:
            continue
        first = c[0]
        if a in pairs:
            close = pairs[a]
            skip_to = close + 1
            k = close - 1
            while k > a and (text[k] in CLOSERS or text[k].isspace()):
                k -= 1
            if text[k] not in MARKS or close + 1 >= end:
                continue
            mark_at, pos = k, close + 1
            while mark_at > a and text[mark_at - 1] in MARKS:
                mark_at -= 1
            mark = text[mark_at : k + 1] + text[close]
        elif first in _MARK_SET:
            if b < end and text[b] in _AFTER:
                continue
            mark_at, pos, mark = a, b, c
            while pos < end and text[pos] in CLOSERS and pos not in pairs and pos not in ends:
                pos += 1
        elif first == ";" or first == "\u037e":
            if not is_greek_question(text, sentence, a) or b < end and not text[b].isspace() and not _GREEK.match(text, b):
                continue
            mark_at, pos, mark = a, b, ";"
        elif c.isspace():
            yield b, "thai", a, True
            sentence = b
            continue
        else:
            continue
        if pos >= end:
            continue
        nxt = text[pos]
        wide = mark[0] in WIDE
        if nxt in _AFTER:
            continue
        if not nxt.isspace():
            if wide and mark[-1] not in CLOSERS:
                pass
            elif nxt in OPENERS and mark[-1] in MARKS:
                pass
            elif nxt.isalpha() and nxt.isupper() and mark_at > start and not text[mark_at - 1].isupper() and (text[mark_at - 1].isalnum() or text[mark_at - 1] in CLOSERS or mark[-1] in CLOSERS or text[mark_at - 1].isspace()):
                pass  # text glued to the mark: only a capital can begin a sentence there, and a file or type name has none
            else:
                continue
        if first == "." and len(c) == 1 and mark_at > start and "\u0e00" <= text[mark_at - 1] <= "\u0e7f":
            continue
        sure = wide and mark[-1] in WIDE
        yield pos, mark, mark_at, sure
        sentence = pos


def _tokens_before(text: str, start: int, at: int) -> tuple[str, str]:
    """The word right before a mark, not reaching over ``start``, and the word before that one (of a word in front of ``start``, what a feature names of it)."""
    words = text[start:at].rsplit(None, 2)
    if len(words) > 1:
        return words[-1], words[-2]
    ahead = text[max(0, start - 2 * WORD) : start].rsplit(None, 1)
    return words[0] if words else "", ahead[-1] if ahead else ""


def _first_token(text: str, at: int, end: int) -> str:
    m = _HEAD.search(text, at, end)
    if m is None:
        return ""
    w = m[0]
    bare = w.lstrip(_STRIP)
    return (bare or w).rstrip(".,;:!?)”»\"…") or w


def words_around(text: str, start: int, end: int, pos: int, mark: str, mark_at: int) -> tuple[str, str, str, str, str]:
    """The word before a mark, the mark's kind, the word before that, the word that follows, and the first of these as written.

    ``start`` is the candidate before, or the block's start.
    """
    raw, before = _tokens_before(text, start, mark_at)
    kind = mark if len(mark) == 1 and mark != "…" else "..." if mark[0] == "…" or mark.startswith("..") else mark[:2]
    return raw.lstrip(_STRIP).lower()[-WORD:], kind, before.lstrip(_STRIP).lower()[-WORD:], _first_token(text, pos, end) if pos < end else "", raw


def context(text: str, start: int, end: int, pos: int, mark: str, mark_at: int, follow: str | None = None, follow_ch: str = "") -> tuple:
    """Everything the model may look at. ``follow`` replaces what comes next (for marks at a block's end)."""
    prev, kind, before, nxt, raw = words_around(text, start, end, pos, mark, mark_at)
    if follow is None:
        k = pos
        while k < end and text[k].isspace():
            k += 1
        glued = k == pos
        ch = inner = text[k] if k < end else ""
        if ch in OPENERS:
            while k < end and text[k] in OPENERS:
                k += 1
            inner = text[k] if k < end else ""
    else:
        nxt, ch, inner, glued = follow, follow_ch[:1], follow_ch[-1:], False
    return prev, kind, before, nxt, script(ch), script(inner), glued, raw[:1].isupper()


def type_keys(c: tuple) -> tuple[str, ...]:
    """Types a mark counts for: its word, and for a letter or two, which say little alone ("lane B.", "z. B."), the word before as well."""
    plain = f"{c[0]} {c[1]}"
    return (plain, f"{c[2]} {plain}") if len(c[0]) <= 2 and not c[0].isdigit() else (plain,)


def _starts(text: str, found: list[tuple[int, int, bool]], i: int) -> tuple[str, str]:
    """First word and first characters of the block after block i ('' if none or if it is a unit)."""
    if i + 1 < len(found) and not found[i + 1][2]:
        s, e, _ = found[i + 1]
        k = s
        while k < e and text[k].isspace():
            k += 1
        first = text[k : k + 1]
        k2 = k
        while k2 < e and text[k2] in OPENERS:
            k2 += 1
        return _first_token(text, s, e), first + text[k2 : k2 + 1]
    return "", ""


def _final_mark(text: str, start: int, end: int) -> tuple[int, str] | None:
    """Begin and text of the mark that closes a block, if one does."""
    k = end
    while k > start and (text[k - 1].isspace() or text[k - 1] in CLOSERS):
        k -= 1
    tail = text[k:end].strip()
    j = k
    while j > start and text[j - 1] in MARKS:
        j -= 1
    if j < k:
        return j, text[j:k] + tail[:1]
    if k > start and text[k - 1] in ";\u037e" and is_greek_question(text, start, k - 1):
        return k - 1, ";"
    return None


def packed(c: tuple) -> str:
    return _SEP.join((*c[:6], "1" if c[6] else "", "1" if c[7] else ""))


def unpacked(text: str) -> tuple:
    p = text.split(_SEP)
    return *p[:6], p[6] == "1", p[7] == "1"


class Reading:
    """What one pass over texts finds, text behind text.

    bounds: begin and end of each block; block, stop, go, context for each
    candidate: the block it stands in (counted from the first text), where a
    sentence that ends there ends and the next begins, and what the model may
    look at (None: certain); ends: the contexts of marks at a block's end; prev,
    end, next, start: word types before any mark, at a block's end, behind a
    mark, at a block's begin.
    """

    FIELDS = ("bounds", "block", "stop", "go", "context", "ends")

    def __init__(self) -> None:
        self.bounds: list[int] = []
        self.block: list[int] = []
        self.stop: list[int] = []
        self.go: list[int] = []
        self.context: list[str | None] = []
        self.ends: list[str] = []
        self.prev: list[str] = []
        self.end: list[str] = []
        self.next: list[str] = []
        self.start: list[str] = []

    def sizes(self) -> tuple[int, int, int]:
        return len(self.bounds), len(self.block), len(self.ends)

    def read(self, text: str, with_ends: bool = True) -> "Reading":
        bounds, block, stops, gos, contexts, prev, following = self.bounds, self.block, self.stop, self.go, self.context, self.prev, self.next
        search = _HEAD.search
        base = len(bounds) // 2
        found = blocks(text)
        for i, (s, e, whole) in enumerate(found):
            head = search(text, s, e)
            bounds += (head.start() if head else s, e)
            if whole:
                continue
            if w := _first_token(text, s, e):
                self.start.append(w)
            floor = s
            for pos, mark, mark_at, sure in candidates(text, s, e):
                stop = pos
                while stop > s and text[stop - 1].isspace():
                    stop -= 1
                block.append(base + i)
                stops.append(stop)
                gos.append(search(text, pos, e).start())
                if sure:
                    contexts.append(None)
                else:
                    c = context(text, floor, e, pos, mark, mark_at)
                    contexts.append(packed(c))
                    prev += type_keys(c)
                    if c[3]:
                        following.append(c[3])
                floor = pos
            last = _final_mark(text, s, e)
            if last and last[1][0] not in WIDE:
                at = min(floor, last[0])
                if with_ends:
                    c = context(text, at, e, e, last[1], last[0], *_starts(text, found, i))
                    self.ends.append(packed(c))
                else:
                    c = words_around(text, at, e, e, last[1], last[0])
                keys = type_keys(c)
                prev += keys
                self.end += keys
        return self


def cut(bounds: np.ndarray, block: np.ndarray, stop: np.ndarray, go: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, begin, end) of every sentence: each block is cut where a candidate ends one."""
    block, stop, go = block[ends], stop[ends], go[ends]
    n = len(bounds) // 2
    first = np.arange(n) + np.concatenate(([0], np.cumsum(np.bincount(block, minlength=n))))[:n]  # of a block's sentences
    total = n + len(block)
    starts, stops, owner = np.empty(total, np.int64), np.empty(total, np.int64), np.repeat(np.arange(n), np.bincount(block, minlength=n) + 1)
    inner = np.arange(len(block)) + block  # the sentence a candidate ends
    starts[first] = bounds[0::2]
    starts[inner + 1] = go
    stops[inner] = stop
    stops[np.concatenate((first[1:], [total]))[:n] - 1] = bounds[1::2]
    some = stops > starts
    return owner[some], starts[some], stops[some]


_READ = "doc_id long, sampled boolean, bounds array<long>, block array<int>, stop array<long>, go array<long>, context array<string>, ends array<string>, kind int, hashes array<long>, ns array<long>, ms array<long>"
_NAMES = [f.split()[0] for f in _READ.split(", ")]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task body: doc_id, text, sampled -> a row a document, and rows of word counts in which kind is 0 (before marks) or 1 (behind them)."""
    seen = {what: Counter() for what in ("prev", "end", "next", "start")}

    def flush() -> Iterator[pa.RecordBatch]:
        for kind, (many, edge) in enumerate((("prev", "end"), ("next", "start"))):
            n, m = seen[many], seen[edge]
            words = [*n, *(w for w in m if w not in n)]
            if words:
                h = np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words)).view(np.int64)
                none = [pa.nulls(1, t) for t in (pa.int64(), pa.bool_(), *[pa.list_(x) for x in (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string())])]
                counts = [pa.array([v], pa.list_(pa.int64())) for v in (h, [n[w] for w in words], [m[w] for w in words])]
                yield pa.RecordBatch.from_arrays([*none, pa.array([kind], pa.int32()), *counts], _NAMES)
            n.clear()
            m.clear()

    for b in batches:
        for at in range(0, b.num_rows, 512):
            part = b.slice(at, 512)
            r, sizes = Reading(), [(0, 0, 0)]
            for text, sampled in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                if text:
                    r.read(text, sampled)
                sizes.append(r.sizes())
            for what, counter in seen.items():
                counter.update(getattr(r, what))
            n = part.num_rows
            offsets = [pa.array(x, pa.int32()) for x in zip(*sizes)]
            # Blocks are counted from each document's first one.
            block = np.array(r.block, np.int64) - np.repeat(np.array([x[0] for x in sizes[:-1]], np.int64) // 2, np.diff([x[1] for x in sizes]))
            values = [pa.array(r.bounds, pa.int64()), pa.array(block.astype(np.int32)), pa.array(r.stop, pa.int64()), pa.array(r.go, pa.int64()), strings(r.context), strings(r.ends)]
            got = [pa.ListArray.from_arrays(offsets[k], v) for k, v in zip((0, 1, 1, 1, 1, 2), values)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *got, pa.nulls(n, pa.int32()), *[pa.nulls(n, pa.list_(pa.int64()))] * 3], _NAMES)
        if sum(map(len, seen.values())) > 200_000:
            yield from flush()
    yield from flush()


#: Names of the levels of a word type, by the number the sketch holds.
_LEVELS = (None, "0-few", "0-many", "1-rare", "2-some", "3-often")


class Evidence:
    """How often word types stand at a block's edge, from a sketch of one byte a cell: magnitude of the count and level.

    ``prev``: word and mark (times before a mark, times at a block's end);
    ``next``: word (times behind a mark, times at a block's begin).
    """

    def __init__(self, prev: bytes | None = None, next: bytes | None = None) -> None:
        none = bytes(SKETCH_ROWS * CELLS)
        self.prev, self.next = prev or none, next or none

    @staticmethod
    def level(table: bytes, word: str) -> str | None:
        """Share of edge sightings, in steps; zero says more the more often a type was seen; None: hardly ever seen."""
        h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        a, b = table[h & (CELLS - 1)], table[CELLS + ((h >> 32) & (CELLS - 1))]
        return _LEVELS[(a if a >> 3 <= b >> 3 else b) & 7] if a and b else None

    def before_mark(self, c: tuple) -> str | None:
        """The level of the most specific known type of a mark's word."""
        for key in reversed(type_keys(c)):
            if found := self.level(self.prev, key):
                return found
        return None

    def features(self, c: tuple) -> tuple:
        prev, kind, before, nxt, ch, inner, glued, capital = c
        bare = prev.rstrip(".")
        key = plain = f"{prev} {kind}"
        level = None
        if len(prev) <= 2 and not prev.isdigit():
            key = f"{before} {plain}"
            level = self.level(self.prev, key)
        if level is None:
            key, level = plain, self.level(self.prev, plain)
        after = self.level(self.next, nxt) if nxt else None
        size = len(bare)
        number = "num" if bare[-1:].isdigit() else "letter" if size == 1 else "dots" if "." in bare else "word"
        known = kind[0] == "." and bare in ABBREVIATIONS
        return (
            kind, level or "new", after or ("none" if not nxt else "new"), key if level and (known or number != "num") else "", nxt if after else "", number, known, ch, inner, glued,
            size if size < 5 else 5, capital, before if len(before) <= 3 or self.level(self.next, before) or self.level(self.prev, f"{before.rstrip('.')} .") else "",
        )

    def label(self, c: tuple, at_end: bool) -> int:
        """1 reliable boundary, 0 reliable non-boundary, -1 unknown."""
        if at_end:
            return 1
        pn = self.before_mark(c)
        nn = self.level(self.next, c[3]) if c[3] else None
        if pn == "0-many" and not c[0][-1:].isdigit() or nn == "0-many":
            return 0
        if c[0].rstrip(".") in ABBREVIATIONS and c[1] == "." and (not pn or pn[0] == "0"):
            return 0
        return 1 if pn == nn == "3-often" else -1


def expand(f: tuple) -> list[tuple]:
    """Model features of a feature tuple: its parts and the conjunctions that matter."""
    kind, pl, nl, prev, nxt, number, known, ch, inner, glued, length, capital, before = f
    return [
        ("bias",), ("kind", kind), ("pl", pl), ("nl", nl), ("prev", prev, kind), ("next", nxt), ("num", number, kind), ("abb", known, pl), ("ch", ch, inner), ("glued", glued, ch, kind), ("len", length, number), ("cap", capital, number),
        ("before", before, number), ("pl-nl", pl, nl, kind), ("abb-ch", known, ch, number), ("num-nl", number, nl), ("kind-ch", kind, ch), ("kind-nl", kind, nl), ("prev-nl", prev, nl), ("before-next", before if number == "num" else "", nl),
    ]


def prior(k: tuple) -> float:
    """Weight a feature starts from, and is drawn to while evidence is scarce: a small letter goes on, an abbreviation too."""
    if k[0] == "kind-ch" and len(k[1]) > 1:
        if k[2] in ("lower", "LOWER"):
            return -2.0
        if k[2] in ("arab", "hang", "deva") and k[1][-1] in CLOSERS:
            return -1.5
        return -1.0 if k[1] == "..." and k[2] == "hang" else 0.0
    return -0.7 if k[0] == "abb" and k[1] else 0.0


class MaxEnt:
    """Logistic regression over sparse features, by averaged Adagrad with a Gaussian prior."""

    def __init__(self) -> None:
        self.index: dict[tuple, int] = {}
        self.w = np.zeros(0)

    def fit(self, rows: list[tuple[tuple, int, int]], updates: int = 1500, l2: float = 1e-5, seed: int = 7) -> "MaxEnt":
        """rows: (feature tuple, label, count). Counts weigh in by their square root, so templates do not drown rare cases."""
        if not rows:
            return self
        xs = []
        for f, _, _ in rows:
            xs.append([self.index.setdefault(k, len(self.index)) for k in expand(f)])
        x = np.array(xs, np.int64)
        y = np.array([r[1] for r in rows], float)
        c = np.sqrt(np.array([r[2] for r in rows], float))
        c /= c.mean()
        start = np.array([prior(k) for k in self.index])
        w, g2 = start.copy(), np.full(len(self.index), 1e-2)
        mean = np.zeros_like(w)
        rng = np.random.default_rng(seed)
        seen = 0
        epochs = max(12, -(-updates * 256 // len(rows)))
        for epoch in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), 256):
                k = order[at : at + 256]
                p = 1 / (1 + np.exp(-np.clip(w[x[k]].sum(1), -30, 30)))
                err = ((p - y[k]) * c[k])[:, None].repeat(x.shape[1], 1)
                g = np.bincount(x[k].ravel(), err.ravel(), len(w)) / len(k) + l2 * (w - start)
                g2 += g * g
                w -= 0.2 * g / np.sqrt(g2)
            if epoch >= epochs // 2:
                mean += w
                seen += 1
        self.w = mean / max(1, seen)
        return self

    @classmethod
    def of(cls, weights: list[tuple[tuple, float]]) -> "MaxEnt":
        model = cls()
        model.index = {k: i for i, (k, _) in enumerate(weights)}
        model.w = np.array([w for _, w in weights])
        return model

    def score(self, f: tuple) -> float:
        """Log-odds of a boundary."""
        return sum(self.w[i] for k in expand(f) if (i := self.index.get(k)) is not None)


class Splitter:
    """Evidence and model together: text, or what was read of it, -> sentence offsets."""

    def __init__(self, evidence: Evidence, model: MaxEnt) -> None:
        self.evidence, self.model = evidence, model
        self._known: dict[str, bool] = {}
        self._scores: dict[tuple, bool] = {}

    def ends(self, packed_context: str) -> bool:
        got = self._known.get(packed_context)
        if got is None:
            f = self.evidence.features(unpacked(packed_context))
            got = self._scores.get(f)
            if got is None:
                if len(self._scores) > 100_000:
                    self._scores.clear()
                if self.model.index:
                    got = bool(self.model.score(f) > 0)
                else:  # nothing to learn from: the plain rule
                    got = not f[6] and f[7] != "lower"
                self._scores[f] = got
            if len(self._known) > 100_000:
                self._known.clear()
            self._known[packed_context] = got
        return got

    def end_at(self, contexts: pa.Array) -> np.ndarray:
        """Which candidates end a sentence; equal contexts are judged once."""
        coded = contexts.dictionary_encode()
        judged = np.array([self.ends(c) for c in coded.dictionary.to_pylist()] + [True])  # the last: certain ones
        return judged[coded.indices.fill_null(len(judged) - 1).to_numpy()]

    def split(self, text: str) -> list[tuple[int, int]]:
        r = Reading().read(text, False)
        _, starts, ends = cut(*(np.array(x, np.int64) for x in (r.bounds, r.block, r.stop, r.go)), self.end_at(strings(r.context)))
        return list(zip(starts.tolist(), ends.tolist()))


def read_marks(documents: DataFrame, most_documents: int = TRAINING_DOCUMENTS) -> DataFrame:
    """The table of step 2 and 3 over all documents: candidates with their contexts, and word counts.

    ``sampled`` marks a hash sample of at most about ``most_documents`` documents, which the classifier may learn from.
    """
    share = max(1, documents.count() // most_documents)
    source = documents.select("doc_id", "text", (F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0).alias("sampled"))
    return materialize(source.mapInArrow(_read, _READ), "marks")


def gather_evidence(marks: DataFrame) -> Evidence:
    """The sketches of word counts over all documents, summed cell by cell; SKETCH_ROWS x CELLS bytes a table come to the driver."""
    each = marks.where(F.col("kind").isNotNull()).select("kind", F.explode(F.arrays_zip("hashes", "ns", "ms")).alias("x"))
    h, mask = F.col("x.hashes"), F.lit(CELLS - 1)
    cells = F.array(h.bitwiseAND(mask), F.shiftrightunsigned(h, 32).bitwiseAND(mask) + CELLS)
    sums = each.select((F.col("kind") * (SKETCH_ROWS * CELLS)).cast("long").alias("base"), F.explode(cells).alias("cell"), F.col("x.ns").alias("n"), F.col("x.ms").alias("m"))
    sums = sums.groupBy((F.col("base") + F.col("cell")).alias("at")).agg(F.sum("n").alias("n"), F.sum("m").alias("m")).where(F.col("n") >= LEAST_SEEN)
    share = F.col("m") / F.col("n")
    level = F.when(F.col("m") == 0, F.when(F.col("n") >= SURE_AFTER, 2).otherwise(1)).when(share < 0.04, 3).when(share < 0.12, 4).otherwise(5)
    coded = sums.select("at", (F.least(F.floor(F.log2("n")) + 1, F.lit(31)) * 8 + level).cast("int").alias("code"))
    slice_bytes = 1 << 15

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            at, code = b.column(0).to_numpy(), b.column(1).to_numpy()
            for part in np.unique(at // slice_bytes).tolist():
                mine = at // slice_bytes == part
                held.setdefault(part, np.zeros(slice_bytes, np.uint8))[at[mine] % slice_bytes] = code[mine]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([v.tobytes() for v in held.values()], pa.binary())], ["part", "codes"])

    table = np.zeros(2 * SKETCH_ROWS * CELLS, np.uint8)
    for part, codes in coded.repartition(F.floor(F.col("at") / slice_bytes)).mapInArrow(pack, "part long, codes binary").collect():
        table[part * slice_bytes : (part + 1) * slice_bytes] = np.frombuffer(codes, np.uint8)
    return Evidence(table[: SKETCH_ROWS * CELLS].tobytes(), table[SKETCH_ROWS * CELLS :].tobytes())


def train(marks: DataFrame, evidence: Evidence, most_rows: int = TRAINING_ROWS) -> MaxEnt:
    """The classifier, fitted to the ``most_rows`` most frequent labelled rows of the sampled documents."""
    held = marks.sparkSession.sparkContext.broadcast(evidence)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ev = held.value
        contexts: Counter = Counter()
        for b in batches:
            for k in (0, 1):
                contexts.update((c, k) for c in b.column(k).flatten().to_pylist() if c is not None)
        seen: Counter = Counter()
        for (text, at_end), n in contexts.items():
            c = unpacked(text)
            y = ev.label(c, bool(at_end))
            if y >= 0:
                seen[repr(ev.features(c)), y] += n
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen]), pa.array([k[1] for k in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], ["f", "y", "n"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))]
        model = MaxEnt().fit([(ast.literal_eval(f), y, n) for f, y, n in sorted(rows, key=lambda r: (-r[2], r[0], r[1]))])
        yield pa.RecordBatch.from_arrays([pa.array([repr(k) for k in model.index], pa.string()), pa.array(model.w, pa.float64())], ["feature", "weight"])

    labelled = marks.where("sampled and kind is null").select("context", "ends").mapInArrow(run, "f string, y int, n long").groupBy("f", "y").agg(F.sum("n").alias("n"))
    # One task fits the model to its bounded number of rows; the driver gets the weights.
    weights = labelled.orderBy(F.desc("n"), "f", "y").limit(most_rows).coalesce(1).mapInArrow(fit, "feature string, weight double").collect()
    return MaxEnt.of([(ast.literal_eval(k), w) for k, w in weights])


def sentences(documents: DataFrame) -> DataFrame:
    """doc_id, sent_start, sent_end (code points from 0, end exclusive, no outer white space) of all documents.

    Null, empty and blank texts have no sentences; an empty table gives no rows.
    Every document is split on its own, whatever its language column says, so
    repeated texts and ids give repeated rows; whole texts are read, however
    long. All text but white space lies in exactly one sentence. Further columns
    are ignored.
    """
    marks = read_marks(documents)
    evidence = gather_evidence(marks)
    splitter = documents.sparkSession.sparkContext.broadcast(Splitter(evidence, train(marks, evidence)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp: Any = splitter.value
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                n = part.num_rows
                bounds, block, stop, go = (part.column(k).flatten().to_numpy() for k in range(1, 5))
                n_blocks = part.column(1).value_lengths().to_numpy() // 2
                first = np.concatenate(([0], np.cumsum(n_blocks)))
                block = block + np.repeat(first[:-1], part.column(2).value_lengths().to_numpy())
                owner, starts, ends = cut(bounds, block, stop, go, sp.end_at(part.column(5).flatten()))
                doc = np.repeat(np.arange(n), n_blocks)[owner]
                off = pa.array(np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=n)))), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(off, pa.array(starts)), pa.ListArray.from_arrays(off, pa.array(ends))], ["doc_id", "starts", "ends"])

    rows = marks.where("kind is null").select("doc_id", "bounds", "block", "stop", "go", "context").mapInArrow(run, "doc_id long, starts array<long>, ends array<long>")
    return rows.select("doc_id", F.explode(F.arrays_zip("starts", "ends")).alias("s")).select("doc_id", F.col("s.starts").alias("sent_start"), F.col("s.ends").alias("sent_end"))


def coverage(documents: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, n_chars (other than white space), n_outside of any sentence, n_faulty: empty, overlapping or out of the text, or with white space at an end."""
    spans = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sent_start", "sent_end"))).alias("spans"))  # the sentences of one text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            chars, outside, faulty = [], [], []
            for text, ss in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                held = at = bad = 0
                for s in ss or ():
                    i, j = s["sent_start"], s["sent_end"]
                    part = text[i:j]
                    bad += not part or i < at or j > len(text) or part != part.strip()
                    held += len("".join(part.split()))
                    at = max(at, j)
                chars.append(len("".join(text.split())))
                outside.append(chars[-1] - held)
                faulty.append(bad)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(chars, pa.int64()), pa.array(outside, pa.int64()), pa.array(faulty, pa.int64())], ["doc_id", "n_chars", "n_outside", "n_faulty"])

    whole = documents.select("doc_id", "text").where(F.col("text").isNotNull()).join(spans.hint("merge"), "doc_id", "left")
    return whole.mapInArrow(run, "doc_id long, n_chars long, n_outside long, n_faulty long").where(F.col("n_chars") > 0)
