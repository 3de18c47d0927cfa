"""Evaluation passages inside a training corpus, found by template windows and slot consistency.

Texts are turned into tokens without markup. Numbers, names and units become typed placeholders
(slots); what remains is the template. Windows of ``WINDOW`` template tokens of all documents are
hash-joined with those of the evaluation items. A match counts if its slots carry the item's own
values; a window without a slot is a stock phrase and counts for nothing. The share of an item's
words under such windows makes a pair a candidate. An alignment of the item's sentences with the
document then decides, so that changed words, spelling, layout and the order of sentences do not
matter. Where instead a long template matches with other values, and every slot of the item is
replaced by one and the same value throughout, the pair is a re-parameterised copy.

The items are a stated query set. Which words are template and which are names is counted over all items
once. They are then indexed in blocks of about ``BLOCK_TOKENS`` tokens; each block is sent to the executors,
indexed once per worker and joined against all documents, one Arrow batch at a time, so nothing is shuffled
and a hot document or page does no harm. The result does not depend on the size of the blocks.

Defined cases: null and empty texts or items hold nothing; repeated documents are reported each;
repeated items are reported each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html
import re
import unicodedata
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderbase.session import ship

WINDOW, LONG_WINDOW = 6, 12
CANDIDATE_SHARE, HELD_SHARE, SENTENCE_SHARE = 0.10, 0.33, 0.6
WINDOW_SHARE, WINDOW_HELD = 0.38, 0.15
LEAKED = f"kind = 'verbatim' AND (held_share >= {HELD_SHARE} OR (window_share >= {WINDOW_SHARE} AND held_share >= {WINDOW_HELD}))"
REPARAMETERISED_SLOTS, REPARAMETERISED_SHARE = 6, 0.6
BLOCK_TOKENS = 2_000_000
#: A token that begins in capitals in at least so many items is no name but a sentence's first word.
COMMON_IN_ITEMS = 6

# Units of measure in four languages.
UNITS = frozenset(
    "metre metres meter meters kilometre kilometres kilometer kilometers mile miles acre acres hectare hectares tonne tonnes ton tons barrel barrels "
    "step steps household households foot feet yard yards gram grams kilogram kilograms litre litres liter liters hour hours day days year years percent "
    "hektar tonnen fässer fass schritte haushalte kilogramm stunden tage jahre prozent mètre mètres kilomètre kilomètres tonneau tonneaux pas foyer foyers "
    "heure heures jour jours an ans metro metros kilómetro kilómetros hectárea hectáreas tonelada toneladas barril barriles paso pasos hogar hogares hora horas día días año años".split()
)
TOKEN = re.compile(r"[^\W\d_]+|\d+")
MARKUP = re.compile(r"<ref[^<>]*/>|<ref.*?</ref>|<!--.*?-->|\[https?://\S+|https?://\S+|\[\[[^\[\]|\n]*\||</?\w[^<>]*>", re.S)
SENTENCE = re.compile(r"(?<=[.!?])\s+")
NUMBER, NAME, UNIT = 1, 2, 3
BASE = np.uint64(0x9E3779B97F4A7C15)


INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
SPLIT_WORD = re.compile(r"(?<=[^\W\d_])-\n\s*(?=[^\W\d_])")


def words(text: str) -> list[str]:
    """The words and numbers of a text in lower case, without markup, entities and invisible characters."""
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    if "-\n" in text:
        text = SPLIT_WORD.sub("", text)
    if "<" in text or "http" in text or "|" in text:
        text = MARKUP.sub(" ", text)
    return TOKEN.findall(text.lower())


def _window_hashes(canon: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros(max(0, len(canon) - width + 1), dtype=np.uint64)
    c = canon.astype(np.uint64)
    for k in range(width):
        out = out * BASE + (c[k : k + len(out)] + np.uint64(7)) * np.uint64(0xC2B2AE3D27D4EB4F)
        out ^= out >> np.uint64(29)
    return out


def item_words(text: str) -> set[tuple[str, bool]]:
    """Each word of an item in lower case, and whether it stands there in lower case."""
    raw = set(TOKEN.findall(MARKUP.sub(" ", text)))
    low = {w for w in raw if w.islower()}
    return {(w, w in low) for w in {x.lower() for x in raw if not x.isdigit()}}


def template_words(items: DataFrame) -> list[str]:
    """Words that some item has in lower case, or many items have; counted over all items."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [pair for t in pdf["item_text"] for pair in item_words(t)]
            yield pd.DataFrame(rows, columns=["word", "low"])

    words = items.select("item_text").mapInPandas(split, "word string, low boolean").groupBy("word").agg(F.count("*").alias("n"), F.max("low").alias("low"))
    return [r[0] for r in words.where(F.col("low") | (F.col("n") >= COMMON_IN_ITEMS)).select("word").collect()]


class ItemIndex:
    """Template windows of a block of items; ``template`` has the template words of all items."""

    def __init__(self, items: list[tuple[int, str]], template: list[str] | None = None):
        self.ids = [i for i, _ in items]
        raw = [TOKEN.findall(MARKUP.sub(" ", t)) for _, t in items]
        if template is None:
            counts = Counter(w for _, t in items for w, _ in item_words(t))
            low = {w for _, t in items for w, is_low in item_words(t) if is_low}
            template = [w for w, n in counts.items() if w in low or n >= COMMON_IN_ITEMS]
        self.codes: dict[str, int] = {w: 16 + k for k, w in enumerate(sorted(template))}
        self.words = [[w.lower() for w in ws] for ws in raw]
        self.sentences = [[words(s) for s in SENTENCE.split(t) if words(s)] for _, t in items]
        self.lengths = np.array([max(1, len(ws)) for ws in self.words])
        self.memo = self._fresh()
        packed = [np.fromiter(map(self.memo.__getitem__, ws), np.int64, len(ws)) for ws in self.words]
        self.owner = np.concatenate([np.full(len(p) + LONG_WINDOW, k) for k, p in enumerate(packed)] or [np.zeros(0, int)]).astype(np.int64)
        gap = np.full(LONG_WINDOW, -1, np.int64)
        flat = np.concatenate([np.concatenate([p, gap]) for p in packed] or [np.zeros(0, np.int64)])
        self.canon, self.value = _unpack(flat)
        self.tables = {w: self._table(w) for w in (WINDOW, LONG_WINDOW)}

    def _fresh(self) -> "_Memo":
        return _Memo(self.codes)

    def _table(self, width: int) -> tuple:
        h = _window_hashes(self.canon, width)
        slots = sum((self.canon[k : k + len(h)] <= UNIT).astype(int) * (self.canon[k : k + len(h)] > 0) for k in range(width)) if len(h) else np.zeros(0, int)
        clean = np.ones(len(h), bool)
        for k in range(width):
            clean &= self.canon[k : k + len(h)] > 0
        at = np.flatnonzero(clean & (slots > 0))
        order = at[np.argsort(h[at], kind="stable")]
        keys, start, count = np.unique(h[order], return_index=True, return_counts=True)
        bloom = np.zeros(1 << 22, bool)
        bloom[(keys >> np.uint64(42)).astype(np.int64)] = True
        return keys, start, count, order, slots, bloom

    def matches(self, canon: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions in the documents and in the items where template windows are equal."""
        keys, start, count, order, _, bloom = self.tables[width]
        h = _window_hashes(canon, width)
        if not len(keys) or not len(h):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(bloom[(h >> np.uint64(42)).astype(np.int64)])
        k = np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)
        hit = keys[k] == h[at]
        at, k = at[hit], k[hit]
        n = count[k]
        doc_pos = np.repeat(at, n)
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return doc_pos, order[np.repeat(start[k], n) + offset]


class _Memo(dict):
    """Token to its value and template code, packed in one number."""

    def __init__(self, codes: dict[str, int]):
        super().__init__()
        self.codes = codes

    def __missing__(self, w: str) -> int:
        code = NUMBER if w.isdigit() else UNIT if w in UNITS else self.codes.get(w, NAME)
        packed = (zlib.crc32(w.encode()) << 24) | code
        if len(self) < 1_000_000:
            self[w] = packed
        return packed


def _unpack(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    gap = flat < 0
    return np.where(gap, 0, flat & 0xFFFFFF), np.where(gap, -1, flat >> 24)


def _alike(a: str, b: str) -> bool:
    """Equal, or one spelling slip apart (a changed, left-out, added or swapped letter)."""
    if a == b:
        return True
    if len(a) < 4 or abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    rest_a, rest_b = a[k:], b[k:]
    return rest_a[1:] == rest_b[1:] or rest_a[1:] == rest_b or rest_a == rest_b[1:] or (rest_a[2:] == rest_b[2:] and rest_a[:2] == rest_b[:2][::-1])


def _common(a: list[str], b: list[str]) -> list[int]:
    """Positions in ``a`` of a longest common subsequence with ``b``."""
    rows = [[0] * (len(b) + 1)]
    for x in a:
        prev, cur = rows[-1], [0]
        for j, y in enumerate(b):
            cur.append(prev[j] + 1 if x == y or (x[:1] == y[:1] and _alike(x, y)) else max(prev[j + 1], cur[j]))
        rows.append(cur)
    i, j, out = len(a), len(b), []
    while i and j:
        if rows[i][j] == rows[i - 1][j]:
            i -= 1
        elif rows[i][j] == rows[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append(i)
    return out[::-1]


def held_share(sentences: list[list[str]], doc: list[str], code) -> float:
    """The share of an item's words that the document holds, by sentences that agree in words and slots.

    ``code`` gives a word's template code. A place in the document where fewer than three tenths of a
    sentence's names and numbers stand cannot agree in slots and is not aligned.
    """
    where: dict[tuple[str, str], list[int]] = {}
    for k in range(len(doc) - 1):
        where.setdefault((doc[k], doc[k + 1]), []).append(k)
    total, held = sum(map(len, sentences)), 0
    for s in sentences:
        codes = [code(w) for w in s]
        slots = [k for k, c in enumerate(codes) if c <= UNIT]
        strong = {w for w, c in zip(s, codes) if c in (NUMBER, NAME)}
        votes: Counter = Counter()
        for k in range(len(s) - 1):
            for p in where.get((s[k], s[k + 1]), ()):
                votes[(p - k) // 3] += 1
        best = 0
        for diagonal, _ in votes.most_common():
            if best == len(s):
                break
            low = max(0, diagonal * 3 - 3)
            near = doc[low : diagonal * 3 + len(s) + 6]
            if strong and len(strong.intersection(near)) < max(1, 0.3 * len(strong)):
                continue
            found = _common(s, near)
            right = sum(k in set(found) for k in slots)
            # a sentence of the same template with other values is a stock phrase; so is one of few slots with a chance value
            partial = len(found) >= 6 and max(found) - min(found) + 1 <= len(found) * 1.3
            inside = [k for k in slots if found and min(found) <= k <= max(found)]
            whole = len(found) >= SENTENCE_SHARE * len(s) and right >= 0.6 * len(slots)
            part = partial and len(inside) >= 2 and sum(k in set(found) for k in inside) >= 0.8 * len(inside)
            if whole or part:
                best = max(best, len(found))
        held += best
    return held / max(1, total)


def _scan(index: ItemIndex, batches: Iterator[pd.DataFrame], reparameterised: bool) -> Iterator[pd.DataFrame]:
    gap = [-1] * LONG_WINDOW
    for pdf in batches:
        flat: list[int] = []
        starts, docs = [], []
        get = index.memo.__getitem__
        for text in pdf["text"]:
            ws = words(text) if isinstance(text, str) else []
            docs.append(ws)
            starts.append(len(flat))
            flat.extend(map(get, ws))
            flat.extend(gap)
        canon, value = _unpack(np.array(flat, np.int64))
        starts_ = np.array(starts)
        doc_pos, item_pos = index.matches(canon, WINDOW)
        slots = np.zeros(len(doc_pos), int)
        equal = np.zeros(len(doc_pos), int)
        for k in range(WINDOW):
            slot = index.canon[item_pos + k] <= UNIT
            slots += slot
            equal += slot & (value[doc_pos + k] == index.value[item_pos + k])
        good = (equal == slots) | ((slots >= 3) & (equal >= slots - 1))
        doc_pos, item_pos = doc_pos[good], item_pos[good]
        doc = np.searchsorted(starts_, doc_pos, side="right") - 1
        out = []
        if len(doc):
            cover = np.unique(((doc * len(index.owner))[:, None] + item_pos[:, None] + np.arange(WINDOW)).ravel())
            pair = (cover // len(index.owner)) * len(index.ids) + index.owner[cover % len(index.owner)]
            pairs, n = np.unique(pair, return_counts=True)
            share = n / index.lengths[pairs % len(index.ids)]
            for p, s in zip(pairs[share >= CANDIDATE_SHARE], share[share >= CANDIDATE_SHARE]):
                d, i = divmod(int(p), len(index.ids))
                held = held_share(index.sentences[i], docs[d], lambda w: index.memo[w] & 0xFFFFFF)
                out.append((index.ids[i], pdf["doc_id"].iloc[d], "verbatim", float(s), held))
        if reparameterised:
            out.extend((i, pdf["doc_id"].iloc[d], "reparameterised", s, 0.0) for d, i, s in _remapped(index, canon, value, starts_))
        yield pd.DataFrame(out, columns=["item_id", "doc_id", "kind", "window_share", "held_share"])


def _remapped(index: ItemIndex, canon: np.ndarray, value: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, float]]:
    """Pairs whose long templates match under one consistent replacement of the item's values."""
    doc_pos, item_pos = index.matches(canon, LONG_WINDOW)
    if not len(doc_pos):
        return []
    doc = np.searchsorted(starts, doc_pos, side="right") - 1
    pair = doc * len(index.ids) + index.owner[item_pos]
    at = (item_pos[:, None] + np.arange(LONG_WINDOW)).ravel()
    to = (doc_pos[:, None] + np.arange(LONG_WINDOW)).ravel()
    frame = pd.DataFrame({"pair": np.repeat(pair, LONG_WINDOW), "at": at, "old": index.value[at], "new": value[to], "slot": index.canon[at] <= UNIT})
    cover = frame.groupby("pair")["at"].nunique()
    maps = frame[frame["slot"]].drop_duplicates(["pair", "old", "new"]).groupby("pair").agg(olds=("old", "nunique"), news=("new", "nunique"), n=("old", "size"), same=("old", "size"))
    changed = frame[frame["slot"] & (frame["old"] != frame["new"])].groupby("pair")["old"].nunique()
    out = []
    for p, row in maps.iterrows():
        d, i = divmod(int(p), len(index.ids))
        share = cover[p] / index.lengths[i]
        if row.n == row.olds == row.news and row.olds >= REPARAMETERISED_SLOTS and changed.get(p, 0) >= 2 and share >= REPARAMETERISED_SHARE:
            out.append((d, index.ids[i], float(share)))
    return out


#: The index of each block in this worker, by a name drawn for the block.
_INDEXES: dict[str, ItemIndex] = {}
SCHEMA = "item_id long, doc_id long, kind string, window_share double, held_share double"


def find_leaks(documents: DataFrame, items: DataFrame, reparameterised: bool = True) -> DataFrame:
    """``item_id, doc_id, kind, window_share, held_share`` of all candidate pairs."""
    spark = documents.sparkSession
    ship(spark)
    held = items.select("item_id", "item_text").where(F.length("item_text") > 0)
    size = held.agg(F.sum(F.floor(F.length("item_text") / 4) + LONG_WINDOW)).first()[0] or 0
    template = spark.sparkContext.broadcast(template_words(held))
    docs = documents.select("doc_id", "text").where("text IS NOT NULL")
    n_blocks = max(1, -(-size // BLOCK_TOKENS))
    found = None
    for k in range(n_blocks):
        block = held.where(F.pmod(F.xxhash64("item_id", "item_text"), F.lit(n_blocks)) == k).orderBy("item_id", "item_text")
        sent = spark.sparkContext.broadcast([(r[0], r[1]) for r in block.collect()])  # about BLOCK_TOKENS tokens

        def scan(batches: Iterator[pd.DataFrame], sent=sent, key=uuid.uuid4().hex) -> Iterator[pd.DataFrame]:
            if key not in _INDEXES:
                _INDEXES.clear()
                _INDEXES[key] = ItemIndex(sent.value, template.value)
            return _scan(_INDEXES[key], batches, reparameterised)

        one = docs.mapInPandas(scan, SCHEMA)
        found = one if found is None else found.unionByName(one)
    return found


def leaked(found: DataFrame) -> DataFrame:
    """The pairs whose document holds the item: by alignment, or by windows where sentences were cut apart.

    An item counts from two fifths of its words; the threshold is lower by what changed words and
    spelling cost on average. Windows alone do not count, since chance values add up in items of very
    common templates; at least one sentence or part of one must be aligned. A re-parameterised copy holds
    all the words of the template and counts as well.
    """
    return found.where(f"({LEAKED}) OR kind = 'reparameterised'")
