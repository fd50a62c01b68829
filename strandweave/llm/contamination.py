"""Passages of evaluation texts inside documents: q-gram counts, pairs of words in diagonal bands, then banded alignment."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import cut, partitions, table

#: Escapes that stand for white space or punctuation, and letters by their number.
ESCAPES = re.compile(r"\\(?:u(?:00[0-7]|20[0-6]|00a)[0-9a-fA-F]|[nrtbf\"'/\\])|&(?:quot|apos|amp|lt|gt|nbsp|#\d{2,4}|#x[0-9a-fA-F]{2,4});|%[0-7][0-9A-F]")
NO_WIDTH = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
BLANK = re.compile("[\u0080-\u00a9\u00ab-\u00b4\u00b6-\u00b9\u00bb-\u00bf\u2000-\u206f\u3000-\u303f]")

#: Six bits a letter: 1..36 for digits and letters, 37..62 for parts of letters outside ASCII, 0 for all that separates.
LETTER = np.zeros(256, np.uint8)
LETTER[[ord(c) for c in "0123456789abcdefghijklmnopqrstuvwxyz"]] = np.arange(1, 37)
LETTER[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = np.arange(11, 37)
LETTER[128:] = 37 + np.arange(128) % 26

Q = 8
BLOOM_BITS = 22
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Words by which a band of alignment reaches beyond its diagonal on either side.
WIDTH = 24


@dataclass(frozen=True)
class Rule:
    """When a document carries an item: the share of the item's words, the least words of a stretch, and the part of the
    words that may be edited; the stretches together need ``proofs`` different words that at most a part ``rare`` of all items
    has (or as many as the item has), since items made from one template agree in the rest."""

    share: float = 1 / 3
    stretch: int = 10
    edits: float = 0.25
    band: int = 64
    rare: float = 0.05
    proofs: int = 2


def plain(text: str) -> bytes:
    """A text with compatibility forms folded (wide letters, ligatures, no-break spaces), marks of no width taken out, and
    escapes, spaces and punctuation outside ASCII made blanks."""
    if not text.isascii():
        text = BLANK.sub(" ", NO_WIDTH.sub("", unicodedata.normalize("NFKC", text)))
    if "\\" in text or "&" in text or "%" in text:
        text = ESCAPES.sub(" ", text)
    return text.encode("utf-8", "replace")


def grams(letters: np.ndarray) -> np.ndarray:
    """The exact codes of all runs of Q = 8 letters."""
    if len(letters) < Q:
        return np.empty(0, np.uint64)
    c = letters.astype(np.uint64)
    two = c[:-1] | c[1:] << np.uint64(6)
    four = two[:-2] | two[2:] << np.uint64(12)
    return four[:-4] | four[4:] << np.uint64(24)


def words_of(text: bytes) -> list[bytes]:
    """The words of a ``plain`` text in lower case: runs of letters and digits."""
    return re.findall(rb"[0-9a-z\x80-\xff]+", text.lower())


class Index:
    """The q-grams of a block of items, and for each item its words and what of them counts.

    Sentences that several items share are instructions; their words don't count as carried on their own.
    """

    def __init__(self, items: list[tuple[int, str]], rule: Rule, common: set[bytes], frequent: set[bytes], bounds: list[int] | None = None):
        self.rule, self.ids = rule, np.array([i for i, _ in items], np.int64)
        codes, owner, at = [], [], []
        self.words: list[list[bytes]] = []
        self.own: list[np.ndarray] = []
        self.proof: list[np.ndarray] = []
        self.total = np.zeros(len(items), np.int64)
        self.vocabulary: dict[bytes, int] = {}
        for k, (_, text) in enumerate(items):
            words = words_of(plain(text))
            own = np.concatenate([np.full(len(w), b"".join(w) not in common) for w in sentences(text)] or [np.zeros(0, bool)])
            letters = LETTER[np.frombuffer(b"".join(words), np.uint8)]
            g = grams(letters)
            codes.append(g)
            owner.append(np.full(len(g), k))
            at.append(np.arange(len(g)))
            self.words.append(words)
            self.own.append(own)
            self.proof.append(np.array([w not in frequent for w in words], bool))
            self.total[k] = bounds[k] if bounds else least_grams([len(w) for w in words], rule)
            for w in words:
                self.vocabulary.setdefault(w, len(self.vocabulary))
        codes_, owner_, at_ = np.concatenate(codes or [np.empty(0, np.uint64)]), np.concatenate(owner or [[]]).astype(np.int64), np.concatenate(at or [[]]).astype(np.int64)
        order = np.argsort(codes_, kind="stable")
        self.codes, first = np.unique(codes_[order], return_index=True)
        self.starts = np.r_[first, len(codes_)]
        self.owner, self.at = owner_[order], at_[order]
        self.bloom = np.zeros(1 << BLOOM_BITS, bool)
        self.bloom[(self.codes * MIX) >> np.uint64(64 - BLOOM_BITS)] = True
        self.word_ids = ids = [self.numbers(w) for w in self.words]
        codes_, owner_, at_ = (np.concatenate([np.empty(0, np.int64), *x]).astype(np.int64) for x in ([self.word_pairs(w) for w in ids], [np.full(max(0, len(w) - 1), k) for k, w in enumerate(ids)], [np.arange(len(w) - 1) for w in ids]))
        order = np.argsort(codes_, kind="stable")
        self.pair_codes, first = np.unique(codes_[order], return_index=True)
        self.pair_starts = np.r_[first, len(codes_)]
        self.pair_owner, self.pair_at = owner_[order], at_[order]
        distinct = [np.unique(w[p & o]) for w, p, o in zip(ids, self.proof, self.own)]
        self.needed = np.array([min(rule.proofs, len(w)) for w in distinct], np.int64)
        word, self.proof_owner = (np.concatenate([np.empty(0, np.int64), *x]).astype(np.int64) for x in (distinct, [np.full(len(w), k) for k, w in enumerate(distinct)]))
        order = np.argsort(word, kind="stable")
        self.proof_owner = self.proof_owner[order]
        self.proof_starts = np.searchsorted(word[order], np.arange(len(self.vocabulary) + 1))


    def hits(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions in ``g`` with the items and item positions that have the same gram."""
        near = np.flatnonzero(self.bloom[(g * MIX) >> np.uint64(64 - BLOOM_BITS)])
        if not len(near) or not len(self.codes):
            none = np.empty(0, np.int64)
            return none, none, none
        found = np.minimum(np.searchsorted(self.codes, g[near]), len(self.codes) - 1)
        same = self.codes[found] == g[near]
        near, found = near[same], found[same]
        n = self.starts[found + 1] - self.starts[found]
        slot = np.repeat(self.starts[found] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        return np.repeat(near, n), self.owner[slot], self.at[slot]

    def proven(self, words: np.ndarray, text: np.ndarray) -> np.ndarray:
        """``text * items + item``, sorted, where the text (a number for each word) has distinctive words enough of the item."""
        some = words >= 0
        one = np.unique(text[some] * len(self.vocabulary) + words[some])
        text, word = np.divmod(one, max(1, len(self.vocabulary)))
        n = self.proof_starts[word + 1] - self.proof_starts[word]
        slot = np.repeat(self.proof_starts[word] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        pairs, n = np.unique(np.repeat(text, n) * len(self.ids) + self.proof_owner[slot], return_counts=True)
        return pairs[n >= self.needed[pairs % len(self.ids)]]

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Words as numbers; -1 for those that are in no item."""
        get = self.vocabulary.get
        return np.array([get(w, -1) for w in words], np.int64)

    def word_pairs(self, words: np.ndarray) -> np.ndarray:
        """The codes of all two words in a row; -1 where one of them is in no item."""
        return np.where((words[:-1] >= 0) & (words[1:] >= 0), words[:-1] * len(self.vocabulary) + words[1:], -1)

    def word_hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions in ``words`` with the items and item positions that have the same two words in a row."""
        codes = self.word_pairs(words)
        near = np.flatnonzero(codes >= 0)
        if not len(near) or not len(self.pair_codes):
            none = np.empty(0, np.int64)
            return none, none, none
        found = np.minimum(np.searchsorted(self.pair_codes, codes[near]), len(self.pair_codes) - 1)
        same = self.pair_codes[found] == codes[near]
        near, found = near[same], found[same]
        n = self.pair_starts[found + 1] - self.pair_starts[found]
        slot = np.repeat(self.pair_starts[found] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        return np.repeat(near, n), self.pair_owner[slot], self.pair_at[slot]


#: Items of more words have no bound by grams: their documents are found by words alone.
BOUNDED_WORDS = 400


def least_grams(lengths: list[int], rule: Rule) -> int:
    """The fewest grams that a text shares with an item of words of these ``lengths`` if it carries the item: the q-gram lemma for
    what ``stretches`` accepts. A stretch of s words with e of them edited has s - e matched words and at most half of what
    these exceed ``rule.stretch`` / 2 by as breaks; it keeps at least its letters but those of its e longest words, and Q - 1
    grams fewer for each run between breaks. The item's share is put together from the stretches that keep the fewest."""
    size = len(lengths)
    if not size or size > BOUNDED_WORDS:
        return 0
    need = max(1, int(np.ceil(size * rule.share)))
    keeps = np.full((size + 1, size + 1), np.inf)  # [first word, words]
    for s in range(max(1, rule.stretch - 2), size + 1):
        # sums of the 0, 1, ... longest words of each window
        longest = np.sort(np.lib.stride_tricks.sliding_window_view(np.array(lengths), s), axis=1)[:, ::-1]
        lost = np.concatenate([np.zeros((len(longest), 1), int), np.cumsum(longest, axis=1)], axis=1)
        e = np.arange(int(s * rule.edits) + 1)
        breaks = np.floor((s - e - rule.stretch / 2) / 2).astype(int)
        e, breaks = (x[(s - e >= rule.stretch - 2) & (breaks >= e)] for x in (e, breaks))
        if len(e):
            keeps[: size - s + 1, s] = np.maximum(0, lost[:, -1:] - lost[:, e] - (breaks + 1) * (Q - 1)).min(1)
    least = np.full((size + 1, need + 1), np.inf)  # [words seen, words carried at least]
    least[:, 0] = 0
    for i in range(1, size + 1):
        s = np.arange(1, i + 1)
        before = least[(i - s)[:, None], np.maximum(0, np.arange(need + 1) - s[:, None])]
        least[i] = np.minimum(least[i - 1], (before + keeps[i - s, s][:, None]).min(0))
    return int(least[size, need]) if np.isfinite(least[size, need]) else 1 << 40


def least_pairs(rule: Rule) -> int:
    """The fewest two words in a row that a stretch has in common with its item."""
    return min(m - 1 - int(max(0, m - rule.stretch / 2) // 2) for m in range(max(1, rule.stretch - 2), rule.stretch + 2))


def sentences(text: str) -> list[list[bytes]]:
    """The words of each sentence; a sentence ends at . ? ! ; and blanks."""
    return [words_of(plain(s)) for s in re.split(r"(?<=[.?!;])\s+", text)]


def shared_sentences(texts: Iterable[str]) -> set[bytes]:
    """Sentences, as their joined words, that at least two texts have."""
    seen = Counter(b for t in texts for b in {b"".join(w) for w in sentences(t)})
    return {b for b, n in seen.items() if n > 1 and b}


def frequent_words(texts: Iterable[str], part: float) -> set[bytes]:
    """Words of more than ``part`` of the texts (and of more than one)."""
    seen: Counter = Counter()
    n = 0
    for n, t in enumerate(texts, 1):
        seen.update(set(words_of(plain(t))))
    return {w for w, k in seen.items() if k > max(1, part * n)}


def aligned(item: list[bytes], doc: list[bytes], offset: int, width: int) -> list[tuple[int, int]]:
    """Pairs of equal words of a banded global alignment by fewest edits: item word i may meet doc words from
    i + offset - width to i + offset + width."""
    if not item or not doc:
        return []
    return matched(equal_words(*numbered(item, doc), offset, width), offset - width)


def numbered(item: list[bytes], doc: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The words as numbers, equal for equal words; -1 for those that the item doesn't have."""
    names = {w: k for k, w in enumerate(dict.fromkeys(item))}
    return np.array([names[w] for w in item]), np.array([names.get(w, -1) for w in doc])


def equal_words(a: np.ndarray, b: np.ndarray, offset: int, width: int) -> np.ndarray:
    """Whether item word i is the doc word that it meets at diagonal d of the band."""
    met = np.arange(len(a))[:, None] + (offset - width) + np.arange(2 * width + 1)
    return (b[np.clip(met, 0, len(b) - 1)] == a[:, None]) & (met >= 0) & (met < len(b))


def reachable(equal: np.ndarray, own: np.ndarray, rule: Rule) -> np.ndarray:
    """Item words that a stretch in the band can hold at most: those in some part that reaches the score of ``stretches`` if each
    word that is anywhere in the band is matched."""
    score = np.r_[0, np.cumsum(np.where(equal.any(1) & own, 1, -2))]
    return np.maximum.accumulate(score[::-1])[::-1][1:] - np.minimum.accumulate(score)[:-1] >= rule.stretch / 2


def matched(equal: np.ndarray, start: int) -> list[tuple[int, int]]:
    """``aligned`` for the equal words of a band whose first diagonal is ``start``."""
    size, span = equal.shape
    low = np.full((size + 1, span + 2), -(10**6), np.int32)  # low[i, d + 1]: most matches with i item words, doc word i + start + d
    low[0, 1:-1] = 0
    for i in range(size):
        best = np.maximum(low[i, 1:-1] + equal[i], low[i, 2:])  # match or replace; item word left out
        np.maximum.accumulate(best, out=low[i + 1, 1:-1])  # doc words left out
    pairs, i = [], size
    d = int(np.argmax(low[size, 1:-1]))
    score, same = low.tolist(), equal.tolist()
    while i > 0:
        here = score[i][d + 1]
        if d > 0 and score[i][d] == here:
            d -= 1
        elif same[i - 1][d] and score[i - 1][d + 1] + 1 == here:
            i -= 1
            pairs.append((i, i + start + d))
        elif score[i - 1][d + 1] == here:
            i -= 1
        else:
            i, d = i - 1, d + 1
    return pairs[::-1]


def stretches(pairs: list[tuple[int, int]], rule: Rule) -> list[tuple[int, int]]:
    """Running text among matched words, as first and last item word. A match gains one, an edit on either side costs two;
    a stretch ends where more than three words in a row are edited or the score has fallen by eight from its best.
    It counts with about ``rule.stretch`` words, a score of at least half of that and at most ``rule.edits`` edited."""
    out: list[tuple[int, int]] = []
    k = 0
    while k < len(pairs):
        start, score, best, end = k, 1, 1, k
        for k in range(start + 1, len(pairs)):
            gap = max(pairs[k][0] - pairs[k - 1][0], pairs[k][1] - pairs[k - 1][1]) - 1
            score += 1 - 2 * gap
            if gap > 3 or score <= 0 or score < best - 8:
                break
            if score >= best:
                best, end = score, k
        matched, span = end - start + 1, pairs[end][0] - pairs[start][0] + 1
        if matched >= rule.stretch - 2 and best >= rule.stretch / 2 and matched >= (1 - rule.edits) * span:
            out.append((pairs[start][0], pairs[end][0]))
        k = end + 1
    return out


def carried(item: np.ndarray, own: np.ndarray, proof: np.ndarray, doc: np.ndarray, offsets: list[int], rule: Rule) -> tuple[int, int]:
    """Item words that running text of ``doc`` carries, and the stretches; both texts as word numbers. Shared instructions count
    only beside a stretch of the item's own words."""
    got, met, n = np.zeros(len(item), bool), np.zeros(len(item), bool), 0
    at = np.flatnonzero(proof & own)
    least = min(rule.proofs, len(np.unique(item[at])))
    if least:  # distinctive words near any of the diagonals; without enough of them no stretch can bring them
        at = at[np.argsort(item[at], kind="stable")]
        j = np.flatnonzero(np.isin(doc, item[at]))
        low, high = (np.searchsorted(item[at], doc[j], side) for side in ("left", "right"))
        k = np.repeat(low - np.r_[0, np.cumsum(high - low)[:-1]], high - low) + np.arange((high - low).sum())
        word, ahead = np.repeat(doc[j], high - low), np.repeat(j, high - low) - at[k]
        close = np.zeros(len(word), bool)
        for offset in offsets:
            close |= np.abs(ahead - offset) <= WIDTH
        if len(np.unique(word[close])) < least:
            return 0, 0
    bands = [(equal_words(item, doc, offset, WIDTH), offset - WIDTH) for offset in offsets]
    reach = [(reachable(equal, own, rule), reachable(equal, ~own, rule)) for equal, _ in bands]
    if np.any(reach, axis=(0, 1)).sum() < len(item) * rule.share:
        return 0, 0
    kept = [matched(*band) for band, r in zip(bands, reach) if np.any(r)]
    for pairs in kept:
        here = np.zeros(len(item), bool)
        here[[i for i, _ in pairs]] = True
        for first, last in stretches([p for p in pairs if own[p[0]]], rule):
            n += not got[first : last + 1].any()
            got[first : last + 1] = True
            met[first : last + 1] |= here[first : last + 1]
    if len(np.unique(item[met & proof & own])) < least:
        return 0, 0
    if got.any():
        for pairs in kept:
            for first, last in stretches([p for p in pairs if not own[p[0]]], rule):
                got[first : last + 1] = True
    return int(got.sum()), n


def searched(batch: pa.RecordBatch, *indexes: Index, chunk: int = 1 << 20) -> Iterator[tuple]:
    """``(row, item, carried words, words, stretches)`` of every pair that the rule accepts, for a batch of texts. Texts are
    looked at in chunks of about ``chunk`` letters; a longer one is a chunk of its own, whole."""
    text, row = batch.column(1), 0
    while row < len(text):
        parts, size, base = [], 0, row
        while row < len(text) and (size < chunk or not parts):
            parts.append(plain(text[row].as_py()) if text[row].is_valid else b"")
            size += len(parts[-1]) + 1
            row += 1
        for index in indexes:
            yield from chunk_pairs(parts, base, index, chunk)


def offsets_of(i: np.ndarray, j: np.ndarray, own: np.ndarray, rule: Rule, width: int = WIDTH) -> list[int]:
    """By how many words a text runs ahead of an item where they have two words in a row at ``i`` and ``j``: diagonals at most 16
    apart from each other, but for those with too few such places in the band about them for any stretch; none if no band
    has enough within the item's own words, or all have too few for the item's share."""
    least, d = least_pairs(rule), j - i
    order = np.argsort(d, kind="stable")
    d, i = d[order], i[order]
    mine = own[i] & own[i + 1]
    out, used, any_own = [], np.zeros(len(own), bool), False
    last = None
    for o in np.unique(d).tolist():
        if last is not None and o - last <= 16:
            continue
        last = o
        low, high = np.searchsorted(d, [o - width, o + width + 1])
        if high - low < least or len(np.unique(i[low:high])) < least:
            continue
        out.append(o)
        used[i[low:high]] = True
        any_own |= len(np.unique(i[low:high][mine[low:high]])) >= least
    # stretches of different bands may overlap, each place lies in two of them at most
    return out if any_own and used.sum() >= len(own) * rule.share * (1 - rule.edits) / 4 else []


def shared_grams(parts: list[bytes], index: Index, step: int) -> tuple[np.ndarray, np.ndarray]:
    """``text * items + item`` of all that share grams, and how many; ``step`` letters are looked up at a time."""
    raw = np.frombuffer(b"\n".join(parts), np.uint8)
    ends = np.cumsum([len(p) + 1 for p in parts])
    letters, place = np.empty(0, np.uint8), np.empty(0, np.int64)
    seen, counts = [], []
    for start in range(0, len(raw), step):
        here = LETTER[raw[start : start + step]]
        at = np.flatnonzero(here)
        letters, place = np.r_[letters, here[at]], np.r_[place, at + start]
        pos, item, _ = index.hits(grams(letters))
        doc = np.searchsorted(ends, place[pos], side="right")
        whole = place[np.minimum(pos + Q, len(place)) - 1] < ends[doc]  # no gram spans two texts
        pairs, n = np.unique(doc[whole] * len(index.ids) + item[whole], return_counts=True)
        seen.append(pairs)
        counts.append(n)
        letters, place = letters[1 - Q :], place[1 - Q :]
    pairs, at = np.unique(np.concatenate([np.empty(0, np.int64), *seen]), return_inverse=True)
    return pairs, np.bincount(at, weights=np.concatenate([np.empty(0), *counts]), minlength=len(pairs))


NO_WORD = re.compile(rb"[^0-9A-Za-z\x80-\xff]")


def word_numbers(text: bytes, index: Index, step: int) -> np.ndarray:
    """A text's words as numbers, about ``step`` letters at a time."""
    out, start = [], 0
    while start < len(text):
        end = NO_WORD.search(text, start + step)
        end = end.start() if end else len(text)
        out.append(index.numbers(words_of(text[start:end])))
        start = end
    return np.concatenate([np.empty(0, np.int64), *out])


def chunk_pairs(parts: list[bytes], base: int, index: Index, step: int) -> Iterator[tuple]:
    rule = index.rule
    pairs, n = shared_grams(parts, index, step)
    pairs = pairs[n >= index.total[pairs % len(index.ids)]]
    free = index.total <= 0  # no bound by grams: every text goes on
    some = np.arange(len(parts)) if free.any() else np.unique(pairs // len(index.ids))
    texts = {d: word_numbers(parts[d], index, step) for d in some.tolist()}
    if not texts:
        return
    starts = np.cumsum([0, *(len(t) + 1 for t in texts.values())])
    words = np.concatenate([np.r_[t, -1] for t in texts.values()])  # a word in no item ends each text
    proven = index.proven(words, np.repeat(some, np.diff(starts)))
    j, item, i = index.word_hits(words)
    nth = np.searchsorted(starts, j, side="right") - 1
    j, pair = j - starts[nth], some[nth] * len(index.ids) + item
    likely = (np.isin(pair, proven) | (index.needed[item] == 0)) & (free[item] | np.isin(pair, pairs))
    pair, j, i = pair[likely], j[likely], i[likely]
    # pairs with places enough for a stretch in one band, before each is looked at
    least = least_pairs(rule)
    order = np.lexsort((j - i, pair))
    pair, j, i = pair[order], j[order], i[order]
    tail, head = slice(least - 1, None), slice(0, len(pair) - least + 1)
    many = np.unique(pair[head][(pair[tail] == pair[head]) & ((j - i)[tail] - (j - i)[head] <= 2 * WIDTH)]) if len(pair) >= least else pair[:0]
    for p in many.tolist():
        a, b = np.searchsorted(pair, [p, p + 1])
        d, k = divmod(p, len(index.ids))
        mine = index.word_ids[k]
        offsets = offsets_of(i[a:b], j[a:b], index.own[k], rule)
        if offsets:
            got, n = carried(mine, index.own[k], index.proof[k], texts[d], offsets, rule)
            if n and got >= len(mine) * rule.share:
                yield base + d, int(index.ids[k]), got, len(mine), n


def leaked(docs: DataFrame, id_col: str, text: str, items: DataFrame, item_id: str, item_text: str, *, rule: Rule = Rule(), block_chars: int = 4_000_000, blocks: int = 4, most_chars: int = 256_000_000) -> DataFrame:
    """``id_col, item_id, carried, words, stretches``: the documents that carry at least ``rule.share`` of an item's words as
    running text, in stretches of about ``rule.stretch`` words or more apart from single edited words. A share of 0 gives
    every passage of one stretch or more.

    Each document is read once, where it lies, without a shuffle. Letters and digits alone count, in one case. A pair
    of document and item goes on if the q-grams (8 letters) they share reach what the q-gram lemma leaves of the required
    words after the allowed edits (``least_grams``; where that is nothing, every document goes on), and if enough of the
    item's two words in a row lie in some band of diagonals; then the words are aligned in a band about each such
    diagonal, and the matched words must form running text. Sentences that several items share (instructions) are no
    passage on their own. All of it is decided on the whole text, whatever its length.

    Items are query texts: they are broadcast in blocks of ``block_chars`` characters, ``blocks`` of them for one pass over the
    documents. The driver holds a block at a time, and of all items the sentences that several share; items of more
    than ``most_chars`` characters together are refused.
    Defined results: null or empty documents and items give no row; an item id that is repeated gives a row for each of its
    different texts that is carried, reduced to one row; of a repeated document id each row is searched; extra columns are
    ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = [least_grams([len(w) for w in words_of(plain(t))], rule) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.int64())], names=["id", "text", "least"])

    once = items.select(F.col(item_id).cast("bigint").alias("id"), F.col(item_text).alias("text")).where("id IS NOT NULL AND length(text) > 0").distinct()
    kept = cut(once.repartition(partitions(spark)).mapInArrow(bounds, "id bigint, text string, least bigint"))
    if (kept.agg(F.sum(F.length("text"))).first()[0] or 0) > most_chars:
        raise ValueError(f"items of more than {most_chars} characters")
    stated = lambda: ((r.id, r.text, r.least) for r in kept.orderBy("id", "text").toLocalIterator())
    common, frequent = shared_sentences(t for _, t, _ in stated()), frequent_words((t for _, t, _ in stated()), rule.rare)
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(id_col, text).where(F.length(text) > 0)

    def search(shared: list) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = list(searched(batch, *(s.value for s in shared)))
                ids = batch.column(0).take(pa.array([f[0] for f in found], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([f[c] for f in found], t) for c, t in ((1, pa.int64()), (2, pa.int32()), (3, pa.int32()), (4, pa.int32())))], names=[id_col, "item_id", "carried", "words", "stretches"])

        return source.mapInArrow(run, f"{id_col} {kind}, item_id bigint, carried int, words int, stretches int")

    block: list[tuple[int, str, int]] = []
    size, shared = 0, [[]]
    for r in [*stated(), None]:
        if r is None or block and size + len(r[1]) > block_chars:
            if len(shared[-1]) == blocks:
                shared.append([])
            shared[-1].append(spark.sparkContext.broadcast(Index([b[:2] for b in block], rule, common, frequent, [b[2] for b in block])))
            block, size = [], 0
        if r:
            block.append(r)
            size += len(r[1])
    out = reduce(DataFrame.unionByName, [search(s) for s in shared])
    return out.groupBy(id_col, "item_id").agg(F.max_by(F.struct("carried", "words", "stretches"), "carried").alias("s")).select(id_col, "item_id", "s.*")


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of an item in a document, however small a part of the item it is, with its share of the item's words."""
    found = leaked(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text", rule=Rule(share=0.0))
    return found.withColumn("share", F.round(F.col("carried") / F.col("words"), 4))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text").select("doc_id", "item_id")


QUERIES = {"p8_report": p8_report, "p8_found": p8_found}
ORACLE: dict[str, str] = {}
