"""Toxicity after noisy-channel deobfuscation.

Writers hide words by look-alike characters, by spacing letters out and by repeating them. A token that shows such signs
becomes a lattice: each place offers the letters it may stand for, at a cost. The Viterbi path under a character
model of ordinary words is the restored text. Restored words are looked up by their 5-character grams, word
boundaries included, whose evidence is the log of how much more often toxic texts have them. A logistic curve over the
strongest words and their density gives the score.

The character model counts the words of all documents, each spelling once a document. Evidence and curve are fitted on at most
``MAX_SAMPLE`` labelled rows of each class, those of the smallest hash: half of them gives the counts, the other half the
curve. Every text is scored whole.

Edge cases: null or empty text scores as a text without evidence; labels that are null or name no document teach
nothing; with one class missing every score is that class's share; repeated rows get equal scores; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, table
from .quality_clf import FEW, fit_logistic, labelled_sample, score_texts

MAX_SAMPLE = 4000
#: Characters a row that the rows of a class may have on average, to bound the driver's memory; no text is cut.
SAMPLE_CHARS = 20_000
GRAM = 5
#: Weaker evidence is left out.
STRONG = 1.0
#: Clean texts that each gram is taken to have been seen in besides those counted.
SMOOTH = 0.5
#: Tokens whose evidence a worker remembers.
CACHE = 500_000
#: Entries that a counting worker holds before it hands them on.
HELD = 300_000
#: Tokens looked at in one go, the longest of them, and characters of texts joined to one.
TOKENS, LONGEST, JOINED = 4096, 1000, 1 << 20
#: Letters whose grams are sorted at once.
LETTERS = 1 << 19
START, BACK_OFF = "^^^^^", 4.0
# What look-alike characters may stand for.
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou",
}
_SUBSTITUTE, _DROP, _SINGLE, _DOUBLE, _BREAK = 1.0, 7.0, 0.5, 3.0, 4.0
_EDGES = ".,;:?\"'()[]{}<>*$!|+&%#=~`-_/\\"
#: Edges that no letter hides behind.
_PLAIN_EDGES = "".join(c for c in _EDGES if c not in LOOKS)
#: Punctuation that is common before and after a word, and what it costs to read it so; elsewhere it costs ``_DROP``.
_OPENS, _CLOSES, _USUAL = "(*|", "!*|+", 0.5
_HIDDEN = re.compile(r"[0-9@$!|+(€£*._\-]")
_REPEATED = re.compile(r"([^\W\d_])\1\1")
_DOUBLED = re.compile(r"([^\W\d_])\1")
#: Three or more letters, digits or look-alikes set apart; a star may be a look-alike or stand between letters.
_PLACE, _APART = r"(?:[^\W_]|[@$!|+(€£*])", r"(?:[\s.\-_]+|\*)"
_SPACED = re.compile(rf"(?<![^\s\"'\[{{]){_PLACE}(?:{_APART}{_PLACE}){{2,}}(?=[.,;:?!\"')\]}}]*(?!\S))")
_BLANKS = re.compile(r"[\s.\-_]+")
#: Numbers and prices are read as such.
_NUMBER = re.compile(r"[+$€£(]?\d[\d.,:\-+]*[)!*+%€£]*")
_RUNS = re.compile(r"(.)\1*", re.DOTALL)
#: The letters that a token begins with.
_HEAD = re.compile(r"[^\W\d_]*")
#: Classes of characters: hiding signs, letters, places of spaced words, what may stand before the first and after each.
_IS_HIDDEN, _IS_ALPHA, _IS_PLACE, _IS_BEFORE, _IS_APART = (1 << k for k in range(5))
#: Bits of a gram's slot in a table of strong grams.
_SLOT = 22


class CharModel:
    """A character model of five-letter memory that backs off to shorter contexts; ``^`` is the word boundary.

    Counts are found by the hash of their gram, in sorted arrays: 16 bytes an entry, however many there are.
    """

    def __init__(self, words: dict[str, int]):
        counts = Counter()
        for gram, n in letter_grams(words).items():
            for key in gram_keys(gram):
                counts[key] += n
        self._hold(sorted(counts.items()))

    @classmethod
    def of_counts(cls, counts: pa.Table) -> CharModel:
        """From a table (key, n)."""
        own = cls.__new__(cls)
        own._hold(counts.sort_by("key"))
        return own

    def _hold(self, rows: list[tuple[int, int]] | pa.Table) -> None:
        self.keys, self.counts = array("q"), array("q")
        if isinstance(rows, pa.Table):
            self.keys.frombytes(rows["key"].to_numpy().tobytes())
            self.counts.frombytes(rows["n"].to_numpy().tobytes())
        else:
            self.keys.extend(k for k, _ in rows)
            self.counts.extend(n for _, n in rows)
        self._shares: dict[str, float] = {}
        self._contexts: dict[str, int] = {}
        self.costs: dict[str, float] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_shares": {}, "_contexts": {}, "costs": {}}

    def count(self, kind: str, text: str) -> int:
        """How often a gram (kind ``+``) or a context (``-``) was seen."""
        key = hash_of(kind + text)
        at = bisect_left(self.keys, key)
        return self.counts[at] if at < len(self.keys) and self.keys[at] == key else 0

    def share(self, context: str, c: str) -> float:
        """P(c | context), from that after the context without its first letter."""
        found = self._shares.get(context + c)
        if found is None:
            n = self._contexts.get(context)
            if n is None:
                if len(self._contexts) >= CACHE:
                    self._contexts.clear()
                n = self._contexts[context] = self.count("-", context)
            found = self.share(context[1:], c) if context else 1 / 200
            if n:
                found = (self.count("+", context + c) + BACK_OFF * found) / (n + BACK_OFF)
            if len(context) < len(START):  # those of whole contexts are held as costs
                if len(self._shares) >= 2 * CACHE:
                    self._shares.clear()
                self._shares[context + c] = found
        return found

    def cost(self, context: str, c: str) -> float:
        """-log P(c | context); ``costs`` remembers it by the letters of both."""
        if len(self.costs) >= 2 * CACHE:
            self.costs.clear()
        found = self.costs[context + c] = -math.log(self.share(context, c))
        return found


def hash_of(text: str) -> int:
    """A 64-bit hash that is the same in every process."""
    return int.from_bytes(blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


def letter_grams(words: dict[str, int]) -> Counter:
    """Every letter of the words with the five before it."""
    out, size = Counter(), len(START)
    for word, n in words.items():
        z = START + word + "^"
        for i in range(size, len(z)):
            out[z[i - size : i + 1]] += n
    return out


def gram_columns(words: dict[str, int]) -> Iterator[tuple[list[str], np.ndarray]]:
    """What ``letter_grams`` counts, as columns of parts that add up.

    Grams of up to 1023 kinds of letters are numbers, and sorted as such, ``LETTERS`` at once.
    """
    size = np.fromiter(map(len, words), np.int64, len(words))
    n = np.fromiter(words.values(), np.int64, len(words))
    names, width = np.array(list(words), object), len(START) + 1
    short = size <= LONGEST
    seen = np.zeros(0x110000, bool)
    seen[code_points("".join(names[short]))] = seen[ord("^")] = True
    kinds = np.flatnonzero(seen).astype("<u4")
    bits = len(kinds).bit_length()
    if width * bits > 63:
        short[:] = False
    if not short.all():
        found = letter_grams(dict(zip(names[~short], n[~short].tolist(), strict=True)))
        yield list(found), np.fromiter(found.values(), np.int64, len(found))
    names, size, n = names[short], size[short], n[short]
    if not len(names):
        return
    ids = np.zeros(0x110000, np.uint16)
    ids[kinds] = np.arange(len(kinds))
    parts, at = [], 0
    ends = np.cumsum(size + width)
    while at < len(names):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LETTERS, "right")))
        codes = ids[code_points("".join([f"{START}{word}^" for word in names[at:to]]))]
        packed = np.zeros(len(codes) - width + 1, np.int64)
        for k in range(width):
            packed <<= bits
            packed |= codes[k : k + len(packed)]
        inside = np.ones(len(codes), bool)  # grams that begin and end in the same word
        for k in range(1, width):
            inside[ends[at:to] - (ends[at - 1] if at else 0) - k] = False
        parts.append(_summed(packed[inside[: len(packed)]], np.repeat(n[at:to], size[at:to] + 1)))
        at = to
    packed, n = _summed(*map(np.concatenate, zip(*parts, strict=True)))
    shifts = np.arange(width - 1, -1, -1) * bits
    letters = kinds[packed[:, None] >> shifts & (1 << bits) - 1]
    yield letters.view(f"<U{width}")[:, 0].tolist(), n


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, with the sum of its numbers."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(n[order], first)


def gram_keys(gram: str) -> list[int]:
    """What one sight of a letter after its context counts for: grams and contexts of every length."""
    return [hash_of(kind) for k in range(len(gram)) for kind in ("+" + gram[k:], "-" + gram[k:-1])]


def plain_words(tokens: dict[str, int]) -> Counter:
    """The tokens that hide nothing, without punctuation around them."""
    out = Counter()
    for token, k in tokens.items():
        if (core := token.strip(_EDGES)).isalpha() and not _REPEATED.search(core):
            out[core] += k
    return out


def corpus_model(docs: DataFrame) -> CharModel:
    """The character model of the words of all documents, each spelling counted once a document."""
    bounded_batches(docs.sparkSession)

    def letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Counter()

        def handed_on() -> Iterator[pa.RecordBatch]:
            words = plain_words(tokens)
            tokens.clear()
            for grams, n in gram_columns(words):
                yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(n, pa.int64())], names=["gram", "n"])

        for batch in batches:
            for text in batch.column("text"):
                tokens.update(set((text.as_py() or "").lower().split()))
                if len(tokens) >= HELD:
                    yield from handed_on()
        yield from handed_on()

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = Counter()
            for gram, n in zip(batch.column("gram").to_pylist(), batch.column("n").to_pylist(), strict=True):
                for key in gram_keys(gram):
                    found[key] += n
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.int64())], names=["key", "n"])

    total = F.sum("n").alias("n")
    found = docs.select("text").mapInArrow(letters, "gram string, n long").groupBy("gram").agg(total)
    return CharModel.of_counts(found.mapInArrow(keys, "key long, n long").groupBy("key").agg(total).toArrow())


def lattice(token: str, *, spaced: bool = False) -> list[list[tuple[str, float]]]:
    """Places of a token, each with (text, cost) choices."""
    out: list[list[tuple[str, float]]] = []
    for run in _RUNS.finditer(token):
        c, n = run[1], len(run[0])
        if c in LOOKS:
            usual = not spaced and (c in _OPENS and run.start() == 0 or c in _CLOSES and run.end() == len(token))
            drop = _USUAL if usual else _SINGLE if spaced and c == "*" else _DROP
            place = [(x, _SUBSTITUTE) for x in LOOKS[c]] + [("", drop)]
            out += [place] * (n if spaced else min(n, 2))
        elif not c.isalnum():
            out.append([("", 0.0), ("^", _BREAK)] if spaced else [("", _SINGLE), ("^", _DOUBLE)])
        elif n == 1 or spaced:
            out += [[(c, 0.0)]] * n
        elif n == 2:
            out.append([(c + c, 0.0), (c, _DOUBLE)])
        else:
            out.append([(c, _SINGLE), (c + c, _DOUBLE)])
    return out


def viterbi(places: list[list[tuple[str, float]]], model: CharModel) -> str:
    """The likeliest text of a lattice of any length."""
    states: dict[str, tuple[float, tuple]] = {START: (0.0, ())}
    known = model.costs.get
    for choices in [*places, [("^", 0.0)]]:
        following: dict[str, tuple[float, tuple]] = {}
        if len(states) == len(choices) == 1:  # nothing to choose: what all paths share needs no cost
            [(context, (cost, path))], [(piece, _)] = states.items(), choices
            for c in piece:
                context = START if c == "^" else context[1:] + c
            states = {context: (cost, (path, piece) if piece else path)}
            continue
        for context, (cost, path) in states.items():
            for piece, extra in choices:
                at, total = context, cost + extra
                for c in piece:
                    z = at + c
                    if (step := known(z)) is None:
                        step = model.cost(at, c)
                    total += step
                    at = START if c == "^" else z[1:]
                if at not in following or total < following[at][0]:
                    following[at] = (total, (path, piece) if piece else path)
        states = following
    path, text = min(states.values(), key=lambda s: s[0])[1], []
    while path:
        path, piece = path
        text.append(piece)
    return "".join(reversed(text))[:-1]


class Model:
    """Character model, gram evidence and curve; picklable."""

    def __init__(self, chars: CharModel, evidence: dict[str, float], weights: tuple[float, ...], prior: float):
        self.chars, self.evidence, self.weights, self.prior = chars, evidence, weights, prior
        self._cache: dict[str, float] = {}
        self._note()

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_cache": {}, "_hot": set(), "_tails": {}, "_slots": {}}

    def _note(self) -> None:
        """Strong grams, the same with doubled letters squeezed, and the lengths of those."""
        self._whole = {g for g, x in self.evidence.items() if x > STRONG}
        self._strong = set(map(squeezed, self._whole))
        self._lengths = sorted({len(g) for g in self._strong})
        self._slots: dict[int, np.ndarray] = {}
        self._hot: set[str] = set()
        self._tails: dict[tuple[str, str], bool] = {}

    def harmless(self, word: str) -> bool:
        """Whether no way to read the word's doubled letters has a strong gram: all ways are equal once squeezed."""
        z = squeezed(f"^{word}$")
        return not any(z[i : i + n] in self._strong for n in self._lengths for i in range(len(z) - n + 1))

    def may_be_strong(self, core: str) -> bool:
        """Whether some reading of a token, however unlikely, has a word with a strong gram."""
        if core.isalpha():
            if len(single := squeezed(core)) == len(core) - 1:  # one doubled letter
                return not self._whole.isdisjoint(grams(core) + grams(single))
            if self.harmless(core):
                return False
        head = _HEAD.match(core)[0]
        if len(head) < GRAM - 1 or _DOUBLED.search(head):
            return self.readable(lattice(core))
        z = "^" + head
        if not self._whole.isdisjoint([z[i : i + GRAM] for i in range(len(z) - GRAM + 1)]):
            return True
        key = z[1 - GRAM :], core[len(head) :]
        found = self._tails.get(key)
        if found is None:
            if len(self._tails) >= CACHE:
                self._tails.clear()
            found = self._tails[key] = self.readable(lattice(key[1]), key[0])
        return found

    def readable(self, places: list[list[tuple[str, float]]], before: str = "^") -> bool:
        """Whether some path of a lattice, after letters that are certain, has a word with a strong gram."""
        ends, strong = {before}, self._whole  # the last letters of all paths
        for choices in [*places, [("^", 0.0)]]:
            following = set()
            for at in ends:
                for piece, _ in choices:
                    if piece == "^":
                        if at + "$" in strong:
                            return True
                        following.add(piece)
                        continue
                    z = at + piece
                    for i in range(len(z) - GRAM + 1):
                        if z[i : i + GRAM] in strong:
                            return True
                    following.add(z[1 - GRAM :])
            ends = following
        return False

    def doubtful(self, cores: list[str]) -> np.ndarray:
        """Which tokens need a closer look: the others hide nothing but doubled letters and have no strong gram.

        Tables of hashes find every strong gram, and few others. Doubled letters are squeezed, as in ``harmless``.
        """
        size = np.fromiter(map(len, cores), np.int64, len(cores))
        out = (size < GRAM - 2) | (size > LONGEST)
        at = np.flatnonzero(~out)
        if not len(at):
            return out
        codes = code_points("".join([f"^{cores[k]}$" for k in at]))
        ends = np.cumsum(size[at] + 2)
        starts = ends - size[at] - 2
        kinds = kinds_of(codes)
        hidden = np.add.reduceat(kinds & _IS_HIDDEN, starts, dtype=np.int64) > _IS_HIDDEN  # one is the ``$`` at the end
        single = np.ones(len(codes), bool)
        np.not_equal(codes[1:], codes[:-1], out=single[1:])
        doubled = ~np.logical_and.reduceat(single, starts)
        alpha = np.add.reduceat((kinds & _IS_ALPHA) // _IS_ALPHA, starts, dtype=np.int64) == size[at]
        codes, starts = codes[single], (np.cumsum(single) - 1)[starts]
        found = hidden | doubled & ~alpha
        for n in {GRAM, *self._lengths}:
            if n not in self._slots:
                table = self._slots[n] = np.zeros(1 << _SLOT, bool)
                table[slots(code_points("".join(g for g in self._strong if len(g) == n)), n)[::n]] = True
            flags = np.zeros(len(codes), bool)
            where = slots(codes, n)
            flags[: len(where)] = self._slots[n][where]
            # a shorter gram is a squeezed one, or all of a word too short to be here
            found |= np.logical_or.reduceat(flags, starts) & (doubled | (n == GRAM))
        out[at] = found
        return out

    def restore(self, token: str) -> list[str]:
        """The words that a lower-case token stands for."""
        core = token.strip(_PLAIN_EDGES)
        if not _HIDDEN.search(core) and not _DOUBLED.search(core):
            return [core] if any(map(str.isalpha, core)) else []
        if _NUMBER.fullmatch(core):
            return []
        return [w for w in viterbi(lattice(core), self.chars).split("^") if w]

    def restore_spaced(self, run: str) -> list[str]:
        """The words that spaced-out letters stand for."""
        run = _BLANKS.sub(" ", run)
        if len(set(run) - {" "}) == 1 and run[0] in LOOKS and not run[0].isdigit():  # a rule across the page
            return []
        return [w for w in viterbi(lattice(run, spaced=True), self.chars).split("^") if w]

    def learn(self, texts: dict[int, list[str]]) -> None:
        """Take the evidence of grams from clean (0) and toxic (1) texts."""
        seen = {y: Counter() for y in (0, 1)}
        for y in (0, 1):
            for token, k in Counter(w for t in texts[y] for w in set(t.lower().split())).items():
                for word in self.restore(token):
                    for g in set(grams(word)):
                        seen[y][g] += k
        share = len(texts[1]) / len(texts[0])
        self.evidence, self._cache = {}, {}
        for g, k in seen[1].items():
            if (x := math.log((k + 0.5) / (seen[0][g] * share + SMOOTH))) > 0:
                self.evidence[g] = x
        self._note()

    def of_word(self, word: str) -> float:
        """The strongest evidence among a restored word's grams."""
        return max([self.evidence.get(g, 0.0) for g in grams(word)], default=0.0)

    def of_token(self, token: str) -> float:
        """The strongest evidence among the words of a token, or less if none of it is strong."""
        core = token.strip(_PLAIN_EDGES)
        if (_HIDDEN.search(core) or _DOUBLED.search(core)) and not self.may_be_strong(core):
            return 0.0  # decoding could not make it strong
        return max(map(self.of_word, self.restore(token)), default=0.0)

    def weigh(self, tokens: list[set[str]]) -> None:
        """Note the evidence of tokens in ``_cache``, and in ``_hot`` those where it is strong."""
        new = set().union(*[s.difference(self._cache) for s in tokens])
        if len(self._cache) + len(new) > CACHE:
            self._cache.clear()
            self._hot.clear()
            new = set().union(*tokens)
        self._cache.update(dict.fromkeys(new, 0.0))
        new = list(new)
        for i in range(0, len(new), TOKENS):
            part = new[i : i + TOKENS]
            for k in np.flatnonzero(self.doubtful([t.strip(_PLAIN_EDGES) for t in part])).tolist():
                if (x := self.of_token(part[k])) > STRONG:
                    self._cache[part[k]] = x
                    self._hot.add(part[k])

    def measures(self, text: str) -> list[float]:
        """The evidence of the three strongest tokens, and the sum of strong evidence: its log, and by length."""
        return self.measures_of([text])[0]

    def measures_of(self, texts: list[str]) -> list[list[float]]:
        """The measures of several texts."""
        texts = [t.lower() for t in texts]
        tokens = [set(t.split()) for t in texts]
        self.weigh(tokens)
        out = []
        for own, runs in zip(tokens, spaced_runs(texts), strict=True):
            found = [self._cache[t] for t in own & self._hot]
            for run in runs:
                found += [x for x in map(self.of_word, self.restore_spaced(run)) if x > STRONG]
            found.sort(reverse=True)
            total, n = sum(found), max(1, len(own))
            out.append([*(found + [0.0, 0.0, 0.0])[:3], math.log1p(total), total / math.sqrt(n), min(total / n, 0.2)])
        return out

    def score(self, raw: bytes) -> float:
        """Likelihood that the text is toxic."""
        return self.scores([raw])[0]

    def scores(self, raws: list[bytes]) -> list[float]:
        """Likelihood of each text that it is toxic."""
        if not self.weights:
            return [self.prior] * len(raws)
        odds = [self.weights[0] + sum(w * x for w, x in zip(self.weights[1:], own, strict=True)) for own in self.measures_of([r.decode() for r in raws])]
        return [float(1 / (1 + np.exp(-np.clip(x, -40, 40)))) for x in odds]


def code_points(text: str) -> np.ndarray:
    """The code points of a text."""
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def slots(codes: np.ndarray, n: int) -> np.ndarray:
    """The slots of all grams of ``n`` code points."""
    last = max(0, len(codes) - n + 1)
    h = np.zeros(last, np.uint32)
    for k in range(n):
        h = (h ^ codes[k : k + last]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    return h >> np.uint32(32 - _SLOT)


@cache
def _kinds() -> np.ndarray:
    """The classes of the first 65 536 code points; the last stands for all beyond, which may be places."""
    out = np.zeros(1 << 16, np.uint8)
    for k in range(len(out)):
        c = chr(k)
        out[k] = _IS_ALPHA * c.isalpha() | _IS_PLACE * c.isalnum() | (_IS_BEFORE | _IS_APART) * c.isspace()
    for kind, some in ((_IS_HIDDEN, "0123456789@$!|+(€£*._-"), (_IS_PLACE, "@$!|+(€£*"), (_IS_BEFORE, "\"'[{"), (_IS_APART, ".-_*")):
        out[[ord(c) for c in some]] |= kind
    out[-1] = _IS_PLACE
    return out


def kinds_of(codes: np.ndarray) -> np.ndarray:
    """The classes of code points."""
    return _kinds()[np.minimum(codes, 0xFFFF)]


def spaced_runs(texts: list[str]) -> list[list[str]]:
    """The spaced-out words of each text: what ``_SPACED`` finds, tried only where a match can begin."""
    out, part, size = [], [], 0
    for text in texts:
        if part and size + len(text) >= JOINED:
            out += _joined_runs(part)
            part, size = [], 0
        part.append(text)
        size += len(text) + 1
    return out + _joined_runs(part)


def _joined_runs(texts: list[str]) -> list[list[str]]:
    if sum(map(len, texts)) > JOINED:
        return [[m[0] for m in _SPACED.finditer(t)] for t in texts]
    out: list[list[str]] = [[] for _ in texts]
    kinds = kinds_of(code_points("\n" + "".join([t + "\n" for t in texts])))
    firsts = np.flatnonzero((kinds[:-2] & _IS_BEFORE > 0) & (kinds[1:-1] & _IS_PLACE > 0) & (kinds[2:] & _IS_APART > 0))
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
    last, end = -1, 0
    for k, at in zip((np.searchsorted(bounds, firsts, "right") - 1).tolist(), firsts.tolist(), strict=True):
        at -= int(bounds[k])
        if k != last:
            last, end = k, 0
        if at >= end and (found := _SPACED.match(texts[k], at)):
            out[k].append(found[0])
            end = found.end()
    return out


def squeezed(text: str) -> str:
    """The text with runs of a character cut to one."""
    return _RUNS.sub(r"\1", text)


def grams(word: str) -> list[str]:
    """The grams of a word with its boundaries; a shorter one is its own gram."""
    z = f"^{word}$"
    return [z[i : i + GRAM] for i in range(max(1, len(z) - GRAM + 1))]


def train(sample: list[tuple[str, int]], chars: CharModel | None = None) -> Model:
    """Fit evidence and curve on labelled texts; without a character model of the corpus their words make one."""
    n = Counter(y for _, y in sample)
    prior = n[1] / len(sample) if sample else 0.0
    sets = {y: [t for t, z in sample if z == y] for y in (0, 1)}
    if chars is None:
        chars = CharModel(plain_words(Counter(w for t, _ in sample for w in set(t.lower().split()))))
    model = Model(chars, {}, (), prior)
    least = min(n[0], n[1])
    if not least:
        return model
    # with few rows in a class the two halves take turns, and both give the last evidence; a lone row stands on both sides
    rows = []
    for k in (0, 1) if least < FEW else (0,):
        model.learn({y: sets[y][k::2] or sets[y] for y in (0, 1)})
        for y in (0, 1):
            texts = sets[y][1 - k :: 2] or (sets[y] if k == 0 else [])
            for i in range(0, len(texts), 256):
                rows += [(*own, y) for own in model.measures_of(texts[i : i + 256])]
    if least < FEW:
        model.learn(sets)
    x = np.array([r[:-1] for r in rows])
    # the sample may hold more toxic rows than the labels; the curve is for the classes as sampled
    model.weights = tuple(fit_logistic(x, np.array([r[-1] for r in rows], float), ridge=0.1))
    return model


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sample = labelled_sample(docs, table(spark, sf_dir, "labels"), "toxic", MAX_SAMPLE, SAMPLE_CHARS)
    return score_texts(docs, train(sample, corpus_model(docs)), 0.5)
