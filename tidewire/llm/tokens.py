"""Public tokenizers on the executors: exact ids of the `tokenizers` library, with a word cache.

A byte-level BPE never merges across pre-tokens, so the library encodes each distinct pre-token once.
Pre-tokens are found, hashed and looked up with numpy for a whole batch of texts at a time; only
those that the cache does not know are encoded.
"""

from __future__ import annotations

import os

import numpy as np

#: The pre-tokens that `_starts` finds (fixed pattern of the GPT-2 family):
#: 's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
LETTER, NUMBER, OTHER, SPACE, BORDER, UNKNOWN = range(6)
#: Code points from here on, and the controls that engines class differently, are left to the library.
KNOWN_POINTS = 0x3000
#: The cache starts anew when this many pre-tokens are in it.
CACHE_WORDS = 1_000_000
SLOT_BITS = 21
#: Characters handled at once.
PART_CHARS = 1 << 19
#: Words that the library is given in one string.
JOINED_WORDS = 512
#: Longer texts are cut where a pre-token ends.
SLICE_CHARS = 1 << 20
#: Longer pre-tokens are not cached; the cache also starts anew when its words have this many characters.
LONG_CHARS, CACHE_CHARS = 128, 1 << 24
MIX = np.uint64(0x9E3779B97F4A7C15)
BASE = 0xD1342543DE82EF95

_encoders: dict[str, "Encoder"] = {}


def vocabulary(name_or_path: str) -> str:
    """A file's path as it is, or the place of a public vocabulary by its file name."""
    if os.path.sep in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


def encoder(name_or_path: str) -> "Encoder":
    """One encoder, and so one cache, for all tasks of a worker process."""
    if name_or_path not in _encoders:
        _encoders[name_or_path] = Encoder(vocabulary(name_or_path))
    return _encoders[name_or_path]


def forget_encoders() -> None:
    """Free the encoders of this worker process, in tasks that need the room and no encoder."""
    _encoders.clear()


def vocab_size(name_or_path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary(name_or_path)).get_vocab_size(with_added_tokens=True)


def _classes() -> np.ndarray:
    import regex

    every = "".join(map(chr, range(KNOWN_POINTS)))
    out = np.full(KNOWN_POINTS + 1, OTHER, np.uint8)
    for kind, name in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        out[[m.start() for m in regex.finditer(name, every)]] = kind
    out[0x1C:0x20] = UNKNOWN
    out[KNOWN_POINTS] = UNKNOWN
    return out


class Encoder:
    """Ids as Tokenizer.encode(text, add_special_tokens=False) gives them.

    Texts that hold an added token's string or characters that only the library classes, and
    tokenizers of any other kind, go through the library whole. Pre-tokens are looked up by a 64-bit
    hash and compared character by character; what differs from its entry goes through the library.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        pre = repr(self.tok.pre_tokenizer)
        self.cached = "BPE(" in repr(self.tok.model)[:8] and self.tok.normalizer is None and pre.startswith("ByteLevel(") and "add_prefix_space=False" in pre and "use_regex=True" in pre
        self.border = regex.compile(r"(?<=\p{L})(?= \p{L})")
        self.room = cache_words
        if self.cached:
            self.kinds = _classes()
            with np.errstate(over="ignore"):
                self.value = (np.arange(KNOWN_POINTS + 1, dtype=np.uint64) + np.uint64(1)) * MIX
                self.value ^= self.value >> np.uint64(29)
                self.value *= np.uint64(0xBF58476D1CE4E5B9)
            self.size_of = np.zeros(self.tok.get_vocab_size(with_added_tokens=True), np.int64)  # bytes of each id
            for token, i in self.tok.get_vocab(with_added_tokens=True).items():
                self.size_of[i] = len(token)
            self.powers = self._powers(BASE)
            self.inverse = self._powers(pow(BASE, -1, 1 << 64))
            self._forget()

    @staticmethod
    def _powers(base: int, n: int = PART_CHARS + SLICE_CHARS + 4096) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def _forget(self) -> None:
        self.keys = np.zeros(1 << SLOT_BITS, np.uint64)
        self.entry = np.zeros(1 << SLOT_BITS, np.int32)
        self.begin, self.length, self.n = np.zeros(self.room, np.int64), np.zeros(self.room, np.int32), 0
        self.ids, self.used = np.zeros(1 << 20, np.uint32), 0
        self.spelt, self.size, self.spelling = np.zeros(self.room, np.int64), np.zeros(self.room, np.int32), np.zeros(1 << 20, np.uint16)  # the words' characters
        self.spelt_used = 0

    def encode(self, text: str | None) -> np.ndarray:
        """Ids as an array of uint32; empty for null."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """encode() of each text."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        part: list[int] = []
        size = 0
        for k, text in enumerate(texts):
            if not text:
                continue
            if not self.cached or any(a in text for a in self.added):
                out[k] = self._library(text)
            elif len(text) > SLICE_CHARS:
                out[k] = np.concatenate([self._part([x])[0] for x in self._slices(text)])
            else:
                part.append(k)
                size += len(text) + 1
                if size > PART_CHARS:
                    for i, ids in zip(part, self._part([texts[i] for i in part])):
                        out[i] = ids
                    part, size = [], 0
        for i, ids in zip(part, self._part([texts[i] for i in part]) if part else ()):
            out[i] = ids
        return out

    def _library(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint32)

    def _slices(self, text: str) -> list[str]:
        cuts = [0]
        while cuts[-1] + SLICE_CHARS // 2 < len(text):
            cut = self.border.search(text, cuts[-1] + SLICE_CHARS // 2, min(len(text), cuts[-1] + SLICE_CHARS))
            if not cut:
                return [text]  # one word without end: as it is
            cuts.append(cut.start())
        return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])]

    def _part(self, texts: list[str]) -> list[np.ndarray]:
        if len(texts) == 1 and len(texts[0]) > SLICE_CHARS:
            return [self._library(texts[0])]
        joined = "\n".join(texts) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        points = np.minimum(points, KNOWN_POINTS)
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        kind = self.kinds[points]
        if (kind == UNKNOWN).any():
            begins = np.concatenate([[0], ends[:-1] + 1])
            odd = [bool((kind[a:b] == UNKNOWN).any()) for a, b in zip(begins, ends)]
            rest = iter(self._part([t for t, o in zip(texts, odd) if not o]) if not all(odd) else ())
            return [self._library(t) if o else next(rest) for t, o in zip(texts, odd)]
        kind[ends] = BORDER
        starts = self._starts(joined, points, kind, ends)
        stops = np.append(starts[1:], len(points))
        real = kind[starts] != BORDER
        first = np.searchsorted(starts[real], np.concatenate([[0], ends + 1]))  # each text's first pre-token
        starts, stops = starts[real], stops[real]
        total = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(self.value[points] * self.powers[: len(points)], out=total[1:])
        hashes = (total[stops] - total[starts]) * self.inverse[starts]
        hashes ^= (stops - starts).astype(np.uint64) * MIX
        hashes[hashes < 2] += np.uint64(2)
        long = stops - starts > LONG_CHARS
        hashes[long] = 1
        at = self._find(points, hashes, starts, stops)
        many, begin, ids = self.length[at], self.begin[at], self.ids
        odd = np.flatnonzero(long | self._differ(points[kind != BORDER].astype(np.uint16), at, starts, stops))
        if len(odd):  # long ones, and words whose hash another word has
            own = [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast([joined[a:b] for a, b in zip(starts[odd].tolist(), stops[odd].tolist())], add_special_tokens=False)]
            sizes = np.array([len(x) for x in own], np.int64)
            begin[odd], many[odd] = len(ids) + np.cumsum(sizes) - sizes, sizes
            ids = np.concatenate([ids, *own])
        upto = np.concatenate([[0], np.cumsum(many, dtype=np.int64)])
        flat = ids[np.repeat(begin - upto[:-1], many) + np.arange(upto[-1])]
        cuts = upto[first].tolist()
        return [flat[a:b] for a, b in zip(cuts, cuts[1:])]

    def _differ(self, points: np.ndarray, at: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Which pre-tokens are spelt differently from their entries; points are their characters without borders."""
        size = (stops - starts).astype(np.int32)
        upto = np.cumsum(size, dtype=np.int32)
        there = np.arange(upto[-1] if len(upto) else 0, dtype=np.int32)
        there += np.repeat((self.spelt[at] - (upto - size)).astype(np.int32), size)
        wrong = np.flatnonzero(self.spelling.take(there, mode="clip") != points)
        out = self.size[at] != size
        out[np.searchsorted(upto, wrong, side="right")] = True
        return out

    def _starts(self, joined: str, points: np.ndarray, kind: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where pre-tokens start; a border between texts counts as one."""
        new = np.ones(len(kind), bool)
        new[1:] = kind[1:] != kind[:-1]
        blank = (points == 32) & (kind == SPACE)
        space = kind == SPACE
        # The last white space before something else stands apart from its run; a blank joins what follows.
        last = np.zeros(len(kind), bool)
        last[:-1] = space[:-1] & ~space[1:] & (kind[1:] != BORDER)
        new |= last
        joins = np.flatnonzero(last & blank) + 1
        new[joins] = False
        for i in np.flatnonzero((points == 39) & new).tolist():  # ' at the start of a pre-token
            for c in CONTRACTIONS:
                if joined.startswith(c, i) and (kind[i + 1 : i + len(c)] == LETTER).all():
                    new[i + 1 : i + len(c)] = False
                    if kind[i + len(c)] != BORDER:
                        new[i + len(c)] = True
                    break
        return np.flatnonzero(new)

    def _find(self, points: np.ndarray, hashes: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """The cache entry of each pre-token; what is missing is learnt first. Hash 1 stands for long ones, which have an empty entry."""
        at, open_ = self._probe(hashes)
        if len(open_):
            new, where = np.unique(hashes[open_], return_index=True)
            if self.n + len(new) > self.room or self.spelt_used > CACHE_CHARS:
                new, where = np.unique(hashes, return_index=True)
                open_ = np.arange(len(hashes))
                self.room = max(self.room, len(new))
                self._forget()
            where = open_[where]
            self._spell(points, starts[where], np.where(new == 1, starts[where], stops[where]))
            self._learn(new)
            at, open_ = self._probe(hashes)
        return at

    def _probe(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slot = (hashes * MIX >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        seen = self.keys[slot]
        at = self.entry[slot]
        todo = np.flatnonzero(seen != hashes)
        missing = []
        while len(todo):
            empty = seen[todo] == 0
            missing.append(todo[empty])
            todo = todo[~empty]
            slot[todo] = (slot[todo] + 1) & ((1 << SLOT_BITS) - 1)
            seen[todo] = self.keys[slot[todo]]
            at[todo] = self.entry[slot[todo]]
            todo = todo[seen[todo] != hashes[todo]]
        return at, np.concatenate(missing) if missing else np.zeros(0, np.int64)

    def _spell(self, points: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> None:
        """Keep the characters of words that are learnt next."""
        size = stops - starts
        upto = np.cumsum(size)
        while self.spelt_used + upto[-1] > len(self.spelling):
            self.spelling = np.concatenate([self.spelling, np.zeros_like(self.spelling)])
        self.spelling[self.spelt_used : self.spelt_used + upto[-1]] = points[np.arange(upto[-1]) + np.repeat(starts - upto + size, size)]
        own = np.arange(self.n, self.n + len(size))
        self.spelt[own], self.size[own] = self.spelt_used + upto - size, size
        self.spelt_used += int(upto[-1])

    def _apart(self, chars: np.ndarray, size: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Ids of words that are joined, one after another, and how many ids each word has.

        The library is quicker where it need not say which word an id is of: that follows from the bytes of the ids.
        """
        text = chars.astype("<u2").tobytes().decode("utf-16-le")
        upto = np.append(0, np.cumsum(size))
        in_bytes = np.append(0, np.cumsum(1 + (chars >= 0x80) + (chars >= 0x800)))[upto]
        cuts = [*range(0, len(size), JOINED_WORDS), len(size)]
        joined = [text[upto[a] : upto[b]] for a, b in zip(cuts, cuts[1:])]
        ids, many = [], np.zeros(len(size), np.int64)
        for a, b, words, e in zip(cuts, cuts[1:], joined, self.tok.encode_batch_fast(joined, add_special_tokens=False)):
            every = np.array(e.ids, np.uint32)
            ends, wanted = np.cumsum(self.size_of[every]), in_bytes[a + 1 : b + 1] - in_bytes[a]
            stops = np.searchsorted(ends, wanted)
            if len(ends) and ends[-1] == wanted[-1] and (ends[stops] == wanted).all():
                many[a:b] = np.diff(stops + 1, prepend=0)
            else:  # the ids do not spell the words byte by byte
                e = self.tok.encode(words, add_special_tokens=False)
                every, many[a:b] = np.array(e.ids, np.uint32), np.bincount(np.array(e.word_ids, np.int64), minlength=b - a)
            ids.append(every)
        return ids, many

    def _learn(self, hashes: np.ndarray) -> None:
        """Encode the words that _spell() kept last, and enter them by their hashes."""
        own = np.arange(self.n, self.n + len(hashes))
        size = self.size[own].astype(np.int64)
        chars = self.spelling[self.spelt_used - size.sum() : self.spelt_used]
        text = chars.astype("<u2").tobytes().decode("utf-16-le")
        stops = np.cumsum(size)
        letters = np.append(0, np.cumsum(self.kinds[chars] == LETTER))
        together = (size > 1) & (letters[stops] - letters[stops - size] == size - 1)
        together[together] = chars[(stops - size)[together]] == 32  # a blank and letters: they stay apart when joined
        many = np.zeros(len(hashes), np.int64)
        alone = np.flatnonzero(~together)
        odd = [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast([text[a:b] for a, b in zip((stops - size)[alone].tolist(), stops[alone].tolist())], add_special_tokens=False)]
        many[alone] = [len(x) for x in odd]
        rest = np.flatnonzero(together)
        parts, many[rest] = self._apart(chars[np.repeat(together, size)], size[rest])
        flat = np.concatenate([np.zeros(0, np.uint32), *parts, *odd])
        order = np.concatenate([rest, alone])
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.begin[own[order]], self.length[own] = self.used + np.cumsum(many[order]) - many[order], many
        self.used += len(flat)
        self.n += len(hashes)
        slot = (hashes * MIX >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        todo = np.arange(len(hashes))
        while len(todo):
            free = todo[self.keys[slot[todo]] == 0]
            self.keys[slot[free]] = hashes[free]
            self.entry[slot[free]] = own[free]
            todo = todo[self.keys[slot[todo]] != hashes[todo]]  # another word took the slot
            slot[todo] = (slot[todo] + 1) & ((1 << SLOT_BITS) - 1)
