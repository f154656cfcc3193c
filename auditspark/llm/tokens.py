"""Token ids of whole texts, a worker's words encoded once.

The tokenizer files used here split a text into pieces before they merge, and no piece runs over white space that
follows something else, or from a letter or digit to a sign. A text can therefore be cut at such places, each span
encoded by itself and the ids joined. Spans repeat (words), so each worker keeps the ids of those it has met, in a
table that is asked for all spans of many texts at once. A text that holds an added token's string (<|endoftext|>),
which the library finds before anything else, or white space other than ASCII before white space, is one span.
"""

from __future__ import annotations

import os
import re

from auditspark.llm.workers import keep

#: Spans whose ids a worker keeps, some 60 bytes each; beyond that it starts anew. Results don't depend on it.
CACHE = 1_000_000
#: Bytes of a span that the table compares (three machine words); longer ones up to KEPT bytes are kept in a dict.
WIDTH, KEPT = 24, 100
#: Bytes of texts, and spans, that are worked on at once.
SLICE, CHUNK = 1 << 20, 1 << 17
#: Words of Latin letters (without the signs U+00D7 and U+00F7, and U+0130, which falls apart in lower case): one
#: piece in either file, and nothing to normalise but case.
LATIN = "[a-zA-ZÀ-ÖØ-öø-įı-ɏ]+"
#: Spans that are encoded many in one text, and how many.
PLAIN = {True: re.compile(LATIN).fullmatch, False: re.compile(f" (?:{LATIN}|[0-9]+)").fullmatch}
TOGETHER = 2000
#: White space beyond ASCII, as RE2 spells it.
OTHER_SPACE = r"[\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Classes of bytes: a place to cut, white space (or what some take for it), a sign, a letter or digit.
CUT, WHITE, SIGN, WORD = 1, 2, 4, 8


def _byte_classes():
    import numpy as np

    of = np.zeros(256, "u1")
    for c in range(128):
        if c in range(9, 14) or c == 32:
            of[c] = CUT | WHITE
        elif c in range(28, 32):
            of[c] = WHITE
        elif chr(c).isalnum():
            of[c] = WORD
        elif c > 32 and c < 127:
            of[c] = SIGN
    return of


class SpanTable:
    """Numbers of spans by their bytes: open addressing, asked and filled for many spans at once."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        import numpy as np

        self.n, self.bits = 0, 16
        self.keys = np.zeros((3, 1 << 15), "u8")
        self.number = np.zeros(1 << 15, "i4")
        self.slots = np.full(1 << self.bits, -1, "i4")

    def mix(self, keys):
        """A hash of the three machine words. Spans that share it are told apart by their bytes."""
        import numpy as np

        h = keys[0] * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h = (h + keys[1]) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        h = (h + keys[2]) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))

    def _home(self, h):
        import numpy as np

        return (h >> np.uint64(64 - self.bits)).astype("i8")

    def find(self, keys, h):
        """The number of each span, -1 for those that are not here."""
        import numpy as np

        out = np.full(len(h), -1, "i8")
        left, at, mask = None, self._home(h), len(self.slots) - 1
        while len(at):
            c = self.slots[at]
            there = c >= 0
            same = there.copy()
            for own, k in zip(self.keys, keys, strict=True):
                same &= own[c] == k
            if left is None:
                out[same] = self.number[c[same]]
                left = np.flatnonzero(there & ~same)
                go = left
            else:
                out[left[same]] = self.number[c[same]]
                go = np.flatnonzero(there & ~same)
                left = left[go]
            keys, at = keys[:, go], (at[go] + 1) & mask
        return out

    def add(self, keys, h, number) -> None:
        """Distinct spans that are not here yet."""
        import numpy as np

        first, self.n = self.n, self.n + len(h)
        if self.n > self.keys.shape[1]:
            room = 2 * self.n
            self.keys = np.hstack([self.keys[:, :first], np.zeros((3, room - first), "u8")])
            self.number = np.append(self.number[:first], np.zeros(room - first, "i4"))
        self.keys[:, first : self.n], self.number[first : self.n] = keys, number
        if 2 * self.n > len(self.slots):
            while 2 * self.n > 1 << self.bits:
                self.bits += 1
            self.slots = np.full(1 << self.bits, -1, "i4")
            first, h = 0, self.mix(self.keys[:, : self.n])
        entry, at = np.arange(first, self.n, dtype="i4"), self._home(h)
        while len(entry):
            free = self.slots[at] < 0
            self.slots[at[free]] = entry[free]
            lost = self.slots[at] != entry
            entry, at = entry[lost], (at[lost] + 1) & (len(self.slots) - 1)


class Encoder:
    """Texts to ids, as the tokenizers library encodes the whole text without special tokens.

    drops_space: the tokenizer lower-cases, and ignores white space but for its cuts. spells_added: an added token's
    string in a text is spelt out like other text, not given the token's id."""

    def __init__(self, path: str, drops_space: bool, spells_added: bool = True):
        import numpy as np

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = spells_added
        added = [] if spells_added else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # a byte of zero would not show in the table; added tokens in any case: spans are compared in lower case
        hard = [r"\x00", *[f"(?i:{re.escape(t)})" for t in added], *[rf"{OTHER_SPACE}[\t-\r\x1c-\x20]"] * (not drops_space)]
        self.hard = "|".join(hard)
        self.drops_space = drops_space
        self._prepare(path)
        self.classes = _byte_classes()
        self.lower = np.arange(256, dtype="u1")
        self.lower[65:91] += 32
        self.masks = np.array([(1 << 8 * k) - 1 for k in range(9)], "u8")
        self.table = SpanTable()
        self._forget()

    def _forget(self) -> None:
        import numpy as np

        self.table.clear()
        self.long: dict[bytes, int] = {}
        #: Ids of all known spans one after another, and for each span the place of its first one and their number.
        self.ids, self.n_ids = np.zeros(1 << 16, "<u4"), 0
        self.first, self.size, self.n = np.zeros(1 << 15, "i8"), np.zeros(1 << 15, "i4"), 0

    def _prepare(self, path: str) -> None:
        """A second tokenizer for plain words: the file's model without the steps that leave such words as they
        are. Where a word begins or ends shows in the ids, so many go through in one text."""
        import numpy as np
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.words = Tokenizer.from_file(path)
        self.words.normalizer = normalizers.Sequence([])
        by_byte = pre_tokenizers.ByteLevel(add_prefix_space=not self.drops_space, use_regex=False)
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), by_byte])
        vocabulary = self.words.get_vocab()
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.edge[i] = token.endswith("</w>") if self.drops_space else token.startswith("Ġ")

    def _plain(self, words: list[str]):
        """(ids, their number for each word)."""
        import numpy as np

        all_ids, sizes = [], []
        for k in range(0, len(words), TOGETHER):
            own = words[k : k + TOGETHER]
            text = " ".join(own).lower() if self.drops_space else "".join(own)
            ids = np.array(self.words.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            at = np.flatnonzero(self.edge[ids])
            stops = at + 1 if self.drops_space else np.append(at[1:], len(ids))
            if len(stops) != len(own):
                raise ValueError("words and ids do not match")
            all_ids.append(ids)
            sizes.append(np.diff(stops, prepend=0))
        return np.concatenate(all_ids), np.concatenate(sizes)

    def _whole(self, texts: list[str]):
        import numpy as np

        found = []
        for k in range(0, len(texts), TOGETHER):
            found += [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts[k : k + TOGETHER], add_special_tokens=False)]
        return np.concatenate(found), np.array([len(f) for f in found])

    def _learn(self, spans: list[bytes]):
        """Encode the spans and give them numbers: (the first number, for each span its place after that)."""
        import numpy as np

        texts = [s.decode() for s in spans]
        plain = np.fromiter((bool(PLAIN[self.drops_space](t)) for t in texts), bool, len(texts))
        before, place = self.n, np.empty(len(texts), "i8")
        for kind, encode in ((True, self._plain), (False, self._whole)):
            own = np.flatnonzero(plain == kind)
            if len(own):
                place[own] = self.n - before + np.arange(len(own))
                self._keep(*encode([texts[k] for k in own.tolist()]))
        return before, place

    def _keep(self, ids, sizes) -> None:
        import numpy as np

        if self.n_ids + len(ids) > len(self.ids):
            self.ids = np.append(self.ids[: self.n_ids], np.zeros(self.n_ids + 2 * len(ids), "<u4"))
        if self.n + len(sizes) > len(self.size):
            room = self.n + 2 * len(sizes)
            self.first = np.append(self.first[: self.n], np.zeros(room, "i8"))
            self.size = np.append(self.size[: self.n], np.zeros(room, "i4"))
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.first[self.n : self.n + len(sizes)] = self.n_ids + np.cumsum(sizes) - sizes
        self.size[self.n : self.n + len(sizes)] = sizes
        self.n_ids, self.n = self.n_ids + len(ids), self.n + len(sizes)

    def _cuts(self, data, offsets, hard):
        """Where spans begin: at each text, and inside those that are not hard."""
        import numpy as np

        found, begins = [], offsets[:-1][np.diff(offsets) > 0]
        for lo in range(0, len(data), SLICE):
            back = min(lo, 2)
            own = data[lo - back : lo + SLICE]
            kind = self.classes[own]
            if own.max() > 127:  # letters of two bytes
                second = own[1:]
                kind[1:][(own[:-1] == 0xC3) & (second > 127) & (second != 0x97) & (second != 0xB7)] = WORD
            before, here = kind[:-1], kind[1:]
            cut = np.zeros(len(own), bool)
            white = here & CUT > 0
            cut[1:] = (white if self.drops_space else white & (before & WHITE == 0)) | ((here & SIGN > 0) & (before & WORD > 0))
            for start, stop in hard:
                cut[max(0, start - lo + back) : max(0, stop - lo + back)] = False
            cut = cut[back:]
            cut[begins[np.searchsorted(begins, lo) : np.searchsorted(begins, lo + SLICE)] - lo] = True
            found.append(np.flatnonzero(cut) + lo)
        return np.concatenate(found) if found else np.empty(0, "i8")

    def _words_of(self, data, starts, lengths):
        """The spans' first WIDTH bytes as three machine words, zero beyond the span."""
        import numpy as np

        q, r = starts >> 3, ((starts & 7) << 3).astype("u8")
        up, one = np.uint64(63) - r, np.uint64(1)
        parts = [data[q + k] for k in range(4)]
        return np.stack([((parts[k] >> r) | (parts[k + 1] << one << up)) & self.masks[np.clip(lengths - 8 * k, 0, 8)] for k in range(3)])

    def _look_up(self, raw, aligned, lowered, starts, lengths):
        """The number of each span; -1 for those too long to keep."""
        import numpy as np

        keys = self._words_of(aligned if lowered is None else lowered, starts, lengths)
        if lowered is not None:  # lower case for ASCII alone: the library composes letters before it lowers them
            other = np.flatnonzero((keys[0] | keys[1] | keys[2]) & np.uint64(0x8080808080808080))
            keys[:, other] = self._words_of(aligned, starts[other], lengths[other])
        h = self.table.mix(keys)
        out = self.table.find(keys, h)
        long = lengths > WIDTH
        out[long] = -1
        missing = np.flatnonzero((out < 0) & ~long)
        if len(missing):
            _, first, back = np.unique(h[missing], return_index=True, return_inverse=True)
            alike = (keys[:, missing] == keys[:, missing[first[back]]]).all(axis=0)
            long[missing[~alike]] = True  # another span has the same hash
            new = missing[first]
            before, place = self._learn([raw[s : s + n] for s, n in zip(starts[new].tolist(), lengths[new].tolist(), strict=True)])
            self.table.add(keys[:, new], h[new], before + place)
            out[missing[alike]] = before + place[back[alike]]
        at = np.flatnonzero(long & (lengths <= KEPT))
        spans = [raw[s : s + n] for s, n in zip(starts[at].tolist(), lengths[at].tolist(), strict=True)]
        unknown = list({s for s in spans if s not in self.long})
        if unknown:
            before, place = self._learn(unknown)
            self.long.update(zip(unknown, (before + place).tolist(), strict=True))
        out[at] = [self.long[s] for s in spans]
        return out

    def encode_ended(self, texts, end_id: int):
        """encode() with one more id at the end of each text."""
        import numpy as np

        ids, ends = self.encode(texts)
        ends = ends + np.arange(1, len(ends) + 1)
        out = np.empty(len(ids) + len(ends), "<u4")
        own = np.ones(len(out), bool)
        own[ends - 1] = False
        out[own], out[~own] = ids, end_id
        return out, ends

    def encode(self, texts):
        """texts: an Arrow array of strings -> (the ids of all texts, as little-endian unsigned 32-bit integers, and for
        each text where its ids end). A null has none."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if self.n > CACHE:
            self._forget()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], "<i8", n + 1, 8 * texts.offset) if n else np.zeros(1, "i8")
        total = int(offsets[-1] - offsets[0])
        if not total:
            return np.empty(0, "<u4"), np.zeros(n, "i8")
        data = np.zeros((total + 7) // 8 * 8 + 32, "u1")
        data[:total] = np.frombuffer(texts.buffers()[2], "u1")[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        raw = data[:total].tobytes()
        hard = np.flatnonzero(pc.match_substring_regex(texts, self.hard).to_numpy(zero_copy_only=False))
        begins = self._cuts(data[:total], offsets, [(int(offsets[k]), int(offsets[k + 1])) for k in hard])
        of_text = np.searchsorted(begins, offsets)
        starts, lengths = begins.copy(), np.diff(begins, append=total)
        if self.drops_space:
            space = self.classes[data[starts]] & CUT > 0
            starts += space
            lengths -= space
        loose = np.zeros(len(starts), bool)
        loose[of_text[hard]] = True  # hard texts are not kept
        aligned = data.view("<u8")
        lowered = self.lower[data].view("<u8") if self.drops_space else None
        number = np.full(len(starts), -1, "i8")
        for k in range(0, len(starts), CHUNK):
            own = k + np.flatnonzero(~loose[k : k + CHUNK])
            number[own] = self._look_up(raw, aligned, lowered, starts[own], lengths[own])
        known = self.n, self.n_ids
        rest = np.flatnonzero(number < 0)
        if len(rest):
            self._keep(*self._whole([raw[s : s + m].decode() for s, m in zip(starts[rest].tolist(), lengths[rest].tolist(), strict=True)]))
            number[rest] = known[0] + np.arange(len(rest))
        sizes = self.size[number]
        ends = np.cumsum(sizes, dtype="i8")
        out = np.empty(int(ends[-1]), "<u4")
        for k in range(0, len(starts), CHUNK):
            own = slice(k, k + CHUNK)
            lo = int(ends[k] - sizes[k])
            hi = int(ends[own][-1])
            out[lo:hi] = self.ids[np.repeat(self.first[number[own]] - (ends[own] - sizes[own]), sizes[own]) + np.arange(lo, hi)]
        self.n, self.n_ids = known
        return out, np.append(0, ends)[of_text[1:]]


def encoder(path: str, drops_space: bool) -> Encoder:
    """One encoder for each worker process, with the ids that Tokenizer.from_file gives."""
    return keep(("encoder", path, drops_space), lambda: Encoder(path, drops_space, spells_added=False))


def spread(texts):
    """Slices of an Arrow array of texts of about SLICE bytes, so that a batch's spans don't stand in memory all at
    once."""
    import numpy as np
    import pyarrow.compute as pc

    if len(texts):
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)) // SLICE
        cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(texts)]
        yield from (slice(a, b) for a, b in zip(cuts, cuts[1:], strict=False))
