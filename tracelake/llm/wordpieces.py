"""Token ids of many texts at once, in numpy, by a word-level BPE vocabulary whose pieces never span white space.

A block of bytes is cut into pretokens (runs of letters, runs of marks, single digits) by byte classes. Each pretoken is
a 64-bit hash that names a slot of a bounded table; what the table lacks is encoded once for each block, all of it side
by side: every round merges the best pair of every pretoken that still has one. Ids are then laid out by offsets.

Words that byte classes can't cut (letters beyond Latin-1, an apostrophe before a letter, marks of special tokens) and
very long pretokens go through the tokenizer itself, and so do all texts under a vocabulary of another make.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import tokens

#: Slots of the table, and ids that it holds before it is emptied.
SLOTS, POOL = 1 << 20, 1 << 23
#: Longer pretokens are merged by the tokenizer, whose time doesn't grow with the square of their length.
LONGEST = 64
# The parts of a tokenizer file that the byte classes below stand for.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS, WORD_END = ["NFC", "Replace", "Lowercase"], "</w>"

_OTHER, _LETTER, _MARK, _DIGIT = 0, 1, 2, 3
_U = np.uint64


def _classes() -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[0x21:0x7F] = _MARK
    out[0x30:0x3A] = _DIGIT
    out[0x41:0x5B] = out[0x61:0x7B] = _LETTER
    return out


#: Second bytes of the Latin-1 letters after 0xC3; the signs for times and divided by are none.
_LATIN = np.zeros(256, bool)
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_AS_IS = tokens.mix(np.arange(257, 513, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))


def _byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself where it is printable, else the next one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return [chr(256 + rest.index(b)) if b in rest else chr(b) for b in range(256)]


def _laid(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of these sizes end to end: where each begins, and each place's distance from its run's begin."""
    begin = np.cumsum(sizes) - sizes
    return begin, np.arange(int(sizes.sum())) - np.repeat(begin, sizes)


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one thread
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        made = json.loads(self.whole.to_str())
        self.fast = self._understood(made)
        if self.fast:
            self._read(made)
        self.keys, self.begin, self.count = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.int32)
        self.pool, self.used = np.zeros(POOL, np.uint32), 0

    @staticmethod
    def _understood(made: dict) -> bool:
        model, norm, pre = made["model"], made.get("normalizer") or {}, made.get("pre_tokenizer") or {}
        steps = pre.get("pretokenizers", [])
        if model.get("type") != "BPE" or model.get("end_of_word_suffix") != WORD_END or [n["type"] for n in norm.get("normalizers", [])] != NORMALIZERS or [p["type"] for p in steps] != ["Split", "ByteLevel"]:
            return False
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
        byte_level = not steps[1]["add_prefix_space"] and not steps[1].get("use_regex")
        return plain and byte_level and steps[0]["pattern"] == {"Regex": SPLIT} and steps[0]["behavior"] == "Removed" and steps[0]["invert"] and all(c + end in model["vocab"] for c in _byte_letters() for end in ("", WORD_END))

    def _read(self, made: dict) -> None:
        vocab = made["model"]["vocab"]
        letters = _byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + WORD_END] for c in letters], np.int64)
        self.size = max(vocab.values()) + 1
        merges = [m.split(" ") if isinstance(m, str) else m for m in made["model"]["merges"]]
        pairs = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        self.merged_id = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.rank = pairs[order], order.astype(np.int64)
        self.classes = _classes()
        # A special token is found in the text as it is: words that hold its first byte are left to the tokenizer.
        for token in made.get("added_tokens", []):
            self.classes[token["content"].encode()[0]] = _OTHER

    # Pretokens.
    def _cut(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start, end, hash and oddness (a whole word that classes can't cut) of each pretoken."""
        word_starts, word_ends = tokens.word_spans(data)
        kind = self.classes[data]
        lead = np.flatnonzero(data[:-1] == 0xC3)
        lead = lead[_LATIN[data[lead + 1]]]
        kind[lead] = kind[lead + 1] = _LETTER
        inner = ~tokens._SPACE[data]
        new = inner.copy()
        new[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        new[word_starts] = True
        apostrophe = np.flatnonzero(data[:-1] == 0x27)
        wrong = np.concatenate((np.flatnonzero(inner & (kind == _OTHER)), apostrophe[kind[apostrophe + 1] == _LETTER]))
        values = tokens._VALUES[data]
        odd = None
        if len(wrong):
            words = np.unique(np.searchsorted(word_starts, wrong, "right") - 1)
            edges = np.zeros(len(data) + 1, np.int8)
            edges[word_starts[words]] = 1
            edges[word_ends[words]] -= 1
            odd = np.cumsum(edges[:-1], dtype=np.int8).astype(bool)
            new[odd] = False
            new[word_starts[words]] = True
            values[odd] = _AS_IS[data[odd]]
        last = inner
        last[:-1] &= ~inner[1:] | new[1:]
        starts, ends = np.flatnonzero(new), np.flatnonzero(last) + 1
        hashes = tokens.hash_spans(values, starts, ends) if len(starts) else np.zeros(0, np.uint64)
        return starts, ends, np.maximum(hashes, _U(1)), np.zeros(len(starts), bool) if odd is None else odd[starts]

    # Merges.
    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or a number beyond all ranks."""
        pair = left * self.size + right
        at = np.searchsorted(self.pairs, pair)
        at[at == len(self.pairs)] = 0
        return np.where(self.pairs[at] == pair, self.rank[at], len(self.pairs))

    def _merge(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their numbers after all merges, of pretokens given as ids of their bytes, end to end.

        In each round every pretoken merges its pair of least rank, the leftmost of equals, as one after another would."""
        none = len(self.pairs)
        which = np.arange(len(sizes))
        owner = np.repeat(which, sizes)
        rank = np.full(len(ids), none)
        same = np.flatnonzero(owner[1:] == owner[:-1])
        rank[same] = self._ranks(ids[same], ids[same + 1])
        done_ids, done_which, done_sizes = [], [], []
        while len(sizes):
            best = np.minimum.reduceat((rank << 32) | np.arange(len(ids)), np.cumsum(sizes) - sizes)
            going = (best >> 32) < none
            if going.mean() < 0.7:
                stay = np.repeat(going, sizes)
                done_ids.append(ids[~stay])
                done_which.append(which[~going])
                done_sizes.append(sizes[~going])
                ids, rank, sizes, which = ids[stay], rank[stay], sizes[going], which[going]
                if not len(sizes):
                    break
                best = np.minimum.reduceat((rank << 32) | np.arange(len(ids)), np.cumsum(sizes) - sizes)
                going = np.ones(len(sizes), bool)
            at = best[going] & 0xFFFFFFFF
            ids[at] = self.merged_id[best[going] >> 32]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            # A merged symbol's pair with the next one is new, and so is that of the one before it with the merged symbol.
            rank[at] = none
            ids, rank, sizes = ids[keep], rank[keep], sizes - going
            at = at - np.arange(len(at))
            begin = np.cumsum(sizes) - sizes
            first, stop = begin[going], (begin + sizes)[going]
            right, left = at[at + 1 < stop], at[at > first]
            rank[right] = self._ranks(ids[right], ids[right + 1])
            rank[left - 1] = self._ranks(ids[left - 1], ids[left])
        which, sizes = np.concatenate(done_which), np.concatenate(done_sizes)
        ids = np.concatenate(done_ids)
        order = np.argsort(which)
        begin, inside = (np.cumsum(sizes) - sizes)[order], _laid(sizes[order])[1]
        return ids[np.repeat(begin, sizes[order]) + inside], sizes[order]

    def _new(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids, end to end, and their numbers of these pretokens."""
        sizes = ends - starts
        slow = odd | (sizes > LONGEST)
        plain = np.flatnonzero(~slow)
        counts = np.zeros(len(starts), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        if len(plain):
            n = sizes[plain]
            begin, inside = _laid(n)
            own = data[np.repeat(starts[plain], n) + inside]
            after = np.flatnonzero(own[:-1] == 0xC3) + 1
            own = _LOWER[own]
            own[after[own[after] < 0x9F]] += 0x20  # Latin-1 capitals
            ids = self.inner[own]
            final = begin + n - 1
            ids[final] = self.last[own[final]]
            merged, counts[plain] = self._merge(ids, n)
            parts.append((plain, merged))
        rest = np.flatnonzero(slow)
        if len(rest):
            found = [e.ids for e in self.whole.encode_batch([data[a:b].tobytes().decode() for a, b in zip(starts[rest], ends[rest], strict=True)], add_special_tokens=False)]
            counts[rest] = [len(x) for x in found]
            parts.append((rest, np.array([i for x in found for i in x], np.int64)))
        out = np.zeros(int(counts.sum()), np.uint32)
        at = np.cumsum(counts) - counts
        for which, ids in parts:
            out[np.repeat(at[which], counts[which]) + _laid(counts[which])[1]] = ids
        return out, counts

    def _block(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of a block, and where each pretoken starts and how many ids it has."""
        starts, ends, hashes, odd = self._cut(data)
        slot = (hashes & _U(SLOTS - 1)).astype(np.int64)
        known = self.keys[slot] == hashes
        counts, begin = np.where(known, self.count[slot], 0).astype(np.int64), self.begin[slot].astype(np.int64)
        missing = np.flatnonzero(~known)
        fresh = np.zeros(0, np.uint32)
        if len(missing):
            distinct, first, back = np.unique(hashes[missing], return_index=True, return_inverse=True)
            first = missing[first]
            fresh, sizes = self._new(data, starts[first], ends[first], odd[first])
            at = np.cumsum(sizes) - sizes
            counts[missing], begin[missing] = sizes[back], at[back]
        out = np.zeros(int(counts.sum()), np.uint32)
        to = np.cumsum(counts) - counts
        for which, source in ((np.flatnonzero(known), self.pool), (missing, fresh)):
            n = counts[which]
            inside = _laid(n)[1]
            out[np.repeat(to[which], n) + inside] = source[np.repeat(begin[which], n) + inside]
        if len(missing) and len(fresh) <= POOL // 4:
            if self.used + len(fresh) > POOL:
                self.keys[:] = 0
                self.used = 0
            self.pool[self.used : self.used + len(fresh)] = fresh
            slot = (distinct & _U(SLOTS - 1)).astype(np.int64)
            # Two new pretokens of one slot: the table's three columns must agree on which one stays.
            slot, one = np.unique(slot, return_index=True)
            self.keys[slot], self.begin[slot], self.count[slot] = distinct[one], (self.used + at)[one], sizes[one]
            self.used += len(fresh)
        return out, starts, counts

    def __call__(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, bool]]:
        """(text, ids, whether the text ends here) in order; a text longer than a block comes in parts. Null is the empty text."""
        nothing = np.zeros(0, np.uint32)
        if not self.fast:
            for i, text in enumerate(texts):
                yield i, np.array(self.whole.encode(text.as_py() or "", add_special_tokens=False).ids, np.uint32), True
            return
        at = 0
        for data, first, bounds, _ in tokens.cuts(texts):
            ids, starts, counts = self._block(data)
            owner = np.searchsorted(bounds, starts, "right")
            each = np.bincount(owner, counts, minlength=len(bounds)).astype(np.int64)
            edges = np.concatenate(([0], np.cumsum(each))).tolist()
            while at < first:
                yield at, nothing, True
                at += 1
            for i in range(len(bounds)):
                if i:
                    yield at, nothing, True
                    at += 1
                yield first + i, ids[edges[i] : edges[i + 1]], False
        while at < len(texts):
            yield at, nothing, True
            at += 1


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker and vocabulary: what one task has learnt the next one knows."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
