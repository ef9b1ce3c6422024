"""Word-level byte-pair encoding in batches, merged through segment trees.

Each word has a segment tree over the ranks of its adjacent pairs. A node holds the least
``rank * 2**32 + position`` below it, so the root is the leftmost pair of lowest rank. A merge
changes three leaves, each a point update of logarithmic cost, until the root holds no pair.
The trees of the words of all new chunks, by size class, lie side by side in one array, and numpy
advances them together, one merge a step. Small trees, which most words have, refill their inner
nodes level by level over all words at once; large ones go up from the changed leaves.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from tokenizers import Tokenizer

NONE = np.int64(2**62)
POSITION = np.int64(2**32 - 1)


#: Chunks of up to so many bytes are told apart by a tabulation hash of 64 bits, longer ones by BLAKE2.
TABULATED = 48
TABLE = np.random.default_rng(20).integers(1, 2**64, size=(TABULATED, 256), dtype=np.uint64).ravel()
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Letters of ASCII and, as bytes 0xC3 and one of SECOND, of Latin-1: every version of Unicode splits and lower-cases them alike.
LETTER = np.zeros(256, dtype=bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3]] = True
SECOND = np.zeros(256, dtype=bool)
SECOND[[b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] = True
LOWER, LOWER_SECOND = np.arange(256, dtype=np.uint8), np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
LOWER_SECOND[[b for b in range(0x80, 0x9F) if b != 0x97]] += 32
#: Up to so many leaves a tree is refilled as a whole.
SMALL = 32


class Words(dict):
    """Numbers words in order of first sight."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


def flatten(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The indices starts[i] .. starts[i] + lengths[i] of all i, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of data as one number, zeros behind the end."""
    return np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, dtype=np.uint8)]), strides=(1,))


#: Keeps so many low bytes of a number.
LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], dtype=np.uint64)


def same_bytes(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, lengths: np.ndarray, b_lengths: np.ndarray, by_eights: int = 8) -> np.ndarray:
    """Whether each string of a has the length and the bytes of its partner in b. Long strings are compared one by one."""
    same = lengths == b_lengths
    left, right = eight_bytes(a), eight_bytes(b)
    for k in range(by_eights):
        at = np.flatnonzero(same & (lengths > 8 * k))
        if not len(at):
            break
        same[at] = (left[a_starts[at] + 8 * k] ^ right[b_starts[at] + 8 * k]) & LOW_BYTES[np.minimum(lengths[at] - 8 * k, 8)] == 0
    for i in np.flatnonzero(same & (lengths > 8 * by_eights)).tolist():
        n = lengths[i]
        same[i] = a[a_starts[i] : a_starts[i] + n].tobytes() == b[b_starts[i] : b_starts[i] + n].tobytes()
    return same


class Encoded:
    """A batch of encoded texts: ids of text i are ids[bounds[i]:bounds[i + 1]]."""

    def __init__(self, ids: np.ndarray, bounds: np.ndarray):
        self.ids, self.bounds = ids, bounds

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def of(self, i: int) -> np.ndarray:
        return self.ids[self.bounds[i] : self.bounds[i + 1]]


class WordBpe:
    """Encodes as a tokenizers file of the word-end kind says: NFC, white space dropped, lower case, byte symbols, merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        self.tokens = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        self.size = max(self.tokens) + 1
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.find = regex.compile(pattern).findall
        # beyond ASCII the library's own tables decide, as other versions of Unicode split and lower-case differently
        parts = {"version": spec["version"], "model": {"type": "BPE", "vocab": {}, "merges": []}, "normalizer": spec["normalizer"], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split"]}}
        front = Tokenizer.from_str(json.dumps(parts | {"added_tokens": [], "truncation": None, "padding": None, "post_processor": None, "decoder": None}))
        self.normalise, self.pieces = front.normalizer.normalize_str, front.pre_tokenizer.pre_tokenize_str
        shown = byte_symbols()
        self.inner = np.array([vocab[shown[b]] for b in range(256)], dtype=np.int64)
        self.final = np.array([vocab[shown[b] + suffix] for b in range(256)], dtype=np.int64)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        ranked = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        self.pair_keys, self.pair_ranks = pair_slots(np.array([a * 2**20 + b for a, b in ranked], dtype=np.int64), np.array([r for r, _ in ranked.values()], dtype=np.int64))
        self.merged = np.zeros(len(merges), dtype=np.int64)
        for rank, new in ranked.values():
            self.merged[rank] = new
        every = np.arange(2**16)  # pairs of bytes: neither, or the second, is a word's last
        self.byte_pairs = np.stack([self.ranks(self.inner[every >> 8], last[every & 255], np.int64(0)) for last in (self.inner, self.final)])
        self.most_known = 400_000
        self.known = np.zeros(0, dtype=np.uint64)
        self.known_start, self.known_count = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int32)
        self.known_ids = np.zeros(0, dtype=np.uint32)
        self.known_data, self.known_at, self.known_length = np.zeros(0, dtype=np.uint8), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.token_bytes = [self.tokens.get(i, "").encode() for i in range(self.size)]
        self.shown = np.frombuffer(b"".join(t + b" " for t in self.token_bytes), dtype=np.uint8)
        self.shown_lengths = np.array([len(t) + 1 for t in self.token_bytes], dtype=np.int64)
        self.shown_starts = np.cumsum(self.shown_lengths) - self.shown_lengths

    def ranks(self, left: np.ndarray, right: np.ndarray, position: np.ndarray) -> np.ndarray:
        """rank * 2**32 + position of each pair, NONE where no merge joins it."""
        pairs = left * 2**20 + right
        key = pairs.ravel()
        at = first_slots(key, len(self.pair_keys))
        held = self.pair_keys[at]
        rank = np.where(held == key, self.pair_ranks[at], -1)
        further = np.flatnonzero((held != key) & (held >= 0))
        while len(further):
            at[further] = (at[further] + 1) & (len(self.pair_keys) - 1)
            held = self.pair_keys[at[further]]
            same = further[held == key[further]]
            rank[same] = self.pair_ranks[at[same]]
            further = further[(held != key[further]) & (held >= 0)]
        rank = rank.reshape(pairs.shape)
        return np.where(rank >= 0, (rank << 32) | position, NONE)

    def merge_words(self, raw: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each word, one after the other, and how many each has. raw: the words' bytes, one after the other."""
        starts = np.cumsum(lengths) - lengths
        symbols = self.inner[raw]
        symbols[starts + lengths - 1] = self.final[raw[starts + lengths - 1]]
        alive = np.ones(len(symbols), dtype=bool)
        size, pairs = 1, lengths - 1
        most = int(pairs.max(initial=0))
        while most:
            these = np.flatnonzero((pairs > size // 2) & (pairs <= size))
            step = max(1, 2**17 // size)
            for i in range(0, len(these), step):
                some = starts[these[i : i + step]], lengths[these[i : i + step]], size
                self._merge_small(raw, symbols, alive, *some) if size <= SMALL else self._merge_forest(symbols, alive, *some)
            if size >= most:
                break
            size *= 2
        kept = np.add.reduceat(alive, starts, dtype=np.int64) if len(lengths) else lengths
        return symbols[alive], kept

    def _merge_small(self, raw: np.ndarray, symbols: np.ndarray, alive: np.ndarray, starts: np.ndarray, lengths: np.ndarray, size: int) -> None:
        """Merges words with at most size pairs in place. Column w of each level is of word w; the levels are filled anew at every step."""
        n = len(starts)
        place = np.arange(size + 1)[:, None]
        inside = place < lengths
        flat = np.where(inside, starts + place, 0)
        word = np.where(inside, symbols[flat], -1)
        held = raw[flat].astype(np.int64)
        level = self.byte_pairs[(place[:-1] + 2 == lengths).astype(np.int64), (held[:-1] << 8) | held[1:]] + place[:-1]
        levels = [np.where(inside[1:], np.minimum(level, NONE), NONE)]
        while len(levels[-1]) > 1:
            levels.append(np.minimum(levels[-1][::2], levels[-1][1::2]))
        after = np.where(place + 1 < lengths, place + 1, size + 1)
        after = np.concatenate([after, np.full((1, n), size + 1)])  # behind the end is the end
        before = np.broadcast_to(place - 1, (size + 1, n)).copy()
        word = np.concatenate([word, np.full((1, n), -1)])
        columns = np.arange(n)  # where the words that still merge are in the result
        out, root = word, levels[-1][0]
        while len(active := np.flatnonzero(root < NONE)):
            if 4 * len(active) < 3 * n:
                if word is not out:
                    out[:, columns] = word
                columns, n = columns[active], len(active)
                word, after, before, *levels = (x.take(active, axis=1) for x in (word, after, before, *levels))
                active, root = np.arange(n), levels[-1][0]
            symbol, leaf, behind_of, ahead_of = word.ravel(), levels[0].ravel(), after.ravel(), before.ravel()
            top = root[active]
            at = top & POSITION
            here = at * n + active
            gone = behind_of[here]
            behind = behind_of[gone * n + active]
            ahead = ahead_of[here]
            new = self.merged[top >> 32]
            symbol[here] = new
            symbol[gone * n + active] = -1
            behind_of[here] = behind
            has = behind <= size
            leaf[here] = np.where(has, self.ranks(new, symbol[behind * n + active], at), NONE)
            ahead_of[(behind * n + active)[has]] = at[has]
            inner = gone < size  # the last symbol has no leaf of its own
            leaf[(gone * n + active)[inner]] = NONE
            has = np.flatnonzero(ahead >= 0)
            to = ahead[has] * n + active[has]
            leaf[to] = self.ranks(symbol[to], new[has], ahead[has])
            for below, level in zip(levels, levels[1:]):
                np.minimum(below[::2], below[1::2], out=level)
            root = levels[-1][0]
        if word is not out:
            out[:, columns] = word
        inside = np.flatnonzero(inside.ravel())
        symbols[flat.ravel()[inside]] = found = out[: size + 1].ravel()[inside]
        alive[flat.ravel()[inside]] = found >= 0

    def _merge_forest(self, symbols: np.ndarray, alive: np.ndarray, starts: np.ndarray, lengths: np.ndarray, size: int) -> None:
        """Merges words with at most size pairs in place; row w of tree is the segment tree of word w."""
        n = len(starts)
        place = np.arange(size + 1)
        inside = place[None, :] < lengths[:, None]
        word = np.where(inside, symbols[np.where(inside, starts[:, None] + place, 0)], -1)
        tree = np.full((n, 2 * size), NONE, dtype=np.int64)
        tree[:, size:] = np.where(inside[:, 1:], self.ranks(word[:, :-1], word[:, 1:], place[None, :-1]), NONE)
        level = size
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        after = np.where(place[None, :] + 1 < lengths[:, None], place[None, :] + 1, -1)
        before = np.broadcast_to(place - 1, (n, size + 1)).copy()

        def update(rows: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
            node = at + size
            tree[rows, node] = values
            while size > 1 and node[0] > 1:
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        rows = np.flatnonzero(tree[:, 1] < NONE)
        while len(rows):
            root = tree[rows, 1]
            at = root & POSITION
            gone = after[rows, at]
            word[rows, at] = self.merged[root >> 32]
            word[rows, gone] = -1
            behind = after[rows, gone]
            after[rows, at] = behind
            has = behind >= 0
            before[rows[has], behind[has]] = at[has]
            last = gone < size  # the last symbol has no leaf of its own
            if last.any():
                update(rows[last], gone[last], np.full(int(last.sum()), NONE))
            new = np.full(len(rows), NONE)
            new[has] = self.ranks(word[rows[has], at[has]], word[rows[has], behind[has]], at[has])
            update(rows, at, new)
            ahead = before[rows, at]
            has = ahead >= 0
            if has.any():
                update(rows[has], ahead[has], self.ranks(word[rows[has], ahead[has]], word[rows[has], at[has]], ahead[has]))
            rows = rows[tree[rows, 1] < NONE]
        w, p = np.nonzero(inside)
        symbols[starts[w] + p] = word[w, p]
        alive[starts[w] + p] = word[w, p] >= 0

    def _split(self, chunk: str) -> list[str]:
        """The words of a chunk in lower case."""
        if "<|" in chunk and self.split_special and (parts := self.split_special.split(chunk))[1:]:
            return [w for k, part in enumerate(parts) for w in ([self.special[part]] if k % 2 else self._split(part))]
        if not chunk.isascii():
            return [w for w, _ in self.pieces(self.normalise(chunk))]
        plain = chunk.lower()
        if plain.isalpha():
            return [plain]
        return [plain[:-1], plain[-1]] if plain[-1:] in (".", ",") and plain[:-1].isalpha() else self.find(plain)

    def _encode_chunks(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each chunk of data, one after the other, and how many each has.

        Chunks of letters of ASCII and Latin-1, with a full stop or comma behind them or not, are words as they are, in lower case.
        """
        raw = data[flatten(lengths, starts)]
        begin = np.cumsum(lengths) - lengths
        second = np.zeros(len(raw), dtype=bool)
        second[1:] = (raw[:-1] == 0xC3) & SECOND[raw[1:]]
        lower = np.where(second, LOWER_SECOND[raw], LOWER[raw])
        odd = np.add.reduceat(~(LETTER[raw] | second), begin, dtype=np.int64) if len(lengths) else lengths
        marks = raw[begin + lengths - 1].astype(np.int64)
        marked = (odd == 1) & ((marks == 0x2E) | (marks == 0x2C)) & (lengths > 1)
        plain = (odd == 0) | marked
        bodies = np.where(plain, lengths - marked, 0)
        others = np.flatnonzero(~plain)
        number = Words()
        split = [self._split(raw[a:z].tobytes().decode(errors="replace")) for a, z in zip(begin[others].tolist(), (begin + lengths)[others].tolist(), strict=True)]
        per_chunk = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        flat = np.fromiter(map(number.__getitem__, chain.from_iterable(split)), dtype=np.int64, count=int(per_chunk.sum()))
        words = [w.encode() for w in number if not isinstance(w, int)]
        merged, kept = self.merge_words(
            np.concatenate([lower[flatten(bodies[plain], begin[plain])], np.frombuffer(b"".join(words), dtype=np.uint8)]),
            np.concatenate([bodies[plain], np.fromiter(map(len, words), dtype=np.int64, count=len(words))]),
        )
        alone = [w for w in number if isinstance(w, int)]  # tokens that stand for themselves
        own = np.fromiter((not isinstance(w, int) for w in number), dtype=bool, count=len(number))
        n_plain = int(plain.sum())
        counts = np.ones(len(number), dtype=np.int64)
        counts[own] = kept[n_plain:]
        at = np.cumsum(kept) - kept
        from_ids = np.empty(len(number), dtype=np.int64)
        from_ids[own] = at[n_plain:]
        from_ids[~own] = len(merged) + np.arange(len(alone))
        pool = np.concatenate([merged, np.array(alone, dtype=np.int64), self.final]).astype(np.uint32)
        final = len(merged) + len(alone)
        # the runs of the pool that make up each chunk: a word and its mark, or the words of _split
        runs = np.where(marked, 2, 1)
        runs[others] = per_chunk
        first = np.cumsum(runs) - runs
        run_start, run_count = np.empty(int(runs.sum()), dtype=np.int64), np.ones(int(runs.sum()), dtype=np.int64)
        run_start[first[plain]], run_count[first[plain]] = at[:n_plain], kept[:n_plain]
        run_start[first[marked] + 1] = final + marks[marked]
        spread = flatten(per_chunk, first[others])
        run_start[spread], run_count[spread] = from_ids[flat], counts[flat]
        ends = np.concatenate([[0], np.cumsum(run_count)])
        return pool[flatten(run_count, run_start)], np.diff(ends[np.concatenate([[0], np.cumsum(runs)])])

    def encode_arrow(self, column: pa.Array) -> Encoded:
        """Encodes the whole texts of an Arrow column; null counts as empty.

        Tokens never cross white space, so the chunks between are encoded once each. Known chunks
        are kept by their hash, up to a bound, for the batches to come. A hash only proposes an equal chunk:
        bytes decide, and chunks that share a hash with other bytes are encoded on their own.
        """
        column = column.cast(pa.large_string()).fill_null("")
        bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[bounds[0] : bounds[-1]]
        starts, lengths, hashes, per_text = split_chunks(data, bounds - bounds[0])
        codes, distinct = pd.factorize(hashes)
        first = np.empty(len(distinct), dtype=np.int64)
        first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        like = first[codes]
        others = np.flatnonzero(~same_bytes(data, starts, data, starts[like], lengths, lengths[like]))
        alone = Words()  # chunks whose hash another one of the batch has
        codes[others] = [len(distinct) + alone[data[starts[i] : starts[i] + lengths[i]].tobytes()] for i in others.tolist()]
        first = np.concatenate([first, np.zeros(len(alone), dtype=np.int64)])
        first[codes[others[::-1]]] = others[::-1]
        old = np.zeros(len(first), dtype=bool)
        begin, count = np.zeros(len(first), dtype=np.int64), np.zeros(len(first), dtype=np.int64)
        taken = np.zeros(len(first), dtype=bool)  # hashes that can't be kept for this chunk
        taken[len(distinct) :] = True
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, distinct), len(self.known) - 1)
            hit = np.flatnonzero(self.known[at] == distinct)
            taken[hit] = True
            hit = hit[same_bytes(data, starts[first[hit]], self.known_data, self.known_at[at[hit]], lengths[first[hit]], self.known_length[at[hit]])]
            old[hit] = True
            begin[hit], count[hit] = self.known_start[at[hit]], self.known_count[at[hit]]
        fresh = np.flatnonzero(~old)
        new_ids, new_count = self._encode_chunks(data, starts[first[fresh]], lengths[first[fresh]])
        begin[fresh], count[fresh] = len(self.known_ids) + np.cumsum(new_count) - new_count, new_count
        pool = np.concatenate([self.known_ids, new_ids])
        ids = pool[flatten(count[codes], begin[codes])]
        total = np.concatenate([[0], np.cumsum(count[codes])])
        if len(self.known) + len(fresh) <= self.most_known and len(pool) <= 8 * self.most_known:
            keep = fresh[~taken[fresh]]
            at, size = starts[first[keep]], lengths[first[keep]]
            keys = np.concatenate([self.known, distinct[keep]])
            order = np.argsort(keys, kind="stable")
            self.known, self.known_ids = keys[order], pool
            self.known_start = np.concatenate([self.known_start, begin[keep].astype(np.int32)])[order]
            self.known_count = np.concatenate([self.known_count, count[keep].astype(np.int32)])[order]
            self.known_at = np.concatenate([self.known_at, len(self.known_data) + np.cumsum(size) - size])[order]
            self.known_length = np.concatenate([self.known_length, size])[order]
            self.known_data = np.concatenate([self.known_data, data[flatten(size, at)]])
        return Encoded(ids, total[np.concatenate([[0], np.cumsum(per_text)])])

    def encode_batch(self, texts: list[str | None]) -> Encoded:
        """Encodes whole texts; None counts as the empty text."""
        return self.encode_arrow(pa.array(texts, pa.string()))

    def decoded_bytes(self, e: Encoded, tokens: int = 2**19) -> Iterator[bytes]:
        """The decoded text of each text of a batch in UTF-8; about so many tokens are laid out at once."""
        first = 0
        while first < len(e):
            last = max(first + 1, int(np.searchsorted(e.bounds, e.bounds[first] + tokens, side="right")) - 1)
            ids = e.ids[e.bounds[first] : e.bounds[last]]
            lengths = self.shown_lengths[ids]
            laid = self.shown[flatten(lengths, self.shown_starts[ids])].tobytes()
            cuts = np.concatenate([[0], np.cumsum(lengths)])[e.bounds[first : last + 1] - e.bounds[first]].tolist()
            for a, z in zip(cuts, cuts[1:]):
                yield laid[a : max(a, z - 1)]
            first = last

    def decode(self, ids) -> str:
        """The tokens with spaces between, as a file without a decoder says."""
        return b" ".join([self.token_bytes[i] for i in ids]).decode()


def first_slots(keys: np.ndarray, slots: int) -> np.ndarray:
    """Where the search for each key begins in a table of so many slots, a power of two."""
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - slots.bit_length())).astype(np.int64)


def pair_slots(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their values in a table four times as large or more, each at its first slot or the next free one; -1 where there is none."""
    slots = 1 << max(8, int(4 * len(keys)).bit_length())
    held, told = np.full(slots, -1, dtype=np.int64), np.zeros(slots, dtype=np.int64)
    left, at = np.arange(len(keys)), first_slots(keys, slots)
    while len(left):
        free = left[held[at[left]] < 0]
        held[at[free]] = keys[free]  # of several keys one stays
        stays = free[held[at[free]] == keys[free]]
        told[at[stays]] = values[stays]
        left = left[held[at[left]] != keys[left]]
        at[left] = (at[left] + 1) & (slots - 1)
    return held, told


def tabulated(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The sum over a chunk's first bytes of what TABLE says for each place and byte; long chunks are summed in part."""
    size = np.minimum(lengths, TABULATED).astype(np.uint8)
    order = np.argsort(TABULATED - size, kind="stable")  # the longest first: those that have a k-th byte are the first ones
    longer = len(size) - np.cumsum(np.bincount(size, minlength=TABULATED + 1))
    at, sums = starts[order], np.zeros(len(size), dtype=np.uint64)
    for k in range(TABULATED):
        n = int(longer[k])
        if not n:
            break
        sums[:n] += TABLE[k * 256 : (k + 1) * 256][data[at[:n] + k]]
    out = np.empty_like(sums)
    out[order] = sums
    return out


def split_chunks(data: np.ndarray, bounds: np.ndarray, step: int = 2**16) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where the runs of other bytes than white space begin, their lengths and hashes, and how many each text has."""
    inside = ~SPACE[data]
    edge = inside.copy()
    edge[1:] &= ~inside[:-1]
    cuts = bounds[:-1][(bounds[:-1] < len(data)) & (bounds[1:] > bounds[:-1])]
    edge[cuts] = inside[cuts]
    starts = np.flatnonzero(edge)
    stop = np.empty(len(data), dtype=bool)
    stop[:-1] = inside[:-1] & (~inside[1:] | edge[1:])
    stop[-1:] = inside[-1:]
    lengths = np.flatnonzero(stop) + 1 - starts
    hashes = np.empty(len(starts), dtype=np.uint64)
    for first in range(0, len(starts), step):
        hashes[first : first + step] = tabulated(data, starts[first : first + step], lengths[first : first + step])
    for i in np.flatnonzero(lengths > TABULATED).tolist():
        hashes[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : starts[i] + lengths[i]].tobytes(), digest_size=8).digest(), "little")
    per_text = np.diff(np.searchsorted(starts, bounds))
    return starts, lengths, hashes, per_text


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


@functools.lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    """The encoder of a file, once in each Python worker; Arrow gives freed memory back there."""
    pa.set_memory_pool(pa.system_memory_pool())
    return WordBpe(path)
